"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block on its own: by the
containers it lies in, where the page names them, by link density, length and stop-word density, as
good, bad or undecided. Pass two gives undecided blocks, short ones above all, the label of their
nearest decided neighbours: those in the same innermost section first, then those in page order;
between two at the same distance that disagree, the longer block decides. Reading a page takes time
in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, pieces

#: Words of a block that is long enough to be decided by density, and the densities that decide.
SHORT_WORDS = 15
LONG_WORDS = 25
STOP_LOW = 0.08
STOP_HIGH = 0.2
LINK_HIGH = 0.4

#: Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se son sur un une vous "
    "aber als am auch auf aus bei das dem den der des die durch ein eine er es für hat ich im ist mit nach nicht oder sich sie sind um und von vor war wie wir zu zum zur über "
    "al como con del el ella en entre es esta este ha la las lo los más no o para pero por se ser si sin sobre su sus también una uno y ya".split()
)

#: Tags that start and end blocks; all others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page.
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video head title select button textarea datalist map".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title".split())
#: Elements of other languages: hidden up to their end, if they have one.
FOREIGN_TAGS = frozenset(("svg", "math"))
#: Inside a select only these are its own; any other block, and a control, ends it.
SELECT_TAGS = frozenset("option optgroup hr".split())
CONTROLS = frozenset("input textarea select".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark page furniture, and those that mark the article.
BOILER_WORDS = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumb\w*|header|masthead|footer|foot|copyright|legal|share|sharing|social|related|recommend\w*|more-stories|pagination|pager|tags|toolbar|search|comments?|commentlist|reply|replies|disqus|respond|skip|alert|contentinfo|complementary|search|dialog|form)(?:$|[\s_-])",
    re.I,
)
#: Marks that mean furniture of the page, but the headline's place inside an article.
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:main|article|articlebody|post|entry|story|content|body-?text)(?:$|[\s_-])", re.I)
#: Whole names that mark the article: beside them a name counts as furniture only as a whole.
MAIN_NAMES = re.compile(r"main|content|article|articlebody|hentry|post|entry|story|body-?text|(?:main|article|page|post|entry|story)[_-]?(?:content|body|text)", re.I)
#: Names that tell a state or a topic of what they stand on, not what it is.
STATE_NAMES = re.compile(r"(?:category|cat|tag|term|author|type|status|format|has|with|no|is)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled|on|off)", re.I)

#: What a tag holds after its name: a quote opens a value only after =. Without an end a tag runs to the end of the page, as does a quote.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_REST})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ENDS_OF = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in RAW_TAGS | FOREIGN_TAGS}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: A block that opens so is the notice at the foot of a page.
_NOTICE = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)


@dataclass
class Block:
    """One block: its text, the characters of it inside links, and where it lies."""

    text: str
    linked: int
    section: int
    main: bool
    boiler: bool
    heading: bool


@dataclass
class _Open:
    tag: str
    section: int
    main: bool
    boiler: bool
    hidden: bool


def _marks(attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """(boilerplate, main, hidden) by the attributes of a tag; `inside` an article its header is text.

    Names that tell a state count for nothing. Beside a whole name of the article, in class or id,
    others are furniture only if a whole name says so, not a part of one.
    """
    hidden, names, roles = False, [], []
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = html.unescape(a or b or c), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "id"):
            names += [x for x in value.split() if not STATE_NAMES.fullmatch(x)]
        elif name == "role":
            roles += value.split()
    main = any(MAIN_WORDS.search(x) for x in names + roles)
    whole = any(MAIN_NAMES.fullmatch(x) for x in names)
    boiler = False
    for x in names + roles:
        rest = HEADER_WORDS.sub(" ", x) if inside or MAIN_WORDS.search(x) else x
        found = BOILER_WORDS.search(rest)
        boiler |= bool(found and (not whole or found.group().strip() == x))
    return boiler, main and not boiler, hidden


#: Tags that an opening tag ends when it finds them open: list items, paragraphs, cells.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; empty ones are left out."""
    stack = [_Open("", 0, False, False, False)]
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, heading, sections, at = 0, False, False, 0, 0
    open_ = Counter()

    def close(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top.section, top.main, top.boiler, heading))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].hidden:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    endless: set[str] = set()
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(html.escape(m["cdata"]))
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _ENDS_OF:
            if not m["close"] and not (tag in FOREIGN_TAGS and m["attrs"].endswith("/")):
                end = None if tag in endless else _ENDS_OF[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                    at = len(page) if tag in RAW_TAGS else at
            continue
        if open_["select"] > 0 and not m["close"] and (tag in CONTROLS or tag in BLOCK_TAGS and tag not in SELECT_TAGS):
            close(next(k for k in range(len(stack)) if stack[k].tag == "select"))
            if tag == "select":
                continue
        if tag == "a":
            in_link = not m["close"]
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        if m["close"]:
            if tag in BLOCK_TAGS:
                flush()
                in_link = False
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BLOCK_TAGS and tag not in BLOCK_TAGS and tag != "select":
                    break
            heading = False if tag in BLOCK_TAGS else heading
            continue
        if tag in BLOCK_TAGS:
            flush()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            for k in range(len(stack) - 1, 0, -1) if tag not in SELECT_TAGS or open_["select"] <= 0 else ():
                if stack[k].tag in _ENDS.get(tag, ()) or stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK_TAGS:
                    break
        elif tag not in HIDDEN_TAGS and not m["attrs"]:
            continue
        if m["attrs"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        top = stack[-1]
        boiler, main, hidden = _marks(m["attrs"], top.main)
        is_main = tag in MAIN_TAGS or main
        is_boiler = tag in BOILER_TAGS or boiler and tag not in ("html", "body") or tag == "header" and not top.main
        if tag not in BLOCK_TAGS and not (hidden or is_boiler or tag in HIDDEN_TAGS):
            continue
        if tag in ("article", "main", "section", "div", "nav", "aside", "header", "footer", "form", "table", "ul", "ol"):
            sections += 1
            section = sections
        else:
            section = top.section
        open_[tag] += 1
        stack.append(_Open(tag, section, (top.main or is_main) and tag not in ("html", "body"), top.boiler or is_boiler, top.hidden or hidden or tag in HIDDEN_TAGS))
    add(page[at:])
    flush()
    return out


def classify(found: list[Block]) -> list[bool | None]:
    """Pass one: True for text, False for boilerplate, None if the block alone can't tell."""
    labels: list[bool | None] = []
    for b in found:
        words = [w.lower() for w in _WORD.findall(b.text)]
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        links = b.linked / len(b.text)
        if b.boiler or _NOTICE.match(b.text) and len(words) < LONG_WORDS and not b.main:
            labels.append(False)
        elif links > LINK_HIGH and not (b.main and density >= STOP_HIGH):
            labels.append(False)
        elif b.heading or len(words) < SHORT_WORDS:
            labels.append(None)
        elif density >= STOP_HIGH or len(words) >= LONG_WORDS and density >= STOP_LOW:
            labels.append(True)
        elif len(words) >= LONG_WORDS and not b.main and density < STOP_LOW / 4 and "." not in b.text:
            labels.append(False)
        else:
            labels.append(None)
    return labels


def inherit(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Pass two: undecided blocks take the label of the nearest decided neighbours.

    Neighbours in the block's own section come first, then those inside the same article, then any.
    A block inside an article without a decided neighbour there is text; elsewhere it isn't.
    """
    n = len(found)

    def nearest(keys: list) -> list[bool | None]:
        """For each block the label of the nearest decided one in its stretch of equal keys; a None key is in no stretch."""
        sides = []
        for order in (range(n), range(n - 1, -1, -1)):
            last, before, seen = [None] * n, None, None
            for i in order:
                if keys[i] is None or keys[i] != before:
                    seen = None
                last[i] = seen
                if labels[i] is not None and keys[i] is not None:
                    seen = i
                before = keys[i]
            sides.append(last)
        return [min(((abs(i - j), -len(found[j].text), labels[j]) for j in two if j is not None), default=(0, 0, None))[2] for i, two in enumerate(zip(*sides))]

    own = nearest([b.section for b in found])
    inside = nearest([True if b.main and not b.boiler else None for b in found])
    any_ = nearest([True] * n)
    out = []
    for i, b in enumerate(found):
        verdict = labels[i] if labels[i] is not None else own[i]
        if verdict is None and b.main:
            verdict = inside[i] is not False
        out.append(bool(any_[i] if verdict is None else verdict))
    return out


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by two newlines; empty if there is none."""
    found = blocks(page or "")
    keep = inherit(found, classify(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Each row of pages with `text` in place of the html; other columns stay as they are, but for an own `text`.

    A null html is the empty page and gives the empty text. Rows are independent: no shuffle.
    """
    bounded_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in (html_column, "text")]
    rows = pages.select(*names, F.coalesce(F.col(html_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = pa.array([main_text(x) for x in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    A null or empty html, or one without main text, gives the empty text; markup that doesn't end
    runs to the end of the page. Repeated rows and ids stay as they are, other columns are left out.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
