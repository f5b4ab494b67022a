"""Corpus operators on small, odd tables: against brute force, round trips and their SQL."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from deltaloom.llm import ann, bpe, common, components, decontaminate, html, lm, minhash, packing, queries, simhash, suffixes, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids int, fp string"


def docs_of(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "own", 7, "own") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(300))
    other = " ".join(rng.choice(words) for _ in range(300))
    rows = [
        (1, base),
        (2, base),
        (3, base.replace(base[200:206], "QWERTY")),
        (4, other),
        (5, other[:700] + " " + base[300:1100] + " " + other[700:]),
        (6, ""),
        (7, None),
        (8, "   \t\n"),
        (9, "One"),
        (10, "one Two"),
        (11, "é🙂 ü\x0b" * 300),
        (12, "ab" * 700),
        (13, "x" * 5000),
        (14, "word " * 20000),
        (15, " ".join(rng.choice(words) for _ in range(5000))),
        (16, "ABC def ghi"),
        (17, "abc DEF ghi"),
        (1, base),
        (None, "no id here at all"),
        (None, base),
    ]
    return rows, docs_of(spark, rows).repartition(3).cache()


def by_rows(rows):
    return collections.Counter(rows)


# --- shared pieces -----------------------------------------------------------------------------


def test_word_hashes(odd):
    texts = [t or "" for _, t in odd[0]]
    hashes, offsets = tokens.word_hashes(pa.array(texts))
    names: dict[int, bytes] = {}
    for i, t in enumerate(texts):
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
        got = hashes[offsets[i] : offsets[i + 1]].tolist()
        assert len(got) == len(words)
        assert all(names.setdefault(h, w) == w for h, w in zip(got, words))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 1)]
    root = {x: x for e in edges for x in e if None not in e}
    for _ in range(80):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == root
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


# --- 1 -----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd):
    rows, docs = odd
    fp = [brute_fingerprint(t) for _, t in rows]
    component = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            component[i] = min(component[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 2)
    least = {c: min((rows[i][0] for i in range(len(rows)) if component[i] == c and rows[i][0] is not None), default=None) for c in component}
    want = by_rows((rows[i][0], fp[i], least[component[i]]) for i in range(len(rows)))
    got = simhash.near_duplicates(docs).collect()
    assert by_rows((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("nodes", [4, 2048])
def test_simhash_links_in_split_shards(spark, monkeypatch, nodes):
    """Crowded fingerprints: shards over the limit are split, and no link is lost."""
    monkeypatch.setattr(simhash, "SHARD_NODES", nodes)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64) for _ in range(3)]
    fps = np.unique(base[rng.integers(0, 4, 250)] ^ flips[0] ^ flips[1] ^ flips[2])
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    root = np.arange(len(fps))
    for _ in range(len(fps)):
        root = np.array([root[near[i]].min() for i in range(len(fps))])
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = components.connected_components(simhash.links(frame))
    got = {r.node: r.root for r in found.collect()}
    groups = collections.defaultdict(set)
    for x, r in zip(fps.view(np.int64).tolist(), root):
        groups[r].add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k, v in got.items() if v == r) for r in set(got.values())}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def share(a, b):
    return len(a & b) / max(1, len(a | b))


def brute_similar(texts):
    """doc -> smallest doc that pairs of equal words or a share of 0.8 reach."""
    root, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and (sets[a] == sets[b] or share(sets[a], sets[b]) >= 0.8)]
    for _ in texts:
        before = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


def spread(words, swaps, tag):
    """The words with `swaps` of them replaced, evenly spread."""
    out = list(words)
    for k in range(swaps):
        out[(2 * k + 1) * len(words) // (2 * swaps)] = f"{tag}x{k}"
    return " ".join(out)


@pytest.mark.parametrize("block", [4, 1024])
def test_duplicates(spark, odd, monkeypatch, block):
    """Swaps around 0.8, long texts near it, and groups over the block's size."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts, k = {i: t for i, t in odd[0] if i is not None}, 100
    for n, swaps in ((50, 1), (100, 2), (200, 4), (3000, 60), (3000, 68), (3000, 75)):
        for g in range(6):
            base = [f"n{n}s{swaps}g{g}w{j}" for j in range(n)]
            for text in (" ".join(base), spread(base, swaps, f"swap{k}")):
                texts[k], k = text, k + 1
    base = [f"many{j}" for j in range(200)]
    for j in range(30):
        texts[k], k = spread(base, 1 + j % 3, f"own{j}"), k + 1
    got = {r.doc_id: r.component_id for r in minhash.duplicates(docs_of(spark, texts.items()).withColumn("row", F.lit(0).cast("bigint"))).collect()}
    assert got == brute_similar(texts) and len(set(got.values())) < len(got) - 40
    assert minhash.duplicates(odd[1].where("doc_id IS NOT NULL").limit(0).withColumn("row", F.lit(0).cast("bigint"))).isEmpty()


def test_repeated_lines_are_no_similarity(spark, odd):
    """Texts of one repeated line and their own words have near fingerprints and stay."""
    line = "this is the line that all of the pages repeat "
    rows = [(k, line * 40 + " ".join(f"own{k}w{j}" for j in range(100 + k))) for k in range(20)]
    docs = docs_of(spark, rows)
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) < 20
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == 20


# --- 2 -----------------------------------------------------------------------------------------


def strongest(text, grammar):
    """The first of READINGS that each clause with one has, of all clauses together."""
    found = toxicity.clause_counts(text, grammar.automaton())
    return [toxicity.READINGS[min(found)]] if found else []


def test_toxic_readings():
    def of(text):
        return strongest(text, toxicity.default_grammar())

    assert of("You are an idiot") == ["insult_target"]
    assert of("what an IDIOT!") == ["insult"]
    assert of("this is not an idiot") == of("nobody is an idiot") == ["negated"]
    assert of("the paper said idiot") == ["reported"]
    assert of("I will kill you.") == of("ich werde dich töten") == of("je vais te tuer") == ["threat_target"]
    assert of("They kill the process that you started") == of("you can kill it") == ["threat"]
    assert of("idiotic###") == ["insult"]
    assert of("") == of("a clear idiom, trashed") == []
    both = toxicity.clause_counts("You idiot, I will kill you", toxicity.default_grammar().automaton())
    assert {toxicity.READINGS[k] for k in both} == set(toxicity.READINGS)


def enumerated_readings(symbols):
    """All readings, from what surrounds each insult and threat, with those that they imply."""
    found, hits = set(), ("insult", "threat", "slur")

    def near(i, step):
        """Symbols beside i that are within reach, which insults and threats don't use up."""
        out, left, j = [], toxicity.REACH, i + step
        while 0 <= j < len(symbols) and left:
            out.append(symbols[j])
            left -= symbols[j] not in hits
            j += step
        return out

    for i, s in enumerate(symbols):
        if s in hits:
            said, negated = s != "slur" and "report" in symbols[:i], s != "slur" and "negation" in near(i, -1)
            person = s != "threat" and {"target", "second", "object"} & set(symbols)
            person = person or s == "threat" and ("object" in near(i, -1) or {"second", "object"} & set(near(i, 1)))
            kind = "threat" if s == "threat" else "insult"
            names = ["reported"] if said else ["negated"] if negated else [kind, f"{kind}_target"] if person else [kind]
            found |= {x for n in names for x in (n, *toxicity.IMPLIED.get(n, ()))}
    return frozenset(map(toxicity.READINGS.index, found))


def test_machine_against_enumeration():
    rng = random.Random(4)
    for _ in range(5000):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(12))]
        assert toxicity.readings(symbols) == enumerated_readings(symbols), symbols


def test_clauses_against_splitting():
    """Clauses that the automaton finds, against all clauses of the text; and in linear time."""
    import time

    rng, grammar = random.Random(9), toxicity.default_grammar({"zorb": "insult"})
    words = ["idiot", "kill", "you", "not", "said", "house", "zorbs", "zorb", "idiots"]
    kinds = {"idiot": "insult", "kill": "threat", "zorbs": "insult"}
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "; ", "\n", "!"]) for _ in range(rng.randrange(20)))
        found = [enumerated_readings([toxicity._symbol(w, kinds) for w in clause.split()]) for clause in re.split(r"[.!?;:\n\r]", text)]
        assert toxicity.clause_counts(text, grammar.automaton()) == collections.Counter(k for r in found for k in r), text
    began = time.process_time()
    assert toxicity.clause_counts("an idiot, " * 10 + "you idiot. " * 100_000, grammar.automaton())[1] == 100_000
    assert time.process_time() - began < 10


def test_words_beside_their_stems():
    """A spelling that is a whole word and a learned stem matches as either."""
    grammar = toxicity.default_grammar({"moron": "insult", "kill": "insult", "zorb": "insult"})
    grammar.words |= {"zorb": "insult"}

    def of(text):
        return strongest(text, grammar)

    assert of("what a moron!") == of("what morons!") == of("a moronic idea") == of("a zorb") == of("some zorbs") == ["insult"]
    assert of("I will kill you") == ["threat_target"] and of("you killjoy") == ["insult_target"]
    assert of("an oxymoron") == of("a zor") == []


def test_toxicity(spark, odd):
    rng = random.Random(2)
    clean = ["".join(rng.choice("aeioukl") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(40)] = "zorg" + rng.choice(["la", "mi", "ku"]) if i % 2 else "moron"
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] * (1 + i % 2)
    labels += [(None, 1), (0, None), (99999, 1)]
    docs, labelled = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labelled)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 600 and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)
    grammar = toxicity.learn(odd[1], labelled.limit(0))
    scored = toxicity.score(odd[1], grammar).collect()
    assert len(scored) == len(odd[0]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    kept = toxicity.keep_clean(odd[1], grammar)
    assert kept.columns == odd[1].columns and kept.count() == len(odd[0])
    assert toxicity.score(odd[1].limit(0), toxicity.learn(odd[1].limit(0), labelled)).isEmpty()


def test_toxicity_held_out(spark):
    found = queries.queries()["op2_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    held = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


# --- 3 -----------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> <a href=/x>News</a></header>
<div class="cookie-notice">We use cookies.</div><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<main><article><h1>Head &amp; line</h1><p>The first&nbsp;paragraph of the article is long enough for the rules,
and it has <a href=/z>a link</a> &#8212; in it.<p>Short one.</p><div class=ad>Buy now, the best of the best for you and all of your friends.</div>
<ul><li>item one</li><li>item two</li></ul><p>The last paragraph of the story has to be there, with its full text.</p></article>
<section id="comments"><p>This is what a reader has to say about the article, and it is long enough.</p></section></main>
<aside>Related stories of the day</aside><form><p>Sign up for the list of the day</p></form><footer>&copy; 2020 the site</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_html_extraction(spark):
    want = ["Head & line", "The first paragraph of the article is long enough for the rules, and it has a link — in it.", "Short one.", "item one", "item two", "The last paragraph of the story has to be there, with its full text."]
    assert html.main_text(PAGE).split("\n\n") == want
    for page in ("", None, "<", "<p", "<!--", "<script>", "&amp", "</p></div>", "<p>" * 3000, "<div " * 500):
        assert isinstance(html.main_text(page), str)
    pages = spark.createDataFrame([(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (2, None, None, "x"), (None, "v", "", "y")], "page_id bigint, url string, html string, text string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert by_rows((r.page_id, r.text == "") for r in got.collect()) == by_rows([(1, False), (1, False), (2, True), (None, True)])
    assert html.extract(pages.limit(0)).isEmpty()


def test_html_articles(spark):
    import html as entities

    found = {r.page_id: r for r in queries.queries()["op3_html_extraction"](spark, SF).collect()}
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert found[page_id].text == "\n\n".join(x for x in parts if x) and found[page_id].n_chars == len(found[page_id].text)


def naive_inherit(found, labels):
    """Pass two by a scan from each block."""
    def near(i, same):
        sides = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(found) and same(found[j]):
                if labels[j] is not None:
                    sides.append((abs(i - j), -len(found[j].text), labels[j]))
                    break
                j += step
        return min(sides)[2] if sides else None

    out = []
    for i, (b, label) in enumerate(zip(found, labels)):
        if label is None:
            label = near(i, lambda x: x.section == b.section)
            if label is None and b.main:
                label = near(i, lambda x: x.main and not x.boiler)
                label = True if label is None else label
            if label is None:
                label = near(i, lambda x: True)
        out.append(bool(label))
    return out


def test_html_passes():
    """Pass one by its rules, pass two against scans, over random blocks."""
    rng = random.Random(6)
    for _ in range(300):
        found, labels, section = [], [], 0
        for _ in range(rng.randrange(25)):
            section = rng.choice([section, section, rng.randrange(4)])
            boiler = rng.random() < 0.15
            found.append(html.Block("x" * rng.randint(1, 9), 0, section, section == 1, boiler, False))
            labels.append(False if boiler else rng.choice([True, False, None, None, None]))
        assert html.inherit(found, labels) == naive_inherit(found, labels)
    stop, own = "the", "zebra"
    for words, dense, linked, want in ((40, 20, 0, True), (40, 4, 0, True), (40, 0, 0, False), (40, 20, 90, False), (10, 5, 0, None), (20, 10, 0, True), (20, 2, 0, None)):
        text = " ".join([stop] * dense + [own] * (words - dense))
        assert html.classify([html.Block(text, len(text) * linked // 100, 0, False, False, False)]) == [want], (words, dense, linked)
    assert html.classify([html.Block("© 2020 the site of the", 0, 0, False, False, False), html.Block("x", 0, 0, False, True, False)]) == [False, False]


@pytest.mark.parametrize("part", ["<p", "<a ", "<p>ab cd</p>", "<div>", "</x>", '<b "', "<!", "<li>", "<span hidden><div></span>", "<p 'a", "&amp", "<script>", "<![CDATA["])
def test_html_takes_linear_time(part):
    import time

    began = time.process_time()
    html.main_text(part * (400_000 // len(part)))
    assert time.process_time() - began < 5


def test_html_without_marks():
    """Pages whose elements are all div, without class, id or role: density, length, links and neighbours decide."""
    found = wanted = both = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|\S+)(?=[\s>])", "", re.sub(r"<(/?)(article|main|nav|aside|footer|header|form|section|p|h1|li|ul)\b[^>]*>", r"<\1div>", page))
        a, b = (collections.Counter(html.main_text(x).split("\n\n")) for x in (page, bare))
        wanted, found, both = (n + sum(len(k) * v for k, v in c.items()) for n, c in ((wanted, a), (found, b), (both, a & b)))
    assert both >= 0.95 * found and both >= 0.95 * wanted


# --- 4 -----------------------------------------------------------------------------------------


def brute_repeats(texts, width):
    starts = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if starts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_passages(texts, words):
    """For each text the bytes that strings of so many words cover which start at two places, as booleans."""
    spans = []
    for t in texts:
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        spans.append([(a, b) for (a, _), (_, b) in zip(at, at[words - 1 :])])
    starts = collections.Counter(t[a:b] for t, own in zip(texts, spans) for a, b in own)
    out = []
    for t, own in zip(texts, spans):
        gone = np.zeros(len(t), bool)
        for a, b in own:
            if starts[t[a:b]] > 1:
                gone[a:b] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("size", [None, 3000])
def test_suffix_dedup(spark, odd, tmp_path, monkeypatch, size):
    """One part and bucket, and many of each."""
    if size:
        monkeypatch.setattr(suffixes, "PART_BYTES", size)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", size)
        monkeypatch.setattr(suffixes, "CHUNK", 512)
        monkeypatch.setattr(suffixes, "STEP", 5000)
        monkeypatch.setattr(suffixes, "HELD", 100)
    rng = random.Random(8)
    rows = list(odd[0])
    parts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (398, 399, 400, 401, 470, 900, 1500)]
    parts += [" ".join("".join(rng.choice("ghij") for _ in range(rng.randint(1, most))) for _ in range(n)) for n, most in ((50, 3), (51, 3), (51, 9), (52, 30), (60, 6), (90, 6))]
    for k in range(90):
        text = "".join(rng.choice([rng.choice(parts), "".join(rng.choice("efgh é") for _ in range(rng.randint(1, 300)))]) for _ in range(rng.randint(1, 5)))
        rows.append((1000 + k, text[rng.randint(0, 60) :]))
    rows += [(2000 + k, f"own{k} {parts[11]} and{k}") for k in range(60)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    data = [(t or "").encode() for _, t in rows]
    passages = [int(x.sum()) for x in brute_passages(data, suffixes.PASSAGE_WORDS)]
    want = by_rows(zip([i for i, _ in rows], *zip(*brute_repeats(data, 400)), passages))
    got = suffixes.op4_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert by_rows((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.passage_bytes) for r in got) == want
    assert suffixes.repeats(odd[1].limit(0)).isEmpty()


def prefix_in_common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_hot_first_phrase(spark, tasks):
    """Suffixes of which most begin with one phrase are dealt to many tasks, and none loses its neighbour at a border."""
    rng = random.Random(tasks)
    keys = {(kind, 7 if rng.random() < 0.8 else rng.randint(1, 9), *(rng.randint(1, 6) for _ in range(rng.randint(0, 8)))) for _ in range(400) for kind in (0, 1)}
    # as ranks do, k2 sorts what follows the first phrase
    rank = {tail: i for i, tail in enumerate(sorted({key[2:] for key in keys}))}
    rows = [(key[0], key[1], 0, rank[key[2:]], 2 if i % 50 == 0 else 1, (i, i % 5), list(key[1:])) for i, key in enumerate(sorted(keys))]
    ddl = "kind int, k0 bigint, k1 bigint, k2 bigint, n bigint, first struct<tid: bigint, k: int>, prefix array<bigint>"
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lined = common.cut(suffixes.neighbours(spark.createDataFrame(rows, ddl)), "lined")
        edges = lined.where("edge IS NOT NULL").count()
        hot = lined.withColumn("task", F.input_file_name()).where("k0 = 7").groupBy("task").count().agg(F.max("count")).first()[0]
        every = lined.drop("edge").unionByName(suffixes.over_borders(lined)).groupBy("first").agg(F.max("shared").alias("shared")).collect()
        assert suffixes.over_borders(lined.limit(0)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert edges <= 2 * tasks and hot < 3 * len(rows) / tasks
    want = {}
    for kind, _, _, _, n, first, prefix in rows:
        others = [prefix_in_common(prefix, r[6]) for r in rows if r[0] == kind and r[5] != first]
        want[first] = len(prefix) if n > 1 else max(others)
    assert {tuple(r.first): r.shared for r in every} == want


def test_cuts_in_steps(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 20000, dtype=np.uint8).tobytes()
    whole = suffixes.cuts(data)
    for step in (1, 50, 999):
        monkeypatch.setattr(suffixes, "STEP", step)
        assert (suffixes.cuts(data[:3000]) == whole[whole < 2900].tolist() + suffixes.cuts(data[:3000])[(whole < 2900).sum() :].tolist()).all()
    assert len(suffixes.cuts(b"")) == len(suffixes.cuts(b"abc")) == 0


@pytest.mark.parametrize("width", [80, 240])
def test_repeats_of_other_widths(spark, width):
    rng = random.Random(width)
    parts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (width - 2, width - 1, width, width + 1, 250, 420)]
    texts = ["".join(rng.choice([rng.choice(parts), "".join(rng.choice("efgh é") for _ in range(rng.randint(1, 200)))]) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    data = [t.encode() for t in texts]
    want = {hashlib.sha256(t).hexdigest(): x[1:3] for t, x in zip(data, brute_repeats(data, width)) if x[1]}
    got = {r.digest: (r.n_removed, r.n_spans) for r in suffixes.repeats(docs_of(spark, enumerate(texts)), width).collect()}
    assert got == want


def test_passages_of_51_words(spark):
    """Passages of over 50 words but under 400 bytes go; shorter ones stay."""
    own = lambda k, n: " ".join(f"own{k}w{j}" for j in range(n))
    long, short = (" ".join(f"{tag}{j:03}" for j in range(n)) for tag, n in (("p", 55), ("q", 45)))
    rows = [(k, f"{own(k, 60)} {p} {own(k + 100, 60)}") for k, p in enumerate([long, long, short, short])]
    assert 200 < len(short) < len(long) < 400
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs_of(spark, rows), SF).collect()}
    assert all("p001" not in out[k] and "p053" not in out[k] and f"own{k}w0" in out[k] and f"own{k + 100}w59" in out[k] for k in (0, 1))
    assert out[2] == rows[2][1] and out[3] == rows[3][1]
    rng = random.Random(1)
    tiny = " ".join(rng.choice("abcdefgh") for _ in range(55))
    rows += [(4, f"{own(4, 60)} {tiny} {long}"), (5, f"{tiny}\n{own(5, 9)}"), (6, tiny[:99])]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs_of(spark, rows), SF).collect()}
    assert len(tiny) < 200 and out[4].split() == own(4, 60).split() and out[5] == "\n" + own(5, 9) and out[6] == tiny[:99]


# --- 5 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_lm(spark, odd, monkeypatch, shard):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    rng = random.Random(2)
    rows = odd[0] + [(1000 + k, " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for k in range(40)]
    docs = docs_of(spark, rows).repartition(3)
    train = [(i, t) for i, t in rows if i is not None and i % 4]
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    count = collections.Counter(w for _, t in train for w in tok(t))
    pairs = collections.Counter(p for _, t in train for p in zip([None, *tok(t)], tok(t)))
    triples = collections.Counter(x for _, t in train for x in zip([None, *tok(t)], tok(t), tok(t)[1:]))
    adjusted = collections.Counter({(a, b): n for (a, b), n in pairs.items() if a is None})
    adjusted.update((b, c) for _, b, c in triples)
    before = collections.Counter(b for _, b in pairs)
    d1, d2, d3 = (lm._discounts(np.array([sum(n == k for n in x.values()) for k in (1, 2, 3, 4)])) for x in (before, adjusted, triples))
    follow, kinds = collections.Counter(), collections.defaultdict(lambda: np.zeros(4))
    for counts in (adjusted, triples):
        for x, n in counts.items():
            follow[x[:-1]] += n
            kinds[x[:-1]][min(n, 3)] += 1
    back = sum(d1[min(n, 3)] for n in before.values()) / len(pairs)
    low = lambda w: (before[w] - d1[min(before[w], 3)]) / len(pairs) + back / (len(count) + 1)

    def prob(a, w, u=None, first=True):
        found = low(w)
        if follow[a,]:
            found = (adjusted[a, w] - d2[min(adjusted[a, w], 3)] + d2 @ kinds[a,] * found) / follow[a,]
        if not first and follow[u, a]:
            n = triples[u, a, w]
            found = (n - d3[min(n, 3)] + d3 @ kinds[u, a] * found) / follow[u, a]
        return found

    assert math.isclose(sum(low(w) for w in count) + back / (len(count) + 1), 1)
    for context in (dict(a=None), dict(a=b"a"), dict(a=b"a", u=b"b", first=False), dict(a=b"one", u=None, first=False)):
        assert math.isclose(sum(prob(w=w, **context) for w in [*count, "unknown"]), 1), context
    model = lm.train(docs.where("doc_id % 4 <> 0"))
    total = sum(count.values())
    assert (model.tokens, model.words, model.pairs) == (total, len(count), len(pairs))
    got = collections.defaultdict(list)
    for r in lm.score(docs, model).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        ws = tok(t)
        fits = [r for r in got[i] if r.n_tokens == len(ws)]
        want = sum(math.log10(prob(a, w, u, k == 0)) for k, (u, a, w) in enumerate(zip([None, None, *ws], [None, *ws], ws)))
        plain = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws)
        assert any(math.isclose(r.score, want, rel_tol=1e-6) and math.isclose(r.base_score, plain, rel_tol=1e-9) and r.n_known == sum(w in count for w in ws) for r in fits), (i, want, fits)
    none = lm.train(docs.limit(0))
    assert {r.score for r in lm.score(docs.where("doc_id = 9"), none).collect()} == {0.0}
    assert lm.score(docs.limit(0), model).isEmpty()


# --- 6 -----------------------------------------------------------------------------------------


def test_decontamination(spark, odd):
    rng = random.Random(4)
    words = ["".join(rng.choice("klmnopqr") for _ in range(6)) for _ in range(3000)]
    item = [rng.sample(words, n) for n in (40, 25, 15, 8, 5)]
    swapped = list(item[0])
    for k in (3, 9, 15, 21, 27, 33, 39):
        swapped[k] = f"other{k}"
    spoiled = [w if k % 3 else f"no{k}" for k, w in enumerate(item[0])]
    fill = lambda n: " ".join(rng.choice(words) + "x" for _ in range(n))
    rows = [
        (1, f"{fill(50)} {' '.join(item[0]).upper()} {fill(50)}"),
        (2, f"{fill(7)}\n{' '.join(swapped)}\t{fill(90)}"),
        (3, f"{fill(7)} {' '.join(spoiled)} {fill(9)}"),
        (4, f"{fill(30)} {' '.join(item[1][5:20])} {fill(3)}"),
        (5, f"{fill(30)} {' '.join(item[1][5:13])} {fill(3)}"),
        (6, " ".join(item[2])),
        (7, " ".join(item[3])),
        (8, " ".join(item[4])),
        (9, fill(400)),
        (1, f"{' '.join(item[0])} {' '.join(item[2])}"),
        (None, " ".join(item[0])),
        (10, None),
    ]
    items = spark.createDataFrame([(k, " ".join(x), "own") for k, x in enumerate(item)] + [(9, None, "own"), (None, " ".join(item[0]), "own")], "item_id bigint, text string, seed string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), items).collect()}
    assert got == {(1, 0), (2, 0), (4, 1), (6, 2), (7, 3), (1, 2)}
    assert decontaminate.contaminated(odd[1], items).isEmpty()
    assert decontaminate.contaminated(docs_of(spark, rows), items.limit(0)).isEmpty()
    assert decontaminate.contaminated(odd[1].limit(0), items).isEmpty()


def brute_overlap(doc, item):
    """The most words that agree on a segment of which IDENTITY agrees, over all diagonals."""
    best = 0
    for d in range(-len(item), len(doc)):
        same = [item[k] == doc[k + d] for k in range(max(0, -d), min(len(item), len(doc) - d))]
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                n = sum(same[i:j])
                if 5 * n >= 4 * (j - i):
                    best = max(best, n)
    return best


def test_substituted_parts(spark):
    """Parts of items with replaced words, against all segments of all diagonals."""
    rng = random.Random(9)
    item = [[f"i{k}w{n}" for n in range(60)] for k in range(2)]
    texts = [[*item[0][:12], *(w if n % 5 else f"no{n}" for n, w in enumerate(item[0][12:27], 0))]]
    for i in range(60):
        size, swaps = rng.choice([(20, 2), (20, 3), (20, 4), (30, 4), (30, 5), (30, 6), (16, 3), (15, 3)])
        at = rng.randrange(60 - size)
        part = item[i % 2][at : at + size]
        for k in rng.sample(range(size), swaps):
            part[k] = f"swap{i}x{k}"
        texts.append([f"f{i}a", *part, f"f{i}b", f"f{i}c"])
    items = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), items).collect()}
    best = {(i, k): brute_overlap(t, x) for i, t in enumerate(texts) for k, x in enumerate(item)}
    assert got == {k: n for k, n in best.items() if n >= decontaminate.MATCHED}
    assert (0, 0) in got and 20 < len(got) < 61


def test_exact_matches(spark):
    """Every document and item that share 13 words in a row are reported, on the whole tables."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = collections.defaultdict(set)
    for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    want = set()
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        w = words(t)
        want |= {(d, i) for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op6_decontamination"](spark, SF).collect()}
    assert want and want <= got


# --- 7 -----------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "u5", long), (3, "u3", long), (9, "u\r\n9", long), (3, "u3", long), (1, "a", "short"), (2, "b", "short"), (4, None, None), (None, "n", long), (6, "c", "y" * 100000), (7, "d", "")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id bigint, url string, html string, digest string")
    root = warc.write_archive(pages, str(tmp_path / "archive"))
    got = by_rows(map(tuple, warc.verify_archive(spark, root).collect()))
    want = by_rows((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 3) if h == long and i != 3 else ("response", None))) for i, _, h in rows)
    assert got == want
    assert spark.read.parquet(f"{root}/payloads").count() == len({h or "" for _, _, h in rows})
    for r in warc.read_records(spark, root).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head).group(1)) == len(body) - 4
        if r.record_type == "response":
            assert hashlib.sha256(body[:-4]).hexdigest() == r.digest
    assert warc.verify_archive(spark, warc.write_archive(pages.limit(0), str(tmp_path / "none"))).isEmpty()


def test_warc_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op7_warc"])
    df = queries.queries()["op7_warc"](spark, SF).select(*want.columns)
    assert by_rows(map(tuple, df.collect())) == by_rows(want.fetchall())


# --- 8 -----------------------------------------------------------------------------------------


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12))
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 12), (1100, [1.0] * 11 + [None]), (1150, [float("nan")] * 12), (1200, [float("inf")] * 12), (1250, []), (None, [1.0] * 12), (1300, [1.0] * 3), (0, x[0].tolist())]
    vectors = spark.createDataFrame([(*r, "own") for r in rows], "vec_id bigint, embedding array<float>, ids string")
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    f = x.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        order = np.lexsort((np.arange(900), -s))[:5].tolist()
        hits += len(set(order) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(math.isclose(s[v], c, abs_tol=1e-9) for v, c in got[q])
    assert set(got) == set(range(0, 900, 50)) and hits >= 0.9 * 5 * 18
    assert [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    few = ann.nearest(vectors.where("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert {(r.query_id, r.rank) for r in few} == {(0, 1), (0, 2)}
    assert ann.nearest(vectors.limit(0), F.lit(True)).isEmpty()


def test_ann_scores_of_any_size(spark):
    """Components whose squares leave the range of doubles."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    scale = np.array([1e160, 1e-170, 1.0])[np.arange(60) % 3]
    vectors = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, scale))], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 15 and all(math.isclose(u[r.query_id] @ u[r.vec_id], r.score, abs_tol=1e-12) for r in got)


def test_ann_chunks(spark, monkeypatch):
    """Cells and queries in many chunks find what they find in one; clusters need few cells."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16)) * 10
    x = centre[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").cache()
    whole = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(vectors, F.col("vec_id") % 10 == 0).collect()}
    index = ann.fit(x, 64)
    assert ann.probes_for(index, x) <= 20
    for name, size in (("CHUNK_ROWS", 50), ("CHUNK_QUERIES", 7), ("STEP", 3000)):
        monkeypatch.setattr(ann, name, size)
    found = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(vectors, F.col("vec_id") % 10 == 0).collect()}
    assert set(found) == set(whole) and sum(found[k] == whole[k] for k in whole) >= 0.98 * len(whole)


def _recall(spark, x):
    """Of the nearest five of every 50th row by brute force, the share that is found."""
    got = collections.defaultdict(set)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(len(s)), np.arange(0, len(x), 50)] = -9
    return np.mean([len(set(np.argsort(-r)[:5].tolist()) & got[50 * k]) / 5 for k, r in enumerate(s)])


def test_ann_queries_unlike_the_rows(spark):
    """Rows lie in tight groups, of whose neighbours a few cells hold all; those of the queries, which lie anywhere, are in many."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    x[::50] = rng.normal(size=(120, 32))
    assert _recall(spark, x) >= 0.97


def test_ann_many_of_one_code(spark, monkeypatch):
    """Groups of 400 rows for which there are fewer codes than groups."""
    monkeypatch.setattr(ann, "CELLS", (4, 4))
    monkeypatch.setattr(ann, "CODEWORDS", 8)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(15, 32))[np.arange(6000) % 15] + 0.001 * rng.normal(size=(6000, 32))
    assert _recall(spark, x) >= 0.97


def test_ann_recall(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY 1").fetchall()
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in queries.queries()["op8_ann_search"](spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    at = [k for k, (i, _) in enumerate(rows) if i % 50 == 0]
    s = u[at] @ u.T
    s[range(len(at)), at] = -9
    near = [{rows[j][0] for j in np.argsort(-r)[:5]} for r in s]
    assert np.mean([len(n & got[rows[k][0]]) / 5 for k, n in zip(at, near)]) >= 0.9


# --- 9 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_best_fit(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    lengths = [rng.randint(1, n) for _ in range(rng.randint(0, 120))]
    rows: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rows if r[0] >= x]
        if fits:
            min(fits)[0] -= x
        else:
            rows.append([n - x])
    got = packing.best_fit(lengths, n)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))
    assert sorted(n - sum(lengths[i] for i in r) for r in got) == sorted(r[0] for r in rows)


def test_packing(spark, odd, tmp_path):
    rows, docs = odd
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = packing.write_packed(docs, str(tmp_path / "packed"), row_tokens=64, bin_bytes=20_000).cache()
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = {i: [*np.frombuffer(codec.encode(t or ""), "<u4").tolist(), packing.END] for i, t in rows if i is not None}
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.unpack(packed).collect()} == want
    for r in packed.collect():
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        ends = [*r.cu_seqlens, *([64] if r.cu_seqlens[-1] < 64 else [])]
        assert len(ids) == 64 and r.n_tokens == r.cu_seqlens[-1] and (ids[r.n_tokens :] == packing.PAD).all()
        assert positions.tolist() == [k for a, b in zip(ends, ends[1:]) for k in range(b - a)]
        assert len(r.doc_ids) == len(r.parts) == len(r.cu_seqlens) - 1
    twice = packing.write_packed(odd[1], str(tmp_path / "twice"), row_tokens=64)
    assert sum(len([1 for i, p in zip(r.doc_ids, r.parts) if i == 1 and p == 0]) for r in twice.collect()) == 2
    assert packing.write_packed(docs.limit(0), str(tmp_path / "none")).isEmpty()


# --- 10 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_bpe_tree(monkeypatch, seed):
    """Small leaves force joins everywhere; the result is the library's."""
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in codec.bytes_of.items()}, special_tokens={})
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "'", "'l", "ll", "s", "é", "1", "23", ".", "🙂", "the", " of", "\t", "%"]
    for n in range(300):
        monkeypatch.setattr(bpe, "LEAF_CHARS", rng.choice([5, 7, 16, 50]))
        monkeypatch.setattr(bpe, "LEAF_BYTES", rng.choice([4, 8, 20]))
        codec.cache.clear()
        text = "".join(rng.choice(parts if n % 2 else "abcdetionhr") for _ in range(rng.randint(0, 150)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_merges():
    """Leaves and windows of any length, also those of one letter, against the library; long pieces in bearable time."""
    import time

    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    for n in range(1500):
        data = "".join(rng.choice(("ab", "aeinrst ", "a", "é🙂x", "=-")[n % 5]) for _ in range(rng.randint(1, 200))).encode()
        want = own._encode_single_piece(data)
        assert list(codec.merge(data)) == want == list(codec.of_bytes(data)), data
    began = time.process_time()
    for text in ("a" * 60_000, "ab" * 30_000, "=" * 60_000):
        assert list(codec.of_bytes(text.encode())) == own._encode_single_piece(text.encode())
    assert time.process_time() - began < 60


def test_bpe(spark, odd):
    rows, docs = odd
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in codec.bytes_of.items()}, special_tokens={})

    def want(i, t):
        ids = own.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert by_rows(map(tuple, bpe.digests(docs).collect())) == by_rows(want(i, t) for i, t in rows)
    back = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {(i, (t or "").encode()) for i, t in rows}
    assert bpe.digests(docs.limit(0)).isEmpty()


# --- the pipeline ------------------------------------------------------------------------------


def test_stages_keep_columns_and_rows(spark, odd):
    rows, docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        if name in ("toxicity", "repeated_passages", "decontamination"):
            assert len(kept) == len(rows), name
        assert {r.score for r in kept} == {"own"}
        assert stage(spark, docs.limit(0), SF).isEmpty(), name


def test_near_duplicate_stage(spark, odd):
    rows, docs = odd
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    named = [(k, i, t or "") for k, (i, t) in enumerate(rows) if i is not None]
    group = brute_similar({k: t for k, _, t in named})
    first = {g: min(i for k, i, _ in named if group[k] == g) for g in set(group.values())}
    assert sorted(k for k in kept if k is not None) == sorted(first.values()) and kept.count(None) == 2


def test_repeats_stage(spark, odd):
    rows, docs = odd
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeats(spark, docs, SF).collect()}
    data = [(t or "").encode() for _, t in rows]
    for (i, t), b, gone in zip(rows, data, brute_passages(data, suffixes.PASSAGE_WORDS)):
        starts = collections.Counter(x[k : k + 400] for x in data for k in range(len(x) - 399)) if i == rows[0][0] else starts
        for k in range(len(b) - 399):
            if starts[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
        left = "".join(b[x:y].decode("utf-8", "ignore") for x, y in zip([0, *edge[1::2]], [*edge[0::2], len(b)]))
        if i is not None:
            assert (out[i][0] or "") == left and out[i][1] == (None if t is None else len(left))


def plain_toxic(text, grammar):
    """Whether a text is toxic, by all its clauses and words."""
    counts = collections.Counter()
    for clause in re.split(r"[.!?;:\n\r]", text.lower()):
        symbols = []
        for w in re.findall(r"[^\W\d_]+", clause):
            kind = grammar.words.get(w) or next((k for s, k in grammar.stems.items() if w.startswith(s) and len(w) > len(s)), None)
            symbols.append(kind or toxicity._symbol(w, {}))
        counts.update(enumerated_readings(symbols))
    x = [1.0, *(1 + math.log(counts[k]) if counts[k] else 0.0 for k in range(len(toxicity.READINGS)))]
    return float(grammar.weights @ x) >= 0


def plain_repeats(texts):
    """The texts without the characters that repeated strings of 400 bytes or 51 words cover."""
    data = [t.encode() for t in texts]
    starts = collections.Counter(hash(b[k : k + 400]) for b in data for k in range(len(b) - 399))
    out = []
    for b, gone in zip(data, brute_passages(data, 51)):
        for k in range(len(b) - 399):
            if starts[hash(b[k : k + 400])] > 1:
                gone[k : k + 400] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
        out.append("".join(b[x:y].decode("utf-8", "ignore") for x, y in zip([0, *edge[1::2]], [*edge[0::2], len(b)])))
    return out


def test_pipeline(spark):
    """Each stage against plain Python, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    words = lambda t: t.encode().lower().split()
    items = [words(t or "") for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    held = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)}
    before, stages = {r.doc_id: r.text or "" for r in docs.collect()}, []
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        after = {r.doc_id: r.text or "" for r in now.collect()}
        assert now.columns == docs.columns and now.count() == len(after)
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if not plain_toxic(t, grammar)}
        elif name == "near_duplicates":
            group = brute_similar(before)
            assert after == {i: t for i, t in before.items() if group[i] == i}
        elif name == "repeated_passages":
            assert after == dict(zip(before, plain_repeats(list(before.values()))))
        else:
            exact = {i for i, t in before.items() if any(tuple(w[k : k + 13]) in held for w in [words(t)] for k in range(len(w) - 12))}
            assert exact and not exact & after.keys() and after.items() <= before.items()
        stages.append(len(after))
        before = after
    assert stages == sorted(stages, reverse=True) and stages[-1] > 0.5 * docs.count()
    out = corpus_pipeline.run(spark, SF).collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN).ranks, special_tokens={})
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == {i: own.encode_ordinary(t) for i, t in before.items()}
    assert {(r.doc_id, r.decoded_sha256) for r in out} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in before.items()}
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in out)
