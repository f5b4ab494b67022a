"""Long items and texts, rows that share an id, and crowds of unlike texts."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaloom.llm import bpe, decontaminate, html, minhash, packing, simhash
from tests.llm.test_corpus import brute_overlap, docs_of

SF = "/root/testdata/sf0.001"


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_two_texts_under_one_item_id(spark):
    """Every pair of texts is compared, against brute force over all segments."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [[rng.choice(words) for _ in range(30)] for _ in range(4)]
    items = items_of(spark, [(7, " ".join(texts[0])), (7, " ".join(texts[1])), (7, " ".join(texts[0])), (8, " ".join(texts[2]))])
    docs = [["x", *t[3:24], "y"] for t in texts] + [texts[0] + texts[1]]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.item_words) for r in decontaminate.contaminated(docs_of(spark, [(k, " ".join(d)) for k, d in enumerate(docs)]), items).collect()}
    want = {(k, i): max(brute_overlap(d, t) for t in own) for k, d in enumerate(docs) for i, own in ((7, texts[:2]), (8, texts[2:3]))}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, n in want.items() if n >= decontaminate.MATCHED}
    assert {(0, 7), (1, 7), (2, 8), (4, 7)} <= got.keys()


def test_long_items(spark):
    """An item of 50,000 words, and a text that holds a part of it and one that holds it all."""
    item = [f"word{k}" for k in range(50_000)]
    docs = docs_of(spark, [(1, " ".join(["a", *item[40_000:40_020], "b"])), (2, " ".join(item)), (3, "none of it")])
    got = sorted((r.doc_id, r.doc_pos, r.n_words, r.n_matched, r.item_words) for r in decontaminate.contaminated(docs, items_of(spark, [(1, " ".join(item))])).collect())
    assert got == [(1, 1, 20, 20, 50_000), (2, 0, 50_000, 50_000, 50_000)]


def test_clean_rows_that_share_an_id_stay(spark):
    text = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 20").first().text
    docs = docs_of(spark, [(1, text), (1, "a clean row of the same id"), (2, f"some words before {text}"), (None, text), (3, None)])
    kept = corpus_pipeline.drop_contaminated(spark, docs.withColumn("text_digest", F.lit("own")).withColumn("_id", F.lit(4)), SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, text), (1, "a clean row of the same id"), (3, "")]


def test_packing_of_long_white_space(spark, tmp_path):
    texts = {1: " " * 5_000_000, 2: "a" + "\n" * 300_000 + "b", 3: " \t" * 200_000 + "end", 4: "plain text"}
    packed = packing.write_packed(docs_of(spark, list(texts.items())), str(tmp_path / "packed"))
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for r in packing.unpack(packed).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert ids[-1] == packing.END and codec.decode(ids[:-1].astype("<u4").tobytes()).decode() == texts[r.doc_id]


def test_crowds_of_unlike_texts_are_compared_with_their_links_only(spark):
    """5,000 texts of one repeated line and their own words: near fingerprints, and candidates in proportion to texts and links."""
    rng, line = random.Random(6), "this is the line that all of the pages repeat "
    rows = [(k, line * 60 + " ".join(f"own{k}w{j}" for j in range(rng.randint(90, 120)))) for k in range(5000)]
    docs = docs_of(spark, rows)
    nodes = spark.createDataFrame([(k, int(np.uint64(simhash.fingerprint(t)).view(np.int64)), minhash.bands(minhash.shingle_set(t)).tolist()) for k, t in rows], "node bigint, fp bigint, bands array<bigint>").cache()
    links = simhash.links(nodes.select("fp").distinct()).count()
    shards = minhash.candidate_shards(nodes)
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) <= 4 * (len(rows) + links)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == 5000


PARAGRAPHS = ["The first paragraph of the article is long enough for all of the rules, and it has the words that such a text has.", "Then there is another one that says more about the matter, with as many of the small words as the first one has."]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<nav><a href=/a>One</a> <a href=/b>Two</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<svg-icon></svg-icon><title-bar>Site</title-bar>{MENU}<article>{BODY}</article>",
        f"<svg/><svg viewBox='0 0 1 1'/>{MENU}<article>{BODY}</article>",
        f"{MENU}<svg><path d=x><article>{BODY}</article>",
        f"<a href=x it's>home</a>{MENU}<article>{BODY}</article>",
        f"<img alt=5\" src=x><p class=a'b></p>{MENU}<article>{BODY}</article>",
        *(f"{MENU}<article class='{c}'>{BODY}</article>" for c in ("post category-social", "hentry tag-search", "article-content related-post", "story share-enabled", "entry comments-open", "category-menu")),
        f"{MENU}<div class='entry-content has-sidebar' id='post-12'>{BODY}</div>",
        f"{MENU}<form><select><option>A<option>B</form><article>{BODY}</article>",
        f"{MENU}<select name=x><option>A</option><article>{BODY}</article>",
        f"{MENU}<select><option>A<option>B</select><article>{BODY}</article>",
        f"{MENU}<select><optgroup label=g><option>A<input name=q><article>{BODY}</article>",
        f"{MENU}<article>{BODY}</article><textarea>never ends <p>and hides the rest, which is not of the article",
    ],
)
def test_ordinary_markup_keeps_the_article(page):
    assert html.main_text(page).split("\n\n") == PARAGRAPHS


@pytest.mark.parametrize("mark", ["class='post comments'", "class=comment-body", "class='related-posts'", "id=site-footer", "class='ad-slot'", "class='newsletter-signup story-list'", "class='story ad'", "role=navigation", "class='article-footer'"])
def test_furniture_stays_out(mark):
    assert html.main_text(f"<article>{BODY}</article><div {mark}><p>{PARAGRAPHS[0].replace('first', 'other')}</p></div>").split("\n\n") == PARAGRAPHS


@pytest.mark.parametrize("part", ["<svg>", "<svg/>", "<select>", "<select><option>x", "<option>", "<a b=", "<a b= = ", "<p class='x", "<textarea>", "<svg-a>", "</select>", "<select><p>"])
def test_mended_markup_takes_linear_time(part):
    began = time.process_time()
    html.main_text(part * (400_000 // len(part)))
    assert time.process_time() - began < 5
