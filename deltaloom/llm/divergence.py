"""How the word use of sources differs within each language, exactly, in integers.

Terms are counted in the map tasks, where a table turns every byte of a text into a letter or a
space; what is shuffled is a task's distinct terms with their counts.

* Pairs of sources: the divergence of two groups sums a function of two shares over all kept terms,
  most of which neither group has. So the sum starts from the baseline in which both counts are zero
  for every term, and is corrected by each group's own counts (a histogram of them is enough) and by
  the terms that both have, the only ones that are joined.
* Terms of a source: the k largest values of each group by radix selection. Histograms over the
  bits of the values, counted where the rows lie, find the group's k-th largest value; among terms
  of just that value the first by UTF-8 bytes are found in the same way, byte by byte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.llm.common import bounded_batches, cut

#: A language keeps the terms that at least so many of its documents have.
MIN_DOCS = 10
#: Terms reported for each group.
TOP = 10
#: Shares are counted in billionths, by long division in steps of a thousand.
STEP, STEPS = 1000, 3
#: Bits of a value, and hex digits of a term, that one histogram tells apart.
BITS, NIBBLES = 16, 4
#: Letters, lower-cased, and bytes of longer characters; all others end a term.
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Distinct terms that a task holds before it hands them on, and bytes of a text that it splits at once.
HELD, SLICE = 200_000, 4 << 20
GROUP = ["lang", "source"]


def text_terms(text: str) -> Counter:
    """How often each term occurs in a text, split slice by slice at spaces."""
    data, found, at = text.encode().translate(LETTERS), Counter(), 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df): occurrences of each term in a group's documents, and how many of them have it. Nulls count as ''."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        n = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (tf, df) in held.items():
                terms = list(tf)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([tf[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())], names=["lang", "source", "term", "tf", "df"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text"))):
                tf, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                n -= len(tf)
                own = text_terms(text.as_py())
                tf.update(own)
                df.update(own.keys())
                n += len(tf)
                if n > HELD:
                    yield from flushed()
                    n = 0
        yield from flushed()

    found = rows.mapInArrow(counted, "lang string, source string, term string, tf bigint, df bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exact for corpora of up to 10^15 terms."""
    whole, over = f"({count} + 2) div ({n} + 2 * {v})", f"({count} + 2) % ({n} + 2 * {v})"
    for _ in range(STEPS):
        whole, over = f"(({whole}) * {STEP} + (({over}) * {STEP}) div ({n} + 2 * {v}))", f"(({over}) * {STEP}) % ({n} + 2 * {v})"
    return F.expr(f"1 + {whole}")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q))"""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Written tables: (lang, source, term, tf, total) of terms that their language keeps, total over its sources; and of all groups (lang, source, v, n, p0, ln).

    v is the number of the language's kept terms, n and ln their occurrences in the group and in the
    language, p0 the group's share of a term that it lacks, null if v is 0.
    """
    counts = cut(term_counts(docs), "term-counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("df").alias("_df"), F.sum("tf").alias("total")).where(F.col("_df") >= min_docs).select("lang", "term", "total")
    kept = cut(counts.select("lang", "source", "term", "tf").join(totals, ["lang", "term"]), "kept-terms")
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("ln"))
    own = kept.groupBy(*GROUP).agg(F.sum("tf").alias("n"))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP)).distinct()
    found = every.join(langs, "lang", "left").join(own, GROUP, "left").select(*GROUP, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("v", "n", "ln")))
    return kept, cut(found.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v"))), "term-groups")


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, in both directions."""
    own = kept.join(groups.select(*GROUP, "v", "n", "p0"), GROUP).withColumn("p", share("tf", "n", "v"))
    own = cut(own.select("lang", "source", "term", "p", "p0"), "term-shares")
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"{x}0"), "v") for x in "ab")
    base = a.join(b.drop("v"), "lang").where("a < b").select("lang", "a", "b", F.expr(f"CASE WHEN v = 0 THEN 0 ELSE v * ({gap('a0', 'b0')}) END").alias("value"))
    several = own.groupBy(*GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("_other"), F.col("p0").alias("q0"))
    alone = several.join(other, "lang").where("source <> _other").select("lang", F.least("source", "_other").alias("a"), F.greatest("source", "_other").alias("b"), F.expr(f"m * ({gap('p', 'q0')} - {gap('p0', 'q0')})").alias("value"))
    left, right = (own.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"{x}p"), F.col("p0").alias(f"{x}0")) for x in "ab")
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(f"{gap('ap', 'bp')} - {gap('ap', 'b0')} - {gap('a0', 'bp')} + {gap('a0', 'b0')}").alias("value"))
    pairs = base
    for part in (alone, both):
        pairs = pairs.unionByName(part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pairs = cut(pairs.groupBy("lang", "a", "b").agg(F.sum("value").cast("bigint").alias("value")), "source-pairs")
    ways = [pairs.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]
    return ways[0].unionByName(ways[1])


def over_used(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms whose share in a group is above that in its language."""
    rows = kept.join(groups.select(*GROUP, "v", "n", "ln"), GROUP)
    rows = rows.withColumn("p", share("tf", "n", "v")).withColumn("q", share("total", "ln", "v")).where("p > q")
    return rows.select(*GROUP, F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))


def _chosen(rows: DataFrame, keys: list[str], digit: str, descending: bool) -> DataFrame:
    """(keys, digit, need): of each group's histogram over digits the bin that holds its need-th row, and how many of that bin are needed."""
    bins = rows.groupBy(*keys, "need", digit).agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.desc(digit) if descending else F.asc(digit)).rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("_upto", F.sum("m").over(order))
    return upto.where("_upto >= need AND _upto - m < need").select(*keys, digit, (F.col("need") - F.col("_upto") + F.col("m")).alias("need"))


def thresholds(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, bar, need): each group's k-th largest value, and how many of the rows of just that value are among its k first.

    Groups of up to k rows get their smallest value. Values are not negative. One histogram a round,
    over BITS bits of the rows that share the bits found so far.
    """
    most = rows.agg(F.max("value")).first()[0] or 0
    found = rows.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("need")).withColumn("bar", F.lit(0).cast("bigint"))
    for low in reversed(range(0, max(1, most.bit_length()), BITS)):
        near = rows.join(found, keys)
        if low + BITS < 64:
            near = near.where(F.shiftright("value", low + BITS) == F.col("bar"))
        near = near.withColumn("_digit", F.shiftright("value", low).bitwiseAND((1 << BITS) - 1))
        found = found.select(*keys, "bar").join(_chosen(near, keys, "_digit", True), keys)
        found = cut(found.select(*keys, (F.shiftleft("bar", BITS) + F.col("_digit")).alias("bar"), "need"), "radix-values")
    return found


def tied(rows: DataFrame, keys: list[str], bars: DataFrame) -> DataFrame:
    """The rows at each group's bar that are needed, the first by the bytes of `item`.

    Each round skips the digits that all undecided items of a group share (its least and greatest
    one show them) and parts those by the next NIBBLES hex digits. A group whose undecided rows are
    all needed is done.
    """
    left = rows.join(bars, keys).where("value = bar").select(*keys, "item", "value", "need", F.hex(F.encode("item", "UTF-8")).alias("_hex"))
    left, done = cut(left, "radix-ties"), None
    while True:
        state = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("_hex").alias("lo"), F.max("_hex").alias("hi"))
        left = left.join(state, keys)
        over = left.where("m <= need").select(*keys, "item", "value")
        done = over if done is None else done.unionByName(over)
        more = left.where("m > need")
        if more.isEmpty():
            return done
        length = F.least(F.length("lo"), F.length("hi"))
        shared = F.array_position(F.transform(F.sequence(F.lit(1), length + 1), lambda i: F.substr("lo", i, F.lit(1)) != F.substr("hi", i, F.lit(1))), F.lit(True))
        skip = F.when(F.col("lo") == F.col("hi"), F.raise_error(F.lit("items repeat within a group"))).otherwise(shared - 1)
        more = more.withColumn("_skip", skip.cast("int")).withColumn("_digit", F.substr("_hex", F.col("_skip") + 1, F.lit(NIBBLES)))
        more = cut(more.select(*keys, "item", "value", "need", "_hex", "_digit"), "radix-more")
        bins = _chosen(more, keys, "_digit", False).withColumnRenamed("need", "_rest").withColumnRenamed("_digit", "_at")
        judged = more.join(bins, keys)
        done = done.unionByName(judged.where("_digit < _at").select(*keys, "item", "value"))
        left = cut(judged.where("_digit = _at").select(*keys, "item", "value", F.col("_rest").alias("need"), "_hex"), "radix-ties")


def largest(rows: DataFrame, keys: list[str], k: int = TOP) -> DataFrame:
    """(keys, item, value, rank): of each group the k rows of largest value, ties by the bytes of `item`; items are distinct within a group."""
    rows = cut(rows.select(*keys, "item", "value"), "radix-rows")
    bars = thresholds(rows, keys, k)
    above = rows.join(bars, keys).where("value > bar").select(*keys, "item", "value")
    return ranked(above.unionByName(tied(rows, keys, bars)), keys)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language, part `term` a source's k most over-used terms.

    Null lang, source and text count as ''. Repeated rows are documents of their own. A language
    that keeps no term has pairs of value 0; a lone source has none. An empty table gives no rows.
    """
    kept, groups = kept_terms(docs, min_docs)
    parts = {"pair": ranked(source_pairs(kept, groups), GROUP), "term": largest(over_used(kept, groups), GROUP, k)}
    found = [rows.select(*GROUP, F.lit(name).alias("part"), "item", "value", "rank") for name, rows in parts.items()]
    return found[0].unionByName(found[1])


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all of `documents`."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _share_sql(count: str, n: str, v: str) -> str:
    return f"(1 + (CAST(1000000000 AS HUGEINT) * ({count} + 2)) // ({n} + 2 * {v}))"


def _gap_sql(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) // ({p} + {q}))"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS ln FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS tf FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(tf) AS n FROM o GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.tf, 0) AS tf, {_share_sql('coalesce(o.tf, 0)', 'coalesce(n.n, 0)', 'v.v')} AS p, {_share_sql('k.total', 'v.ln', 'v.v')} AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum({_gap_sql('x.p', 'y.p')}) AS value FROM c x JOIN c y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, {_gap_sql('p', 'q')} FROM c WHERE tf > 0 AND p > q),
f AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM f WHERE part = 'pair' OR rank <= {TOP}
"""
