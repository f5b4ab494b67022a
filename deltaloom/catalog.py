"""The join engine's queries by name, each with its SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import lifetimes as lt
from deltaloom.operators import snapshot as sn
from deltaloom.operators.factorised import factorised
from deltaloom.plans.model import Atom, Query, query
from deltaloom.sources import tables as src
from deltaloom.sources import updates as up
from deltaloom.streaming.levels import LevelViews
from deltaloom.streaming.microbatch import View, Views

Run = Callable[[SparkSession, str], DataFrame]

#: Answers over current tables, as atoms and output.
SNAPSHOTS = [
    query("scan_project_distinct", "LS(p,s)", "s"),
    query("natural_join_2", "CN(c,n) OC(o,c)", "n,o"),
    query("path_join_3", "CN(c,n) OC(o,c) LO(o,p)", "n,p"),
    query("path_join_4", "NR(n,r) CN(c,n) OC(o,c) LO(o,p)", "r,p"),
    query("path_join_6", "RG(r,rn) NR(n,r) CN(c,n) OC(o,c) LO(o,p) LS(p,s)", "rn,s"),
    query("star_join", "OC(o,c) LO(o,p1) LOPS(o,p,s)", "c,p1,s"),
    query("snowflake_join", "NR(n,r) CN(c,n) OC(o,c) LOPS(o,p,s) PB(p,b)", "r,b,s"),
    query("self_join_copies", "UE(u,t1) UE(u,t2)", "u,t1,t2"),
    query("multi_attr_join", "LO(o,p) LOPS(o,p,s)", "o,p,s"),
    query("semi_join_chain", "RG(r,rn) NR(n,r) CN(c,n) OC(o,c) LO(o,p) LS(p,s)", "r"),
    query("projection_free_connex", "CN(c,n) OC(o,c) LO(o,p)", "c,n,o"),
    query("projection_full", "CN(c,n) OC(o,c) LO(o,p)", "c,n,o,p"),
    query("projection_single_attr", "CN(c,n) OC(o,c) LO(o,p)", "c"),
    query("non_free_connex_snapshot", "OC(o,c) LO(o,p) LS(p,s)", "c,s"),
    query("cyclic_snapshot", "CN(c,n) OC(o,c) LOPS(o,p,s) SN(s,n)", "c,s,n"),
]
#: The same kind of answers by semi-join reduction.
REDUCED = [
    query("yannakakis_path", "NR(n,r) CN(c,n) OC(o,c) LO(o,p)", "r,p"),
    query("yannakakis_star", "OC(o,c) LO(o,p1) LOPS(o,p,s)", "c,p1,s"),
    query("yannakakis_existence", "CN(c,n) OC(o,c) LO(o,p) PB(p,b)", "c,n"),
]
#: Queries whose siblings multiply under one key: the attribute they are dealt by, and rows read by a task.
DEALT = {"star_join": "o", "yannakakis_star": "o"}
DEALT_ROWS = 250_000
#: Queries whose last atom's values multiply: the attribute that lists of them are dealt by, and those that relations are.
GATHERED = {"non_free_connex_snapshot": "c", "delta_non_free_connex": "c"}
GATHERED_BY = {"OC": "o", "LO": "o", "LS": "p"}
#: Delta logs over the change logs.
DELTAS = [
    query("delta_insert_path", "CN(c,n) OC(o,c)", "n,o"),
    query("delta_mixed_path", "CN(c,n) OC(o,c) LO(o,p)", "n,p"),
    query("delta_projection_distinct", "CN(c,n) OC(o,c) LO(o,p)", "n"),
    query("delta_self_join", "UE(u,t1) UE(u,t2)", "t1,t2"),
    query("delta_star", "OC(o,c) LO(o,p) LO(o,p2)", "c,p,p2"),
    query("delta_generalized_root", "CN(c,n) SN(s,n)", "n,s"),
    query("delta_reinsert", "OC(o,c)", "o,c"),
    query("delta_non_free_connex", "OC(o,c) LO(o,p) LS(p,s)", "c,s"),
]
MULTI = [query("q0", "CN(c,n) OC(o,c)", "n,o"), query("q1", "SN(s,n) NR(n,r)", "r,s"), query("q2", "CN(c,n) OC(o,c) LO(o,p)", "n,p")]
SHARED_NODE = query("CO", "CN(c,n) OC(o,c)", "n,o")
SHARING = [query("s0", "CO(n,o) LO(o,p)", "n,p"), query("s1", "CO(x,y) NR(x,z)", "z,y"), query("s2", "CO(a,b)", "a,b")]
#: An order's lines beside each other, with all attributes, and the page of answers that is read.
SIBLINGS = query("siblings", "OC(o,c) LO(o,p1) LOPS(o,p,s)", "o,c,p1,p,s")
PAGE = (1000, 500)
#: Queries that nobody told what they have in common: customers with their orders, under many names, and twice in one.
FOUND = [
    query("f0", "CN(c,n) OC(o,c) LO(o,p)", "n,p"),
    query("f1", "NR(w,z) OC(y,x) CN(x,w)", "z,y"),
    query("f2", "OC(b,a) CN(a,d)", "d,b"),
    query("f3", "RG(r,rn) NR(n,r) CN(k,n) OC(o,k) LO(o,p) LS(p,s)", "r,s"),
    query("f4", "SN(s,n) LS(p,s) LS(p,t) SN(t,m)", "n,m"),
]
MAINTAINED = [query("m0", "CN(c,n) OC(o,c) LO(o,p)", "n,p"), query("m1", "OC(y,x) CN(x,w) NR(w,z)", "z,y"), query("m2", "OC(b,a) CN(a,d)", "d,b"), query("m3", "LO(u,w) CN(s,t) OC(u,s)", "t,w")]
ISOMORPHIC = [query("i0", "UE(u,t) UE(u,v)", "t,v"), query("i1", "UE(k,a) UE(k,b)", "a,b")]
LIVE = [query("l0", "OC(o,c) LO(o,p)", "c,p"), query("l1", "OC(o,c) CN(c,n)", "o,n"), query("l2", "OC(o,c) LO(o,p) LS(p,s) PB(p,b)", "o,b")]
BATCH = 100_000
STATE_SEQ = 5_500_000
#: Where the oracles' lives end that have no end: beyond any seq.
NEVER = (1 << 63) - 1
#: First seq of each micro-batch of the streaming queries.
BOUNDS = [0, 1_004_000, 5_000_000, 8_000_000]
#: The same for the lines and parts that a generalized node joins: no batch of theirs is empty.
OFFERED_BOUNDS = [0, 3_000_100, 6_000_100, 7_000_000]
STREAM = query("stream", "CN(c,n) OC(o,c)", "n,o")
#: A query with states of its nodes, hung up at its customers, and one at a generalized node, the parts.
KEYED = query("keyed", "CN(c,n) OC(o,c) SN(s,n)", "n,o")
OFFERED = query("offered", "LO(o,p) LS(p,s)", "p")
#: Queries at the same atom, of which none needs more than its columns; customers are users of the same number.
MEMBERS = [query("k0", "OC(o,c) CN(c,n)", "o,c"), query("k1", "OC(o,c) CN(c,n) SN(s,n)", "o,c"), query("k2", "OC(o,c) UE(c,t)", "o,c")]
#: The change logs of CN and OC as update lines: relation -> [(place among lines of one seq, line, condition)], in SQL of both engines.
#: Some lines are of no known op or tag, end in empty fields, have none, or lack the digit of an insert.
PIPED_LOG = {
    "CN": [(0, "op || '|CN|' || CAST(c AS STRING) || '|' || CAST(n AS STRING)", "true")],
    "OC": [
        (0, "'?|OC|' || CAST(o AS STRING)", "o % 10 = 4"),
        (1, "'+|XX|' || CAST(o AS STRING)", "o % 10 = 5"),
        (2, "op || '|OC|' || CAST(o AS STRING) || '|' || CAST(c AS STRING) || CASE WHEN o % 10 = 3 THEN '||' ELSE '' END", "true"),
        (3, "'+|OC|x' || CAST(o AS STRING)", "o % 10 = 6"),
    ],
}
_DIGIT = "CASE WHEN op = '-' THEN '0 ' WHEN {0} % 3 = 0 THEN '' ELSE '1 ' END"
TABLED_LOG = {
    "CN": [(0, _DIGIT.format("c") + """ || 'CN ' || CAST(c AS STRING) || ', "name, of ' || CAST(c AS STRING) || '",' || CAST(n AS STRING)""", "true")],
    "OC": [
        (0, "'1 OC'", "o % 10 = 4"),
        (1, "'XX ' || CAST(o AS STRING)", "o % 10 = 5"),
        (2, _DIGIT.format("o") + """ || 'OC ' || CAST(o AS STRING) || ',,"' || CAST(c AS STRING) || '"  '""", "true"),
    ],
}
PIPED_FEEDS = [("OC", "OC", 0, [0, 1]), ("OC", "ORDERS", 0, [1]), ("CN", "CN", 0, [0, 1])]
TABLED_FEEDS = [("OC", "OC", 0, [0, 2]), ("OC", "GAPS", 0, [1]), ("CN", "CN", 0, [0, 2]), ("CN", "NAMES", 0, [1])]


def _tables(spark: SparkSession, sf_dir: str) -> sn.Tables:
    return lambda name: src.relation(spark, sf_dir, name)


def _logs(spark: SparkSession, sf_dir: str) -> lt.Logs:
    return lambda name: src.change_log(spark, sf_dir, name)


def _joined_sql(q: Query, rows: Callable[[str], str] = src.relation_sql, extra: Callable[[int], str] = lambda k: "") -> str:
    """The natural join of the query's atoms as a FROM clause."""
    width = {r: len(c) for r, (_, c) in src.RELATIONS.items()}
    parts = []
    for k, a in enumerate(sn._in_order(q)):
        names = list(src.RELATIONS[a.relation][1])[: width[a.relation]]
        parts.append(f"(SELECT {', '.join(f'{c} AS {x}' for c, x in zip(names, a.attrs, strict=True))}{extra(k)} FROM ({rows(a.relation)}))")
    return " NATURAL JOIN ".join(parts)


def _snapshot_sql(q: Query) -> str:
    return f"SELECT DISTINCT {', '.join(q.out)} FROM {_joined_sql(q)}"


def _lives_sql(name: str) -> str:
    cols = ", ".join(src.RELATIONS[name][1])
    return f"SELECT {cols}, seq AS s_, e_ FROM (SELECT *, coalesce(lead(seq) OVER (PARTITION BY {cols} ORDER BY seq), {NEVER}) AS e_ FROM ({src.change_log_sql(name)})) WHERE op = '+'"


def _joined_lives_sql(q: Query) -> str:
    n = len(q.atoms)
    s, e = (f"{f}({', '.join(f'{c}{k}' for k in range(n))})" if n > 1 else f"{c}0" for f, c in (("greatest", "s"), ("least", "e")))
    return f"SELECT * FROM (SELECT DISTINCT {', '.join(q.out)}, {s} AS s_, {e} AS e_ FROM {_joined_sql(q, _lives_sql, lambda k: f', s_ AS s{k}, e_ AS e{k}')}) WHERE s_ < e_"


def _delta_sql(q: Query) -> str:
    y = ", ".join(q.out)
    return f"""
WITH j AS ({_joined_lives_sql(q)}),
f AS (SELECT *, CASE WHEN max(e_) OVER (PARTITION BY {y} ORDER BY s_, e_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s_ THEN 0 ELSE 1 END AS fresh FROM j),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY {y} ORDER BY s_, e_ ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT {y}, min(s_) AS s_, max(e_) AS e_ FROM i GROUP BY {y}, island)
SELECT '+' AS op, s_ AS seq, {y} FROM m UNION ALL SELECT '-' AS op, e_ AS seq, {y} FROM m WHERE e_ < {NEVER}"""


def _tagged(queries: list[Query], sql: Callable[[Query], str], first: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {k} AS qid, {first}{', '.join(f'{c} AS y{i + 1}' for i, c in enumerate(q.out))} FROM ({sql(q)})" for k, q in enumerate(queries))


def _unwritten(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """The change logs of relations as changes of maintained views."""
    parts = []
    for name in names:
        log = src.change_log(spark, sf_dir, name)
        cells = [c for c in log.columns if c not in ("op", "seq")]
        parts.append(log.select(F.lit(name).alias("rel"), F.array(*(F.col(c).cast("string") for c in cells)).alias("cells"), "op", "seq"))
    return reduce(DataFrame.unionByName, parts)


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{src.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(views: Views, changes: DataFrame, bounds: list[int] = BOUNDS) -> Views:
    """The views after their stream has found each batch's files and stopped; it goes on where it stopped.

    All changes are written once, to a folder for each batch, which is moved to where the stream looks.
    """
    spark = changes.sparkSession
    root, apart = _fresh(spark, "in"), _fresh(spark, "apart")
    _apart(changes, apart, bounds)
    for k in range(len(bounds)):
        if not src.moved(spark, f"{apart}/_batch={k}", f"{root}/{k}"):
            spark.createDataFrame([], changes.schema).write.parquet(f"{root}/{k}")
        views.start(spark.readStream.schema(changes.schema).option("recursiveFileLookup", "true").parquet(root)).awaitTermination()
    return views


def _apart(rows: DataFrame, path: str, bounds: list[int] = BOUNDS) -> None:
    """Writes rows to a folder for each micro-batch, by seq; a task has a file open for each, so that it need not sort."""
    spark, most = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    batch = reduce(lambda found, k: F.when(F.col("seq") >= bounds[k], k).otherwise(found), range(1, len(bounds)), F.lit(0))
    before = spark.conf.get(most)
    spark.conf.set(most, len(bounds))
    try:
        rows.withColumn("_batch", batch).write.partitionBy("_batch").parquet(path)
    finally:
        spark.conf.set(most, before)


def _levels(spark: SparkSession, sf_dir: str, queries: list[Query], tops: list[int | tuple[str, ...]], bounds: list[int] = BOUNDS, sets: bool = False) -> LevelViews:
    """Views with states of their nodes, after a stream of the change logs of their relations, batch by batch."""
    views = LevelViews(spark, queries, _fresh(spark, "levels"), tops, sets=sets)
    return _streamed(views, _unwritten(spark, sf_dir, sorted({a.relation for q in queries for a in q.atoms})), bounds)


def _numbers(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*(F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in rows.columns))


def _stream(spark: SparkSession, sf_dir: str) -> View:
    return _streamed(View(spark, STREAM, _fresh(spark, "view")), _unwritten(spark, sf_dir, ["CN", "OC"]))


def _update_lines(spark: SparkSession, sf_dir: str, lines: dict[str, list[tuple[int, str, str]]]) -> DataFrame:
    """(seq, place, value): update lines of whole change logs."""
    parts = []
    for name, forms in lines.items():
        log = src.change_log(spark, sf_dir, name)
        parts += [log.where(cond).select("seq", F.lit(place).alias("place"), F.expr(line).alias("value")) for place, line, cond in forms]
    return reduce(DataFrame.unionByName, parts)


def _update_lines_sql(lines: dict[str, list[tuple[int, str, str]]]) -> str:
    return " UNION ALL ".join(f"SELECT seq, {place} AS place, {line} AS value FROM ({src.change_log_sql(name)}) WHERE {cond}" for name, forms in lines.items() for place, line, cond in forms)


def _ingested(spark: SparkSession, sf_dir: str, form: str, lines: dict[str, list[tuple[int, str, str]]], feeds: up.Registry) -> DataFrame:
    """Writes the lines as text in order, reads them as updates and routes those."""
    path = _fresh(spark, "lines")
    _update_lines(spark, sf_dir, lines).orderBy("seq", "place", "value").select("value").write.text(path)
    return up.routed(up.read_updates(spark, path, form), feeds).withColumn("values", F.array_join("values", ";", "<none>"))


def _stream_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted log of a view that text files of update lines maintain, by a schema file."""
    path, schema = _fresh(spark, "lines"), _fresh(spark, "schema")
    spark.createDataFrame([("\n".join(f"{t},{r},{k},{','.join(map(str, f))}" for t, r, k, f in PIPED_FEEDS) + "\n1  # queries\n0\nCN.0,1\nOC.0,0",)], "value string").write.text(schema)
    views = Views(spark, [STREAM], _fresh(spark, "view"))
    apart = _fresh(spark, "apart")
    _apart(_update_lines(spark, sf_dir, PIPED_LOG), apart)
    for k in range(len(BOUNDS)):
        spark.read.parquet(apart).where(F.col("_batch") == k).orderBy("seq", "place", "value").select("value").write.mode("append").text(path)
        views.start_text(path, "piped", up.read_schema(spark, schema)[0]).awaitTermination()
    return views.log()


def _stream_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output changes, by batch, of queries that share a node."""
    views = _streamed(Views(spark, [SHARED_NODE, *SHARING], _fresh(spark, "views")), _unwritten(spark, sf_dir, ["NR", "CN", "OC", "LO"]))
    parts = [views.output(k + 1).select(F.lit(k).alias("qid"), "batch", "op", *(F.col(c).cast("bigint").alias(f"y{i + 1}") for i, c in enumerate(q.out))) for k, q in enumerate(SHARING)]
    return reduce(DataFrame.unionByName, parts)


def _stream_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a view's results, at its update, from a stream."""
    found = _streamed(View(spark, DELTAS[1], _fresh(spark, "view"), exact=True), _unwritten(spark, sf_dir, ["CN", "OC", "LO"])).exact_log()
    return _numbers(found.drop("batch"), "n", "p")


def _stream_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output changes, by batch, of queries whose common parts are found and maintained once."""
    views = Views.sharing(spark, MAINTAINED, _fresh(spark, "views"))
    places = {q.name: k for k, q in enumerate(views.queries)}
    views = _streamed(views, _unwritten(spark, sf_dir, ["NR", "CN", "OC", "LO"]))
    parts = [views.output(places[q.name]).select(F.lit(k).alias("qid"), "batch", "op", *(F.col(c).cast("bigint").alias(f"y{i + 1}") for i, c in enumerate(q.out))) for k, q in enumerate(MAINTAINED)]
    return reduce(DataFrame.unionByName, parts)


def _batches_sql(q: Query) -> str:
    """A query's net output changes by micro-batch."""
    batch = "CASE " + " ".join(f"WHEN seq >= {lo} THEN {k}" for k, lo in reversed(list(enumerate(BOUNDS)))) + " END"
    y = ", ".join(q.out)
    return f"SELECT batch, CASE WHEN k > 0 THEN '+' ELSE '-' END AS op, {y} FROM (SELECT {batch} AS batch, {y}, sum(CASE WHEN op = '+' THEN 1 ELSE -1 END) AS k FROM ({_delta_sql(q)}) GROUP BY ALL) WHERE k <> 0"


def _after_batches_sql(sql: Callable[[Callable[[str], str]], str], bounds: list[int] = BOUNDS) -> str:
    """`sql`, given the relations' contents after each batch, with the batch."""
    def contents(name: str, seq: int) -> str:
        return f"SELECT {', '.join(src.RELATIONS[name][1])} FROM ({_lives_sql(name)}) WHERE s_ < {seq} AND e_ >= {seq}"

    return " UNION ALL ".join(f"SELECT {k} AS batch, * FROM ({sql(lambda name, seq=seq: contents(name, seq))})" for k, seq in enumerate([*bounds[1:], NEVER]))


def _dealt_tasks(spark: SparkSession, sf_dir: str, q: Query) -> int:
    """A number of tasks that grows with the query's tables."""
    rows = src.source_rows(spark, sf_dir, [a.relation for a in q.atoms])
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT_ROWS))


def _rows_of(spark: SparkSession, sf_dir: str, q: Query) -> Callable[[Atom], DataFrame] | None:
    """For queries in DEALT their atoms' rows, in tasks whose number grows with the tables."""
    if q.name not in DEALT:
        return None
    return sn.dealt(_tables(spark, sf_dir), DEALT[q.name], _dealt_tasks(spark, sf_dir, q))


def _snapshot(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
    if q.name in GATHERED:
        return sn.gathered(lambda name: src.relation(spark, sf_dir, name, GATHERED_BY[name]), q, GATHERED[q.name], _dealt_tasks(spark, sf_dir, q))
    return sn.snapshot(_tables(spark, sf_dir), q, _rows_of(spark, sf_dir, q))


def _delta(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
    if q.name in GATHERED:
        return lt.gathered_log(lambda name: src.change_log(spark, sf_dir, name, GATHERED_BY[name]), q, GATHERED[q.name], _dealt_tasks(spark, sf_dir, q))
    return lt.delta_log(_logs(spark, sf_dir), q)


def queries() -> dict[str, Run]:
    found: dict[str, Run] = {}
    for q in SNAPSHOTS:
        found[q.name] = lambda spark, d, q=q: _snapshot(spark, d, q)
    for q in REDUCED:
        found[q.name] = lambda spark, d, q=q: sn.reduced(_tables(spark, d), q, _rows_of(spark, d, q))
    for q in DELTAS:
        found[q.name] = lambda spark, d, q=q: _delta(spark, d, q)

    def semi_join_existence(spark: SparkSession, d: str) -> DataFrame:
        t = _tables(spark, d)
        return sn.natural_join(t("OC"), t("LO"), "left_semi").select("c").distinct()

    def classified(spark: SparkSession, d: str) -> DataFrame:
        t = _tables(spark, d)
        few = t("LO").where("p % 3 = 0")
        return sn.satisfied(t("OC"), [t("CN").where("n % 2 = 0"), few])

    def nations(spark: SparkSession, d: str) -> DataFrame:
        t = _tables(spark, d)
        return sn.generalized([t("CN").where("n < 20"), t("SN").where("n > 4")], ["n"])

    def replay_differences(spark: SparkSession, d: str) -> DataFrame:
        q, logs = query("r", "CN(c,n) OC(o,c)", "n,o"), _logs(spark, d)
        a, b = lt.replayed(lt.delta_log(logs, q), STATE_SEQ), lt.state_at(logs, q, STATE_SEQ)
        return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n_different"))

    def broken_log(spark: SparkSession, d: str) -> DataFrame:
        """Orders' log with repeated inserts of every 11th order and deletes of orders that never were."""
        log = src.change_log(spark, d, "OC")
        first = log.where("op = '+' AND o % 11 = 0 AND seq < 4000000")
        return log.unionByName(first.withColumn("seq", F.expr("seq + 100"))).unionByName(first.select((-F.col("o") - 1).alias("o"), "c", F.lit("-").alias("op"), "seq"))

    def _violated(spark: SparkSession, d: str, log: DataFrame) -> DataFrame:
        """What a view's stream finds wrong with that log."""
        changes = log.select(F.lit("OC").alias("rel"), F.array(F.col("o").cast("string"), F.col("c").cast("string")).alias("cells"), "op", "seq")
        found = _streamed(View(spark, query("v", "OC(o,c)", "o"), _fresh(spark, "view")), changes).violations()
        return found.select(F.col("cells")[0].cast("bigint").alias("o"), F.col("cells")[1].cast("bigint").alias("c"), "op", "seq", "violation")

    batches = list(range(len(BOUNDS)))

    found |= {
        "semi_join_existence": semi_join_existence,
        "alive_tuples": lambda spark, d: classified(spark, d).where("alive").select("o", "c"),
        "onhold_tuples": lambda spark, d: classified(spark, d).where("NOT alive").select("o", "c", "n_satisfied"),
        "key_count": lambda spark, d: src.relation(spark, d, "OC").groupBy("c").agg(F.count(F.lit(1)).alias("n_alive")),
        "derivation_count": lambda spark, d: sn.derivations(_tables(spark, d), query("d", "CN(c,n) OC(o,c) LO(o,p)", "n,p")),
        "generalized_alive": lambda spark, d: nations(spark, d).where("alive").select("n"),
        "generalized_onhold": lambda spark, d: nations(spark, d).where("NOT alive").select("n", "n_children"),
        "live_view": lambda spark, d: sn.live_view(_tables(spark, d), LIVE[2], 0),
        "query_set_union": lambda spark, d: sn.query_sets(_tables(spark, d), LIVE, 0),
        "multi_query": lambda spark, d: sn.many(_tables(spark, d), MULTI),
        "multi_query_shared": lambda spark, d: sn.shared(_tables(spark, d), SHARED_NODE, SHARING),
        "multi_query_found": lambda spark, d: sn.found_shared(_tables(spark, d), FOUND, rows=lambda name: src.source_rows(spark, d, [name])),
        "factorised_count": lambda spark, d: factorised(_tables(spark, d), SIBLINGS).count(),
        "factorised_page": lambda spark, d: factorised(_tables(spark, d), SIBLINGS).page(*PAGE),
        "factorised_expanded": lambda spark, d: factorised(_tables(spark, d), SIBLINGS).expanded(),
        "isomorphic_queries": lambda spark, d: sn.many(_tables(spark, d), ISOMORPHIC),
        "annotation_product": lambda spark, d: sn.annotated(_tables(spark, d), query("a", "CN(c,n) OC(o,c)", "n,o"), {"CN": "1 + c % 3", "OC": "1 + o % 5"}),
        "insert_log": lambda spark, d: lt.formatted(lt.delta_log(_logs(spark, d), DELTAS[0]).where("op = '+'")),
        "delete_log": lambda spark, d: lt.formatted(lt.delta_log(_logs(spark, d), DELTAS[0]).where("op = '-'")),
        "delta_delete_path": lambda spark, d: lt.delta_log(_logs(spark, d), DELTAS[1]).where("op = '-'"),
        "delta_multi_query": lambda spark, d: lt.delta_logs(_logs(spark, d), [DELTAS[0], DELTAS[1], DELTAS[5]]),
        "state_at_seq": lambda spark, d: lt.state_at(_logs(spark, d), DELTAS[1], STATE_SEQ),
        "delta_sum_equals_snapshot": replay_differences,
        "delta_netted_batches": lambda spark, d: lt.netted(lt.delta_log(_logs(spark, d), DELTAS[1]), BATCH),
        "duplicate_insert_check": lambda spark, d: lt.violations(broken_log(spark, d)).where("violation = 'duplicate_insert'"),
        "missing_delete_check": lambda spark, d: lt.violations(broken_log(spark, d)).where("violation = 'missing_delete'"),
        "delta_replay_state": lambda spark, d: lt.replayed(lt.delta_log(_logs(spark, d), DELTAS[1]), STATE_SEQ),
        "text_ingest_snb": lambda spark, d: _ingested(spark, d, "piped", PIPED_LOG, PIPED_FEEDS),
        "text_ingest_job": lambda spark, d: _ingested(spark, d, "tabled", TABLED_LOG, TABLED_FEEDS),
        "stream_from_text": _stream_from_text,
        "stream_multi_query": _stream_multi,
        "stream_violations": lambda spark, d: _violated(spark, d, broken_log(spark, d)),
        "stream_alive": lambda spark, d: _numbers(_levels(spark, d, [KEYED], [0]).states_after(0, batches).where("alive").drop("alive", "n_satisfied"), "c", "n"),
        "stream_onhold": lambda spark, d: _numbers(_levels(spark, d, [KEYED], [0]).states_after(0, batches).where("NOT alive").drop("alive"), "c", "n"),
        "stream_live": lambda spark, d: _numbers(_levels(spark, d, [KEYED], [0]).live_after(1, batches), "o", "c"),
        "stream_keyed": lambda spark, d: _numbers(_levels(spark, d, [KEYED], [0]).output(), "n", "o"),
        "stream_generalized": lambda spark, d: _numbers(_levels(spark, d, [OFFERED], [("p",)], OFFERED_BOUNDS).states_after(2, batches), "p"),
        "stream_query_sets": lambda spark, d: _numbers(_levels(spark, d, MEMBERS, [0, 0, 0], sets=True).query_sets_after(batches), "o", "c"),
        "stream_exact_log": _stream_exact,
        "stream_multi_found": _stream_found,
        "stream_microbatch_total": lambda spark, d: _stream(spark, d).results().select(F.col("n").cast("bigint").alias("n"), F.col("o").cast("bigint").alias("o")),
        "stream_microbatch_output": lambda spark, d: _stream(spark, d).output().groupBy("op").agg(F.count(F.lit(1)).alias("changes")),
    }
    return found


def oracle_sql() -> dict[str, str]:
    r = src.relation_sql
    children = f"WITH oc AS ({r('OC')}), x AS (SELECT o, c, CASE WHEN c IN (SELECT c FROM ({r('CN')}) WHERE n % 2 = 0) THEN 1 ELSE 0 END + CASE WHEN o IN (SELECT o FROM ({r('LO')}) WHERE p % 3 = 0) THEN 1 ELSE 0 END AS n_satisfied FROM oc)"
    keys = f"WITH k AS (SELECT DISTINCT n, 0 AS side FROM ({r('CN')}) WHERE n < 20 UNION ALL SELECT DISTINCT n, 1 FROM ({r('SN')}) WHERE n > 4), g AS (SELECT n, CAST(count(*) AS INTEGER) AS n_children FROM k GROUP BY n)"
    co = _snapshot_sql(SHARED_NODE)
    live = [f"SELECT DISTINCT o, c FROM {_joined_sql(q)}" for q in LIVE]
    broken = f"WITH l AS ({src.change_log_sql('OC')}), f AS (SELECT * FROM l WHERE op = '+' AND o % 11 = 0 AND seq < 4000000), b AS (SELECT o, c, op, seq FROM l UNION ALL SELECT o, c, op, seq + 100 FROM f UNION ALL SELECT -o - 1, c, '-', seq FROM f), w AS (SELECT *, lag(op) OVER (PARTITION BY o, c ORDER BY seq, op) AS prev FROM b)"
    formatted = "SELECT op || ' 0 ' || n || ', ' || o AS line FROM ({}) WHERE op = '{}'"
    found = {q.name: _snapshot_sql(q) for q in [*SNAPSHOTS, *REDUCED]} | {q.name: _delta_sql(q) for q in DELTAS}
    last = _delta_sql(STREAM)
    numbered = "row_number() OVER (ORDER BY seq, place, value) AS seq"
    piped = f"WITH l AS ({_update_lines_sql(PIPED_LOG)}), p AS (SELECT *, string_split(rtrim(value, '|'), '|') AS p FROM l), k AS (SELECT {numbered}, p[1] AS op, p[2] AS tag, p[3:] AS cells FROM p WHERE len(p) >= 2 AND p[1] IN ('+', '-'))"
    line = "'^([01] )?([A-Z]+) (.+)$'"
    tabled = f"WITH l AS ({_update_lines_sql(TABLED_LOG)}), k AS (SELECT {numbered}, CASE WHEN value LIKE '0 %' THEN '-' ELSE '+' END AS op, regexp_extract(value, {line}, 2) AS tag, regexp_extract(value, {line}, 3) AS rest FROM l WHERE regexp_matches(value, {line}))"

    def fed(head: str, parts: list[tuple[str, str, str, list[str]]]) -> str:
        """The routed rows: for each relation that a tag feeds (tag, relation, key, values)."""
        shown = {r: " || ';' || ".join(f"coalesce({v}, '<none>')" for v in values) for _, r, _, values in parts}
        return head + " UNION ALL ".join(f" SELECT op, seq, '{r}' AS relation, TRY_CAST({key} AS BIGINT) AS key, {shown[r]} AS \"values\", TRY_CAST({key} AS BIGINT) IS NOT NULL{''.join(f' AND {v} IS NOT NULL' for v in values)} AS ok FROM k WHERE tag = '{t}'" for t, r, key, values in parts)

    def part(pattern: str, k: int) -> str:
        return f"regexp_extract(rest, '{pattern}', {k})"

    cn, oc = r'^(\d+), "(.*)",(\d+)$', r'^(\d+),,"(\d+)" *$'
    return found | {
        "semi_join_existence": f"SELECT DISTINCT c FROM ({r('OC')}) WHERE o IN (SELECT o FROM ({r('LO')}))",
        "alive_tuples": f"{children} SELECT o, c FROM x WHERE n_satisfied = 2",
        "onhold_tuples": f"{children} SELECT o, c, n_satisfied FROM x WHERE n_satisfied < 2",
        "key_count": f"SELECT c, count(*) AS n_alive FROM ({r('OC')}) GROUP BY c",
        "derivation_count": f"SELECT n, p, count(*) AS n_derivations FROM {_joined_sql(query('d', 'CN(c,n) OC(o,c) LO(o,p)', 'n,p'))} GROUP BY n, p",
        "generalized_alive": f"{keys} SELECT n FROM g WHERE n_children = 2",
        "generalized_onhold": f"{keys} SELECT n, n_children FROM g WHERE n_children < 2",
        "live_view": live[2],
        "query_set_union": f"SELECT o, c, string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) AS qids FROM ({' UNION ALL '.join(f'SELECT o, c, {k} AS qid FROM ({s})' for k, s in enumerate(live))}) GROUP BY o, c",
        "multi_query": _tagged(MULTI, _snapshot_sql),
        "multi_query_shared": f"WITH co AS ({co}) SELECT DISTINCT 0 AS qid, co.n AS y1, l.p AS y2 FROM co JOIN ({r('LO')}) l ON l.o = co.o UNION ALL SELECT DISTINCT 1, nr.r, co.o FROM co JOIN ({r('NR')}) nr ON nr.n = co.n UNION ALL SELECT 2, n, o FROM co",
        "multi_query_found": _tagged(FOUND, _snapshot_sql),
        "factorised_count": f"SELECT count(*) AS n FROM {_joined_sql(SIBLINGS)}",
        "factorised_page": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY o, c, p1, p, s) - 1 AS rank, o, c, p1, p, s FROM {_joined_sql(SIBLINGS)}) WHERE rank >= {PAGE[0]} AND rank < {sum(PAGE)}",
        "factorised_expanded": _snapshot_sql(SIBLINGS),
        "isomorphic_queries": _tagged(ISOMORPHIC, _snapshot_sql),
        "annotation_product": f"SELECT n, o, CAST((1 + c % 3) * (1 + o % 5) AS DOUBLE) AS ann FROM {_joined_sql(query('a', 'CN(c,n) OC(o,c)', 'n,o'))}",
        "insert_log": formatted.format(_delta_sql(DELTAS[0]), "+"),
        "delete_log": formatted.format(_delta_sql(DELTAS[0]), "-"),
        "delta_delete_path": f"SELECT * FROM ({_delta_sql(DELTAS[1])}) WHERE op = '-'",
        "delta_multi_query": _tagged([DELTAS[0], DELTAS[1], DELTAS[5]], _delta_sql, "op, seq, "),
        "state_at_seq": f"SELECT DISTINCT n, p FROM ({_joined_lives_sql(DELTAS[1])}) WHERE s_ <= {STATE_SEQ} AND e_ > {STATE_SEQ}",
        "delta_sum_equals_snapshot": "SELECT CAST(0 AS BIGINT) AS n_different",
        "delta_netted_batches": f"SELECT batch, CASE WHEN k > 0 THEN '+' ELSE '-' END AS op, n, p FROM (SELECT seq // {BATCH} AS batch, n, p, sum(CASE WHEN op = '+' THEN 1 ELSE -1 END) AS k FROM ({_delta_sql(DELTAS[1])}) GROUP BY ALL) WHERE k <> 0",
        "duplicate_insert_check": f"{broken} SELECT o, c, op, seq, 'duplicate_insert' AS violation FROM w WHERE op = '+' AND prev = '+'",
        "missing_delete_check": f"{broken} SELECT o, c, op, seq, 'missing_delete' AS violation FROM w WHERE op = '-' AND coalesce(prev, '-') = '-'",
        "delta_replay_state": f"SELECT DISTINCT n, p FROM ({_joined_lives_sql(DELTAS[1])}) WHERE s_ <= {STATE_SEQ} AND e_ > {STATE_SEQ}",
        "text_ingest_snb": fed(piped, [("OC", "OC", "cells[1]", ["cells[1]", "cells[2]"]), ("OC", "ORDERS", "cells[1]", ["cells[2]"]), ("CN", "CN", "cells[1]", ["cells[1]", "cells[2]"])]),
        "text_ingest_job": fed(tabled, [("OC", "OC", part(oc, 1), [part(oc, 1), part(oc, 2)]), ("OC", "GAPS", part(oc, 1), ["'null'"]), ("CN", "CN", part(cn, 1), [part(cn, 1), part(cn, 3)]), ("CN", "NAMES", part(cn, 1), [part(cn, 2)])]),
        "stream_from_text": f"SELECT op || ' 0 ' || n || ', ' || o AS line, batch FROM ({_batches_sql(STREAM)})",
        "stream_multi_query": _tagged([query("s0", "CN(c,n) OC(o,c) LO(o,p)", "n,p"), query("s1", "CN(c,n) OC(o,c) NR(n,r)", "r,o"), query("s2", "CN(c,n) OC(o,c)", "n,o")], _batches_sql, "batch, op, "),
        "stream_violations": f"{broken} SELECT o, c, op, seq, CASE op WHEN '+' THEN 'duplicate_insert' ELSE 'missing_delete' END AS violation FROM w WHERE op = coalesce(prev, '-')",
        "stream_alive": _after_batches_sql(lambda at: f"SELECT c, n FROM ({at('CN')}) WHERE c IN (SELECT c FROM ({at('OC')})) AND n IN (SELECT n FROM ({at('SN')}))"),
        "stream_onhold": _after_batches_sql(lambda at: f"SELECT * FROM (SELECT c, n, CAST(c IN (SELECT c FROM ({at('OC')})) AS INTEGER) + CAST(n IN (SELECT n FROM ({at('SN')})) AS INTEGER) AS n_satisfied FROM ({at('CN')})) WHERE n_satisfied < 2"),
        "stream_live": _after_batches_sql(lambda at: f"SELECT o, c FROM ({at('OC')}) WHERE c IN (SELECT c FROM ({at('CN')}) WHERE n IN (SELECT n FROM ({at('SN')})))"),
        "stream_keyed": _batches_sql(KEYED),
        "stream_generalized": _after_batches_sql(lambda at: f"SELECT p, CAST(count(*) AS INTEGER) AS n_satisfied, count(*) = 2 AS alive FROM (SELECT DISTINCT p, 0 AS side FROM ({at('LO')}) UNION ALL SELECT DISTINCT p, 1 FROM ({at('LS')})) GROUP BY p", OFFERED_BOUNDS),
        "stream_query_sets": _after_batches_sql(lambda at: f"SELECT o, c, string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) AS qids FROM (SELECT o, c, unnest(CASE WHEN n IS NULL THEN [] WHEN n IN (SELECT n FROM ({at('SN')})) THEN [0, 1] ELSE [0] END || CASE WHEN c IN (SELECT u FROM ({at('UE')})) THEN [2] ELSE [] END) AS qid FROM ({at('OC')}) LEFT JOIN ({at('CN')}) USING (c)) GROUP BY o, c"),
        "stream_exact_log": _delta_sql(DELTAS[1]),
        "stream_multi_found": _tagged(MAINTAINED, _batches_sql, "batch, op, "),
        "stream_microbatch_total": f"SELECT n, o FROM (SELECT n, o, sum(CASE WHEN op = '+' THEN 1 ELSE -1 END) AS k FROM ({last}) GROUP BY n, o) WHERE k > 0",
        "stream_microbatch_output": f"SELECT op, count(*) AS changes FROM ({_batches_sql(STREAM)}) GROUP BY op",
    }
