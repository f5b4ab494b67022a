"""Deltas of conjunctive queries from change logs, exactly per update, in one batch job.

A base tuple lives from an insert to the next delete; without one it has no end (null). A joined row
lives where all its tuples do. A result lives where at least one of its rows does: overlapping and
touching lives merge, and the ends of what remains are the inserts and deletes that a maintained
view would emit, under set semantics.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.operators.packed import logged, packed
from deltaloom.operators.snapshot import LIST, WHOLE, _gathering, _in_order, atom_rows, natural_join
from deltaloom.plans.model import Query

#: Relation name -> its change log: columns, then op ('+' or '-') and seq.
Logs = Callable[[str], DataFrame]


def lives(log: DataFrame) -> DataFrame:
    """(columns, _start, _end): a row for each insert, up to the tuple's next entry in the log; _end is null if there is none."""
    keys = [c for c in log.columns if c not in ("op", "seq")]
    after = F.lead("seq").over(Window.partitionBy(*keys).orderBy("seq", F.desc("op")))
    return log.withColumn("_end", after).where("op = '+'").select(*keys, F.col("seq").alias("_start"), "_end")


def _latest() -> Column:
    """The greatest _end, null if one is."""
    return F.when(~F.bool_or(F.isnull("_end")), F.max("_end"))


def joined_lives(logs: Logs, q: Query) -> DataFrame:
    """(out, _start, _end) of the joined rows that live at all; several lives of one result may overlap.

    Attributes of an atom that neither the output nor another atom has go before it is joined, and the
    lives of what is left merge: rows that only differ in what nobody asks for are never joined one by
    one. Those that only a join needed go after it.
    """
    atoms, rows = _in_order(q), None
    for k, atom in enumerate(atoms):
        own = _needed(atom_rows(lambda name: lives(logs(name)), atom, "_start", "_end"), {*q.out, *(a for other in [*atoms[:k], *atoms[k + 1 :]] for a in other.attrs)})
        if rows is None:
            rows = own
            continue
        met = natural_join(rows, own.withColumnsRenamed({"_start": "_s", "_end": "_e"}))
        later = {*q.out, *(a for other in atoms[k + 1 :] for a in other.attrs)}
        rows = met.select(*(c for c in met.columns if c in later), F.greatest("_start", "_s").alias("_start"), F.least("_end", "_e").alias("_end")).where("_end IS NULL OR _start < _end")
    return rows.select(*q.out, "_start", "_end").where("_end IS NULL OR _start < _end")


def _needed(rows: DataFrame, wanted: set[str]) -> DataFrame:
    """An atom's lives by its wanted attributes alone, merged if others go."""
    kept = [c for c in rows.columns if c in wanted]
    if len(kept) + 2 == len(rows.columns):
        return rows
    return merged(rows.where("_end IS NULL OR _start < _end").groupBy(*kept, "_start").agg(_latest().alias("_end")))


def longest(rows: DataFrame, q: Query) -> DataFrame:
    """Of lives of one result that start together the longest."""
    return rows.groupBy(*q.out, "_start").agg(_latest().alias("_end"))


#: Bits of seq within which lives merge first, so that no task gets all lives of a result that has very many.
SLICES = (16, 32)
#: Lives of equal values in an atom that make a query's results crowded.
CROWDED = 100_000


def crowded(logs: Logs, q: Query) -> bool:
    """Whether a result may have very many lives: in every atom that holds output attributes, some values of theirs do."""
    for atom in sorted(q.atoms, key=lambda a: -len(set(a.attrs) & set(q.out))):
        own = [a for a in dict.fromkeys(atom.attrs) if a in q.out]
        if own and atom_rows(logs, atom, "op", "seq").where("op = '+'").groupBy(*own).count().where(F.col("count") > CROWDED).isEmpty():
            return False
    return True


def merged(rows: DataFrame) -> DataFrame:
    """Overlapping and touching intervals [_start, _end) of equal other columns as one.

    First those that start in one slice of time, then what is left of them in wider slices, then the
    few that are left in all. Each step is a shuffle; delta_log() takes the last alone where no
    result has very many lives.
    """
    keys = [c for c in rows.columns if c not in ("_start", "_end")]
    for bits in SLICES:
        rows = merged_at_once(rows.withColumn("_slice", F.shiftright("_start", bits)), [*keys, "_slice"]).drop("_slice")
    return merged_at_once(rows, keys)


def merged_at_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same for keys none of which has very many intervals: one shuffle."""
    order = Window.partitionBy(*keys).orderBy("_start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.bool_or(F.isnull("_end")).over(earlier) | (F.max("_end").over(earlier) >= F.col("_start"))
    fresh = rows.withColumn("_new", F.when(reached, 0).otherwise(1))
    island = fresh.withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(*keys, "_island").agg(F.min("_start").alias("_start"), _latest().alias("_end")).drop("_island")


def delta_log(logs: Logs, q: Query) -> DataFrame:
    """(op, seq, out): every result that appears ('+') or goes ('-'), at the update that does it."""
    rows = joined_lives(logs, q)
    return ends_of(merged(longest(rows, q)) if crowded(logs, q) else merged_at_once(rows, list(q.out)), q)


def gathered_log(logs: Logs, q: Query, by: str, tasks: int, longest: int = LIST) -> DataFrame:
    """delta_log() where the output is `by` and one attribute that the last atom alone has, both whole numbers.

    The other atoms' lives meet lists of the last one's, as bytes, and go with them to the task of
    their `by`; lives of pairs are there for the first time, a few customers' at a time, and merged.
    """
    *others, last = _in_order(q)
    rows = joined_lives(logs, Query(q.name, tuple(others), tuple(dict.fromkeys(a for x in others for a in x.attrs if a in {*q.out, *last.attrs}))))
    link, own = _gathering(q, rows, last, by)
    found = atom_rows(lambda name: lives(logs(name)), last, "_start", "_end")
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *found.schema.fields]}
    if {*q.out} != {by, own} or not {types[by], types[own]} <= WHOLE:
        raise ValueError(f"query {q.name}: not two whole numbers")
    found = found.select(*link, F.struct("_end", "_start", F.col(own).cast("bigint").alias("_own")).alias("_life"))
    at = F.row_number().over(Window.partitionBy(*link).orderBy("_life")) - 1
    lists = found.withColumn("_at", F.floor(at / longest)).groupBy(*link, "_at").agg(F.sort_array(F.collect_list("_life")).alias("_l")).select(*link, F.col("_l._own").alias("_o"), F.col("_l._start").alias("_s"), F.col("_l._end").alias("_e"))
    met = natural_join(rows, packed(lists, ["_o", "_s", "_e"], "_list")).select(by, "_start", "_end", "_list").repartition(tasks, by).sortWithinPartitions(by)
    return logged(met, by, own, "_list", q.out).withColumn(own, F.col(own).cast(types[own]))


def ends_of(lives_: DataFrame, q: Query) -> DataFrame:
    """(op, seq, out): where merged lives begin and end."""
    sides = F.explode(F.array(F.struct(F.lit("+").alias("op"), F.col("_start").alias("seq")), F.struct(F.lit("-").alias("op"), F.col("_end").alias("seq"))))
    return lives_.select(sides.alias("_d"), *q.out).where(F.col("_d.seq").isNotNull()).select("_d.op", "_d.seq", *q.out)


def delta_logs(logs: Logs, queries: list[Query]) -> DataFrame:
    """Deltas of several queries of equal output width, tagged by position as qid, columns y1, y2, …"""
    parts = []
    for k, q in enumerate(queries):
        d = delta_log(logs, q)
        parts.append(d.toDF("op", "seq", *(f"y{i + 1}" for i in range(len(q.out)))).select(F.lit(k).alias("qid"), "*"))
    return reduce(DataFrame.unionByName, parts)


def state_at(logs: Logs, q: Query, seq: int) -> DataFrame:
    """The results right after the update `seq`."""
    return joined_lives(logs, q).where((F.col("_start") <= seq) & (F.isnull("_end") | (F.col("_end") > seq))).select(*q.out).distinct()


def replayed(deltas: DataFrame, seq: int) -> DataFrame:
    """The results that a delta log leaves after `seq`: the sum of its signs is 1."""
    keys = [c for c in deltas.columns if c not in ("op", "seq")]
    sign = F.when(F.col("op") == "+", 1).otherwise(-1)
    return deltas.where(F.col("seq") <= seq).groupBy(*keys).agg(F.sum(sign).alias("_n")).where("_n > 0").drop("_n")


def netted(deltas: DataFrame, batch: int) -> DataFrame:
    """(batch, op, out): the net change of each batch of `batch` consecutive seqs."""
    keys = [c for c in deltas.columns if c not in ("op", "seq")]
    sign = F.when(F.col("op") == "+", 1).otherwise(-1)
    net = deltas.groupBy(F.expr(f"seq div {batch}").alias("batch"), *keys).agg(F.sum(sign).alias("_n")).where("_n <> 0")
    return net.select("batch", F.when(F.col("_n") > 0, "+").otherwise("-").alias("op"), *keys)


def violation(before: Column) -> Column:
    """What is wrong with `op` after the op `before` (null: none) of the same tuple, null if nothing."""
    return F.when((F.col("op") == "+") & (before == "+"), "duplicate_insert").when((F.col("op") == "-") & (F.coalesce(before, F.lit("-")) == "-"), "missing_delete")


def violations(log: DataFrame) -> DataFrame:
    """Log rows that a set can't take: an insert of a live tuple, a delete of an absent one."""
    keys = [c for c in log.columns if c not in ("op", "seq")]
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy("seq", F.desc("op")))
    return log.withColumn("violation", violation(before)).where("violation IS NOT NULL")


def formatted(deltas: DataFrame, qid: str | int = 0) -> DataFrame:
    """Text lines: sign, query, then the result's values with comma and space between."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in deltas.columns if c not in ("op", "seq", "qid")]
    tag = F.col(qid).cast("string") if isinstance(qid, str) else F.lit(str(qid))
    return deltas.select(F.concat_ws(" ", "op", tag, F.concat_ws(", ", *values)).alias("line"))
