"""Maintained answers of several queries over a stream of changes, by counting.

Each micro-batch is checked against the base relations, which are sets: an insert of a live tuple or
a delete of an absent one changes nothing and is kept as a violation. What is left are signed base
changes. The joined rows that they add or remove are the sum over i of
new(1) ⋈ … ⋈ new(i-1) ⋈ delta(i) ⋈ old(i+1) ⋈ …, with the product of the signs; only atoms whose
relation changes have a term. They change the number of derivations of each result; a result appears
when that number leaves zero and goes when it returns. Inside a batch, what appears and vanishes
again is netted away, unless the exact log is kept as well: then the lives of the batch's tuples are
joined, with one that began earlier open at its start, and one that goes on open at its end, to be
closed by a later batch. Where the batches' bounds lie makes no difference to that log.

A query may use an earlier one, by its name, as a relation: such a node is maintained once for all
that share it.

State is a folder of signed Parquet rows per batch, for each relation and for each query's counts.
As counting is linear, joins read signed rows as they are: nothing regroups the state, and of it
only rows that match the batch's go on. Every `fold` batches the state's folders so far become one,
and those of each log since the last fold. A batch that runs again overwrites its own folders, so
replay after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from deltaloom.operators.lifetimes import CROWDED, ends_of, formatted, longest, merged, merged_at_once, violation
from deltaloom.operators.snapshot import _in_order, atom_rows, natural_join
from deltaloom.plans.model import Query
from deltaloom.plans.sharing import share
from deltaloom.sources import updates as up
from deltaloom.sources.tables import remove, rewritten
from deltaloom.streaming.runs import FOLD, History, latencies, timed

CELLS = "cells array<string>, _n bigint"
#: The start of a life that began before the batch.
BEFORE = -(1 << 62)
#: Rows that are sent to all tasks.
FEW = 100_000
CHANGE = "rel string, cells array<string>, op string, seq bigint, violation string"


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def _changed(taken: DataFrame) -> DataFrame:
    """(cells, _start, _end): the lives that begin or end with a batch's changes of one relation."""
    begins = F.col("op") == "+"
    lives = taken.where(begins | ((F.col("op") == "-") & F.col("_first")))
    return lives.select("cells", F.when(begins, F.col("seq")).otherwise(BEFORE).alias("_start"), F.when(begins, F.col("_after")).otherwise(F.col("seq")).alias("_end"))


class Views:
    """Queries, maintained in `root` by batches of changes (rel, cells array<string>, op, seq)."""

    def __init__(self, spark: SparkSession, queries: list[Query], root: str, fold: int = FOLD, exact: bool = False):
        self.spark, self.queries, self.root, self.fold, self.exact = spark, queries, root, fold, exact
        nodes = [q.name for q in queries]
        for k, q in enumerate(queries):
            if own := {"op", "seq", "v"} & set(q.out):
                raise ValueError(f"query {q.name}: {sorted(own)} can't be output attributes, the views' tables have columns of that name")
            if set(nodes[k:]) & {a.relation for a in q.atoms}:
                raise ValueError(f"query {q.name} uses one that doesn't come before it")
        self.shared = {n for n in nodes if any(a.relation == n for q in queries for a in q.atoms)}
        self.bases = sorted({a.relation for q in queries for a in q.atoms} - set(nodes))
        self.histories = {
            "checked": History(f"{root}/checked", CHANGE, fold, "violation IS NOT NULL"),
            "refused": History(f"{root}/refused", CHANGE, fold),
            "latency": latencies(root, fold),
        }
        for k in range(len(queries)):
            self.histories[f"output/{k}"] = History(f"{root}/output/{k}", f"op string, {self._outputs(k)}", fold)
            if exact:
                self.histories[f"exact/{k}"] = History(f"{root}/exact/{k}", f"op string, seq bigint, {self._outputs(k)}", fold)

    @classmethod
    def sharing(cls, spark: SparkSession, queries: list[Query], root: str, rows: Callable[[str], int] = lambda name: 1, fold: int = FOLD, exact: bool = False) -> Views:
        """Views of the queries over nodes that they are found to have in common, which come before them; `rows` tells how large relations are."""
        nodes, rest = share(queries, rows)
        return cls(spark, [*nodes, *rest], root, fold, exact)

    def _state(self, name: str, schema: str, before: int) -> DataFrame:
        """All signed rows of earlier batches, in one read. A batch is written even if it changes nothing."""
        spark, folded = self.spark, before // self.fold * self.fold
        paths = [f"{self.root}/{name}/folded={folded}"] * (folded > 0) + [f"{self.root}/{name}/v={b}" for b in range(folded, before)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        return rewritten(df, f"{self.root}/{name}/v={batch}")

    def _fold(self, name: str, schema: str, upto: int) -> None:
        """Sums the rows of all batches before `upto` into one folder; what the last fold read goes, as no batch reads it again."""
        keys = [c for c in self.spark.createDataFrame([], schema).columns if c != "_n"]
        now = self._state(name, schema, upto - 1).unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={upto - 1}"))
        now.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0").write.mode("overwrite").parquet(f"{self.root}/{name}/folded={upto}")
        for old in [f"folded={upto - 2 * self.fold}", *(f"v={b}" for b in range(upto - 2 * self.fold, upto - self.fold))]:
            remove(self.spark, f"{self.root}/{name}/{old}")

    def _matching(self, state: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
        """The state's rows that have a match, by a hash first. Few rows are sent to the state; one that is smaller than the batch goes whole to where they are brought together."""
        keys = rows.select(*on)
        if _few(rows):
            return state.join(F.broadcast(keys), on, "left_semi")
        size = state.count()
        if size == 0 or size <= rows.count():
            return state
        by = F.hash(*on).alias("_hash")
        return state.select("*", by).join(keys.distinct().select("*", by), ["_hash", *on], "left_semi").drop("_hash")

    def _checked(self, changes: DataFrame, batch: int) -> DataFrame:
        """The batch's changes with what is wrong with each, and for a tuple's last one the sign of its net change.

        The state's rows of a tuple come before its changes, in one shuffle and sort, by a hash first as
        that is quick to compare. With the exact log, changes that a set can take also have the seq of the
        tuple's next one, and whether they are its first.
        """
        mine = changes.where(F.col("rel").isin(self.bases)).select("rel", "cells", "op", "seq")
        states = reduce(DataFrame.unionByName, [self._state(f"base/{name}", CELLS, batch).select(F.lit(name).alias("rel"), "cells", "_n") for name in self.bases])
        live = self._matching(states, mine, ["rel", "cells"])
        both = mine.withColumn("_new", F.lit(True)).unionByName(live.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        line = Window.partitionBy("_hash", "rel", "cells").orderBy("_new", "seq", F.desc("op"))
        rows = both.withColumn("_hash", F.hash("rel", "cells")).withColumn("_was", F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) > 0)
        before = F.coalesce(F.lag("op").over(line), F.when(F.col("_was"), "+"))
        last = F.lead("op").over(line).isNull()
        is_ = F.col("op") == "+"
        sign = F.when(last & is_ & ~F.col("_was"), 1).when(last & ~is_ & F.col("_was"), -1)
        found = rows.withColumns({"violation": violation(before), "_n": sign.cast("bigint")}).where("_new")
        if not self.exact:
            return found.select("rel", "cells", "op", "seq", "violation", "_n")
        after = F.expr("lead(IF(violation IS NULL, seq, NULL)) IGNORE NULLS OVER (PARTITION BY _hash, rel, cells ORDER BY _new, seq, op DESC)")
        taken = F.count(F.when(F.isnull("violation"), 1)).over(line.rowsBetween(Window.unboundedPreceding, -1))
        return found.select("rel", "cells", "op", "seq", "violation", "_n", after.alias("_after"), (taken == 0).alias("_first"))

    def _taken(self, changes: DataFrame, batch: int) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Writes what is refused of a batch, what is wrong with its changes, and each relation's net changes (cells, _n); gives the last two."""
        refused = F.when(F.col("rel").isin([q.name for q in self.queries]), "derived_relation").otherwise("unknown_relation")
        self._write(changes.where(~F.col("rel").isin(self.bases) | F.col("rel").isNull()).select("rel", "cells", "op", "seq", refused.alias("violation")), "refused", batch)
        found = self._checked(changes, batch)
        checked = self._write(found if self.exact else found.where("violation IS NOT NULL OR _n IS NOT NULL"), "checked", batch)
        return checked, {name: self._write(checked.where((F.col("rel") == name) & F.col("_n").isNotNull()).select("cells", "_n"), f"base/{name}", batch) for name in self.bases}

    def apply_all(self, changes: DataFrame, batch: int) -> list[DataFrame]:
        """Takes one batch into the state and returns each query's net output changes (op, out)."""
        self.spark = changes.sparkSession
        checked, nets = self._taken(changes, batch)
        taken = checked.where("violation IS NULL")
        kinds = checked.groupBy("rel").agg(F.count("_n").alias("moves"), F.bool_or(F.isnull("violation")).alias("changes")).collect()
        moving = {r["rel"]: r["moves"] for r in kinds if r["moves"]}
        changed = {r["rel"]: _changed(taken.where(F.col("rel") == r["rel"])) for r in kinds if r["changes"]} if self.exact else {}
        out = []
        for k, q in enumerate(self.queries):
            if self.exact:
                log = self._write(self._exact(q, k, changed, batch), f"exact/{k}", batch)
                if q.name in self.shared and not log.isEmpty():
                    line = Window.partitionBy("cells").orderBy("seq", F.desc("op"))
                    changed[q.name] = _changed(log.select(F.array(*q.out).alias("cells"), "op", "seq").select("*", F.lead("seq").over(line).alias("_after"), (F.row_number().over(line) == 1).alias("_first")))
            moved = self._output(q, k, nets, moving, batch)
            out.append(moved)
            if q.name in self.shared:
                signed = moved.select(F.array(*q.out).alias("cells"), F.when(F.col("op") == "+", 1).otherwise(-1).cast("bigint").alias("_n"))
                nets[q.name] = self._write(signed, f"base/{q.name}", batch)
                if n := moved.count():
                    moving[q.name] = n
        self._folded(nets, batch)
        if self.exact and batch:
            for k in range(len(self.queries)):
                remove(self.spark, f"{self.root}/lives/{k}/v={batch - 1}")
        return out

    def _folded(self, names: Iterable[str], batch: int) -> None:
        """To be called after each batch: folds the states of relations by name, the counts and the logs if it is the last of its `fold` ones."""
        if (batch + 1) % self.fold == 0:
            for name in names:
                self._fold(f"base/{name}", CELLS, batch + 1)
            for k in range(len(self.queries)):
                self._fold(f"counts/{k}", self._schema(k, "_n bigint"), batch + 1)
        for name, history in self.histories.items():
            if name != "latency":
                history.folded(self.spark, batch)

    def _output(self, q: Query, k: int, nets: dict[str, DataFrame], moving: dict[str, int], batch: int) -> DataFrame:
        """One query's net output changes, after its counts and output are written.

        Counts so far that are fewer than the tuples that change (`moving`, by relation) are summed in the
        aggregation that the joined rows need anyway; more than that are read for what changes, if that is
        little, and else meet it in one aggregation.
        """
        atoms = _in_order(q)

        def rows(i: int, name: str, state: DataFrame) -> DataFrame:
            width = len(atoms[i].attrs)
            return atom_rows(lambda _: state.select(*(F.col("cells")[c].alias(f"c{c}") for c in range(width)), "_n"), atoms[i], f"_n{i}")

        terms, n = [], reduce(lambda x, y: x * y, (F.col(f"_n{i}") for i in range(len(atoms))))
        for i, atom in enumerate(atoms):
            if atom.relation not in moving:
                continue
            joined = rows(i, atom.relation, nets[atom.relation])
            rest = []
            for j, other in enumerate(atoms):
                if j != i:
                    state = self._state(f"base/{other.relation}", CELLS, batch)
                    rest.append(rows(j, other.relation, state.unionByName(nets[other.relation]) if j < i else state))
            while rest:
                nxt = next(r for r in rest if set(r.columns) & set(joined.columns))
                joined = natural_join(joined, nxt)
                rest.remove(nxt)
            terms.append(joined.select(*q.out, n.alias("_n")))
        none, on = self.spark.createDataFrame([], self._schema(k, "_n bigint")), list(q.out)
        joined = reduce(DataFrame.unionByName, terms, none)
        before = self._state(f"counts/{k}", self._schema(k, "_n bigint"), batch)
        if before.count() <= sum(moving.get(name, 0) for name in {a.relation for a in atoms}):
            moved = self._write(self._summed(joined, before, on), f"counts/{k}", batch)
        else:
            delta = self._write(joined.groupBy(*on).agg(F.sum("_n").cast("bigint").alias("_n")).where("_n <> 0"), f"counts/{k}", batch)
            moved = self._summed(delta, self._matching(before, delta, on) if _few(delta) else before, on)
        op = F.when((F.col("_m") <= 0) & (F.col("_m") + F.col("_n") > 0), "+").when((F.col("_m") > 0) & (F.col("_m") + F.col("_n") <= 0), "-")
        return self._write(moved.select(op.alias("op"), *on).where("op IS NOT NULL"), f"output/{k}", batch)

    @staticmethod
    def _summed(rows: DataFrame, before: DataFrame, on: list[str]) -> DataFrame:
        """(on, _n, _m): what rows change in all, if anything, and what was before, in one shuffle."""
        both = rows.select(*on, "_n", F.lit(0).cast("bigint").alias("_m")).unionByName(before.select(*on, F.lit(0).cast("bigint").alias("_n"), F.col("_n").alias("_m")))
        return both.groupBy(*on).agg(F.sum("_n").cast("bigint").alias("_n"), F.sum("_m").cast("bigint").alias("_m")).where("_n <> 0")

    def _exact(self, q: Query, k: int, changed: dict[str, DataFrame], batch: int) -> DataFrame:
        """(op, seq, out): every change of one query's results in the batch, at the update that makes it.

        Lives that touch the batch are joined if a tuple of theirs changes in it; `changed` holds, of the
        relations that change, the lives that begin or end in it. A result that has a further derivation,
        which no change concerns, stays as it is all the time.
        """
        atoms, on = _in_order(q), list(q.out)

        def kept(name: str) -> DataFrame:
            state = self._state(f"base/{name}", CELLS, batch).groupBy("cells").agg(F.sum("_n").alias("_n")).where("_n > 0").select("cells")
            held = state.join(changed[name].where(F.col("_start") == BEFORE).select("cells"), "cells", "left_anti") if name in changed else state
            return held.select("cells", F.lit(BEFORE).alias("_start"), F.lit(None).cast("bigint").alias("_end"))

        def lives(i: int, which: str, start: str = "_s", end: str = "_e") -> DataFrame:
            name, width = atoms[i].relation, len(atoms[i].attrs)
            found = changed[name] if which == "changed" else kept(name)
            if which == "all" and name in changed:
                found = found.unionByName(changed[name])
            return atom_rows(lambda _: found.select(*(F.col("cells")[c].alias(f"c{c}") for c in range(width)), "_start", "_end"), atoms[i], start, end)

        terms = []
        for i, atom in enumerate(atoms):
            if atom.relation not in changed:
                continue
            joined, rest = lives(i, "changed", "_start", "_end"), [j for j in range(len(atoms)) if j != i]
            while rest:
                nxt = next(j for j in rest if set(atoms[j].attrs) & set(joined.columns))
                rest.remove(nxt)
                met = natural_join(joined, lives(nxt, "kept" if nxt < i else "all"))
                wanted = {*on, *(a for j in rest for a in atoms[j].attrs)}
                joined = met.select(*(c for c in met.columns if c in wanted), F.greatest("_start", "_s").alias("_start"), F.least("_end", "_e").alias("_end")).where("_end IS NULL OR _start < _end")
            terms.append(joined.select(*on, "_start", "_end"))
        none = self.spark.createDataFrame([], self._schema(k, "_start bigint, _end bigint"))
        found = self._write(reduce(DataFrame.unionByName, terms, none).where("_end IS NULL OR _start < _end"), f"lives/{k}", batch)
        old = found.where(F.col("_start") == BEFORE).groupBy(*on).agg(F.count(F.lit(1)).alias("_old"))
        counts = self._matching(self._state(f"counts/{k}", self._schema(k, "_n bigint"), batch), found, on).groupBy(*on).agg(F.sum("_n").alias("_m"))
        further = counts.join(old, on, "left").where("_m > coalesce(_old, 0)").select(*on)
        own = found.join(further, on, "left_anti")
        many = not _few(found) and all(not found.groupBy(*keys).count().where(F.col("count") > CROWDED).isEmpty() for keys in [*([c] for c in on), on])
        return ends_of(merged(longest(own, q)) if many else merged_at_once(own, on), q).where(F.col("seq") > BEFORE)

    def _outputs(self, k: int) -> str:
        return ", ".join(f"{c} string" for c in self.queries[k].out)

    def _schema(self, k: int, extra: str) -> str:
        return f"{self._outputs(k)}, {extra}"

    def results(self, k: int = 0) -> DataFrame:
        """The current results of query k."""
        upto = self.histories["checked"].batches(self.spark)
        rows = self._state(f"counts/{k}", self._schema(k, "_n bigint"), upto)
        return rows.groupBy(*self.queries[k].out).agg(F.sum("_n").alias("_n")).where("_n > 0").drop("_n")

    def output(self, k: int = 0) -> DataFrame:
        """All output changes of query k so far, by batch."""
        return self.histories[f"output/{k}"].read(self.spark)

    def violations(self) -> DataFrame:
        """All changes so far that a set can't take, by batch."""
        return self.histories["checked"].read(self.spark).where("violation IS NOT NULL")

    def refused(self) -> DataFrame:
        """(rel, cells, op, seq, violation, batch): changes of relations that the queries don't read, or that are queries themselves; they change nothing."""
        return self.histories["refused"].read(self.spark)

    def exact_log(self, k: int = 0) -> DataFrame:
        """(op, seq, output, batch) of query k: every change of its results, at the update that makes it, if the views keep it."""
        return self.histories[f"exact/{k}"].read(self.spark)

    def latencies(self) -> DataFrame:
        """(results, seconds, batch): what each batch of a stream changed in all outputs, and the time from its start until that could be read."""
        return self.histories["latency"].read(self.spark)

    def log(self) -> DataFrame:
        """The formatted lines (line, batch) that start() wrote."""
        return self.spark.read.schema("value string, v int").text(f"{self.root}/log").toDF("line", "batch")

    def _take(self, changes: DataFrame, batch: int) -> None:
        """Applies a batch and writes its output as text lines: sign, query number, values."""
        for k, moved in enumerate(self.apply_all(changes, batch)):
            formatted(moved, k).write.mode("overwrite" if k == 0 else "append").text(f"{self.root}/log/v={batch}")

    def start(self, changes: DataFrame) -> StreamingQuery:
        """Maintains the views from a streaming DataFrame until its source has nothing new."""
        return self._run(changes, self._take)

    def start_text(self, path: str, form: str, registry: up.Registry) -> StreamingQuery:
        """Maintains the views from text files of update lines, until there are no new ones.

        Lines are numbered on from batch to batch, in the order of file names and positions within
        each; those that the registry can't load go to `rejected`.
        """

        def take(lines: DataFrame, batch: int) -> None:
            self.spark = lines.sparkSession
            after = self.spark.read.schema("n bigint").parquet(f"{self.root}/lines/v={batch - 1}").first()[0] if batch else 0
            numbered = up.numbered(lines, up.DECODERS[form], f"{self.root}/decoded", after)
            self._write(numbered.agg((F.count(F.lit(1)) + after).alias("n")), "lines", batch)
            remove(self.spark, f"{self.root}/lines/v={batch - 2}")
            routes = up.routed(numbered, registry)
            wrong = self.rejections(routes.schema)
            wrong.write(routes.where("NOT ok"), batch)
            wrong.folded(self.spark, batch)
            self._take(up.as_changes(routes), batch)

        return self._run(up.placed(self.spark.readStream.text(path)), take)

    def rejections(self, schema: StructType) -> History:
        """The lines that start_text() couldn't load."""
        return History(f"{self.root}/rejected", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), self.fold)

    def _changed(self, spark: SparkSession, batch: int) -> int:
        return spark.read.schema("op string").parquet(*(f"{self.root}/output/{k}/v={batch}" for k in range(len(self.queries)))).count()

    def _run(self, source: DataFrame, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
        return source.writeStream.foreachBatch(timed(take, self._changed, self.histories["latency"])).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()


class View(Views):
    """One query, maintained as Views are."""

    def __init__(self, spark: SparkSession, q: Query, root: str, fold: int = FOLD, exact: bool = False):
        super().__init__(spark, [q], root, fold, exact)

    def apply(self, changes: DataFrame, batch: int) -> DataFrame:
        """Takes one batch into the state and returns the query's net output changes (op, out)."""
        return self.apply_all(changes, batch)[0]
