"""The node states, live tuples and results of keyed views, maintained a whole level of the join tree at a time.

What is maintained is what `keyed` has: each query's tree hung up at an atom or at a generalized node, tuples
alive or on hold by how many of their children are satisfied, live ones by a witness check downward, results
by counting joined live tuples of the nodes that output needs, and query sets. But a level of a batch is a few
joins and aggregations of columns, with signed rows in folders as state, as Views keep them. So a batch costs
a read of the state, and then about what it changes; a batch of very many changes costs no calls of a state
store or of Python. A stream of small batches over a large state is what `keyed` is for.

A level's changes are few or many. Of few, all that they may concern is found by sending them to the state:
tuples that change, and tuples under keys whose counts leave or reach zero. With many, the state is brought
together with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.plans.model import Atom, Query
from deltaloom.streaming.keyed import Layout, _most_output
from deltaloom.streaming.microbatch import CELLS, Views, _few
from deltaloom.streaming.runs import FOLD, History

#: Another side that tuples meet: the attributes of the key, those of its own tuples, these before a batch, and how they change.
Side = tuple[tuple[str, ...], tuple[str, ...], DataFrame, DataFrame]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def _status(old: DataFrame, delta: DataFrame, keys: list[str], was: str, now: str) -> DataFrame:
    """Keys of signed rows with whether there were any before a change, and are after it; those with neither are left out."""
    both = old.select(*keys, F.col("_n").alias("_o"), F.lit(0).cast("bigint").alias("_d")).unionByName(delta.select(*keys, F.lit(0).cast("bigint").alias("_o"), F.col("_n").alias("_d")))
    sums = both.groupBy(*keys).agg(F.sum("_o").alias("_o"), F.sum("_d").alias("_d"))
    return sums.select(*keys, (F.col("_o") > 0).alias(was), (F.col("_o") + F.col("_d") > 0).alias(now)).where(F.col(was) | F.col(now))


def _keyed(rows: DataFrame, names: tuple[str, ...], on: tuple[str, ...], s: int) -> DataFrame:
    """The rows' keys as columns of side s, with _n; a key with a null matches nothing."""
    keys = [F.col("cells")[names.index(a)].alias(f"_{s}_{j}") for j, a in enumerate(on)]
    found = rows.select(*keys, "_n")
    return found.where(~_any([F.isnull(c) for c in found.columns[:-1]]))


def _with_keys(rows: DataFrame, names: tuple[str, ...], sides: list[Side]) -> DataFrame:
    return rows.select("*", *(F.col("cells")[names.index(a)].alias(f"_{s}_{j}") for s, (on, *_) in enumerate(sides) for j, a in enumerate(on)))


def met(names: tuple[str, ...], old: DataFrame, delta: DataFrame, sides: list[Side]) -> DataFrame:
    """(cells, _was, _now, and for each side _was0, _now0, …): tuples that a change may concern, whether they are there before and after it, and whether a side has their key."""
    keys = [[f"_{s}_{j}" for j in range(len(on))] for s, (on, *_) in enumerate(sides)]
    others = [(_keyed(held, own, on, s), _keyed(change, own, on, s)) for s, (on, own, held, change) in enumerate(sides)]
    few = all(_few(rows) for rows in [delta, *(change for *_, change in sides)])
    near = old
    if few:
        near = _with_keys(old, names, sides).join(F.broadcast(delta.select("cells").distinct().withColumn("_t", F.lit(True))), "cells", "left")
        for s, (held, change) in enumerate(others):
            of = held.join(F.broadcast(change.select(*keys[s]).distinct()), keys[s], "left_semi")
            flips = _status(of, change, keys[s], "_was", "_now").where("_was <> _now").select(*keys[s], F.lit(True).alias(f"_t{s}"))
            near = near.join(F.broadcast(flips), keys[s], "left")
        near = near.where(_any([F.col(c).isNotNull() for c in ["_t", *(f"_t{s}" for s in range(len(sides)))]])).select("cells", "_n")
    found = _with_keys(_status(near, delta, ["cells"], "_was", "_now"), names, sides)
    for s, (held, change) in enumerate(others):
        found = found.join(_status(held, change, keys[s], f"_was{s}", f"_now{s}"), keys[s], "left")
    flags = [f"_{w}{s}" for s in range(len(sides)) for w in ("was", "now")]
    return found.select("cells", "_was", "_now", *(F.coalesce(f, F.lit(False)).alias(f) for f in flags))


def _held(flags: list[str]) -> Column:
    return reduce(lambda x, y: x + y, (F.col(f).cast("int") for f in flags), F.lit(0))


class LevelViews(Views):
    """Acyclic queries, maintained in `root` from changes (rel, cells array<string>, op, seq), with the states of their nodes.

    Nodes are numbered query by query: a query's atoms in order, then its generalized node if it has one.
    """

    def __init__(self, spark: SparkSession, queries: list[Query], root: str, tops: list[int | tuple[str, ...] | None] | None = None, every: bool = False, sets: bool = False, leaves: bool = False, fold: int = FOLD):
        """`tops`, `every` and `sets` are those of KeyedViews. With `leaves` there are states() of nodes without children as well."""
        super().__init__(spark, queries, root, fold)
        if self.shared:
            raise ValueError(f"no query can use another one: {sorted(self.shared)}")
        tops = [_most_output(q) if top is None else top for q, top in zip(queries, tops or [None] * len(queries), strict=True)]
        self.layout = Layout(queries, tops, every, sets)
        nodes = self.layout.nodes
        #: Nodes with a state of their own: what is alive of others is their relation.
        self.inner = [i for i, n in enumerate(nodes) if n.children or n.parent is None]
        self.watched = [i for i, n in enumerate(nodes) if n.parent is not None and self.layout.watched(i)]
        self.leaves = leaves
        for i in range(len(nodes)) if leaves else self.inner:
            self.histories[f"state/{i}"] = History(f"{root}/state/{i}", "cells array<string>, n int, m int", fold)
        for i in self.watched:
            self.histories[f"live/{i}"] = History(f"{root}/live/{i}", CELLS, fold)
        if sets:
            self.histories["sets"] = History(f"{root}/sets", ", ".join(["cells array<string>", *(f"q{k} bigint" for k in range(len(queries)))]), fold)

    def apply_all(self, changes: DataFrame, batch: int) -> list[DataFrame]:
        """Takes one batch into the state and returns each query's net output changes (op, out)."""
        self.spark = changes.sparkSession
        _, nets = self._taken(changes, batch)
        layout, nodes = self.layout, self.layout.nodes
        alive = self._upward(nets, batch)
        live = {i: alive[i] for i, n in enumerate(nodes) if n.parent is None}
        for i in sorted(self.watched, key=lambda i: nodes[i].depth):
            live[i] = self._downward(i, alive[i], live[nodes[i].parent], batch)
        if layout.sets:
            self._members([live[i] for i, n in enumerate(nodes) if n.parent is None], batch)
        out = []
        for k, q in enumerate(self.queries):
            own = [i for i in range(len(nodes)) if layout.of[i] == k and layout.needed[i]]
            names = {i: f"{'alive' if nodes[i].parent is None else 'live'}/{i}" for i in own}
            changed = {names[i]: live[i][1] for i in own}
            moving = {name: n for name, rows in changed.items() if (n := rows.count())}
            out.append(self._output(Query(q.name, tuple(Atom(names[i], nodes[i].attrs) for i in own), q.out), k, changed, moving, batch))
        states = [*self.bases, *(f"alive/{i}" for i in self.inner), *(f"live/{i}" for i in self.watched)]
        self._folded(states, batch)
        return out

    def _take(self, changes: DataFrame, batch: int) -> None:
        self.apply_all(changes, batch)

    def _own(self, i: int, rows: DataFrame) -> DataFrame:
        """Signed rows of a node's relation as its tuples; a repeated attribute keeps equal cells only."""
        node = self.layout.nodes[i]
        place = [node.atom.attrs.index(a) for a in node.atom.attrs]
        rows = rows.where(F.size("cells") == len(place))
        for k, first in enumerate(place):
            if first != k:
                rows = rows.where(F.col("cells")[first] == F.col("cells")[k])
        return rows if len(node.attrs) == len(place) else rows.select(F.array(*(F.col("cells")[node.atom.attrs.index(a)] for a in node.attrs)).alias("cells"), "_n")

    def _before(self, name: str, batch: int) -> DataFrame:
        return self._state(f"base/{name}", CELLS, batch)

    def _upward(self, nets: dict[str, DataFrame], batch: int) -> dict[int, tuple[DataFrame, DataFrame]]:
        """For each node its alive tuples before the batch and how they change."""
        layout, nodes, alive = self.layout, self.layout.nodes, {}
        for i in sorted(range(len(nodes)), key=lambda i: nodes[i].height):
            node = nodes[i]
            if node.atom:
                old, delta = self._own(i, self._before(node.atom.relation, batch)), self._own(i, nets[node.atom.relation])
            if i not in self.inner:
                alive[i] = old, delta
                if self.leaves:
                    there, none = F.lit(0), F.lit(None).cast("int")
                    self.histories[f"state/{i}"].write(delta.select("cells", F.when(F.col("_n") < 0, there).otherwise(none).alias("n"), F.when(F.col("_n") > 0, there).otherwise(none).alias("m")), batch)
                continue
            found = met(node.attrs, old, delta, [(layout.shared(c), nodes[c].attrs, *alive[c]) for c in node.children]) if node.atom else self._offered(i, [alive[c] for c in node.children])
            n = {w: F.when(F.col(f"_{w}"), _held([f"_{w}{s}" for s in range(len(node.children))])) for w in ("was", "now")}
            rows = found.select("cells", n["was"].alias("n"), n["now"].alias("m")).where("NOT (n <=> m)")
            told = self.histories[f"state/{i}"].write(rows, batch)
            full = [F.coalesce(F.col(c) == len(node.children), F.lit(False)).cast("int") for c in ("n", "m")]
            signed = told.select("cells", (full[1] - full[0]).cast("bigint").alias("_n")).where("_n <> 0")
            alive[i] = self._before(f"alive/{i}", batch), self._write(signed, f"base/alive/{i}", batch)
        return alive

    def _offered(self, i: int, children: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        """met() for a generalized node, whose keys are there while a child offers them."""
        layout, node = self.layout, self.layout.nodes[i]
        keys, parts = [f"_0_{j}" for j in range(len(node.attrs))], []
        rows = [tuple(_keyed(r, layout.nodes[c].attrs, node.attrs, 0) for r in pair) for c, pair in zip(node.children, children)]
        few = all(_few(change) for _, change in rows)
        for s, (held, change) in enumerate(rows):
            if few:
                touched = reduce(DataFrame.unionByName, (d.select(*keys) for _, d in rows)).distinct()
                held = held.join(F.broadcast(touched), keys, "left_semi")
            flags = [(F.col(c) if t == s else F.lit(False)).alias(f"{c}{t}") for t in range(len(rows)) for c in ("_was", "_now")]
            parts.append(_status(held, change, keys, "_was", "_now").select(*keys, *flags))
        flags = [f"_{w}{s}" for w in ("was", "now") for s in range(len(rows))]
        both = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*(F.bool_or(f).alias(f) for f in flags))
        was, now = (_any([F.col(f"_{w}{s}") for s in range(len(rows))]) for w in ("was", "now"))
        return both.select(F.array(*keys).alias("cells"), was.alias("_was"), now.alias("_now"), *flags)

    def _downward(self, i: int, own: tuple[DataFrame, DataFrame], above: tuple[DataFrame, DataFrame], batch: int) -> tuple[DataFrame, DataFrame]:
        """A node's live tuples, those alive whose key a live tuple above has, before the batch and how they change."""
        layout, nodes = self.layout, self.layout.nodes
        found = met(nodes[i].attrs, *own, [(layout.shared(i), nodes[nodes[i].parent].attrs, *above)])
        was, now = (F.col(f"_{w}") & F.col(f"_{w}0") for w in ("was", "now"))
        signed = found.select("cells", (now.cast("int") - was.cast("int")).cast("bigint").alias("_n")).where("_n <> 0")
        delta = self._write(signed, f"base/live/{i}", batch)
        self.histories[f"live/{i}"].write(delta, batch)
        return self._before(f"live/{i}", batch), delta

    def _members(self, roots: list[tuple[DataFrame, DataFrame]], batch: int) -> None:
        """Writes, for each tuple that a batch adds to or takes from queries, the sign by query."""
        each = reduce(DataFrame.unionByName, (delta.withColumn("_k", F.lit(k)) for k, (_, delta) in enumerate(roots)))
        sums = [F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_n"))), F.lit(0)).alias(f"q{k}") for k in range(len(roots))]
        self.histories["sets"].write(each.groupBy("cells").agg(*sums), batch)

    # what is read

    def _last(self) -> int:
        return self.histories["checked"].batches(self.spark) - 1

    def _after(self, rows: DataFrame, batches: list[int]) -> DataFrame:
        """The rows that hold after each of the batches: a tuple's last ones so far; `batch` is that batch."""
        nxt = F.lead("batch").over(Window.partitionBy("cells").orderBy("batch"))
        asked = F.array(*(F.lit(b) for b in batches)).cast("array<int>")
        there = F.filter(asked, lambda b: (b >= F.col("batch")) & (F.isnull("_next") | (b < F.col("_next"))))
        return rows.withColumn("_next", nxt).withColumn("batch", F.explode(there)).drop("_next")

    def _columns(self, i: int) -> list[Column]:
        return [F.col("cells")[k].alias(a) for k, a in enumerate(self.layout.nodes[i].attrs)]

    def states_after(self, node: int, batches: list[int]) -> DataFrame:
        """After each of the batches, the node's tuples with n_satisfied, the number of children that have their key (of a generalized node: that offer them), and alive if all do."""
        held = self._after(self.histories[f"state/{node}"].read(self.spark), batches).where("m IS NOT NULL")
        return held.select(*self._columns(node), F.col("m").alias("n_satisfied"), (F.col("m") == len(self.layout.nodes[node].children)).alias("alive"), "batch")

    def states(self, node: int, upto: int | None = None) -> DataFrame:
        """The same after batch `upto`, or the last."""
        return self.states_after(node, [self._last() if upto is None else upto]).drop("batch")

    def live_after(self, node: int, batches: list[int]) -> DataFrame:
        """After each of the batches, the node's tuples that take part in a result."""
        if self.layout.nodes[node].parent is None:
            return self.states_after(node, batches).where("alive").drop("n_satisfied", "alive")
        held = self._after(self.histories[f"live/{node}"].read(self.spark), batches).where("_n > 0")
        return held.select(*self._columns(node), "batch")

    def live(self, node: int, upto: int | None = None) -> DataFrame:
        """The same after batch `upto`, or the last."""
        return self.live_after(node, [self._last() if upto is None else upto]).drop("batch")

    def query_sets_after(self, batches: list[int]) -> DataFrame:
        """After each of the batches, the tuples of the atom that all trees hang at, with the list of queries in which each is live."""
        line = Window.partitionBy("cells").orderBy("batch")
        own = F.array_compact(F.array(*(F.when(F.sum(f"q{k}").over(line) > 0, F.lit(str(k))) for k in range(len(self.queries)))))
        held = self._after(self.histories["sets"].read(self.spark).select("cells", "batch", own.alias("_own")), batches).where("size(_own) > 0")
        root = next(i for i, n in enumerate(self.layout.nodes) if n.parent is None)
        return held.select(*self._columns(root), F.array_join("_own", ",").alias("qids"), "batch")

    def query_sets(self, upto: int | None = None) -> DataFrame:
        """The same after batch `upto`, or the last."""
        return self.query_sets_after([self._last() if upto is None else upto]).drop("batch")
