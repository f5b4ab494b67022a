"""Acyclic queries over a stream of changes, all of their state kept by key in Spark's state store.

Each query's join tree is hung up at an atom, or at a generalized node. A batch goes through a line of
stateful operators, each keyed by what its state is about; a row names the operator and key that it is
meant for, and all other operators pass it on. A key's state is read and written only when a change
of the batch concerns it, so a batch costs what it changes, however large the state is.

A group of an operator costs about as much as some calls of its state store. So keys with nothing but
numbers (Base, States, Offers, Results, Sets) are dealt to buckets, each a group whose state is a map of
leaves of keys and numbers; rows that an operator only passes on come in buckets as well, and what a group says for
the log goes on in packs, which are opened after the line's end. Exists and Join list what is under a
key and have a group for each.

1. Base: keyed by tuple. Base relations are sets: what a set can't take is a violation, the rest the
   tuple's net change.
2. Upward, for each height: Exists, keyed by join key, counts a child's alive tuples and holds the
   parent's tuples; only when the count leaves or reaches zero they are told. Then States, keyed by
   tuple, counts satisfied children: a tuple is alive if all are, else on hold. A generalized node
   (Offers) has no tuples of its own: a key exists while a child offers it, and is alive if all do.
3. Downward, for each depth: Exists again, with the roles turned: it counts the live parents of a key
   and holds the child's alive tuples. Live tuples take part in some result. A change under a key
   without a live parent ends here: this is the witness check, nothing of it is ever joined.
4. Joins, keyed by join key, of live tuples of nodes that output needs, each row as wide as what lies
   above needs, with its number of derivations. Other atoms are existence checks: of them there is
   a count for each key and nothing else.
5. Results, keyed by output row: derivations, and a change where their number leaves or reaches zero.
6. Where all trees hang at the same atom, Sets on demand, keyed by its tuple: the queries in which it is live.

Several queries go through one line, whose operators take the places of all of them at one height or depth.

Inside a batch what appears and vanishes again is netted. What the operators say is written for each
batch; a batch that runs again overwrites its own.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from deltaloom.plans import model
from deltaloom.plans.model import Node, Query, tree
from deltaloom.streaming.runs import FOLD, History, latencies, timed

#: Operators go to the workers with their code: a stream's runners need not have the library on their path.
for _module in (model, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: addr is "operator:place:key", or "out:…"; cells is a JSON list; n a sign, count or number of derivations.
EVENT = "addr string, what string, node int, cells string, n bigint, seq bigint, note string"
_Event = Row("addr", "what", "node", "cells", "n", "seq", "note")
BASE = 0
#: Groups of the keys that have numbers alone, and of the rows that an operator passes on.
BUCKETS = 512
#: Entries of a bucket's state, each the keys of one hash: a batch reads and writes those that it changes.
LEAVES = 32
#: Rows of a pack.
PACK = 500


def _text(values: list | dict) -> str:
    return json.dumps(values, ensure_ascii=False, separators=(",", ":"))


def _needs(out: list[tuple[str, ...]], nodes: list[Node]) -> tuple[list[bool], list[tuple[str, ...]]]:
    """For each node whether output needs rows of it, and the attributes that it hands up if so."""
    below = [set(n.attrs) for n in nodes]
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i].height):
        below[i] = below[i].union(*(below[c] for c in nodes[i].children))
    needed = [n.parent is None or bool(set(out[i]) & below[i] - set(nodes[n.parent].attrs)) for i, n in enumerate(nodes)]
    handed = [out[i] if n.parent is None else tuple(dict.fromkeys([*(a for a in n.attrs if a in nodes[n.parent].attrs), *(a for a in out[i] if a in below[i])])) for i, n in enumerate(nodes)]
    return needed, handed


@dataclass
class Layout:
    """Which operator does what for rooted queries; operators are numbered in the order of the line."""

    queries: list[Query]
    tops: list[int | tuple[str, ...]]
    #: Whether live tuples of every node are wanted, not only of those that output needs.
    every: bool
    #: Whether the queries in which a root's tuple is live are wanted.
    sets: bool
    nodes: list[Node] = field(init=False)
    #: The query of each node.
    of: list[int] = field(init=False)
    needed: list[bool] = field(init=False)
    handed: list[tuple[str, ...]] = field(init=False)
    kinds: list[str] = field(init=False)
    up: dict[int, int] = field(default_factory=dict)
    states: dict[int, int] = field(default_factory=dict)
    down: dict[int, int] = field(default_factory=dict)
    joins: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        nodes, self.of = [], []
        for k, (q, top) in enumerate(zip(self.queries, self.tops, strict=True)):
            at = len(nodes)
            nodes += [replace(n, parent=None if n.parent is None else n.parent + at, children=tuple(c + at for c in n.children)) for n in tree(q, top)]
            self.of += [k] * (len(nodes) - at)
        self.nodes = nodes
        if self.sets and len({n.atom and (n.atom.relation, len(n.attrs)) for n in nodes if n.parent is None}) > 1:
            raise ValueError("query sets are of one relation's tuples: the trees have to hang at its atoms")
        self.needed, self.handed = _needs([self.queries[k].out for k in self.of], nodes)
        self.kinds = ["base"]
        for h in range(1, max(n.height for n in nodes) + 1):
            here = [i for i, n in enumerate(nodes) if n.height == h]
            for kind, own in (("exists", [i for i in here if nodes[i].atom]), ("offers", [i for i in here if not nodes[i].atom]), ("states", [i for i in here if nodes[i].atom])):
                if own:
                    self.kinds.append(kind)
                    at = len(self.kinds) - 1
                    self.up |= {c: at for i in own if kind != "states" for c in nodes[i].children}
                    self.states |= {i: at for i in own if kind == "states"}
        for d in range(1, max(n.depth for n in nodes) + 1):
            own = [i for i, n in enumerate(nodes) if n.depth == d and self.watched(i)]
            if own:
                self.kinds.append("exists_down")
                self.down |= {i: len(self.kinds) - 1 for i in own}
        for i in sorted(range(len(nodes)), key=lambda i: -nodes[i].depth):
            if self.needed[i] and nodes[i].parent is not None:
                self.kinds.append("join")
                self.joins[i] = len(self.kinds) - 1
        self.results = len(self.kinds)
        self.kinds += ["results"] + ["sets"] * self.sets

    def watched(self, i: int) -> bool:
        return self.every or self.needed[i]

    def shared(self, child: int) -> tuple[str, ...]:
        parent = self.nodes[self.nodes[child].parent]
        return tuple(a for a in parent.attrs if a in self.nodes[child].attrs)

    def joined(self, i: int) -> list[int]:
        """The children of a node whose rows it joins, in the order of their operators."""
        return sorted((c for c in self.nodes[i].children if self.needed[c]), key=self.joins.get)

    def left(self, child: int) -> tuple[str, ...]:
        """The columns of the parent's rows where they meet a child's."""
        i = self.nodes[child].parent
        columns = self.nodes[i].attrs
        for c in self.joined(i):
            if c == child:
                return columns
            columns = tuple(dict.fromkeys([*columns, *self.handed[c]]))

    # events

    def out(self, what: str, node: int, values: list, n: int, **more) -> Row:
        return _Event("out", what, node, _text(values), n, more.get("seq"), more.get("note"))

    def to(self, at: int, place: int, key: list, what: str, values: list, n: int, node: int) -> Row:
        return _Event(f"{at}:{place}:{_text(key)}", what, node, _text(values), n, None, None)

    def alive(self, i: int, values: list, n: int) -> Iterator[Row]:
        """What a tuple that becomes alive (n 1) or ceases to be (-1) tells."""
        named, node = dict(zip(self.nodes[i].attrs, values)), self.nodes[i]
        if node.parent is None:
            yield from self.live(i, values, n)
            return
        key = [named[a] for a in self.shared(i)]
        place = node.parent if self.nodes[node.parent].atom is None else i
        yield self.to(self.up[i], place, key, "count", [i], n, i)
        if self.watched(i):
            yield self.to(self.down[i], i, key, "tuple", values, n, i)

    def live(self, i: int, values: list, n: int) -> Iterator[Row]:
        named = dict(zip(self.nodes[i].attrs, values))
        yield self.out("live", i, values, n)
        if self.sets and self.nodes[i].parent is None:
            yield self.to(self.results + 1, 0, values, "member", [self.of[i]], n, i)
        for c in self.nodes[i].children:
            if self.watched(c):
                yield self.to(self.down[c], c, [named[a] for a in self.shared(c)], "count", [c], n, c)
        if self.needed[i]:
            yield from self.row(i, 0, named, n)

    def row(self, i: int, after: int, named: dict, n: int) -> Iterator[Row]:
        """A row of node i that has met the first `after` of the children it joins."""
        rest = self.joined(i)[after:]
        if rest:
            c = rest[0]
            yield self.to(self.joins[c], c, [named[a] for a in self.shared(c)], "left", [named[a] for a in self.left(c)], n, c)
            return
        values = [named[a] for a in self.handed[i]]
        if self.nodes[i].parent is None:
            yield self.to(self.results, i, values, "row", values, n, i)
        else:
            yield self.to(self.joins[i], i, [named[a] for a in self.shared(i)], "right", values, n, i)


def _packed(rows: list[Row]) -> Row:
    cells = _text([list(r[1:]) for r in rows])
    return _Event(f"out:{zlib.crc32(cells.encode())}", "pack", None, cells, None, None, None)


def unpacked(rows: DataFrame) -> DataFrame:
    """What the line says: the rows in its packs, without addr."""
    told = rows.select(F.explode(F.from_json("cells", "array<array<string>>")).alias("_r"))
    fields = [f.split() for f in EVENT.split(", ")[1:]]
    return told.select(*(F.col("_r")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(fields)))


class _Operator(StatefulProcessor):
    """Takes the rows that are meant for operator `at`, passes all others on."""

    #: Whether a group holds a bucket of keys, not one.
    bucketed = False

    def __init__(self, layout: Layout, at: int):
        self.layout, self.at = layout, at

    def group(self, buckets: int) -> Column:
        """The group of a row: where it is for this operator a key or a bucket of them, else a bucket of rows to pass on."""
        addr = F.col("addr")
        bucket = F.pmod(F.xxhash64("addr"), F.lit(buckets)).cast("string")
        return F.when(addr.startswith(f"{self.at}:"), F.concat(F.lit(f"{self.at}:"), bucket) if self.bucketed else addr).otherwise(F.concat(F.lit("-:"), bucket))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0].startswith("-:"):
            yield from rows
            return
        told = []
        for r in self.taken(key[0], rows):
            if r.addr != "out":
                yield r
                continue
            told.append(r)
            if len(told) == PACK:
                yield _packed(told)
                told = []
        if told:
            yield _packed(told)

    def taken(self, addr: str, rows: Iterator[Row]) -> Iterator[Row]:
        _, place, values = addr.split(":", 2)
        yield from self.take(place, values, rows)

    def close(self) -> None:
        pass

    def number(self, name: str):
        return self.handle.getValueState(name, "n bigint")

    def rows(self, name: str):
        return self.handle.getMapState(name, "cells string", "n bigint")


def _read(value) -> int:
    found = value.get()
    return found[0] if found else 0


def _write(value, n: int) -> None:
    if n:
        value.update((n,))
    else:
        value.clear()


def _change(rows, nets: Counter) -> None:
    """Adds the numbers to those of a map; what comes to zero goes."""
    for cells, n in nets.items():
        if n:
            held = rows.getValue((cells,))
            total = n + (held[0] if held else 0)
            if total:
                rows.updateValue((cells,), (total,))
            elif held:
                rows.removeKey((cells,))


class _Numbers(_Operator):
    """Keys with `width` numbers each, a bucket's in LEAVES entries; a key whose numbers are all zero is not kept."""

    bucketed = True

    def open(self) -> None:
        self.held = self.handle.getMapState("held", "leaf string", "numbers string")

    def width(self, place: str) -> int:
        return 1

    def taken(self, addr: str, rows: Iterator[Row]) -> Iterator[Row]:
        leaves: dict[str, dict[str, list[Row]]] = {}
        for r in rows:
            key = r.addr.partition(":")[2]
            leaves.setdefault(str(zlib.crc32(key.encode()) % LEAVES), {}).setdefault(key, []).append(r)
        for leaf, keys in leaves.items():
            found = self.held.getValue((leaf,))
            was = json.loads(found[0]) if found else {}
            now = dict(was)
            for key, own in keys.items():
                place, _, values = key.partition(":")
                before = was.get(key) or [0] * self.width(place)
                now[key] = after = self.added(place, own, before)
                if not any(after):
                    del now[key]
                yield from self.take(place, json.loads(values), own, before, after)
            if now and now != was:
                self.held.updateValue((leaf,), (_text(now),))
            elif found and not now:
                self.held.removeKey((leaf,))

    def added(self, place: str, rows: list[Row], before: list[int]) -> list[int]:
        """The numbers after the rows."""
        raise NotImplementedError


class Base(_Numbers):
    def added(self, place: str, rows: list[Row], before: list[int]) -> list[int]:
        rows.sort(key=lambda r: (r.seq, r.n))
        return [int(rows[-1].n > 0)]

    def take(self, place: str, values: list, rows: list[Row], before: list[int], after: list[int]) -> Iterator[Row]:
        live = bool(before[0])
        for r in rows:
            if live == (r.n > 0):
                yield self.layout.out("violation", -1, values, r.n, seq=r.seq, note=f"{place}:{'duplicate_insert' if live else 'missing_delete'}")
            live = r.n > 0
        if before == after:
            return
        n = 1 if live else -1
        for i, node in enumerate(self.layout.nodes):
            if node.atom is None or node.atom.relation != place or len(node.atom.attrs) != len(values):
                continue
            named = dict(zip(node.atom.attrs, values))
            if any(named[a] != v or v is None and node.atom.attrs.count(a) > 1 for a, v in zip(node.atom.attrs, values)):
                continue
            own = [named[a] for a in node.attrs]
            if not node.children:
                yield self.layout.out("state", i, own, n, note="0")
                yield from self.layout.alive(i, own, n)
                continue
            yield self.layout.to(self.layout.states[i], i, own, "base", own, n, i)
            for c in node.children:
                yield self.layout.to(self.layout.up[c], c, [named[a] for a in self.layout.shared(c)], "tuple", own, n, i)


class Exists(_Operator):
    """Tuples of one side, told when the other side's count under their key leaves or reaches zero. A key with a null matches nothing."""

    def __init__(self, layout: Layout, at: int, down: bool):
        super().__init__(layout, at)
        self.down = down

    def open(self) -> None:
        self.count, self.tuples = self.number("count"), self.rows("tuples")

    def tell(self, edge: int, values: list, n: int) -> Iterator[Row]:
        if self.down:
            yield from self.layout.live(edge, values, n)
        else:
            parent = self.layout.nodes[edge].parent
            yield self.layout.to(self.layout.states[parent], parent, values, "satisfied", values, n, parent)

    def take(self, place: str, key: str, rows: Iterator[Row]) -> Iterator[Row]:
        edge, delta, nets = int(place), 0, Counter()
        for r in rows:
            if r.what == "count":
                delta += r.n
            else:
                nets[r.cells] += r.n
        if None in json.loads(key):
            return
        held = _read(self.count)
        was, now = held > 0, held + delta > 0
        if delta:
            _write(self.count, held + delta)
        for cells, n in nets.items():
            if n < 0:
                self.tuples.removeKey((cells,))
                if was:
                    yield from self.tell(edge, json.loads(cells), -1)
        if was != now:
            for (cells,) in self.tuples.keys():
                yield from self.tell(edge, json.loads(cells), 1 if now else -1)
        for cells, n in nets.items():
            if n > 0:
                self.tuples.updateValue((cells,), (1,))
                if now:
                    yield from self.tell(edge, json.loads(cells), 1)


class States(_Numbers):
    """Whether a tuple is there, and how many of its children are satisfied."""

    def width(self, place: str) -> int:
        return 2

    def added(self, place: str, rows: list[Row], before: list[int]) -> list[int]:
        base = sum(r.n for r in rows if r.what == "base")
        return [before[0] + base, before[1] + sum(r.n for r in rows) - base]

    def take(self, place: str, values: list, rows: list[Row], before: list[int], after: list[int]) -> Iterator[Row]:
        i = int(place)
        if before == after:
            return
        for (there, n), sign in ((before, -1), (after, 1)):
            if there:
                yield self.layout.out("state", i, values, sign, note=str(n))
        full = [1, len(self.layout.nodes[i].children)]
        if (before == full) != (after == full):
            yield from self.layout.alive(i, values, 1 if after == full else -1)


class Offers(_Numbers):
    """Keys of a generalized node: by how many tuples each child offers them. A key with a null matches nothing."""

    def width(self, place: str) -> int:
        return len(self.layout.nodes[int(place)].children)

    def added(self, place: str, rows: list[Row], before: list[int]) -> list[int]:
        after, children = list(before), self.layout.nodes[int(place)].children
        for r in rows:
            after[children.index(r.node)] += r.n
        return after

    def take(self, place: str, values: list, rows: list[Row], before: list[int], after: list[int]) -> Iterator[Row]:
        i = int(place)
        was, now = (sum(map(bool, numbers)) for numbers in (before, after))
        if None in values or was == now:
            return
        for n, sign in ((was, -1), (now, 1)):
            if n:
                yield self.layout.out("state", i, values, sign, note=str(n))
        full = len(self.layout.nodes[i].children)
        if (was == full) != (now == full):
            yield from self.layout.alive(i, values, 1 if now == full else -1)


class Join(_Operator):
    def open(self) -> None:
        self.left, self.right = self.rows("left"), self.rows("right")

    def take(self, place: str, key: str, rows: Iterator[Row]) -> Iterator[Row]:
        child, nets = int(place), {"left": Counter(), "right": Counter()}
        for r in rows:
            nets[r.what][r.cells] += r.n
        yield from self.met(child, nets["left"], self.right, turned=False)
        _change(self.left, nets["left"])
        yield from self.met(child, nets["right"], self.left, turned=True)
        _change(self.right, nets["right"])

    def met(self, child: int, nets: Counter, other, turned: bool) -> Iterator[Row]:
        """Rows of changed ones of one side with those that the other holds, read once."""
        changed = [(json.loads(cells), n) for cells, n in nets.items() if n]
        if not changed:
            return
        layout, parent = self.layout, self.layout.nodes[child].parent
        after = layout.joined(parent).index(child) + 1
        for (cells,), (m,) in other.iterator():
            values = json.loads(cells)
            for own, n in changed:
                left, right = (values, own) if turned else (own, values)
                yield from layout.row(parent, after, dict(zip(layout.left(child), left)) | dict(zip(layout.handed[child], right)), n * m)


class Results(_Numbers):
    def added(self, place: str, rows: list[Row], before: list[int]) -> list[int]:
        return [before[0] + sum(r.n for r in rows)]

    def take(self, place: str, values: list, rows: list[Row], before: list[int], after: list[int]) -> Iterator[Row]:
        if (before[0] > 0) != (after[0] > 0):
            yield self.layout.out("result", self.layout.of[int(place)], values, 1 if after[0] > 0 else -1)


class Sets(_Numbers):
    """The queries in which a tuple is live; what changes of them is said once a batch."""

    def width(self, place: str) -> int:
        return len(self.layout.queries)

    def added(self, place: str, rows: list[Row], before: list[int]) -> list[int]:
        after = list(before)
        for r in rows:
            after[self.layout.of[r.node]] += r.n
        return after

    def take(self, place: str, values: list, rows: list[Row], before: list[int], after: list[int]) -> Iterator[Row]:
        if before != after:
            for found, sign in ((before, -1), (after, 1)):
                if any(found):
                    yield self.layout.out("set", -1, values, sign, note=",".join(str(k) for k, n in enumerate(found) if n))


KINDS = {
    "base": Base,
    "exists": lambda layout, at: Exists(layout, at, False),
    "exists_down": lambda layout, at: Exists(layout, at, True),
    "states": States,
    "offers": Offers,
    "join": Join,
    "results": Results,
    "sets": Sets,
}


def _most_output(q: Query) -> int:
    return max(range(len(q.atoms)), key=lambda i: len(set(q.atoms[i].attrs) & set(q.out)))


class KeyedViews:
    """Acyclic queries, maintained in `root` from changes (rel, cells array<string>, op, seq).

    Nodes are numbered query by query: a query's atoms in order, then its generalized node if it has one.
    """

    def __init__(self, spark: SparkSession, queries: list[Query], root: str, tops: list[int | tuple[str, ...] | None] | None = None, every: bool = False, sets: bool = False, fold: int = FOLD, buckets: int = BUCKETS):
        """`tops` are the atoms, or the attributes of the generalized nodes, that the trees hang at: by default the atom with most of the output. A root keeps its number of `buckets`."""
        tops = [_most_output(q) if top is None else top for q, top in zip(queries, tops or [None] * len(queries), strict=True)]
        self.spark, self.queries, self.root, self.buckets = spark, queries, root, buckets
        self.layout = Layout(queries, tops, every, sets)
        self.said = History(f"{root}/events", EVENT.replace("addr string, ", ""), fold)
        self.latency = latencies(root, fold)

    def events(self, changes: DataFrame) -> DataFrame:
        """The line of operators over a streaming DataFrame of changes; rows of relations that the queries lack are left out."""
        bases = sorted({a.relation for q in self.queries for a in q.atoms})
        sign = F.when(F.col("op") == "+", 1).otherwise(-1).cast("bigint")
        cells = F.to_json("cells", {"ignoreNullFields": "false"})
        rows = changes.where(F.col("rel").isin(bases)).select(F.concat(F.lit(f"{BASE}:"), "rel", F.lit(":"), cells).alias("addr"), F.lit("change").alias("what"), F.lit(-1).alias("node"), cells.alias("cells"), sign.alias("n"), F.col("seq").cast("bigint").alias("seq"), F.lit(None).cast("string").alias("note"))
        for at, kind in enumerate(self.layout.kinds):
            operator = KINDS[kind](self.layout, at)
            rows = rows.withColumn("group", operator.group(self.buckets)).groupBy("group").transformWithState(operator, EVENT, "Append", "None")
        return rows

    def start(self, changes: DataFrame) -> StreamingQuery:
        """Maintains the queries until its source has nothing new; a later start goes on from there.

        Each operator has a task and a store for each partition of its state, which cost half a second a
        batch even without a change: at first start there are no more of them than cores.
        """

        def take(rows: DataFrame, batch: int) -> None:
            self.said.write(unpacked(rows), batch)
            self.said.folded(rows.sparkSession, batch)

        conf, parts = self.spark.conf, "spark.sql.shuffle.partitions"
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        before = conf.get(parts)
        conf.set(parts, min(int(before), self.spark.sparkContext.defaultParallelism))
        try:
            return self.events(changes).writeStream.outputMode("append").foreachBatch(timed(take, self._changed, self.latency)).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        finally:
            conf.set(parts, before)

    def _changed(self, spark: SparkSession, batch: int) -> int:
        return spark.read.schema("what string").parquet(self.said.at(batch)).where("what = 'result'").count()

    def _said(self, what: str, upto: int | None = None) -> DataFrame:
        found = self.said.read(self.spark)
        if upto is not None:
            found = found.where(F.col("batch") <= upto)
        return found.where(F.col("what") == what).withColumn("_values", F.from_json("cells", "array<string>"))

    def _columns(self, names: tuple[str, ...]) -> list:
        return [F.col("_values")[k].alias(a) for k, a in enumerate(names)]

    def _op(self):
        return F.when(F.col("n") > 0, "+").otherwise("-").alias("op")

    def states(self, node: int, upto: int | None = None) -> DataFrame:
        """After batch `upto`, or the last, the node's tuples with n_satisfied, the number of children that have their key (of a generalized node: that offer them), and alive if all do."""
        n = F.col("note").cast("int").alias("n_satisfied")
        names = self.layout.nodes[node].attrs
        held = self._said("state", upto).where(F.col("node") == node).groupBy("_values", n).agg(F.sum("n").alias("_n")).where("_n > 0")
        return held.select(*self._columns(names), "n_satisfied", (F.col("n_satisfied") == len(self.layout.nodes[node].children)).alias("alive"))

    def state_changes(self, node: int) -> DataFrame:
        """(op, attributes, n_satisfied, batch): what states() lost and won in each batch."""
        return self._said("state").where(F.col("node") == node).select(self._op(), *self._columns(self.layout.nodes[node].attrs), F.col("note").cast("int").alias("n_satisfied"), "batch")

    def live(self, node: int, upto: int | None = None) -> DataFrame:
        """The node's tuples that take part in a result."""
        held = self._said("live", upto).where(F.col("node") == node).groupBy("_values").agg(F.sum("n").alias("_n")).where("_n > 0")
        return held.select(*self._columns(self.layout.nodes[node].attrs))

    def output(self, k: int = 0) -> DataFrame:
        """(op, output, batch): all changes of the results of query k so far."""
        return self._said("result").where(F.col("node") == k).select(self._op(), *self._columns(self.queries[k].out), "batch")

    def results(self, k: int = 0, upto: int | None = None) -> DataFrame:
        held = self._said("result", upto).where(F.col("node") == k).groupBy("_values").agg(F.sum("n").alias("_n")).where("_n > 0")
        return held.select(*self._columns(self.queries[k].out))

    def query_sets(self, upto: int | None = None) -> DataFrame:
        """The tuples of the atom that all trees hang at, with the list of queries in which each is live."""
        held = self._said("set", upto).groupBy("_values", "note").agg(F.sum("n").alias("_n")).where("_n > 0")
        root = next(n for n in self.layout.nodes if n.parent is None)
        return held.select(*self._columns(root.attrs), F.col("note").alias("qids"))

    def violations(self) -> DataFrame:
        """(rel, cells, op, seq, violation, batch): changes that a set can't take."""
        note = F.split("note", ":")
        return self._said("violation").select(note[0].alias("rel"), F.col("_values").alias("cells"), self._op(), "seq", note[1].alias("violation"), "batch")

    def traffic(self) -> DataFrame:
        """(batch, what, rows): how much each batch said, by kind."""
        return self.said.read(self.spark).groupBy("batch", "what").agg(F.count(F.lit(1)).alias("rows"))

    def latencies(self) -> DataFrame:
        """(results, seconds, batch): what each batch changed in all results, and the time from its start until that could be read."""
        return self.latency.read(self.spark)


class KeyedView(KeyedViews):
    """One query, maintained as KeyedViews are."""

    def __init__(self, spark: SparkSession, q: Query, root: str, top: int | tuple[str, ...] | None = None, every: bool = False, fold: int = FOLD):
        super().__init__(spark, [q], root, [top], every, fold=fold)


def latency(query: StreamingQuery) -> list[tuple[int, int, float]]:
    """(batch, rows read, seconds) of the batches that a query has run lately, from its progress reports."""
    return [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000) for p in query.recentProgress if p["numInputRows"]]


def state_reads(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, bytes): what the state stores of a query's lately run batches have read."""
    return [(p["batchId"], sum(o["customMetrics"].get("rocksdbTotalBytesRead", 0) for o in p["stateOperators"])) for p in query.recentProgress if p["numInputRows"]]
