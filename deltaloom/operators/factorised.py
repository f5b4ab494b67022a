"""Answers kept factorised: each node's rows under their key as arrays, siblings side by side.

The join of a parent with two children under one key has as many rows as the product of the
siblings; its factorised form holds each sibling once. It is counted by sums and products of array
sizes, and expanded only where rows are asked for: all of them, or one page in a fixed order.

Siblings of one key are arrays of at most CHUNK elements: a longer list is dealt to several arrays by
a hash, and the parent's row has one row for each combination of them. So no key's rows meet in one
task or one row, and every expanded row comes from exactly one factorised row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.operators.snapshot import Tables, atom_rows
from deltaloom.plans.model import Node, Query, tree
from deltaloom.sources.tables import written

#: Elements of an array of siblings.
CHUNK = 1024


@dataclass
class Factorised:
    """`rows` has the root's columns and, for each child, an array of structs: its further columns and its own children's arrays."""

    q: Query
    nodes: list[Node]
    root: int
    rows: DataFrame
    tables: Tables
    chunk: int

    def _own(self, i: int) -> list[str]:
        """The columns that node i adds to its parent's."""
        parent = self.nodes[i].parent
        return [a for a in self.nodes[i].attrs if parent is None or a not in self.nodes[parent].attrs]

    def _size(self, i: int, at: Column | None = None) -> Column:
        """The number of expanded rows behind one element of node i."""
        sizes = []
        for c in self.nodes[i].children:
            array = F.col(f"_{c}") if at is None else at[f"_{c}"]
            if self.nodes[c].children:
                sizes.append(self._sum(c, array))
            else:
                sizes.append(F.size(array).cast("bigint"))
        return reduce(lambda x, y: x * y, sizes, F.lit(1).cast("bigint"))

    def _sum(self, c: int, array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda total, x: total + self._size(c, x))

    def count(self) -> DataFrame:
        """The number of answers (n), without expanding any."""
        return self.rows.agg(F.coalesce(F.sum(self._size(self.root)), F.lit(0)).cast("bigint").alias("n"))

    def _expand(self, rows: DataFrame) -> DataFrame:
        left = [*self.nodes[self.root].children]
        while left:
            c = left.pop()
            rows = rows.select("*", F.explode(f"_{c}").alias("_x")).drop(f"_{c}").select("*", "_x.*").drop("_x")
            left += self.nodes[c].children
        return rows

    def expanded(self) -> DataFrame:
        """All answers."""
        return self._expand(self.rows).select(*self.q.out)

    def _sizes(self) -> DataFrame:
        """The root's rows with the number of answers behind each (_n), without gathering any."""
        counts: dict[int, DataFrame] = {}
        for i in sorted(range(len(self.nodes)), key=lambda i: self.nodes[i].height):
            node, n = self.nodes[i], F.lit(1).cast("bigint")
            rows = atom_rows(self.tables, self.q.atoms[i]).select(*node.attrs)
            for c in node.children:
                rows = rows.join(counts[c].withColumnRenamed("_n", f"_n{c}"), [a for a in node.attrs if a in self.nodes[c].attrs])
                n = n * F.col(f"_n{c}")
            rows = rows.select(*node.attrs, n.alias("_n"))
            if node.parent is None:
                return rows
            counts[i] = rows.groupBy(*(a for a in node.attrs if a in self.nodes[node.parent].attrs)).agg(F.sum("_n").alias("_n"))
        raise AssertionError("a tree has a root")

    def _below(self, roots: DataFrame) -> list[DataFrame]:
        """Each node's rows that lie below some of the root's rows, which are few."""
        found = {self.root: roots}
        for i in sorted(range(len(self.nodes)), key=lambda i: self.nodes[i].depth):
            node = self.nodes[i]
            if node.parent is not None:
                key = [a for a in node.attrs if a in self.nodes[node.parent].attrs]
                keys = found[node.parent].select(*key).distinct()
                rows = atom_rows(self.tables, self.q.atoms[i]).select(*node.attrs)
                found[i] = rows.join(F.broadcast(keys) if node.depth == 1 else keys, key, "left_semi")
        return [found[i] for i in range(len(self.nodes))]

    def page(self, start: int, size: int) -> DataFrame:
        """The answers with ranks start to start + size - 1, from 0, in the order of the root's columns, then of the others; with `rank`.

        Root rows get the number of answers behind each, by counts alone, once. Those are summed up by
        range partitions, of which the driver gets one number each; only what lies below root rows that
        the page touches, at most one for each of its ranks, is factorised and expanded.
        """
        roots, others = list(self.nodes[self.root].attrs), [a for a in self.q.out if a not in self.nodes[self.root].attrs]
        sizes = written(self._sizes(), "factorised-counts")
        ranged = written(sizes.repartitionByRange(*roots).withColumn("_part", F.spark_partition_id()), "factorised-sizes")
        before, wanted = 0, []
        for r in sorted(ranged.groupBy("_part").agg(F.sum("_n").alias("n")).collect(), key=lambda r: r["_part"]):
            if before < start + size and before + r["n"] > start:
                wanted.append((r["_part"], before))
            before += r["n"]
        chosen = self.rows.sparkSession.createDataFrame(wanted, "_part int, _base bigint")
        upto = Window.partitionBy("_part").orderBy(*roots).rowsBetween(Window.unboundedPreceding, -1)
        first = ranged.join(F.broadcast(chosen), "_part").withColumn("_first", F.col("_base") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        touched = first.where((F.col("_first") < start + size) & (F.col("_first") + F.col("_n") > start)).select(*roots, "_first")
        touched = written(touched, "factorised-touched")
        rows = self._expand(_made(self.nodes, self._below(touched.select(*roots)), self.chunk)).join(F.broadcast(touched), roots)
        own = F.row_number().over(Window.partitionBy(*roots).orderBy(*others)) if others else F.lit(1)
        ranked = rows.withColumn("rank", F.col("_first") + own - 1)
        return ranked.where((F.col("rank") >= start) & (F.col("rank") < start + size)).select("rank", *self.q.out)


def factorised(tables: Tables, q: Query, root: int = 0, chunk: int = CHUNK) -> Factorised:
    """The answers of an acyclic query that outputs all of its attributes, hung up at an atom.

    A query that projects attributes away can have one answer under several root rows, and raises.
    Nulls match nothing; relations are sets.
    """
    if set(q.out) != {a for atom in q.atoms for a in atom.attrs}:
        raise ValueError(f"query {q.name}: factorised answers need all attributes in the output")
    nodes = tree(q, root)
    rows = _made(nodes, [atom_rows(tables, a).select(*n.attrs) for a, n in zip(q.atoms, nodes, strict=True)], chunk)
    return Factorised(q, nodes, root, rows, tables, chunk)


def _made(nodes: list[Node], rows_of: list[DataFrame], chunk: int) -> DataFrame:
    """The root's rows with arrays of what lies below, from the rows of each node."""
    made: dict[int, DataFrame] = {}
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i].height):
        rows = rows_of[i]
        for c in nodes[i].children:
            rows = rows.join(made[c], [a for a in nodes[i].attrs if a in nodes[c].attrs])
        if nodes[i].parent is None:
            return rows
        key = [a for a in nodes[i].attrs if a in nodes[nodes[i].parent].attrs]
        rest = [a for a in nodes[i].attrs if a not in key] + [f"_{c}" for c in nodes[i].children]
        made[i] = _gathered(rows, key, rest, f"_{i}", chunk)
    raise AssertionError("a tree has a root")


def _gathered(rows: DataFrame, key: list[str], rest: list[str], name: str, chunk: int) -> DataFrame:
    """(key, name): arrays of at most about `chunk` structs of the rest of the key's rows; empty structs only count."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > chunk)
    plain = [c for c in rows.columns if not c.startswith("_")]
    dealt = rows.join(sizes, key, "left").withColumn("_deal", F.when(F.col("_many").isNotNull(), F.pmod(F.xxhash64(*plain), F.ceil(2 * F.col("_many") / chunk))).otherwise(0))
    element = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    return dealt.groupBy(*key, "_deal").agg(F.collect_list(element).alias(name)).drop("_deal")
