"""Answers and node states of conjunctive queries over current tables.

Joins are natural joins of DataFrames. `reduced` goes up the join tree once and reads every atom
once: a child that offers no output only restricts its parent, by a semi-join; any other hands up
the distinct values that its parent or the answer needs. Which form is faster depends on the data:
plain joins let the optimizer broadcast small sides, reduction pays where joined rows are many more
than the answer.

Adaptive execution merges shuffled partitions by their bytes. Where siblings under one key multiply,
a merged partition's joined rows are many times what it reads, and so is the memory of its distinct:
`dealt` takes such a key and a number of tasks, which stays as it is. Where the last atom's values are
what multiplies, `gathered` moves a list of them in place of a row for each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.operators.packed import packed, united
from deltaloom.plans.model import Atom, Query, join_tree, rooted
from deltaloom.plans.sharing import share

Tables = Callable[[str], DataFrame]
#: Values in a list of gathered(), at most.
LIST = 1_000
#: Types whose lists move as bytes.
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def atom_rows(tables: Tables, atom: Atom, *extra: str) -> DataFrame:
    """The atom's relation with the query's attribute names; a repeated attribute keeps equal rows only.

    `extra` names the columns that follow the relation's own.
    """
    names = [f"{a}__{i}" if a in atom.attrs[:i] else a for i, a in enumerate(atom.attrs)]
    rows = tables(atom.relation).toDF(*names, *extra)
    for i, a in enumerate(atom.attrs):
        if names[i] != a:
            rows = rows.where(F.col(names[i]) == F.col(a)).drop(names[i])
    return rows


def dealt(tables: Tables, by: str, tasks: int) -> Callable[[Atom], DataFrame]:
    """Rows of atoms; those that have the attribute are dealt by it to so many tasks, at which their joins stay."""

    def rows(atom: Atom) -> DataFrame:
        found = atom_rows(tables, atom)
        return found.repartition(tasks, by) if by in atom.attrs else found

    return rows


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns of the same name; without any, an error rather than a product."""
    on = _shared(left, right)
    if not on:
        raise ValueError("no shared columns: products are not supported")
    return left.join(right if how == "inner" else right.select(on), on, how)


def _in_order(q: Query) -> list[Atom]:
    """The atoms so that each shares an attribute with those before it."""
    order, left = [q.atoms[0]], list(q.atoms[1:])
    while left:
        seen = {a for x in order for a in x.attrs}
        nxt = next((x for x in left if seen & set(x.attrs)), None)
        if nxt is None:
            raise ValueError(f"query {q.name}: no shared columns: products are not supported")
        order.append(nxt)
        left.remove(nxt)
    return order


def _projected(rows: DataFrame, q: Query) -> DataFrame:
    """The distinct output; relations are sets, so joined rows with all of their attributes are distinct as they are."""
    found = rows.select(*q.out)
    return found if set(q.out) == {a for atom in q.atoms for a in atom.attrs} else found.distinct()


def snapshot(tables: Tables, q: Query, rows_of: Callable[[Atom], DataFrame] | None = None) -> DataFrame:
    """All current results: join, project, distinct. `rows_of` gives atoms' rows, as dealt() does."""
    rows_of = rows_of or (lambda a: atom_rows(tables, a))
    return _projected(reduce(natural_join, map(rows_of, _in_order(q))), q)


def gathered(tables: Tables, q: Query, by: str, tasks: int, longest: int = LIST) -> DataFrame:
    """The same results where the last atom has one output attribute that no other has.

    The other atoms' rows meet lists of its values, of at most `longest` each and whole numbers as bytes,
    go with them to the task of their `by`, and are only there unfolded and made distinct, without another shuffle.
    """
    *others, last = _in_order(q)
    rows = reduce(natural_join, (atom_rows(tables, a) for a in others))
    link, own = _gathering(q, rows, last, by)
    found = atom_rows(tables, last)
    values, whole = found.select(*link, own), found.schema[own].dataType.simpleString()
    values = values if set(found.columns) == {*link, own} else values.distinct()
    at = F.row_number().over(Window.partitionBy(*link).orderBy(own)) - 1
    bytes_ = whole in WHOLE and set(q.out) == {by, own} and rows.schema[by].dataType.simpleString() in WHOLE
    known = F.sort_array(F.collect_list(F.col(own).cast("bigint") if bytes_ else F.col(own)))
    lists = values.withColumn("_at", F.floor(at / longest)).groupBy(*link, "_at").agg(F.when(F.bool_or(F.isnull(own)), F.array_append(known, F.lit(None))).otherwise(known).alias("_values")).drop("_at")
    kept = [c for c in rows.columns if c in q.out or c in link]
    met = natural_join(rows.select(*kept), packed(lists, ["_values"], "_values") if bytes_ else lists)
    met = met.drop(*(c for c in kept if c not in q.out)).repartition(tasks, by)
    if bytes_:
        return united(met.sortWithinPartitions(by), by, "_values").select(by, F.explode(F.col("_values").cast(f"array<{whole}>")).alias(own)).select(*q.out)
    return met.select("*", F.explode("_values").alias(own)).select(*q.out).distinct()


def _gathering(q: Query, rows: DataFrame, last: Atom, by: str) -> tuple[list[str], str]:
    """What the last atom shares with the others' rows, and the one output attribute that it alone has."""
    link = [a for a in dict.fromkeys(last.attrs) if a in rows.columns]
    own = [a for a in q.out if a in last.attrs and a not in link]
    if len(own) != 1 or by not in q.out or by in own:
        raise ValueError(f"query {q.name}: not one attribute of {last} to gather by {by}")
    return link, own[0]


def _upward(rows_of: Callable[[Atom], DataFrame], q: Query, order: list[tuple[int, int | None]], wanted: set[str]) -> list[DataFrame]:
    """For each child of the root what it hands up: the distinct attributes that it shares with the root or that are wanted."""
    edges = [set(a.attrs) for a in q.atoms]
    below: dict[int, list[DataFrame]] = {i: [] for i, _ in order}
    for i, parent in order[:-1]:
        rows = _combined(rows_of(q.atoms[i]), below.pop(i))
        keep = [c for c in rows.columns if c in edges[parent] or c in wanted]
        below[parent].append(rows.select(keep).distinct())
    return below[order[-1][0]]


def _combined(rows: DataFrame, children: list[DataFrame]) -> DataFrame:
    """The rows with what their children hand up; those that only restrict come first."""
    only = [c for c in children if set(c.columns) <= set(rows.columns)]
    for c in only:
        rows = natural_join(rows, c, "left_semi")
    return reduce(natural_join, (c for c in children if c not in only), rows)


def reduced(tables: Tables, q: Query, rows_of: Callable[[Atom], DataFrame] | None = None) -> DataFrame:
    """The same results by reduction along the join tree, from the atom with most of the output; cyclic queries take the plain form."""
    edges, out = [set(a.attrs) for a in q.atoms], set(q.out)
    tree = join_tree(edges)
    if tree is None:
        return snapshot(tables, q, rows_of)
    rows_of = rows_of or (lambda a: atom_rows(tables, a))
    root = max(range(len(edges)), key=lambda i: len(edges[i] & out))
    return _projected(_combined(rows_of(q.atoms[root]), _upward(rows_of, q, rooted(tree, root), out)), q)


def many(tables: Tables, queries: list[Query], form: Callable[[Tables, Query], DataFrame] = snapshot) -> DataFrame:
    """Results of several queries of equal output width, tagged by their position as qid, columns y1, y2, …"""
    parts = [form(tables, q).toDF(*(f"y{i + 1}" for i in range(len(q.out)))).select(F.lit(k).alias("qid"), "*") for k, q in enumerate(queries)]
    return reduce(DataFrame.unionByName, parts)


def shared(tables: Tables, node: Query, queries: list[Query]) -> DataFrame:
    """Results of queries that use `node` as one of their relations, under its name, evaluated once.

    The node is written to the shared folder once and read by all queries, whatever their attribute
    names; recovery needs no recomputation.
    """
    from deltaloom.sources.tables import written

    rows = written(snapshot(tables, node), node.name)
    return many(lambda name: rows if name == node.name else tables(name), queries)


def found_shared(tables: Tables, queries: list[Query], nodes_of: Callable[[list[Query], Callable[[str], int]], tuple[list[Query], list[Query]]] = share, rows: Callable[[str], int] | None = None) -> DataFrame:
    """Results of several queries, as many() has them; what they have in common is found, evaluated once and written.

    For the choice of what to share relations are counted once each, unless `rows` tells about how large
    they are. Each node is read by all that use it, and may itself use earlier ones.
    """
    from deltaloom.sources.tables import written

    done: dict[str, DataFrame] = {}
    at = lambda name: done[name] if name in done else tables(name)
    nodes, rest = nodes_of(queries, rows or (lambda name: tables(name).count()))
    for n in nodes:
        done[n.name] = written(snapshot(at, n), n.name)
    return many(at, rest)


def satisfied(rows: DataFrame, children: list[DataFrame]) -> DataFrame:
    """rows with n_satisfied, the number of children that hold the row's key, and alive if all do."""
    out = rows.withColumn("n_satisfied", F.lit(0))
    for child in children:
        on = _shared(rows, child)
        out = out.join(child.select(on).distinct().withColumn("_hit", F.lit(1)), on, "left")
        out = out.withColumn("n_satisfied", F.col("n_satisfied") + F.coalesce("_hit", F.lit(0))).drop("_hit")
    return out.withColumn("alive", F.col("n_satisfied") == len(children))


def generalized(children: list[DataFrame], on: list[str]) -> DataFrame:
    """The virtual relation of keys that any child offers, with how many do, and alive if all do."""
    keys = reduce(DataFrame.unionByName, [c.select(*on).distinct() for c in children])
    return keys.groupBy(*on).agg(F.count(F.lit(1)).cast("int").alias("n_children")).withColumn("alive", F.col("n_children") == len(children))


def derivations(tables: Tables, q: Query) -> DataFrame:
    """The number of joined rows behind each result."""
    rows = reduce(natural_join, (atom_rows(tables, a) for a in _in_order(q)))
    return rows.groupBy(*q.out).agg(F.count(F.lit(1)).alias("n_derivations"))


def _restrictions(tables: Tables, q: Query, atom: int) -> list[DataFrame]:
    """Distinct keys, one of each of which a row of the atom has to match to take part in some result."""
    tree = join_tree([set(a.attrs) for a in q.atoms])
    if tree is None:
        return [snapshot(tables, Query(q.name, q.atoms, tuple(dict.fromkeys(q.atoms[atom].attrs))))]
    return _upward(lambda a: atom_rows(tables, a), q, rooted(tree, atom), set())


def live_view(tables: Tables, q: Query, atom: int) -> DataFrame:
    """The rows of one atom that take part in some result: the tree, hung up at the atom, restricts it."""
    return _combined(atom_rows(tables, q.atoms[atom]), _restrictions(tables, q, atom))


def query_sets(tables: Tables, queries: list[Query], atom: int) -> DataFrame:
    """Each row of the queries' common atom with the sorted list of queries in which it is live; the atom is read once."""
    rows = atom_rows(tables, queries[0].atoms[atom])
    keys, live = rows.columns, []
    for k, q in enumerate(queries):
        if q.atoms[atom] != queries[0].atoms[atom]:
            raise ValueError(f"query {q.name}: atom {atom} is not the common one")
        hits = []
        for j, child in enumerate(_restrictions(tables, q, atom)):
            hits.append(f"_hit{k}_{j}")
            rows = natural_join_left(rows, child, hits[-1])
        live.append(F.when(reduce(lambda x, y: x & y, (F.col(h).isNotNull() for h in hits), F.lit(True)), F.lit(str(k))))
    rows = rows.select(*keys, F.array_compact(F.array(*live)).alias("_live")).where("size(_live) > 0")
    return rows.select(*keys, F.array_join("_live", ",").alias("qids"))


def natural_join_left(rows: DataFrame, child: DataFrame, hit: str) -> DataFrame:
    """The rows with a column that is null where the child has no match; its rows are distinct."""
    return rows.join(child.withColumn(hit, F.lit(1)), child.columns, "left")


def annotated(tables: Tables, q: Query, weights: dict[str, str]) -> DataFrame:
    """Joined rows with ann, the product of the atoms' annotations: a column expression by relation, 1 by default."""
    parts = []
    for k, a in enumerate(_in_order(q)):
        weight = F.expr(weights.get(a.relation, "1.0D")).cast("double")
        parts.append(atom_rows(lambda name, weight=weight: tables(name).withColumn("_weight", weight), a, f"_w{k}"))
    rows = reduce(natural_join, parts)
    product = reduce(lambda x, y: x * y, (F.col(f"_w{k}") for k in range(len(parts))))
    return rows.withColumn("ann", product).select(*q.out, "ann")
