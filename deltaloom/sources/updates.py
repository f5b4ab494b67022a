"""Update lines as change rows.

Two line formats: fields after `|`, as in `+|KN|5|6`; and `1 title 7,"a, b"`, with a digit (1 insert,
0 delete, insert if absent), a table name and comma-separated fields. A registry tells which
relations an event tag feeds and which fields they load.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.functions.fields import csv_fields, stripped
from deltaloom.sources.tables import rewritten, shared_dir

#: (tag, relation, key field, loaded fields) for each relation that a tag feeds.
Registry = list[tuple[str, str, int, list[int]]]
#: (relation, place, attribute) for each output attribute of a query.
Outputs = list[list[tuple[str, int, int]]]
_SPLIT = ["_file", "_block"]


def decode_piped(lines: DataFrame) -> DataFrame:
    """(op, tag, cells) of lines (value): op is + or -; shorter lines and other ops are left out, and so are trailing empty fields."""
    parts = lines.select("*", F.split(F.regexp_replace("value", r"\|+\z", ""), r"\|").alias("_p")).where((F.size("_p") >= 2) & F.col("_p")[0].isin("+", "-"))
    return parts.select(*(c for c in lines.columns if c != "value"), F.col("_p")[0].alias("op"), F.col("_p")[1].alias("tag"), F.expr("slice(_p, 3, size(_p))").alias("cells"))


def decode_tabled(lines: DataFrame) -> DataFrame:
    """(op, tag, cells) of lines (value); empty fields become the text 'null', so that they join with each other.

    Only spaces separate the digit, the table and the fields. Lines without fields are left out.
    """
    own = [c for c in lines.columns if c != "value"]

    def halves(text: str) -> list:
        return [stripped(F.regexp_extract(text, r"(?s)\A([^ ]*) (.*)\z", k)) for k in (1, 2)]

    first, rest = halves("_line")
    rows = lines.select(*own, stripped("value").alias("_line")).where(F.contains("_line", F.lit(" "))).select(*own, first.alias("_first"), rest.alias("_rest"))
    table, fields = halves("_rest")
    digit = F.col("_first").isin("0", "1")
    rows = rows.where(~digit | F.contains("_rest", F.lit(" "))).select(*own, F.when(F.col("_first") == "0", "-").otherwise("+").alias("op"), F.when(digit, table).otherwise(F.col("_first")).alias("tag"), csv_fields(F.when(digit, fields).otherwise(F.col("_rest"))).alias("cells"))
    return rows.withColumn("cells", F.transform("cells", lambda c: F.when(c == "", "null").otherwise(c)))


#: The decoders by the name of their format.
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"piped": decode_piped, "tabled": decode_tabled}


def placed(lines: DataFrame) -> DataFrame:
    """Lines of a text source with where they lie: file, block, and an order within the block."""
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered(lines: DataFrame, decode: Callable[[DataFrame], DataFrame], path: str, after: int = 0) -> DataFrame:
    """Decoded lines with seq: 1 more for each line that the decoder takes, in the order of file name and position.

    A task counts the lines that it decodes, which are written to `path` with that count: those of a
    block follow each other there, so its first one and their number tell all of theirs. No lines are
    brought together, only a row for each block. `after` is the number of those that came before.
    """
    rows = rewritten(decode(lines).withColumn("_at", F.monotonically_increasing_id()), f"{path}/lines")
    before = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*_SPLIT).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    shift = F.lit(after + 1) + F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")
    shifts = rewritten(blocks.select(*_SPLIT, shift.cast("bigint").alias("_shift")), f"{path}/blocks")
    return rows.join(F.broadcast(shifts), _SPLIT).withColumn("seq", F.col("_at") + F.col("_shift")).drop("_at", "_shift", *_SPLIT)


def read_updates(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(op, tag, cells, seq) of the update lines in a text file or folder; form is a key of DECODERS."""
    return numbered(placed(spark.read.text(path)), DECODERS[form], f"{shared_dir(spark)}/decoded-{uuid.uuid4().hex}")


def read_schema(spark: SparkSession, path: str) -> tuple[Registry, Outputs]:
    """The registry and the queries' outputs of a schema file.

    Lines of four or more comma-separated values are tag, relation, key field, loaded fields. Of the
    others the first is the number of queries; then each query is its number and a line
    relation.place,attribute for each output (place 0 if absent). What follows # is left out.
    """
    lines = [x.split("#")[0].strip() for r in spark.read.text(path, wholetext=True).toLocalIterator() for x in r.value.splitlines()]
    cells = [[c.strip() for c in x.split(",")] for x in lines if x]
    registry = [(c[0], c[1], int(c[2]), [int(x) for x in c[3:]]) for c in cells if len(c) >= 4]
    outputs: Outputs = []
    for c in [c for c in cells if len(c) < 4][1:]:
        if len(c) == 1:
            outputs.append([])
        else:
            relation, _, place = c[0].partition(".")
            outputs[-1].append((relation, int(place or 0), int(c[1])))
    return registry, outputs


def routed(changes: DataFrame, registry: Registry) -> DataFrame:
    """One row per change and relation that its tag feeds: op, relation, key, values, ok.

    A row whose key field is missing is skipped for that relation; ok is false if the key is no
    integer or a loaded field is missing.
    """
    spark = changes.sparkSession
    rules = spark.createDataFrame(registry, "tag string, relation string, key_index int, fields array<int>")
    joined = changes.join(F.broadcast(rules), "tag").where((F.col("key_index") >= 0) & (F.col("key_index") < F.size("cells")))
    key = F.expr("try_cast(get(cells, key_index) AS BIGINT)")
    values = F.expr("transform(fields, i -> get(cells, i))")
    out = joined.select(*(c for c in changes.columns if c not in ("tag", "cells")), "relation", key.alias("key"), values.alias("values"))
    return out.withColumn("ok", F.col("key").isNotNull() & ~F.exists("values", lambda v: v.isNull()))


def as_changes(routes: DataFrame) -> DataFrame:
    """Routed rows that are ok, as changes (rel, cells, op, seq) of maintained views."""
    return routes.where("ok").select(F.col("relation").alias("rel"), F.col("values").alias("cells"), "op", "seq")
