"""Relations over the driver tables, their change logs, and written intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set-valued relations over the tables: name -> (table, {column: source column}).
RELATIONS = {
    "RG": ("region", {"r": "r_regionkey", "rn": "r_name"}),
    "NR": ("nation", {"n": "n_nationkey", "r": "n_regionkey"}),
    "CN": ("customer", {"c": "c_custkey", "n": "c_nationkey"}),
    "SN": ("supplier", {"s": "s_suppkey", "n": "s_nationkey"}),
    "OC": ("orders", {"o": "o_orderkey", "c": "o_custkey"}),
    "LO": ("lineitem", {"o": "l_orderkey", "p": "l_partkey"}),
    "LS": ("lineitem", {"p": "l_partkey", "s": "l_suppkey"}),
    "LOPS": ("lineitem", {"o": "l_orderkey", "p": "l_partkey", "s": "l_suppkey"}),
    "PB": ("part", {"p": "p_partkey", "b": "p_brand"}),
    "UE": ("events", {"u": "user_id", "t": "event_type"}),
}
TEXT = {"rn", "b", "t"}
#: Change logs: relation -> [(op, seq expression, condition)], in the relation's columns.
CHANGES = {
    "NR": [("+", "n", "true")],
    "CN": [("+", "c", "true")],
    "SN": [("+", "s", "true"), ("-", "4000000 + s", "s % 3 = 0")],
    "OC": [("+", "1000000 + o", "true"), ("-", "5000000 + o", "o % 7 = 0"), ("+", "8000000 + o", "o % 14 = 0")],
    "LO": [("+", "2000000 + o", "true"), ("-", "6000000 + p", "p % 5 = 0")],
    "LS": [("+", "3000000 + p", "true"), ("-", "7000000 + s", "s % 3 = 0")],
    "UE": [("+", "1000 + u", "true"), ("-", "4000000 + u", "u % 4 = 0"), ("+", "4500000 + u", "u % 8 = 0")],
}


def relation(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """The distinct rows of one relation, keys as bigint; dealt by one of them, a join on it needs no other shuffle."""
    table, columns = RELATIONS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = rows.select(*[F.col(c).cast("string" if a in TEXT else "bigint").alias(a) for a, c in columns.items()])
    return (rows.repartition(by) if by else rows).distinct()


def source_rows(spark: SparkSession, sf_dir: str, names: list[str]) -> int:
    """How many rows the tables of some relations have together, by the Parquet files' footers."""
    return sum(spark.read.parquet(f"{sf_dir}/{RELATIONS[name][0]}.parquet").count() for name in names)


def relation_sql(name: str) -> str:
    table, columns = RELATIONS[name]
    return f"SELECT DISTINCT {', '.join(f'CAST({c} AS {'VARCHAR' if a in TEXT else 'BIGINT'}) AS {a}' for a, c in columns.items())} FROM {table}"


def change_log(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """The relation's columns with op and seq: the log whose replay gives its contents over time."""
    rows = relation(spark, sf_dir, name, by)
    each = F.explode(F.array(*(F.when(F.expr(cond), F.struct(F.lit(op).alias("op"), F.expr(f"CAST({seq} AS BIGINT)").alias("seq"))) for op, seq, cond in CHANGES[name])))
    return rows.select("*", each.alias("_c")).where("_c IS NOT NULL").select(*rows.columns, "_c.op", "_c.seq")


def change_log_sql(name: str) -> str:
    columns = ", ".join(RELATIONS[name][1])
    return " UNION ALL ".join(f"SELECT {columns}, '{op}' AS op, CAST({seq} AS BIGINT) AS seq FROM ({relation_sql(name)}) WHERE {cond}" for op, seq, cond in CHANGES[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may leave it unset and gets a fresh local folder; on a cluster, where
    executors could not see one, that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    return rewritten(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def rewritten(df: DataFrame, path: str) -> DataFrame:
    """df written to `path`, in place of what is there, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path, if it is there, through Spark's file system layer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a path, through Spark's file system layer; false if there is none."""
    at, goal = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return False
    fs.mkdirs(goal.getParent())
    if not fs.rename(at, goal):
        raise OSError(f"{path} can't be renamed to {to}")
    return True
