"""Sharding by fixed virtual slots and a versioned map of slots to shards.

A record's hash names one of some thousands of slots, for good. Bytes are summed per slot; which
shard holds a slot is a row of the map, of which every version is kept in the shared folder: version
0 deals the slots out evenly by number, and each edit (`rebalanced`, `grown`) is the next version and
moves only the slots that it has to. A slot that alone is large for a shard, as a record that is
repeated very often makes it, is split into parts by the places of its rows.

Only DataFrame functions are used. What is shuffled is ids, sizes and places, never texts; what is
broadcast is the map, a row per slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.llm.common import cut, new_path

SLOTS = 4096
SHARDS = 24
#: Bytes that count for a record besides its text's.
OVERHEAD = 8
#: A slot of several records is split into parts of at most a shard's bytes divided by this.
SPLIT = 32
MAP = "vslot int, part int, bytes bigint, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, at) of each row, written: at is its place in the input, once and for all.

    A null text is empty. The slot follows from doc_id and text alone, so that rows without an id
    spread; repeated rows are records of their own. Further columns are left out.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"), F.lit(slots)).cast("int")
    return cut(rows.select("*", slot.alias("vslot"), F.monotonically_increasing_id().alias("at")), "shard-records")


def even_map(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The first map, of all slots, empty ones too: slots in order of their numbers, as many to each shard."""
    sizes = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    limit = F.greatest(F.lit(1), F.expr(f"total div {shards * SPLIT}"))
    wanted = sizes.join(F.broadcast(total)).select("vslot", F.least("n", F.greatest(F.lit(1), F.ceil(F.col("bytes") / limit))).cast("int").alias("parts"))
    split = wanted.where("parts > 1")
    parted = rows.join(F.broadcast(split), "vslot").groupBy("vslot", F.expr("CAST(at % parts AS INT)").alias("part")).agg(F.sum("size").alias("bytes"))
    held = split.select("vslot", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).join(parted, ["vslot", "part"], "left")
    plain = sizes.join(F.broadcast(split), "vslot", "left_anti").select("vslot", F.lit(0).alias("part"), "bytes")
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    empty = every.join(F.broadcast(sizes), "vslot", "left_anti").select("vslot", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("bytes"))
    found = held.unionByName(plain).unionByName(empty)
    return found.select("vslot", "part", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), F.expr(f"CAST(vslot * CAST({shards} AS BIGINT) div {slots} AS INT)").alias("shard"))


def _kept(map_: DataFrame, shards: int) -> DataFrame:
    """The map with `stays`: true for a shard's largest slots, as far as they fit into an equal share of all bytes."""
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot", "part").rowsBetween(Window.unboundedPreceding, 0)
    total = map_.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))
    return map_.withColumn("_upto", F.sum("bytes").over(largest)).join(F.broadcast(total)).select(*map_.columns, ((F.col("_upto") * shards <= F.col("_total")) | (F.col("bytes") == 0)).alias("stays"))


def rebalanced(map_: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map's next version, sizes near equal: each shard gives up what exceeds an equal share; those slots go, largest first, to the smallest shard so far."""
    kept = _kept(map_, shards)
    loads = kept.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    start = kept.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(loads), "shard", "left")
    start = start.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads"))
    given = kept.where("NOT stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "part"))).alias("given"))

    def deal(state: Column, slot: Column) -> Column:
        smallest = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        moved = F.struct(slot["vslot"].alias("vslot"), slot["part"].alias("part"), (-slot["less"]).alias("bytes"), smallest.cast("int").alias("shard"))
        return F.struct(F.transform(state["loads"], lambda x, i: F.when(i == smallest, x - slot["less"]).otherwise(x)).alias("loads"), F.array_append(state["dealt"], moved).alias("dealt"))

    none = F.from_json(F.lit("[]"), "array<struct<vslot:int,part:int,bytes:bigint,shard:int>>")
    dealt = start.join(F.broadcast(given)).select(F.aggregate("given", F.struct("loads", none.alias("dealt")), deal)["dealt"].alias("dealt"))
    return kept.where("stays").select(map_.columns).unionByName(dealt.select(F.inline("dealt")).select(map_.columns))


def grown(map_: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version with one shard more, number `shards`: what exceeds the smaller equal share moves into it, nothing else moves."""
    kept = _kept(map_, shards + 1)
    return kept.select("vslot", "part", "bytes", F.when(F.col("stays"), F.col("shard")).otherwise(shards).cast("int").alias("shard"))


def write_map(map_: DataFrame, root: str, version: int) -> DataFrame:
    """Keeps the map as that version under `root` and reads it back; a version that is there already raises."""
    map_.select("vslot", "part", "bytes", "shard").coalesce(1).write.parquet(f"{root}/version={version}")
    return read_map(map_.sparkSession, root, version)


def read_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{root}/version={version}")


def assigned(rows: DataFrame, map_: DataFrame) -> DataFrame:
    """The records with their shards by a map."""
    shards = map_.groupBy("vslot").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "shard"))), lambda x: x["shard"]).alias("_shards"))
    return rows.join(F.broadcast(shards), "vslot").withColumn("shard", F.expr("_shards[CAST(at % size(_shards) AS INT)]")).drop("_shards")


def numbered(rows: DataFrame) -> DataFrame:
    """Assigned records with `slot`, gapless from 0 in each shard, in the order of their places.

    Rows are counted by input partition and shard, the counts are summed up, and rows are numbered
    within both: no group is larger than an input partition.
    """
    rows = rows.withColumn("_place", F.shiftright("at", 33))
    before = Window.partitionBy("shard").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_place", "shard").count().select("_place", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_place", "shard").orderBy("at"))
    return rows.withColumn("_own", own).join(counts, ["_place", "shard"]).withColumn("slot", (F.col("_before") + F.col("_own") - 1).cast("bigint")).drop("_place", "_own", "_before")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, root: str | None = None) -> tuple[DataFrame, str]:
    """Records of `docs` with shard and slot by version 1 of a new map, and the folder that keeps the map's versions.

    An empty table has no records and a map of empty slots.
    """
    root = root or new_path(docs.sparkSession, "shard-map")
    rows = records(docs, slots)
    first = write_map(even_map(rows, shards, slots), root, 0)
    return numbered(assigned(rows, write_map(rebalanced(first, shards), root, 1))), root


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in shards of near equal bytes, by the rebalanced map of slots."""
    rows, _ = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
