"""Sharding by fixed virtual slots, with DataFrame operations only.

Records are hashed by text into `slots` virtual slots, so equal texts meet in one slot.
Bytes are summed per slot, and a slot map, a table of `slots` rows per version, gives each
slot its shard: largest slot first, always to the lightest shard. Rebalancing edits the map
and moves whole slots; the law is therefore `bytes` (sizes near equal).

A text whose copies hold more than 1 / (SPLIT * shards) of all bytes would weigh a slot
down; its rows are hashed by id too and spread over all slots: for these texts alone, near
equal bytes go before equal texts staying together, and op2 says so in the column `spread`.
There are SPLIT * shards such texts at most, which bounds that broadcast; the map has `slots`
rows, which bounds the other.

Null texts have no bytes, a null text_crc32 and are one group; empty texts are another. Ties
in the order within a slot are broken by doc_id, size and hash; rows that agree in all of
these are equal and any order of them is the same. An empty table has no rows and a map with
empty slots. assign() passes all columns through and adds `slot` and `shard`, with underscores
before these names if the table has such columns; op2 ignores columns but doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, cut, free, table

SHARDS = 24
SLOTS = 4096
SPLIT = 8

MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def record_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 8


def _narrow(docs: DataFrame) -> DataFrame:
    """What the map needs of each row; the texts are read once, here."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        record_bytes().alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
        F.xxhash64(text).alias("h"),
    )


def hot_texts(narrow: DataFrame, shards: int) -> DataFrame:
    """(h, size) of the texts whose copies are too many for one slot."""
    total = narrow.agg(F.sum("size")).first()[0] or 0
    return narrow.groupBy("h", "size").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (SPLIT * shards) > F.lit(total)).where("bytes > size").select("h", "size", F.lit(True).alias("hot"))


def _slot(slots: int, h: str = "h", size: str = "size", doc_id: str = "doc_id", hot: str = "hot") -> Column:
    key = F.when(F.col(hot), F.xxhash64(F.col(doc_id), F.lit("spread"))).otherwise(F.lit(0).cast("long"))
    return F.pmod(F.xxhash64(F.col(h), F.col(size), key), F.lit(slots).cast("long")).cast("int")


def with_slots(narrow: DataFrame, hot: DataFrame, slots: int) -> DataFrame:
    # at most SPLIT * shards rows
    return narrow.join(F.broadcast(hot), ["h", "size"], "left").withColumn("vslot", _slot(slots)).withColumn("hot", F.coalesce("hot", F.lit(False)))


def slot_stats(slotted: DataFrame, slots: int) -> DataFrame:
    """(slot, bytes, rows) of every slot, those without rows too."""
    got = slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(got, F.col("slot") == F.col("vslot"), "left").select("slot", F.coalesce("b", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("rows"))


def _lightest_first(free: DataFrame, loads: DataFrame) -> DataFrame:
    """(slot, shard) for free (slot, bytes): largest first, each to the shard with the least.

    loads: (shard, bytes) of every shard. Both tables are the map's size, which is fixed.
    """
    start = loads.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "bytes"))), lambda x: x["bytes"]).alias("loads"))
    todo = free.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot"))).alias("todo"))
    fold = F.expr("""
        aggregate(todo,
          named_struct('loads', loads, 'out', cast(array() as array<struct<slot:int,shard:int>>)),
          (a, x) -> named_struct(
            'loads', transform(a.loads, (v, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, v - x.less, v)),
            'out', concat(a.out, array(named_struct('slot', x.slot, 'shard', cast(array_position(a.loads, array_min(a.loads)) - 1 as int))))),
          a -> a.out)""")
    return todo.join(start).select(F.explode(fold).alias("x")).select("x.slot", "x.shard")  # one row each


def first_map(stats: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0 of the slot map."""
    loads = stats.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"))
    return _lightest_first(stats, loads).join(stats, "slot").select(F.lit(0).alias("version"), "slot", "shard", "bytes", "rows")


def rebalance(old: DataFrame, stats: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """The next version of the map for new stats or another number of shards.

    A shard keeps its largest slot, and others by size up to the mean plus slack; only what is
    beyond, and the slots of shards that are no more, move.
    """
    now = cut(old.select("version", "slot", "shard").join(stats, "slot"))
    mean = (now.agg(F.sum("bytes")).first()[0] or 0) / shards
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    marked = now.withColumn("keep", (F.col("shard") < shards) & ((F.sum("bytes").over(own) <= mean * (1 + slack)) | (F.row_number().over(own) == 1)))
    marked = cut(marked)
    held = marked.where("keep").groupBy("shard").agg(F.sum("bytes").alias("b"))
    loads = now.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left").select("shard", F.coalesce("b", F.lit(0)).alias("bytes"))
    moved = _lightest_first(marked.where(~F.col("keep")).select("slot", "bytes"), loads)
    placed = marked.where("keep").select("slot", "shard").unionByName(moved)
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    return placed.join(stats, "slot").select(F.lit(version).alias("version"), "slot", "shard", "bytes", "rows")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds one version to the map's table."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    at = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == at)


def plan(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(narrow rows with vslot, hot texts, map of version 0)."""
    narrow = cut(_narrow(docs))
    hot = cut(hot_texts(narrow, shards))
    slotted = with_slots(narrow, hot, slots)
    return slotted, hot, cut(first_map(cut(slot_stats(slotted, slots)), shards))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with columns slot (virtual) and shard; the texts aren't shuffled."""
    _, hot, slot_map = plan(docs, shards, slots)
    text = F.col("text").cast("string")
    h, size, id_, is_hot, slot, shard = (free(f"__{c}", docs) for c in ("h", "size", "id", "hot", "slot", "shard"))
    rows = docs.withColumns({h: F.xxhash64(text), size: record_bytes(), id_: F.col("doc_id").cast("long")})
    rows = rows.join(F.broadcast(hot.toDF(h, size, is_hot)), [h, size], "left")
    rows = rows.withColumn(slot, _slot(slots, h, size, id_, is_hot))
    places = slot_map.select(F.col("slot").alias(slot), F.col("shard").alias(shard))  # `slots` rows
    return rows.join(F.broadcast(places), slot).select(*map(column, docs.columns), F.col(slot).alias(free("slot", docs)), F.col(shard).alias(free("shard", docs)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    slotted, _, slot_map = plan(table(spark, sf_dir, "documents"))
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.select(F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "crc", "h")) - 1
    return (
        slotted.withColumn("within", within)
        .join(F.broadcast(places), "vslot")  # `slots` rows
        .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("hot").alias("spread"))
    )
