"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed by doc_id, size, checksum and the number of the copy among equal records into a fixed number of virtual
slots, so neither null or repeated ids nor a document with a million copies fill one slot; the bytes of each slot are aggregated; a versioned map
says which shard each slot belongs to, and its versions are stored side by side (`saved`, `stored`). The first version packs
slots into shards, largest first, each to the lightest shard so far, so the shards' bytes are nearly equal. `rebalance`
edits the newest version for another number of shards or for grown slots: only slots that must move do. The map has `slots` rows whatever the data's size, so that packing
is a fold over one bounded array, and joining it is a small broadcast.

A record's place in its shard (`slot` of the contract) is counted in two levels: a window inside each (virtual slot,
part), where the number of parts grows with the table so that no window is large, plus the rows of the parts before it.
Equal records (doc_id, size and checksum) are counted where they are read and numbered by spelling that count out again, in
steps of COPIES. Null text has no bytes; null doc_id is hashed like a value. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldhouse.llm.util import new_folder, written

SLOTS, SHARDS = 4096, 16
#: Rows of one place-counting window, about.
WINDOW_ROWS = 100_000
#: Equal records that are spelled out from one row at a time.
COPIES = 10_000


def virtual_slot(*key: F.Column, slots: int = SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy (its number among equal records) and virtual slot of each record; the texts go no
    further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    equal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    steps = equal.withColumn("step", F.explode(upto(F.ceil(F.col("n") / COPIES))))
    own = F.transform(upto(F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("step") * COPIES)), lambda k: F.col("step") * COPIES + k)
    each = steps.withColumn("copy", F.explode(own))
    return each.select("doc_id", "size", "text_crc32", "copy", virtual_slot(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("copy"), slots=slots).alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """bytes and rows of every slot, empty ones included."""
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _packed(loads: DataFrame, start: F.Column, version: F.Column) -> DataFrame:
    """Puts each (virtual_slot, bytes) of `loads` on the then lightest shard, largest first. `start`: the loads so far."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("rest"), "virtual_slot")))

    def put(acc, x):
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == lightest, v - x["rest"]).otherwise(v))
        entry = F.struct(x["virtual_slot"].alias("virtual_slot"), lightest.alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(acc["map"], F.array(entry)).alias("map"))

    none = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)")
    folded = F.aggregate(order, F.struct(start.alias("loads"), none.alias("map")), put, lambda acc: acc["map"])
    return loads.agg(folded.alias("map")).select(F.inline("map")).withColumn("version", version)


def slot_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: (virtual_slot, shard, version)."""
    return _packed(loads, F.array_repeat(F.lit(0).cast("long"), shards), F.lit(1))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for `shards` shards. Each old shard keeps its slots up to an equal share of all bytes,
    in the order of their hashes; the rest, and the slots of shards that no longer exist, go to the lightest shards."""
    share = loads.agg((F.sum("bytes") / shards).alias("share"))
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot"))
    placed = old.join(loads, "virtual_slot").withColumn("upto", upto).crossJoin(F.broadcast(share))
    placed = placed.withColumn("stays", (F.col("shard") < shards) & (F.col("upto") <= F.col("share")))
    stays = placed.filter("stays")
    kept = stays.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    by_shard = F.map_from_entries(F.collect_list(F.struct("shard", "bytes")))
    start = kept.agg(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(by_shard[k], F.lit(0).cast("long"))).alias("start"))
    version = old.agg((F.max("version") + 1).alias("next"))
    moving = placed.filter("not stays").select("virtual_slot", "bytes").crossJoin(F.broadcast(start))
    moved = _packed(moving, F.first("start"), F.lit(0)).drop("version")
    return stays.select("virtual_slot", "shard").unionByName(moved).crossJoin(F.broadcast(version)).select("virtual_slot", "shard", F.col("next").alias("version"))


def saved(mapped: DataFrame, path: str) -> DataFrame:
    """Stores a version of the map under path, beside the older ones, and reads it back."""
    spark = mapped.sparkSession
    mapped = written(mapped, "slot-map")  # a few thousand rows: packed once, not again for its version
    version = mapped.agg(F.max("version")).first()[0]
    mapped.select("virtual_slot", "shard").write.parquet(f"{path}/version={version}")
    return stored(spark, path, version)


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map; the newest by default."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version)


def rebalance(rows: DataFrame, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Edits the newest stored map for these records and this number of shards, and stores the next version."""
    return saved(rebalanced(stored(rows.sparkSession, path), slot_bytes(rows, slots), shards), path)


def numbered(rows: DataFrame, mapped: DataFrame, slots: int = SLOTS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Each of the records with its virtual slot, shard by the map, and place in the shard, gapless from 0."""
    loads = slot_bytes(rows, slots)
    # parts of a slot: as many as its rows ask for, so that a window stays near window_rows
    parts = loads.select("virtual_slot", F.greatest(F.ceil(F.col("rows") / window_rows), F.lit(1)).cast("int").alias("parts"))
    assigned = mapped.join(parts, "virtual_slot")
    rows = rows.join(F.broadcast(assigned), "virtual_slot")  # `slots` rows of four integers: bounded by the parameter
    rows = rows.withColumn("part", F.pmod(F.xxhash64("virtual_slot", "doc_id", "size", "text_crc32", "copy"), F.col("parts")).cast("int"))
    counts = rows.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("virtual_slot", "part", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "copy"))
    return rows.withColumn("inside", inside).join(offsets, ["virtual_slot", "part"]).withColumn("slot", F.col("offset") + F.col("inside") - 1)


def placed(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The documents' records by a new map, whose first version is stored. The four small columns of the records are stored
    once, so that the texts are read once."""
    rows = written(records(docs, slots), "records")
    mapped = saved(slot_map(slot_bytes(rows, slots), shards), new_folder(docs.sparkSession, "slot-map"))
    return numbered(rows, mapped, slots, window_rows)


def contract(docs: DataFrame) -> DataFrame:
    """The columns of op2, law `bytes`."""
    return placed(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
