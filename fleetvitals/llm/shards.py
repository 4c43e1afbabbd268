"""Shards of near equal bytes by fixed virtual slots and a stored slot-to-shard map.

A record's slot follows from its key alone. Where several records carry one key, size,
checksum and the number among equal records are part of it, so that a key with a third
of all rows fills no slot. Bytes are summed per slot, and a map, thousands of rows
whatever the data, says which shard holds a slot.
The map is versioned: to rebalance or to add shards a new version is stored in which
only the slots that must move have another shard. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.session import stored

from .text import restricted

SLOTS = 4096
SLOT_ROWS = 50_000


def _digits(key: Column, first: int, count: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, first, count), 16, 10).cast("long")


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a key; null has that of the empty text."""
    return (_digits(key, 1, 8) % slots).cast("int")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of records with virtual_slot and size."""
    return rows.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(slots: Column, loads: Column) -> Column:
    """Shard of each slot: the largest first, each to the shard with the least bytes so far.

    `slots` is an array of structs with bytes, sorted; `loads` the bytes each shard has.
    """
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def place(done: Column, slot: Column) -> Column:
        least = F.array_position(done["loads"], F.array_min(done["loads"])) - 1
        return F.struct(
            F.transform(done["loads"], lambda load, i: F.when(
                i == least, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.array_append(done["shards"], least.cast("int")).alias("shards"))

    return F.aggregate(slots, start, place, lambda done: done["shards"])


def _gathered(slots: DataFrame) -> DataFrame:
    """One row with the array of slots, largest first, ties to the smaller slot."""
    one = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    return slots.agg(F.array_sort(F.collect_list(one)).alias("slots"))


def _map_rows(gathered: DataFrame, dealt: Column, version: int) -> DataFrame:
    pair = F.explode(F.arrays_zip(
        F.col("slots.virtual_slot").alias("virtual_slot"), F.col("slots.bytes").alias("bytes"),
        dealt.alias("shard")))
    return gathered.select(pair.alias("at")).select(
        F.lit(version).alias("version"), "at.virtual_slot", "at.shard", "at.bytes")


def initial_map(sizes: DataFrame, shards: int) -> DataFrame:
    """(version, virtual_slot, shard, bytes) of version 1."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    return _map_rows(_gathered(sizes), _dealt(F.col("slots"), loads), 1)


def rebalanced_map(previous: DataFrame, sizes: DataFrame, shards: int, version: int,
                   tolerance: float = 0.02) -> DataFrame:
    """The next version of a map for changed bytes or another number of shards.

    A shard keeps its slots, largest first, up to its fair share of bytes and the
    tolerance; slots beyond that, new ones and those of shards given up are dealt to the
    emptiest shards. Every other slot stays where it is.
    """
    now = sizes.select("virtual_slot", "bytes").join(
        previous.select("virtual_slot", "shard"), "virtual_slot", "left")
    fair = (sizes.agg(F.sum("bytes")).first()[0] or 0) / shards * (1 + tolerance)
    order = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot")
    now = now.withColumn("sum", F.sum("bytes").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    stays = (F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("sum") <= fair))
    now = now.withColumn("stays", F.coalesce(stays, F.lit(False)))
    one = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "shard")
    both = now.agg(
        F.array_sort(F.collect_list(F.when(F.col("stays"), one))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), one))).alias("slots"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"),
        lambda n, k: n + k["bytes"]))
    moved = _map_rows(both, _dealt(F.col("slots"), loads), version)
    kept = both.select(F.explode("kept").alias("at")).select(
        F.lit(version).alias("version"), "at.virtual_slot", "at.shard", "at.bytes")
    return kept.unionByName(moved)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`rows` (with doc_id, size, virtual_slot) and their shard and gapless place in it.

    Places follow the slots of a shard and inside a slot the keys. A slot is numbered in
    sub-slots, more of them the more rows a slot has, so that no task sorts a whole shard.
    """
    most = rows.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] or 0
    subs = most // SLOT_ROWS + 1
    text = [c for c in ("size", "text_crc32") if c in rows.columns]
    key = "record_key" if "record_key" in rows.columns else "doc_id"
    rows = rows.withColumn("sub", (_digits(F.col(key), 9, 8) % subs).cast("int")).drop("record_key")
    counts = rows.groupBy("virtual_slot", "sub").agg(F.count("*").alias("n")).join(
        slot_map.select("virtual_slot", "shard"), "virtual_slot")
    order = Window.partitionBy("shard").orderBy("virtual_slot", "sub")
    offsets = counts.select("virtual_slot", "sub", "shard", F.coalesce(
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot", "sub").orderBy("doc_id", *text)
    return (rows.withColumn("number", F.row_number().over(inside) - 1)
            .join(offsets, ["virtual_slot", "sub"])
            .withColumn("place", (F.col("before") + F.col("number")).cast("long"))
            .drop("sub", "number", "before"))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, record_key, virtual_slot): bytes of the text plus 8, null as none.

    The key of a record is its id. Ids of several rows, null among them, give each row
    `id:size:crc32:number` instead, the number telling equal rows apart, from 0.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # Stored with the place of its scan, by which equal rows are numbered in parts.
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("record_key"),
        F.spark_partition_id().alias("part")), "records")
    often = stored(rows.groupBy("record_key").agg(F.count("*").alias("n")).where("n > 1")
                   .select("record_key"), "repeated-ids")
    if not often.isEmpty():
        once = restricted(rows, often, "record_key", "left_anti")
        rows = once.unionByName(_told_apart(restricted(rows, often, "record_key")))
    return rows.drop("part").withColumn("virtual_slot", virtual_slot(F.col("record_key"), slots))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows of repeated ids, each with a key of its own.

    Equal rows are numbered inside each part of the scan, and the parts by running sums
    of their counts, so that no task numbers all copies of a row.
    """
    same = ["record_key", "size", "text_crc32"]
    counts = rows.groupBy(*same, "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *same, "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*same, "part").orderBy("doc_id")) - 1
    numbered = rows.withColumn("number", inside).join(before, [*same, "part"])
    number = F.col("before") + F.col("number")
    own = F.concat_ws(":", *[c.cast("string") for c in (*map(F.col, same), number)])
    return numbered.withColumn("record_key", own).drop("number", "before")
