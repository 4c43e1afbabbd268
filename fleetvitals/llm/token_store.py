"""Token ids of documents in a binary store with a minimal perfect hash per block.

A store is a folder with two tables. `blocks` has rows of about a million ids: the
raw ids of consecutive documents end to end (little-endian, 16 bits where the
vocabulary allows), and an index of its documents. The index is a minimal perfect
hash: a key's bucket gives a seed, key and seed give a slot of its own among exactly
as many slots as documents, and the slot holds a fingerprint of the key, the offset of
its ids in the block and their number. `directory` says for each block which
documents it spans and how many ids lie before it. A document is found by its block,
one hash, one fingerprint and one slice, however many documents a block has.

Documents lie in ascending order of id. Rows of one id are told apart by their copy
number, in the order of their texts' first HEAD characters, then of a hash of the whole
text; rows without an id come first. An id may most of the rows: its rows are dealt to several tasks, each numbers its own from 0, and
the directory says how many of them lie in the tasks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import word_encoder
from .text import as_list, mixed, slices

BLOCK_IDS = 1 << 20
BLOCK_DOCS = 1 << 15
SEEDS_AT_ONCE = 64
PER_BUCKET = 3
# So many characters order texts of one id; they go to the driver with Spark's range samples.
HEAD = 32
NO_ID = np.iinfo(np.int64).min
_BLOCKS = ("part int, block int, first_id long, last_id long, last_copy long, n_docs int, n_ids long, width int, "
           "doc_ids binary, copies binary, seeds binary, fingerprints binary, offsets binary, "
           "lengths binary, payload binary")


def keys_of(doc_ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64-bit keys of documents; null ids are given as the smallest 64-bit number."""
    with np.errstate(over="ignore"):
        return mixed(mixed(doc_ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                     + copies.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _slots(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mixed(keys ^ mixed(seeds.astype(np.uint64) + np.uint64(1)))


def _bucket_count(n: int) -> int:
    return n // PER_BUCKET + 1


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(_bucket_count(n))).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """A seed for each bucket, such that distinct keys fall on the slots 0 to n - 1."""
    n = len(keys)
    bucket = _buckets(keys, n)
    seeds = np.zeros(_bucket_count(n), np.uint32)
    taken = np.zeros(n, bool)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
    for at in np.argsort(-np.diff(edges), kind="stable").tolist():
        own = keys[order[edges[at]:edges[at + 1]]]
        if not len(own):
            break
        first = 0
        while True:
            tried = np.arange(first, first + SEEDS_AT_ONCE)
            slots = np.sort(_slots(own[None, :], tried[:, None]) % np.uint64(n), axis=1)
            slots = slots.astype(np.int64)
            good = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) != 0).all(axis=1)
            if good.any():
                found = int(np.argmax(good))
                seeds[at] = first + found
                taken[slots[found]] = True
                break
            first += SEEDS_AT_ONCE
    return seeds


def slots_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (_slots(keys, seeds[_buckets(keys, n)]) % np.uint64(n)).astype(np.int64)


def fingerprints_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype("<u4")


class _Block:
    """Documents on their way into one row of `blocks`."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.copies: list[int] = []
        self.payload: list[bytes] = []
        self.size = 0

    def row(self, part: int, number: int, kind: str) -> tuple:
        width = np.dtype(kind).itemsize
        lengths = np.array([len(x) // width for x in self.payload], np.int64)
        offsets = np.cumsum(lengths) - lengths
        ids, copies = np.array(self.ids, np.int64), np.array(self.copies, np.int64)
        keys = keys_of(ids, copies)
        seeds = perfect_hash(keys)
        order = np.argsort(slots_of(keys, seeds, len(keys)))
        return (part, number, self.ids[0], self.ids[-1], self.copies[-1], len(ids), int(lengths.sum()), width,
                ids.tobytes(), copies.astype("<u4").tobytes(), seeds.astype("<u4").tobytes(),
                fingerprints_of(keys)[order].tobytes(), offsets[order].astype("<u4").tobytes(),
                lengths[order].astype("<u4").tobytes(), b"".join(self.payload))


def write_store(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append `end_id`, and write the store to `folder`.

    Documents are dealt by ranges of id, head and hash of the text and place in the scan, so a task
    writes its blocks in order and rows of one id need not be in one task, equal ones
    included; a null text is the end id alone. The encoder's tables are bounded, a task
    holds one block.
    """
    schema = docs.sparkSession.createDataFrame([], _BLOCKS).schema

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        task = TaskContext.get().partitionId()
        block, number, last, copy = _Block(), 0, None, 0

        def batch() -> pa.RecordBatch:
            row = block.row(task, number, encoder.kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, target, strict=True)], schema=target)

        for part in slices(parts):
            for doc_id, text in zip(*[as_list(c) for c in part.columns], strict=True):
                own = NO_ID if doc_id is None else doc_id
                copy = copy + 1 if own == last else 0
                last = own
                ids = encoder.encode((text or b"").decode()) + end
                block.ids.append(own)
                block.copies.append(copy)
                block.payload.append(ids)
                block.size += len(ids) // 2
                if block.size >= BLOCK_IDS or len(block.ids) >= BLOCK_DOCS:
                    yield batch()
                    block, number = _Block(), number + 1
        if block.ids:
            yield batch()

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.substring(text, 1, HEAD).alias("head"), F.xxhash64(text).alias("digest"),
                       F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "head", "digest", "row")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(blocks, schema).write.parquet(f"{folder}/blocks")
    _directory(docs.sparkSession, folder).write.parquet(f"{folder}/directory")


def _directory(spark: SparkSession, folder: str) -> DataFrame:
    """A row per block: its documents, `start`, the ids before it, `edge_id`, the first id
    of its task, and `edge_copies`, the rows of that id in the tasks before."""
    rows = spark.read.parquet(f"{folder}/blocks").select(
        "part", "block", "first_id", "last_id", "last_copy", "n_docs", "n_ids")
    ends = rows.groupBy("part").agg(
        F.sum("n_ids").alias("total"), F.min("first_id").alias("edge_id"),
        F.max("last_id").alias("last"), F.max_by("last_copy", "block").alias("last_copy"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = ends.select(
        "part", "edge_id", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # A task asks for the rows of its first id so far, then adds those of its last.
    asks = ends.select("part", F.col("edge_id").alias("id"), F.lit(0).alias("adds"), F.lit(0).cast(
        "long").alias("n"))
    adds = ends.select("part", F.col("last").alias("id"), F.lit(1).alias("adds"),
                       (F.col("last_copy") + 1).alias("n"))
    sofar = Window.partitionBy("id").orderBy("part", "adds").rowsBetween(Window.unboundedPreceding, 0)
    edges = asks.unionByName(adds).withColumn("edge_copies", F.sum("n").over(sofar)).where(
        "adds = 0").select("part", "edge_copies")
    return rows.drop("last_copy").join(starts, "part").join(edges, "part").withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("base")


_READ = "doc_id long, copy int, start long, n_tokens long, ids binary"


def _wanted_slices(row: dict, ids: np.ndarray, copies: np.ndarray) -> list[tuple]:
    """(id, copy, offset, raw ids) of documents of one block, by its index; absent ones left out."""
    n = row["n_docs"]
    keys = keys_of(ids, copies)
    slot = slots_of(keys, np.frombuffer(row["seeds"], "<u4"), n)
    known = np.frombuffer(row["fingerprints"], "<u4")[slot] == fingerprints_of(keys)
    offsets = np.frombuffer(row["offsets"], "<u4")[slot]
    lengths = np.frombuffer(row["lengths"], "<u4")[slot]
    payload = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
    return [(i, c, o, payload[o:o + m].astype("<u4")) for i, c, o, m, k in zip(
        ids.tolist(), copies.tolist(), offsets.tolist(), lengths.tolist(), known.tolist(),
        strict=True) if k]


_INDEX = ("n_docs", "width", "seeds", "fingerprints", "offsets", "lengths", "payload")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32) of every document of a store.

    Each is looked up by its key in the index of its block; start counts the ids of all
    documents before it; the checksum is over its ids as unsigned 32-bit numbers.
    """
    blocks = spark.read.parquet(f"{folder}/blocks").drop(
        "first_id", "last_id", "last_copy", "n_ids")
    starts = spark.read.parquet(f"{folder}/directory").select(
        F.col("part").alias("at_part"), F.col("block").alias("at_block"), F.col("start").alias("base"),
        "edge_id", "edge_copies")

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, copies = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["copies"], "<u4")
                found = _wanted_slices(row, ids, copies)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(found), pa.int32()),
                    "block": pa.array([row["block"]] * len(found), pa.int32()),
                    "doc_id": pa.array([None if i == NO_ID else i for i, *_ in found], pa.int64()),
                    "copy": pa.array([c for _, c, *_ in found], pa.int32()),
                    "offset": pa.array([o for _, _, o, _ in found], pa.int64()),
                    "n_tokens": pa.array([len(x) for *_, x in found], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for *_, x in found], pa.int64())})

    found = blocks.mapInArrow(
        digests, "part int, block int, doc_id long, copy int, offset long, n_tokens long, ids_crc32 long")
    on = (F.col("part") == F.col("at_part")) & (F.col("block") == F.col("at_block"))
    at_edge = F.coalesce("doc_id", F.lit(NO_ID)) == F.col("edge_id")
    copy = F.col("copy") + F.when(at_edge, F.col("edge_copies")).otherwise(0)
    return found.join(starts, on).select(
        "doc_id", copy.alias("copy"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids) of the documents that `wanted` (doc_id) asks for.

    Keys meet blocks over bins of ids, about as many as there are blocks; only the
    blocks they fall into are read into memory, one at a time. Copy 0 is returned, which is
    in the first task that has rows of the id; ids
    that the store lacks are left out, but for a chance of 2^-32 each. Null ids are not
    looked up.
    """
    directory = spark.read.parquet(f"{folder}/directory").where(F.col("last_id") > NO_ID)
    # Ids below the lowest named one can only be in a block that begins with rows without id.
    least = F.when(F.col("first_id") > NO_ID, F.col("first_id")).otherwise(F.col("last_id"))
    span = directory.agg(F.min(least).alias("low"), F.max("last_id").alias("high"),
                         F.count("*").alias("n")).first()
    low, width = span.low or 0, max(1, ((span.high or 0) - (span.low or 0)) // max(1, span.n) + 1)
    # As decimals: the distance of two ids can be beyond 64 bits.
    bin_of = lambda c: F.floor(
        (F.greatest(F.col(c), F.lit(low)).cast("decimal(20,0)") - F.lit(Decimal(low)))
        / F.lit(Decimal(width))).cast("long")
    bins = directory.select("part", "block", "first_id", "last_id", "start", "edge_id",
                            "edge_copies", F.explode(
        F.sequence(bin_of("first_id"), bin_of("last_id"))).alias("bin"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().where(
        "doc_id is not null").withColumn("bin", bin_of("doc_id"))
    placed = (asked.join(bins, "bin").where("doc_id between first_id and last_id")
              .where("edge_copies = 0 or doc_id <> edge_id")
              .groupBy("part", "block", "start").agg(F.collect_list("doc_id").alias("asked")))
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", *_INDEX)

    def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids = np.array(row["asked"], np.int64)
                found = _wanted_slices(row, ids, np.zeros(len(ids), np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([i for i, *_ in found], pa.int64()),
                    "copy": pa.array([c for _, c, *_ in found], pa.int32()),
                    "start": pa.array([row["start"] + o for _, _, o, _ in found], pa.int64()),
                    "n_tokens": pa.array([len(x) for *_, x in found], pa.int64()),
                    "ids": pa.array([x.tobytes() for *_, x in found], pa.binary())})

    return blocks.join(placed, ["part", "block"]).mapInArrow(slices, _READ)
