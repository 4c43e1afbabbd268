"""Benchmark passages in documents, found by one Aho-Corasick automaton over words.

The windows of all items (ten words in a row; a shorter item is one window) are the
patterns. A pattern is a sequence of word numbers, so the automaton has a node per
word of a window, not per character, and its matches end at word positions, from
which the offsets in the original text follow. A text is scanned once.

The automaton goes to every executor, so its size is bounded: items are cut into pieces
that overlap by a window less a word, equal pieces count once, and by the running size
of the pieces they are dealt into parts of PART_BYTES and a piece at most, each with an
automaton and a scan of its own. Neither an item that has most rows nor one that has
most of the text makes a larger part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.session import stored

from .text import as_list, map_texts, plain_words, slices

WINDOW = 10
PART_BYTES = 2 << 20
PIECE_BYTES = 64 << 10
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RUN = "array<struct<word_from:int,word_to:int,start:int,end:int>>"
_FOUND = f"n_words long, items array<string>, runs {_RUN}"


class Automaton:
    """The windows of items over numbered words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1)
                     for w in plain_words((text or "").encode())]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[at:at + window]), set()).add(item)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, named in owners.items():
            self.found.add_word(pattern, (len(pattern), tuple(named)))
        self.empty = not owners
        if owners:
            self.found.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[str], list[tuple]]:
        """Number of words, ids of items with a window in the text, and the runs of hit words."""
        words = plain_words(text)
        if not words or self.empty:
            return len(words), [], []
        number = self.numbers.get
        named: set[str] = set()
        edges = None
        for last, (length, owners) in self.found.iter(tuple([number(w, 0) for w in words])):
            if edges is None:
                edges = np.zeros(len(words) + 1, np.int64)
            edges[last - length + 1] += 1
            edges[last + 1] -= 1
            named.update(owners)
        return len(words), sorted(named), [] if edges is None else _runs(edges, text)


def _runs(edges: np.ndarray, text: bytes) -> list[tuple]:
    """(first word, word after, first character, character after) of every run of hit words."""
    hit = np.cumsum(edges[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    at = [m.span() for m in ORIGINAL_WORD.finditer(text.decode())]
    return [(int(a), int(b), at[a][0], at[b - 1][1])
            for a, b in zip(turns[::2], turns[1::2], strict=True)]


_built: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str, str]], window: int) -> Automaton:
    """One automaton per worker process and part."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(doc_id, n_words, items, runs) of every row of `docs`.

    `items` are the ids, as sorted strings, of items with a window in the text; `runs`
    the maximal runs of hit words with their places in the original text, as word
    numbers and as code points. Null and wordless texts have no words and no hits.
    Items without an id or without words take no part, rows of one item id add up. The
    items' pieces are collected a part at a time, each bounded by `part_bytes` and a piece.
    Repeated rows come out as often as they went in. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("string").alias("item"),
                         F.col(item_text).alias("words")).where("item is not null")
    dealt = stored(_parts(_pieces(items, window), part_bytes), "item-parts")
    parts = (dealt.agg(F.max("at")).first()[0] or 0) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    if parts == 1:
        return _scanned(docs, dealt, window, f"doc_id {kind}, {_FOUND}", "doc_id")
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = None
    for part in range(parts):
        one = _scanned(docs, dealt.where(F.col("at") == part), window, f"row long, {_FOUND}", "row")
        found = one if found is None else found.unionByName(one)
    together = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
    ).mapInPandas(_merged, f"row long, {_FOUND}")
    return docs.select("row", "doc_id").join(together, "row").drop("row")


def _cut(words: list[bytes], window: int, piece_bytes: int) -> Iterator[bytes]:
    """The words in pieces of about `piece_bytes`, each window whole in one of them."""
    first, size = 0, 0
    for at, word in enumerate(words):
        size += len(word) + 1
        if size >= piece_bytes and at + 1 - first >= 2 * window and at + 1 < len(words):
            yield b" ".join(words[first:at + 1])
            first = at + 2 - window
            size = sum(len(w) + 1 for w in words[first:at + 1])
    if words:
        yield b" ".join(words[first:])


def _pieces(items: DataFrame, window: int, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(item, words) with the pieces of all items, equal ones once.

    A piece has at least twice as many words as a window, so it is longer than
    `piece_bytes` only where words are; an item has a window, if it has words.
    """
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            for item, text in zip(*[as_list(c) for c in part.columns], strict=True):
                for piece in _cut(plain_words(text), window, piece_bytes):
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([item.decode()]), "words": pa.array([piece.decode()])})

    return items.mapInArrow(cut, "item string, words string").distinct()


def _parts(pieces: DataFrame, part_bytes: int) -> DataFrame:
    """The pieces with the part (`at`, from 0) that their running size gives.

    Sizes are summed inside each stored partition and over the partitions' totals.
    """
    pieces = stored(pieces.select("item", "words", F.octet_length("words").cast("long").alias("size"),
                                  F.spark_partition_id().alias("part")), "pieces")
    totals = pieces.groupBy("part").agg(F.sum("size").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy(
        "item", F.xxhash64("words"), "words").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.withColumn("inside", inside).join(totals, "part").select(
        "item", "words", F.floor((F.col("base") + F.col("inside")) / part_bytes).cast("int").alias("at"))


def _scanned(docs: DataFrame, items: DataFrame, window: int, schema: str, key: str) -> DataFrame:
    rows = sorted((r.item, r.words) for r in items.collect())
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    name = f"{hash((tuple(rows), window))}"

    def row(own: object, text: bytes | None) -> tuple:
        return own, *_automaton(name, sent.value, window).scan(text)

    return map_texts(docs, schema, row, key, "text")


def _merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of several scans of one text as maximal runs."""
    for part in parts:
        runs = []
        for row in part["runs"]:
            joined: list[list[int]] = []
            for run in row:
                a, b, start, end = (int(run[n]) for n in ("word_from", "word_to", "start", "end"))
                if joined and a <= joined[-1][1]:
                    if b > joined[-1][1]:
                        joined[-1][1], joined[-1][3] = b, end
                else:
                    joined.append([a, b, start, end])
            runs.append([dict(zip(("word_from", "word_to", "start", "end"), x, strict=True))
                         for x in joined])
        yield part.assign(runs=runs, items=[sorted(set(x)) for x in part["items"]])


def hit_words(runs: str = "runs"):
    """Number of words in the runs."""
    return F.aggregate(F.col(runs), F.lit(0).cast("long"),
                       lambda n, run: n + (run["word_to"] - run["word_from"]).cast("long"))
