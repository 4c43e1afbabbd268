"""Passages that stand more than once in a corpus, found by suffix automata of its parts.

A window is `window` words in a row. Of the short grams in a window the one with the
smallest hash is its anchor, so equal windows have equal anchors, and the windows of a
text fall into segments of neighbours with one anchor. Anchors that occur once need no
further look. The others' segments, each distinct one once with its number of copies,
are the reference; it is dealt by anchor into shards of bounded size. A task builds the
suffix automaton of a shard, with the copies of every substring, and streams the shard's
segments of the documents through it: where the longest match holds a window that occurs
twice or more, the window goes.

All documents are reference and grow with the input, so automata are not sent from the
driver: a shard's automaton is built where its segments are streamed. An anchor with more
than `hot` segments is taken apart into windows, which count as segments of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.session import stored

from .text import BROADCAST_IDS, map_texts, mixed, restricted, slices, word_hashes

WINDOW = 35
GRAM = 12
# An anchor with more distinct segments is taken apart; about 50 words a segment.
HOT_SEGMENTS = 1_000
SHARD_SEGMENTS = 500
# A text with more copies is dealt to several tasks.
COPIES = 200
# Verdicts on up to so many segments are broadcast, about 50 MB.
BROADCAST_VERDICTS = 500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = "anchor long, digest long"


class Hashes:
    """Rolling hashes over the words of one text."""

    def __init__(self, words: list[bytes], window: int):
        n = len(words)
        self.window = window
        self.powers = np.cumprod(np.full(n, _INVERSE, np.uint64))
        rising = np.cumprod(np.full(n, _BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(words) * rising)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of the words from start to before end, and of their number."""
        raw = (self.sums[end] - self.sums[start]) * self.powers[start]
        return mixed(raw + (end - start).astype(np.uint64))

    def segments(self) -> tuple[np.ndarray, ...]:
        """(first window, windows, anchor, digest) of every segment."""
        gram = min(GRAM, self.window)
        n = len(self.powers)
        at = np.arange(n - gram + 1)
        grams = self.of(at, at + gram)
        places = sliding_window_view(grams, self.window - gram + 1).argmin(1)
        places += np.arange(len(places))
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        after = np.append(first[1:], len(places))
        return (first, after - first, grams[places[first]].view(np.int64),
                self.of(first, after - 1 + self.window).view(np.int64))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, digest) of every window as a segment of its own."""
        at = np.arange(len(self.powers) - self.window + 1)
        digest = self.of(at, at + self.window)
        return mixed(digest + np.uint64(1)).view(np.int64), digest.view(np.int64)


class SuffixAutomaton:
    """All substrings of the added sequences, with the number of their occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.occurrences = [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.occurrences.append(0)
        return len(self.link) - 1

    def _shortened(self, p: int, word: int, q: int) -> int:
        """The state of what p spells and `word`, made out of q where q spells more."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def add(self, words: list[int], copies: int) -> None:
        last = 0
        for word in words:
            if (known := self.next[last].get(word)) is not None:
                last = self._shortened(last, word, known)
            else:
                p, last = last, self._state(self.length[last] + 1, 0, {})
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = self._shortened(p, word, self.next[p][word])
            self.occurrences[last] += copies

    def finish(self) -> None:
        """Let shorter substrings count the occurrences of those they end."""
        for state in np.argsort(self.length)[:0:-1].tolist():
            self.occurrences[self.link[state]] += self.occurrences[state]

    def repeated_ends(self, words: list[int], window: int) -> Iterator[int]:
        """Places where a window ends that occurs twice or more, from matching statistics."""
        state = matched = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= window:
                holder = state
                while self.length[self.link[holder]] >= window:
                    holder = self.link[holder]
                if self.occurrences[holder] > 1:
                    yield at


def _places(window: int, single: bool):
    """Segments of texts, or of chosen ones every window, as rows (key, anchor, digest)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            found = []
            chosen = part.column(2).to_pylist() if single else [None] * part.num_rows
            for key, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                         chosen, strict=True):
                words = text.encode().split() if text else []
                if len(words) < window:
                    continue
                hashes = Hashes(words, window)
                first, windows, anchor, digest = hashes.segments()
                if single:
                    inside = _marked(hashes, first, windows, anchor, digest, wanted)
                    anchor, digest = (x[inside] for x in hashes.windows())
                found.append((np.full(len(anchor), key, np.int64), anchor, digest))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)],
                    names=["key", "anchor", "digest"])

    return batches


def _marked(hashes: Hashes, first, windows, anchor, digest, wanted: list[dict]) -> np.ndarray:
    """For every window whether its segment is in `wanted`, and there its bit is set."""
    marks = np.zeros(len(hashes.powers) - hashes.window + 1, bool)
    bits = {(w["anchor"], w["digest"]): w["bits"] for w in wanted}
    for at, n, own in zip(first.tolist(), windows.tolist(),
                          zip(anchor.tolist(), digest.tolist(), strict=True), strict=True):
        if held := bits.get(own):
            marks[at:at + n] = [held >> k & 1 for k in range(n)]
    return marks


def _repeated(places: DataFrame) -> DataFrame:
    """The places whose anchor has another place."""
    anchors = stored(places.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    return stored(restricted(places, anchors, "anchor"), "repeated")


def _distinct(places: DataFrame) -> DataFrame:
    """(anchor, digest, copies, key): every segment once, with a text that holds it."""
    return stored(places.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.min("key").alias("key")), "segments")


def _one_of_each(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, list of texts, list) of the keys in `lists`; copies of a text come once."""
    needed = restricted(texts.select("key", "text"), lists.select("key"), "key")
    return needed.groupBy("key").agg(F.collect_set("text").alias("texts")).join(lists, "key")


def _segment_texts(window: int):
    """Rows (shard, anchor, digest, copies, words) of the segments a text stands for."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            rows = []
            for texts, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                     strict=True):
                waiting = {(w["single"], w["anchor"], w["digest"]): w for w in wanted}
                for text in texts:
                    rows += _found_segments(text.encode().split(), window, waiting)
            for at in range(0, len(rows), 4096):
                columns = list(zip(*rows[at:at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if k == 5 else pa.bool_() if k == 1 else pa.int64())
                     for k, c in enumerate(columns)],
                    names=["shard", "single", "anchor", "digest", "copies", "words"])

    return batches


def _found_segments(words: list[bytes], window: int, waiting: dict) -> list[tuple]:
    if len(words) < window:
        return []
    hashes = Hashes(words, window)
    first, windows, anchor, digest = hashes.segments()
    kinds = [(False, first.tolist(), (first + windows - 1 + window).tolist(), anchor, digest)]
    if any(single for single, _, _ in waiting):
        at = np.arange(len(words) - window + 1)
        kinds.append((True, at.tolist(), (at + window).tolist(), *hashes.windows()))
    rows = []
    for single, starts, ends, anchors, digests in kinds:
        for a, b, x, y in zip(starts, ends, anchors.tolist(), digests.tolist(), strict=True):
            if w := waiting.pop((single, x, y), None):
                rows.append((w["shard"], single, x, y, w["copies"], b" ".join(words[a:b]).decode()))
    return rows


def _verdicts(window: int):
    """The repeated windows of every segment of one shard, as bits."""
    def judge(shard: pa.Table) -> pa.Table:
        automaton, numbers, own, segments = SuffixAutomaton(), {}, [], {}
        for single, anchor, digest, copies, text in zip(
                *(shard.column(c).to_pylist() for c in
                  ("single", "anchor", "digest", "copies", "words")), strict=True):
            # Texts that share a hash may both send a segment.
            segments[single, anchor, digest] = copies, text
        for key, (copies, text) in sorted(segments.items()):
            words = [numbers.setdefault(w, len(numbers)) for w in text.encode().split()]
            automaton.add(words, copies)
            own.append((key, words))
        automaton.finish()
        found = []
        for key, words in own:
            bits = sum(1 << (end - window + 1) for end in automaton.repeated_ends(words, window))
            if bits:
                found.append((*key, bits))
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table({"single": pa.array(columns[0], pa.bool_())} | {
            name: pa.array(columns[k], pa.int64())
            for k, name in enumerate(("anchor", "digest", "bits"), 1)})

    return judge


def repeated_segments(
    texts: DataFrame, copied: DataFrame, window: int, hot: int, shard_segments: int,
) -> DataFrame:
    """(key, found): for the keys of texts (key, row, text) with repeated windows, their segments.

    `found` lists segments (single, anchor, digest) with the bits of their repeated windows.
    """
    places = stored(texts.select("key", "text").mapInArrow(
        _places(window, False), f"key long, {_SEGMENT}"), "places")
    places = _repeated(places)
    segments = _distinct(places)
    many = stored(segments.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"),
                  "hot-anchors")
    places = places.withColumn("single", F.lit(False))
    segments = segments.withColumn("single", F.lit(False))
    if not many.isEmpty():
        taken = restricted(places, many, "anchor").groupBy("key").agg(F.collect_set(
            F.struct("anchor", "digest", F.lit(-1).alias("bits"))).alias("wanted"))
        taken = stored(taken, "hot-places")
        windows = stored(_with_lists(texts, taken, copied).select("key", "text", "wanted").mapInArrow(
            _places(window, True), f"key long, {_SEGMENT}"), "windows")
        windows = _repeated(windows)
        places = restricted(places, many, "anchor", "left_anti").unionByName(
            windows.withColumn("single", F.lit(True)))
        segments = restricted(segments, many, "anchor", "left_anti").unionByName(
            _distinct(windows).withColumn("single", F.lit(True)))
        segments, places = stored(segments, "segments"), stored(places, "repeated")
    shards = -(-segments.count() // shard_segments) or 1
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    lists = stored(segments.groupBy("key").agg(F.collect_list(F.struct(
        shard, "single", "anchor", "digest", "copies")).alias("wanted")), "sent")
    sent = _one_of_each(texts, lists).select("texts", "wanted").mapInArrow(
        _segment_texts(window), f"shard long, single boolean, {_SEGMENT}, copies long, words string")
    verdicts = stored(sent.groupBy("shard").applyInArrow(
        _verdicts(window), f"single boolean, {_SEGMENT}, bits long"), "verdicts")
    if verdicts.count() <= BROADCAST_VERDICTS:
        verdicts = F.broadcast(verdicts)
    return stored(places.join(verdicts, ["single", "anchor", "digest"]).groupBy("key").agg(
        F.collect_set(F.struct("single", "anchor", "digest", "bits")).alias("found")), "found")


def _copied(texts: DataFrame) -> DataFrame:
    """(key, parts) of texts with many copies: into how many parts their rows are dealt."""
    counts = texts.groupBy("key").count().where(F.col("count") > COPIES)
    return stored(counts.select("key", (F.col("count") / COPIES).cast("long").alias("parts")), "copied")


def _with_lists(texts: DataFrame, lists: DataFrame, copied: DataFrame) -> DataFrame:
    """Rows of the texts whose keys have a list, with it; the rows of a text with many
    copies go to many tasks, and the list to all of them."""
    spread = lists.join(copied, "key", "left").withColumn("part", F.explode(
        F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    if copied.count() <= BROADCAST_IDS:
        copied = F.broadcast(copied)
    rows = restricted(texts, lists.select("key"), "key").join(copied, "key", "left")
    part = F.coalesce(F.pmod("row", "parts"), F.lit(0).cast("long"))
    return rows.withColumn("part", part).join(spread, ["key", "part"])


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    hot: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS,
) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of every row of `docs`.

    Words are what stands between ASCII white space (0x20, 0x09 to 0x0D), unchanged. A word
    goes if a window of `window` words that holds it also starts at another place of any
    row, its own text and equal rows included. `removed` are the maximal runs of words that
    went, as word numbers; `kept` is the rest, joined by single spaces. Null, empty and
    shorter texts lose nothing. Repeated rows and rows without id come out as often as they
    went in; other columns are not read. Segments are told apart by 128 bits of hashes.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("key"), F.monotonically_increasing_id().alias("row"))
    copied = _copied(texts)
    found = repeated_segments(texts, copied, window, hot, shard_segments)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, n_removed long, "
              "removed array<struct<word_from:long,word_to:long>>, kept string")

    def row(doc_id: object, text: bytes | None, marked: list[dict] | None = None) -> tuple:
        words = text.split() if text else []
        if not marked or len(words) < window:
            return doc_id, len(words), 0, [], b" ".join(words).decode()
        gone = _covered(Hashes(words, window), marked)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        spans = [{"word_from": a, "word_to": b}
                 for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return doc_id, len(words), len(words) - len(left), spans, b" ".join(left).decode()

    untouched = restricted(texts, found.select("key"), "key", "left_anti")
    touched = _with_lists(texts, found, copied)
    return map_texts(untouched, schema, row, "doc_id", "text").unionByName(
        map_texts(touched, schema, row, "doc_id", "text", "found"))


def _covered(hashes: Hashes, marked: list[dict]) -> np.ndarray:
    """1 for every word in a repeated window, else 0."""
    marks = _marked(hashes, *hashes.segments(), [m for m in marked if not m["single"]])
    single = {(m["anchor"], m["digest"]) for m in marked if m["single"]}
    if single:
        anchors, digests = hashes.windows()
        marks |= np.fromiter(map(single.__contains__, zip(anchors.tolist(), digests.tolist())),
                             bool, len(marks))
    edges = np.zeros(len(hashes.powers) + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + hashes.window, -1)
    return (np.cumsum(edges[:-1]) > 0).astype(np.int8)
