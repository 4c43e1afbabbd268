"""Alignment of the tokens of two tokenizers, and how often which tokens end together.

Both tokenizers cover the same bytes, so their tokens are two rising arrays of end
offsets. Where both arrays hold the same offset a group ends. Along a stretch of
one-to-one groups the two indices differ by a constant shift: blocks of doubling, then
halving width are compared at that shift, which jumps the stretch. Where the ends part,
the group is resolved token by token, and the shift is what it leaves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetvitals.session import stored

from .text import BROADCAST_IDS, map_texts

# Longer texts are encoded in pieces that start where both tokenizers always part.
PIECE_CHARS = 1 << 16
_PARTING = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
# Characters whose classes are the same in every Unicode version.
_COMMON = re.compile("[\t\n\r -~¡-¬®-ɏ]*")
# How the byte-level vocabulary parts words, and how it writes bytes as characters.
_BYTE_WORDS = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BLANK = "▁"


@dataclass(frozen=True)
class Groups:
    """Index of the last token of every group, in either array."""

    a_last: np.ndarray
    b_last: np.ndarray


def aligned(a_ends: list[int], b_ends: list[int]) -> Groups:
    """Groups of two arrays of rising ends that close with the same offset."""
    # Stretches of one-to-one groups: token of a that ends the first, shift to b, number of groups.
    firsts: list[int] = []
    shifts: list[int] = []
    runs: list[int] = []
    i, shift, n = 0, 0, len(a_ends)
    while i < n:
        j = i + shift
        x, y = a_ends[i], b_ends[j]
        if x == y:
            width, run = 1, 1
            while (part := a_ends[i + run:i + run + width]) and (
                    part == b_ends[j + run:j + run + width]):
                run += len(part)
                width *= 2
            while width := width >> 1:
                part = a_ends[i + run:i + run + width]
                if part and part == b_ends[j + run:j + run + width]:
                    run += len(part)
            firsts.append(i)
            shifts.append(shift)
            runs.append(run)
            i += run
            continue
        while x != y:
            if x < y:
                i += 1
                x = a_ends[i]
            else:
                j += 1
                y = b_ends[j]
        # The group that closes here begins the next stretch, at the shift it leaves.
        shift = j - i
    lengths = np.array(runs, np.int64)
    before = np.cumsum(lengths) - lengths
    a_last = np.arange(lengths.sum()) + np.repeat(np.array(firsts, np.int64) - before, lengths)
    return Groups(a_last, a_last + np.repeat(np.array(shifts, np.int64), lengths))


def _byte_of() -> dict[str, int]:
    """Byte of every character of a byte-level vocabulary: printed ones stand for themselves."""
    others = [b for b in range(256) if b not in set(_PRINTED)]
    return ({chr(b): b for b in _PRINTED}
            | {chr(256 + k): b for k, b in enumerate(others)})


class Pair:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, byte_file: str, piece_file: str):
        self.library = Tokenizer.from_file(byte_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        byte_of, vocabulary = _byte_of(), self.library.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            self.a_bytes[at] = token.encode() if token in added else bytes(map(byte_of.__getitem__, token))
        ranks = {self.a_bytes[at]: at for token, at in vocabulary.items() if token not in added}
        self.common = tiktoken.Encoding(
            "common", pat_str=_BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.b_bytes = []
        for at in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(at)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(at)
                                else piece.replace(_BLANK, " ").encode())
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        # Every token inside its side of a group and at its end; those of b from `b_marks` on.
        self.marks = [f"{at}{mark}" for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                      for at in range(size) for mark in ends]
        self.b_marks = 2 * len(self.a_bytes)

    def _byte_ids(self, text: str) -> list[int]:
        # Both encoders give the same ids; on characters of every Unicode version the second is faster.
        if _COMMON.fullmatch(text):
            return self.common.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of space + text by either tokenizer; none where one of them changes the bytes."""
        a: list[int] = []
        b: list[int] = []
        if text:
            for piece in parted(text):
                a += self._byte_ids(" " + piece)
                b += self.pieces.encode(piece)
        whole = b" " + text.encode()
        if (b"".join(map(self.a_bytes.__getitem__, a)) != whole
                or b"".join(map(self.b_bytes.__getitem__, b)) != whole):
            return [], []
        return a, b


def parted(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, without the spaces between them."""
    start = 0
    while len(text) - start > size and (place := _PARTING.search(text, start + size)):
        yield text[start:place.start()]
        start = place.end()
    yield text[start:]


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(byte_file: str, piece_file: str) -> Pair:
    """One pair per worker process."""
    if (byte_file, piece_file) not in _pairs:
        _pairs[byte_file, piece_file] = Pair(byte_file, piece_file)
    return _pairs[byte_file, piece_file]


def _groups_text(a_ids: np.ndarray, b_ids: np.ndarray, groups: Groups, pair: Pair) -> str:
    """`a1,a2|b1;a3|b2,b3`: the tokens of every group.

    The names of tokens stand in `pair.marks` with what follows them.
    """
    a_last, b_last = groups.a_last, groups.b_last
    a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    a_marks, b_marks = 2 * a_ids, 2 * b_ids
    a_marks[a_last] += 1
    b_marks[b_last] += 1
    # Before a token stand those of its own side, and those of the other in the groups before;
    # before one of b also those of a in its own group.
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    order[np.arange(len(a_ids)) + np.repeat(b_last + 1 - b_sizes, a_sizes)] = a_marks
    order[np.arange(len(b_ids)) + np.repeat(a_last + 1, b_sizes)] = b_marks + pair.b_marks
    return "".join(map(pair.marks.__getitem__, order.tolist()))[:-1]


def alignments(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_text, pairs, times) of every row of `docs`.

    A pair is a token of either tokenizer that end together, as a_id * (number of b ids)
    + b_id; `pairs` are the distinct ones of the text in order, `times` how often each
    occurs. `groups_text` names the tokens of every group. Texts that are null or empty,
    or whose bytes a tokenizer changes, have no tokens, zeros and ''. Repeated rows and
    rows without id come out as often as they went in; other columns are not read.
    """
    def row(doc_id: object, text: bytes | None) -> tuple:
        pair = tokenizer_pair(byte_file, piece_file)
        a, b = pair.encoded(text.decode()) if text else ([], [])
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        groups = aligned(np.cumsum(pair.a_sizes[a_ids]).tolist(),
                         np.cumsum(pair.b_sizes[b_ids]).tolist())
        named = _groups_text(a_ids, b_ids, groups, pair)
        ends = a_ids[groups.a_last] * len(pair.b_bytes) + b_ids[groups.b_last] if a else a_ids
        pairs, times = np.unique(ends, return_counts=True)
        return doc_id, len(a), len(b), len(groups.a_last), named, pairs, times

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(
        docs, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_text string, "
        "pairs array<long>, times array<long>", row, id_col, text_col)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, total, best): links of a pair in all rows, and whether no pair of its b has more."""
    totals = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(
        F.col("pairs").alias("pair")).agg(F.sum("times").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pair") % b_size))
    return totals.withColumn("best", (F.col("total") == most).cast("long"))


def with_pair_sums(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """`rows` (with `key` unique) and, over their links, n_best and count_sum.

    The counts are few where tokens are few: they are counted, and broadcast up to
    BROADCAST_IDS rows, which leaves the links where they are; beyond that both sides
    are shuffled by pair.
    """
    if counts.count() <= BROADCAST_IDS:
        counts = F.broadcast(counts)
    links = rows.select(key, F.inline(F.arrays_zip("pairs", "times")))
    sums = links.join(counts, F.col("pairs") == F.col("pair")).groupBy(key).agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"),
        F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    return rows.join(sums, key, "left").na.fill(0, ["n_best", "count_sum"])


def cross_alignment(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Every group ends with one link. `n_best` are the links whose pair has the most links
    of its b id in all rows, ties included; `count_sum` adds those counts up. The digest
    is '' for a text without tokens. What rows of an odd kind give: see `alignments`.
    """
    found = alignments(docs, byte_file, piece_file, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups_text").cast("binary"), 256)).otherwise("")
    rows = stored(found.select(
        F.monotonically_increasing_id().alias("row"), "*", digest.alias("groups_sha256"),
    ).drop("groups_text"), "alignments")
    b_size = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    counts = stored(pair_counts(rows, b_size), "pair-counts")
    return with_pair_sums(rows, counts, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best",
        "count_sum", "groups_sha256")
