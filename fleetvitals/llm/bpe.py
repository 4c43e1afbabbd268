"""Exact BPE ids of whole texts from encoded pieces, and their decoding.

Content-defined chunks: a rolling hash over the characters cuts a text where the
hash of the last eight characters has six zero bits, so equal passages of different
documents are cut alike, and a chunk is encoded once and reused from a table. A
chunk's own ids are right only between sync points, places where the tokenizer
always parts a text whatever stands around: before a blank or line feed that follows
a character other than white space. So a chunk is stored as the ids between its first and
last sync point and the text outside; at every join the text from the last sync point
of one chunk to the first of the next is encoded anew, over as many chunks as it takes
to reach one. From sync point to sync point the ids agree with those of the whole text.

Pieces of plain Latin text are parted by the tokenizer's rule and looked up word by
word; anything else goes through the library's own encode.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .text import map_texts

# The pre-tokenizers' rules for characters of PLAIN (fixed by the tokenizer files).
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ÿ]*")
BYTE_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+"
    rf"| ?[^\t\n\r {LETTER}{NUMBER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
WORD_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\t\n\r {LETTER}{NUMBER}]+")
# These stand for themselves in byte-level vocabularies.
ASCII_PRINTED = re.compile(r"[!-~]*")
SYNC = re.compile(r"(?<=\S)[ \n]")

WINDOW, CUT_BITS = 8, 6
WORDS_KEPT, CHUNKS_KEPT = 200_000, 20_000
# Longer runs between blanks are parted each time they come.
RUN_CHARS = 64
_ODD = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


class Kept(dict):
    """A table that makes what it lacks, and starts anew when full; longer keys are not kept."""

    def __init__(self, make: Callable, limit: int, longest: float = float("inf")):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: str) -> object:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Encoder:
    """Ids of texts as a tokenizer file gives them, as little-endian 16 or 32-bit numbers."""

    def __init__(self, path: str, pieces: re.Pattern, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.pieces, self.lower = pieces, lower
        self.letters = _byte_letters()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.words = Kept(self._word, WORDS_KEPT)
        self.runs = Kept(self._run, WORDS_KEPT, RUN_CHARS)
        self.spans = Kept(self.encode, CHUNKS_KEPT)
        self.chunks = Kept(self._chunk, CHUNKS_KEPT)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _word(self, piece: str) -> bytes:
        mapped = piece if ASCII_PRINTED.fullmatch(piece) else "".join(
            [self.letters[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(mapped)]
        # Of the few ids of a word in less time than by an array.
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def _run(self, run: str) -> bytes:
        """The ids of a text without special tokens, as far as the pieces' rule holds."""
        return b"".join(map(self.words.__getitem__, self.pieces.findall(run)))

    def encode(self, text: str) -> bytes:
        """The ids of a text that starts and ends at sync points, or is whole."""
        if PLAIN.fullmatch(text) and not self.special.search(text):
            if self.lower:
                # No piece of a word tokenizer holds white space, so runs between it are kept whole.
                return b"".join(map(self.runs.__getitem__, text.lower().split()))
            return self._run(text)
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> tuple[str, bytes, str] | None:
        """(text before the first sync point, ids, text after the last), or None without any."""
        points = [m.start() for m in SYNC.finditer(chunk)]
        if not points:
            return None
        first, last = points[0], points[-1]
        return chunk[:first], self.encode(chunk[first:last]), chunk[last:]

    def encode_chunks(self, text: str) -> bytes:
        out, open_span = [], []
        for start, stop in chunk_places(text):
            chunk = text[start:stop]
            kept = self.chunks[chunk]
            if kept is None:
                open_span.append(chunk)
                continue
            head, ids, tail = kept
            # The last character before a join may be white space: no sync point there.
            out.append(self.spans["".join([*open_span, head])])
            out.append(ids)
            open_span = [tail]
        out.append(self.spans["".join(open_span)])
        return b"".join(out)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id decodes to."""
        back = {letter: b for b, letter in enumerate(self.letters)}
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        return [bytes([back[c] for c in name]) if all(c in back for c in name)
                else name.encode() for name in names]


def chunk_places(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the content-defined chunks of a text, in order and without gaps."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = len(codes)
    if size <= WINDOW:
        return [(0, size)] if size else []
    last = size - WINDOW + 1
    rolled = np.zeros(last, np.uint64)
    for place, odd in enumerate(_ODD):
        rolled += codes[place:place + last] * odd
    rolled ^= rolled >> np.uint64(29)
    rolled *= _ODD[0]
    cuts = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    edges = [0, *cuts.tolist()]
    if edges[-1] != size:
        edges.append(size)
    return list(zip(edges[:-1], edges[1:], strict=True))


_encoders: dict[str, Encoder] = {}
_tables: dict[str, list[bytes]] = {}


def byte_encoder(path: str) -> Encoder:
    """One encoder per worker process and file of a byte-level tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, BYTE_PIECES, lower=False)
        _tables[path] = _encoders[path].token_bytes()
    return _encoders[path]


def word_encoder(path: str) -> Encoder:
    """One encoder per worker process and file of a lower-casing word tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, WORD_PIECES, lower=True)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids as little-endian unsigned 32-bit numbers.

    A null text is encoded as the empty one. Other columns are not read.
    """
    def row(doc_id: object, text: bytes | None) -> tuple:
        encoder = byte_encoder(path)
        ids = encoder.encode_chunks((text or b"").decode())
        return doc_id, np.frombuffer(ids, encoder.kind).astype("<u4").tobytes()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, f"doc_id {kind}, ids binary", row, id_col, text_col)


def decoded_text(ids: np.ndarray, path: str) -> bytes:
    """The text of ids, in UTF-8; bytes that are no UTF-8 become U+FFFD."""
    byte_encoder(path)
    raw = b"".join(map(_tables[path].__getitem__, ids.tolist()))
    return raw.decode("utf-8", "replace").encode()


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids as `encoded` returns them."""
    def row(doc_id: object, ids: bytes | None) -> tuple:
        return doc_id, decoded_text(np.frombuffer(ids or b"", "<u4"), path).decode()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, f"doc_id {kind}, text string", row, "doc_id", "ids")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `docs`.

    Encoding, decoding of those ids and both digests in one pass, so that ids do not
    leave the task. Null texts are empty; repeated rows come out as often as they went in.
    """
    def row(doc_id: object, text: bytes | None) -> tuple:
        encoder = byte_encoder(path)
        ids = np.frombuffer(encoder.encode_chunks((text or b"").decode()), encoder.kind)
        back = decoded_text(ids, path)
        return (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(back).hexdigest())

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(
        docs, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
        row, id_col, text_col)
