"""Words of texts as bytes, their hashes, and small helpers of several operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)
# Everything in ASCII but letters and digits parts words; UTF-8 bytes from 0x80 on are parts of them.
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
TO_WORDS = bytes.maketrans(UPPER + _MARKS, LOWER + b" " * len(_MARKS))

# Up to so many rows of one id, about 32 MB, a list of ids is sent to every executor.
BROADCAST_IDS = 2_000_000


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D), A-Z as a-z; null has none."""
    return text.translate(TO_LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z; null has none."""
    return text.translate(TO_WORDS).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a multiply and shift finaliser)."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def map_texts(
    df: DataFrame, schema: str, row: Callable[..., tuple], *columns: str,
) -> DataFrame:
    """`row` of the given columns of each row, a batch at a time; texts arrive as UTF-8 bytes."""
    kinds = df.sparkSession.createDataFrame([], schema).schema
    names = kinds.fieldNames()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        for part in slices(parts):
            lists = [as_list(part.column(i)) for i in range(part.num_columns)]
            rows = list(map(row, *lists))
            out = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[i], target.field(i).type) for i in range(len(names))], schema=target)

    return df.select(*columns).mapInArrow(batches, kinds)


# So many rows at a time become Python objects.
SLICE_ROWS = 256


def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, which bounds what a worker holds beside a batch."""
    for part in parts:
        for first in range(0, part.num_rows, SLICE_ROWS):
            yield part.slice(first, SLICE_ROWS)


def as_list(column: pa.Array) -> list:
    """A column's values; texts as UTF-8 bytes, which spares decoding them."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def restricted(
    df: DataFrame, ids: DataFrame, name: str, how: str = "left_semi"
) -> DataFrame:
    """The rows whose `name` stands in `ids` (its only column, distinct), or the others
    with `how` "left_anti".

    The ids are counted: few enough are broadcast, which leaves the wide rows where
    they are; beyond that bound both sides are shuffled.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, name, how)


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds
