"""Periodic runs of words: stretches that repeat themselves with some period.

One pass over the words of a text keeps the active lags. A lag is a distance to an
earlier occurrence; its match length grows with every word that equals the one a lag
before it (a diagonal of the sparse matrix of equal words). A diagonal that ends with
a sufficient length is a run, and is given out at once.

Three rules keep the table of lags small, none of which loses a run:

- A run of length max(12, 2 * period) matches six words or more on its lag, so a lag
  starts only where the next six words have an earlier occurrence, and only where the
  word before differs, as otherwise it had started before.
- A lag needs as many matches as it is long. Prefix sums of a rolling hash tell whether
  the words between the two occurrences come again; the pass itself then compares words.
- A lag that is a multiple of an active lag whose stretch reaches as far back has the
  same stretch, and its period is not the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import map_texts, mixed

LEAST_WORDS = 12
LEAST_PERIODS = 2
# Matches that every run has on its lag: max(12, 2 * q) - q is never less.
SEED_WORDS = LEAST_WORDS // LEAST_PERIODS
PAIRS_AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start:long,length:long,period:long>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0."""
    number = dict(zip(dict.fromkeys(words), count()))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _seed_groups(numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, word before each) of every seed that follows different words."""
    wide = mixed(numbers.astype(np.uint64) + np.uint64(1))
    seeds = np.zeros(len(numbers) - SEED_WORDS + 1, np.uint64)
    for step in range(SEED_WORDS):
        seeds = seeds * _BASE + wide[step:len(seeds) + step]
    order = np.argsort(seeds, kind="stable")
    ordered = seeds[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if len(first) == len(ordered):
        return
    before = np.concatenate([[-1], numbers[:-1]])[order]
    parted = np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)
    ends = np.append(first[1:], len(ordered))
    for a, b in zip(first[parted].tolist(), ends[parted].tolist(), strict=True):
        yield order[a:b], before[a:b]


def _starts(numbers: np.ndarray) -> dict[int, list[int]]:
    """Place: the lags whose diagonal begins there and may become a run."""
    n = len(numbers)
    if n < LEAST_WORDS:
        return {}
    sums = powers = None
    found: dict[int, list[int]] = {}
    for places, before in _seed_groups(numbers):
        if sums is None:
            powers = np.cumprod(np.full(n, _BASE, np.uint64))
            words = mixed(numbers.astype(np.uint64) + np.uint64(0x51ED27))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
        for value in np.unique(before):
            mine, others = places[before == value], places[before != value]
            for some in np.array_split(mine, 1 + mine.size * others.size // PAIRS_AT_ONCE):
                lags = some[:, None] - others[None, :]
                row, _ = keep = np.nonzero((lags > 0) & (some[:, None] + lags <= n))
                at, lag = some[row], lags[keep]
                again = ((sums[at] - sums[at - lag]) * powers[lag - 1]
                         == sums[at + lag] - sums[at])
                for i, q in zip(at[again].tolist(), lag[again].tolist(), strict=True):
                    found.setdefault(i, []).append(q)
    return found


def runs_of(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run, by start and period."""
    starts = _starts(numbers)
    if not starts:
        return []
    word, n = numbers.tolist(), len(numbers)
    waiting = sorted(starts, reverse=True)
    active: dict[int, int] = {}
    first: dict[int, int] = {}
    runs = []

    def end(lag: int) -> None:
        matched, start = active.pop(lag), first.pop(lag)
        length = matched + lag
        if length >= LEAST_WORDS and length >= LEAST_PERIODS * lag:
            runs.append((start, length, lag))

    at = 0
    while active or waiting:
        if not active:
            at = waiting[-1]
        if at == n:
            for lag in list(active):
                end(lag)
            break
        ended = []
        for lag in active:
            if word[at] == word[at - lag]:
                active[lag] += 1
            else:
                ended.append(lag)
        for lag in ended:
            end(lag)
        if waiting and waiting[-1] == at:
            waiting.pop()
            for lag in starts[at]:
                if not any(lag % d == 0 and first[d] <= at - lag for d in active):
                    active[lag], first[lag] = 1, at - lag
        at += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays when only the first period of every run does."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def collapsed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of `docs`.

    Words are what stands between ASCII white space (0x20, 0x09 to 0x0D), unchanged.
    `runs` are all maximal runs by start and period, with start, length and smallest
    period as word numbers; `collapsed` is the text without the words after the first
    period of any run, joined by single spaces. Null, empty and blank texts have no words,
    no runs and an empty collapsed text. Repeated rows come out as often as they went in,
    rows without id as well; other columns are not read.
    """
    def row(doc_id: object, text: bytes | None) -> tuple:
        words = text.split() if text else []
        runs = runs_of(word_numbers(words))
        if runs:
            stays = kept_words(len(words), runs).tolist()
            words_left = [w for w, k in zip(words, stays, strict=True) if k]
        else:
            words_left = words
        named = [{"start": a, "length": b, "period": q} for a, b, q in runs]
        return doc_id, len(words), named, b" ".join(words_left).decode()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed string",
                     row, id_col, text_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids a text that ends in a run.

    With h = crc32 of the id as text and g = floor(h / 10): where h % 10 = 0, of n words
    each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    parts = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), g.alias("g"))

    def looped(x: Column) -> Column:
        a = x["g"] % x["n"]
        p = 1 + F.floor((x["n"] - a) / (3 + x["g"] % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(x["w"], place(i).cast("int"))),
            " ")

    # One-element arrays let the words be computed once.
    changed = F.transform(F.array(parts), lambda x: F.when(x["n"] > 0, looped(x)))[0]
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)
