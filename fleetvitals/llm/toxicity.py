"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word left
out, hashed to 2^20 places. Every place has a learning rate of its own, which falls
with the gradients it has seen, and the L1 penalty keeps the weight of a place at zero
until enough of them agree; what remains is a short list of weights, small enough to
send to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import fold, map_texts, mixed, plain_words, word_hashes

BITS = 20
FOLDS, HELD_OUT = 5, 0
# At most about so many labelled texts are learnt from, chosen by a hash of their id.
TRAIN_ROWS = 10_000
BIAS = 1 << BITS


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal parameters; `positive` is the weight of a text labelled 1."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 15.0
    l2: float = 0.1
    epochs: int = 3
    positive: float = 4.0


def features(text: bytes | None) -> np.ndarray:
    """Distinct places of a text's words, pairs and skip-pairs; none for an empty text."""
    hashes = word_hashes(plain_words(text))
    if not len(hashes):
        return np.zeros(0, np.int64)
    pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    skips = mixed(hashes[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:] + np.uint64(1))
    every = np.concatenate([mixed(hashes), pairs, skips]) >> np.uint64(64 - BITS)
    return every.astype(np.int64)


class Ftrl:
    """The sums of one learner: z of adjusted gradients, n of their squares."""

    def __init__(self, rates: Rates):
        self.rates = rates
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[at]
        l1 = np.where(at == BIAS, 0.0, r.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w.sum()) - label) * (self.rates.positive if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rates.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _fitted(rates: Rates):
    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # 32-bit places, the bias behind them: a row stays the bytes it came as.
        rows = sorted(((draw, label, places) for part in parts for draw, label, places in zip(
            part["draw"], part["label"], part["places"], strict=True)))
        if not rows:
            return
        learner = Ftrl(rates)
        texts = [np.frombuffer(places, "<i4") for _, _, places in rows]
        labels = [label for _, label, _ in rows]
        for epoch in range(rates.epochs):
            for at in np.random.RandomState(epoch).permutation(len(texts)):
                learner.learn(texts[at], labels[at])
        every = np.arange(BIAS + 1)
        weights = learner.weights(every)
        kept = np.flatnonzero(weights)
        yield pd.DataFrame({"place": kept, "weight": weights[kept]})

    return fit


def fit(docs: DataFrame, labels: DataFrame, rates: Rates | None = None,
        train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(place, weight) of a model of labels.toxic, the only column of labels that is used.

    Learns from texts whose id lies in folds 1 to 4, about `train_rows` of them at most,
    chosen by hash of the id; the learner is one task, bounded by that, since of an id in
    several rows one text is learnt from, the smallest by hash. Rows of one id in `labels` are
    positive if one is; null labels and null texts are left out.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label"))
    known = known.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    share = min(1.0, 0.95 * train_rows / max(1, known.count()))
    # The bound on rows is what makes this side fit to send to every executor.
    drawn = F.broadcast(known.withColumn("draw", draw).where(F.col("draw") < share))
    texts = docs.select("doc_id", "text").where("text is not null").join(drawn, "doc_id")
    # Starts in the map tasks: an id that holds a third of all rows comes to one row a task.
    texts = texts.groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"),
        F.max("label").alias("label"), F.max("draw").alias("draw")).select(
            "least.text", "label", "draw")

    def row(text: bytes, label: int, at: float) -> tuple:
        places = np.append(np.unique(features(text)), BIAS)
        return places.astype("<i4").tobytes(), label, at

    rows = map_texts(texts, "places binary, label int, draw double", row, "text", "label", "draw")
    return rows.repartition(1).mapInPandas(_fitted(rates or Rates()), "place int, weight double")


_tables: dict[str, np.ndarray] = {}


def _table(name: str, model: tuple[bytes, bytes]) -> np.ndarray:
    """Weights by place, one table per worker process and model."""
    if name not in _tables:
        _tables.clear()
        table = np.zeros(BIAS + 1)
        table[np.frombuffer(model[0], "<i4")] = np.frombuffer(model[1], "<f8")
        _tables[name] = table
    return _tables[name]


def score(text: bytes | None, weights: np.ndarray) -> float:
    """Probability of label 1; an empty text has that of the bias alone."""
    places = features(text)
    places = np.unique(places[weights[places] != 0])
    return sigmoid(weights[places].sum() + weights[BIAS])


def scored(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`, whole texts; `keep` adds its columns.

    The score is never null: null and empty texts get that of the bias. Repeated rows
    come out as often as they went in.
    """
    rows = model.toPandas()
    sent = docs.sparkSession.sparkContext.broadcast(
        (rows["place"].to_numpy("<i4").tobytes(), rows["weight"].to_numpy("<f8").tobytes()))
    name = f"{hash(sent.value)}"
    names = list(dict.fromkeys([id_col, text_col, *keep]))
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}"
                       for n in names if n != text_col or n in keep)

    def row(*values: object) -> tuple:
        own = dict(zip(names, values, strict=True))
        found = score(own[text_col], _table(name, sent.value))
        kept = [v.decode() if isinstance(v, bytes) else v
                for n, v in own.items() if n != text_col or n in keep]
        return (*kept, found, int(found >= 0.5))

    return map_texts(docs, f"{schema}, score double, predicted int", row, *names)
