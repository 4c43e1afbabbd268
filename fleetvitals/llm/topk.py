"""Exact top-k inner products by an impact-ordered index, processed score at a time.

Vectors of integers are dealt into shards. In a shard every dimension is quantised
into levels; the vectors of one dimension and level are a posting segment. For a
query a segment has one impact: what its level adds to the score beyond the lowest
level of that dimension, which is never negative. Segments are processed by falling
impact, each adding its impact to the accumulators of its vectors. What the segments
to come can still add is bounded by the sum of each dimension's next impact. From
that and the k best exact scores seen so far follows which vectors can still be
members. The k best are of k different ids, as of several vectors of one id only the best
counts. Only when the possible members are few, which proves all others out, the work stops, and
the possible members are scored exactly. If they never become few, all segments are
processed and all that the quantisation leaves possible are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fleetvitals.session import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 256
LEVELS = 16
# Shares of the segments after which the possible members are counted.
STOPS = (0.25, 0.5, 0.7, 0.85, 1.0)
FEW = 64


class ShardIndex:
    """The segments of one shard: per dimension the vectors in the order of their levels."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # Where the rows of each id begin, and the end.
        self.turns = np.flatnonzero(np.concatenate(
            [[True], self.ids[1:] != self.ids[:-1], [True]]))
        self.low = self.vectors.min(axis=0)
        span = self.vectors.max(axis=0) - self.low
        self.step = span // LEVELS + 1
        levels = (self.vectors - self.low) // self.step
        self.order = np.argsort(levels, axis=0, kind="stable").T.astype(np.int32)
        edges = np.arange(LEVELS + 1)
        self.starts = np.array([np.searchsorted(np.sort(column), edges) for column in levels.T])

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest exact scores, ties to smaller ids, without `own`."""
        size = np.abs(query)
        levels = np.arange(1, LEVELS)
        impact = size[:, None] * self.step[:, None] * levels
        places = np.argsort(-impact, axis=None, kind="stable")
        places = places[impact.ravel()[places] > 0]
        base = int(np.where(query > 0, query * self.low,
                            query * (self.low + LEVELS * self.step - 1)).sum())
        slack = int((size * (self.step - 1)).sum())
        reached = np.zeros(len(self.ids), np.int64)
        mine = self.ids == own
        done, left = 0, np.full(len(query), LEVELS - 1)
        for stop in STOPS:
            upto = int(len(places) * stop)
            for place in places[done:upto].tolist():
                dim, rank = divmod(place, LEVELS - 1)
                level = rank + 1 if query[dim] > 0 else LEVELS - 2 - rank
                members = self.order[dim, self.starts[dim, level]:self.starts[dim, level + 1]]
                reached[members] += impact[dim, rank]
                left[dim] -= 1
            done = upto
            rest = int((size * self.step * left).sum())
            least = self._least(query, own, k, reached)
            possible = ~mine if least is None else ~mine & (reached + (base + rest + slack) >= least)
            if stop == 1.0 or np.count_nonzero(possible) <= FEW + k:
                break
        members = np.flatnonzero(possible)
        scores = self.vectors[members] @ query
        ids, first = _one_row_each(self.ids[members], scores)
        order = np.lexsort((ids, -first))[:k]
        return ids[order], first[order]

    def _least(self, query: np.ndarray, own: int, k: int, reached: np.ndarray) -> int | None:
        """A score that k different ids other than `own` have or exceed; None if there are fewer."""
        first = self.turns[:-1]
        high = np.maximum.reduceat(reached, first)
        top = np.argpartition(-high, min(k, len(high) - 1))[:k + 1]
        top = top[self.ids[first[top]] != own][:k]
        if len(top) < k:
            return None
        # Of each of them the row that has reached most: its exact score is the id's or less.
        rows = [a + int(reached[a:b].argmax())
                for a, b in zip(first[top], self.turns[top + 1], strict=True)]
        return int((self.vectors[rows] @ query).min())


def _one_row_each(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each id."""
    order = np.lexsort((-scores, ids))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return ids[new], scores[new]


def integer_vector(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is not finite."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


_PACKED = "shard int, dim int, kind int, ids binary, cells binary"


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard of the index or a block of queries."""
    first = group.iloc[0]
    cells = np.array(group["cells"].tolist(), np.int64).reshape(len(group), int(first["dim"]))
    return pd.DataFrame([{
        "shard": first["shard"], "dim": first["dim"], "kind": first["kind"],
        "ids": group["id"].to_numpy(np.int64).tobytes(), "cells": cells.tobytes()}])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
    vector_col: str = "vector",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of `vectors` for each of `queries`.

    Both hold an id and a vector of integers (bigint). Candidates are all rows with
    another id and as many components as the query; inner products must fit 64 bits.
    Rows with a null id or vector take no part. Repeated rows count once; of several
    vectors of one id the best counts. A query with fewer candidates gets all of them.
    Every shard passes its queries one block after the other, so a task holds one shard.
    """
    spark = vectors.sparkSession
    every = stored(_usable(vectors, id_col, vector_col), "candidates")
    asked = _usable(queries, id_col, vector_col)
    shards = -(-every.count() // SHARD_ROWS) or 1
    blocks = -(-asked.count() // BLOCK_QUERIES) or 1
    place = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    indexed = every.withColumn("shard", place(shards)).withColumn("kind", F.lit(0))
    packed = indexed.groupBy("shard", "dim").applyInPandas(_packed, _PACKED)
    # A block of queries is packed under its own number and then sent to every shard.
    asked = asked.withColumn("shard", place(blocks)).withColumn("kind", F.lit(1))
    sent = asked.groupBy("shard", "dim").applyInPandas(_packed, _PACKED).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = stored(packed.unionByName(sent), "search")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, at = None, None
        for part in parts:
            for row in part.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                cells = np.frombuffer(row.cells, np.int64).reshape(len(ids), row.dim)
                if row.kind == 0:
                    index, at = ShardIndex(ids, cells), (row.shard, row.dim)
                elif at == (row.shard, row.dim):
                    yield from _answers(index, ids, cells, k)

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
    found = rows.mapInPandas(search, schema).groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _answers(index: ShardIndex, ids: np.ndarray, cells: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    found = [index.best(cell, own, k) for own, cell in zip(ids.tolist(), cells, strict=True)]
    yield pd.DataFrame({
        "query_id": np.repeat(ids, [len(x) for x, _ in found]),
        "vec_id": np.concatenate([x for x, _ in found]),
        "score": np.concatenate([y for _, y in found])})


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with id and vector, repeated ones once."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("cells"))
    rows = rows.where("id is not null and cells is not null").distinct()
    return rows.withColumn("dim", F.size("cells"))
