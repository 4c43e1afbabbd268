"""Connected components of a table of links, as label per node."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.session import stored


# A task forgets the nodes it knows and starts anew once it knows so many: some 300 MB.
NODES_AT_ONCE = 1 << 20
# Sets of stars that one task of the next pass reads.
FAN_IN = 16
_STARS = "u long, v long, mark int"


class _Stars:
    """Links seen so far, every node under the smallest it reaches."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent, top = self.parent, node
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def rows(self) -> pd.DataFrame:
        """The stars' edges, one of them marked."""
        nodes = [n for n in self.parent if self.root(n) != n]
        return pd.DataFrame({"u": nodes, "v": [self.root(n) for n in nodes],
                             "mark": [int(at == 0) for at in range(len(nodes))]})


def _contracted(nodes_at_once: int):
    """The links of one task as stars, of about `nodes_at_once` nodes at a time."""

    def contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stars = _Stars()
        for part in parts:
            for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
                stars.link(a, b)
            if len(stars.parent) > nodes_at_once:
                yield stars.rows()
                stars = _Stars()
        if stars.parent:
            yield stars.rows()

    return contract


def components(links: DataFrame, nodes_at_once: int = NODES_AT_ONCE) -> DataFrame:
    """(node, label) of every node of a link (columns a, b): the smallest node it reaches.

    Links are first contracted to stars inside the tasks that read them, and written. In
    the next pass a task reads FAN_IN sets of stars, each of bounded size; it goes on
    while that at least halves the sets, and a single set is the result.
    Where the links are too many for that, stars are drawn alternately to the smallest
    neighbour of larger and of smaller nodes, which ends in one star per component after
    few rounds. Every pass is written to the shared folder, so a lost executor costs one
    pass; nothing but the number of sets, and whether stars are left, comes to the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = edges.where("u <> v"), None
    while True:
        edges = stored(edges.mapInPandas(_contracted(nodes_at_once), _STARS), "stars")
        sets = edges.agg(F.sum("mark")).first()[0] or 0
        edges = edges.select("u", "v")
        if sets <= 1:
            break
        if before is None or 2 * sets <= before:
            edges, before = edges.coalesce(-(-sets // FAN_IN)), sets
            continue
        edges = stored(edges.distinct(), "stars")
        if _are_stars(edges):
            break
        edges, before = _small_star(_large_star(edges)), None
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")))
            .distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge downwards, to a node that has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    downs = ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("is_low"))
    return downs.where("n > 1 or (n = 1 and is_low = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stored(both, "links")
    low = stored(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("low")), "lowest")
    return (both.join(low, "u").where("v > u and low < v")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    edges = stored(edges, "links")
    low = stored(edges.groupBy("u").agg(F.min("v").alias("low")), "lowest")
    return (edges.join(low, "u")
            .select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
                    F.col("low").alias("v")).where("u <> v").distinct())
