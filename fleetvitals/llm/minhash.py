"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature has 60 lanes of 16 bits. The forest has 20 orders; order t sorts the
signatures rotated by 3t lanes, so each order starts with lanes of its own. Two
documents of similarity s agree in the first lane with probability s, and so
share the first three lanes of at least one order with 1 - (1 - s^3)^20: 0.99998
at 0.75. Neighbours in an order with a common prefix of at least three lanes are
candidates; in a dense region the nearest ones share many more lanes, so the
depth adapts to the region. A region (an order and its first three lanes) whose
members the confirmed links do not join into one component is then compared in
full, its smaller components against all of it in blocks, so that no partner is
lost to the width of the neighbourhood.

Links are confirmed on the full shingle sets. Documents with equal sets form one
class and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.session import stored

from .components import components
from .text import BROADCAST_IDS, as_list, blank_words, map_texts, mixed, restricted, slices, word_hashes

WORDS = 5
LANES = 60
ORDERS = 20
STEP = LANES // ORDERS
MIN_DEPTH = 3
KEY_LANES = 8
WIDTH = 3
BLOCK = 512
COLUMNS_AT_ONCE = 1 << 15
# Standard deviations of an estimate over 60 lanes that a pair may lie under the threshold.
SLACK = 4.0

_random = np.random.RandomState(20240229)
_PLACES = [np.uint64(x | 1) for x in _random.randint(1 << 62, size=2 * WORDS, dtype=np.int64)]
_TIMES = (_random.randint(1 << 31, size=LANES, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
_PLUS = _random.randint(1 << 31, size=LANES, dtype=np.int64).astype(np.uint32)[:, None]


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text.

    A text of one to four words is one shingle; one without words has none.
    """
    words = word_hashes(blank_words(text))
    if not len(words):
        return words
    if len(words) < WORDS:
        places = np.array(_PLACES[WORDS:WORDS + len(words)])
        return mixed((words * places).sum(keepdims=True) + np.uint64(len(words)))
    last = len(words) - WORDS + 1
    total = np.zeros(last, np.uint64)
    for place in range(WORDS):
        total += words[place:place + last] * _PLACES[place]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> bytes:
    """The smallest of each of 60 hash functions over the shingles, 16 bits of it."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for at in range(0, values.shape[1], COLUMNS_AT_ONCE):
        lanes = values[:, at:at + COLUMNS_AT_ONCE] * _TIMES
        lanes += _PLUS
        lanes ^= lanes >> np.uint32(15)
        lanes *= np.uint32(0x2C1B3C6D)
        np.minimum(low, lanes.min(axis=1), out=low)
    return (low ^ (low >> np.uint32(16))).astype("<u2").tobytes()


def _features(doc_id: int | None, text: bytes | None, *keys: int) -> tuple:
    shingles = shingle_set(text)
    if not len(shingles):
        return doc_id, 0, None, None, None, *keys
    key = xxhash.xxh3_128_digest(shingles.tobytes())
    high, low = np.frombuffer(key, "<i8").tolist()
    return doc_id, len(shingles), high, low, signature(shingles), *keys


def _prefix(lanes: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.cumprod(lanes == other, axis=1).sum(axis=1)


def _lanes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u2").reshape(len(keys), -1)


_NEIGHBOURS = "part int, a long, b long, depth int, tree int, key binary"


def _neighbours(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of near rows of a sorted range, and the rows at both of its ends (part not null)."""
    task = TaskContext.get().partitionId()
    before: pd.DataFrame | None = None
    seen = 0
    for part in parts:
        if not len(part):
            continue
        if seen < WIDTH:
            yield _ends(part.iloc[:WIDTH - seen], task)
        rows = part if before is None else pd.concat([before, part], ignore_index=True)
        yield _pairs(rows, new_from=0 if before is None else len(before))
        seen += len(part)
        before = rows.iloc[-WIDTH:]
    if seen > WIDTH:
        yield _ends(before.iloc[-min(WIDTH, seen - WIDTH):], task)


def _ends(rows: pd.DataFrame, task: int) -> pd.DataFrame:
    return pd.DataFrame({"part": task, "a": rows["node"], "b": rows["node"], "depth": 0,
                         "tree": rows["tree"], "key": rows["key"]})


def _pairs(rows: pd.DataFrame, new_from: int, across: np.ndarray | None = None) -> pd.DataFrame:
    """Pairs up to WIDTH rows apart whose second is new, in one order, of common prefix."""
    keys, tree, node = _lanes(rows["key"].tolist()), rows["tree"].to_numpy(), rows["node"].to_numpy()
    found = []
    for apart in range(1, min(WIDTH, len(rows) - 1) + 1):
        depth = _prefix(keys[apart:], keys[:-apart])
        keep = (tree[apart:] == tree[:-apart]) & (depth >= MIN_DEPTH)
        keep[:max(0, new_from - apart)] = False
        if across is not None:
            keep &= across[apart:] != across[:-apart]
        at = np.flatnonzero(keep)
        found.append(pd.DataFrame({"a": node[at], "b": node[at + apart], "depth": depth[at]}))
    pairs = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "depth": []})
    return pairs.assign(part=None, tree=None, key=None)[["part", "a", "b", "depth", "tree", "key"]]


def _across_ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts), ignore_index=True)
    if len(rows):
        rows = rows.assign(node=rows["a"])
        yield _pairs(rows, 0, across=rows["part"].to_numpy())


def forest_rows(classes: DataFrame) -> DataFrame:
    """(tree, key, node): every class once in each order, with its rotated signature."""
    twice = F.concat("sig", "sig")
    return classes.select("node", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(ORDERS - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring(
            twice, t * (2 * STEP) + 1, F.lit(2 * KEY_LANES)).alias("key")))).alias("at"),
    ).select("at.tree", "at.key", "node")


def neighbour_pairs(forest: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) with the number of orders that show them and their deepest prefix.

    Each order is cut into ranges of rows, so a prefix that very many share is spread
    over tasks; the few rows at the ends of ranges are paired in a second step.
    """
    ordered = forest.repartitionByRange("tree", "key", "node").sortWithinPartitions(
        "tree", "key", "node")
    found = stored(ordered.mapInPandas(_neighbours, _NEIGHBOURS), "neighbours")
    ends = (found.where("part is not null").repartition(1)
            .sortWithinPartitions("tree", "key", "a", "part"))
    across = ends.mapInPandas(_across_ranges, _NEIGHBOURS)
    pairs = found.where("part is null").unionByName(across).where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("orders"), F.max("depth").alias("depth"))


def similar_sets(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|, on the sets themselves."""
    both = len(np.intersect1d(first, second, assume_unique=True))
    return 100 * both >= percent * (len(first) + len(second) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    joined = (pairs.select("a", "b")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for part in slices(parts):
            keep = []
            columns = [as_list(part.column(i)) for i in range(4)]
            for at, (a, text_a, _, text_b) in enumerate(zip(*columns, strict=True)):
                if a != last:
                    last, own = a, shingle_set(text_a)
                if similar_sets(own, shingle_set(text_b), percent):
                    keep.append(at)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return joined.select("a", "text_a", "b", "text_b").mapInArrow(check, "a long, b long")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Without pairs whose signatures lie far under the threshold, or whose sizes rule it out."""
    mine = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"),
                          F.col("n_shingles").alias("n_a"))
    other = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"),
                           F.col("n_shingles").alias("n_b"))

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                equal = (_lanes(part["sig_a"].tolist()) == _lanes(part["sig_b"].tolist())).sum(axis=1)
                yield part.loc[equal >= least_lanes(percent), ["a", "b"]]

    return (pairs.join(mine, "a").join(other, "b")
            .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            .select("a", "b", "sig_a", "sig_b").mapInPandas(check, "a long, b long"))


def least_lanes(percent: int) -> float:
    share = percent / 100
    return LANES * (share - SLACK * (share * (1 - share) / LANES) ** 0.5)


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")))


def open_regions(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of regions wider than the neighbourhood that still hold several components.

    One row per member (tree, prefix, node, label, major, blocks); major is the label
    most members have.
    """
    region = ("tree", "prefix")
    rows = (forest.withColumn("prefix", F.substring("key", F.lit(1), F.lit(2 * MIN_DEPTH)))
            .join(labels, "node", "left")
            .select(*region, "node", F.coalesce("label", "node").alias("label")))
    rows = stored(rows, "regions")
    sizes = rows.groupBy(*region, "label").agg(F.count("*").alias("n"))
    wide = stored(
        sizes.groupBy(*region).agg(
            F.count("*").alias("parts"), F.sum("n").alias("n"),
            F.max_by("label", "n").alias("major"))
        .where((F.col("parts") > 1) & (F.col("n") > WIDTH + 1))
        .select(*region, "major", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "wide")
    return rows.join(wide, list(region))


def region_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside open regions, between different components.

    Every member outside the largest component meets every member of the region on the
    full sets: the region is cut into blocks by hash, and a task counts what the sets of
    one block share with those of another by an index of the other's shingles. A pair
    that shares several regions is compared in the first; of several links between
    one member and one component one is given.
    """
    members = members.join(texts, "node").withColumn(
        "block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    key = ["tree", "prefix", "left", "right"]
    rows = ["node", "label", "sig", "text"]
    left = members.where(F.col("label") != F.col("major")).withColumn("right", spread).select(
        "tree", "prefix", F.col("block").alias("left"), "right", *rows, F.lit(0).alias("side"))
    lefts = left.select("tree", "prefix", "left").distinct()
    right = (members.join(lefts, ["tree", "prefix"]).select(
        "tree", "prefix", "left", F.col("block").alias("right"), *rows, F.lit(1).alias("side")))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        one, two = part[part["side"] == 0], part[part["side"] == 1]
        found: list[tuple[int, int]] = []
        if len(one) and len(two):
            found = _block_links(one, two, int(part["tree"].iloc[0]), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.unionByName(right).groupBy(*key).applyInPandas(compare, "a long, b long").distinct()


def _block_links(one: pd.DataFrame, two: pd.DataFrame, tree: int, percent: int) -> list:
    sets = [shingle_set(t.encode()) for t in two["text"]]
    sizes = np.array([len(x) for x in sets])
    shingles = np.concatenate(sets)
    order = np.argsort(shingles)
    shingles, owner = shingles[order], np.repeat(np.arange(len(sets)), sizes)[order]
    lanes, node, label = _lanes(two["sig"].tolist()), two["node"].to_numpy(), two["label"].to_numpy()
    found = []
    for own, mine in zip(one.itertuples(), _lanes(one["sig"].tolist()), strict=True):
        own_set = shingle_set(own.text.encode())
        first, last = (np.searchsorted(shingles, own_set, side) for side in ("left", "right"))
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = 100 * both >= percent * (len(own_set) + sizes - both)
        near &= label != own.label
        together = (lanes == mine).reshape(len(sets), ORDERS, STEP).all(axis=2)
        near &= together.argmax(axis=1) == tree
        for other in {label[i]: node[i] for i in np.flatnonzero(near)}.values():
            found.append((min(own.node, int(other)), max(own.node, int(other))))
    return found


def row_key(doc_id: Column, text: Column) -> Column:
    """What rows of one id and one text share, and no others (64 bits of a hash)."""
    return F.xxhash64(doc_id.cast("long"), text)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group_id, row_key) of every row of `docs`.

    component_id is the smallest id that links reach. Null, empty and blank texts have
    no shingles and no links. Repeated rows come out as often as they went in; rows that
    share an id are in one component, whatever their texts. Rows without an id are linked
    like others and never kept; where no row of a component has an id, component_id is
    null. `group_id` tells components apart in any case, and is null for a text without
    shingles whose id no other row has. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumns({"text_key": F.xxhash64("text"),
                              "row_key": row_key(F.col("doc_id"), F.col("text"))})
    found = stored(map_texts(
        keyed, "doc_id long, n_shingles long, high long, low long, sig binary, text_key long, row_key long",
        _features, "doc_id", "text", "text_key", "row_key"), "features")
    # A class is a set of shingles; any text that has it stands for it.
    classes = stored(
        found.where("n_shingles > 0").groupBy("high", "low").agg(
            F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"),
            F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        ).withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = stored(_shared_ids(found), "shared-ids")
    is_shared = not shared.isEmpty()
    same_id = _links_by_id(found, classes, shared) if is_shared else None
    labels = stored(_class_labels(classes, docs, same_id, percent), "labels")
    # Classes that are linked with no other keep their own smallest id.
    own = classes.select("high", "low", "node", "first_id").join(labels, "node", "left")
    linked = own.where("label is not null").groupBy("label").agg(F.min("first_id").alias("linked_id"))
    groups = stored(own.join(linked, "label", "left").select(
        "high", "low", F.coalesce("label", "node").alias("group_id"),
        F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("linked_id"))
        .alias("component_id")), "components")
    joined = found.drop("sig", "text_key").join(groups, ["high", "low"], "left")
    if is_shared:
        # A row without shingles lies in the component of the other rows of its id.
        own = restricted(joined, shared, "doc_id").groupBy("doc_id").agg(
            F.min("group_id").alias("own_group"), F.min("component_id").alias("own_component"))
        joined = joined.join(own, "doc_id", "left").withColumns({
            "group_id": F.coalesce("group_id", "own_group"),
            "component_id": F.coalesce("component_id", "own_component")})
    component = F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "group_id", "row_key")


def _shared_ids(found: DataFrame) -> DataFrame:
    """Ids whose rows are not all of one class; sums of fixed width, so that an id of very
    many rows is reduced where they are."""
    return (found.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.count("high").alias("with_class"),
        F.min("high").alias("h0"), F.max("high").alias("h1"), F.min("low").alias("l0"), F.max("low").alias("l1"))
        .where("h0 <> h1 or l0 <> l1 or (with_class > 0 and with_class < rows)").select("doc_id"))


def _links_by_id(found: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Links (a, b) from the smallest class of a shared id to its others."""
    rows = restricted(found.select("doc_id", "high", "low"), shared, "doc_id")
    of_id = stored(rows.join(classes.select("high", "low", "node"), ["high", "low"])
                   .select("doc_id", "node").distinct(), "classes-of-ids")
    low = of_id.groupBy("doc_id").agg(F.min("node").alias("a"))
    return stored(of_id.join(low, "doc_id").where("a <> node").select("a", F.col("node").alias("b")), "id-links")


def _class_labels(
    classes: DataFrame, docs: DataFrame, same_id: DataFrame | None, percent: int,
) -> DataFrame:
    """(node, label) of the classes that are linked with another, also by `same_id`."""
    forest = stored(forest_rows(classes), "forest")
    pairs = stored(neighbour_pairs(forest), "pairs")
    texts = _texts_of(pairs, classes, docs)

    # The nearest partner of each first: it joins most of what belongs together.
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "orders", "depth")
    ends = ends.unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "orders", "depth"))
    nearest = ends.groupBy("node").agg(F.max_by(
        "other", F.col("orders") * 64 + F.col("depth")).alias("other"))
    nearest = nearest.select(F.least("node", "other").alias("a"),
                             F.greatest("node", "other").alias("b")).distinct()
    near = confirmed(nearest, texts, percent)
    links = stored(near if same_id is None else near.unionByName(same_id), "links")
    labels = stored(components(links), "labels")

    rest = _estimated(_labelled(pairs.select("a", "b"), labels), classes, percent)
    links = stored(links.unionByName(confirmed(rest, texts, percent)), "links")
    labels = stored(components(links), "labels")

    # Whoever shares three lanes with another is a candidate, so `texts` has all members.
    members = open_regions(forest, labels).join(classes.select("node", "sig"), "node")
    more = stored(region_links(members, texts, percent), "region-links")
    if more.isEmpty():
        return labels
    return components(stored(links.unionByName(more), "links"))


def _texts_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of all classes in pairs, one text each, however many rows have it."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(classes.select("node", "text_key").join(nodes, "node"), "candidates")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("text_key", F.xxhash64("text")).select("text_key", "text")
    return stored(texts.join(wanted, "text_key").groupBy("node").agg(F.min("text").alias("text")), "texts")
