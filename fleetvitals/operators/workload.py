"""The data queries and row derivations the audited application itself runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def count_by_key(df: DataFrame, key: str, values: Sequence | None = None) -> DataFrame:
    """Rows per key, for the given keys or all of them."""
    if values is not None:
        df = df.where(F.col(key).isin(*values))
    return df.groupBy(key).agg(F.count("*").alias("n"))


def filtered_count(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet every condition."""
    for condition in conditions:
        df = df.where(condition)
    return df.agg(F.count("*").alias("n"))


def sum_sorted(df: DataFrame, key: str, value: str, kind: str = "decimal(18,2)") -> DataFrame:
    """Sum per key, largest first, ties by key."""
    sums = df.groupBy(key).agg(F.sum(F.col(value).cast(kind)).cast("double").alias("total"))
    return sums.orderBy(F.col("total").desc(), F.col(key).asc())


def full_sort(df: DataFrame, *order: Column) -> DataFrame:
    """The whole table in order. A unique last key keeps range partitions even."""
    return df.orderBy(*order)


def join_sorted(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, *order: Column
) -> DataFrame:
    """Inner equi-join in order of some column."""
    return left.join(right, left[left_key] == right[right_key]).orderBy(*order)


def contains_counts(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose text contains each term, all terms in one pass over the text."""
    sums = [F.count_if(F.contains(F.col(text), F.lit(t))).alias(f"n_{i}")
            for i, t in enumerate(terms)]
    rows = [F.struct(F.lit(t).alias("term"), F.col(f"n_{i}").alias("n"))
            for i, t in enumerate(terms)]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def without_child(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
    null_aware: bool = False,
) -> DataFrame:
    """Parents no child row refers to.

    Child keys are made distinct first: a key with most of the children then
    costs one row per task. `null_aware` drops parents without a key, as NOT IN
    over non-null children does; the outer-join form keeps them.
    """
    keys = child.where(F.col(child_key).isNotNull()).select(
        F.col(child_key).alias("_key")).distinct()
    if null_aware:
        parent = parent.where(F.col(parent_key).isNotNull())
    return parent.join(keys, F.col(parent_key) == F.col("_key"), "left_anti")


def expand_rows(df: DataFrame, times: Column, name: str = "n") -> DataFrame:
    """Each row once for every number from 1 to `times`; none where that is below 1."""
    numbers = F.when(times >= 1, F.sequence(F.lit(1), times.cast("int")))
    return df.select("*", F.explode(numbers).alias(name))


def random_subset(
    df: DataFrame, n: int, key: Sequence[str], seed: int = 0, prefix_digits: int = 4
) -> DataFrame:
    """n rows in an order given by a hash of seed and key: repeatable, not a range.

    Rows are counted by the first digits of their hash; prefixes below the cut are taken
    whole, and only the rows of the one prefix that holds the cut are put in order. So
    no task sees more than a prefix's share of the rows, 1 in 16 ** prefix_digits.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    hashed = df.withColumn("_hash", F.md5(text)).withColumn(
        "_prefix", F.substring("_hash", 1, prefix_digits))
    counts = hashed.groupBy("_prefix").agg(F.count("*").alias("_rows")).withColumn(
        "_head", F.substring("_prefix", 1, prefix_digits // 2))
    # Rows before a prefix: those of smaller first digits, then those beside it.
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.groupBy("_head").agg(F.sum("_rows").alias("_sum")).select("_head", F.coalesce(
        F.sum("_sum").over(before(Window.orderBy("_head"))), F.lit(0)).alias("_base"))
    beside = F.coalesce(F.sum("_rows").over(
        before(Window.partitionBy("_head").orderBy("_prefix"))), F.lit(0))
    room = counts.join(heads, "_head").select(
        "_prefix", "_rows", (F.lit(n) - F.col("_base") - beside).alias("_room"))
    near = hashed.join(room.where("_room > 0"), "_prefix")
    order = Window.partitionBy("_prefix").orderBy("_hash", *key)
    edge = near.where("_room < _rows").withColumn("_rank", F.row_number().over(order)).where(
        "_rank <= _room").drop("_rank")
    whole = near.where("_room >= _rows")
    return whole.unionByName(edge).drop("_hash", "_prefix", "_rows", "_room")


def merge_json(text: Column, additions: Mapping[str, Column]) -> Column:
    """A JSON object with keys added; an added key replaces one of the same name.

    Values of any kind stay as they are: strings, numbers, nested values and nulls. Null
    for a null text and for one that is no JSON object.
    """
    names = list(additions)
    old = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), "map<string,variant>")
    kept = F.map_filter(old, lambda key, _: ~key.isin(*names))
    added = F.create_map(*[part for name in names
                           for part in (F.lit(name), additions[name].cast("variant"))])
    return F.to_json(F.map_concat(kept, added))


def pick(values: Sequence[str], position: Column) -> Column:
    """One of the listed values, by a position from 0 that wraps around."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.pmod(position, F.lit(len(values))) + 1).cast("int"))


# Listed values of the derived rows (fixed values).
GRADES = ("Premium", "Standard", "Economy", "Deluxe", "Basic")


def derived_parts(part: DataFrame) -> DataFrame:
    """Rows derived column by column: padding, picks, repeats, hashes, dates, bands."""
    key = F.col("p_partkey")
    return part.select(
        "p_partkey",
        F.concat(F.lit("SKU-"), F.lpad(key.cast("string"), 6, "0")).alias("sku"),
        F.concat(F.lit("Product "), key.cast("string"), F.lit(" - "), pick(GRADES, key)).alias("name"),
        F.concat(F.repeat(F.concat("p_name", F.lit(". ")), F.lit(3)),
                 F.when(key % 50 == 0, F.lit("SPECIAL EDITION ITEM")).otherwise(F.lit(""))
                 ).alias("description"),
        F.md5(key.cast("string")).alias("token"),
        F.date_add(F.to_date(F.lit("1960-01-01")), (key % 20000).cast("int")).alias("made_on"),
        F.col("p_retailprice").cast("decimal(10,2)").cast("double").alias("price"),
        (key % 20 != 0).alias("is_active"),
        F.when(F.col("p_retailprice") < 950, F.lit("low"))
        .when(F.col("p_retailprice") < 1050, F.lit("middle"))
        .otherwise(F.lit("high")).alias("price_band"),
    )
