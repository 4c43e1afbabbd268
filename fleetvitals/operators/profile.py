"""Column statistics of real tables: what the rules on skew and width read."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rounded

# Values longer than this are counted by their first characters and a digest, which keeps
# the shuffle narrow; what is shown is always the whole value.
KEY_CHARS = 256
# Stored width of fixed-size types, in bytes (fixed values).
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def _text(kind: T.DataType, column: Column) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    return [f for f in df.schema if columns is None or f.name in columns]


def _width(field: T.StructField, text: Column) -> Column:
    fixed = FIXED_WIDTHS.get(field.dataType.simpleString())
    size = F.octet_length(text) if fixed is None else F.when(text.isNotNull(), F.lit(fixed))
    return size.cast("bigint")


def _cells(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(at, text, width) of every value, all columns from one scan; at is the column's place."""
    cells = []
    for at, field in enumerate(fields):
        text = _text(field.dataType, F.col(f"`{field.name}`"))
        cells.append(F.struct(F.lit(at).alias("at"), text.alias("text"),
                              _width(field, text).alias("width")))
    return df.select(F.inline(F.array(*cells)))


def _is_long() -> Column:
    return F.length("text") > KEY_CHARS


def _digest() -> Column:
    """What tells apart long values of one beginning; empty for short ones."""
    return F.when(_is_long(), F.sha2(F.col("text").cast("binary"), 256)).when(
        F.col("text").isNotNull(), F.lit(""))


def _shown(best: DataFrame, df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """`best` (at, start, digest, ...) with the whole value: long ones are looked up once."""
    wide = [f for f in fields if f.dataType.simpleString() not in FIXED_WIDTHS]
    if not wide:
        return best.withColumn("value", F.col("start"))
    place = {f.name: at for at, f in enumerate(fields)}
    cells = _cells(df, wide).where(_is_long())
    at = F.element_at(F.array(*[F.lit(place[f.name]) for f in wide]), F.col("at") + 1)
    whole = (cells.select(at.alias("at"), _digest().alias("digest"), "text")
             .join(best.where("digest <> ''").select("at", "digest"), ["at", "digest"], "left_semi")
             .groupBy("at", "digest").agg(F.min("text").alias("whole")))
    return best.join(whole, ["at", "digest"], "left").withColumn(
        "value", F.coalesce("whole", "start"))


def _named(fields: Sequence[T.StructField]) -> Column:
    names = F.array(*[F.lit(f.name) for f in fields])
    return F.element_at(names, F.col("at") + 1)


def column_profile(
    df: DataFrame, table_name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows, null share, mean width, distinct values and the most common value per column.

    One scan stacks the values of all columns and counts them with a map-side half: a
    value that fills most of a column costs one row per task. What follows works on
    counted values, in every task first. Values are shown whole, whatever their width; a
    second scan, of wide columns only, fetches long ones. Ties for the most common value
    go to the smallest by its first characters, then by its digest.
    """
    fields = _fields(df, columns)
    counted = _cells(df, fields).groupBy(
        "at", F.left("text", F.lit(KEY_CHARS)).alias("start"), _digest().alias("digest"),
        "width").agg(F.count("*").alias("n"))
    present = F.col("start").isNotNull()
    totals = counted.groupBy("at").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~present, F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(present, F.col("n") * F.col("width"))).alias("bytes"),
        F.count("start").alias("n_distinct"),
        F.min(F.when(present, F.struct((-F.col("n")).alias("order"), "start", "digest"))).alias("best"),
    )
    # An empty table has no cell; its columns are listed all the same.
    listed = df.sparkSession.range(len(fields)).select(F.col("id").cast("int").alias("at"))
    totals = listed.join(totals, "at", "left").select(
        "at", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_null", "bytes",
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        (-F.col("best.order")).alias("best_n"), "best.start", "best.digest")
    rows = F.col("n_rows")
    return _shown(totals, df, fields).select(
        F.lit(table_name).alias("table_name"),
        _named(fields).alias("column_name"),
        "n_rows",
        F.try_divide(F.col("n_null"), rows).alias("null_frac"),
        rounded(F.try_divide(F.col("bytes"), rows - F.col("n_null")), 4).alias("avg_width"),
        "n_distinct",
        F.col("value").alias("mcv1"),
        F.try_divide(F.col("best_n"), rows).alias("mcf1"),
    )


def approx_column_profile(
    df: DataFrame, table_name: str, columns: Sequence[str] | None = None, rsd: float = 0.02,
    tracked: int = 1000,
) -> DataFrame:
    """The same from sketches: one aggregation, no (column, value) shuffle.

    Distinct counts come from HyperLogLog within `rsd`, the most common value from a
    frequent-items sketch of `tracked` items; its share may be off by mcf1_error. Rows,
    nulls and widths are exact, values are shown whole.
    """
    fields = _fields(df, columns)
    aggregates = [F.count("*").alias("n_rows")]
    for at, field in enumerate(fields):
        text = _text(field.dataType, F.col(f"`{field.name}`"))
        key = F.when(F.length(text) > KEY_CHARS, F.concat(
            F.left(text, F.lit(KEY_CHARS)), F.sha2(text.cast("binary"), 256))).otherwise(text)
        aggregates += [
            F.count(text).alias(f"filled_{at}"),
            F.avg(_width(field, text)).alias(f"width_{at}"),
            F.approx_count_distinct(text, rsd).alias(f"distinct_{at}"),
            F.call_function("approx_top_k", key, F.lit(2), F.lit(tracked)).alias(f"top_{at}"),
        ]
    # The sketch counts nulls as an item: of its two best the one that is a value is taken.
    slots = 2 ** math.ceil(math.log2(tracked / 0.75))
    rows = []
    for at, field in enumerate(fields):
        top = F.get(F.filter(f"top_{at}", lambda t: t["item"].isNotNull()), 0)
        rows.append(F.struct(
            F.lit(at).alias("at"),
            F.left(top["item"], F.lit(KEY_CHARS)).alias("start"),
            F.substring(top["item"], KEY_CHARS + 1, 64).alias("digest"),
            ((F.col("n_rows") - F.col(f"filled_{at}")) / F.col("n_rows")).alias("null_frac"),
            rounded(F.col(f"width_{at}"), 4).alias("avg_width"),
            F.col(f"distinct_{at}").alias("n_distinct"),
            (top["count"] / F.col("n_rows")).alias("mcf1"),
        ))
    found = df.agg(*aggregates).select("n_rows", F.inline(F.array(*rows)))
    return _shown(found, df, fields).select(
        F.lit(table_name).alias("table_name"), _named(fields).alias("column_name"), "n_rows",
        "null_frac", "avg_width", "n_distinct", F.col("value").alias("mcv1"), "mcf1",
        F.lit(3.5 / slots).alias("mcf1_error"))
