"""Sizes, units and the bands built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded

BLOCK_SIZE = 8192
MIB = 1024 * 1024
# Spill bands in MB, lower bound inclusive.
SPILL_MEDIUM_MB = 10
SPILL_HIGH_MB = 100


def pretty_size(size: Column) -> Column:
    """A byte count as text, by the server's rule: whole units, rounded half up,
    moving to the next unit from 10240 of the current one (10239.5 after bytes)."""
    magnitude = F.abs(size.cast("bigint"))

    def in_unit(bits: int, unit: str) -> Column:
        halves = F.shiftright(magnitude, bits - 1)
        return F.concat(F.shiftright(halves + 1, 1).cast("string"), F.lit(f" {unit}"))

    def fits(bits: int) -> Column:
        return F.shiftright(magnitude, bits - 1) < 2 * 10 * 1024 - 1

    text = (
        F.when(magnitude < 10 * 1024, F.concat(magnitude.cast("string"), F.lit(" bytes")))
        .when(fits(10), in_unit(10, "kB"))
        .when(fits(20), in_unit(20, "MB"))
        .when(fits(30), in_unit(30, "GB"))
        .when(fits(40), in_unit(40, "TB"))
        .otherwise(in_unit(50, "PB"))
    )
    return F.when(size < 0, F.concat(F.lit("-"), text)).otherwise(text)


def setting_to_mb(setting: Column, unit: Column) -> Column:
    """A memory setting in MB; a missing or unknown unit leaves the number as it is."""
    value = setting.try_cast("bigint")
    return (
        F.when(unit == "kB", value / 1024)
        .when(unit == "8kB", value * 8 / 1024)
        .otherwise(value.cast("double"))
    )


def blocks_to_mb(blocks: Column) -> Column:
    """Temporary blocks as MB, two decimals."""
    return rounded(blocks.cast("double") * BLOCK_SIZE / MIB, 2)


def bytes_to_mb(size: Column) -> Column:
    """Bytes as MB, two decimals."""
    return rounded(size.cast("double") / MIB, 2)


def spill_severity(mb: Column) -> Column:
    return (
        F.when(mb >= SPILL_HIGH_MB, F.lit("HIGH"))
        .when(mb >= SPILL_MEDIUM_MB, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
