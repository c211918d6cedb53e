"""Document length, exact or squeezed to three significant bits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quantised_length(length: Column) -> Column:
    """Round down to three significant bits: 9 -> 8, 100 -> 96, 10000 -> 8192."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 2)
    return (
        F.when(length <= 0, F.lit(0.0))
        .otherwise(F.floor(length / step) * step)
        .cast("double")
    )
