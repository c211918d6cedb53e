"""Positions and running counts that never gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from siftrank.session import write_and_reload


def with_running_count(
    df: DataFrame, keys: Sequence[str], at: str, name: str = "running", width: int = 65_536
) -> DataFrame:
    """Number rows 1, 2, ... along the whole-number column ``at`` within ``keys``.

    Rows are split into stretches of ``width`` values of ``at``. Stretches are
    counted (a plain aggregate) and their counts summed up; rows are numbered
    inside their stretch and shifted. A window thus sees one stretch, or one
    row per stretch, never a whole group. ``at`` is unique within ``keys``.
    """
    df = df.withColumn("_stretch", F.floor(F.col(at) / width))
    before = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_stretch")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*keys, "_stretch").orderBy(at)
    return (
        df.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*keys, "_stretch"])
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("long"))
        .drop("_stretch", "_row", "_offset")
    )


def number_rows(df: DataFrame, by: Sequence[Column], name: str = "position") -> DataFrame:
    """Rows numbered 1, 2, ... in the order ``by``, which tells all rows apart.

    Rows are dealt out in ranges and written as they lie; a row's number is its place in its
    range and the rows of the ranges before. Only the sizes of the ranges, one for each task, are put
    together.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = write_and_reload(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_in_range": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = sorted(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for each in sizes:
        offsets.append((each["_range"], before))
        before += each["n"]
    table = df.sparkSession.createDataFrame(offsets, "_range long, _before long")
    return placed.join(table, "_range").withColumn(name, F.col("_before") + F.col("_in_range") + 1).drop(
        "_at", "_range", "_in_range", "_before"
    )


def number_ids(df: DataFrame, id: str, name: str = "position", descending: bool = False) -> DataFrame:
    """Distinct ids numbered 1, 2, ... in order."""
    by = F.col(id).desc() if descending else F.col(id).asc()
    return number_rows(df.select(id).distinct(), [by], name)
