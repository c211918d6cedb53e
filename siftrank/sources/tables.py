"""Loading the given Parquet tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text in a partition of ``load_by``; as token rows with their counts or in order they are some thirty times that.
PART = 4_000_000
#: Rows of numbers in a partition of ``parts_of``.
ROWS = 500_000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as it is stored."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_by(spark: SparkSession, folder: str, name: str, key: str, part: int = PART) -> DataFrame:
    """One table whose rows are costly to process, dealt out by ``key``.

    A row group is read by one task, however long its texts are. What is then summed
    or numbered within a key needs no other exchange. Partitions have about ``part`` bytes of text, and
    Spark does not merge them: what a task makes of them does not grow with the table.
    """
    df = load(spark, folder, name)
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(F.sum(sum(texts, F.lit(0).cast("long")))).first()[0] or 0
    return df.repartition(max(1, math.ceil(size / part)), key)


def parts_of(spark: SparkSession, rows: int, part: int = ROWS) -> int:
    """Partitions for ``rows``: those of the session, or more when they would have over ``part`` rows each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / part))
