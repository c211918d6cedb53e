r"""Sharding by extendible hashing.

Rows are hashed; a bucket is a prefix of the hash's bits. The directory starts with one
bucket for all rows, and only a bucket with more bytes than a shard may have is split on
another bit, until every bucket fits. Rows of a shard share its prefix, so growth
splits the shards concerned and moves no other row.

Bytes are summed over the cells of ``STEP`` further bits at once, with map-side sums,
and rolled up to every depth in between; so a thousandfold table takes one more pass, over
narrow rows, and a prefix is never gathered. Rows that are alike share all bits; where
they are too many for a shard they are counted off into shards of their own
(``prefix.number``): their copies are made again from one count, in blocks, instead of
numbering a third of all rows in one task. A single row over the limit is a shard of its
own, the only kind that exceeds it.

Column expressions only. The hash is of ``doc_id`` and ``text``; nulls hash as a sign of
their own and weigh no bytes. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import row_key, stored, table, text_of
from siftrank.operators.positions import with_running_count

LIMIT = 64 << 20
BITS = 60
STEP = 12
_BLOCK = 1 << 16


def hash_bits() -> Column:
    """The first ``BITS`` bits of the row's hash, as a number."""
    return F.conv(F.substring(row_key(), 1, BITS // 4), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    return F.lpad(F.bin(prefix), depth.cast("int"), "0")


def _split(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """The cells ``STEP`` bits below ``base``, each with the depth at which it fits.

    Columns ``cell``, ``depth`` (null: too large still), ``shard_bytes``.
    """
    end = base + STEP
    cells = rows.groupBy(F.shiftright("hash", BITS - end).alias("cell")).agg(F.sum("n_bytes").alias("n"))
    cells = stored(cells, "cells")
    depths = F.sequence(F.lit(base if base == 0 else base + 1), F.lit(end))
    at = cells.select("cell", "n", F.explode(depths).alias("depth"))
    at = at.select("cell", "n", "depth", F.expr(f"shiftright(cell, {end} - depth)").alias("prefix"))
    sums = at.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    fits = at.join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("s"))
    return cells.select("cell").join(fits, "cell", "left").select("cell", "s.depth", "s.shard_bytes")


def _alike(rows: DataFrame, limit: int) -> DataFrame:
    """Shards of rows that share all bits: as many in each as fit, one at least."""
    groups = rows.groupBy("doc_id", "hash", "n_bytes").agg(F.count("*").alias("copies"))
    most = groups.groupBy("hash").agg(F.max("n_bytes").alias("most"), F.sum("copies").alias("all"))
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))
    blocks = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_BLOCK}"))).alias("block"))
    numbers = F.sequence(F.col("block") * _BLOCK, F.least(F.col("copies"), (F.col("block") + 1) * _BLOCK) - 1)
    numbered = blocks.repartition("hash", "block").select("doc_id", "hash", "n_bytes", F.explode(numbers).alias("number"))
    placed = numbered.join(most, "hash").withColumn("each", each).withColumn("part", F.floor(F.col("number") / F.col("each")))
    size = F.least(F.col("each"), F.col("all") - F.col("part") * F.col("each")) * F.col("n_bytes")
    return placed.select(
        "doc_id",
        "hash",
        "n_bytes",
        F.lit(BITS).alias("depth"),
        F.concat(_bits(F.col("hash"), F.lit(BITS)), F.lit("."), F.col("part").cast("string")).alias("shard"),
        size.cast("long").alias("shard_bytes"),
    )


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every row's shard: ``doc_id``, ``hash``, ``n_bytes``, ``depth``, ``shard`` (bits), ``shard_bytes``."""
    left = stored(docs.select("doc_id", hash_bits().alias("hash"), F.octet_length(text_of()).cast("long").alias("n_bytes")), "hashed")
    done = None
    for base in range(0, BITS, STEP):
        cells = stored(_split(left, base, limit), "directory")
        placed = left.withColumn("cell", F.shiftright("hash", BITS - base - STEP)).join(cells, "cell")
        prefix = F.expr(f"shiftright(hash, {BITS} - depth)")
        fitting = placed.where(F.col("depth").isNotNull()).select(
            "doc_id", "hash", "n_bytes", "depth", _bits(prefix, F.col("depth")).alias("shard"), "shard_bytes"
        )
        done = fitting if done is None else done.unionByName(fitting)
        if cells.where(F.col("depth").isNull()).isEmpty():
            return done
        left = stored(placed.where(F.col("depth").isNull()).select("doc_id", "hash", "n_bytes"), "oversized")
    return done.unionByName(_alike(left, limit))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The rows of ``docs``, a folder for each shard (``shard=bits``) under ``path``."""
    shards = stored(assign(docs, limit), "shards")
    rows = docs.withColumn("_hash", hash_bits())
    numbered = F.contains("shard", F.lit("."))
    split = shards.where(numbered).groupBy(F.col("hash").alias("_hash")).agg(F.max("n_bytes").alias("_most"))
    whole = shards.where(~numbered).select(F.col("hash").alias("_hash"), "shard").distinct()
    # the rows themselves are counted off: their other columns may differ
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest("_most", F.lit(1))))
    alike = stored(rows.withColumn("_at", F.monotonically_increasing_id()).join(split, "_hash"), "alike")
    part = F.floor((F.col("_number") - 1) / each).cast("string")
    again = (
        with_running_count(alike, ["_hash"], "_at", "_number")
        .withColumn("shard", F.concat(_bits(F.col("_hash"), F.lit(BITS)), F.lit("."), part))
        .drop("_at", "_most", "_number")
    )
    placed = rows.join(whole, "_hash").unionByName(again).drop("_hash")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark, folder: str) -> DataFrame:
    """``op6``: the shard of every document."""
    return assign(table(spark, folder, "documents")).withColumn("depth", F.col("depth").cast("long")).drop("hash")


def sql(limit: int = LIMIT) -> str:
    """The same in SQL, for tables without rows that are alike and too many for a shard."""
    return f"""
WITH h AS (
  SELECT row_number() OVER () AS r, doc_id, CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), chr(0), coalesce(text, ''))), 1, {BITS // 4}) AS BIGINT) AS h,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes
  FROM documents
), deep AS (
  SELECT r, doc_id, h, n_bytes, depth, h >> ({BITS} - depth) AS prefix FROM h, (SELECT unnest(range(0, {BITS + 1})) AS depth)
), fit AS (
  SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM deep GROUP BY depth, prefix HAVING sum(n_bytes) <= {limit}
), first AS (
  SELECT doc_id, h, n_bytes, depth, prefix, shard_bytes,
    row_number() OVER (PARTITION BY r ORDER BY depth) AS k
  FROM deep JOIN fit USING (depth, prefix)
)
SELECT doc_id, n_bytes, CAST(depth AS BIGINT) AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, shard_bytes
FROM first WHERE k = 1
"""


SQL = sql()
