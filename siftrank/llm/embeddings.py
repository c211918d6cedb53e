"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

The signs of a vector against random hyperplanes are bits that two vectors at an angle
``t`` share with probability ``1 - t / pi`` each. A table takes some bits as the key of a
bucket; vectors of one bucket are compared by their exact cosine in double precision, and
links go to distributed connected components (``components.py``). The number of bits follows
the logarithm of the largest group, so that chance meetings do not grow with it, and the
number of tables follows from the bits: a pair just at the threshold is missed by all
tables with probability ``MISS``, one closer than that by less.

1. Equal vectors of a group (a label and a dimension) are one class with its number of rows.
   Only classes go on, with a short number as id.
2. Buckets are counted as keys alone, with map-side sums. Only members of buckets with a
   second class travel with their vectors.
3. A bucket of more than ``BLOCK`` classes is laid out in pairs of blocks, so that no task
   holds a whole group. Pairs are compared as products of matrices and never leave a task:
   what comes out is, for each class, its number of links and one edge of a spanning forest. A
   pair met in several tables counts in the first of them, which the keys of both tell.

Vectors that are null, empty or zero, or hold null or non-finite components, and those with
a null label, link with nothing. Rows with a null id take part, but a component has
the least id that is not null (null if all are), and ``kept`` is then false for them. Repeated rows are linked as
equal vectors. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from siftrank.llm.common import by_batch, stored, table
from siftrank.llm.components import components

THRESHOLD = 0.98
#: The chance that a pair just at the threshold shares no bucket.
MISS = 1e-4
SEED = 20_240_229
#: Blocks of crowded buckets have about so many classes.
BLOCK = 512


def layout(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for groups of up to ``n`` classes."""
    bits = min(62, max(8, math.ceil(math.log2(max(n, 1))) + 2))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one; scaled first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def table_keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each vector in each table, as whole numbers."""
    keys = np.zeros((len(units), tables), np.int64)
    planes = hyperplanes(units.shape[1], bits, tables)
    for start in range(0, len(units), 4096):
        signs = (units[start : start + 4096] @ planes >= 0).reshape(-1, tables, bits)
        keys[start : start + 4096] = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return keys


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each list begins; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A digest of group and vector for rows that can link; null for others."""
    values, begins = _lists(batch.column("vector"))  # null components come as NaN
    labels, keys, dims = batch.column("label").to_pylist(), [], []
    for label, a, b in zip(labels, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        vector = np.asarray(values[a:b], np.float64) + 0.0  # no negative zeros
        dims.append(b - a)
        if label is None or not np.isfinite(vector).all() or not vector.any():
            keys.append(None)
        else:
            keys.append(hashlib.blake2b(f"{label}\x00".encode() + vector.tobytes(), digest_size=16).digest())
    kept = ["vec_id", "label", "vector"]
    return pa.RecordBatch.from_arrays(
        [*map(batch.column, kept), pa.array(dims, pa.int32()), pa.array(keys, pa.binary())], names=[*kept, "dim", "key"]
    )


def _signed(bits: int, tables: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, begins = _lists(batch.column("vector"))
        dims = np.diff(begins)
        keys = np.zeros((batch.num_rows, tables), np.int64)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            vectors = values[begins[own][:, None] + np.arange(dim)]
            keys[own] = table_keys(unit(vectors), bits, tables)
        ends = pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32())
        names = ["id", "label", "dim", "n", "vector"]
        return pa.RecordBatch.from_arrays(
            [*map(batch.column, names), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=[*names, "keys"]
        )

    return run


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row that it is connected with."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            frontier = np.array([start])
            while len(frontier):
                root[frontier] = start
                frontier = np.flatnonzero(near[frontier].any(axis=0) & (root < 0))
    return root


def _compared(threshold: float):
    """Links of each block pair: class, links by rows, and the class it hangs on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            begins = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
            flat = members.flatten()
            ids, rows, side = (flat.field(c).to_numpy() for c in ("id", "n", "side"))
            keys = flat.field("keys").flatten().to_numpy().reshape(len(flat), -1)
            values, starts = _lists(flat.field("vector"))
            out_id, out_links, out_root = [], [], []
            for k, t in enumerate(batch.column("t").to_pylist()):
                a, b = begins[k], begins[k + 1]
                units = unit(values[starts[a] : starts[b]].reshape(b - a, -1))
                near = units @ units.T >= threshold
                if batch.column("lo")[k] == batch.column("hi")[k]:
                    np.fill_diagonal(near, False)
                else:
                    near &= side[a:b, None] != side[None, a:b]
                for earlier in range(t):
                    if not near.any():
                        break
                    near &= keys[a:b, earlier, None] != keys[None, a:b, earlier]
                linked = near.any(axis=1)
                if linked.any():
                    out_id.append(ids[a:b][linked])
                    out_links.append((near @ rows[a:b])[linked])
                    out_root.append(ids[a:b][forest(near)[linked]])
            if out_id:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (out_id, out_links, out_root)],
                    names=["id", "links", "root"],
                )

    return run


def links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (``id``, ``links``, ``root``) for classes (``id``, ``label``, ``dim``, ``n``, ``vector``): the sum of
    ``links`` by ``id`` is the number of rows of other classes linked directly, and ``root`` is
    connected with ``id`` by links."""
    largest = classes.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables = layout(largest, threshold)
    schema = classes.select("id", "label", "dim", "n", "vector").schema.add("keys", ArrayType(LongType()))
    signed = stored(by_batch(classes.select("id", "label", "dim", "n", "vector"), _signed(bits, tables), schema), "signed")
    bucket = ["label", "dim", "t", "key"]
    each = signed.select("id", "label", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = stored(each.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    met = each.join(sizes, bucket).select("id", "t", "key", blocks.alias("blocks"))
    placed = met.withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    full = placed.join(signed, "id").select(
        "label", "dim", "t", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
        F.struct("id", "n", "side", "vector", "keys").alias("member"),
    )
    grouped = full.groupBy(*bucket, "lo", "hi").agg(F.collect_list("member").alias("members"))
    return grouped.select("t", "lo", "hi", "members").mapInArrow(_compared(threshold), "id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Columns ``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    given = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    schema = StructType([*given.schema.fields]).add("dim", "integer").add("key", "binary")
    rows = stored(by_batch(given, _keyed, schema), "vectors")
    classes = stored(
        rows.where("key is not null")
        .groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.min("vec_id").alias("least"),
            *[F.first(c).alias(c) for c in ("label", "dim", "vector")],
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    found = stored(links(classes, threshold, block), "links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    narrow = classes.select("id", "key", "n", "least")
    rooted = stored(
        narrow.join(direct, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "least", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "rooted",
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = stored(named.select("key", "n_links", "component_id"), "named")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        rows.select("vec_id", "key")
        .join(named, "key", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def query(spark, folder: str) -> DataFrame:
    """``op12``: near-duplicates among the vectors of each label."""
    return near_duplicates(table(spark, folder, "embeddings"))
