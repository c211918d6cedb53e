"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit position set in most of its shingles'
hashes. Fingerprints link when they differ in few bits. To find all such pairs, the
bit positions are labelled with the non-zero vectors of a binary space with one
dimension more than the radius, and each non-zero vector makes a table whose mask
keeps the positions with an odd inner product. Whatever positions a linked pair
differs in, their labels leave one vector orthogonal to all of them, so the pair
agrees on that table's mask: no link is missed, unlike with random masks.

Copies meet before any table is made: tables hold each different fingerprint once. A
bucket emits a spanning forest of its links, never its pairs. A crowded bucket is
masked once more, in the same manner, over the positions its mask leaves out; what
then agrees can differ in at most 17 positions, which bounds a bucket whatever the
input.

Null and empty texts, and texts without a word, have the fingerprint zero. Rows whose
doc_id is null take part, but an id of a component is the least that is not null (null if all
are). Repeated rows are linked like any copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import by_batch, carried, stored, table, text_of
from siftrank.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42

#: Buckets with more different fingerprints than this are masked a second time.
CROWDED = 2048


def fingerprint(text: str) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    width = min(SHINGLE, len(words))
    starts = [0] + [end + 1 for end in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    return majority_bits(np.array(hashes, dtype="<u8"))


def majority_bits(hashes: np.ndarray) -> int:
    set_in = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):  # bounds the unpacked bits of a long text
        part = hashes[start : start + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(positions: Sequence[int], radius: int = RADIUS) -> list[int]:
    """Masks of which one at least leaves out any ``radius`` of the positions."""
    vectors = 2 ** (radius + 1) - 1
    label = {position: 1 + k % vectors for k, position in enumerate(positions)}
    return [
        sum(1 << position for position in positions if (label[position] & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


MASKS = covering_masks(range(BITS))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made.view(np.int64))], names=["row", "fp"])


def fingerprints(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` with the columns ``carry``, and the fingerprint ``fp`` as a signed long."""
    rows = docs.select(carried(docs, carry).alias("row"), text_of().alias("text"))
    return by_batch(rows, _fingerprints, rows.drop("text").schema.add("fp", "long"))


def _masked(masks: Sequence[int]) -> Column:
    """A table number and the masked fingerprint for each mask."""
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for k, mask in enumerate(masks)
    ]))


def spanning_forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what the links of all pairs of ``values`` connect.

    ``values`` are signed, as Spark has them; bits are counted without a sign, since
    ``bitwise_count`` counts those of the absolute value.
    """
    left, links = values.view(np.uint64), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            value = reached.pop()
            near = np.bitwise_count(left ^ value) <= radius
            if near.any():
                found = left[near]
                links += [(_signed(int(value)), _signed(int(other))) for other in found]
                reached.extend(found)
                left = left[~near]
    return links


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [
            link
            for values in batch.column("values").to_pylist()
            for link in spanning_forest(np.array(values, dtype=np.int64))
        ]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all the fingerprints ``fp`` within the radius.

    A forest of each bucket, not all pairs: connected values are those of all pairs.
    """
    tables = prints.select("fp", _masked(MASKS).alias("t")).select("fp", "t.*")
    buckets = stored(
        tables.groupBy("mask", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "buckets",
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    twos = buckets.where((F.col("n") == 2) & near).select("a", "b")
    many = stored(tables.join(buckets.where("n > 2").select("mask", "key", "n"), ["mask", "key"]), "crowded")
    usual = many.where(F.col("n") <= CROWDED).select("mask", "key", F.lit(0).alias("sub"), "fp")
    second = [[mask | more for more in covering_masks([i for i in range(BITS) if not mask >> i & 1])] for mask in MASKS]
    crowded = many.where(F.col("n") > CROWDED).select(
        "mask",
        "fp",
        F.explode(F.transform(
            F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in second]), F.col("mask") + 1),
            lambda mask, k: F.struct((k + 1).alias("sub"), F.col("fp").bitwiseAND(mask).alias("key")),
        )).alias("t"),
    ).select("mask", "t.key", "t.sub", "fp")
    lists = (
        usual.unionByName(crowded).groupBy("mask", "sub", "key")
        .agg(F.collect_list("fp").alias("values")).where(F.size("values") > 1).select("values")
    )
    return twos.unionByName(lists.mapInArrow(_forests, "a long, b long")).distinct()


def with_components(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``fp``) and ``root``, the same for all connected fingerprints."""
    prints = rows.select("fp").distinct()
    roots = components(links(prints))
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row."""
    rows = stored(fingerprints(docs).select("row.doc_id", "fp"), "fingerprints")
    rooted = stored(with_components(rows), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least doc_id, nulls last."""
    rows = stored(
        fingerprints(docs, docs.columns).withColumn("n", F.monotonically_increasing_id()), "fingerprints"
    )
    narrow = rows.select("fp", "n", F.col("row.doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("n"))).alias("first")
    kept = with_components(narrow).groupBy("root").agg(first).select(F.col("first.n").alias("n"))
    return rows.join(kept, "n", "left_semi").select("row.*")


def query(spark, folder: str) -> DataFrame:
    """``op2``: fingerprint and component of every document."""
    return near_duplicates(table(spark, folder, "documents"))
