"""The index as tables, written once and searched many times.

Postings are bucketed by document and sorted by term inside a bucket. Scoring
sums per (topic, document), so with a query table small enough to be broadcast
no match is shuffled: each bucket scores its own documents and only its best
hits travel. Inside a bucket postings lie in parts by a hash of the term, so a search
opens only the parts of its terms: Spark prunes the others when it has the query terms.
The sort keeps row groups narrow in ``term``, so a look-up of a term skips most of a file.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from siftrank.operators.analyze import Analyzer, token_arrays
from siftrank.operators.index import Index, collection_stats, lexicon, raw_postings, shard_of, stemmed_postings
from siftrank.session import write_and_reload

#: Parts by term that an index gets unless told otherwise.
SHARDS = 16


#: Bytes of text in a bucket, and bytes of text a token stands for where only lengths are at hand.
BUCKET = 12_000_000
TOKEN = 6


def default_buckets(spark: SparkSession, size: float = 0) -> int:
    """As many buckets as the session has shuffle partitions, or more when they would have over
    ``BUCKET`` of the ``size`` bytes of text: one task makes, sorts and scores a bucket, so what it
    holds must not grow with the collection."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET))


def index_documents(
    documents: DataFrame,
    path: str,
    text: str = "text",
    id: str = "doc_id",
    analyzer: Analyzer = Analyzer(),
    buckets: int | None = None,
    shards: int = SHARDS,
) -> Index:
    """Build from text and store, in ``buckets`` by document and ``shards`` by term.

    The one shuffle moves the texts, by document, before they grow into tokens;
    a document's tokens are then counted where they are. Lexicon, lengths and
    statistics are derived from the stored postings, so the text is read and
    tokenized once.
    """
    spark = documents.sparkSession
    n = buckets or default_buckets(spark, _total(documents, F.octet_length(F.col(text))))
    texts = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    arrays = token_arrays(texts.repartition(n, "doc_id"), analyzer=analyzer)
    counts = raw_postings(arrays)
    if analyzer.stem:  # written first: the vocabulary and the join both read the counts
        counts = stemmed_postings(write_and_reload(counts, "counts"), n)
    stored = _write_bucketed(_with_norms(counts), f"{path}/postings", n, shards)
    _by_term(lexicon(stored.where(F.col("term").isNotNull()))).write.parquet(f"{path}/lexicon")
    stored.where("lead").select("doc_id", "dl").write.parquet(f"{path}/lengths")
    collection_stats(spark.read.parquet(f"{path}/lengths")).write.parquet(f"{path}/stats")
    return _open(spark, path, stored, shards)


def write_index(index: Index, path: str, buckets: int | None = None, shards: int = SHARDS) -> Index:
    """Store any index (a merged one, say)."""
    spark = index.postings.sparkSession
    index.lengths.write.parquet(f"{path}/lengths")
    tokens = _total(spark.read.parquet(f"{path}/lengths"), F.col("dl"))
    n = buckets or default_buckets(spark, TOKEN * tokens)
    stored = _write_bucketed(_with_norms(index.postings.repartition(n, "doc_id")), f"{path}/postings", n, shards)
    _by_term(index.lexicon).write.parquet(f"{path}/lexicon")
    index.stats.write.parquet(f"{path}/stats")
    return _open(spark, path, stored, shards)


def read_index(spark: SparkSession, path: str) -> Index:
    """Open an index another session wrote."""
    schema = spark.read.parquet(f"{path}/postings").schema
    layout = spark.read.parquet(f"{path}/postings-layout").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def create(table: str) -> None:
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (shard) CLUSTERED BY (doc_id) "
            f"SORTED BY (term, doc_id) INTO {layout.buckets} BUCKETS LOCATION '{path}/postings'"
        )

    return _open(spark, path, _through_catalog(spark, create), layout.shards)


def _total(df: DataFrame, value: Column) -> float:
    return df.agg(F.sum(value.cast("double"))).first()[0] or 0.0


def _with_norms(postings: DataFrame) -> DataFrame:
    """The squared norm of its document beside each posting; rows lie by document, so nothing moves."""
    of_document = W.partitionBy("doc_id")
    return postings.withColumn("norm2", F.sum(F.col("tf") * F.col("tf")).over(of_document))


def _write_bucketed(postings: DataFrame, path: str, n: int, shards: int) -> DataFrame:
    """Rows come partitioned by document, so every task fills one bucket of each shard."""
    spark = postings.sparkSession

    def create(table: str) -> None:
        (
            postings.withColumn("shard", shard_of(F.col("term"), shards))
            .write.format("parquet")
            .partitionBy("shard")
            .bucketBy(n, "doc_id")
            .sortBy("term", "doc_id")
            .option("path", path)
            .saveAsTable(table)
        )

    stored = _through_catalog(spark, create)
    layout = spark.range(1).select(F.lit(n).alias("buckets"), F.lit(shards).alias("shards"))
    layout.write.parquet(f"{path}-layout")
    return stored


#: Whether the catalog keeps the partitions of a table; if not, they are found among its files.
_PARTITIONS = "spark.sql.hive.manageFilesourcePartitions"


def _through_catalog(spark: SparkSession, create: Callable[[str], None]) -> DataFrame:
    """Spark knows buckets only from a table. The table goes again once it is opened;
    it is an external one, so its files stay, and what reads them needs no catalog."""
    table, kept = f"postings_{uuid.uuid4().hex}", spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, "false")
    try:
        create(table)
        opened = spark.table(table)
        opened.schema  # resolved now
    finally:
        spark.conf.set(_PARTITIONS, kept)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return opened


def _open(spark: SparkSession, path: str, postings: DataFrame, shards: int) -> Index:
    rows = postings.where(F.col("term").isNotNull())
    return Index(
        rows.select("term", "doc_id", "tf", "dl"),
        spark.read.parquet(f"{path}/lexicon"),
        spark.read.parquet(f"{path}/lengths"),
        spark.read.parquet(f"{path}/stats"),
        rows.select("term", "doc_id", "tf", "dl", "norm2", "shard"),
        shards,
    )


def _by_term(lexicon: DataFrame) -> DataFrame:
    """Range-sorted, so that look-ups and prefix scans read few row groups."""
    return lexicon.repartitionByRange("term").sortWithinPartitions("term")


def fetch_posting(index: Index, term: str) -> DataFrame:
    """Postings of one term; the comparison reaches the scan and prunes row groups, the shard all other parts."""
    if index.stored is None:
        return index.postings.where(F.col("term") == term)
    shard = F.col("shard") == shard_of(F.lit(term), index.shards)
    return index.stored.where((F.col("term") == term) & shard).select("term", "doc_id", "tf", "dl")


def fetch_length(index: Index, doc_id) -> DataFrame:
    return index.lengths.where(F.col("doc_id") == doc_id)


def read_meta(index: Index) -> DataFrame:
    """(key, value): collection length and number of documents."""
    return index.stats.select(
        F.explode(
            F.create_map(
                F.lit("CollectionLength"),
                F.col("cl").cast("long"),
                F.lit("NumberOfDocuments"),
                F.col("n_docs"),
            )
        ).alias("key", "value")
    )
