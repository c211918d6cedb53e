"""Index tables: postings, lexicon, lengths and collection statistics.

Postings carry the length of their document, so scoring needs no join for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from siftrank.functions.lengths import quantised_length
from siftrank.operators.analyze import Analyzer, stem_vocabulary, token_arrays


class Index(NamedTuple):
    postings: DataFrame  # term, doc_id, tf, dl
    lexicon: DataFrame  # term, df, ctf
    lengths: DataFrame  # doc_id, dl
    stats: DataFrame  # n_docs, cl, avg_dl, cl_q, avg_dl_q  (one row)
    # Stored indexes only: the postings with ``norm2`` of the document and the ``shard`` of the term, of ``shards``.
    stored: DataFrame | None = None
    shards: int = 0


def shard_of(term: Column, shards: int) -> Column:
    """The part of a stored index that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from token rows."""
    return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def raw_postings(arrays: DataFrame, stem: bool = False) -> DataFrame:
    """(term, doc_id, dl, tf, lead) from token arrays.

    One posting per document has ``lead``: the one of its first token, or a row
    without a term when the document is empty. Selecting the lead rows gives
    the lengths table with neither a second pass over the text nor a shuffle.
    """
    rows = arrays.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens").select(
        "doc_id", "dl", F.posexplode_outer("tokens").alias("pos", "term")
    )
    counts = rows.groupBy("term", "doc_id", "dl").agg(
        F.count("term").alias("tf"), (F.coalesce(F.min("pos"), F.lit(0)) == 0).alias("lead")
    )
    return stemmed_postings(counts) if stem else counts


def stemmed_postings(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Counts of terms as counts of stems. The vocabulary alone is stemmed, and what
    is joined and summed again is a document's distinct terms, not its tokens. With ``parts`` the
    sums come dealt out by document, and are made after that one shuffle."""
    joined = counts.join(stem_vocabulary(counts), "term", "left")
    return (
        (joined if parts is None else joined.repartition(parts, "doc_id")).groupBy(F.col("stem").alias("term"), "doc_id", "dl")
        .agg(F.sum("tf").alias("tf"), F.max("lead").alias("lead"))
    )


def lexicon(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")
    )


def document_lengths(arrays: DataFrame) -> DataFrame:
    """Exact lengths, 0 for an empty document; read off the arrays, no shuffle."""
    return arrays.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def lengths_from_postings(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """Lengths when only postings are at hand; documents without one get 0."""
    sums = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return documents.select("doc_id").distinct().join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce("dl", F.lit(0).cast("long")).alias("dl")
    )


def collection_stats(lengths: DataFrame) -> DataFrame:
    quantised = quantised_length(F.col("dl"))
    return lengths.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("dl").cast("double").alias("cl"),
        F.avg("dl").alias("avg_dl"),
        F.sum(quantised).alias("cl_q"),
        F.avg(quantised).alias("avg_dl_q"),
    )


def build_index(
    documents: DataFrame, text: str = "text", id: str = "doc_id", analyzer: Analyzer = Analyzer()
) -> Index:
    """The four tables as lazy plans. For repeated searches write them first
    (:func:`siftrank.sources.index_store.index_documents`)."""
    arrays = token_arrays(documents, text, id, analyzer)
    postings = (
        raw_postings(arrays, analyzer.stem)
        .where(F.col("term").isNotNull())
        .select("term", "doc_id", "tf", "dl")
    )
    lengths = document_lengths(arrays)
    return Index(postings, lexicon(postings), lengths, collection_stats(lengths))


def from_postings(postings: DataFrame, lengths: DataFrame) -> Index:
    """Complete an index whose postings and lengths changed."""
    return Index(postings, lexicon(postings), lengths, collection_stats(lengths))


def quantised(index: Index) -> Index:
    """The same index with lengths squeezed to three significant bits, and the
    collection sums taken over the squeezed lengths."""
    squeezed = quantised_length(F.col("dl"))
    return index._replace(
        postings=index.postings.withColumn("dl", squeezed),
        stored=None if index.stored is None else index.stored.withColumn("dl", squeezed),
        lengths=index.lengths.withColumn("dl", squeezed),
        stats=index.stats.select(
            "n_docs",
            F.col("cl_q").alias("cl"),
            F.col("avg_dl_q").alias("avg_dl"),
            "cl_q",
            "avg_dl_q",
        ),
    )


def index_from_frequencies(frequencies: DataFrame, documents: DataFrame) -> Index:
    """An index of documents whose text is spread over several rows."""
    lengths = lengths_from_postings(documents, frequencies)
    return from_postings(frequencies.join(lengths, "doc_id"), lengths)


# --- views of the postings -------------------------------------------------


def postings_with_counts(index: Index) -> DataFrame:
    """The long posting table with df and ctf beside each row."""
    return index.postings.join(index.lexicon, "term").select(
        "term", "df", "ctf", "doc_id", "tf"
    )


def posting_blocks(index: Index, block_size: int = 4096) -> DataFrame:
    """Compact postings for export: (term, df, ctf, block, observations).

    A common term would make one huge row, so its documents are spread by hash
    over as many blocks as its df needs; every block stays near ``block_size``.
    """
    blocks = F.ceil(F.col("df") / F.lit(block_size)).cast("long")
    spread = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10)
    rows = postings_with_counts(index).withColumn("block", F.pmod(spread.cast("long"), blocks))
    return rows.groupBy("term", "df", "ctf", "block").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
        ).alias("observations")
    )


def positional_postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, positions); a group is one term of one document."""
    return tokens.groupBy("term", "doc_id").agg(
        F.sort_array(F.collect_list("pos")).alias("positions")
    )


def term_vectors(field_postings: Sequence[DataFrame]) -> DataFrame:
    """(doc_id, term, tf): frequencies summed over the given fields."""
    rows = reduce(DataFrame.unionByName, [p.select("doc_id", "term", "tf") for p in field_postings])
    return rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def document_totals(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("total_tf")
    )


# --- merging ---------------------------------------------------------------


def merge_indexes(parts: Sequence[Index]) -> Index:
    """One index from parts over disjoint documents."""
    postings = reduce(DataFrame.unionByName, [p.postings for p in parts])
    lengths = reduce(DataFrame.unionByName, [p.lengths for p in parts])
    return from_postings(postings, lengths)


def federated_lexicon(sources: dict[str, Index]) -> DataFrame:
    """df and ctf summed over several indexes, with the number of indexes that
    have the term. Each lexicon is already one row per term, so only lexicons
    are shuffled, not postings."""
    rows = reduce(
        DataFrame.unionByName,
        [ix.lexicon.withColumn("source", F.lit(name)) for name, ix in sources.items()],
    )
    return rows.groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("ctf").alias("ctf"), F.count("source").alias("n_sources")
    )


def federated_documents(sources: dict[str, Index]) -> DataFrame:
    """Documents of all indexes, one after another, with their source."""
    return reduce(
        DataFrame.unionByName,
        [ix.lengths.withColumn("source", F.lit(name)) for name, ix in sources.items()],
    )


def join_families(families: Sequence[DataFrame], id: str = "doc_id") -> DataFrame:
    """Tables of the same documents joined side by side; the first table that has
    a column owns it. Fails while running when the tables differ in documents."""
    seen = {id}
    picked = []
    for family in families:
        own = [c for c in family.columns if c not in seen]
        seen.update(own)
        picked.append(family.select(id, *own).withColumn(f"_in{len(picked)}", F.lit(True)))
    joined = reduce(lambda a, b: a.join(b, id, "full_outer"), picked)
    everywhere = reduce(Column.__and__, [F.col(f"_in{i}").isNotNull() for i in range(len(picked))])
    checked = joined.withColumn(
        id,
        F.when(everywhere, F.col(id)).otherwise(
            F.raise_error(F.lit("column families hold different documents")).cast(
                joined.schema[id].dataType
            )
        ),
    )
    return checked.drop(*[f"_in{i}" for i in range(len(picked))])


# --- look-ups --------------------------------------------------------------


def terms_from(lexicon: DataFrame, start: str, limit: int | None = None) -> DataFrame:
    """Terms from ``start`` onward in dictionary order."""
    rows = lexicon.where(F.col("term") >= start).orderBy("term")
    return rows if limit is None else rows.limit(limit)


def terms_with_prefix(lexicon: DataFrame, prefix: str) -> DataFrame:
    return lexicon.where(F.col("term").startswith(prefix))


def look_up(table: DataFrame, terms: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of ``table`` (lexicon or postings) for the given terms."""
    if isinstance(terms, DataFrame):
        return table.join(terms.select("term").distinct(), "term", "left_semi")
    return table.where(F.col("term").isin(list(terms)))


# --- maintenance -----------------------------------------------------------


def documents_with_terms(index: Index, terms: Sequence[str] | DataFrame) -> DataFrame:
    return look_up(index.postings, terms).select("doc_id").distinct()


def delete_documents(index: Index, doc_ids: DataFrame) -> Index:
    """The index without the given documents; statistics are taken again."""
    return from_postings(
        index.postings.join(doc_ids, "doc_id", "left_anti"),
        index.lengths.join(doc_ids, "doc_id", "left_anti"),
    )


def update_documents(index: Index, terms: Sequence[str] | DataFrame, fresh: Index) -> Index:
    """Delete the documents that have one of ``terms``, then add ``fresh``."""
    return merge_indexes([delete_documents(index, documents_with_terms(index, terms)), fresh])


def mark_deleted(documents: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Soft delete: a ``deleted`` flag beside every document."""
    marks = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return (
        documents.join(marks, "doc_id", "left")
        .withColumn("deleted", F.col("_gone").isNotNull())
        .drop("_gone")
    )


def undelete_all(documents: DataFrame) -> DataFrame:
    return documents.withColumn("deleted", F.lit(False))


def document_counts(documents: DataFrame) -> DataFrame:
    """Live and total documents of a table with a ``deleted`` flag."""
    return documents.agg(
        F.count_if(~F.col("deleted")).alias("num_docs"), F.count(F.lit(1)).alias("max_doc")
    )
