"""From pages and raw records to document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siftrank.functions import dates, html as H


def extract_pages(
    pages: DataFrame, html: str = "html", id: str = "page_id", formats: Sequence[str] = dates.HEADER_FORMATS
) -> DataFrame:
    """(doc_id, title, body, doc_date, props) of HTML pages. All of it is column
    work in one stage, without a shuffle."""
    page = F.col(html)
    return (
        pages.select(
            F.col(id).alias("doc_id"),
            H.title(page).alias("title"),
            H.body_text(page).alias("body"),
            H.meta_tags(page).alias("props"),
        )
        .withColumn("doc_date", dates.parse_any(F.try_element_at("props", F.lit("date")), formats))
        .select("doc_id", "title", "body", "doc_date", "props")
    )


def page_summaries(pages: DataFrame, html: str = "html", id: str = "page_id") -> DataFrame:
    """(doc_id, summary)."""
    page = F.col(html)
    texts = pages.select(
        F.col(id).alias("doc_id"),
        H.title(page).alias("title"),
        H.body_text(page, with_title=False).alias("text"),
    )
    return texts.select("doc_id", H.summary(F.col("text"), F.col("title")).alias("summary"))


def chunk_pattern(size: int) -> str:
    """A chunk: the rest when it is no longer than ``size``; else up to the first
    white space at offsets ``size - 1`` to ``size + 19``; else ``size`` characters."""
    return (
        rf"(?s)(.{{1,{size}}}\z|.{{{size - 1},{size + 19}}}?(?=\s)|.{{{size}}})"
    )


def chunk_documents(
    documents: DataFrame, size: int, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, text). Joined up, the chunks of a document are
    its whole text."""
    if size < 2:
        raise ValueError("chunk size must be at least 2")
    return documents.select(
        F.col(id).alias("doc_id"),
        F.posexplode(
            F.regexp_extract_all(F.col(text), F.lit(chunk_pattern(size)), F.lit(1))
        ).alias("chunk_no", "text"),
    ).select(
        "doc_id",
        "chunk_no",
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias(
            "chunk_id"
        ),
        "text",
    )


def stored_fields(
    documents: DataFrame, fields: Sequence[str], ids: DataFrame | None = None
) -> DataFrame:
    """Named fields of all documents, or of those in ``ids`` (doc_id)."""
    picked = documents.select("doc_id", *fields)
    if ids is None:
        return picked
    return picked.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def gather_values(
    rows: DataFrame, id: str, pos: str, value: str, block_size: int | None = None
) -> DataFrame:
    """(id, block, values): the values of a repeated field in order.

    With ``block_size`` the values come in rows of at most that many positions,
    for fields of which one document may have very many.
    """
    block = F.lit(0) if block_size is None else F.floor(F.col(pos) / F.lit(block_size))
    return (
        rows.groupBy(id, block.cast("long").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(value)))).alias("_v"))
        .select(id, "block", F.transform("_v", lambda v: v[value]).alias("values"))
    )


def corpus_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents, characters and distinct texts. Texts are told apart by a 256-bit
    digest, so the exact count shuffles digests and not the texts."""
    return documents.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.length(text)).alias("n_chars"),
        F.count_distinct(F.sha2(text, 256)).alias("n_texts"),
    )
