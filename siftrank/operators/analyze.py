"""Text analysis: from a text column to rows of tokens."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, Window as W

from siftrank.functions import text as T
from siftrank.functions.stems import with_stems
from siftrank.session import write_and_reload


class Analyzer(NamedTuple):
    """One chain for documents and queries alike; each stage can be switched off."""

    tokenizer: str = "letters"
    stop_words: Sequence[str] = ()
    ignore_case: bool = False
    stem: bool = False
    max_tokens: int | None = None


def token_arrays(
    df: DataFrame, text: str = "text", id: str = "doc_id", analyzer: Analyzer = Analyzer()
) -> DataFrame:
    """(doc_id, tokens): tokenized, stop words out, capped. Stemming comes later,
    on the vocabulary; it never changes a length."""
    tokens = T.TOKENIZERS[analyzer.tokenizer](F.coalesce(F.col(text), F.lit("")))
    if analyzer.stop_words:
        tokens = T.without_words(tokens, analyzer.stop_words, analyzer.ignore_case)
    if analyzer.max_tokens is not None:
        tokens = F.slice(tokens, 1, analyzer.max_tokens)
    return df.select(F.col(id).alias("doc_id"), tokens.alias("tokens"))


def analyze(
    df: DataFrame, text: str = "text", id: str = "doc_id", analyzer: Analyzer = Analyzer()
) -> DataFrame:
    """(doc_id, pos, term). Positions count the tokens kept. No shuffle without stemming."""
    rows = token_arrays(df, text, id, analyzer).select(
        "doc_id", F.posexplode("tokens").alias("pos", "term")
    )
    return stem_tokens(rows) if analyzer.stem else rows


def stem_tokens(tokens: DataFrame, term: str = "term") -> DataFrame:
    """Token rows with stems in place of terms; only the vocabulary is stemmed."""
    stems = stem_vocabulary(tokens.select(F.col(term).alias("_term")), "_term", "_stem")
    joined = tokens.join(stems, F.col(term) == F.col("_term"), "left")
    return joined.withColumn(term, F.col("_stem")).drop("_term", "_stem")


def stem_vocabulary(terms: DataFrame, term: str = "term", stem: str = "stem") -> DataFrame:
    """Each distinct term with its stem, written once: a condition on a stem, such as
    that of a join, would otherwise be pushed down through all the steps that make it."""
    distinct = terms.where(F.col(term).isNotNull()).select(term).distinct()
    return write_and_reload(with_stems(distinct, term, stem), "stems")


def remove_stop_words(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Stop filter for a list held as a DataFrame (one column, ``term``).

    Positions count the tokens kept, as with a list in the analyzer; the window
    that counts them holds one document at a time. The list is stored, so that Spark knows its size: below the
    broadcast threshold tokens stay where their documents lie and are not shuffled by term.
    """
    words = write_and_reload(stop_words.select("term").distinct(), "stop-words")
    kept = tokens.join(words, "term", "left_anti")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return kept.withColumn("pos", place)


def token_offsets(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, term, start, end) of every letter token of the original text.

    The text is cut into tokens and the gaps between them; a running sum of the
    piece lengths gives the offsets. The window holds one document at a time.
    """
    pieces = df.select(
        F.col(id).alias("doc_id"),
        F.posexplode(
            F.regexp_extract_all(F.col(text), F.lit(T.LETTER_RUN_OR_GAP), F.lit(1))
        ).alias("piece_no", "piece"),
    )
    is_token = F.col("piece").rlike(r"^\p{L}")
    so_far = W.partitionBy("doc_id").orderBy("piece_no")
    return (
        pieces.select(
            "doc_id",
            F.lower("piece").alias("term"),
            is_token.alias("is_token"),
            F.length("piece").alias("width"),
            F.sum(F.length("piece")).over(so_far).alias("end"),
            (F.sum(is_token.cast("int")).over(so_far) - 1).alias("pos"),
        )
        .where("is_token")
        .select(
            "doc_id",
            F.col("pos").cast("int").alias("pos"),
            "term",
            (F.col("end") - F.col("width")).cast("int").alias("start"),
            F.col("end").cast("int").alias("end"),
        )
    )


def cap_tokens(tokens: DataFrame, cap: int = 10_000) -> DataFrame:
    """Keep the first ``cap`` tokens of each document."""
    return tokens.where(F.col("pos") < cap)
