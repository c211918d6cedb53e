"""Readers of retrieval file formats. All are plain text scans: large files split,
folders are read recursively, and gz or bz2 files are opened by their extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Text cut at a closing tag, so records never straddle a split."""
    return spark.read.option("recursiveFileLookup", True).option("lineSep", end).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines with their place in the input: file, split, line in split."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.trim("value").alias("value"),
            F.struct(
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("at"),
        )
    )


def read_documents(spark: SparkSession, path: str, end: str = "</DOC>") -> DataFrame:
    """(doc_id, raw) of ``<DOC> <DOCNO> id </DOCNO> ... </DOC>`` records; ``raw`` is
    what follows the id."""
    return (
        _records(spark, path, end)
        .select(
            F.trim(F.regexp_extract("value", r"(?is)<DOC>.*?<DOCNO>\s*(.*?)\s*</DOCNO>", 1)).alias(
                "doc_id"
            ),
            F.regexp_extract("value", r"(?is)</DOCNO>\r?\n?(.*)\z", 1).alias("raw"),
        )
        .where(F.col("doc_id") != "")
    )


def read_topics(spark: SparkSession, path: str, end: str = "</top>") -> DataFrame:
    """(topic_id, title, description). The description is what lies between the
    ``<desc>`` line and the ``<narr>`` line. Ids are strings; numbers come first."""
    return (
        _records(spark, path, end)
        .select(
            F.trim(F.regexp_extract("value", r"(?im)^<num>(?:[^:\n]*:)?([^\n]*)", 1)).alias("topic_id"),
            F.trim(F.regexp_extract("value", r"(?im)^<title>([^\n]*)", 1)).alias("title"),
            F.trim(
                F.regexp_replace(
                    F.regexp_extract("value", r"(?ism)^<desc>[^\n]*\n(.*?)^<narr>", 1),
                    r"^\s+|\s+\z",
                    "",
                )
            ).alias("description"),
        )
        .where(F.col("topic_id") != "")
        .orderBy(F.expr("try_cast(topic_id AS bigint)").asc_nulls_last(), "topic_id")
    )


def _fields(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn(
        "f", F.split("value", r"\s+")
    )


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, doc_id, relevant) of ``topic iteration document grade`` lines.
    Any grade but "0" is relevant; of repeated pairs the last line counts."""
    rows = _fields(_lines(spark, path)).select(
        F.col("f")[0].alias("topic_id"),
        F.upper(F.col("f")[2]).alias("doc_id"),
        (F.col("f")[3] != "0").alias("relevant"),
        "at",
    )
    return rows.groupBy("topic_id", "doc_id").agg(F.max_by("relevant", "at").alias("relevant"))


def read_run(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """(topic_id, doc_id, rank, score, tag[, mean, variance]) of a run file, cut at
    ``depth`` if there is one. Ranks are 0-based in the file and 1-based in the table."""
    f = F.col("f")
    wide = F.size("f") >= 8
    rows = _fields(_lines(spark, path)).select(
        f[0].alias("topic_id"),
        f[2].alias("doc_id"),
        (f[3].cast("int") + 1).alias("rank"),
        f[4].cast("double").alias("score"),
        F.when(wide, F.get(f, F.lit(5)).cast("double")).alias("mean"),
        F.when(wide, F.get(f, F.lit(6)).cast("double")).alias("variance"),
        F.element_at(f, -1).alias("tag"),
    )
    return rows if depth is None else rows.where(F.col("rank") <= depth)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, rating, seq) of ``user \\t item \\t rating [\\t time]`` lines.
    ``seq`` is the place of the line, for taking the last rating of a cell."""
    f = F.split("value", "\t")
    return _lines(spark, path).where(F.col("value") != "").select(
        f[0].cast("long").alias("user_id"),
        f[1].cast("long").alias("item_id"),
        f[2].cast("double").alias("rating"),
        F.col("at").alias("seq"),
    )


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): one word per line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> ''")


# --- the matching record writers -------------------------------------------


def document_record(doc_id: Column, raw: Column) -> Column:
    return F.concat(
        F.lit("<DOC>\n<DOCNO> "), doc_id.cast("string"), F.lit(" </DOCNO>\n"), raw, F.lit("\n</DOC>")
    )


def topic_record(topic_id: Column, title: Column, description: Column) -> Column:
    return F.concat(
        F.lit("<top>\n<num> Number: "), topic_id.cast("string"),
        F.lit("\n<title> "), title,
        F.lit("\n<desc> Description:\n"), description,
        F.lit("\n<narr> Narrative:\n\n</top>"),
    )
