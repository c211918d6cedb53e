"""Queries: file formats. Each writes a given table in the format and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.catalog.retrieval import POSTERIOR
from siftrank.functions import models
from siftrank.operators import search as S
from siftrank.session import scratch_path
from siftrank.sources import files, sinks
from siftrank.sources.tables import load, parts_of

CATALOG = Catalog()

_ONE_LINE = r"\s+"


def _write_lines(df: DataFrame, label: str, compression: str = "none") -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.text(path, compression=compression)
    return path


def _document_file(spark, folder, compression="none") -> str:
    docs = load(spark, folder, "documents")
    return _write_lines(
        docs.select(files.document_record(F.col("doc_id"), F.col("text"))), "docs", compression
    )


_DOCS_SQL = r"SELECT doc_id::VARCHAR AS doc_id, rtrim(text, chr(10)) AS raw FROM documents"


@CATALOG.add("read_documents", _DOCS_SQL)
def read_documents(spark, folder):
    docs = files.read_documents(spark, _document_file(spark, folder))
    return docs.withColumn("raw", F.rtrim(F.col("raw"), F.lit("\n")))


@CATALOG.add("read_compressed_documents", _DOCS_SQL)
def read_compressed_documents(spark, folder):
    docs = files.read_documents(spark, _document_file(spark, folder, "gzip"))
    return docs.withColumn("raw", F.rtrim(F.col("raw"), F.lit("\n")))


@CATALOG.add(
    "read_topics",
    r"""SELECT item_id::VARCHAR AS topic_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS description FROM benchmark""",
)
def read_topics(spark, folder):
    title = F.trim(F.regexp_replace("text", _ONE_LINE, " "))
    records = load(spark, folder, "benchmark").select(
        files.topic_record(F.col("item_id"), title, F.col("text"))
    )
    return files.read_topics(spark, _write_lines(records, "topics"))


@CATALOG.add(
    "read_judgements",
    f"WITH {I.JUDGED} SELECT topic_id::VARCHAR AS topic_id, 'D' || doc_id AS doc_id, relevant FROM judged",
)
def read_judgements(spark, folder):
    lines = I.stored_judgements(spark, folder).select(
        F.concat_ws(
            " ",
            F.col("topic_id").cast("string"),
            F.lit("0"),
            F.concat(F.lit("d"), F.col("doc_id").cast("string")),
            F.col("relevant").cast("int").cast("string"),
        )
    )
    return files.read_judgements(spark, _write_lines(lines, "qrels"))


@CATALOG.add(
    "run_round_trip",
    f"WITH {I.BM25_RUN} SELECT topic_id::VARCHAR AS topic_id, doc_id::VARCHAR AS doc_id, rank, score, 'test' AS tag FROM run",
)
def run_round_trip(spark, folder):
    path = scratch_path(spark, "run-file")
    sinks.write_run(I.run(spark, folder), path)
    return files.read_run(spark, path).select("topic_id", "doc_id", "rank", "score", "tag")


@CATALOG.add(
    "meanvar_run_round_trip",
    f"""WITH {POSTERIOR}, scored AS (SELECT topic_id, doc_id, round(sum(qtf * (mu - 2 * sqrt(var))), 4) AS score,
  sum(qtf * mu) AS mean, sum(qtf * var) AS variance FROM post3 GROUP BY ALL)
SELECT topic_id::VARCHAR AS topic_id, doc_id::VARCHAR AS doc_id, rank, score, round(mean, 3) AS mean, round(variance, 2) AS variance, 'test' AS tag FROM (SELECT *,
  row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 1000""",
)
def meanvar_run_round_trip(spark, folder):
    run = S.mean_variance_search(
        I.corpus_index(spark, folder),
        I.prepared_terms(spark, folder),
        models.risk_adjusted(a=2.0),
        k=1000,
        decimals=4,
    )
    path = scratch_path(spark, "run-file")
    sinks.write_run(run, path)
    return files.read_run(spark, path).select(
        "topic_id",
        "doc_id",
        "rank",
        "score",
        F.round("mean", 3).alias("mean"),
        F.round("variance", 2).alias("variance"),
        "tag",
    )


@CATALOG.add(
    "submission_report",
    f"""WITH {I.BM25_RUN} SELECT topic_id || ' ' || chr(9) || ' Q0 ' || chr(9) || ' ' || rpad(doc_id::VARCHAR, 20, ' ')
  || ' ' || chr(9) || ' ' || rpad((rank - 1)::VARCHAR, 7, ' ') || ' ' || chr(9) || ' ' || CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 4))
  || ' ' || chr(9) || ' bm25' AS line FROM run""",
)
def submission_report(spark, folder):
    path = scratch_path(spark, "report")
    sinks.write_report(I.run(spark, folder), path, "bm25")
    return spark.read.text(path).withColumnRenamed("value", "line")


@CATALOG.add(
    "relevant_scores",
    f"WITH {I.JUDGED} SELECT doc_id, topic_id, rank - 1 AS rank, score FROM jr WHERE relevant",
)
def relevant_scores(spark, folder):
    path = scratch_path(spark, "relevant-scores")
    sinks.write_relevant_scores(
        I.run(spark, folder), I.stored_judgements(spark, folder), path
    )
    return spark.read.schema("doc_id long, topic_id long, rank long, score double").csv(
        path, sep="\t"
    )


@CATALOG.add("read_ratings", f"WITH {I.RATINGS} SELECT user_id, item_id, rating FROM rt")
def read_ratings(spark, folder):
    from siftrank.operators.recommend import latest_ratings

    path = scratch_path(spark, "ratings-file")
    I.ratings(spark, folder).select("user_id", "item_id", "rating", F.lit(0)).write.csv(
        path, sep="\t"
    )
    events = files.read_ratings(spark, path)
    return latest_ratings(events, parts=parts_of(spark, I.ratings(spark, folder).count()))
