"""Writers of run files, submission reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftrank.operators.evaluate import judge


def _sorted_by_rank(run: DataFrame, *keys: str) -> DataFrame:
    return run.repartitionByRange(*keys, "rank").sortWithinPartitions(*keys, "rank")


def _file_rank() -> Column:
    """Ranks are 1-based in tables and 0-based in files."""
    return (F.col("rank") - 1).cast("string")


def run_lines(run: DataFrame, tag: str = "test") -> DataFrame:
    """Six tab-separated columns, or eight when the run has mean and variance."""
    extra = [c for c in ("mean", "variance") if c in run.columns]
    return run.select(
        F.concat_ws(
            "\t",
            F.col("topic_id").cast("string"),
            F.lit("Q0"),
            F.col("doc_id").cast("string"),
            _file_rank(),
            *[F.col(c).cast("string") for c in ("score", *extra)],
            F.lit(tag),
        ).alias("value")
    )


def write_run(run: DataFrame, path: str, tag: str = "test", compression: str = "none") -> None:
    run_lines(_sorted_by_rank(run, "topic_id"), tag).write.text(path, compression=compression)


def report_lines(run: DataFrame, name: str) -> DataFrame:
    """The padded variant: document in 20 places, rank in 7, four decimals."""
    extra = [c for c in ("mean", "variance") if c in run.columns]

    def padded(text: Column, width: int) -> Column:
        return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))

    return run.select(
        F.concat_ws(
            " \t ",
            F.col("topic_id").cast("string"),
            F.lit("Q0"),
            padded(F.col("doc_id").cast("string"), 20),
            padded(_file_rank(), 7),
            *[F.format_string("%.4f", F.col(c)) for c in ("score", *extra)],
            F.lit(name),
        ).alias("value")
    )


def write_report(run: DataFrame, path: str, name: str) -> None:
    report_lines(_sorted_by_rank(run, "topic_id"), name).write.text(path)


def relevant_scores(run: DataFrame, judgements: DataFrame) -> DataFrame:
    """(doc_id, topic_id, rank, score) of the relevant hits, rank 0-based as in the file."""
    return judge(run, judgements).where("relevant").select(
        "doc_id", "topic_id", (F.col("rank") - 1).alias("rank"), "score"
    )


def write_relevant_scores(run: DataFrame, judgements: DataFrame, path: str) -> None:
    relevant_scores(run, judgements).write.csv(path, sep="\t")


def export_correlations(corr: DataFrame, path: str) -> DataFrame:
    """Write (topic_id, a, b, corr) sorted by topic and return what was written."""
    corr.repartitionByRange("topic_id", "a").sortWithinPartitions("topic_id", "a", "b").write.parquet(
        path
    )
    return corr.sparkSession.read.schema(corr.schema).parquet(path)
