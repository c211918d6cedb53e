"""Judging runs and measuring them.

Every metric at a cutoff is a conditional sum, so one hash aggregate per topic
gives them all; only average precision and recall points need the order of the
relevant hits, and they look at those hits alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from siftrank.operators.positions import with_running_count

# The cutoffs at which gain is recorded and the rank of k-call.
NDCG_CUTOFFS = (1, 5, 10, 15, 20, 35, 50, 70, 100, 200, 250, 400, 500, 600, 700, 1000)
CALL_RANK = 10
MRR_CUTOFF = 5
# Fixed rule: the precision cutoffs of the report.
PRECISION_CUTOFFS = (*range(1, 21), *range(21, 200, 20), *range(200, 1001, 50))


def _match_key(df: DataFrame, column: str) -> Column:
    """String ids match without regard to case or outer spaces."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.upper(F.trim(column))
    return F.col(column)


def judge(run: DataFrame, judgements: DataFrame) -> DataFrame:
    """The run with ``relevant`` beside each hit; unjudged hits are not relevant."""
    verdicts = judgements.where("relevant").select(
        F.col("topic_id").alias("_topic"), _match_key(judgements, "doc_id").alias("_doc")
    ).distinct().withColumn("_hit", F.lit(True))
    return (
        run.join(
            verdicts,
            (F.col("topic_id") == F.col("_topic")) & (_match_key(run, "doc_id") == F.col("_doc")),
            "left",
        )
        .withColumn("relevant", F.col("_hit").isNotNull())
        .drop("_topic", "_doc", "_hit")
    )


def relevant_counts(judgements: DataFrame) -> DataFrame:
    """Judged-relevant documents per topic."""
    return judgements.groupBy("topic_id").agg(F.count_if("relevant").alias("relevant_count"))


def check_consistency(topics: DataFrame, judgements: DataFrame) -> DataFrame:
    """Topics without a relevant judgement and judged topics that are unknown."""
    have = judgements.where("relevant").select("topic_id").distinct()
    known = topics.select("topic_id").distinct()
    missing = known.join(have, "topic_id", "left_anti").withColumn(
        "reason", F.lit("topic without relevant judgements")
    )
    unknown = have.join(known, "topic_id", "left_anti").withColumn(
        "reason", F.lit("judged topic not in the topic set")
    )
    return missing.unionByName(unknown)


# --- metrics ---------------------------------------------------------------


def _hits_within(n: int) -> Column:
    return F.count_if(F.col("relevant") & (F.col("rank") <= n))


def precision_at(n: int) -> Column:
    """Beyond the end of the list the divisor stays ``n``."""
    return _hits_within(n) / F.lit(n)


def ndcg_at(n: int) -> Column:
    """Binary gain, logarithmic discount, an ideal list that is relevant all the
    way; 0 unless the list reaches rank ``n``."""
    ideal = sum(_discount(r) for r in range(1, n + 1))
    gain = F.sum(
        F.when(F.col("relevant") & (F.col("rank") <= n), 1.0 / F.log(1.0 + F.col("rank"))).otherwise(0.0)
    )
    return F.when(F.max("rank") >= n, gain / F.lit(ideal)).otherwise(F.lit(0.0))


def _discount(rank: int) -> float:
    import math

    return 1.0 / math.log(1.0 + rank)


def call_at(k: int, rank: int = CALL_RANK) -> Column:
    """1 when at least ``k`` of the first ``rank`` hits are relevant and the list
    is that long."""
    return ((F.max("rank") >= rank) & (_hits_within(rank) >= k)).cast("int")


def reciprocal_rank(cutoff: int = MRR_CUTOFF) -> Column:
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return F.when(first <= cutoff, 1.0 / first).otherwise(F.lit(0.0))


def _per_topic(judged: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    return judged.groupBy(*keys).agg(*[c.alias(name) for name, c in columns.items()])


def precision(
    judged: DataFrame, cutoffs: Sequence[int] = (5, 10, 20), keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    return _per_topic(judged, keys, {f"p_{n}": precision_at(n) for n in cutoffs})


def ndcg(
    judged: DataFrame, cutoffs: Sequence[int] = NDCG_CUTOFFS, keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    return _per_topic(judged, keys, {f"ndcg_{n}": ndcg_at(n) for n in cutoffs})


def calls(
    judged: DataFrame, ks: Sequence[int] = range(1, 11), keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    return _per_topic(judged, keys, {f"call_{k}": call_at(k) for k in ks})


def reciprocal_ranks(
    judged: DataFrame, cutoff: int = MRR_CUTOFF, keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    return _per_topic(judged, keys, {"rr": reciprocal_rank(cutoff)})


def recall_points(judged: DataFrame, keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """(topic_id, rank, found): rank and running count of each relevant hit."""
    hits = judged.where("relevant").select(*keys, "rank")
    return with_running_count(hits, keys, "rank", "found")


def average_precision(
    judged: DataFrame, judgements: DataFrame, keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    """Sum of the precisions at relevant ranks over the number of relevant documents."""
    sums = recall_points(judged, keys).groupBy(*keys).agg(
        F.sum(F.col("found") / F.col("rank")).alias("precision_sum")
    )
    topics = judged.select(*keys).distinct()
    return (
        topics.join(relevant_counts(judgements), "topic_id", "left")
        .join(sums, list(keys), "left")
        .select(
            *keys,
            F.when(
                F.col("relevant_count") > 0,
                F.coalesce("precision_sum", F.lit(0.0)) / F.col("relevant_count"),
            )
            .otherwise(F.lit(0.0))
            .alias("ap"),
        )
    )


def recall(
    judged: DataFrame, judgements: DataFrame, keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    """Found over known relevant documents; with none known, the precision."""
    found = judged.groupBy(*keys).agg(
        F.count_if("relevant").alias("found"), F.count(F.lit(1)).alias("retrieved")
    )
    return found.join(relevant_counts(judgements), "topic_id", "left").select(
        *keys, _recall().alias("recall")
    )


def _recall() -> Column:
    known = F.coalesce("relevant_count", F.lit(0))
    return F.when(known > 0, F.col("found") / known).otherwise(F.col("found") / F.col("retrieved"))


def metrics(
    judged: DataFrame,
    judgements: DataFrame,
    precisions: Sequence[int] = PRECISION_CUTOFFS,
    gains: Sequence[int] = NDCG_CUTOFFS,
    mrr_cutoff: int = MRR_CUTOFF,
    keys: Sequence[str] = ("topic_id",),
) -> DataFrame:
    """One row per topic with every metric."""
    columns = {
        "retrieved": F.count(F.lit(1)),
        "found": F.count_if("relevant"),
        "rr": reciprocal_rank(mrr_cutoff),
        **{f"call_{k}": call_at(k) for k in range(1, 11)},
        **{f"ndcg_{n}": ndcg_at(n) for n in gains},
        **{f"p_{n}": precision_at(n) for n in precisions},
    }
    rest = [name for name in columns if name not in ("retrieved", "found")]
    return (
        _per_topic(judged, keys, columns)
        .join(relevant_counts(judgements), "topic_id", "left")
        .join(average_precision(judged, judgements, keys), list(keys))
        .select(
            *keys,
            "retrieved",
            "found",
            F.coalesce("relevant_count", F.lit(0)).cast("long").alias("relevant_count"),
            "ap",
            _recall().alias("recall"),
            *rest,
        )
    )


def average(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over the topics that have a relevant judgement, with their number."""
    skip = {"topic_id", *by}
    values = [c for c in metrics.columns if c not in skip]
    return (
        metrics.where(F.col("relevant_count") > 0)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("topics"),
            *[F.avg(c).alias("map" if c == "ap" else c) for c in values],
        )
    )


# --- reports ---------------------------------------------------------------


def report_long(metrics: DataFrame, keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """(topic_id, metric, value), three decimals. A precision past the end of the
    list is left out, as in the printed report."""
    values = [c for c in metrics.columns if c not in keys]
    long = metrics.select(
        *keys,
        F.col("retrieved").alias("_length"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 3).alias("value")
                    )
                    for c in values
                ]
            )
        ).alias("m"),
    ).select(*keys, "_length", "m.metric", "m.value")
    cutoff = F.regexp_extract("metric", r"^p_(\d+)$", 1)
    return long.where(
        (cutoff == "") | (F.try_to_number(cutoff, F.lit("99999")) < F.col("_length"))
    ).drop("_length")


def report_wide(
    long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("topic_id",)
) -> DataFrame:
    """The long report turned back: one column per named metric."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


# --- comparing runs, fitting -----------------------------------------------


def overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per topic of both runs, down to the shorter list: documents at the same
    rank and documents in both lists, with the two list sizes."""
    size_a = ours.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_ours"))
    size_b = theirs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_theirs"))
    sizes = size_a.join(size_b, "topic_id").withColumn("depth", F.least("n_ours", "n_theirs"))
    a = ours.select("topic_id", "doc_id", F.col("rank").alias("rank_a"))
    b = theirs.select("topic_id", "doc_id", F.col("rank").alias("rank_b"))
    common = (
        a.join(b, ["topic_id", "doc_id"])
        .join(sizes.select("topic_id", "depth"), "topic_id")
        .where((F.col("rank_a") <= F.col("depth")) & (F.col("rank_b") <= F.col("depth")))
        .groupBy("topic_id")
        .agg(
            F.count_if(F.col("rank_a") == F.col("rank_b")).alias("same_rank"),
            F.count(F.lit(1)).alias("in_both"),
        )
    )
    return sizes.drop("depth").join(common, "topic_id", "left").na.fill(0, ["same_rank", "in_both"])


def shared_topics(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    ids = ours.select("topic_id").distinct()
    return ids.join(theirs.select("topic_id").distinct(), "topic_id", "left_semi").agg(
        F.count(F.lit(1)).alias("shared_topics")
    )


def fit_normal(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Maximum-likelihood normal per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))
