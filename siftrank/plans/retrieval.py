"""Topics, judgements, index and model in; run, metrics and averages out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from siftrank.functions.models import Model
from siftrank.operators import evaluate, rerank, search
from siftrank.operators.index import Index
from siftrank.session import write_and_reload


class Evaluation(NamedTuple):
    run: DataFrame
    per_topic: DataFrame
    summary: DataFrame


def evaluate_model(
    index: Index,
    query_terms: DataFrame,
    judgements: DataFrame,
    model: Model,
    k: int = 1000,
    rerank_weight: float | None = None,
    decimals: int | None = None,
    objective: str | None = None,
    max_topics: int | None = None,
) -> Evaluation:
    """The whole passage. The run feeds three branches, so it is written once.

    Whole hit lists are re-ranked for an ``objective``: ``correlation`` (the default with a
    weight), ``meanvar``, ``ap``, ``rr`` or ``ndcg``; all but the first need a model with a
    variance. ``max_topics`` keeps the first topics by id.
    """
    if max_topics is not None:
        first = query_terms.select("topic_id").distinct().orderBy("topic_id").limit(max_topics)
        query_terms = query_terms.join(first, "topic_id", "left_semi")
        judgements = judgements.join(first, "topic_id", "left_semi")
    if objective is None and rerank_weight is not None:
        objective = "correlation"
    weight = 1.0 if rerank_weight is None else rerank_weight
    if objective in (None, "correlation"):
        hits = search.search(index, query_terms, model, k, decimals=decimals)
    else:
        hits = search.mean_variance_search(index, query_terms, model, k, decimals=decimals)
    if objective == "ndcg":
        hits = rerank.ndcg_order(hits)
    elif objective == "meanvar":
        hits = rerank.mean_variance_greedy_over(hits, index, weight)
    elif objective is not None:
        hits = rerank.greedy_over(hits, index, weight, objective)
    run = write_and_reload(hits, "run")
    per_topic = evaluate.metrics(evaluate.judge(run, judgements), judgements)
    return Evaluation(run, per_topic, evaluate.average(per_topic))


#: Values of a grid that share a pass over the postings; each is a column of its aggregate.
PER_PASS = 24


def sweep_run(
    index: Index,
    query_terms: DataFrame,
    model: Callable[[float], Model],
    values: Sequence[float],
    k: int = 1000,
    decimals: int | None = None,
) -> DataFrame:
    """(param, topic_id, doc_id, rank, score): one model over a grid of values.

    The values are columns of one aggregate, so a match is one row whatever the grid;
    only a candidate's sums become a row for each value.
    """
    terms = search.prepare(index, query_terms)
    values = [float(v) for v in values]
    parts = []
    for first in range(0, len(values), PER_PASS):
        some = values[first : first + PER_PASS]
        cells = [F.struct(F.lit(v).alias("param"), F.col(f"score_{i}").alias("score")) for i, v in enumerate(some)]
        wide = search.score_grid(index, terms, [model(v) for v in some])
        parts.append(wide.select("topic_id", "doc_id", F.inline(F.array(*cells))))
    scored = reduce(DataFrame.unionByName, parts)
    if decimals is not None:
        scored = search.rounded(scored, decimals)
    return search.top_k(scored, k, keys=["param", "topic_id"])


def grid(start: float, step: float, end: float) -> list[float]:
    """The values of a ``start:step:end`` sweep, end included."""
    n = int((end - start) / step + 1e-9)
    return [start + i * step for i in range(n + 1)]


def sweep(
    index: Index,
    query_terms: DataFrame,
    judgements: DataFrame,
    model: Callable[[float], Model],
    values: Sequence[float],
    k: int = 1000,
    decimals: int | None = None,
) -> DataFrame:
    """Averaged metrics per parameter value."""
    run = write_and_reload(sweep_run(index, query_terms, model, values, k, decimals), "sweep")
    keys = ["param", "topic_id"]
    per_topic = evaluate.metrics(evaluate.judge(run, judgements), judgements, keys=keys)
    return evaluate.average(per_topic, by=["param"])
