"""Diversity re-ranking of hit lists.

A hit list is cut to ``k`` before it comes here, so a topic has at most ``k`` hits and ``k * k / 2`` pairs.
All pairs are sums of products of bounded matrices over chunks of a topic's terms; re-ranking
needs only the correlations of the few documents it has fixed, and never a matrix of all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from siftrank.operators.index import Index

# Places re-decided after the first one, and what a frozen
# document gains per step.
STEPS = 19
FROZEN_BONUS = 100.0
# Fixed value: the weight of the correlation for lists with mean and variance.
MEAN_VARIANCE_WEIGHT = 0.01

#: Terms of a topic that one task has at most, columns of its matrix at a time, which part of a
#: topic's documents must hold a term for it to be in the matrix, and pairs summed at a time.
CHUNK = 500_000
COLUMNS = 1024
OFTEN = 12
PAIRS = 4_000_000
#: Rows of a topic's vectors that are multiplied at a time.
SLICE = 500_000


def _term_numbers(terms: pa.ChunkedArray) -> np.ndarray:
    return terms.combine_chunks().dictionary_encode().indices.to_numpy()


def _products(at: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared terms and products of all pairs of ``n`` documents, from rows sorted by term.

    Terms of many documents are multiplied as matrices of bounded width; of the others the pairs
    of rows that share one are few, and are summed.
    """
    begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(begins, len(term)))
    often = sizes > max(8, n // OFTEN)
    dot, shared = np.zeros((n, n)), np.zeros((n, n))
    row_often = np.repeat(often, sizes)
    column = np.repeat(np.cumsum(often) - 1, sizes)[row_often]
    rows, values = at[row_often], tf[row_often]
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS))
        part[rows[a:b], column[a:b] - low] = values[a:b]
        dot += part @ part.T
        present = (part > 0).astype(np.float32)
        shared += present @ present.T
    # each row of a rarer term beside the rows of the term after it
    row, left = np.flatnonzero(~row_often), (np.repeat(begins + sizes, sizes) - np.arange(len(term)) - 1)[~row_often]
    ends = np.cumsum(left)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, PAIRS)), len(row)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.repeat(row[a:b], left[a:b])
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(left[a:b]) - left[a:b], left[a:b])
        cell = np.minimum(at[first], at[second]) * n + np.maximum(at[first], at[second])
        dot += np.bincount(cell, tf[first] * tf[second], n * n).reshape(n, n)
        shared += np.bincount(cell, minlength=n * n).reshape(n, n)
    return shared, dot


def _topic(rows: pa.Table) -> tuple:
    """Documents by rank, and the rows by term: place of the document, term, frequency."""
    ranks, first, at = np.unique(rows["rank"].to_numpy(), return_index=True, return_inverse=True)
    term, tf = _term_numbers(rows["term"]), rows["tf"].to_numpy().astype(np.float64)
    order = np.argsort(term, kind="stable")
    return rows["doc_id"].combine_chunks().take(pa.array(first)), at[order], term[order], tf[order], len(ranks)


def _pair_sums(rows: pa.Table) -> pa.Table:
    """Shared terms and products of the pairs of a topic, over a chunk of its terms."""
    docs, at, term, tf, n = _topic(rows)
    shared, dot = _products(at, term, tf, n)
    i, j = np.nonzero(np.triu(shared, 1))
    return pa.table(
        [pa.repeat(rows["topic_id"][0], len(i)), docs.take(pa.array(i)), docs.take(pa.array(j)), pa.array(shared[i, j].astype(np.int64)), pa.array(dot[i, j])],
        ["topic_id", "doc_id_a", "doc_id_b", "o", "dot"],
    )


def _correlated(rows: pa.Table) -> pa.Table:
    """The correlations of a topic all of whose terms are here."""
    docs, at, term, tf, n = _topic(rows)
    shared, dot = _products(at, term, tf, n)
    size, mean = np.bincount(at, minlength=n).astype(np.float64), np.bincount(at, tf, n)
    mean /= size
    spread = np.bincount(at, tf * tf, n) - size * mean**2
    i, j = np.nonzero(np.triu(shared, 1))
    o = shared[i, j]
    both = (spread[i] + mean[i] ** 2 * (size[j] - o)) * (spread[j] + mean[j] ** 2 * (size[i] - o))
    cov = dot[i, j] - mean[i] * mean[j] * o
    corr = np.divide(cov, np.sqrt(np.maximum(both, 0)), out=np.zeros(len(i)), where=both > 1e-9)
    return pa.table(
        [pa.repeat(rows["topic_id"][0], len(i)), docs.take(pa.array(i)), docs.take(pa.array(j)), pa.array(corr, mask=both <= 1e-9)],
        ["topic_id", "a", "b", "corr"],
    )


def correlations(hits: DataFrame, index: Index, chunk: int = CHUNK) -> DataFrame:
    """(topic_id, a, b, corr): Pearson correlation of the term vectors of the hits
    of a topic, ``a`` ranked above ``b``, over the terms of either document.

    Means are over each document's own terms. Pairs without a shared term have
    correlation 0 and no row; a pair with a constant side has NULL.
    """
    rows, vectors = _hit_vectors(hits, index)
    chunks = rows.groupBy("topic_id").agg(F.ceil(F.count_distinct("term") / F.lit(chunk)).alias("_chunks"))
    dealt = rows.join(chunks, "topic_id").withColumn("_chunk", F.pmod(F.xxhash64("term"), "_chunks"))
    topic, doc = (rows.schema[name].dataType.simpleString() for name in ("topic_id", "doc_id"))
    columns = ["topic_id", "_chunk", "term", "doc_id", "rank", "tf"]
    # a topic of one chunk needs no sums: its task has its documents' whole vectors
    whole = dealt.where("_chunks = 1").select(*columns).groupBy("topic_id").applyInArrow(
        _correlated, f"topic_id {topic}, a {doc}, b {doc}, corr double"
    )
    pairs = (
        dealt.where("_chunks > 1").select(*columns)
        .groupBy("topic_id", "_chunk").applyInArrow(_pair_sums, f"topic_id {topic}, doc_id_a {doc}, doc_id_b {doc}, o long, dot double")
        .groupBy("topic_id", "doc_id_a", "doc_id_b").agg(F.sum("o").alias("o"), F.sum("dot").alias("dot"))
    )
    left = vectors.select(*[F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "mu", "sq")])
    right = vectors.select(*[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "mu", "sq")])
    joined = pairs.join(left, "doc_id_a").join(right, "doc_id_b")
    c = F.col
    # Over the union of terms: a document counts 0 for the other's own terms.
    cov = c("dot") - c("mu_a") * c("mu_b") * c("o")
    var_a = c("sq_a") - c("n_a") * c("mu_a") ** 2 + c("mu_a") ** 2 * (c("n_b") - c("o"))
    var_b = c("sq_b") - c("n_b") * c("mu_b") ** 2 + c("mu_b") ** 2 * (c("n_a") - c("o"))
    spread = var_a * var_b
    return whole.unionByName(joined.select(
        "topic_id",
        c("doc_id_a").alias("a"),
        c("doc_id_b").alias("b"),
        F.when(spread > 1e-9, cov / F.sqrt(spread)).alias("corr"),
    ))


def _hit_vectors(hits: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """(the terms of each topic's hits, what the correlations need of each document)."""
    ranked = hits.select("topic_id", "doc_id", "rank")
    chosen = ranked.select("doc_id").distinct()
    postings = index.postings.select("term", "doc_id", "tf").join(chosen, "doc_id", "left_semi")
    vectors = postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("tf").alias("mu"), F.sum(F.col("tf") * F.col("tf")).alias("sq")
    )
    return ranked.join(postings, "doc_id").select("topic_id", "term", "doc_id", "rank", "tf"), vectors


class _Vectors:
    """The term vectors of a topic's hits, by place in the given list."""

    def __init__(self, places: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, decimals: int | None) -> None:
        order = np.argsort(places, kind="stable")
        self.places, self.term, self.tf = places[order], term[order], tf[order]
        self.begins = np.searchsorted(self.places, np.arange(n + 1))
        self.sizes = np.diff(self.begins).astype(np.float64)
        sums, squares = np.zeros(n), np.zeros(n)
        for part in self._slices():  # sums of whole numbers are the same however they are cut
            of, counts = self.places[part], self.tf[part].astype(np.float64)
            sums += np.bincount(of, counts, n)
            squares += np.bincount(of, counts * counts, n)
        self.mu = np.divide(sums, self.sizes, out=np.zeros(n), where=self.sizes > 0)
        self.spread = squares - self.sizes * self.mu**2
        self.n, self.width, self.decimals = n, int(term.max(initial=-1)) + 1, decimals

    def _slices(self) -> list[slice]:
        return [slice(s, s + SLICE) for s in range(0, len(self.places), SLICE)]

    def with_all(self, place: int) -> np.ndarray:
        """Correlations of one document with all; 0 where none is defined."""
        own = slice(self.begins[place], self.begins[place + 1])
        dense, present = np.zeros(self.width), np.zeros(self.width)
        dense[self.term[own]], present[self.term[own]] = self.tf[own], 1.0
        dot, shared = np.zeros(self.n), np.zeros(self.n)
        for part in self._slices():
            of, term = self.places[part], self.term[part]
            dot += np.bincount(of, self.tf[part] * dense[term], self.n)
            shared += np.bincount(of, present[term], self.n)
        mu = self.mu[place]
        cov = dot - mu * self.mu * shared
        var_a = self.spread[place] + mu**2 * (self.sizes - shared)
        var_b = self.spread + self.mu**2 * (self.sizes[place] - shared)
        both = var_a * var_b
        corr = np.divide(cov, np.sqrt(np.maximum(both, 0)), out=np.zeros(self.n), where=(both > 1e-9) & (shared > 0))
        if self.decimals is None:
            return corr
        scale = 10.0**self.decimals
        return np.copysign(np.floor(np.abs(corr) * scale + 0.5), corr) / scale


def _step_scores(objective: str, weight: float, step: int, work: pd.DataFrame, corr: np.ndarray):
    """New scores of the documents not yet frozen. ``corr[s, i]`` is between the
    s-th frozen document and the i-th open one; ``work`` is in current order."""
    frozen, open_ = work.iloc[: step + 1], work.iloc[step + 1 :]
    if objective == "correlation":
        return open_["score"].to_numpy() - weight / math.log2(step + 2) * corr[step]
    given = open_["given"].to_numpy()
    if objective == "ap":
        return (given + MEAN_VARIANCE_WEIGHT * corr.sum(axis=0)) / (step + 2)
    if objective == "rr":
        miss = np.prod(1 - frozen["given"].to_numpy())
        spread = np.sqrt(np.outer(frozen["variance"].to_numpy(), open_["variance"].to_numpy()))
        return (miss * given - np.prod(corr * spread, axis=0)) / (step + 2)
    raise ValueError(f"unknown objective: {objective}")


def greedy(
    hits: DataFrame,
    corr: DataFrame,
    weight: float = 1.0,
    objective: str = "correlation",
    steps: int = STEPS,
) -> DataFrame:
    """Fix one place after another, re-scoring the rest by ``objective`` each time:

    * ``correlation``: lose ``weight / log2(step + 2)`` times the correlation with
      the document fixed last;
    * ``ap``, ``rr``: expected average precision or reciprocal rank given all fixed
      documents, from the input scores (``rr`` needs a ``variance`` column).

    Sequential within a topic, parallel over topics. Returns the hits in their new
    order with new ``rank`` and ``score``.
    """
    schema = hits.schema
    columns = hits.columns

    def one_topic(hit_rows: pd.DataFrame, corr_rows: pd.DataFrame) -> pd.DataFrame:
        work = hit_rows.sort_values("rank", kind="stable").reset_index(drop=True)
        place = {d: i for i, d in enumerate(work["doc_id"])}
        matrix = np.zeros((len(work), len(work)))
        i = corr_rows["a"].map(place).to_numpy(dtype=int)
        j = corr_rows["b"].map(place).to_numpy(dtype=int)
        matrix[i, j] = matrix[j, i] = corr_rows["corr"].fillna(0.0).to_numpy(dtype=float)
        return _fixed_in_turn(work, matrix.__getitem__, weight, objective, steps)[columns]

    pairs = corr.select(F.col("topic_id").alias("of_topic"), "a", "b", "corr")
    return (
        hits.groupBy("topic_id")
        .cogroup(pairs.groupBy("of_topic"))
        .applyInPandas(one_topic, schema)
    )


def _fixed_in_turn(work: pd.DataFrame, with_all, weight: float, objective: str, steps: int) -> pd.DataFrame:
    """``work`` in its new order; ``with_all`` gives the correlations of the document at a place
    of the given order with those at all places."""
    work["given"] = work["score"]
    at = np.arange(len(work))  # current order -> place in the given one
    rows: list[np.ndarray] = []
    for step in range(min(steps, len(work) - 1)):
        rows.append(with_all(at[step]))
        between = np.stack([row[at[step + 1 :]] for row in rows])
        fresh = _step_scores(objective, weight, step, work, between)
        work["score"] = np.concatenate([work["score"].to_numpy()[: step + 1] + FROZEN_BONUS, fresh])
        order = np.lexsort((work["doc_id"].to_numpy(), -work["score"].to_numpy()))
        if (order[: step + 1] != np.arange(step + 1)).any():  # fixed ones have changed places
            rows = [rows[k] if k <= step else with_all(at[k]) for k in order[: step + 1]]
        work, at = work.iloc[order].reset_index(drop=True), at[order]
    work["rank"] = np.arange(1, len(work) + 1)
    return work


def greedy_over(
    hits: DataFrame,
    index: Index,
    weight: float = 1.0,
    objective: str = "correlation",
    steps: int = STEPS,
    decimals: int | None = None,
) -> DataFrame:
    """:func:`greedy` over whole hit lists, from the documents' vectors.

    A topic's task holds the vectors of its hits and, of their correlations, one row for each
    document fixed: ``steps`` times ``k``, not ``k`` times ``k``. ``decimals`` rounds correlations, so that ties
    do not hang on how a sum ran.
    """
    columns = hits.columns

    def one_topic(hit_rows: pa.Table, vector_rows: pa.Table) -> pa.Table:
        work = hit_rows.to_pandas().sort_values("rank", kind="stable").reset_index(drop=True)
        ranks = work["rank"].to_numpy()
        places = np.searchsorted(ranks, vector_rows["of_rank"].to_numpy()).astype(np.int32)
        term = _term_numbers(vector_rows["term"]) if vector_rows.num_rows else np.zeros(0, np.int32)
        vectors = _Vectors(places, term, vector_rows["tf"].to_numpy(), len(work), decimals)
        made = _fixed_in_turn(work, vectors.with_all, weight, objective, steps)[columns]
        return pa.Table.from_pandas(made, hit_rows.schema, preserve_index=False)

    rows, _ = _hit_vectors(hits, index)
    counts = F.col("tf").cast("int").alias("tf")
    vectors = rows.select(F.col("topic_id").alias("of_topic"), F.col("rank").alias("of_rank"), "term", counts)
    return hits.groupBy("topic_id").cogroup(vectors.groupBy("of_topic")).applyInArrow(one_topic, hits.schema)


def mean_variance_greedy(hits: DataFrame, corr: DataFrame, weight: float = 1.0) -> DataFrame:
    """The correlation objective on hits with mean and variance, at a hundredth of
    the weight."""
    return greedy(hits, corr, weight * MEAN_VARIANCE_WEIGHT)


def mean_variance_greedy_over(hits: DataFrame, index: Index, weight: float = 1.0, **how) -> DataFrame:
    """The same over whole hit lists."""
    return greedy_over(hits, index, weight * MEAN_VARIANCE_WEIGHT, **how)


def ndcg_order(hits: DataFrame, decimals: int = 6) -> DataFrame:
    """Order by expected gain ``2^s + v * 2^s * ln(2)^2``. The value of a document
    does not depend on what is fixed before it, so one ranking does: the first
    hit stays, the others follow by value.

    Values are compared by their base-2 logarithm, ``s + log2(1 + v * ln(2)^2)``,
    because ``2^s`` is 0 for the low scores of long queries.
    """
    value = F.col("score") + F.log2(1 + F.col("variance") * F.lit(math.log(2) ** 2))
    order = [(F.col("rank") == 1).desc(), F.col("value").desc(), F.col("doc_id").asc()]
    valued = hits.withColumn("value", F.round(value, decimals))
    numbered = valued.withColumn(
        "new_rank", F.row_number().over(W.partitionBy("topic_id").orderBy(*order))
    )
    return numbered.drop("rank").withColumnRenamed("new_rank", "rank")
