"""Queries: diversity re-ranking."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.catalog.retrieval import BM25, POSTERIOR
from siftrank.functions import models
from siftrank.operators import rerank as R
from siftrank.operators import search as S
from siftrank.session import write_and_reload

CATALOG = Catalog()

#: Whole hit lists: what a search gives.
_TOP = 1000
#: Correlations are compared, and lists re-ranked, at so many decimals.
_DECIMALS = 9


def _hits(spark, folder):
    return I.once(
        spark,
        folder,
        "rerank_hits",
        lambda: write_and_reload(
            S.search(
                I.corpus_index(spark, folder),
                I.prepared_terms(spark, folder),
                models.bm25(),
                k=_TOP,
                decimals=6,
            ),
            "rerank-hits",
        ),
    )


def _meanvar_hits(spark, folder):
    return I.once(
        spark,
        folder,
        "rerank_meanvar_hits",
        lambda: write_and_reload(
            S.mean_variance_search(
                I.corpus_index(spark, folder),
                I.prepared_terms(spark, folder),
                models.risk_adjusted(a=2.0),
                k=_TOP,
                decimals=4,
            ),
            "rerank-meanvar-hits",
        ),
    )


def _correlations(spark, folder):
    return R.correlations(_hits(spark, folder), I.corpus_index(spark, folder))


_BM25_HITS = f"""{I.TOPICS}, scored AS (
SELECT topic_id, doc_id, round(sum(qtf * ({BM25})), 6) AS score, 0.0::DOUBLE AS variance
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL)"""
_MEANVAR_HITS = f"""{POSTERIOR}, scored AS (
SELECT topic_id, doc_id, round(sum(qtf * (mu - 2 * sqrt(var))), 4) AS score,
  sum(qtf * var) AS variance FROM post3 GROUP BY ALL)"""


def _corr_ctes(hits: str, decimals: int) -> str:
    """Hits with their rank, and the correlations ``corr`` of their pairs."""
    return f"""
WITH {hits},
hits AS MATERIALIZED (SELECT * FROM (SELECT topic_id, doc_id, score, variance,
  row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {_TOP}),
pairs AS (SELECT x.topic_id, x.doc_id AS a, y.doc_id AS b FROM hits x JOIN hits y
  ON x.topic_id = y.topic_id AND x.rank < y.rank),
docs AS MATERIALIZED (SELECT term, doc_id, tf FROM post WHERE doc_id IN (SELECT doc_id FROM hits)),
vec AS MATERIALIZED (SELECT doc_id, count(*) AS n, avg(tf) AS mu, sum(tf * tf) AS sq FROM docs GROUP BY ALL),
dots AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o, sum(x.tf * y.tf) AS dot
  FROM docs x JOIN docs y USING (term) GROUP BY ALL),
parts AS (SELECT topic_id, a, b, dot - va.mu * vb.mu * o AS cov,
  va.sq - va.n * va.mu * va.mu + va.mu * va.mu * (vb.n - o) AS var_a,
  vb.sq - vb.n * vb.mu * vb.mu + vb.mu * vb.mu * (va.n - o) AS var_b
  FROM pairs JOIN dots USING (a, b) JOIN vec va ON va.doc_id = a JOIN vec vb ON vb.doc_id = b),
corr AS MATERIALIZED (SELECT topic_id, a, b,
  round(CASE WHEN var_a * var_b > 1e-9 THEN cov / sqrt(var_a * var_b) END, {decimals}) AS corr FROM parts)"""


_CORR_SQL = _corr_ctes(_BM25_HITS, 6) + " SELECT topic_id, a, b, corr FROM corr"


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _greedy_sql(hits: str, objective: str, weight: float = 1.0) -> str:
    """The steps one after the other, each as two common table expressions."""
    steps = [
        _corr_ctes(hits, _DECIMALS),
        "two AS MATERIALIZED (SELECT topic_id, a, b, corr FROM corr UNION ALL SELECT topic_id, b, a, corr FROM corr)",
        "o0 AS MATERIALIZED (SELECT topic_id, doc_id, score AS given, score, variance, rank AS pos FROM hits)",
    ]
    for step in range(R.STEPS):
        fixed = step + 1
        if objective == "correlation":
            per_step = _number(weight / math.log2(step + 2))
            value = f"o.score - {per_step} * max(coalesce(c.corr, 0)) FILTER (WHERE f.pos = {fixed})"
        elif objective == "ap":
            value = f"(o.given + {_number(R.MEAN_VARIANCE_WEIGHT)} * sum(coalesce(c.corr, 0) ORDER BY f.pos)) / {step + 2}"
        else:
            value = f"""(product(1 - f.given ORDER BY f.pos) * o.given
  - product(coalesce(c.corr, 0) * sqrt(f.variance * o.variance) ORDER BY f.pos)) / {step + 2}"""
        steps += [
            f"""n{step} AS MATERIALIZED (SELECT o.topic_id, o.doc_id, {value} AS fresh
  FROM o{step} o JOIN o{step} f ON f.topic_id = o.topic_id AND f.pos <= {fixed}
  LEFT JOIN two c ON c.topic_id = o.topic_id AND c.a = f.doc_id AND c.b = o.doc_id
  WHERE o.pos > {fixed} GROUP BY o.topic_id, o.doc_id, o.score, o.given, o.variance)""",
            f"""o{step + 1} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS pos
  FROM (SELECT o.topic_id, o.doc_id, o.given, o.variance,
    CASE WHEN o.pos <= {fixed} THEN o.score + {R.FROZEN_BONUS} ELSE n.fresh END AS score
    FROM o{step} o LEFT JOIN n{step} n USING (topic_id, doc_id)))""",
        ]
    return ",\n".join(steps) + f" SELECT topic_id, doc_id, pos AS rank FROM o{R.STEPS}"


@CATALOG.add("document_correlations", _CORR_SQL)
def document_correlations(spark, folder):
    return _correlations(spark, folder).withColumn("corr", F.round("corr", 6))


@CATALOG.add("correlation_matrix_export", _CORR_SQL)
def correlation_matrix_export(spark, folder):
    """The matrix as it is written: one row per pair, the upper hit first, read back."""
    from siftrank.sources import sinks

    return sinks.export_correlations(_correlations(spark, folder), _scratch(spark, "corr")).withColumn(
        "corr", F.round("corr", 6)
    )


def _scratch(spark, label):
    from siftrank.session import scratch_path

    return scratch_path(spark, label)


def _new_order(df):
    return df.select("topic_id", "doc_id", "rank")


@CATALOG.add("greedy_correlation_rerank", _greedy_sql(_BM25_HITS, "correlation", 2.0))
def greedy_correlation_rerank(spark, folder):
    return _new_order(R.greedy_over(_hits(spark, folder), I.corpus_index(spark, folder), weight=2.0, decimals=_DECIMALS))


def _meanvar(spark, folder):
    return _meanvar_hits(spark, folder), I.corpus_index(spark, folder)


@CATALOG.add("greedy_meanvar_rerank", _greedy_sql(_MEANVAR_HITS, "correlation", 200.0 * R.MEAN_VARIANCE_WEIGHT))
def greedy_meanvar_rerank(spark, folder):
    return _new_order(R.mean_variance_greedy_over(*_meanvar(spark, folder), weight=200.0, decimals=_DECIMALS))


@CATALOG.add("greedy_reciprocal_rank_rerank", _greedy_sql(_MEANVAR_HITS, "rr"))
def greedy_reciprocal_rank_rerank(spark, folder):
    return _new_order(R.greedy_over(*_meanvar(spark, folder), objective="rr", decimals=_DECIMALS))


@CATALOG.add("greedy_average_precision_rerank", _greedy_sql(_MEANVAR_HITS, "ap"))
def greedy_average_precision_rerank(spark, folder):
    return _new_order(R.greedy_over(*_meanvar(spark, folder), objective="ap", decimals=_DECIMALS))


@CATALOG.add(
    "ndcg_objective_rerank",
    f"""WITH {POSTERIOR}, scored AS (
SELECT topic_id, doc_id, round(sum(qtf * (mu - 2 * sqrt(var))), 4) AS score,
  sum(qtf * var) AS variance FROM post3 GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= {_TOP}),
valued AS (SELECT *, round(score + log2(1 + variance * ln(2) * ln(2)), 4) AS v FROM hits)
SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY (r = 1) DESC, v DESC, doc_id) AS rank FROM valued""",
)
def ndcg_objective_rerank(spark, folder):
    return _new_order(R.ndcg_order(_meanvar_hits(spark, folder), decimals=4))
