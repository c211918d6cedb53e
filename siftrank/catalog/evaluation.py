"""Queries: judging and measuring runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.catalog.retrieval import BM25
from siftrank.functions import models
from siftrank.operators import evaluate as E
from siftrank.operators import search as S
from siftrank.plans import retrieval as P
from siftrank.session import write_and_reload

CATALOG = Catalog()


def _rounded(df, *skip):
    return df.withColumns(
        {n: F.round(n, 6) for n, t in df.dtypes if t == "double" and n not in skip}
    )


@CATALOG.add("judged_run", f"WITH {I.JUDGED} SELECT topic_id, doc_id, rank, score, relevant FROM jr")
def judged_run(spark, folder):
    return I.judged_run(spark, folder).select("topic_id", "doc_id", "rank", "score", "relevant")


@CATALOG.add("relevant_counts", f"WITH {I.JUDGED} SELECT topic_id, relevant_count FROM goods")
def relevant_counts(spark, folder):
    return E.relevant_counts(I.stored_judgements(spark, folder))


@CATALOG.add(
    "judgement_consistency",
    f"""WITH {I.JUDGED}, have AS (SELECT DISTINCT topic_id FROM judged WHERE relevant)
SELECT item_id AS topic_id, 'topic without relevant judgements' AS reason FROM benchmark
WHERE item_id NOT IN (SELECT topic_id FROM have)
UNION ALL SELECT topic_id, 'judged topic not in the topic set' AS reason FROM have
WHERE topic_id NOT IN (SELECT item_id FROM benchmark)""",
)
def judgement_consistency(spark, folder):
    return E.check_consistency(I.topics(spark, folder), I.stored_judgements(spark, folder))


def _p(n: int) -> str:
    return f"sum(CASE WHEN relevant AND rank <= {n} THEN 1 ELSE 0 END) / {n}.0"


def _ndcg(n: int) -> str:
    return (
        f"CASE WHEN max(rank) >= {n} THEN sum(CASE WHEN relevant AND rank <= {n} THEN 1 / ln(1 + rank) ELSE 0 END)"
        f" / (SELECT sum(1 / ln(1 + r)) FROM range(1, {n + 1}) AS ideal(r)) ELSE 0 END"
    )


def _call(k: int) -> str:
    return (
        "(max(rank) >= 10 AND sum(CASE WHEN relevant AND rank <= 10 THEN 1 ELSE 0 END)"
        f" >= {k})::BIGINT"
    )


_RR = "CASE WHEN min(CASE WHEN relevant THEN rank END) <= 5 THEN 1.0 / min(CASE WHEN relevant THEN rank END) ELSE 0 END"


def _select(columns: dict[str, str]) -> str:
    inner = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT topic_id, {inner} FROM jr GROUP BY topic_id"


def _round_sql(columns: dict[str, str]) -> dict[str, str]:
    return {n: f"round(({s})::DOUBLE, 6)" for n, s in columns.items()}


@CATALOG.add(
    "precision_at",
    f"WITH {I.JUDGED} " + _select(_round_sql({f"p_{n}": _p(n) for n in E.PRECISION_CUTOFFS})),
)
def precision_at(spark, folder):
    return _rounded(E.precision(I.judged_run(spark, folder), E.PRECISION_CUTOFFS))


@CATALOG.add(
    "recall",
    f"""WITH {I.JUDGED} SELECT topic_id, round(CASE WHEN coalesce(max(relevant_count), 0) > 0
  THEN sum(relevant::INT)::DOUBLE / max(relevant_count) ELSE sum(relevant::INT)::DOUBLE / count(*) END, 6) AS recall
FROM jr LEFT JOIN goods USING (topic_id) GROUP BY topic_id""",
)
def recall(spark, folder):
    return _rounded(E.recall(I.judged_run(spark, folder), I.stored_judgements(spark, folder)))


@CATALOG.add("reciprocal_rank", f"WITH {I.JUDGED} " + _select(_round_sql({"rr": _RR})))
def reciprocal_rank(spark, folder):
    return _rounded(E.reciprocal_ranks(I.judged_run(spark, folder)))


@CATALOG.add(
    "k_call", f"WITH {I.JUDGED} " + _select({f"call_{k}": _call(k) for k in range(1, 11)})
)
def k_call(spark, folder):
    return E.calls(I.judged_run(spark, folder))


@CATALOG.add(
    "ndcg_at",
    f"WITH {I.JUDGED} " + _select(_round_sql({f"ndcg_{n}": _ndcg(n) for n in E.NDCG_CUTOFFS})),
)
def ndcg_at(spark, folder):
    return _rounded(E.ndcg(I.judged_run(spark, folder)))


_AP = """aps AS (SELECT topic_id, round(CASE WHEN coalesce(max(relevant_count), 0) > 0
  THEN coalesce(sum(CASE WHEN relevant THEN found / rank END), 0)::DOUBLE / max(relevant_count) ELSE 0 END, 6) AS ap
FROM (SELECT *, sum(relevant::INT) OVER (PARTITION BY topic_id ORDER BY rank) AS found FROM jr)
LEFT JOIN goods USING (topic_id) GROUP BY topic_id)"""


@CATALOG.add(
    "average_precision", f"WITH {I.JUDGED}, {_AP} SELECT topic_id, ap FROM aps"
)
def average_precision(spark, folder):
    return _rounded(
        E.average_precision(I.judged_run(spark, folder), I.stored_judgements(spark, folder))
    )


@CATALOG.add(
    "mean_average_precision",
    f"WITH {I.JUDGED}, {_AP} SELECT round(avg(ap), 6) AS map FROM aps JOIN goods USING (topic_id) WHERE relevant_count > 0",
)
def mean_average_precision(spark, folder):
    judgements = I.stored_judgements(spark, folder)
    per_topic = _rounded(E.average_precision(I.judged_run(spark, folder), judgements))
    good = E.relevant_counts(judgements).where("relevant_count > 0")
    return per_topic.join(good, "topic_id").agg(F.round(F.avg("ap"), 6).alias("map"))


@CATALOG.add(
    "recall_points",
    f"""WITH {I.JUDGED} SELECT topic_id, rank, row_number() OVER (PARTITION BY topic_id ORDER BY rank) AS found
FROM jr WHERE relevant""",
)
def recall_points(spark, folder):
    return E.recall_points(I.judged_run(spark, folder))


_VALUES = {
    "rr": _RR,
    **{f"call_{k}": _call(k) for k in range(1, 11)},
    **{f"ndcg_{n}": _ndcg(n) for n in E.NDCG_CUTOFFS},
    **{f"p_{n}": _p(n) for n in E.PRECISION_CUTOFFS},
}
_METRICS_CTE = (
    _AP
    + ", met AS (SELECT topic_id, retrieved, found, coalesce(relevant_count, 0) AS relevant_count, ap,"
    + " CASE WHEN coalesce(relevant_count, 0) > 0 THEN found::DOUBLE / relevant_count ELSE found::DOUBLE / retrieved END AS recall, "
    + ", ".join(_VALUES)
    + " FROM (SELECT topic_id, count(*) AS retrieved, sum(relevant::INT) AS found, "
    + ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in _VALUES.items())
    + " FROM jr GROUP BY topic_id) LEFT JOIN goods USING (topic_id) JOIN aps USING (topic_id))"
)
_ALL = ["retrieved", "found", "relevant_count", "ap", "recall", *_VALUES]


def _average_select(where: str = "", group: str = "") -> str:
    names = {c: ("map" if c == "ap" else c) for c in _ALL}
    cols = ", ".join(f"round(avg({c})::DOUBLE, 5) AS {n}" for c, n in names.items())
    return f"SELECT {group} count(*) AS topics, {cols} FROM met WHERE relevant_count > 0"


def _average(metrics, by=()):
    out = E.average(metrics, by)
    return out.withColumns(
        {n: F.round(n, 5) for n, t in out.dtypes if t == "double" and n not in by}
    )


@CATALOG.add("metrics_all", f"WITH {I.JUDGED}, {_METRICS_CTE} {_average_select()}")
def metrics_all(spark, folder):
    metrics = E.metrics(I.judged_run(spark, folder), I.stored_judgements(spark, folder))
    return _average(metrics.withColumn("ap", F.round("ap", 6)))


def _long_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT topic_id, '{c}' AS metric, round({c}::DOUBLE, 3) AS value FROM met"
        + (f" WHERE {c[2:]} < retrieved" if c.startswith("p_") else "")
        for c in _ALL
    )
    return f"WITH {I.JUDGED}, {_METRICS_CTE} {rows}"


@CATALOG.add("metric_report_long", _long_sql())
def metric_report_long(spark, folder):
    return E.report_long(E.metrics(I.judged_run(spark, folder), I.stored_judgements(spark, folder)))


_WIDE = ("ap", "rr", "recall", "p_10", "ndcg_10", "call_1")


@CATALOG.add(
    "metric_report_wide",
    f"WITH {I.JUDGED}, {_METRICS_CTE} SELECT topic_id, "
    + ", ".join(
        (f"CASE WHEN 10 < retrieved THEN round({c}::DOUBLE, 3) END" if c == "p_10" else f"round({c}::DOUBLE, 3)")
        + f" AS {c}"
        for c in _WIDE
    )
    + " FROM met",
)
def metric_report_wide(spark, folder):
    metrics = E.metrics(I.judged_run(spark, folder), I.stored_judgements(spark, folder))
    return E.report_wide(E.report_long(metrics), _WIDE)


def _dirichlet_run(spark, folder):
    return I.once(
        spark,
        folder,
        "dirichlet_run",
        lambda: write_and_reload(
            S.search(
                I.corpus_index(spark, folder),
                I.prepared_terms(spark, folder),
                models.dirichlet(),
                k=1000,
                decimals=6,
            ),
            "dirichlet-run",
        ),
    )


_TWO_RUNS = (
    I.BM25_RUN
    + """,
cand AS MATERIALIZED (SELECT DISTINCT topic_id, doc_id FROM qt JOIN post USING (term)),
lm AS (
  SELECT c.topic_id, c.doc_id, round(sum(qtf * ln((coalesce(p.tf, 0) + 1000 * ctf / cl) / (dl + 1000))), 6) AS score
  FROM cand c JOIN qt q USING (topic_id) JOIN lex USING (term) JOIN len USING (doc_id)
  LEFT JOIN post p ON p.term = q.term AND p.doc_id = c.doc_id, st GROUP BY ALL),
other AS MATERIALIZED (SELECT * FROM (SELECT topic_id, doc_id,
  row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM lm) WHERE rank <= 1000),
sizes AS (SELECT * FROM (SELECT topic_id, count(*) AS n_ours FROM run GROUP BY 1)
  JOIN (SELECT topic_id, count(*) AS n_theirs FROM other GROUP BY 1) USING (topic_id))
"""
)


@CATALOG.add(
    "run_overlap",
    f"""WITH {_TWO_RUNS}, common AS (
SELECT a.topic_id, count(*) FILTER (a.rank = b.rank) AS same_rank, count(*) AS in_both
FROM run a JOIN other b USING (topic_id, doc_id) JOIN sizes USING (topic_id)
WHERE a.rank <= least(n_ours, n_theirs) AND b.rank <= least(n_ours, n_theirs) GROUP BY ALL)
SELECT topic_id, n_ours, n_theirs, coalesce(same_rank, 0) AS same_rank, coalesce(in_both, 0) AS in_both
FROM sizes LEFT JOIN common USING (topic_id)""",
)
def run_overlap(spark, folder):
    return E.overlap(I.run(spark, folder), _dirichlet_run(spark, folder))


@CATALOG.add(
    "shared_topics",
    f"WITH {I.BM25_RUN} SELECT count(DISTINCT topic_id) AS shared_topics FROM run",
)
def shared_topics(spark, folder):
    return E.shared_topics(I.run(spark, folder), _dirichlet_run(spark, folder))


@CATALOG.add(
    "score_distribution_fit",
    f"""WITH {I.BM25_RUN} SELECT topic_id, round(avg(score), 5) AS mu, round(stddev_pop(score), 5) AS sigma
FROM run GROUP BY ALL""",
)
def score_distribution_fit(spark, folder):
    fit = E.fit_normal(I.run(spark, folder), "score", ["topic_id"])
    return fit.select("topic_id", F.round("mu", 5).alias("mu"), F.round("sigma", 5).alias("sigma"))


@CATALOG.add("evaluate_bm25", f"WITH {I.JUDGED}, {_METRICS_CTE} {_average_select()}")
def evaluate_bm25(spark, folder):
    """The whole passage from topics to the summary."""
    result = P.evaluate_model(
        I.corpus_index(spark, folder),
        S.parse_topics(I.topics(spark, folder)),
        I.stored_judgements(spark, folder),
        models.bm25(),
        decimals=6,
    )
    return _average(result.per_topic.withColumn("ap", F.round("ap", 6)))


_GRID = P.grid(0.0, 0.25, 1.0)
_SWEEP_BM25 = BM25.replace("(0.5 + 0.5 * dl / avg_dl)", "(1 - param + param * dl / avg_dl)")


def _sweep_sql() -> str:
    grid = ", ".join(f"({v}::DOUBLE)" for v in _GRID)
    judged = I.JUDGED[I.JUDGED.index(",\njudged AS") :]
    ctes = (
        I.TOPICS
        + f""",
grid AS (SELECT * FROM (VALUES {grid}) AS t(param)),
scored AS (SELECT param, topic_id, doc_id, round(sum(qtf * ({_SWEEP_BM25})), 6) AS score
  FROM grid, qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL),
run AS MATERIALIZED (SELECT * FROM (SELECT param, topic_id, doc_id, score,
  row_number() OVER (PARTITION BY param, topic_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 1000)
"""
        + judged.replace("SELECT run.topic_id", "SELECT run.param, run.topic_id")
    )
    return f"""WITH {ctes}
SELECT param, count(*) AS topics, round(avg(p10), 5) AS p_10, round(avg(rr), 5) AS rr, round(avg(recall), 5) AS recall FROM (
  SELECT param, topic_id, ({_p(10)})::DOUBLE AS p10, ({_RR})::DOUBLE AS rr,
    sum(relevant::INT)::DOUBLE / max(relevant_count) AS recall
  FROM jr JOIN goods USING (topic_id) WHERE relevant_count > 0 GROUP BY param, topic_id)
GROUP BY param"""


@CATALOG.add("parameter_sweep", _sweep_sql())
def parameter_sweep(spark, folder):
    """BM25's length parameter from 0 to 1 in steps of a quarter."""
    swept = P.sweep(
        I.corpus_index(spark, folder),
        I.prepared_terms(spark, folder),
        I.stored_judgements(spark, folder),
        lambda b: models.bm25(b=b),
        _GRID,
        decimals=6,
    )
    return swept.select(
        "param", "topics", *[F.round(c, 5).alias(c) for c in ("p_10", "rr", "recall")]
    )
