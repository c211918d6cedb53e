"""Queries: ranking models and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.functions import models
from siftrank.operators import search as S

CATALOG = Catalog()

_HITS = ("topic_id", "doc_id", "rank", "score")


def _top_sql(ctes: str, scored: str, k: int = 10) -> str:
    return f"""
WITH {ctes}, scored AS ({scored}),
ranked AS (SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank, score FROM scored)
SELECT topic_id, doc_id, rank, score FROM ranked WHERE rank <= {k}"""


def _filled(present: str, absent: str) -> str:
    return f"""SELECT topic_id, doc_id,
  round(sum(qtf * CASE WHEN tf IS NOT NULL THEN {present} ELSE {absent} END), 6) AS score
FROM fill GROUP BY ALL"""


def _matched(expr: str) -> str:
    return f"""SELECT topic_id, doc_id, round(sum(qtf * ({expr})), 6) AS score
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL"""


def _register_model(name: str, model, sql: str, terms=I.prepared_terms, decimals=6) -> None:
    def query(spark, folder):
        return S.search(
            I.corpus_index(spark, folder),
            terms(spark, folder),
            model(),
            k=10,
            decimals=decimals,
        ).select(*_HITS)

    CATALOG.add(name, sql)(query)


BM25 = "log2((n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.6) / (tf + 1.6 * (0.5 + 0.5 * dl / avg_dl))"
_register_model("bm25_topk", models.bm25, _top_sql(I.TOPICS, _matched(BM25)))
_register_model(
    "tf_idf_topk", models.tf_idf, _top_sql(I.TOPICS, _matched("(tf / dl) * log2(n_docs / df)"))
)
_register_model(
    "tf_idf_ln_topk",
    lambda: models.tf_idf("ln_plus1"),
    _top_sql(I.TOPICS, _matched("(tf / dl) * ln(n_docs / (1 + df))")),
)
_register_model(
    "cosine_topk",
    models.vector_space,
    _top_sql(
        I.TOPICS,
        """SELECT topic_id, doc_id, round(dot / (qn * dn), 6) AS score
FROM (SELECT topic_id, doc_id, sum(qtf * tf) AS dot FROM qt JOIN post USING (term) GROUP BY ALL)
JOIN (SELECT topic_id, sqrt(sum(qtf * qtf)) AS qn FROM qt GROUP BY ALL) USING (topic_id)
JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM post GROUP BY ALL) USING (doc_id)""",
    ),
    terms=I.topic_terms,
)
_register_model(
    "dirichlet_topk",
    models.dirichlet,
    _top_sql(
        I.FILLED,
        _filled("ln((tf + 1000 * ctf / cl) / (dl + 1000))", "ln((1000 * ctf / cl) / (dl + 1000))"),
    ),
)
_register_model(
    "jelinek_mercer_topk",
    models.jelinek_mercer,
    _top_sql(
        I.FILLED, _filled("ln(0.9 * tf / dl + 0.1 * ctf / cl)", "ln(0.1 * ctf / cl)")
    ),
)

# The posterior of the risk-adjusted models, per candidate and query term.
POSTERIOR = (
    I.FILLED
    + """,
post1 AS (SELECT *, coalesce(tf, 0) + dl * 0.1 / 0.9 * ctf / cl AS t, dl + dl * 0.1 / 0.9 AS d FROM fill),
post2 AS (SELECT *, least(t / d, 1 - 1e-12) AS m, t * (d - t) / (d * d * (d + 1)) AS v FROM post1),
post3 AS (SELECT *, ln(m / (1 - m)) + (2 * m - 1) * v / (2 * m * m * (1 - m) * (1 - m)) AS mu,
  v / (m * m * (1 - m) * (1 - m)) AS var FROM post2)
"""
)
_register_model(
    "risk_adjusted_topk",
    lambda: models.risk_adjusted(a=2.0),
    _top_sql(
        POSTERIOR,
        "SELECT topic_id, doc_id, round(sum(qtf * (mu - 2 * sqrt(var))), 4) AS score FROM post3 GROUP BY ALL",
    ),
    decimals=4,  # scores in the hundred thousands
)
_register_model(
    "risk_plain_topk",
    lambda: models.risk_adjusted_plain(a=0.0),
    _top_sql(
        POSTERIOR,
        "SELECT topic_id, doc_id, round(sum(qtf * ln(m)), 6) AS score FROM post3 GROUP BY ALL",
    ),
)
_register_model(
    "risk_plain_penalised_topk",
    lambda: models.risk_adjusted_plain(a=0.5),
    _top_sql(
        POSTERIOR,
        "SELECT topic_id, doc_id, round(sum(qtf * ln(greatest(m - 0.5 * sqrt(v), 4.9e-324))), 6) AS score FROM post3 GROUP BY ALL",
    ),
)


@CATALOG.add(
    "bm25_quantised_topk",
    _top_sql(
        I.TOPICS
        + """,
lenq AS MATERIALIZED (SELECT doc_id, CASE WHEN dl <= 0 THEN 0.0 ELSE
  floor(dl / pow(2.0, floor(log2(dl)) - 2)) * pow(2.0, floor(log2(dl)) - 2) END AS dl FROM len),
stq AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM lenq)
""",
        f"""SELECT topic_id, doc_id, round(sum(qtf * ({BM25})), 6) AS score
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN lenq USING (doc_id), stq GROUP BY ALL""",
    ),
)
def bm25_quantised(spark, folder):
    from siftrank.operators.index import quantised

    index = quantised(I.corpus_index(spark, folder))
    return S.search(
        index, I.prepared_terms(spark, folder), models.bm25(), k=10, decimals=6
    ).select(*_HITS)


@CATALOG.add("topic_terms", f"WITH {I.TOPICS} SELECT topic_id, term, qtf FROM qt")
def topic_terms(spark, folder):
    return S.parse_topics(I.topics(spark, folder))


@CATALOG.add(
    "candidates",
    f"WITH {I.TOPICS} SELECT DISTINCT topic_id, doc_id FROM qt JOIN post USING (term)",
)
def candidates(spark, folder):
    return S.candidates(I.corpus_index(spark, folder), I.topic_terms(spark, folder))


@CATALOG.add("bm25_all_scores", f"WITH {I.TOPICS} {_matched(BM25)}")
def bm25_all_scores(spark, folder):
    index, terms = I.corpus_index(spark, folder), I.prepared_terms(spark, folder)
    return S.rounded(S.score(index, terms, models.bm25()))


@CATALOG.add(
    "default_fill_scores",
    f"WITH {I.FILLED} "
    + _filled("ln((tf + 1000 * ctf / cl) / (dl + 1000))", "ln((1000 * ctf / cl) / (dl + 1000))"),
)
def default_fill_scores(spark, folder):
    index, terms = I.corpus_index(spark, folder), I.prepared_terms(spark, folder)
    return S.rounded(S.score(index, terms, models.dirichlet()))


@CATALOG.add(
    "hit_summary",
    f"""WITH {I.TOPICS}, scored AS ({_matched(BM25)})
SELECT topic_id, count(*) AS total_hits, max(score) AS max_score FROM scored GROUP BY ALL""",
)
def hit_summary(spark, folder):
    index, terms = I.corpus_index(spark, folder), I.prepared_terms(spark, folder)
    return S.hit_summary(S.rounded(S.score(index, terms, models.bm25())))


_MEAN_VAR = """SELECT topic_id, doc_id, round(sum(qtf * (mu - 2 * sqrt(var))), 4) AS score,
  sum(qtf * mu) AS mean, sum(qtf * var) AS variance FROM post3 GROUP BY ALL"""


@CATALOG.add(
    "meanvar_topk",
    f"""WITH {POSTERIOR}, scored AS ({_MEAN_VAR}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT topic_id, doc_id, rank, score, round(mean, 3) AS mean, round(variance, 2) AS variance FROM ranked WHERE rank <= 1000""",
)
def meanvar_topk(spark, folder):
    return S.mean_variance_search(
        I.corpus_index(spark, folder),
        I.prepared_terms(spark, folder),
        models.risk_adjusted(a=2.0),
        k=1000,
        a=2.0,
        decimals=4,
    ).select(*_HITS, F.round("mean", 3).alias("mean"), F.round("variance", 2).alias("variance"))


@CATALOG.add(
    "meanvar_by_mean_topk",
    f"""WITH {POSTERIOR}, scored AS ({_MEAN_VAR}),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(mean, 4) DESC, doc_id) AS r0 FROM scored) WHERE r0 <= 2000),
again AS (SELECT topic_id, doc_id, round(mean - 2 * sqrt(variance), 4) AS score, mean, variance FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM again)
SELECT topic_id, doc_id, rank, score, round(mean, 3) AS mean, round(variance, 2) AS variance FROM ranked WHERE rank <= 100""",
)
def meanvar_by_mean_topk(spark, folder):
    return S.mean_variance_search(
        I.corpus_index(spark, folder),
        I.prepared_terms(spark, folder),
        models.risk_adjusted(a=2.0),
        k=100,
        rank_by="mean",
        precut=2000,
        a=2.0,
        decimals=4,
    ).select(*_HITS, F.round("mean", 3).alias("mean"), F.round("variance", 2).alias("variance"))


@CATALOG.add(
    "per_term_scores",
    f"""WITH {I.TOPICS}
SELECT topic_id, doc_id, term, qtf, round({BM25}, 6) AS score
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st""",
)
def per_term_scores(spark, folder):
    index, terms = I.corpus_index(spark, folder), I.prepared_terms(spark, folder)
    return S.rounded(S.term_scores(index, terms, models.bm25()))


@CATALOG.add(
    "length_normalised_topk",
    _top_sql(
        I.FILLED,
        """SELECT topic_id, doc_id, round(total / ql, 6) AS score FROM (
  SELECT topic_id, doc_id, sum(qtf * CASE WHEN tf IS NOT NULL THEN ln(0.9 * tf / dl + 0.1 * ctf / cl)
         ELSE ln(0.1 * ctf / cl) END) AS total FROM fill GROUP BY ALL)
JOIN (SELECT topic_id, sum(qtf) AS ql FROM qt GROUP BY ALL) USING (topic_id)""",
        k=50,
    ),
)
def length_normalised_topk(spark, folder):
    index, terms = I.corpus_index(spark, folder), I.topic_terms(spark, folder)
    scored = S.rounded(S.per_term_search(index, terms, models.jelinek_mercer()))
    return S.top_k(scored, 50).select(*_HITS)


@CATALOG.add(
    "range_filtered_topk",
    _top_sql(
        I.TOPICS,
        f"""SELECT topic_id, doc_id, round(sum(qtf * ({BM25})), 6) AS score
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st
WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang >= 'de' AND lang < 'fr')
GROUP BY ALL""",
    ),
)
def range_filtered_topk(spark, folder):
    from siftrank.sources.tables import load

    allowed = S.field_range(
        load(spark, folder, "documents"), "lang", low="de", high="fr", include_high=False
    )
    return S.search(
        I.corpus_index(spark, folder),
        I.prepared_terms(spark, folder),
        models.bm25(),
        k=10,
        allowed=allowed,
        decimals=6,
    ).select(*_HITS)


@CATALOG.add(
    "date_range_orders",
    """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders
WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'""",
)
def date_range_orders(spark, folder):
    from datetime import datetime

    from siftrank.sources.tables import load

    kept = S.field_range(
        load(spark, folder, "orders"),
        "o_orderdate",
        low=datetime(1996, 1, 1),
        high=datetime(1997, 6, 30),
        include_low=False,
    )
    return kept.select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day")
    )


@CATALOG.add(
    "field_sorted_topk",
    f"""WITH {I.TOPICS}, scored AS (
SELECT topic_id, doc_id, round(sum(qtf * ((tf / dl) * log2(n_docs / df))), 6) AS score
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL),
ranked AS (SELECT topic_id, doc_id, lang, n_chars, score,
  row_number() OVER (PARTITION BY topic_id ORDER BY lang ASC, n_chars DESC, doc_id) AS rank
  FROM scored JOIN documents USING (doc_id) WHERE score > 0)
SELECT topic_id, doc_id, lang, n_chars, score, rank FROM ranked WHERE rank <= 20""",
)
def field_sorted_topk(spark, folder):
    from siftrank.sources.tables import load

    scored = S.rounded(
        S.score(I.corpus_index(spark, folder), I.prepared_terms(spark, folder), models.tf_idf())
    )
    return S.top_k_by_fields(
        scored, load(spark, folder, "documents"), [("lang", False), ("n_chars", True)], k=20
    ).select("topic_id", "doc_id", "lang", "n_chars", "score", "rank")


# Sources named as they are written, in small letters for some and capitals for others:
# by bytes all capitals come first, in the locale's order they stand beside each other.
_NAMED = "CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END"


@CATALOG.add(
    "locale_sorted_topk",
    f"""WITH {I.TOPICS}, scored AS (
SELECT topic_id, doc_id, round(sum(qtf * ((tf / dl) * log2(n_docs / df))), 6) AS score
FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL),
ranked AS (SELECT topic_id, doc_id, name, score,
  row_number() OVER (PARTITION BY topic_id ORDER BY name COLLATE de, doc_id) AS rank
  FROM scored JOIN (SELECT doc_id, {_NAMED} AS name FROM documents) USING (doc_id) WHERE score > 0)
SELECT topic_id, doc_id, name, score, rank FROM ranked WHERE rank <= 1000""",
)
def locale_sorted_topk(spark, folder):
    from siftrank.sources.tables import load

    scored = S.rounded(
        S.score(I.corpus_index(spark, folder), I.prepared_terms(spark, folder), models.tf_idf())
    )
    named = load(spark, folder, "documents").select("doc_id", F.expr(_NAMED).alias("name"))
    return S.top_k_by_fields(scored, named, [("name", False)], collation="de").select(
        "topic_id", "doc_id", "name", "score", "rank"
    )


# A topic's terms met once are optional, met twice or more required; the words of
# the second list are refused. Fixed values for the query, not for the engine.
_REFUSED = ("der", "que")


@CATALOG.add(
    "boolean_candidates",
    f"""WITH {I.TOPICS},
cl AS (SELECT topic_id, term, CASE WHEN qtf > 1 THEN 'must' ELSE 'should' END AS occur FROM qt
  UNION ALL SELECT DISTINCT topic_id, w AS term, 'must_not' AS occur FROM qt, (VALUES ('der'), ('que')) AS t(w)),
cnt AS (SELECT topic_id, doc_id, count(*) FILTER (occur = 'must') AS m, count(*) FILTER (occur = 'should') AS s,
  count(*) FILTER (occur = 'must_not') AS x FROM cl JOIN post USING (term) GROUP BY ALL),
need AS (SELECT topic_id, count(*) FILTER (occur = 'must') AS n FROM cl GROUP BY ALL)
SELECT topic_id, doc_id FROM cnt JOIN need USING (topic_id) WHERE x = 0 AND m = n AND (n > 0 OR s > 0)""",
)
def boolean_candidates(spark, folder):
    terms = I.topic_terms(spark, folder)
    wanted = terms.select(
        "topic_id", "term", F.when(F.col("qtf") > 1, "must").otherwise("should").alias("occur")
    )
    refused = terms.select("topic_id").distinct().select(
        "topic_id",
        F.explode(F.array(*[F.lit(w) for w in _REFUSED])).alias("term"),
        F.lit("must_not").alias("occur"),
    )
    return S.boolean_candidates(I.corpus_index(spark, folder), wanted.unionByName(refused))


@CATALOG.add(
    "retrieval_counters",
    f"""WITH {I.BM25_RUN}
SELECT (SELECT count(DISTINCT topic_id) FROM qt) AS queries,
  (SELECT count(*) FROM scored) AS scored_documents, (SELECT count(*) FROM run) AS retrieved_documents,
  (SELECT sum(trunc(score)::BIGINT)::BIGINT FROM scored) AS total_score""",
)
def retrieval_counters(spark, folder):
    index, terms = I.corpus_index(spark, folder), I.topic_terms(spark, folder)
    scored = S.rounded(S.score(index, terms, models.bm25()))
    return S.retrieval_counters(terms, scored, I.run(spark, folder))
