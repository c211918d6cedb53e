"""How the given tables map to the engine's tables, in Spark and in SQL.

documents    documents(doc_id, text)
topics       benchmark: the whole text of an item is the topic's title
judgements   a labelled document is judged for a topic when it has at least half
             of the topic's distinct terms; its quality label is the grade
ratings      orders x lineitem: user o_custkey, item l_partkey, rating from
             l_quantity, the last one wins

Index, ratings and similarity edges are built once per session and folder,
written to the shared scratch folder and reused, as a user would do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftrank.operators import evaluate, recommend, search
from siftrank.operators.index import Index
from siftrank.session import scratch_path, write_and_reload
from siftrank.sources.index_store import index_documents
from siftrank.sources.tables import load, load_by, parts_of

_built: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, folder: str, label: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_by(spark, folder, "documents", "doc_id")


def topics(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "benchmark").select(
        F.col("item_id").alias("topic_id"), F.col("text").alias("title")
    )


def corpus_index(spark: SparkSession, folder: str) -> Index:
    return once(
        spark,
        folder,
        "index",
        lambda: index_documents(
            load(spark, folder, "documents"), scratch_path(spark, "index")
        ),
    )


def topic_terms(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark,
        folder,
        "topic_terms",
        lambda: write_and_reload(search.parse_topics(topics(spark, folder)), "topic-terms"),
    )


def prepared_terms(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark,
        folder,
        "prepared_terms",
        lambda: search.prepare(corpus_index(spark, folder), topic_terms(spark, folder)),
    )


def judgements(spark: SparkSession, folder: str) -> DataFrame:
    terms = topic_terms(spark, folder)
    labels = load(spark, folder, "labels").select("doc_id", "quality")
    grades = labels.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("times"))
    # Matches are counted where the documents lie; only counts that can be enough meet the labels.
    shared = (
        terms.join(corpus_index(spark, folder).postings, "term")
        .groupBy("topic_id", "doc_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    sizes = terms.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_terms"))
    most = grades.agg(F.max("times")).scalar()
    return (
        shared.join(sizes, "topic_id")
        .where(2 * F.col("shared") * most >= F.col("n_terms"))
        .join(grades, "doc_id")
        .where(2 * F.col("shared") * F.col("times") >= F.col("n_terms"))
        .select("topic_id", "doc_id", (F.col("quality") != 0).alias("relevant"))
    )


def stored_judgements(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark,
        folder,
        "judgements",
        lambda: write_and_reload(judgements(spark, folder), "judgements"),
    )


def rating_parts(spark: SparkSession, folder: str) -> int:
    """Partitions for the lines of all orders, whose number the files tell."""
    return parts_of(spark, load(spark, folder, "lineitem").count())


def rating_events(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, item_id, rating, seq) with repeats; ``seq`` orders them."""
    parts = rating_parts(spark, folder)
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
    ).repartition(parts, "l_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"),
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark,
        folder,
        "ratings",
        lambda: write_and_reload(
            recommend.latest_ratings(rating_events(spark, folder), parts=rating_parts(spark, folder)), "ratings"
        ),
    )


def user_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Similarities of the users similar enough to predict by, one row per pair. The filter is that of the rule."""
    return once(
        spark,
        folder,
        "user_edges",
        lambda: write_and_reload(
            recommend.user_similarities(ratings(spark, folder), recommend.MIN_USER_SIMILARITY, decimals=6), "user-edges"
        ),
    )


def item_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The same for items."""
    return once(
        spark,
        folder,
        "item_edges",
        lambda: write_and_reload(
            recommend.item_similarities(ratings(spark, folder), recommend.MIN_ITEM_SIMILARITY, decimals=6), "item-edges"
        ),
    )


def run(spark: SparkSession, folder: str) -> DataFrame:
    """A BM25 run, 1,000 hits per topic."""
    from siftrank.functions import models

    return once(
        spark,
        folder,
        "run",
        lambda: write_and_reload(
            search.search(
                corpus_index(spark, folder),
                prepared_terms(spark, folder),
                models.bm25(),
                k=1000,
                decimals=6,
            ),
            "run",
        ),
    )


def judged_run(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.judge(run(spark, folder), stored_judgements(spark, folder))


# --- the same in SQL -------------------------------------------------------

TEXT = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS MATERIALIZED (SELECT doc_id, len(regexp_extract_all(lower(text), '\p{L}+'))::BIGINT AS dl FROM documents),
lex AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM post GROUP BY term),
st AS MATERIALIZED (SELECT count(*) AS n_docs, sum(dl)::DOUBLE AS cl, avg(dl) AS avg_dl FROM len)
"""

TOPICS = (
    TEXT
    + r""",
qtok AS (SELECT item_id AS topic_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark),
qt AS MATERIALIZED (SELECT topic_id, term, count(*) AS qtf FROM qtok GROUP BY ALL)
"""
)

# Every query term beside every candidate; tf is NULL where the document lacks it.
FILLED = (
    TOPICS
    + """,
cand AS MATERIALIZED (SELECT DISTINCT topic_id, doc_id FROM qt JOIN post USING (term)),
fill AS (
  SELECT c.topic_id, c.doc_id, q.term, q.qtf, p.tf, len.dl, lex.df, lex.ctf, st.n_docs, st.cl, st.avg_dl
  FROM cand c JOIN qt q USING (topic_id) JOIN lex USING (term) JOIN len USING (doc_id)
  LEFT JOIN post p ON p.term = q.term AND p.doc_id = c.doc_id, st
)
"""
)

BM25_RUN = (
    TOPICS
    + """,
scored AS (
  SELECT topic_id, doc_id,
         round(sum(qtf * log2((n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.6)
               / (tf + 1.6 * (0.5 + 0.5 * dl / avg_dl))), 6) AS score
  FROM qt JOIN lex USING (term) JOIN post USING (term) JOIN len USING (doc_id), st
  GROUP BY ALL
),
run AS MATERIALIZED (
  SELECT * FROM (
    SELECT topic_id, doc_id, score,
           row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank
    FROM scored) WHERE rank <= 1000
)
"""
)

JUDGED = (
    BM25_RUN
    + """,
judged AS MATERIALIZED (
  SELECT topic_id, doc_id, quality <> 0 AS relevant
  FROM (SELECT topic_id, doc_id, count(*) AS shared FROM qt JOIN post USING (term) GROUP BY ALL)
  JOIN (SELECT topic_id, count(*) AS n_terms FROM qt GROUP BY ALL) USING (topic_id)
  JOIN labels USING (doc_id)
  WHERE 2 * shared >= n_terms
),
jr AS MATERIALIZED (
  SELECT run.topic_id, run.doc_id, run.rank, run.score, coalesce(judged.relevant, false) AS relevant
  FROM run LEFT JOIN judged USING (topic_id, doc_id)
),
goods AS MATERIALIZED (
  SELECT topic_id, coalesce(sum(relevant::INT), 0)::BIGINT AS relevant_count FROM judged GROUP BY topic_id
)
"""
)

RATINGS = """
ev AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, (1 + l_quantity::INT % 5)::DOUBLE AS rating,
         l_orderkey, l_linenumber, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
rt AS MATERIALIZED (
  SELECT user_id, item_id, rating FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM ev) WHERE rn = 1
),
um AS MATERIALIZED (SELECT user_id, avg(rating) AS mean FROM rt GROUP BY user_id),
ce AS MATERIALIZED (SELECT user_id, item_id, rating, rating - mean AS w FROM rt JOIN um USING (user_id))
"""



def _pairs_sql(name: str, who: str, via: str) -> str:
    return f"""{RATINGS},
{name} AS MATERIALIZED (
  SELECT x.{who} AS a, y.{who} AS b, round(sum(x.w * y.w) / (sqrt(sum(x.w * x.w)) * sqrt(sum(y.w * y.w))), 6) AS sim
  FROM ce x JOIN ce y ON x.{via} = y.{via} AND x.{who} < y.{who}
  GROUP BY ALL
  HAVING abs(sum(x.w * y.w)) >= 1e-9 AND sum(x.w * x.w) >= 1e-9 AND sum(y.w * y.w) >= 1e-9)
"""


USER_PAIRS = _pairs_sql("up", "user_id", "item_id")
ITEM_PAIRS = _pairs_sql("ip", "item_id", "user_id")
USER_EDGES = USER_PAIRS + ", ue AS MATERIALIZED (SELECT * FROM up WHERE sim >= 0.1)"
ITEM_EDGES = ITEM_PAIRS + ", ie AS MATERIALIZED (SELECT * FROM ip WHERE sim >= 0)"
