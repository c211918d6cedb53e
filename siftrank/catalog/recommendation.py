"""Queries: ratings, similarities, predictions and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.operators import recommend as R

CATALOG = Catalog()


@CATALOG.add("latest_ratings", f"WITH {I.RATINGS} SELECT user_id, item_id, rating FROM rt")
def latest_ratings(spark, folder):
    return R.latest_ratings(I.rating_events(spark, folder), parts=I.rating_parts(spark, folder))


# Line items flagged returned are re-rated 1; a later change of a cell wins.
@CATALOG.add(
    "set_ratings",
    f"""WITH {I.RATINGS}, ch AS (
SELECT user_id, item_id, rating FROM (SELECT o_custkey AS user_id, l_partkey AS item_id, 1.0::DOUBLE AS rating
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') GROUP BY ALL)
SELECT user_id, item_id, rating FROM ch
UNION ALL SELECT user_id, item_id, rating FROM rt WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM ch)""",
)
def set_ratings(spark, folder):
    return R.set_ratings(I.ratings(spark, folder), _returned(spark, folder))


def _returned(spark, folder):
    from siftrank.sources.tables import load

    lines = load(spark, folder, "lineitem").where("l_returnflag = 'R'")
    orders = load(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.lit(1.0).alias("rating"),
        F.col("l_orderkey").alias("seq"),
    )


@CATALOG.add(
    "remove_ratings",
    f"""WITH {I.RATINGS} SELECT user_id, item_id, rating FROM rt WHERE (user_id, item_id) NOT IN (
SELECT (o_custkey, l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')""",
)
def remove_ratings(spark, folder):
    return R.remove_ratings(I.ratings(spark, folder), _returned(spark, folder))


# The suppliers' line items as incoming profiles.
@CATALOG.add(
    "add_profiles",
    f"""WITH {I.RATINGS}, inc AS (SELECT l_suppkey AS profile_id, l_partkey AS item_id,
  max(1 + l_quantity::INT % 5)::DOUBLE AS rating FROM lineitem GROUP BY ALL)
SELECT user_id, item_id, rating FROM rt UNION ALL
SELECT (SELECT max(user_id) FROM rt) + dense_rank() OVER (ORDER BY profile_id) AS user_id, item_id, rating FROM inc""",
)
def add_profiles(spark, folder):
    from siftrank.sources.tables import load

    incoming = (
        load(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("profile_id"), F.col("l_partkey").alias("item_id"))
        .agg(F.max(1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"))
    )
    return R.add_profiles(I.ratings(spark, folder), incoming)


_BUILDING = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@CATALOG.add(
    "remove_profiles",
    f"""WITH {I.RATINGS} SELECT user_id, item_id, rating,
CASE WHEN user_id IN ({_BUILDING}) THEN 'removed' ELSE 'kept' END AS part FROM rt""",
)
def remove_profiles(spark, folder):
    from siftrank.sources.tables import load

    users = (
        load(spark, folder, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.col("c_custkey").alias("user_id"))
    )
    kept, removed = R.remove_profiles(I.ratings(spark, folder), users)
    return kept.withColumn("part", F.lit("kept")).unionByName(
        removed.withColumn("part", F.lit("removed"))
    )


def _profile_text(column: str, other: str):
    return F.array_join(
        F.transform(column, lambda p: F.concat_ws(":", p[other], p["rating"].cast("int"))), " "
    )


@CATALOG.add(
    "user_profiles",
    f"""WITH {I.RATINGS} SELECT user_id, string_agg(item_id || ':' || rating::INT, ' ' ORDER BY item_id) AS profile
FROM rt GROUP BY user_id""",
)
def user_profiles(spark, folder):
    return R.profiles(I.ratings(spark, folder), "user_id", 1_000_000).select(
        "user_id", _profile_text("profile", "item_id").alias("profile")
    )


@CATALOG.add(
    "item_profiles",
    f"""WITH {I.RATINGS}, sized AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM rt)
SELECT item_id, (user_id % ceil(n / 16.0)::BIGINT)::BIGINT AS block,
  string_agg(user_id || ':' || rating::INT, ' ' ORDER BY user_id) AS profile FROM sized GROUP BY ALL""",
)
def item_profiles(spark, folder):
    """Item profiles in blocks of about 16, to exercise the splitting."""
    return R.profiles(I.ratings(spark, folder), "item_id", 16).select(
        "item_id", "block", _profile_text("profile", "user_id").alias("profile")
    )


_MOMENTS = "count(*) AS n_ratings, round(avg(rating), 6) AS mean, round(coalesce(stddev_samp(rating), 0), 6) AS deviation"


def _round_moments(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@CATALOG.add(
    "rating_matrix_stats",
    f"WITH {I.RATINGS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, {_MOMENTS} FROM rt",
)
def rating_matrix_stats(spark, folder):
    return _round_moments(R.matrix_stats(I.ratings(spark, folder)))


@CATALOG.add(
    "user_profile_stats", f"WITH {I.RATINGS} SELECT user_id, {_MOMENTS} FROM rt GROUP BY user_id"
)
def user_profile_stats(spark, folder):
    return _round_moments(R.profile_stats(I.ratings(spark, folder), "user_id"))


@CATALOG.add(
    "item_profile_stats", f"WITH {I.RATINGS} SELECT item_id, {_MOMENTS} FROM rt GROUP BY item_id"
)
def item_profile_stats(spark, folder):
    return _round_moments(R.profile_stats(I.ratings(spark, folder), "item_id"))


# Asked cells: every customer against the supplier number of each of their lines.
_ASKED = "SELECT DISTINCT o_custkey AS user_id, l_suppkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _asked(spark, folder):
    from siftrank.sources.tables import load

    lines, orders = load(spark, folder, "lineitem"), load(spark, folder, "orders")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("item_id"))
        .distinct()
    )


@CATALOG.add(
    "rating_lookup",
    f"WITH {I.RATINGS}, asked AS ({_ASKED}) SELECT user_id, item_id, rating FROM rt JOIN asked USING (user_id, item_id)",
)
def rating_lookup(spark, folder):
    return R.get_ratings(I.ratings(spark, folder), _asked(spark, folder))


@CATALOG.add(
    "rating_exists",
    f"""WITH {I.RATINGS}, asked AS ({_ASKED}) SELECT user_id, item_id, rating IS NOT NULL AS rated
FROM asked LEFT JOIN rt USING (user_id, item_id)""",
)
def rating_exists(spark, folder):
    return R.has_ratings(I.ratings(spark, folder), _asked(spark, folder))


@CATALOG.add("user_similarity", f"WITH {I.USER_PAIRS} SELECT a, b, sim FROM up")
def user_similarity(spark, folder):
    return R.user_similarities(I.ratings(spark, folder), decimals=6)


@CATALOG.add("item_similarity", f"WITH {I.ITEM_PAIRS} SELECT a, b, sim FROM ip")
def item_similarity(spark, folder):
    return R.item_similarities(I.ratings(spark, folder), decimals=6)


def _lists_sql(ctes: str, edges: str) -> str:
    return f"""WITH {ctes}, two AS (SELECT a AS one, b AS other, sim FROM {edges} UNION ALL SELECT b, a, sim FROM {edges})
SELECT one, other, sim, row_number() OVER (PARTITION BY one ORDER BY sim DESC, other DESC) AS rank FROM two"""


@CATALOG.add("user_similarity_lists", _lists_sql(I.USER_PAIRS, "up"))
def user_similarity_lists(spark, folder):
    return R.similarity_lists(R.user_similarities(I.ratings(spark, folder), decimals=6, lists=True))


@CATALOG.add("item_similarity_lists", _lists_sql(I.ITEM_PAIRS, "ip"))
def item_similarity_lists(spark, folder):
    return R.similarity_lists(R.item_similarities(I.ratings(spark, folder), decimals=6, lists=True))


def _to_all_sql(ctes: str, edges: str, who: str) -> str:
    return f"""WITH {ctes}, two AS (SELECT a AS one, b AS other, sim FROM {edges} UNION ALL SELECT b, a, sim FROM {edges}),
ids AS (SELECT DISTINCT {who} AS id FROM rt),
every AS (SELECT t.id AS one, o.id AS other, coalesce(sim, -1) AS sim FROM ids t JOIN ids o ON t.id <> o.id
  LEFT JOIN two ON one = t.id AND other = o.id WHERE t.id % 20 = 0)
SELECT one, other, sim, row_number() OVER (PARTITION BY one ORDER BY sim DESC, other DESC) AS rank FROM every"""


def _asked_ids(ratings, who):
    """The query set: ids divisible by 20, against all."""
    return ratings.where(F.col(who) % 20 == 0).select(who).distinct()


@CATALOG.add("user_similarity_to_all", _to_all_sql(I.USER_PAIRS, "up", "user_id"))
def user_similarity_to_all(spark, folder):
    """Every user beside each user asked for, -1 where nothing is shared, in order."""
    return _lists_to_all(I.ratings(spark, folder), "user_id", R.user_similarities_to)


@CATALOG.add("item_similarity_to_all", _to_all_sql(I.ITEM_PAIRS, "ip", "item_id"))
def item_similarity_to_all(spark, folder):
    return _lists_to_all(I.ratings(spark, folder), "item_id", R.item_similarities_to)


def _lists_to_all(ratings, who, similarities_to):
    asked = _asked_ids(ratings, who)
    known = similarities_to(asked, ratings, fill=None, decimals=6)
    ids = [df.select(F.col(who).alias("id")) for df in (asked, ratings)]
    return R.ranked_lists(known, targets=ids[0], others=ids[1])


_USER_PARTS = """two AS MATERIALIZED (SELECT a AS user_id, b AS other, sim FROM ue UNION ALL SELECT b, a, sim FROM ue),
near AS (SELECT user_id, item_id, num, den FROM (
  SELECT two.user_id, ce.item_id, sim * w AS num, sim AS den,
    row_number() OVER (PARTITION BY two.user_id, ce.item_id ORDER BY sim DESC, other DESC) AS rn
  FROM two JOIN ce ON ce.user_id = two.other {targets}) WHERE rn <= 20),
sums AS (SELECT user_id, item_id, sum(num) AS num, sum(den) AS den FROM near GROUP BY ALL)
"""
_ITEM_PARTS = """two AS MATERIALIZED (SELECT a AS item_id, b AS other, sim FROM ie UNION ALL SELECT b, a, sim FROM ie),
near AS (SELECT user_id, item_id, num, den FROM (
  SELECT rt.user_id, two.item_id, sim * rt.rating AS num, sim AS den,
    row_number() OVER (PARTITION BY rt.user_id, two.item_id ORDER BY sim DESC, other DESC) AS rn
  FROM two JOIN rt ON rt.item_id = two.other {targets}) WHERE rn <= 20),
sums AS (SELECT user_id, item_id, sum(num) AS num, sum(den) AS den FROM near GROUP BY ALL)
"""
_USER_VALUE = "mean + CASE WHEN den > 0 THEN num / den ELSE 0 END"
_ITEM_VALUE = "CASE WHEN den > 0 THEN num / den ELSE mean END"


@CATALOG.add(
    "predict_user_based",
    f"""WITH {I.USER_EDGES}, {_USER_PARTS.format(targets="JOIN rt t ON t.user_id = two.user_id AND t.item_id = ce.item_id")}
SELECT user_id, item_id, round({_USER_VALUE}, 6) AS prediction
FROM rt JOIN um USING (user_id) LEFT JOIN sums USING (user_id, item_id)""",
)
def predict_user_based(spark, folder):
    """Every rated cell, predicted from the other users."""
    ratings = I.ratings(spark, folder)
    out = R.predict_user_based(ratings, ratings, I.user_edges(spark, folder))
    return out.withColumn("prediction", F.round("prediction", 6))


@CATALOG.add(
    "predict_item_based",
    f"""WITH {I.ITEM_EDGES}, {_ITEM_PARTS.format(targets="JOIN rt t ON t.user_id = rt.user_id AND t.item_id = two.item_id")}
SELECT user_id, item_id, round({_ITEM_VALUE}, 6) AS prediction
FROM rt JOIN um USING (user_id) LEFT JOIN sums USING (user_id, item_id)""",
)
def predict_item_based(spark, folder):
    """Every rated cell, predicted from the user's other items."""
    ratings = I.ratings(spark, folder)
    out = R.predict_item_based(ratings, ratings, I.item_edges(spark, folder))
    return out.withColumn("prediction", F.round("prediction", 6))


def _recommend_sql(ctes: str, parts: str, value: str) -> str:
    return f"""WITH {ctes}, {parts.format(targets="")},
cells AS (SELECT user_id, mean, item_id FROM um, (SELECT DISTINCT item_id FROM rt)),
preds AS (SELECT user_id, item_id, round({value}, 6) AS prediction
  FROM cells LEFT JOIN sums USING (user_id, item_id)
  WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM rt))
SELECT user_id, item_id, prediction, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id DESC) AS rank FROM preds) WHERE rank <= 10"""


@CATALOG.add(
    "recommend_user_based",
    _recommend_sql(I.USER_EDGES, _USER_PARTS, "mean + CASE WHEN den > 0 THEN num / den ELSE 0 END"),
)
def recommend_user_based(spark, folder):
    return R.recommend_user_based(
        I.ratings(spark, folder), I.user_edges(spark, folder), top=10, decimals=6
    )


@CATALOG.add("recommend_item_based", _recommend_sql(I.ITEM_EDGES, _ITEM_PARTS, _ITEM_VALUE))
def recommend_item_based(spark, folder):
    return R.recommend_item_based(
        I.ratings(spark, folder), I.item_edges(spark, folder), top=10, decimals=6
    )
