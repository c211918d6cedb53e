"""Ratings, similarities, predictions and recommendations.

``ratings`` is (user_id, item_id, rating), unique per (user, item). Similarity
edges are (a, b, sim) with ``a < b``; a pair without an edge has similarity -1
in the sense of the neighbourhood rules, which never use it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from siftrank.operators.neighbourhood import Rule, best_unrated, sums_of_cells
from siftrank.operators.packed import similar
from siftrank.operators.positions import number_ids, number_rows
from siftrank.operators.search import top_k
from siftrank.session import write_and_reload

# The neighbourhood rules.
NEIGHBOURS = 20
MIN_USER_SIMILARITY = 0.1
MIN_ITEM_SIMILARITY = 0.0

# A sum of products this small is zero: the order of a distributed sum may
# leave a residue where the exact value is 0.
ZERO = 1e-9

# An item (or user) with more ratings than this is paired by blocks.
HEAVY = 1024
BLOCK = 1024
CHUNK = 256
# Pairs that one task adds up, and rows of lists that it puts in order.
PAIRS = 2_000_000
# Similarity of those that share nothing, and ids beside a target in one row of a filled list.
FILL = -1.0
STRETCH = 4096
# A list of more rows than this is put in order over several tasks.
LIST = 1_000_000


# --- the rating table ------------------------------------------------------


def latest_ratings(events: DataFrame, seq: str = "seq", parts: int | None = None) -> DataFrame:
    """One rating per (user, item): the one with the largest ``seq``. Cells are sorted where they are
    settled, so many events want their number of ``parts``."""
    if parts is not None:
        events = events.repartition(parts, "user_id", "item_id")
    return events.groupBy("user_id", "item_id").agg(F.max_by("rating", seq).alias("rating"))


def set_ratings(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert ``changes`` (user_id, item_id, rating, seq); the last one wins."""
    no_seq = F.lit(None).cast(changes.schema["seq"].dataType)
    cells = ["user_id", "item_id", "rating"]
    old = ratings.select(*cells, F.lit(0).alias("_new"), no_seq.alias("seq"))
    new = changes.select(*cells, F.lit(1).alias("_new"), "seq")
    return old.unionByName(new).groupBy("user_id", "item_id").agg(
        F.max_by("rating", F.struct("_new", "seq")).alias("rating")
    )


def remove_ratings(ratings: DataFrame, cells: DataFrame) -> DataFrame:
    return ratings.join(cells.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def add_profiles(ratings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Append profiles (profile_id, item_id, rating) as new users, numbered from the
    largest user id upward in the order of ``profile_id``."""
    largest = ratings.select(F.coalesce(F.max("user_id"), F.lit(0))).scalar()
    numbered = number_ids(profiles, "profile_id", "_n")
    fresh = profiles.join(numbered, "profile_id").select(
        (largest + F.col("_n")).alias("user_id"), "item_id", "rating"
    )
    return ratings.select("user_id", "item_id", "rating").unionByName(fresh)


def remove_profiles(ratings: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed)."""
    gone = users.select("user_id").distinct()
    return ratings.join(gone, "user_id", "left_anti"), ratings.join(gone, "user_id", "left_semi")


def user_profile(ratings: DataFrame, user) -> DataFrame:
    return ratings.where(F.col("user_id") == user).select("item_id", "rating")


def item_profile(ratings: DataFrame, item) -> DataFrame:
    return ratings.where(F.col("item_id") == item).select("user_id", "rating")


def profiles(ratings: DataFrame, owner: str = "user_id", block_size: int = 4096) -> DataFrame:
    """(owner, block, profile): all profiles as arrays of (other, rating).

    A profile longer than ``block_size`` comes in several rows, so that no row
    and no task holds an unbounded profile.
    """
    other = "item_id" if owner == "user_id" else "user_id"
    sizes = ratings.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / F.lit(block_size)).cast("long")
    return (
        ratings.join(sizes, owner)
        .withColumn("block", F.pmod(F.col(other).cast("long"), blocks))
        .groupBy(owner, "block")
        .agg(F.array_sort(F.collect_list(F.struct(other, "rating"))).alias("profile"))
    )


def matrix_stats(ratings: DataFrame) -> DataFrame:
    """Ids are counted by themselves: several distinct counts in one aggregate would first write
    every rating once for each of them."""

    def ids(name: str) -> Column:
        return ratings.select(name).distinct().select(F.count(name)).scalar()

    return ratings.agg(
        F.count(F.lit(1)).alias("n_ratings"),
        ids("user_id").alias("n_users"),
        ids("item_id").alias("n_items"),
        F.avg("rating").alias("mean"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("deviation"),
    )


def profile_stats(ratings: DataFrame, owner: str = "user_id") -> DataFrame:
    return ratings.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.avg("rating").alias("mean"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("deviation"),
    )


def get_ratings(ratings: DataFrame, cells: DataFrame) -> DataFrame:
    """The requested cells that have a rating."""
    return ratings.join(cells.select("user_id", "item_id").distinct(), ["user_id", "item_id"])


def has_ratings(ratings: DataFrame, cells: DataFrame) -> DataFrame:
    """Every requested cell with ``rated`` true or false."""
    marks = ratings.select("user_id", "item_id", F.lit(True).alias("_there"))
    return cells.join(marks, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", F.col("_there").isNotNull().alias("rated")
    )


# --- similarity ------------------------------------------------------------


def centred(ratings: DataFrame) -> DataFrame:
    """Ratings with ``w``, the rating less the user's mean over all their ratings."""
    means = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    return ratings.join(means, "user_id").select(
        "user_id", "item_id", "rating", "mean", (F.col("rating") - F.col("mean")).alias("w")
    )


def user_similarities(ratings: DataFrame, minimum: float | None = None, **how) -> DataFrame:
    """Pearson similarity of users over the items both rated."""
    return _similarities(centred(ratings), "user_id", "item_id", minimum, **how)


def item_similarities(ratings: DataFrame, minimum: float | None = None, **how) -> DataFrame:
    """Adjusted cosine of items over the users who rated both."""
    return _similarities(centred(ratings), "item_id", "user_id", minimum, **how)


def _similarities(
    cells: DataFrame,
    who: str,
    via: str,
    minimum: float | None,
    decimals: int | None = None,
    heavy: int = HEAVY,
    block: int = BLOCK,
    chunk: int = CHUNK,
    pairs: int = PAIRS,
    lists: bool = False,
) -> DataFrame:
    """Similarity of all pairs of ``who`` that meet on some ``via``.

    A ``via`` with at most ``heavy`` cells is packed and goes once to each part of ids that it has (``packed.similar``), where
    its pairs are made and added up, so neither pairs nor their sums are shuffled. A ``who`` with far more pairs than
    ``pairs`` goes by a join, whose pairs spread. Beyond ``heavy`` the cells are laid out in blocks of
    ``who`` by chunks of ``via`` and the sums come from products of bounded matrices, added up before
    anything is shuffled. With either, and for ids that are no whole numbers, each cell of the others goes with the cells of
    larger ``who`` beside it to the task of its ``who``. All ways are exact.

    With ``lists`` the pairs come in both directions and in the order of ``similarity_lists``.
    """
    w = (F.col("rating") - F.col("mean")).alias("w")
    cells = cells.select(F.col(who).alias("x"), F.col(via).alias("v"), *[F.col(c).cast("double").alias(c) for c in ("rating", "mean")])
    cells = write_and_reload(cells.where("x IS NOT NULL AND v IS NOT NULL"), "cells")
    n = F.col("n")
    counts = cells.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    crowded = write_and_reload(counts.where(n > heavy).select("v"), "crowded")
    total = counts.where(n <= heavy).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()[0]
    light = cells.join(crowded, "v", "left_anti")
    met = F.sort_array(F.collect_list(F.struct("x", "rating", "mean")))
    profiles = light.groupBy("v").agg(met.alias("met")).where(F.size("met") > 1)
    profiles = profiles.select(F.col("met.x").alias("xs"), F.col("met.rating").alias("rs"), F.col("met.mean").alias("ms"))
    profiles = write_and_reload(profiles, "profiles")
    hot, parts = _hot(profiles, 4 * pairs), max(1, math.ceil(total * (2 if lists else 1) / pairs))
    odd = cells.agg(F.coalesce(F.max(F.isnan("rating") | F.isnan("mean")), F.lit(False)), F.count(F.lit(1))).first()
    whole = cells.schema["x"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if crowded.isEmpty() and hot is None and whole and not odd[0]:
        edges = similar(profiles, odd[1], parts, decimals, ZERO, lists)
        return edges if minimum is None else edges.where(F.col("sim") >= minimum)
    light, cells = (df.select("x", "v", w) for df in (light, cells))
    sums = _pairs_by_profile(profiles.select("xs", F.zip_with("rs", "ms", lambda r, m: r - m).alias("ws")), parts, hot)
    blocks = None
    if not crowded.isEmpty():
        blocks = _pairs_by_blocks(cells.join(crowded, "v", "left_semi"), block, chunk)
        ours = blocks if hot is None else blocks.join(hot, "a", "left_anti")
        sums = sums.unionByName(ours.repartition(parts, "a"))
    edges = _similarity_of_sums(sums, decimals)
    if hot is not None:
        spread = _pairs_by_join(light, hot)
        if blocks is not None:
            spread = spread.unionByName(blocks.join(hot, "a", "left_semi"))
        edges = edges.unionByName(_similarity_of_sums(spread, decimals))
    edges = edges if minimum is None else edges.where(F.col("sim") >= minimum)
    return similarity_lists(write_and_reload(edges, "edges")) if lists else edges


def _hot(profiles: DataFrame, most: int) -> DataFrame | None:
    """Ids ``a`` that make more than ``most`` pairs with larger ones, if there are any."""
    places = profiles.select(F.posexplode("xs").alias("at", "a"), F.size("xs").alias("n"))
    loads = places.groupBy("a").agg(F.sum(F.col("n") - F.col("at") - 1).alias("load"))
    hot = write_and_reload(loads.where(F.col("load") > most).select("a"), "hot")
    return None if hot.isEmpty() else hot


def _pairs_by_profile(profiles: DataFrame, parts: int, hot: DataFrame | None) -> DataFrame:
    """Pairs of packed profiles (xs, ws), in order of ``xs``; all pairs of an ``a`` lie in one of ``parts`` partitions."""
    at, size = F.col("at"), F.size("xs")
    ahead = (
        profiles.repartition(parts).select("xs", "ws", F.posexplode("xs").alias("at", "a")).where(at + 1 < size)
        .select("a", F.get("ws", at).alias("wa"), *[F.slice(c, at + 2, size).alias(c) for c in ("xs", "ws")])
    )
    if hot is not None:
        ahead = ahead.join(hot, "a", "left_anti")
    made = ahead.repartition(parts, "a").select("a", "wa", "ws", F.posexplode("xs").alias("at", "b"))
    wa, wb = F.col("wa"), F.get("ws", at)
    return made.where(F.col("a") < F.col("b")).select(
        "a", "b", (wa * wb).alias("dot"), (wa * wa).alias("sq_a"), (wb * wb).alias("sq_b")
    )


def _similarity_of_sums(sums: DataFrame, decimals: int | None) -> DataFrame:
    """(a, b, sim) of the pairs whose similarity is defined."""
    totals = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("dot", "sq_a", "sq_b")])
    sim = F.col("dot") / (F.sqrt("sq_a") * F.sqrt("sq_b"))
    defined = (F.abs("dot") >= ZERO) & (F.col("sq_a") >= ZERO) & (F.col("sq_b") >= ZERO)
    return totals.where(defined).select("a", "b", (sim if decimals is None else F.round(sim, decimals)).alias("sim"))


def user_similarities_to(targets: DataFrame, ratings: DataFrame, **how) -> DataFrame:
    """(one, other, sim): each user of ``targets`` (user_id) against all other users; -1 where the
    similarity is not defined."""
    return _similarities_to(targets, centred(ratings), "user_id", "item_id", **how)


def item_similarities_to(targets: DataFrame, ratings: DataFrame, **how) -> DataFrame:
    """The same for the items of ``targets`` (item_id)."""
    return _similarities_to(targets, centred(ratings), "item_id", "user_id", **how)


def _similarities_to(
    targets: DataFrame,
    cells: DataFrame,
    who: str,
    via: str,
    fill: float | None = -1.0,
    decimals: int | None = None,
    heavy: int = HEAVY,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """Only cells of targets meet those of others, by a join or, for a crowded ``via``, in
    products of blocks of targets and blocks of all. The rest of the rows is filled, unless
    ``fill`` is None, which leaves that to ``ranked_lists``."""
    cells = write_and_reload(cells.select(F.col(who).alias("x"), F.col(via).alias("v"), "w"), "cells")
    asked = write_and_reload(targets.select(F.col(who).alias("x")).distinct(), "targets")
    crowded = write_and_reload(cells.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("v"), "crowded")
    own = cells.join(asked, "x", "left_semi")
    wa, wb = F.col("wa"), F.col("wb")
    met = (
        own.join(crowded, "v", "left_anti").select("v", F.col("x").alias("a"), F.col("w").alias("wa"))
        .join(cells.select("v", F.col("x").alias("b"), F.col("w").alias("wb")), "v")
        .where(F.col("a") != F.col("b"))
        .select("a", "b", (wa * wb).alias("dot"), (wa * wa).alias("sq_a"), (wb * wb).alias("sq_b"))
    )
    if not crowded.isEmpty():
        dense = cells.join(crowded, "v", "left_semi")
        met = met.unionByName(_target_blocks(dense.join(asked, "x", "left_semi"), dense, block, chunk))
    sims = _similarity_of_sums(met, decimals)
    if fill is None:
        return sims.select(F.col("a").alias("one"), F.col("b").alias("other"), "sim")
    # all ids against the targets, a block of targets after the other
    n = max(1, -(-asked.count() // block))
    rows = cells.select(F.col("x").alias("b")).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = asked.select(F.col("x").alias("a"), F.pmod(F.xxhash64("x"), F.lit(n)).cast("int").alias("_block"))
    every = rows.join(dealt, "_block").where(F.col("a") != F.col("b")).select("a", "b")
    filled = every.join(sims, ["a", "b"], "left")
    return filled.select(F.col("a").alias("one"), F.col("b").alias("other"), F.coalesce("sim", F.lit(fill)).alias("sim"))


def _target_blocks(own: DataFrame, every: DataFrame, block: int, chunk: int) -> DataFrame:
    """Partial pair sums of targets and all, over crowded ``v``."""
    counted = every.agg(F.count_distinct("x").alias("x"), F.count_distinct("v").alias("v")).first()
    asked = own.agg(F.count_distinct("x")).first()[0]
    n_p, n_q, n_c = (max(1, -(-n // size)) for n, size in ((asked, block), (counted["x"], block), (counted["v"], chunk)))
    place = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select("x", "v", "w", F.lit(True).alias("target"), place("x", n_p).alias("p"), to_all(n_q).alias("q"), place("v", n_c).alias("c"))
    right = every.select("x", "v", "w", F.lit(False).alias("target"), to_all(n_p).alias("p"), place("x", n_q).alias("q"), place("v", n_c).alias("c"))
    ids = every.schema["x"].dataType.simpleString()
    return left.unionByName(right).groupBy("p", "q", "c").applyInPandas(
        _target_products, f"a {ids}, b {ids}, dot double, sq_a double, sq_b double"
    )


def _target_products(rows: pd.DataFrame) -> pd.DataFrame:
    columns, width = pd.factorize(rows["v"])[0], rows["v"].nunique()
    target = rows["target"].to_numpy()
    (names_l, left, in_l), (names_r, right, in_r) = (_dense(rows, columns, width, mask) for mask in (target, ~target))
    i, j = np.nonzero(in_l @ in_r.T)
    apart = names_l[i] != names_r[j]
    i, j = i[apart], j[apart]
    return pd.DataFrame(
        {
            "a": names_l[i],
            "b": names_r[j],
            "dot": (left @ right.T)[i, j],
            "sq_a": ((left * left) @ in_r.T)[i, j],
            "sq_b": (in_l @ (right * right).T)[i, j],
        }
    )


def _dense(rows: pd.DataFrame, columns: np.ndarray, width: int, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names, values and presence of the rows of one side of a block."""
    ids, names = pd.factorize(rows.loc[mask, "x"], sort=True)
    values, present = np.zeros((len(names), width)), np.zeros((len(names), width))
    values[ids, columns[mask]] = rows.loc[mask, "w"]
    present[ids, columns[mask]] = 1.0
    return np.asarray(names), values, present


def _pairs_by_join(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of the ids ``a`` in ``hot``."""
    left = cells.select("v", F.col("x").alias("a"), F.col("w").alias("wa")).join(hot, "a", "left_semi")
    right = cells.select("v", F.col("x").alias("b"), F.col("w").alias("wb"))
    wa, wb = F.col("wa"), F.col("wb")
    return (
        left.join(right, "v")
        .where(F.col("a") < F.col("b"))
        .select("a", "b", (wa * wb).alias("dot"), (wa * wa).alias("sq_a"), (wb * wb).alias("sq_b"))
    )


def _pairs_by_blocks(cells: DataFrame, block: int, chunk: int) -> DataFrame:
    """Partial pair sums of crowded ``v``.

    Rows of the sparse matrix are dealt to blocks by hash, columns to chunks, and
    each pair of blocks meets once per chunk. A group has about ``2 * block``
    rows by ``chunk`` columns, whatever the skew.
    """
    blocks = F.greatest(
        F.lit(1), F.ceil(cells.select(F.count_distinct("x")).scalar() / F.lit(block))
    ).cast("int")
    chunks = F.greatest(
        F.lit(1), F.ceil(cells.select(F.count_distinct("v")).scalar() / F.lit(chunk))
    ).cast("int")
    placed = cells.withColumns({"_blocks": blocks, "_chunks": chunks}).select(
        "x",
        "v",
        "w",
        F.pmod(F.xxhash64("x"), F.col("_blocks")).cast("int").alias("p"),
        F.pmod(F.xxhash64("v"), F.col("_chunks")).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("q"),
    )
    groups = placed.select(
        F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "c", "p", "x", "v", "w"
    )
    ids = cells.schema["x"].dataType.simpleString()
    return groups.groupBy("lo", "hi", "c").applyInPandas(
        _block_products, f"a {ids}, b {ids}, dot double, sq_a double, sq_b double"
    )


def _block_products(rows: pd.DataFrame) -> pd.DataFrame:
    lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
    columns, n_columns = pd.factorize(rows["v"])[0], rows["v"].nunique()

    names_l, left, in_l = _dense(rows, columns, n_columns, (rows["p"] == lo).to_numpy())
    names_r, right, in_r = _dense(rows, columns, n_columns, (rows["p"] == hi).to_numpy())
    together = in_l @ in_r.T
    if lo == hi:
        together = np.triu(together, 1)
    i, j = np.nonzero(together)
    dot = (left @ right.T)[i, j]
    sq_l = ((left * left) @ in_r.T)[i, j]
    sq_r = (in_l @ (right * right).T)[i, j]
    a, b = names_l[i], names_r[j]
    swap = a > b
    return pd.DataFrame(
        {
            "a": np.where(swap, b, a),
            "b": np.where(swap, a, b),
            "dot": dot,
            "sq_a": np.where(swap, sq_r, sq_l),
            "sq_b": np.where(swap, sq_l, sq_r),
        }
    )


def mirrored(edges: DataFrame, one: str = "one", other: str = "other") -> DataFrame:
    """Both directions of every edge."""
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias(one), F.col("b").alias(other)),
            F.struct(F.col("b").alias(one), F.col("a").alias(other)),
        )
    )
    return edges.select(both.alias("_e"), "sim").select(f"_e.{one}", f"_e.{other}", "sim")


def similarity_lists(edges: DataFrame, k: int | None = None) -> DataFrame:
    """(one, other, sim, rank): most similar first, ties to the larger id. Similarities that were made as
    ``lists`` have their order from where they were added up."""
    if "rank" in edges.columns:
        return edges if k is None else edges.where(F.col("rank") <= k)
    return ranked_lists(mirrored(edges), k)


def ranked_lists(
    rows: DataFrame, k: int | None = None, longest: int = LIST, targets: DataFrame | None = None, others: DataFrame | None = None
) -> DataFrame:
    """The same for rows (one, other, sim); with ``targets`` and ``others`` (id) also for
    pairs of them without a row (``filled_lists``). Without ``k`` whole lists are put in order, after one
    shuffle. Lists of more than ``longest`` rows are put in order over ranges and a rank is the distance
    from the first of its list, so none of them stands in one task."""
    best_first = [F.col("sim").desc(), F.col("other").desc()]
    if targets is not None and others is not None:
        filled = filled_lists(rows, targets, others)
        return filled if k is None else filled.where(F.col("rank") <= k)
    if k is not None:
        return top_k(rows, k, keys=["one"], order=best_first)
    sizes = write_and_reload(rows.groupBy("one").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    long = sizes.where(F.col("n") > longest).select("one")
    short = rows if most <= longest else rows.where(F.col("one").isNotNull()).join(long, "one", "left_anti")
    ranked = top_k(short.repartition(max(1, math.ceil(total / PAIRS)), "one"), None, keys=["one"], order=best_first)
    ranked = ranked.select("one", "other", "sim", F.col("rank").cast("long").alias("rank"))
    if most <= longest:
        return ranked
    placed = number_rows(rows.join(long, "one", "left_semi"), [F.col("one").asc(), *best_first], "_place")
    first = placed.groupBy("one").agg(F.min("_place").alias("_first"))
    return ranked.unionByName(
        placed.join(first, "one").select("one", "other", "sim", (F.col("_place") - F.col("_first") + 1).alias("rank"))
    )


def filled_lists(rows: DataFrame, targets: DataFrame, others: DataFrame, fill: float = FILL, stretch: int = STRETCH) -> DataFrame:
    """``ranked_lists`` of all ``others`` (id) for each of ``targets`` (id), itself left out; those without a
    row (one, other, sim) have the similarity ``fill``.

    Only the given rows are put in order. Those of similarity ``fill`` come by falling id, so their ranks follow from
    the places of the ids: a stretch of ids beside a target leaves out what has a row and counts on from
    the stretches before.
    """
    rows = write_and_reload(rows, "known")
    own = F.col("sim") != fill
    ranked = write_and_reload(ranked_lists(rows.where(own)), "ranked")
    place = F.col("place") - 1
    ids = number_ids(others.where(F.col("id").isNotNull()), "id", "place", descending=True)
    ids = write_and_reload(ids.select("id", F.floor(place / stretch).alias("part"), (place % stretch).alias("at")), "ids")
    asked = targets.where(F.col("id").isNotNull()).select(F.col("id").alias("one")).distinct()
    inside = ids.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("ids"))
    inside = write_and_reload(inside.select("part", "ids.id", F.size("ids").alias("size")), "stretches")
    # what does not have the fill: the target itself and its own rows, by stretch
    away = ranked.select("one", "other").unionByName(asked.select("one", F.col("one").alias("other")))
    away = away.join(ids.withColumnRenamed("id", "other"), "other")
    away = away.groupBy("one", "part").agg(F.collect_list("other").alias("away"))
    ahead = ranked.groupBy("one").agg(F.sum((F.col("sim") > fill).cast("long")).alias("ahead"))
    before = W.partitionBy("one").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    none = F.array().cast(away.schema["away"].dataType)
    sizes = inside.select("part", "size")
    every = asked.withColumn("_all", F.lit(1)).join(sizes.withColumn("_all", F.lit(1)), "_all").drop("_all")
    every = every.join(away, ["one", "part"], "left").withColumn("away", F.coalesce("away", none))
    left = F.col("size") - F.size("away")
    every = every.withColumn("start", F.coalesce(F.sum(left).over(before), F.lit(0))).join(ahead, "one", "left")
    start = F.coalesce("ahead", F.lit(0)) + F.col("start")
    rest = every.join(inside.select("part", "id"), "part").select(
        "one", start.alias("start"), F.posexplode(F.array_except("id", "away")).alias("at", "other")
    )
    rest = rest.select("one", "other", F.lit(fill).alias("sim"), (F.col("start") + F.col("at") + 1).cast("long").alias("rank"))
    # rows below the fill come after all that have it
    n = ids.count()
    sizes = ranked.groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    behind = ranked.join(sizes, "one")
    rank = F.when(F.col("sim") > fill, F.col("rank")).otherwise(F.col("rank") + F.lit(n - 1) - F.col("n"))
    return behind.select("one", "other", "sim", rank.cast("long").alias("rank")).unionByName(rest)


# --- prediction ------------------------------------------------------------

_CELL = ["user_id", "item_id"]


def _user_links(ratings: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The users near a user, and the deviations of their ratings."""
    near = mirrored(edges.where(F.col("sim") >= MIN_USER_SIMILARITY), "u", "x").withColumnRenamed("sim", "v")
    far = centred(ratings).select(F.col("user_id").alias("x"), F.col("item_id").alias("i"), F.col("w").alias("v"))
    return near, far


def _item_links(ratings: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items a user rated, and the items similar to them."""
    near = ratings.select(F.col("user_id").alias("u"), F.col("item_id").alias("x"), F.col("rating").alias("v"))
    far = mirrored(edges.where(F.col("sim") >= MIN_ITEM_SIMILARITY), "x", "i").withColumnRenamed("sim", "v")
    return near, far


def _means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"))


def _user_value() -> Column:
    shift = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0))
    return F.col("mean") + F.coalesce(shift, F.lit(0.0))


def _item_value() -> Column:
    return F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("mean"))


def _clipped(value: Column, clip: tuple[float, float] | None) -> Column:
    return value if clip is None else F.least(F.greatest(value, F.lit(clip[0])), F.lit(clip[1]))


def predict_user_based(
    targets: DataFrame,
    ratings: DataFrame,
    edges: DataFrame,
    k: int = NEIGHBOURS,
    clip: tuple[float, float] | None = None,
    **how,
) -> DataFrame:
    """(user_id, item_id, prediction): the user's mean moved by the deviations of
    the ``k`` most similar users who rated the item."""
    sums = sums_of_cells(targets, *_user_links(ratings, edges), Rule(True, k), **how)
    return _predict(targets, ratings, sums, _user_value(), clip)


def predict_item_based(
    targets: DataFrame,
    ratings: DataFrame,
    edges: DataFrame,
    k: int = NEIGHBOURS,
    clip: tuple[float, float] | None = None,
    **how,
) -> DataFrame:
    """(user_id, item_id, prediction): the user's ratings of the ``k`` most similar
    items, weighted by similarity."""
    sums = sums_of_cells(targets, *_item_links(ratings, edges), Rule(False, k), **how)
    return _predict(targets, ratings, sums, _item_value(), clip)


def _predict(targets, ratings, sums, value, clip) -> DataFrame:
    return (
        targets.select(*_CELL)
        .join(_means(ratings), "user_id")
        .join(sums, _CELL, "left")
        .select(*_CELL, _clipped(value, clip).alias("prediction"))
    )


# --- recommendation --------------------------------------------------------


def recommend_user_based(
    ratings: DataFrame,
    edges: DataFrame,
    top: int | None = 10,
    users: DataFrame | None = None,
    k: int = NEIGHBOURS,
    decimals: int | None = None,
    **how,
) -> DataFrame:
    """(user_id, item_id, prediction, rank): unseen items, best first. Items that no
    neighbour reaches have the user's mean."""
    links = _user_links(ratings, edges)
    return best_unrated(ratings, _asked(ratings, users), *links, Rule(True, k), top, decimals, **how)


def recommend_item_based(
    ratings: DataFrame,
    edges: DataFrame,
    top: int | None = 10,
    users: DataFrame | None = None,
    k: int = NEIGHBOURS,
    decimals: int | None = None,
    **how,
) -> DataFrame:
    links = _item_links(ratings, edges)
    return best_unrated(ratings, _asked(ratings, users), *links, Rule(False, k), top, decimals, **how)


def _asked(ratings: DataFrame, users: DataFrame | None) -> DataFrame:
    """The means of the users asked for, or of all."""
    means = _means(ratings)
    return means if users is None else means.join(users.select("user_id").distinct(), "user_id", "left_semi")
