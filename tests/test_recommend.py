import random

import pytest
from pyspark.sql import functions as F

from siftrank.operators import recommend as R


def stored(df):
    from siftrank.session import write_and_reload

    return write_and_reload(df, "similar")


def edges(df):
    return {(r.a, r.b): r.sim for r in df.collect()}


def test_user_similarity(ratings):
    got = edges(R.user_similarities(ratings))
    assert got[(1, 2)] == pytest.approx(0.956183, abs=1e-6)
    assert got[(1, 3)] == pytest.approx(0.816497, abs=1e-6)
    assert got[(1, 5)] == pytest.approx(-0.845626, abs=1e-6)
    assert (1, 4) not in got


def test_item_similarity(ratings):
    got = edges(R.item_similarities(ratings))
    assert [got[(j, 4)] for j in (1, 2, 3)] == pytest.approx([0.510630, -0.515716, -0.966195], abs=1e-6)


def test_predictions(spark, ratings):
    cell = spark.createDataFrame([(1, 4)], "user_id long, item_id long")
    user = R.predict_user_based(cell, ratings, R.user_similarities(ratings, 0.1)).first()
    item = R.predict_item_based(cell, ratings, R.item_similarities(ratings, 0.0)).first()
    assert user.prediction == pytest.approx(4.174250, abs=1e-6)
    assert item.prediction == pytest.approx(5.0)
    clipped = R.predict_user_based(cell, ratings, R.user_similarities(ratings, 0.1), clip=(1.0, 4.0))
    assert clipped.first().prediction == 4.0


@pytest.fixture(scope="module")
def sparse(spark):
    rng = random.Random(3)
    rows = [
        (u, i, float(rng.randint(1, 5)))
        for u in range(1, 41)
        for i in range(1, 31)
        if i <= 2 or rng.random() < 0.25  # items 1 and 2 are rated by everybody
    ]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double")


@pytest.mark.parametrize("by", [R.user_similarities, R.item_similarities])
def test_blocks_equal_the_join(sparse, by):
    plain = edges(by(sparse, heavy=10**6))
    for heavy in (0, 12):
        mixed = edges(by(sparse, heavy=heavy, block=7, chunk=3))
        assert mixed == pytest.approx(plain)


def test_predictions_equal_a_loop(spark, sparse):
    sims = edges(R.user_similarities(sparse, 0.1))
    near = {}
    for (a, b), s in sims.items():
        near.setdefault(a, []).append((s, b))
        near.setdefault(b, []).append((s, a))
    cells = {(r.user_id, r.item_id): r.rating for r in sparse.collect()}
    means = {u: sum(v for (x, _), v in cells.items() if x == u) / sum(x == u for x, _ in cells) for u in range(1, 41)}

    def predict(u, i, k):
        best = sorted(((s, v) for s, v in near.get(u, []) if (v, i) in cells), reverse=True)[:k]
        den = sum(abs(s) for s, _ in best)
        return means[u] + (sum(s * (cells[v, i] - means[v]) for s, v in best) / den if den else 0)

    similar = R.user_similarities(sparse, 0.1)
    got = {(r.user_id, r.item_id): r.prediction for r in R.predict_user_based(sparse, sparse, similar, k=3).collect()}
    assert got == pytest.approx({c: predict(*c, 3) for c in cells})

    want = {}
    for u in range(1, 41):
        unseen = [(round(predict(u, i, 3), 6), i) for i in range(1, 31) if (u, i) not in cells]
        want[u] = [i for _, i in sorted(unseen, reverse=True)]
    for top in (4, None):
        rows = R.recommend_user_based(sparse, similar, top=top, k=3, decimals=6).orderBy("user_id", "rank").collect()
        lists = {}
        for r in rows:
            lists.setdefault(r.user_id, []).append(r.item_id)
        assert lists == {u: (w if top is None else w[:top]) for u, w in want.items()}


def test_unreached_items_have_the_mean(spark):
    rows = [(1, 1, 5.0), (1, 2, 1.0), (2, 3, 2.0), (2, 4, 4.0), (2, 5, 3.0)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    out = R.recommend_user_based(ratings, R.user_similarities(ratings, 0.1), top=2).orderBy("user_id", "rank")
    assert [(r.user_id, r.item_id, r.prediction) for r in out.collect()] == [(1, 5, 3.0), (1, 4, 3.0), (2, 2, 3.0), (2, 1, 3.0)]
    asked = spark.createDataFrame([(1,)], "user_id long")
    assert R.recommend_item_based(ratings, R.item_similarities(ratings, 0.0), users=asked).count() == 3


def test_similarity_lists_rank_ties_by_larger_id(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.9)], "a long, b long, sim double")
    rows = R.similarity_lists(e).where("one = 1").orderBy("rank").collect()
    assert [r.other for r in rows] == [3, 2]


def test_matrix_edits(spark, ratings):
    new = spark.createDataFrame([(1, 1, 2.0, 1), (1, 1, 3.0, 2), (7, 1, 4.0, 1)], "user_id long, item_id long, rating double, seq int")
    out = {(r.user_id, r.item_id): r.rating for r in R.set_ratings(ratings, new).collect()}
    assert out[(1, 1)] == 3.0 and out[(7, 1)] == 4.0 and len(out) == 20
    assert R.remove_ratings(ratings, new).count() == 18
    incoming = spark.createDataFrame([(50, 1, 1.0), (50, 2, 2.0), (60, 1, 3.0)], "profile_id long, item_id long, rating double")
    added = R.add_profiles(ratings, incoming)
    assert {r.user_id for r in added.collect()} == {1, 2, 3, 4, 5, 6, 7}
    kept, gone = R.remove_profiles(ratings, spark.createDataFrame([(2,)], "user_id long"))
    assert (kept.count(), gone.count()) == (15, 4)
    assert R.user_profile(ratings, 1).count() == 3 and R.item_profile(ratings, 4).count() == 4


def test_single_rating_has_no_deviation(spark):
    one = spark.createDataFrame([(1, 1, 4.0)], "user_id long, item_id long, rating double")
    assert tuple(R.matrix_stats(one).first()) == (1, 1, 1, 4.0, 0.0)
    assert R.profile_stats(one).first().deviation == 0.0


@pytest.mark.parametrize("how", [{}, {"heavy": 12}])
def test_blocks_of_predictions_equal_each_other(sparse, how):
    for by, name in ((R.user_similarities, "user"), (R.item_similarities, "item")):
        similar = stored(by(sparse, 0.0))
        predict = getattr(R, f"predict_{name}_based")
        whole = {(r.user_id, r.item_id): r.prediction for r in predict(sparse, sparse, similar, k=3, heavy=10**6).collect()}
        parts = {(r.user_id, r.item_id): r.prediction for r in predict(sparse, sparse, similar, k=3, links=50, **how).collect()}
        assert parts == pytest.approx(whole) and len(whole) == sparse.count()


@pytest.mark.parametrize("how", [{}, {"heavy": 12}])
def test_waves_of_items_give_the_list_of_all(sparse, how):
    for by, name in ((R.user_similarities, "user"), (R.item_similarities, "item")):
        similar = stored(by(sparse, 0.0))
        recommend = getattr(R, f"recommend_{name}_based")
        every = recommend(sparse, similar, top=None, k=3, decimals=6).where("rank <= 4").collect()
        waves = recommend(sparse, similar, top=4, k=3, decimals=6, block=(9, 3), **how).collect()
        assert sorted(map(tuple, waves)) == sorted(map(tuple, every))


def test_numbers_of_ids(spark):
    from siftrank.operators.positions import number_ids

    ids = [hash((n, "id")) for n in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:500]], "id long").repartition(7)
    got = {r.id: r.position for r in number_ids(df, "id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids), 1)}
    back = {r.id: r.n for r in number_ids(df, "id", "n", descending=True).collect()}
    assert back == {i: n for n, i in enumerate(sorted(ids, reverse=True), 1)}


@pytest.mark.parametrize("how", [{}, {"heavy": 0, "block": 7, "chunk": 3}, {"heavy": 12, "block": 7, "chunk": 3}])
def test_similarities_of_targets_to_all(sparse, how):
    for by, to, who in (
        (R.user_similarities, R.user_similarities_to, "user_id"), (R.item_similarities, R.item_similarities_to, "item_id"),
    ):
        pairs = edges(by(sparse))
        ids = {r[0] for r in sparse.select(who).distinct().collect()}
        asked = sparse.where(F.col(who) % 4 == 0).select(who)
        got = {(r.one, r.other): r.sim for r in to(asked, sparse, **how).collect()}
        assert set(got) == {(a, b) for a in ids if a % 4 == 0 for b in ids if a != b}
        assert got == pytest.approx({c: pairs.get((min(c), max(c)), -1.0) for c in got})


def test_ranks_of_whole_lists(spark):
    rng = random.Random(9)
    rows = [(one, other, rng.choice([0.1, 0.5, -1.0])) for one in range(6) for other in range(one * 40)]
    got = R.ranked_lists(spark.createDataFrame(rows, "one long, other long, sim double").repartition(9)).collect()
    for one in range(6):
        want = sorted(((s, o) for x, o, s in rows if x == one), reverse=True)
        assert [(r.sim, r.other) for r in sorted(got, key=lambda r: r.rank) if r.one == one] == want
        assert sorted(r.rank for r in got if r.one == one) == list(range(1, len(want) + 1))


@pytest.mark.parametrize("by", [R.user_similarities, R.item_similarities])
@pytest.mark.parametrize("heavy", [0, 12, 10**6])
def test_hot_ids_equal_packed_ones(sparse, by, heavy):
    plain = edges(by(sparse, heavy=10**6, pairs=10**6))
    assert edges(by(sparse, heavy=heavy, block=7, chunk=3, pairs=5)) == pytest.approx(plain)


def test_pairs_are_shuffled_packed(spark):
    """A pair used to be a row of two ids and three sums, written before it was added up."""
    rng = random.Random(8)
    cells = [(u, i, float(rng.randint(1, 5))) for u in range(60) for i in range(80)]
    df = spark.createDataFrame([*cells, (None, 3, 1.0), (3, None, 2.0)], "user_id long, item_id long, rating double")
    plan = R.item_similarities(df)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanged if "sq_a" in line or "hashpartitioning(a#" in line and "b#" in line.split("),")[0]]
    assert len(edges(R.item_similarities(df))) == 80 * 79 // 2


def test_long_and_short_lists_rank_alike(spark):
    rng = random.Random(4)
    rows = [(a, b, rng.randint(-3, 3) / 3) for a in range(9) for b in range(3 * a + 1)]
    df = spark.createDataFrame(rows, "one long, other long, sim double")
    want = {}
    for a in range(9):
        for place, (_, b) in enumerate(sorted(((s, b) for x, b, s in rows if x == a), reverse=True), 1):
            want[a, b] = place
    for longest in (0, 10, 10**6):
        assert {(r.one, r.other): r["rank"] for r in R.ranked_lists(df, longest=longest).collect()} == want


def test_filled_lists_rank_as_filled_rows(spark):
    rng = random.Random(6)
    ids, asked = list(range(0, 90, 3)), [0, 9, 33, 87]
    known = {(a, b): rng.choice([0.5, 0.2, -0.3, -1.0, -1.5]) for a in asked[:3] for b in ids if a != b and rng.random() < 0.4}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in known.items()], "one long, other long, sim double")
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "id long")
    want = []
    for a in asked:
        rows = sorted(((known.get((a, b), -1.0), b) for b in ids if b != a), reverse=True)
        want += [(a, b, s, n) for n, (s, b) in enumerate(rows, 1)]
    got = R.ranked_lists(df, targets=frame([*asked, None]), others=frame([*ids, *ids, None]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    got = R.filled_lists(df, frame(asked), frame(ids), stretch=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lists_to_all_make_rows_without_ordering_them(spark, sparse):
    """Every filled row used to be shuffled to be put in order."""
    ids = [sparse.select(F.col("user_id").alias("id"))] * 2
    known = R.user_similarities_to(sparse.select("user_id"), sparse, fill=None)
    plan = R.ranked_lists(known, targets=ids[0], others=ids[1])._jdf.queryExecution().executedPlan().toString()
    top = plan.split("+- Generate posexplode")[0]
    assert "Union" in top and "Window" not in top and "rangepartitioning" not in plan


@pytest.fixture(scope="module")
def crowd(spark):
    """Two groups that share no items, one of much larger ids, a user who rates all alike and one without links."""
    rng = random.Random(12)
    rows = [
        (1000 * g + u, 5000 * g + i, float(rng.randint(1, 5)))
        for g in range(2) for u in range(30) for i in range(60) if rng.random() < 0.12
    ]
    rows += [(500, i, 3.0) for i in range(5)] + [(501, 777, 4.0), (501, 778, 2.0)]
    return stored(spark.createDataFrame(rows, "user_id long, item_id long, rating double"))


@pytest.mark.parametrize("tries, how", [((4, 9), {}), ((200,), {"heavy": 6})])
def test_candidates_give_the_best_of_all(crowd, tries, how):
    for by, name in ((R.user_similarities, "user"), (R.item_similarities, "item")):
        similar = stored(by(crowd, 0.0, decimals=6))
        recommend = getattr(R, f"recommend_{name}_based")
        every = recommend(crowd, similar, top=None, k=3, decimals=6).where("rank <= 4").collect()
        got = recommend(crowd, similar, top=4, k=3, decimals=6, block=(20, 50), tries=tries, small=0, **how).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, every))


@pytest.mark.parametrize("name", ["user", "item"])
def test_whole_lists_need_no_blocks(crowd, name, monkeypatch):
    """Every user used to be paired with every item, so rows and disk grew with their product."""
    from siftrank.operators import neighbourhood

    paired = []
    blocks = neighbourhood._best_by_blocks
    monkeypatch.setattr(neighbourhood, "_best_by_blocks", lambda r, means, *rest: paired.append(means.count()) or blocks(r, means, *rest))
    similar = stored(getattr(R, f"{name}_similarities")(crowd, 0.0, decimals=6))
    got = getattr(R, f"recommend_{name}_based")(crowd, similar, top=4, decimals=6, small=0)
    assert got.count() == 4 * crowd.select("user_id").distinct().count() and paired == []


def pairs_by_hand(rows, who):
    """Similarities of all pairs, cell by cell; what is not known adds nothing."""
    rows = [r for r in rows if r[0] is not None]
    known = lambda u: [r for x, _, r in rows if x == u and r is not None]
    mean = {u: sum(known(u)) / len(known(u)) for u, _, _ in rows if known(u)}
    cells = [((u, i)[who], (u, i)[1 - who], None if r is None else r - mean[u]) for u, i, r in rows]
    sums = {}
    for a, v, x in cells:
        for b, v2, y in cells:
            if v == v2 and a < b:
                total = sums.setdefault((a, b), [0.0, 0.0, 0.0])
                for k, (p, q) in enumerate(((x, y), (x, x), (y, y))):
                    total[k] += 0.0 if p is None or q is None else p * q
    return {pair: d / (p**0.5 * q**0.5) for pair, (d, p, q) in sums.items() if min(abs(d), p, q) >= 1e-9}


@pytest.mark.parametrize("pairs", [500, 10**6])
def test_lists_are_ordered_where_pairs_are_added_up(spark, sparse, pairs):
    """Every pair used to be written, then shuffled twice more to be put in order."""
    odd = sparse.unionByName(spark.createDataFrame([(3, 5, None), (3, 6, 1.0), (-7, 4, 2.0), (-7, 5, 3.0), (None, 5, 1.0)], sparse.schema))
    for who, by in enumerate((R.user_similarities, R.item_similarities)):
        lists = R.similarity_lists(by(odd, decimals=6, lists=True, pairs=pairs))
        plan = lists._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning(one" not in plan
        hand = pairs_by_hand([tuple(r) for r in odd.collect()], who)
        assert edges(by(odd, pairs=pairs)) == pytest.approx(hand)
        want = R.similarity_lists(stored(by(odd, decimals=6))).collect()
        assert len(want) == 2 * len(hand) and sorted(map(tuple, lists.collect())) == sorted(map(tuple, want))
        assert R.similarity_lists(lists, 3).count() == sum(r["rank"] <= 3 for r in want)
        crowded = [R.similarity_lists(by(sparse, decimals=6, heavy=heavy, lists=True)) for heavy in (12, 10**6)]
        assert sorted(map(tuple, crowded[0].collect())) == sorted(map(tuple, crowded[1].collect()))


def test_packed_profiles_come_back():
    import numpy as np

    from siftrank.operators.packed import half_up, pack, unpack

    sizes, ids = np.array([3, 1, 2]), np.array([-5, 0, 70_000, 8, 1, 1 << 40])
    rs, ms = np.array([1.0, 5.0, np.nan, 1.0, 2.0, 1.0]), np.array([0.1, 0.1, 0.1, 2.0, -1e300, 0.3])
    got = unpack(*pack(sizes, ids, rs, ms))
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, (sizes, ids, rs, ms), strict=True))
    sims = np.array([0.123457, -1.0, 0.5, 0.000001, 0.9, 0.7])
    assert np.array_equal(unpack(*pack(sizes, ids, sims))[2], sims) and pack(sizes, ids, sims)[0][5] == 1
    assert half_up(np.array([0.0000005, 0.1234565, -0.1234565, -0.0000001, 0.5]), 6).tolist() == [0.000001, 0.123457, -0.123457, 0.0, 0.5]


def test_written_tables_leave_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, so a query had those of all its steps."""
    import time

    jvm = spark.sparkContext._jvm
    files = lambda: {f for f in map(str, _listed(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if "shuffle_" in f}
    before = files()
    kept = stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 7


def _listed(found):
    return [found.apply(i) for i in range(found.length())]
