import math

import pytest

from siftrank.operators import rerank as R

VECTORS = {1: {"red": 2, "fox": 1, "hill": 1}, 2: {"blue": 1, "fox": 1}, 3: {"red": 3}, 4: {"green": 1, "hill": 2, "fox": 1, "den": 1}}


def pearson(a, b):
    """The definition, term by term over the union."""
    va, vb = VECTORS[a], VECTORS[b]
    ma, mb = sum(va.values()) / len(va), sum(vb.values()) / len(vb)
    up = sa = sb = 0.0
    for t in va.keys() | vb.keys():
        x, y = va.get(t, 0) - ma, vb.get(t, 0) - mb
        up, sa, sb = up + x * y, sa + x * x, sb + y * y
    return up / math.sqrt(sa * sb)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, d, r + 1, s, 0.1 * d) for r, (d, s) in enumerate([(3, 0.9), (1, 0.7), (4, 0.65), (2, 0.2)])]
    return spark.createDataFrame(rows, "topic_id long, doc_id long, rank int, score double, variance double")


def test_correlations(hits, index):
    got = {(r.a, r.b): r.corr for r in R.correlations(hits, index).collect()}
    assert got == pytest.approx({p: pearson(*p) for p in [(3, 1), (1, 4), (1, 2), (4, 2)]})
    fixture = {(1, 2): -0.150756, (3, 1): 0.577350, (1, 4): -0.106676, (4, 2): -0.094916}
    assert got == pytest.approx(fixture, abs=1e-6)


def literal(objective, c, n_steps=19):
    """The published procedure on plain lists."""
    docs = [(3, 0.9), (1, 0.7), (4, 0.65), (2, 0.2)]
    given, score = dict(docs), dict(docs)
    var = {d: 0.1 * d for d, _ in docs}
    shared = lambda a, b: bool(VECTORS[a].keys() & VECTORS[b].keys())
    corr = lambda a, b: pearson(a, b) if shared(a, b) else 0.0
    order = [d for d, _ in docs]
    for step in range(min(n_steps, len(order) - 1)):
        frozen, rest = order[: step + 1], order[step + 1 :]
        for d in frozen:
            score[d] += 100
        for i in rest:
            if objective == "correlation":
                score[i] -= c / math.log2(step + 2) * corr(frozen[-1], i)
            elif objective == "ap":
                score[i] = given[i] / (step + 2) + sum(corr(s, i) * 0.01 for s in frozen) / (step + 2)
            else:
                miss = cov = 1.0
                for s in frozen:
                    miss *= 1 - given[s]
                    cov *= corr(s, i) * math.sqrt(var[s] * var[i])
                score[i] = miss * given[i] / (step + 2) - cov / (step + 2)
        order.sort(key=lambda d: (-score[d], d))
    return order


@pytest.mark.parametrize("objective, c", [("correlation", 1.0), ("correlation", 0.0), ("correlation", 3.0), ("ap", 1.0), ("rr", 1.0)])
def test_greedy_equals_the_procedure(hits, index, objective, c):
    out = R.greedy(hits, R.correlations(hits, index), c, objective).orderBy("rank").collect()
    assert [r.doc_id for r in out] == literal(objective, c)


def test_meanvar_weight(hits, index):
    corr = R.correlations(hits, index)
    a = R.mean_variance_greedy(hits, corr, 300.0).orderBy("rank").collect()
    assert [r.doc_id for r in a] == literal("correlation", 3.0)


def test_ndcg_objective(hits):
    value = {d: 2**s * (1 + 0.1 * d * math.log(2) ** 2) for d, s in [(1, 0.7), (4, 0.65), (2, 0.2)]}
    want = [3, *sorted(value, key=lambda d: -value[d])]
    assert [r.doc_id for r in R.ndcg_order(hits).orderBy("rank").collect()] == want


def test_one_hit_stays(spark, hits, index):
    only = hits.where("doc_id = 3")
    assert R.greedy(only, R.correlations(only, index)).count() == 1


@pytest.mark.parametrize("objective, c", [("correlation", 1.0), ("correlation", 3.0), ("ap", 1.0), ("rr", 1.0)])
def test_whole_lists_from_vectors(hits, index, objective, c):
    out = R.greedy_over(hits, index, c, objective).orderBy("rank").collect()
    assert [r.doc_id for r in out] == literal(objective, c)


def test_correlations_over_chunks_of_terms(hits, index, monkeypatch):
    monkeypatch.setattr(R, "COLUMNS", 2)
    monkeypatch.setattr(R, "PAIRS", 2)
    whole = {(r.a, r.b): r.corr for r in R.correlations(hits, index).collect()}
    assert {(r.a, r.b): r.corr for r in R.correlations(hits, index, chunk=1).collect()} == pytest.approx(whole)


def test_whole_lists_equal_the_matrix(spark):
    """Long lists of several topics: rows of fixed documents against the matrix of all pairs."""
    import random

    from siftrank.operators.index import build_index

    rng = random.Random(4)
    texts = [(d, " ".join(rng.choice(["a", "b", "c", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 40)))) for d in range(90)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = [(t, d, r + 1, 1 - r / 100, rng.random()) for t in range(3) for r, d in enumerate(rng.sample(range(90), 70))]
    hits = spark.createDataFrame(rows, "topic_id long, doc_id long, rank int, score double, variance double")
    corr = R.correlations(hits, index)
    plain = {(r.topic_id, r.a, r.b): r["corr"] for r in corr.collect()}
    assert {(r.topic_id, r.a, r.b): r["corr"] for r in R.correlations(hits, index, chunk=5).collect()} == pytest.approx(plain)
    for objective in ("correlation", "ap", "rr"):
        a = {(r.topic_id, r.doc_id): r["rank"] for r in R.greedy(hits, corr, 0.7, objective).collect()}
        b = {(r.topic_id, r.doc_id): r["rank"] for r in R.greedy_over(hits, index, 0.7, objective).collect()}
        assert a == b


def test_products_of_often_and_rare_terms(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(R, "COLUMNS", 2)
    monkeypatch.setattr(R, "PAIRS", 3)
    rng = random.Random(6)
    rows = sorted({(rng.choice([0, 1, 2, rng.randint(3, 40)]), rng.randrange(30)) for _ in range(260)})
    term, at = (np.array(x) for x in zip(*rows))
    tf = np.array([float(rng.randint(1, 4)) for _ in rows])
    whole = np.zeros((30, 41))
    whole[at, term] = tf
    shared, dot = R._products(at, term, tf, 30)
    up = np.triu_indices(30, 1)
    assert (dot[up] == (whole @ whole.T)[up]).all() and (shared[up] == ((whole > 0) * 1.0 @ (whole > 0).T)[up]).all()


def test_evaluation_by_objectives_and_of_few_topics(spark, index):
    from siftrank.functions import models
    from siftrank.operators.search import parse_topics
    from siftrank.plans.retrieval import evaluate_model

    topics = parse_topics(spark.createDataFrame([(1, "red fox"), (2, "hill den"), (3, "blue")], "topic_id long, title string"))
    judged = spark.createDataFrame([(1, 1, True), (2, 4, True), (3, 2, True)], "topic_id long, doc_id long, relevant boolean")
    for objective in (None, "correlation", "meanvar", "ap", "rr", "ndcg"):
        made = evaluate_model(index, topics, judged, models.risk_adjusted(a=2.0), objective=objective, max_topics=2)
        assert sorted(r.topic_id for r in made.run.select("topic_id").distinct().collect()) == [1, 2]
        assert made.per_topic.count() == 2 and made.summary.count() == 1
