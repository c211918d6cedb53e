import math

import pytest
from pyspark.sql import functions as F

from siftrank.operators import evaluate as E


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(1, d, d, d in (2, 3, 7)) for d in range(1, 11)]
    rows += [(2, d, d, d == 6) for d in range(1, 10)]  # nine results, first hit at 6
    rows += [(3, d, d, False) for d in range(1, 5)]  # nothing judged relevant
    return spark.createDataFrame(rows, "topic_id long, doc_id long, rank int, relevant boolean")


@pytest.fixture(scope="module")
def judgements(spark):
    rows = [(1, d, True) for d in (2, 3, 7, 99)] + [(2, 6, True), (3, 1, False)]
    return spark.createDataFrame(rows, "topic_id long, doc_id long, relevant boolean")


def test_hand_computed_metrics(judged, judgements):
    m = E.metrics(judged, judgements, precisions=(5, 10, 20)).where("topic_id = 1").first()
    assert (m.p_5, m.p_10, m.p_20, m.recall, m.rr) == (0.4, 0.3, 0.15, 0.75, 0.5)
    assert m.ap == pytest.approx(0.398810, abs=1e-6)
    assert m.ndcg_1 == 0
    assert m.ndcg_5 == pytest.approx(0.383566, abs=1e-6)
    assert m.ndcg_10 == pytest.approx(0.322272, abs=1e-6)
    assert [m[f"call_{k}"] for k in range(1, 5)] == [1, 1, 1, 0]


def test_short_lists_and_late_hits(judged, judgements):
    m = E.metrics(judged, judgements).where("topic_id = 2").first()
    assert m.rr == 0 and m.call_1 == 0 and m.ndcg_10 == 0
    assert m.p_20 == pytest.approx(1 / 20)


def test_topics_without_relevant_documents(judged, judgements):
    m = E.metrics(judged, judgements)
    assert m.where("topic_id = 3").first().recall == 0
    avg = E.average(m).first()
    assert avg.topics == 2 and avg.recall == pytest.approx((0.75 + 1.0) / 2)


def test_all_relevant_list_has_gain_one(spark):
    df = spark.createDataFrame([(1, d, d, True) for d in range(1, 21)], "topic_id long, doc_id long, rank int, relevant boolean")
    row = E.ndcg(df, (1, 5, 20)).first()
    assert (row.ndcg_1, row.ndcg_5, row.ndcg_20) == pytest.approx((1, 1, 1))


def test_string_ids_match_without_case(spark):
    run = spark.createDataFrame([("1", "ap-1 ", 1)], "topic_id string, doc_id string, rank int")
    q = spark.createDataFrame([("1", "AP-1", True)], "topic_id string, doc_id string, relevant boolean")
    assert E.judge(run, q).first().relevant


def test_consistency_report(spark):
    topics = spark.createDataFrame([(1,), (2,)], "topic_id long")
    q = spark.createDataFrame([(1, 5, True), (2, 5, False), (9, 5, True)], "topic_id long, doc_id long, relevant boolean")
    assert {(r.topic_id, r.reason.split()[0]) for r in E.check_consistency(topics, q).collect()} == {(2, "topic"), (9, "judged")}


def test_running_counts_cross_stretches(spark):
    from siftrank.operators.positions import with_running_count

    rows = [(k, p) for k in (1, 2) for p in range(k, 40, 3)]
    df = spark.createDataFrame(rows, "k long, p long")
    got = {(r.k, r.p): r.running for r in with_running_count(df, ["k"], "p", width=4).collect()}
    want = {(k, p): i + 1 for k in (1, 2) for i, p in enumerate(range(k, 40, 3))}
    assert got == want


def test_report_stops_at_the_end_of_the_list(judged, judgements):
    long = E.report_long(E.metrics(judged, judgements))
    shown = {r.metric for r in long.where("topic_id = 3").collect()}
    assert "p_3" in shown and "p_4" not in shown
    wide = E.report_wide(long, ["ap", "p_5"]).where("topic_id = 1").first()
    assert (wide.ap, wide.p_5) == (0.399, 0.4)


def test_overlap(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 1, 1)], "topic_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "topic_id long, doc_id long, rank int")
    assert [tuple(r) for r in E.overlap(a, b).collect()] == [(1, 3, 2, 1, 1)]
    assert E.shared_topics(a, b).first()[0] == 1


def test_normal_fit(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0)], "g long, v double")
    assert tuple(E.fit_normal(df, "v", ["g"]).first()) == (1, 2.0, 1.0)


def test_sweep_equals_single_runs(spark, index, query):
    from siftrank.functions import models as M
    from siftrank.operators import search as S
    from siftrank.plans import retrieval as P

    assert P.grid(0.0, 0.1, 0.3) == pytest.approx([0.0, 0.1, 0.2, 0.3])
    both = P.sweep_run(index, query, lambda l: M.risk_adjusted(l, 0.1), [0.5, 2.0])
    for a in (0.5, 2.0):
        one = {r.doc_id: r.score for r in S.search(index, query, M.risk_adjusted(a)).collect()}
        got = {r.doc_id: r.score for r in both.where(F.col("param") == a).collect()}
        assert got == pytest.approx(one)


def test_evaluate_end_to_end(spark, index, query):
    from siftrank.functions import models as M
    from siftrank.plans import retrieval as P

    q = spark.createDataFrame([(1, 1, True), (1, 4, True)], "topic_id long, doc_id long, relevant boolean")
    out = P.evaluate_model(index, query, q, M.tf_idf(), k=10)
    assert out.run.count() == 4
    row = out.summary.first()
    assert row.map == pytest.approx((1 / 2 + 2 / 4) / 2) and row.rr == 0.5
    again = P.evaluate_model(index, query, q, M.tf_idf(), k=10, rerank_weight=0.0)
    assert [r.doc_id for r in again.run.orderBy("rank").collect()] == [3, 1, 2, 4]
