import re

import pytest
from pyspark.sql import functions as F

from siftrank.functions import models as M
from siftrank.operators import index as X
from siftrank.operators import search as S

EXPECTED = {
    "tf_idf": (M.tf_idf(), [(3, 1.0), (1, 0.603759), (2, 0.207519), (4, 0.083007)]),
    "bm25": (M.bm25(), [(3, 0.0), (4, -1.079978), (1, -1.170923), (2, -1.408072)]),
    "dirichlet": (M.dirichlet(), [(3, -2.567691), (1, -2.567808), (2, -2.569405), (4, -2.575384)]),
    "jelinek_mercer": (M.jelinek_mercer(), [(1, -2.122818), (3, -3.909475), (2, -4.084192), (4, -4.934525)]),
    "vector_space": (M.vector_space(), [(1, 0.866025), (3, 0.707107), (2, 0.5), (4, 0.267261)]),
    "risk_adjusted": (M.risk_adjusted(2.0), [(1, -5.140251), (4, -13.169719), (3, -15.290642), (2, -15.865561)]),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_models(index, query, name):
    model, want = EXPECTED[name]
    hits = S.search(index, query, model, k=10).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == [d for d, _ in want]
    assert [h.score for h in hits] == pytest.approx([s for _, s in want], abs=2e-6)


def test_mean_and_variance(index, query):
    rows = S.mean_variance_search(index, query, M.risk_adjusted(2.0)).collect()
    got = {r.doc_id: (r.mean, r.variance) for r in rows}
    assert got[1] == pytest.approx((-1.436216, 1.724373), abs=2e-6)
    assert got[3] == pytest.approx((-4.738540, 14.841421), abs=2e-6)


def test_plain_variant_is_floored(index, query):
    rows = S.score(index, query, M.risk_adjusted_plain(a=100.0)).collect()
    assert all(r.score < -700 for r in rows)


@pytest.mark.parametrize("model", [M.bm25(), M.dirichlet(), M.jelinek_mercer(), M.risk_adjusted(1.0)], ids=lambda m: m.name)
def test_short_cuts_equal_the_literal_default_fill(spark, index, model):
    terms = spark.createDataFrame(
        [(1, "red", 2), (1, "hill", 1), (2, "den", 1), (2, "fox", 1), (2, "unknown", 3)],
        "topic_id long, term string, qtf long",
    )
    fast = {(r.topic_id, r.doc_id): r.score for r in S.score(index, terms, model).collect()}
    slow = {(r.topic_id, r.doc_id): r.score for r in S.score_by_filling(index, terms, model).collect()}
    assert fast.keys() == slow.keys()
    assert fast == pytest.approx(slow, abs=1e-9)


@pytest.mark.parametrize("model", [M.risk_adjusted(2.0), M.risk_adjusted_plain(0.0), M.risk_adjusted_plain(0.5)], ids=["logit", "plain", "penalised"])
def test_documents_without_a_term_have_no_default(spark, corpus, model):
    """Their length, 0, used to get a default like any other, which divided by it."""
    from siftrank.session import scratch_path
    from siftrank.sources.index_store import index_documents

    odd = corpus.unionByName(spark.createDataFrame([(5, "12 - 3"), (6, "")], corpus.schema))
    index = index_documents(odd, scratch_path(spark, "odd"), buckets=2)
    terms = spark.createDataFrame([(1, "red", 2), (1, "fox", 1)], "topic_id long, term string, qtf long")
    got = {r.doc_id: r.score for r in S.score(index, terms, model).collect()}
    slow = {r.doc_id: r.score for r in S.score_by_filling(index, terms, model).collect()}
    assert got.keys() == {1, 2, 3, 4} and got == pytest.approx(slow, abs=1e-9)
    assert S.search(index, terms, model, k=2).count() == 2


def test_unknown_terms_add_nothing(spark, index, query):
    more = query.unionByName(spark.createDataFrame([(1, "zebra", 5)], query.schema))
    a = {r.doc_id: r.score for r in S.score(index, query, M.dirichlet()).collect()}
    b = {r.doc_id: r.score for r in S.score(index, more, M.dirichlet()).collect()}
    assert a == pytest.approx(b)


def test_ties_go_to_the_lower_document(spark):
    scored = spark.createDataFrame([(1, d, 1.0) for d in (9, 3, 7)], "topic_id long, doc_id long, score double")
    assert [r.doc_id for r in S.top_k(scored, 2).orderBy("rank").collect()] == [3, 7]


def test_filter_applies_to_candidates(spark, index, query):
    allowed = spark.createDataFrame([(1,), (4,)], "doc_id long")
    hits = S.search(index, query, M.tf_idf(), allowed=allowed)
    assert {r.doc_id for r in hits.collect()} == {1, 4}


def test_boolean_rules(spark, index):
    clauses = spark.createDataFrame(
        [(1, "fox", "must"), (1, "red", "must_not"), (1, "hill", "should"),
         (2, "red", "should"), (2, "den", "should"), (3, "fox", "must"), (3, "absent", "must")],
        "topic_id long, term string, occur string",
    )
    got = {(r.topic_id, r.doc_id) for r in S.boolean_candidates(index, clauses).collect()}
    assert got == {(1, 2), (1, 4), (2, 1), (2, 3), (2, 4)}


def test_sort_by_fields(spark, corpus):
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.0), (1, 3, 0.5), (1, 4, 0.1)], "topic_id long, doc_id long, score double")
    docs = corpus.withColumn("size", F.length("text"))
    rows = S.top_k_by_fields(scored, docs, [("score", True), ("size", False)]).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [3, 1, 4]


def test_per_term_search_divides_by_query_length(index, query):
    whole = {r.doc_id: r.score for r in S.score(index, query, M.bm25()).collect()}
    part = {r.doc_id: r.score for r in S.per_term_search(index, query, M.bm25()).collect()}
    assert part == pytest.approx({d: s / 2 for d, s in whole.items()})


def test_statistics_add_up(index):
    stats = index.stats.first()
    assert (stats.n_docs, stats.cl, stats.avg_dl) == (4, 14.0, 3.5)
    assert index.postings.agg(F.sum("tf")).first()[0] == stats.cl
    assert index.lengths.agg(F.sum("dl")).first()[0] == stats.cl


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_merged_parts_equal_the_whole(corpus, index):
    from siftrank.operators.analyze import Analyzer

    chain = Analyzer(tokenizer="whitespace")
    parts = [X.build_index(corpus.where(c), analyzer=chain) for c in ("doc_id <= 2", "doc_id > 2")]
    merged = X.merge_indexes(parts)
    for field in ("postings", "lexicon", "lengths", "stats"):
        assert _rows(getattr(merged, field)) == _rows(getattr(index, field))


def test_update_replaces_documents(spark, index):
    from siftrank.operators.analyze import Analyzer

    fresh = spark.createDataFrame([(9, "blue moon")], "doc_id long, text string")
    out = X.update_documents(index, ["blue"], X.build_index(fresh, analyzer=Analyzer("whitespace")))
    assert {r.doc_id for r in out.lengths.collect()} == {1, 3, 4, 9}
    assert out.stats.first().n_docs == 4


def test_stored_index_keeps_empty_documents_and_random_postings(spark):
    import random

    from siftrank.session import scratch_path
    from siftrank.sources import index_store

    rng = random.Random(7)
    docs = [(d, " ".join(rng.choices("abcdefg", k=rng.randrange(0, 12)))) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    stored = index_store.index_documents(df, scratch_path(spark, "t"))
    built = X.build_index(df)
    for field in ("postings", "lexicon", "lengths", "stats"):
        assert _rows(getattr(stored, field)) == _rows(getattr(built, field))
    path = scratch_path(spark, "t")
    index_store.write_index(stored, path, buckets=3)
    again = index_store.read_index(spark, path)
    assert _rows(again.postings) == _rows(built.postings)
    term = "c"
    assert index_store.fetch_posting(stored, term).count() == sum("c" in t for _, t in docs)
    assert index_store.fetch_length(stored, 5).first().dl == len(docs[5][1].split())
    assert {r.key: r.value for r in index_store.read_meta(stored).collect()}["NumberOfDocuments"] == 60


def test_posting_blocks_split_common_terms(spark):
    docs = spark.createDataFrame([(d, "x") for d in range(200)], "doc_id long, text string")
    blocks = X.posting_blocks(X.build_index(docs), block_size=50).collect()
    assert len(blocks) == 4 and all(b.df == 200 for b in blocks)
    assert sorted(d for b in blocks for d in b.observations) == list(range(200))


def test_families_must_hold_the_same_documents(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, f string")
    b = spark.createDataFrame([(1, "z", 5), (2, "w", 6)], "doc_id long, f string, g long")
    assert _rows(X.join_families([a, b])) == [(1, "x", 5), (2, "y", 6)]
    with pytest.raises(Exception, match="different documents"):
        X.join_families([a, b.where("doc_id = 1")]).collect()


def test_matches_are_not_shuffled(spark, corpus):
    from siftrank.session import scratch_path
    from siftrank.sources import index_store

    stored = index_store.index_documents(corpus, scratch_path(spark, "t"), buckets=4)
    terms = spark.createDataFrame([(1, "fox", 1)], "topic_id long, term string, qtf long")
    terms = S.prepare(stored, terms)
    plan = S.score(stored, terms, M.bm25())._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(topic_id" not in plan
    assert "Bucketed: true" in plan


def test_lookup_prunes_at_the_scan(spark, corpus):
    from siftrank.session import scratch_path
    from siftrank.sources import index_store

    stored = index_store.index_documents(corpus, scratch_path(spark, "t"))
    plan = index_store.fetch_posting(stored, "fox")._jdf.queryExecution().toString()
    assert "EqualTo(term,fox)" in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, corpus):
    from siftrank.operators.analyze import Analyzer
    from siftrank.session import scratch_path
    from siftrank.sources import index_store

    return index_store.index_documents(corpus, scratch_path(spark, "t"), analyzer=Analyzer("whitespace"), buckets=4)


@pytest.mark.parametrize("model", [M.vector_space(), M.risk_adjusted(2.0), M.risk_adjusted_plain(1.0)], ids=lambda m: m.name)
def test_postings_are_read_once(index, stored, query, model):
    terms = query if model.cosine else S.prepare(stored, query)
    scored = S.score(stored, terms, model)
    files = [line for line in _plan(scored).splitlines() if "FileScan" in line and "postings_" in line]
    assert len(files) == 1
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({r.doc_id: r.score for r in S.score(index, query, model).collect()})


def test_stored_norms(spark, stored):
    from siftrank.session import scratch_path
    from siftrank.sources import index_store

    want = {(1, 6), (2, 2), (3, 9), (4, 7)}
    assert {(r.doc_id, r.norm2) for r in stored.stored.collect()} == want
    path = scratch_path(spark, "t")
    index_store.write_index(stored, path, buckets=2)
    assert _rows(index_store.read_index(spark, path).stored) == _rows(stored.stored)


@pytest.mark.parametrize(
    "model", [lambda b: M.bm25(b=b), lambda x: M.jelinek_mercer(0.1 + x / 2), lambda x: M.risk_adjusted(x)], ids=["bm25", "jm", "risk"]
)
def test_a_sweep_matches_once_and_equals_single_searches(stored, query, model, monkeypatch):
    from siftrank.plans import retrieval as P

    terms, grid = S.prepare(stored, query), P.grid(0.0, 0.25, 1.0)
    swept = P.sweep_run(stored, terms, model, grid, k=3)
    want = {(v, r.doc_id, r.rank): r.score for v in grid for r in S.search(stored, terms, model(v), k=3).collect()}
    plan = _plan(swept)
    assert sum("FileScan" in line and "postings_" in line for line in plan.splitlines()) == 1
    assert plan.index("inline") < plan.index("HashAggregate")  # values become rows after the sums
    monkeypatch.setattr(P, "PER_PASS", 2)
    for run in (swept, P.sweep_run(stored, terms, model, grid, k=3)):
        assert {(r.param, r.doc_id, r.rank): r.score for r in run.collect()} == pytest.approx(want)


def test_grids_take_one_model(stored, query):
    with pytest.raises(ValueError, match="one additive model"):
        S.score_grid(stored, query, [M.bm25(), M.dirichlet()])
    with pytest.raises(ValueError, match="one additive model"):
        S.score_grid(stored, query, [M.vector_space()])


def test_a_search_opens_only_the_shards_of_its_terms(spark, stored, index, query):
    from siftrank.session import scratch_path
    from siftrank.sources import index_store

    path = scratch_path(spark, "t")
    index_store.write_index(index, path, buckets=4, shards=64)
    again = index_store.read_index(spark, path)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("postings_")]
    for each in (stored, again):
        scored = S.score(each, S.prepare(each, query), M.bm25())
        assert "dynamicpruning" in _plan(scored)
        assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({r.doc_id: r.score for r in S.score(index, query, M.bm25()).collect()})
        ran = _plan(scored)
        assert "Bucketed: true" in ran and "hashpartitioning(topic_id" not in ran
        assert "dynamicpruningexpression(shard" in ran and "SubqueryBroadcast" in ran
    assert re.search(r"PartitionFilters: \[[^\]]*shard", _plan(index_store.fetch_posting(again, "fox")))
    assert _rows(index_store.fetch_posting(again, "fox")) == _rows(index.postings.where("term = 'fox'"))


def test_squeezed_lengths_of_a_stored_index(stored, index, query):
    scores = [{r.doc_id: r.score for r in S.score(X.quantised(i), query, M.bm25()).collect()} for i in (stored, index)]
    assert scores[0] == pytest.approx(scores[1])
