"""Partitions follow the size of the input, so that what one task holds does not."""

import math

from pyspark.sql import functions as F

from siftrank.catalog import inputs
from siftrank.functions import models
from siftrank.operators import index as X, recommend, search
from siftrank.operators.analyze import Analyzer
from siftrank.sources import index_store, tables


def _texts(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("red fox hills running "), F.repeat(F.lit("hill "), (F.col("id") % 7).cast("int"))).alias("text")
    )


def _buckets(spark, path):
    return spark.read.parquet(f"{path}/postings-layout").first().buckets


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_buckets_follow_the_text(spark, tmp_path, monkeypatch):
    docs = _texts(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    small = index_store.index_documents(docs, f"{tmp_path}/small")
    assert _buckets(spark, f"{tmp_path}/small") == index_store.default_buckets(spark)
    monkeypatch.setattr(index_store, "BUCKET", 50)
    for stem in (False, True):
        path = f"{tmp_path}/large-{stem}"
        large = index_store.index_documents(docs, path, analyzer=Analyzer(stem=stem))
        assert _buckets(spark, path) == math.ceil(size / 50) > index_store.default_buckets(spark)
        built = X.build_index(docs, analyzer=Analyzer(stem=stem))
        assert _rows(large.postings) == _rows(built.postings) and _rows(large.lexicon) == _rows(built.lexicon)
    assert _rows(small.lengths) == _rows(large.lengths)


def test_buckets_of_a_written_index_follow_its_tokens(spark, tmp_path, monkeypatch):
    built = X.build_index(_texts(spark))
    tokens = built.lengths.agg(F.sum("dl")).first()[0]
    monkeypatch.setattr(index_store, "BUCKET", 30)
    path = f"{tmp_path}/copy"
    stored = index_store.write_index(built, path)
    assert _buckets(spark, path) == math.ceil(tokens * index_store.TOKEN / 30) > index_store.default_buckets(spark)
    assert _rows(stored.postings) == _rows(built.postings) and _rows(stored.lengths) == _rows(built.lengths)


def test_stems_are_summed_after_one_shuffle(spark):
    counts = X.raw_postings(X.token_arrays(_texts(spark)))
    dealt = X.stemmed_postings(counts, 13)
    assert dealt.rdd.getNumPartitions() == 13
    assert _rows(dealt) == _rows(X.stemmed_postings(counts))


def test_defaults_are_looked_up_in_bounded_partitions(spark, tmp_path, monkeypatch):
    docs = _texts(spark)
    stored = index_store.index_documents(docs, f"{tmp_path}/index")
    topics = search.parse_topics(spark.createDataFrame([(1, "red hill"), (2, "fox")], "topic_id long, title string"))
    seen = []
    monkeypatch.setattr(search, "PAIRS", 4)
    monkeypatch.setattr(search, "parts_of", lambda *args: seen.append(args[1:]) or tables.parts_of(*args))
    model = models.risk_adjusted(a=2.0)
    found = {(r.topic_id, r.doc_id): r.score for r in search.score(stored, topics, model).collect()}
    assert seen == [(2 * 40, 4)]
    plain = {(r.topic_id, r.doc_id): r.score for r in search.score(X.build_index(docs), topics, model).collect()}
    assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 1e-6 for k in plain)


def test_parts_follow_the_rows(spark):
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.parts_of(spark, 10) == session
    assert tables.parts_of(spark, 1000 * session, 10) == 100 * session


def test_latest_ratings_in_parts(spark):
    events = spark.createDataFrame(
        [(u, i, float(s), s) for u in (1, 2, None) for i in range(9) for s in (3, 1, 2)], "user_id long, item_id long, rating double, seq long"
    )
    latest = recommend.latest_ratings(events, parts=23)
    assert latest.rdd.getNumPartitions() == 23
    key = lambda r: (r.user_id or 0, r.item_id)
    assert sorted(latest.collect(), key=key) == sorted(recommend.latest_ratings(events).collect(), key=key)
    assert all(r.rating == 3.0 for r in latest.collect())


def test_matrix_stats_does_not_multiply_ratings(spark):
    ratings = spark.createDataFrame([(1, 7, 2.0), (1, 8, 4.0), (2, 7, 3.0), (None, 9, 3.0)], "user_id long, item_id long, rating double")
    stats = recommend.matrix_stats(ratings)
    assert "Expand" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(stats.first())[:4] == (4, 2, 3, 3.0)


def test_judgements_count_before_they_meet_labels(spark, tmp_path):
    spark.createDataFrame([(1, "red fox"), (2, "red hill"), (3, "den")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "red fox hill den"), (6, "den")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made = inputs.judgements(spark, str(tmp_path))
    # a document whose label comes twice counts twice, as rows of matches with labels do
    assert sorted(made.collect(), key=str) == sorted([(5, 1, True), (5, 2, False), (5, 3, True), (6, 3, True), (6, 3, None)], key=str)


def test_vectors_are_multiplied_in_slices(monkeypatch):
    import numpy as np

    from siftrank.operators import rerank

    g = np.random.default_rng(5)
    places, term, tf = (g.integers(0, top, 500).astype(np.int32) for top in (20, 90, 6))
    whole = rerank._Vectors(places, term, tf + 1, 20, 9)
    sizes, multiply = [], np.bincount

    def watched(x, *args, **how):
        sizes.append(len(x))
        return multiply(x, *args, **how)

    expected = [whole.with_all(i) for i in range(20)]
    monkeypatch.setattr(rerank, "SLICE", 64)
    monkeypatch.setattr(rerank.np, "bincount", watched)
    cut = rerank._Vectors(places, term, tf + 1, 20, 9)
    assert all((cut.with_all(i) == expected[i]).all() for i in range(20))
    assert max(sizes) <= 64 and cut.places.itemsize == 4
