"""Batch retrieval: all topics at once.

Query terms meet the lexicon, then the postings, on ``term``. No side is
broadcast by hint: Spark does so when the query table is under its threshold
and otherwise shuffles, splitting hot terms with the adaptive skew join.
Collection statistics enter as scalar subqueries, so they are computed once
and there is no join for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from siftrank.functions.models import Model, Pair
from siftrank.operators.analyze import Analyzer, analyze
from siftrank.operators.index import Index, shard_of
from siftrank.session import write_and_reload
from siftrank.sources.tables import parts_of

#: Pairs of a topic and a document in a partition, at most, when they look up their defaults.
PAIRS = 2_000_000


def parse_topics(
    topics: DataFrame,
    text: str = "title",
    id: str = "topic_id",
    analyzer: Analyzer = Analyzer(),
) -> DataFrame:
    """(topic_id, term, qtf): each topic as a bag of terms."""
    return (
        analyze(topics, text, id, analyzer)
        .groupBy(F.col("doc_id").alias("topic_id"), "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def known_terms(index: Index, query_terms: DataFrame) -> DataFrame:
    """Query terms found in the collection, with df and ctf. Others score 0."""
    if {"df", "ctf"} <= set(query_terms.columns):
        return query_terms
    return query_terms.join(index.lexicon, "term")


def prepare(index: Index, query_terms: DataFrame) -> DataFrame:
    """Known query terms, written and read back. The planner cannot tell how small
    query terms joined with a large lexicon are; of a stored table it knows the
    size, and broadcasts it to the postings when it is under the threshold.
    Prepared terms can be passed wherever query terms can, and are kept as they are;
    only the cosine, whose query norm counts unknown terms too, wants all terms.
    """
    if {"df", "ctf"} <= set(query_terms.columns):
        return query_terms
    return write_and_reload(known_terms(index, query_terms), "query-terms")


def _stats_columns(index: Index) -> dict[str, Column]:
    return {name: index.stats.select(name).scalar() for name in ("n_docs", "cl", "avg_dl")}


def _restrict(postings: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Only documents of ``allowed`` (a filter on candidates), when one is given."""
    if allowed is None:
        return postings
    return postings.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")


def _hits(index: Index, query_terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Query terms joined with their postings. Of a stored index only the shards of these terms are
    opened: Spark prunes by a side that has a filter, and here every row stands the filter."""
    if index.stored is None:
        return query_terms.join(_restrict(index.postings, allowed), "term")
    side = query_terms.where(F.col("qtf") > 0).withColumn("shard", shard_of(F.col("term"), index.shards))
    return side.join(_restrict(index.stored, allowed), ["term", "shard"]).drop("shard")


def match(index: Index, query_terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row per (topic, document, shared term), with all a model needs."""
    return _hits(index, known_terms(index, query_terms), allowed).withColumns(_stats_columns(index))


def candidates(index: Index, query_terms: DataFrame) -> DataFrame:
    """Documents with any query term."""
    hits = _hits(index, query_terms.select("topic_id", "term", "qtf"))
    return hits.select("topic_id", "doc_id").distinct()


def _pair() -> Pair:
    return Pair(*[F.col(name) for name in Pair._fields])


def term_scores(
    index: Index, query_terms: DataFrame, model: Model, allowed: DataFrame | None = None
) -> DataFrame:
    """(topic_id, doc_id, term, qtf, score) of present terms, before the sum."""
    return match(index, query_terms, allowed).select(
        "topic_id", "doc_id", "term", "qtf", model.present(_pair()).alias("score")
    )


def score(index: Index, query_terms: DataFrame, model: Model, allowed: DataFrame | None = None) -> DataFrame:
    """(topic_id, doc_id, score, *extras) for every candidate."""
    if model.cosine:
        return cosine_scores(index, query_terms, allowed)
    return _scores(index, query_terms, {"score": model}, model.extras, allowed)


def score_grid(
    index: Index, query_terms: DataFrame, models: Sequence[Model], allowed: DataFrame | None = None
) -> DataFrame:
    """(topic_id, doc_id, score_0, score_1, ...): one model at several parameters.

    A match is one row whatever the number of models; each adds a column to the aggregate.
    """
    if len({(m.name, m.absent is None, m.absent_term is None) for m in models}) != 1 or models[0].cosine:
        raise ValueError("a grid takes one additive model at several parameters")
    return _scores(index, query_terms, {f"score_{i}": m for i, m in enumerate(models)}, {}, allowed)


def _scores(
    index: Index, query_terms: DataFrame, models: dict[str, Model], extras: dict, allowed: DataFrame | None
) -> DataFrame:
    query_terms = prepare(index, query_terms)
    kind = next(iter(models.values()))
    if kind.absent is not None:
        values = {name: (model.present, model.absent) for name, model in models.items()}
        return _score_with_pair_defaults(index, query_terms, values | extras, allowed)
    if kind.absent_term is not None:
        return _score_with_split_defaults(index, query_terms, models, allowed)
    p = _pair()
    parts = [(F.col("qtf") * model.present(p)).alias(name) for name, model in models.items()]
    rows = match(index, query_terms, allowed).select("topic_id", "doc_id", *parts)
    return rows.groupBy("topic_id", "doc_id").agg(*[F.sum(name).alias(name) for name in models])


def _score_with_split_defaults(
    index: Index, query_terms: DataFrame, models: dict[str, Model], allowed: DataFrame | None
) -> DataFrame:
    """Sum of all defaults plus, for present terms, score minus default.

    The term part of the defaults is one number per topic, computed over the
    (small) query table and carried along; the document part is added per
    candidate. No (candidate x term) rows appear.
    """
    p = _pair()
    of_topic = W.partitionBy("topic_id")
    query = (
        known_terms(index, query_terms)
        .withColumns(_stats_columns(index))
        .withColumns({f"term_{name}": model.absent_term(p) for name, model in models.items()})
    )
    query = query.withColumns(
        {f"topic_{name}": F.sum(F.col("qtf") * F.col(f"term_{name}")).over(of_topic) for name in models}
        | {"topic_length": F.sum("qtf").over(of_topic)}
    )
    rows = _hits(index, query, allowed).select(
        "topic_id",
        "doc_id",
        *[
            (F.col("qtf") * (model.present(p) - (F.col(f"term_{name}") + model.absent_doc(p)))).alias(f"gain_{name}")
            for name, model in models.items()
        ],
        *[
            (F.col(f"topic_{name}") + F.col("topic_length") * model.absent_doc(p)).alias(f"base_{name}")
            for name, model in models.items()
        ],
    )
    return rows.groupBy("topic_id", "doc_id").agg(
        *[(F.max(f"base_{name}") + F.sum(f"gain_{name}")).alias(name) for name in models]
    )


def _topic_defaults(index: Index, query_terms: DataFrame, values: dict) -> DataFrame:
    """(topic_id, dl, default_*): what a topic's terms give a document of each length that has none of them.

    The lengths come from the lengths table, not from the matches, so postings are read once. The list of
    distinct lengths is short whatever the collection: ``n`` of them take ``n * n / 2`` tokens at least.
    """
    p = _pair()
    spark = query_terms.sparkSession
    # A document without a term is nobody's candidate, and models have no default for its length.
    lengths = index.lengths.where(F.col("dl") > 0).select("dl").distinct().agg(F.collect_list("dl").alias("dl"))
    # A stored query table is one small file; its terms are dealt out before each grows by all lengths.
    # Numbered partitions are not merged again by their size before that.
    dealt = known_terms(index, query_terms).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "topic_id", "term"
    )
    return (
        dealt.withColumn("dl", F.explode(lengths.scalar()))
        .withColumns(_stats_columns(index))
        .select("topic_id", "dl", *[(F.col("qtf") * absent(p)).alias(name) for name, (_, absent) in values.items()])
        .groupBy("topic_id", "dl")
        .agg(*[F.sum(name).alias(f"default_{name}") for name in values])
    )


def _score_with_pair_defaults(
    index: Index, query_terms: DataFrame, values: dict, allowed: DataFrame | None
) -> DataFrame:
    """Defaults evaluated per (topic, document length, query term).

    A default depends on the document only through its length, and a collection
    has far fewer lengths than candidates. So defaults are summed per topic and
    length, and each candidate, with its present terms summed as
    score minus default, looks its sum up.
    """
    p = _pair()
    gains = (
        match(index, query_terms, allowed)
        .select(
            "topic_id",
            "doc_id",
            "dl",
            *[
                (F.col("qtf") * (present(p) - absent(p))).alias(name)
                for name, (present, absent) in values.items()
            ],
        )
        .groupBy("topic_id", "doc_id", "dl")
        .agg(*[F.sum(name).alias(f"gain_{name}") for name in values])
    )
    if index.stored is not None:  # its lengths are counted without a pass; partitions of the join stay bounded
        pairs = index.lengths.count() * query_terms.select("topic_id").distinct().count()
        gains = gains.repartition(parts_of(query_terms.sparkSession, pairs, PAIRS), "topic_id", "dl")
    return gains.join(_topic_defaults(index, query_terms, values), ["topic_id", "dl"]).select(
        "topic_id",
        "doc_id",
        *[(F.col(f"gain_{n}") + F.col(f"default_{n}")).alias(n) for n in values],
    )


def score_by_filling(index: Index, query_terms: DataFrame, model: Model) -> DataFrame:
    """The literal form of the default fill: candidates x query terms, left
    joined with the postings. Kept to check the two forms above against."""
    p = _pair()
    absent = model.absent or (
        (lambda x: model.absent_term(x) + model.absent_doc(x))
        if model.absent_term
        else (lambda x: F.lit(0.0))
    )
    pairs = (
        candidates(index, query_terms)
        .join(known_terms(index, query_terms), "topic_id")
        .join(index.lengths, "doc_id")
        .join(index.postings.select("term", "doc_id", "tf"), ["term", "doc_id"], "left")
        .withColumns(_stats_columns(index))
    )
    value = F.when(F.col("tf").isNotNull(), model.present(p)).otherwise(absent(p))
    return (
        pairs.select("topic_id", "doc_id", (F.col("qtf") * value).alias("part"))
        .groupBy("topic_id", "doc_id")
        .agg(F.sum("part").alias("score"))
    )


def cosine_scores(
    index: Index, query_terms: DataFrame, allowed: DataFrame | None = None
) -> DataFrame:
    """Cosine of raw term-frequency vectors. Query norms count known terms and
    unknown ones alike. A stored index carries document norms on its postings;
    without one they are an aggregate over the postings of its own."""
    topic_norms = query_terms.groupBy("topic_id").agg(
        F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("topic_norm")
    )
    dot = F.sum(F.col("qtf") * F.col("tf")).alias("dot")
    if index.stored is not None:
        norm = F.sqrt(F.max("norm2")).alias("doc_norm")
        dots = _hits(index, query_terms, allowed).groupBy("topic_id", "doc_id").agg(dot, norm)
    else:
        postings = _restrict(index.postings, allowed)
        doc_norms = postings.groupBy("doc_id").agg(
            F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("doc_norm")
        )
        dots = query_terms.join(postings, "term").groupBy("topic_id", "doc_id").agg(dot).join(doc_norms, "doc_id")
    return dots.join(topic_norms, "topic_id").select(
        "topic_id",
        "doc_id",
        (F.col("dot") / (F.col("topic_norm") * F.col("doc_norm"))).alias("score"),
    )


# --- ranking ---------------------------------------------------------------


def top_k(
    scored: DataFrame,
    k: int | None = 1000,
    keys: Sequence[str] = ("topic_id",),
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Add a 1-based ``rank`` within ``keys`` and keep the first ``k``.

    Score descending, then lower document first. The filter on the rank makes
    Spark cut each task's rows to ``k`` per group before the shuffle, so a
    group never gathers whole in one task.
    """
    order = order or [F.col("score").desc(), F.col("doc_id").asc()]
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def hit_summary(scored: DataFrame, keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """Total hits and best score per topic."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_hits"), F.max("score").alias("max_score")
    )


def rounded(scored: DataFrame, decimals: int = 6, columns: Sequence[str] = ("score",)) -> DataFrame:
    """Round scores before ranking, so that ties do not hang on the order in
    which a distributed sum happened to run."""
    return scored.withColumns({c: F.round(c, decimals) for c in columns})


def search(
    index: Index,
    query_terms: DataFrame,
    model: Model,
    k: int | None = 1000,
    allowed: DataFrame | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Score, rank and cut: (topic_id, doc_id, score[, extras], rank)."""
    scored = score(index, query_terms, model, allowed)
    if decimals is not None:
        scored = rounded(scored, decimals)
    return top_k(scored, k)


def mean_variance_search(
    index: Index,
    query_terms: DataFrame,
    model: Model,
    k: int = 1000,
    rank_by: str = "score",
    a: float = 0.0,
    precut: int | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Score, mean and variance per hit.

    The top ``k`` by score, or by ``mean - a * sd`` among the best ``precut`` by mean
    (all, if there is no ``precut``).
    """
    settle = (lambda c: F.col(c)) if decimals is None else (lambda c: F.round(c, decimals))
    scored = score(index, query_terms, model)
    if rank_by == "mean":
        if precut is not None:
            scored = top_k(scored, precut, order=[settle("mean").desc(), F.col("doc_id").asc()]).drop("rank")
        scored = scored.withColumn("score", F.col("mean") - F.lit(float(a)) * F.sqrt("variance"))
    return top_k(scored.withColumn("score", settle("score")), k)


def per_term_search(index: Index, query_terms: DataFrame, model: Model) -> DataFrame:
    """Scores divided by the query length, every occurrence counted."""
    lengths = query_terms.groupBy("topic_id").agg(F.sum("qtf").alias("query_length"))
    return (
        score(index, query_terms, model)
        .join(lengths, "topic_id")
        .withColumn("score", F.col("score") / F.col("query_length"))
        .drop("query_length")
    )


# --- candidate filters -----------------------------------------------------


def field_range(
    documents: DataFrame,
    field: str,
    low=None,
    high=None,
    include_low: bool = True,
    include_high: bool = True,
) -> DataFrame:
    """Documents whose field lies in a range; ``None`` leaves a side open. The
    comparison is left bare so that it reaches the Parquet scan."""
    kept = documents
    if low is not None:
        kept = kept.where(F.col(field) >= F.lit(low) if include_low else F.col(field) > F.lit(low))
    if high is not None:
        kept = kept.where(
            F.col(field) <= F.lit(high) if include_high else F.col(field) < F.lit(high)
        )
    return kept


def top_k_by_fields(
    scored: DataFrame,
    documents: DataFrame,
    sort: Sequence[tuple[str, bool]],
    k: int = 1000,
    positive_only: bool = True,
    collation: str | None = None,
) -> DataFrame:
    """Top ``k`` by fields: ``sort`` lists (column, descending); ``score`` and
    ``doc_id`` are columns like any other. Ties go to the lower document. Strings go by their
    bytes or, with a ``collation`` (``UNICODE``, ``de``, ...), by the order of that locale."""
    kept = scored.where(F.col("score") > 0) if positive_only else scored
    fields = [c for c, _ in sort if c not in ("score", "doc_id")]
    with_fields = kept.join(documents.select("doc_id", *fields), "doc_id") if fields else kept
    kinds = dict(with_fields.dtypes)
    by = [(F.collate(F.col(c), collation) if collation and kinds[c] == "string" else F.col(c), down) for c, down in sort]
    order = [c.desc() if down else c.asc() for c, down in by]
    return top_k(with_fields, k, order=[*order, F.col("doc_id").asc()])


def boolean_candidates(index: Index, clauses: DataFrame) -> DataFrame:
    """Candidates under (topic_id, term, occur), occur in must, should, must_not.

    All musts, no must-not and, when a topic has no must, at least one should.
    One pass: matched clauses are counted per (topic, document).
    """
    clauses = clauses.select("topic_id", "term", "occur").distinct()
    needed = clauses.groupBy("topic_id").agg(
        F.count_if(F.col("occur") == "must").alias("n_must"),
    )
    counts = (
        clauses.join(index.postings, "term")
        .groupBy("topic_id", "doc_id")
        .agg(
            F.count_if(F.col("occur") == "must").alias("must"),
            F.count_if(F.col("occur") == "should").alias("should"),
            F.count_if(F.col("occur") == "must_not").alias("must_not"),
        )
    )
    return (
        counts.join(needed, "topic_id")
        .where(
            (F.col("must_not") == 0)
            & (F.col("must") == F.col("n_must"))
            & ((F.col("n_must") > 0) | (F.col("should") > 0))
        )
        .select("topic_id", "doc_id")
    )


def retrieval_counters(query_terms: DataFrame, scored: DataFrame, run: DataFrame) -> DataFrame:
    """Queries, scored documents, retrieved documents and the total of the
    scores, each cut to a whole number as the counter does."""
    return run.agg(
        query_terms.select(F.count_distinct("topic_id")).scalar().alias("queries"),
        scored.select(F.count(F.lit(1))).scalar().alias("scored_documents"),
        F.count(F.lit(1)).alias("retrieved_documents"),
        scored.select(F.sum(F.col("score").cast("int"))).scalar().alias("total_score"),
    )
