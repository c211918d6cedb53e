"""Benchmark decontamination: a prefix-filtered join of shingle sets with positions.

A window is a run of consecutive words of a benchmark item. Its tokens are shingles
of a few words. The tokens of all windows are looked up in the documents once; what is
found is a narrow table of token occurrences. Tokens are ordered by rarity in the
documents. A document that contains a window contains each of its tokens, so the rarest
one alone is the necessary prefix: only its occurrences make candidates. A candidate's
place follows from the token's offset and must lie within the document (length and
position bounds). It is kept if all tokens of the window occur at their places, which
is exact containment, as a window is given by its tokens in order.

Column expressions only. Cutting texts into words is what costs most, so it is done once: a report
stores the words. The look-up compares hashes first, then the words themselves.
The hashes of the benchmark's tokens are broadcast if there are no more than
``BROADCAST_TOKENS``, by count; beyond that the join is left to Spark, which shuffles.
Whatever is gathered for a document is bounded by its length.

Null texts have no words. Repeated documents each get their row; repeated items or ids
count once, a null item_id has the empty string as its id. Empty tables give no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import row_key, stored, table, text_of

WINDOW = 10
TOKEN_WORDS = 3
BROADCAST_TOKENS = 1_000_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in ASCII lower case: letters a-z, digits and all beyond ASCII.

    Lower-casing must leave letters beyond ASCII alone, so it runs on the UTF-8 bytes
    read as Latin-1. There it also shifts lead bytes of two-byte characters, one to
    one: those are told from others by the bytes that follow, so equal words stay equal
    and different ones different.
    """
    as_bytes = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(F.lower(as_bytes), F.lit(_WORD), F.lit(0))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``item``, and each window: ``id`` (its words), ``tokens`` in order, ``n`` words."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_of()).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda at: F.slice("words", at, window))).alias("w"))
    size = F.least(F.size("w"), F.lit(TOKEN_WORDS))
    tokens = F.transform(
        F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")
    )
    return cut.select(
        "item", F.array_join("w", " ").alias("id"), F.size("w").alias("n"), size.alias("size"), tokens.alias("tokens")
    ).distinct()


def _token_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _occurrences(docs: DataFrame, tokens: DataFrame, size: int) -> DataFrame:
    """Where ``tokens`` of ``size`` words occur in the documents."""
    # outer: else the optimizer adds filters on the array below, which cut the text into words again for each of them
    placed = docs.select("key", F.col("words"), F.size("words").alias("length"), F.posexplode_outer("words").alias("pos", "first"))
    after = [F.get("words", F.col("pos") + k).alias(f"w{k}") for k in range(1, size)]
    parts = [F.col("first"), *[F.col(f"w{k}") for k in range(1, size)]]
    runs = placed.select("key", "length", "pos", "first", *after).where(F.col("pos") <= F.col("length") - size)
    hashes = tokens.select(F.xxhash64(*[F.get(F.split("token", " "), k) for k in range(size)]).alias("h")).distinct()
    if tokens.count() <= BROADCAST_TOKENS:
        hashes = F.broadcast(hashes)
    found = runs.withColumn("h", _token_hash(parts)).join(hashes, "h", "left_semi")
    said = found.select("key", "length", "pos", F.concat_ws(" ", *parts).alias("token"))
    return said.join(tokens, "token", "left_semi")


def contained_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each place of a document where a window occurs.

    ``docs`` has ``key`` and ``words``. Columns ``key``, ``start``, ``n`` (words), ``id``
    and the table ``(id, item)`` of windows.
    """
    windows = stored(_windows(items, window), "windows")
    tokens = stored(windows.select("size", F.explode("tokens").alias("token")).distinct(), "tokens")
    found = None
    for (size,) in sorted(tokens.select("size").distinct().collect()):  # TOKEN_WORDS rows at most
        part = _occurrences(docs, tokens.where(F.col("size") == size).select("token"), size)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "key string, length int, pos int, token string")
    found = stored(found.distinct(), "occurrences")
    rarity = tokens.select("token").join(found.groupBy("token").agg(F.count("*").alias("seen")), "token")
    # a window with a token that nowhere occurs is nowhere contained
    each = windows.select("id", "n", "tokens").distinct().select("id", "n", F.size("tokens").alias("all"), F.posexplode("tokens").alias("offset", "token"))
    ranked = each.join(rarity, "token").groupBy("id", "n", "all").agg(
        F.count("*").alias("known"), F.min(F.struct("seen", "offset", "token")).alias("rarest")
    )
    prefix = ranked.where("known = all").select("id", "n", "rarest.offset", "rarest.token")
    candidates = (
        found.join(prefix, "token")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("length")))
        .select("key", "start", "id", "n")
    )
    expected = candidates.join(each.select("id", "all", "offset", "token"), "id").withColumn("pos", F.col("start") + F.col("offset"))
    verified = (
        expected.join(found.select("key", "pos", "token"), ["key", "pos", "token"], "left_semi")
        .groupBy("key", "start", "n", "id", "all").agg(F.count("*").alias("present"))
        .where("present = all").select("key", "start", "n", "id")
    )
    return stored(verified, "contained"), windows.select("id", "item").distinct()


def _covered(spans: Column) -> Column:
    """How many places the runs ``(start, n)`` cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], (span["start"] + span["n"]).cast("long"))
        return F.struct(
            (state["sum"] + end - F.least(F.greatest(state["end"], span["start"].cast("long")), end)).alias("sum"),
            end.alias("end"),
        )

    return F.aggregate(F.array_sort(spans), zero, add, lambda state: state["sum"])


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per ``key`` of a contaminated document: ``n_hit`` and the sorted ``items``."""
    places, window_items = contained_windows(docs, items, window)
    covered = places.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    named = (
        places.select("key", "id").distinct().join(window_items, "id")
        .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return covered.select("key", _covered(F.col("spans")).alias("n_hit")).join(named, "key")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    keyed = docs.select(row_key().alias("key"), words_of(text_of()).alias("words"))
    found = hits(keyed, items).select("key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("key"))
    return rows.join(found, "key", "left_anti").select("row.*")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document's words, words hit and items."""
    keyed = stored(docs.select("doc_id", row_key().alias("key"), words_of(text_of()).alias("words")), "words")
    found = stored(hits(keyed.select("key", "words"), items), "hits")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    counted = keyed.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    return counted.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark, folder: str) -> DataFrame:
    """``op4``: contamination of every document by any benchmark item."""
    return report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark
), s AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_slice(w, i, least(i + 9, len(w))) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM s
), p AS (
  SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT rid, i, n, item FROM p JOIN s USING (win)
), hit AS (
  SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM m) GROUP BY rid
), found AS (
  SELECT rid, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""
