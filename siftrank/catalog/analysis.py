"""Queries: text analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.catalog.indexing import STOP
from siftrank.catalog.stemming import STEMS, TERMS
from siftrank.functions.stems import with_stems
from siftrank.operators import analyze as A

CATALOG = Catalog()

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_TOKENS = r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ts FROM documents)"
_KEPT = rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: x NOT IN ({_STOP_SQL})) AS ts FROM documents)"""
_POSITIONS = "SELECT doc_id, unnest(range(0, len(ts)))::BIGINT AS pos, unnest(ts) AS term FROM t"


@CATALOG.add("letter_tokens", f"{_TOKENS} {_POSITIONS}")
def letter_tokens(spark, folder):
    return A.analyze(I.documents(spark, folder))


@CATALOG.add(
    "whitespace_tokens",
    rf"WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ts FROM documents) {_POSITIONS}",
)
def whitespace_tokens(spark, folder):
    return A.analyze(I.documents(spark, folder), analyzer=A.Analyzer(tokenizer="whitespace"))


@CATALOG.add("stop_filtered_tokens", f"{_KEPT} {_POSITIONS}")
def stop_filtered_tokens(spark, folder):
    return A.analyze(I.documents(spark, folder), analyzer=A.Analyzer(stop_words=STOP))


@CATALOG.add(
    "stop_filtered_by_table",
    f"{_KEPT} {_POSITIONS}",
)
def stop_filtered_by_table(spark, folder):
    """The list as a table; positions are those of the tokens kept."""
    words = spark.createDataFrame([(w,) for w in STOP], "term string")
    tokens = A.remove_stop_words(A.analyze(I.documents(spark, folder)), words)
    return tokens.select("doc_id", "pos", "term")


@CATALOG.add(
    "stop_filtered_folded",
    rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '\S+'), lambda x: lower(x) NOT IN ({_STOP_SQL})) AS ts FROM documents)
{_POSITIONS}""",
)
def stop_filtered_folded(spark, folder):
    chain = A.Analyzer(tokenizer="whitespace", stop_words=STOP, ignore_case=True)
    return A.analyze(I.documents(spark, folder), analyzer=chain)


CATALOG.add("stemmed_vocabulary", rf"{TERMS}, {STEMS} SELECT term, stem FROM stems")(
    lambda spark, folder: with_stems(I.corpus_index(spark, folder).lexicon.select("term"))
)


@CATALOG.add(
    "stemmed_tokens",
    f"{_KEPT}, p AS ({_POSITIONS}), voc AS MATERIALIZED (SELECT DISTINCT term FROM p), {STEMS} "
    "SELECT doc_id, pos, stem AS term FROM p JOIN stems USING (term) WHERE pos < 10000",
)
def stemmed_tokens(spark, folder):
    chain = A.Analyzer(stop_words=STOP, stem=True, max_tokens=10_000)
    return A.analyze(I.documents(spark, folder), analyzer=chain)


@CATALOG.add(
    "token_offsets",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+|[^\p{L}]+') AS ps FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS piece FROM t),
o AS (SELECT doc_id, piece, sum(length(piece)) OVER w AS e, regexp_matches(piece, '^\p{L}') AS tk,
  sum(regexp_matches(piece, '^\p{L}')::INT) OVER w - 1 AS pos FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, pos::BIGINT AS pos, lower(piece) AS term, (e - length(piece))::BIGINT AS "start", e::BIGINT AS "end" FROM o WHERE tk""",
)
def token_offsets(spark, folder):
    return A.token_offsets(I.documents(spark, folder))


@CATALOG.add("capped_tokens", f"{_KEPT}, p AS ({_POSITIONS}) SELECT * FROM p WHERE pos < 10000")
def capped_tokens(spark, folder):
    """The usual cap: the first 10,000 tokens after stop words."""
    return A.cap_tokens(
        A.analyze(I.documents(spark, folder), analyzer=A.Analyzer(stop_words=STOP)), 10_000
    )
