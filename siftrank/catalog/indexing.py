"""Queries: index building, views, merging, look-ups and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.catalog.stemming import STEMS, TERMS
from siftrank.functions.lengths import quantised_length
from siftrank.operators import index as X
from siftrank.operators.analyze import Analyzer, analyze
from siftrank.session import scratch_path
from siftrank.sources import index_store
from siftrank.sources.tables import load, load_by

CATALOG = Catalog()

WITH = f"WITH {I.TEXT}"


@CATALOG.add("term_frequencies", f"{WITH} SELECT term, doc_id, tf FROM post")
def term_frequencies(spark, folder):
    return X.build_index(I.documents(spark, folder)).postings.select("term", "doc_id", "tf")


@CATALOG.add(
    "postings_with_counts", f"{WITH} SELECT term, df, ctf, doc_id, tf FROM post JOIN lex USING (term)"
)
def postings_with_counts(spark, folder):
    return X.postings_with_counts(I.corpus_index(spark, folder))


@CATALOG.add(
    "posting_blocks",
    f"""{WITH}, spread AS (SELECT term, df, ctf, doc_id, tf,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % ceil(df / 64.0)::BIGINT)::BIGINT AS block FROM post JOIN lex USING (term))
SELECT term, df, ctf, block, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS observations
FROM spread GROUP BY ALL""",
)
def posting_blocks(spark, folder):
    blocks = X.posting_blocks(I.corpus_index(spark, folder), block_size=64)
    text = F.array_join(
        F.transform(
            F.map_entries("observations"), lambda e: F.concat_ws(":", e["key"], e["value"])
        ),
        " ",
    )
    return blocks.withColumn("observations", text)


@CATALOG.add("lexicon", f"{WITH} SELECT term, df, ctf FROM lex")
def lexicon(spark, folder):
    return X.build_index(I.documents(spark, folder)).lexicon


@CATALOG.add("document_lengths", f"{WITH} SELECT doc_id, dl FROM len")
def document_lengths(spark, folder):
    return X.build_index(I.documents(spark, folder)).lengths


@CATALOG.add(
    "collection_stats", f"{WITH} SELECT n_docs, cl, round(avg_dl, 6) AS avg_dl FROM st"
)
def collection_stats(spark, folder):
    stats = X.build_index(I.documents(spark, folder)).stats
    return stats.select("n_docs", "cl", F.round("avg_dl", 6).alias("avg_dl"))


@CATALOG.add(
    "positional_postings",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ts FROM documents),
p AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM t)
SELECT term, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM p GROUP BY ALL""",
)
def positional_postings(spark, folder):
    rows = X.positional_postings(analyze(I.documents(spark, folder)))
    return rows.withColumn(
        "positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")
    )


@CATALOG.add(
    "quantised_lengths",
    f"""{WITH} SELECT doc_id, dl, CASE WHEN dl <= 0 THEN 0.0 ELSE floor(dl / pow(2.0, floor(log2(dl)) - 2))
  * pow(2.0, floor(log2(dl)) - 2) END::DOUBLE AS dl_q FROM len""",
)
def quantised_lengths(spark, folder):
    return I.corpus_index(spark, folder).lengths.withColumn("dl_q", quantised_length(F.col("dl")))


# Term vectors over two fields: a turn's text and its role.
_FIELDS = r"""WITH body AS (SELECT conv_id AS doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM conversations),
role AS (SELECT conv_id AS doc_id, unnest(regexp_extract_all(lower(role), '\p{L}+')) AS term FROM conversations),
fields AS (SELECT * FROM body UNION ALL SELECT * FROM role),
tv AS (SELECT doc_id, term, count(*) AS tf FROM fields GROUP BY ALL)"""


def _conversation_vectors(spark, folder):
    turns = load_by(spark, folder, "conversations", "conv_id")
    fields = [
        X.term_frequencies(analyze(turns, field, "conv_id")) for field in ("text", "role")
    ]
    return X.term_vectors(fields)


@CATALOG.add("term_vectors", f"{_FIELDS} SELECT doc_id, term, tf FROM tv")
def term_vectors(spark, folder):
    return _conversation_vectors(spark, folder)


@CATALOG.add(
    "document_term_totals",
    f"{_FIELDS} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS total_tf FROM tv GROUP BY ALL",
)
def document_term_totals(spark, folder):
    return X.document_totals(_conversation_vectors(spark, folder))


def _by_source(spark, folder) -> dict[str, X.Index]:
    """One index per document source; sources are few and listed by the table."""
    docs = load(spark, folder, "documents")
    stored = I.once(
        spark,
        folder,
        "by_language",
        lambda: {
            lang: index_store.index_documents(
                docs.where(F.col("lang") == lang), scratch_path(spark, f"index-{lang}")
            )
            for lang in _LANGUAGES
        },
    )
    rest = I.documents(spark, folder).where(~F.col("lang").isin(list(_LANGUAGES)) | F.col("lang").isNull())
    return {**stored, "other": X.build_index(rest)}


_LANGUAGES = ("de", "en", "fr")


@CATALOG.add(
    "merged_index",
    f"{WITH} SELECT term, doc_id, tf, dl, df, ctf FROM post JOIN len USING (doc_id) JOIN lex USING (term)",
)
def merged_index(spark, folder):
    merged = X.merge_indexes(list(_by_source(spark, folder).values()))
    return merged.postings.join(merged.lexicon, "term")


@CATALOG.add(
    "merged_stats", f"{WITH} SELECT n_docs, cl, round(avg_dl, 6) AS avg_dl FROM st"
)
def merged_stats(spark, folder):
    merged = X.merge_indexes(list(_by_source(spark, folder).values()))
    return merged.stats.select("n_docs", "cl", F.round("avg_dl", 6).alias("avg_dl"))


@CATALOG.add(
    "federated_lexicon",
    f"""{WITH} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf,
  count(DISTINCT CASE WHEN lang IN ('de', 'en', 'fr') THEN lang ELSE 'other' END) AS n_sources
FROM post JOIN documents USING (doc_id) GROUP BY term""",
)
def federated_lexicon(spark, folder):
    return X.federated_lexicon(_by_source(spark, folder))


@CATALOG.add(
    "federated_documents",
    f"""{WITH} SELECT doc_id, dl, CASE WHEN lang IN ('de', 'en', 'fr') THEN lang ELSE 'other' END AS source
FROM len JOIN documents USING (doc_id)""",
)
def federated_documents(spark, folder):
    return X.federated_documents(_by_source(spark, folder))


@CATALOG.add(
    "joined_families", f"{WITH} SELECT doc_id, dl, lang, source, n_chars FROM len JOIN documents USING (doc_id)"
)
def joined_families(spark, folder):
    docs = load(spark, folder, "documents")
    return X.join_families(
        [
            I.corpus_index(spark, folder).lengths,
            docs.select("doc_id", "lang", "source"),
            docs.select("doc_id", "source", "n_chars"),
        ]
    )


@CATALOG.add(
    "terms_from", f"{WITH} SELECT term, df, ctf FROM lex WHERE term >= 'm' ORDER BY term LIMIT 500"
)
def terms_from(spark, folder):
    """A page of the dictionary: 500 terms from "m" onward."""
    return X.terms_from(I.corpus_index(spark, folder).lexicon, "m", 500)


@CATALOG.add("terms_with_prefix", f"{WITH} SELECT term, df, ctf FROM lex WHERE term LIKE 'th%'")
def terms_with_prefix(spark, folder):
    return X.terms_with_prefix(I.corpus_index(spark, folder).lexicon, "th")


@CATALOG.add(
    "term_lookup", f"{WITH} SELECT term, doc_id, tf FROM post WHERE term IN ('the', 'der', 'que')"
)
def term_lookup(spark, folder):
    return X.look_up(I.corpus_index(spark, folder).postings, ["the", "der", "que"]).select(
        "term", "doc_id", "tf"
    )


@CATALOG.add(
    "term_lookup_batch",
    f"WITH {I.TOPICS} SELECT term, df, ctf FROM lex WHERE term IN (SELECT term FROM qt)",
)
def term_lookup_batch(spark, folder):
    return X.look_up(I.corpus_index(spark, folder).lexicon, I.topic_terms(spark, folder))


_GONE = "gone AS (SELECT DISTINCT doc_id FROM post WHERE term IN ('hund', 'der'))"


def _deleted(spark, folder):
    index = I.corpus_index(spark, folder)
    return X.delete_documents(index, X.documents_with_terms(index, ["hund", "der"]))


@CATALOG.add(
    "deleted_lexicon",
    f"""{WITH}, {_GONE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM post
WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY term""",
)
def deleted_lexicon(spark, folder):
    return _deleted(spark, folder).lexicon


@CATALOG.add(
    "deleted_stats",
    f"""{WITH}, {_GONE} SELECT (SELECT count(*) FROM gone) AS n_deleted, count(*) AS n_docs, sum(dl)::DOUBLE AS cl
FROM len WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
)
def deleted_stats(spark, folder):
    index = I.corpus_index(spark, folder)
    gone = X.documents_with_terms(index, ["hund", "der"])
    return X.delete_documents(index, gone).stats.select(
        gone.select(F.count(F.lit(1))).scalar().alias("n_deleted"), "n_docs", "cl"
    )


# The documents with "der" are replaced by the conversations.
@CATALOG.add(
    "updated_lexicon",
    f"""{WITH}, fresh AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term, -1 - conv_id AS doc_id FROM conversations),
fp AS (SELECT term, doc_id, count(*) AS tf FROM fresh GROUP BY ALL),
kept AS (SELECT term, doc_id, tf FROM post WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'der')
  UNION ALL SELECT term, doc_id, tf FROM fp)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM kept GROUP BY term""",
)
def updated_lexicon(spark, folder):
    # One document per conversation: the words of all its turns.
    turns = load_by(spark, folder, "conversations", "conv_id").withColumn("doc_id", -1 - F.col("conv_id"))
    fresh = X.index_from_frequencies(X.term_frequencies(analyze(turns)), turns)
    index = I.corpus_index(spark, folder)
    return X.update_documents(index, ["der"], fresh).lexicon


@CATALOG.add(
    "document_counts",
    f"""{WITH} SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'der')) AS num_docs,
  count(*) AS max_doc FROM documents""",
)
def document_counts(spark, folder):
    index = I.corpus_index(spark, folder)
    docs = load(spark, folder, "documents").select("doc_id")
    return X.document_counts(X.mark_deleted(docs, X.documents_with_terms(index, ["der"])))


@CATALOG.add("undeleted_counts", "SELECT count(*) AS num_docs, count(*) AS max_doc FROM documents")
def undeleted_counts(spark, folder):
    index = I.corpus_index(spark, folder)
    docs = load(spark, folder, "documents").select("doc_id")
    marked = X.mark_deleted(docs, X.documents_with_terms(index, ["der"]))
    return X.document_counts(X.undelete_all(marked))


@CATALOG.add("index_store_round_trip", f"{WITH} SELECT term, doc_id, tf, dl FROM post JOIN len USING (doc_id)")
def index_store_round_trip(spark, folder):
    built = X.build_index(I.documents(spark, folder))
    return index_store.write_index(built, scratch_path(spark, "index-copy")).postings


@CATALOG.add(
    "index_store_fetch",
    f"{WITH} SELECT doc_id, tf, df, ctf FROM post JOIN lex USING (term) WHERE term = 'the'",
)
def index_store_fetch(spark, folder):
    index = I.corpus_index(spark, folder)
    return X.postings_with_counts(
        index._replace(postings=index_store.fetch_posting(index, "the"))
    ).select("doc_id", "tf", "df", "ctf")


@CATALOG.add(
    "index_store_meta",
    f"""{WITH} SELECT 'CollectionLength' AS key, cl::BIGINT AS value FROM st
UNION ALL SELECT 'NumberOfDocuments', n_docs FROM st""",
)
def index_store_meta(spark, folder):
    return index_store.read_meta(I.corpus_index(spark, folder))


# Fixed value for the stemmed queries: a short list, so that the SQL can hold it.
STOP = ("der", "die", "und", "the", "and", "of", "to", "les", "des", "que")


_STOPPED = ", ".join(f"'{w}'" for w in STOP)


@CATALOG.add(
    "stemmed_lexicon",
    f"""{TERMS}, {STEMS}, post AS (
  SELECT stem, doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM documents)
  JOIN stems USING (term) WHERE term NOT IN ({_STOPPED}))
SELECT stem AS term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM post GROUP BY stem""",
)
def stemmed_lexicon(spark, folder):
    """The whole chain with stemming, stored."""
    return index_store.index_documents(
        load(spark, folder, "documents"),
        scratch_path(spark, "stemmed-index"),
        analyzer=Analyzer(stop_words=STOP, stem=True),
    ).lexicon
