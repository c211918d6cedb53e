"""Queries: extraction, fields, dates and corpus statistics."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from siftrank.catalog import Catalog
from siftrank.catalog import inputs as I
from siftrank.functions import dates, html as H
from siftrank.operators import extract as X
from siftrank.sources.tables import load, load_by

CATALOG = Catalog()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replace(sql: str, pattern: str, by: str) -> str:
    return f"regexp_replace({sql}, {_quoted(pattern)}, {_quoted(by)}, 'g')"


def _without_scripts(sql: str) -> str:
    for pattern in (H.SCRIPT, H.COMMENT, H.DECLARATION):
        sql = _replace(sql, pattern, "")
    return sql


_ENTITY_MAP = "MAP {" + ", ".join(
    f"{_quoted(name)}: chr({code})" for name, code in name2codepoint.items()
) + "}"


def _decoded(sql: str) -> str:
    return f"""list_aggregate(list_transform(regexp_extract_all({sql}, {_quoted(H.ENTITY_OR_TEXT)}), lambda x:
  CASE WHEN x[1] <> '&' OR length(x) = 1 THEN x
       WHEN x[2] = '#' AND lower(x[3]) = 'x' THEN chr(('0x' || rtrim(x[4:], ';'))::INT)
       WHEN x[2] = '#' THEN chr(rtrim(x[3:], ';')::INT)
       ELSE coalesce(({_ENTITY_MAP})[rtrim(x[2:], ';')], '') END), 'string_agg', '')"""


def _tidy(sql: str) -> str:
    space = r"\s+"
    return f"trim({_replace(sql, space, ' ')})"


def _title(sql: str) -> str:
    return f"coalesce({_tidy(_decoded(f'regexp_extract({_without_scripts(sql)}, {_quoted(H.TITLE)}, 1)'))}, '')"


def _body(sql: str, with_title: bool = True) -> str:
    text = _replace(_without_scripts(sql), H.STYLE, "")
    if not with_title:
        text = _replace(text, H.TITLE, "")
    text = _replace(text, H.IMAGE_ALT, r"[\1\2\3]")
    text = _replace(text, H.SPACING, " ")
    text = _replace(text, H.TAG, "")
    return f"coalesce({_tidy(_decoded(text))}, '')"


@CATALOG.add(
    "page_text",
    f"SELECT page_id AS doc_id, {_title('html')} AS title, {_body('html')} AS body FROM pages",
)
def page_text(spark, folder):
    return X.extract_pages(load_by(spark, folder, "pages", "page_id")).select("doc_id", "title", "body")


@CATALOG.add(
    "page_meta",
    """SELECT doc_id, unnest(['lang', 'source', 'size']) AS name,
  unnest([lower(lang), lower(source), n_chars::VARCHAR]) AS content FROM documents""",
)
def page_meta(spark, folder):
    """(doc_id, name, content): documents dressed up as pages with meta tags of every
    kind of quoting, one of them given twice."""
    text = F.regexp_replace("text", "[<>&]", " ")
    page = F.concat(
        F.lit('<html><head><meta name="Lang" content="old"><META NAME="LANG" CONTENT="'), "lang",
        F.lit("\"><meta content='"), "source", F.lit("' http-equiv='Source'><meta name=size content="),
        F.col("n_chars").cast("string"),
        F.lit("><!-- <meta name=no content=no> --></head><body><p>"), text, F.lit("</p></body></html>"),
    )
    pages = I.documents(spark, folder).select("doc_id", page.alias("html"))
    props = X.extract_pages(pages, id="doc_id").select("doc_id", "props")
    return props.select("doc_id", F.explode("props").alias("name", "content"))


@CATALOG.add(
    "page_summary",
    f"""WITH t AS (SELECT page_id AS doc_id, {_title('html')} AS title, {_body('html', False)} AS body FROM pages),
s AS (SELECT doc_id, title, trim(substring(body, 1, 200)) AS s FROM t)
SELECT doc_id, CASE WHEN s = '' OR (title <> '' AND starts_with(s, title)) THEN title ELSE s END AS summary FROM s""",
)
def page_summary(spark, folder):
    return X.page_summaries(load_by(spark, folder, "pages", "page_id"))


# A chunk ends at the first blank that 499 to 519 characters stand before, else after 500.
_BLANK = r"[ \t\n\x0b\f\r]"


@CATALOG.add(
    "document_chunks",
    rf"""WITH RECURSIVE pieces AS (
SELECT doc_id, -1::BIGINT AS chunk_no, '' AS piece, text AS rest FROM documents WHERE length(text) > 0
UNION ALL
SELECT doc_id, chunk_no + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (
  SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest)
    WHEN length(word) < length(ahead) THEN 499 + length(word) ELSE 500 END AS n
  FROM (SELECT *, substr(rest, 500, 21) AS ahead, regexp_extract(substr(rest, 500, 21), '^[^{_BLANK[1:-1]}]*') AS word
    FROM pieces WHERE length(rest) > 0)))
SELECT doc_id, chunk_no, doc_id || '_' || chunk_no AS chunk_id, piece AS text FROM pieces WHERE chunk_no >= 0""",
)
def document_chunks(spark, folder):
    """Chunks of 500."""
    return X.chunk_documents(I.documents(spark, folder), 500)


@CATALOG.add(
    "chunk_coverage",
    "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 0",
)
def chunk_coverage(spark, folder):
    """Chunk lengths add up to the length of the text."""
    chunks = X.chunk_documents(I.documents(spark, folder), 500)
    return chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"))


@CATALOG.add(
    "stored_fields",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def stored_fields(spark, folder):
    return X.stored_fields(
        load(spark, folder, "documents"), ["lang", "source"], load(spark, folder, "labels")
    )


@CATALOG.add("selected_fields", "SELECT doc_id, lang, n_chars FROM documents")
def selected_fields(spark, folder):
    return X.stored_fields(load(spark, folder, "documents"), ["lang", "n_chars"])


@CATALOG.add(
    "gathered_values",
    "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id",
)
def gathered_values(spark, folder):
    rows = X.gather_values(load(spark, folder, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", F.array_join("values", "\n").alias("turns"))


_RESOLUTIONS = tuple(dates.FORMATS)
_STRFTIME = {
    "year": "%Y", "month": "%Y%m", "day": "%Y%m%d", "hour": "%Y%m%d%H", "minute": "%Y%m%d%H%M",
    "second": "%Y%m%d%H%M%S", "millisecond": "%Y%m%d%H%M%S%g",
}


@CATALOG.add(
    "rounded_dates",
    "SELECT event_id, "
    + ", ".join(
        f"strftime(date_trunc('{r}', ts), '%Y-%m-%d %H:%M:%S.%g') AS by_{r}" for r in _RESOLUTIONS
    )
    + " FROM events",
)
def rounded_dates(spark, folder):
    shown = "yyyy-MM-dd HH:mm:ss.SSS"
    return load(spark, folder, "events").select(
        "event_id",
        *[F.date_format(dates.round_date(F.col("ts"), r), shown).alias(f"by_{r}") for r in _RESOLUTIONS],
    )


@CATALOG.add(
    "formatted_dates",
    "SELECT event_id, "
    + ", ".join(f"strftime(ts, '{f}') AS by_{r}" for r, f in _STRFTIME.items())
    + " FROM events",
)
def formatted_dates(spark, folder):
    return load(spark, folder, "events").select(
        "event_id",
        *[dates.date_to_string(F.col("ts"), r).alias(f"by_{r}") for r in _RESOLUTIONS],
    )


@CATALOG.add(
    "parsed_dates",
    "SELECT event_id, "
    + ", ".join(
        f"strftime(date_trunc('{r}', ts), '%Y-%m-%d %H:%M:%S.%g') AS by_{r}" for r in _RESOLUTIONS
    )
    + " FROM events",
)
def parsed_dates(spark, folder):
    """Written at each resolution and read back by length."""
    shown = "yyyy-MM-dd HH:mm:ss.SSS"
    return load(spark, folder, "events").select(
        "event_id",
        *[
            F.date_format(
                dates.string_to_date(dates.date_to_string(F.col("ts"), r)), shown
            ).alias(f"by_{r}")
            for r in _RESOLUTIONS
        ],
    )


@CATALOG.add(
    "header_dates",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
)
def header_dates(spark, folder):
    """Event times written as mail headers, in two styles, and parsed again."""
    ts = F.col("ts")
    written = F.when(
        F.col("event_type") == "click", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    ).otherwise(F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy 'GMT'"))
    return load(spark, folder, "events").select(
        "event_id", F.date_format(dates.parse_any(written), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@CATALOG.add(
    "corpus_stats",
    "SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, count(DISTINCT text) AS n_texts FROM documents",
)
def corpus_stats(spark, folder):
    return X.corpus_stats(I.documents(spark, folder))
