"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: mail addresses, IP addresses, card numbers with
a right check digit and phone numbers. Around them the corpus is asked which other
terms give an entity away. How much a term ``t`` tells about an entity ``e`` is their
pointwise mutual information over the entity's own information,

    disclosure = log(n(e,t) N / (n(e) n(t))) / log(N / n(e)),

with documents as the unit: 0 for a term that occurs regardless of the entity, 1 for
one that occurs nowhere else. Terms are sought in the whole of an entity's documents; the
counts are over all documents. A term above ``THRESHOLD`` that is seen with the entity in
``SUPPORT`` different surroundings (``REACH`` words about the entity; copies of one passage
are one) is sanitised wherever it stands in the entity's documents: numbers and capitalised
words are generalised to what they are, others removed.

Every count is an aggregate with map-side sums. What a document adds is bounded by its
entities; frequent terms and entities are counted, never gathered. The terms asked about
are sent along with the tasks if there are no more than ``BROADCAST_TERMS``, by count; otherwise Spark
shuffles.

Null texts are empty. Repeated rows count as often as they occur, and each gets its row. Empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from siftrank.llm.common import by_batch, carried, row_key, sha256_hex, stored, table, text_of

KINDS = ("email", "ip", "card", "phone")
REACH = 8
SUPPORT = 3
THRESHOLD = 0.8
BROADCAST_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: what follows the run decides for all of it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{3,}"
_TERMS = re.compile(_TERM)

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from the left; looks at each character about an @ sign once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def passes_luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Kind, start and end of the entities, by kind as listed, then by start."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]  # any number of zeros in front
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def words_outside(text: str, spans: Sequence[Span]) -> list[tuple[int, int]]:
    """Start and end of the words outside all spans, in order."""
    covered = sorted((start, end) for _, start, end in spans)
    words, at = [], 0
    for m in _TERMS.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or m.end() <= covered[at][0]:
            words.append((m.start(), m.end()))
    return words


def surroundings(text: str, spans: Sequence[Span]) -> tuple[dict[str, set[str]], set[str]]:
    """The entities with their different surroundings, and the terms of the text."""
    if not spans:
        return {}, set()
    words = words_outside(text, spans)
    made, starts = {}, [a for a, _ in words]
    for kind, start, end in spans:
        k = bisect_left(starts, start)
        near = words[max(0, k - REACH) : k + REACH]
        around = sha256_hex(" ".join(text[a:b] for a, b in near).encode())[:16]
        made.setdefault(f"{kind}:{text[start:end].lower()}", set()).add(around)
    return made, {text[a:b] for a, b in words}


def span_list(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_FOUND = "array<struct<kind:string,start:int,end:int>>"
_NEAR = "array<struct<entity:string,arounds:array<string>>>"


def _detect(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans, near, held = [], [], []
    for text in batch.column("text").to_pylist():
        found = base_spans(text)
        spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        entities, terms = surroundings(text, found)
        near.append([{"entity": e, "arounds": sorted(arounds)} for e, arounds in entities.items()])
        held.append(sorted(terms))
    place = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    entity = pa.struct([("entity", pa.string()), ("arounds", pa.list_(pa.string()))])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key"), batch.column("row"), pa.array(spans, pa.list_(place)),
            pa.array(near, pa.list_(entity)), pa.array(held, pa.list_(pa.string())),
        ],
        names=["key", "row", "spans", "near", "held"],
    )


def detect(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``key``, ``row``, the base ``spans``, the entities ``near`` and the terms ``held`` with them."""
    rows = docs.select(row_key().alias("key"), carried(docs, carry).alias("row"), text_of().alias("text"))
    kept = rows.select("key", "row").schema
    made = StructType.fromDDL(f"spans {_FOUND}, near {_NEAR}, held array<string>")
    return by_batch(rows, _detect, StructType(kept.fields + made.fields))


def disclosing_terms(detected: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``(entity, term)`` above the threshold, with their ``disclosure``."""
    found = detected.select(F.explode("near").alias("x"), "held").select("x.*", "held")

    total = float(detected.count())

    def told(n_term: str) -> Column:
        both, entity = F.col("n_both"), F.col("n_entity")
        return F.log(both * F.lit(total) / (entity * F.col(n_term))) / F.log(F.lit(total) / entity)

    # what has too few surroundings itself can have no term in enough of them
    around = found.select("entity", F.explode("arounds").alias("around")).distinct()
    enough = around.groupBy("entity").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT).select("entity")
    # an entity of all documents has no information to give away
    entities = stored(
        found.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < total).join(enough, "entity"),
        "entities",
    )
    each = found.join(entities.select("entity"), "entity").select("entity", "arounds", F.explode("held").alias("term"))
    both = each.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    # a term is held by all documents that hold it beside some entity: a bound that rules most pairs out
    at_least = detected.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    likely = stored(
        both.join(entities, "entity").join(at_least, "term").where(told("n_near") >= THRESHOLD).drop("n_near"), "likely"
    )
    contexts = (
        each.join(likely.select("entity", "term"), ["entity", "term"])
        .select("entity", "term", F.explode("arounds").alias("around")).distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    )
    pairs = stored(likely.join(contexts, ["entity", "term"]), "pairs")
    asked = stored(pairs.select("term").distinct(), "asked")
    words = docs.select(text_of().alias("text"))
    if asked.count() <= BROADCAST_TERMS:
        counts = by_batch(words, _holding({row["term"] for row in asked.collect()}), "term string, n long")
        terms = counts.groupBy("term").agg(F.sum("n").alias("n_term"))
    else:
        held = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))))
        terms = words.select(held.alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    return (
        pairs.join(terms, "term").withColumn("disclosure", told("n_term"))
        .where(F.col("disclosure") >= THRESHOLD).select("entity", "term", "disclosure")
    )


def _holding(asked: set[str]):
    """In how many texts of a batch each term asked about occurs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(asked.intersection(_TERMS.findall(text)))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
        )

    return run


def term_spans(detected: DataFrame, docs: DataFrame) -> DataFrame:
    """For each ``key`` with disclosing terms, their places ``terms``, by start."""
    flagged = stored(disclosing_terms(detected, docs), "flagged")
    # documents without a flagged entity go before their terms are looked at
    found = detected.select("key", F.explode("near.entity").alias("entity"), "held").join(
        flagged.select("entity").distinct(), "entity"
    )
    own = found.select("key", "entity", F.explode("held").alias("term")).join(flagged, ["entity", "term"])
    wanted = own.groupBy("key").agg(F.collect_set("term").alias("wanted"))
    texts = docs.select(row_key().alias("key"), text_of().alias("text")).join(stored(wanted, "wanted"), "key")
    places = by_batch(texts, _places, "key string, terms array<struct<start:int,end:int>>")
    return places.dropDuplicates(["key"])


def _places(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Every place of a text's wanted terms."""
    made = []
    for text, wanted in zip(batch.column("text").to_pylist(), map(set, batch.column("wanted").to_pylist()), strict=True):
        words = words_outside(text, base_spans(text))
        made.append([{"start": a, "end": b} for a, b in words if text[a:b] in wanted])
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.list_(place))], names=["key", "terms"])


def generalised(word: str) -> str:
    if word.isdigit():
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: Sequence[Span], terms: Sequence[tuple[int, int]]) -> str:
    """The text with entities and disclosing terms replaced; overlapping ones as one."""
    marks = sorted(
        [(a, -b, f"[{kind.upper()}]") for kind, a, b in spans] + [(a, -b, generalised(text[a:b])) for a, b in terms]
    )
    parts, done = [], 0
    for start, minus_end, mark in marks:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, -minus_end)
    return "".join([*parts, text[done:]])


def _replaced(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [
        None if text is None else sanitised(text, base_spans(text), [(t["start"], t["end"]) for t in terms or []])
        for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True)
    ]
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "clean"])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts sanitised; all rows stay, all other columns too."""
    terms = term_spans(stored(detect(docs), "detected"), docs)
    rows = docs.select(row_key().alias("key"), carried(docs, docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    joined = rows.join(stored(terms, "terms"), "key", "left").select("row", "text", "terms")
    clean = by_batch(joined, _replaced, joined.select("row").schema.add("clean", "string"))
    return clean.select(*[
        F.col("clean").alias("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns
    ])


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = []
    for spans, terms in zip(batch.column("spans").to_pylist(), batch.column("terms").to_pylist(), strict=True):
        base = [(s["kind"], s["start"], s["end"]) for s in spans]
        every = base + [("term", t["start"], t["end"]) for t in terms or []]
        counts = [sum(kind == k for k, _, _ in base) for kind in KINDS]
        made.append((*counts, sha256_hex(span_list(base).encode()), span_list(every)))
    columns = list(zip(*made, strict=True))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
        names=["doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"],
    )


def report(docs: DataFrame) -> DataFrame:
    """Every document's entities, and all its spans in a list."""
    detected = stored(detect(docs), "detected")
    rows = detected.join(stored(term_spans(detected, docs), "terms"), "key", "left").select("row.doc_id", "spans", "terms")
    schema = rows.select("doc_id").schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    return by_batch(rows, _summed, schema.add("base_sha256", "string").add("spans", "string"))


def query(spark, folder: str) -> DataFrame:
    """``op10``: personal data of every document."""
    return report(table(spark, folder, "documents"))
