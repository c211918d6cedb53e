"""Main text of web pages: differencing of pages with near URLs, checked by markup.

A page is cut into lines, one for each block of text that is ever shown. Pages are ordered by host and
URL path, each is paired with the neighbour of its host that shares the longer beginning of the path, all
their lines are aligned by a longest common subsequence, and shared lines go. Then markup is heard where
it says what a line is: inside an article or main element it is text and stays; inside menus,
page headers, footers, sidebars, notices, adverts, forms and reader comments it is not and goes. A page
of which nothing would be left is a copy, not a template; it keeps the lines that markup does not rule out.

(Differencing alone, ``markup=False``, is the method as named; README.md has its figures.)

Host, path and a key of the page are put in order first, by range partitions and per-partition counts, and cut into
blocks of pages. Then the lines are shuffled once, to the block of their page; the pages at the edges of
a block also go to the block beside it. So a host of any size spreads over tasks, every page meets both
its neighbours, and nothing but order is stored.

Null html is an empty page with an empty text; a null or strange URL has no host and no
partner. Of two neighbours with as much of the path in common a copy of the page comes first. Repeated rows are pages like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from siftrank.llm.common import by_batch, stored, table

#: Elements by what they mean for the text in them.
UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option textarea button datalist".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
TEXT = frozenset(["article", "main"])
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Parts of class names, ids and roles that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead "
    "footer foot sidebar aside widget widgets related recommended trending "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social comment comments commentlist disqus respond replies reply search searchbox form "
    "contentinfo complementary hidden".split()
)

# a raw-text element runs to its own end tag; quoted attribute values may hold a ">"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|template|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

Line = tuple[str, bool]

#: Pages of a block.
PAGES = 4096
_ORDER = ["host", "path", "key"]
_LINES = "block int, extra boolean, texts array<string>, says array<tinyint>"


def _means(tag: str, rest: str, in_text: bool) -> int:
    """1: article text, -1: not article, 0: as around it."""
    if tag in UNSEEN or tag in ASIDE or tag == "header" and not in_text:
        return -1
    if rest and tag not in ("html", "body"):
        for name, value in _NAMED.findall(rest):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return -1
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -1
            if name in ("class", "id", "role"):
                if name == "role" and value.lower() in ("main", "article"):
                    return 1
                parts = {part.lower() for part in _NAME_PARTS.findall(value)}
                if parts & MARKS and tag not in ("main",) and not parts & {"no", "has", "with", "without"}:
                    return -1
                if "header" in parts and not in_text:
                    return -1
    return 1 if tag in TEXT else 0


def lines_of(page: str) -> list[Line]:
    """The lines that markup does not rule out, with whether they are article text."""
    return [(text, says > 0) for text, says in marked_lines(page) if says >= 0]


def marked_lines(page: str) -> list[tuple[str, int]]:
    """The lines of a page, with what markup says: 1 article text, 0 nothing, -1 not article text."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    beside: list[str] = []
    stack: list[tuple[str, int]] = []
    out = inside = unseen = 0  # open elements that rule text out, that hold article text, that are never shown

    def flush() -> None:
        for held, says in ((beside, -1), (parts, -1 if out else int(inside > 0))):
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    lines.append((text, says))

    for token in _TOKEN.finditer(page):
        text, tag = token["text"], token["tag"]
        if text is not None:
            if not unseen:
                (beside if out else parts).append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS or tag in UNSEEN
        if block:
            flush()
        if token["end"]:
            if any(name == tag for name, _ in stack):
                while stack:
                    name, means = stack.pop()
                    out -= means < 0
                    inside -= means > 0
                    unseen -= name in UNSEEN
                    if name == tag:
                        break
        elif tag not in VOID:
            means = _means(tag, token["rest"], inside > 0)
            # elements whose end may be left out are tracked only where they mean something
            if means or tag in ("div", "section", "span", "table", "ul", "ol", "header"):
                if not block and means:
                    flush()
                stack.append((tag, means))
                out += means < 0
                inside += means > 0
                unseen += tag in UNSEEN
    flush()
    return lines


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared_lines(own: Sequence[int], other: Sequence[int]) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Rows of the usual table are kept as bit vectors in whole numbers.
    """
    mask: dict[int, int] = {}
    for k, line in enumerate(own):
        mask[line] = mask.get(line, 0) | 1 << k
    full = (1 << len(own)) - 1
    row, rows = full, []
    for line in other:
        both = row & mask.get(line, 0)
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    found, i, j = set(), len(other), len(own)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.add(j)
    return found


def _common(a: str | None, b: str | None) -> int:
    size = 0
    for x, y in zip(a or "", b or "", strict=False):
        if x != y:
            break
        size += 1
    return size


def _lines(markup: bool, page: str | None) -> list[tuple[str, int]]:
    return marked_lines(page or "") if markup else [(text, 0) for text in all_lines(page or "")]


def _ordered_pages(markup: bool):
    """Host, path and key of the pages that can have a neighbour."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [bool(host) and bool(_lines(markup, page)) for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True)]
        return batch.select(_ORDER).filter(pa.array(kept, pa.bool_()))

    return run


def _cut(markup: bool, blocks: int, firsts: list[tuple[str, ...]], lasts: list[tuple[str, ...]]):
    """Lines of pages, dealt to blocks. The first and last page of a block also go to the block beside it."""
    begin, end = ({place: k for k, place in enumerate(places)} for places in (firsts, lasts))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, block, extra, every, said = [], [], [], [], []
        for k, (host, path, key, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*_ORDER, "html")), strict=True)):
            lines, place = _lines(markup, page), (host, path, key)
            if not host or not lines:
                places = [int(key[:8], 16) % blocks]
            else:
                own = max(bisect.bisect_right(firsts, place) - 1, 0)
                places = [own, *[own - 1] * (begin.get(place, 0) > 0), *[own + 1] * (place in end and own + 1 < len(firsts))]
            for at, where in enumerate(places):
                rows.append(k)
                block.append(where)
                extra.append(at > 0)
                every.append([text for text, _ in lines])
                said.append([says for _, says in lines])
        held = batch.select([name for name in batch.schema.names if name != "html"]).take(pa.array(rows, pa.int64()))
        hosts = [host if texts else "" for host, texts in zip(held.column("host").to_pylist(), every, strict=True)]  # nobody's neighbour
        held = held.set_column(held.schema.get_field_index("host"), "host", pa.array(hosts, pa.string()))
        return pa.RecordBatch.from_arrays(
            [*held.columns, pa.array(block, pa.int32()), pa.array(extra, pa.bool_()), pa.array(every, pa.list_(pa.string())), pa.array(said, pa.list_(pa.int8()))],
            names=[*held.schema.names, "block", "extra", "texts", "says"],
        )

    return run


def all_lines(page: str) -> list[str]:
    """Every line of a page outside scripts and the like, whatever its markup means."""
    pieces = []
    for token in _TOKEN.finditer(page):
        if token["text"] is not None:
            pieces.append(token["text"])
        elif token["tag"] and token["tag"].lower() in BLOCKS:
            pieces.append("\0")
    return [line for part in "".join(pieces).split("\0") if (line := " ".join(html.unescape(part).split()))]


def _main_text(row: dict, beside: Sequence[dict | None]) -> str:
    """The lines that stay. Lines shared with the neighbour go; then markup is heard."""
    near = [
        (_common(row["path"], other["path"]), other["key"] == row["key"], other["hashes"])
        for other in beside
        if other and row["host"] and row["texts"] and (other["block"], other["host"]) == (row["block"], row["host"])
    ]
    gone = shared_lines(row["hashes"], max(near, key=lambda x: x[:2])[2]) if near else set()
    lines = list(zip(row["texts"], row["says"], strict=True))
    left = [text for k, (text, says) in enumerate(lines) if says > 0 or says == 0 and k not in gone]
    return " ".join(left or [text for text, says in lines if says == 0])


def _differenced(names: list[str]):
    """Main texts of pages that come in order: each is held until the one after it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[dict, str]], schema: pa.Schema) -> pa.RecordBatch:
            held = [pa.array([row[name] for row, _ in rows], schema.field(name).type) for name in names]
            return pa.RecordBatch.from_arrays([*held, pa.array([text for _, text in rows], pa.string())], names=[*names, "text"])

        before, row, schema = None, None, None
        for batch in batches:
            schema, found = batch.schema, []
            for place in range(batch.num_rows):
                after = batch.slice(place, 1).to_pylist()[0]
                after["hashes"] = [line_hash(text) for text in after["texts"]]
                if row is not None and not row["extra"]:
                    found.append((row, _main_text(row, (before, after))))
                before, row = row, after
            if found:
                yield made(found, schema)
        if row is not None and not row["extra"]:
            yield made([(row, _main_text(row, (before, None)))], schema)

    return run


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with their place ``pos`` in the order of host, path and key."""
    order = _ORDER
    placed = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ordered",
    )
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row per partition
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, "part").withColumn("pos", F.col("start") + F.col("i")).drop("part", "i", "start")


def extract(pages: DataFrame, markup: bool = True, size: int = PAGES) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and its length ``n_chars`` of every page."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    address = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    html_text = F.col("html").cast("string")
    known = [F.coalesce(F.col("page_id").cast("string"), F.lit("null")), url, F.coalesce(html_text, F.lit(""))]
    rows = pages.select(
        "page_id",
        "url",
        F.lower(F.regexp_extract(url, address, 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(url, address, 2), r"(\.html?|/)$", "").alias("path"),
        F.md5(F.concat_ws("\0", *known)).alias("key"),
        html_text.alias("html"),
    )
    ordered = by_batch(rows, _ordered_pages(markup), "host string, path string, key string")
    placed = stored(_positions(ordered.distinct()), "positions")
    place = F.col("pos") % size
    # the first and last page of every block, a few for each task
    edges = placed.where((place == 0) | (place == size - 1)).select(*_ORDER, (place == 0).alias("first"), (place == size - 1).alias("last")).collect()
    firsts, lasts = (sorted((e["host"], e["path"], e["key"]) for e in edges if e[side]) for side in ("first", "last"))
    blocks = max(len(firsts), -(-rows.count() // size), 1)
    schema = StructType(rows.drop("html").schema.fields + StructType.fromDDL(_LINES).fields)
    dealt = by_batch(rows, _cut(markup, blocks, firsts, lasts), schema).repartition(blocks, "block").sortWithinPartitions("block", *_ORDER)
    told = StructType([rows.schema["page_id"], rows.schema["url"]]).add("text", "string")
    return dealt.mapInArrow(_differenced(["page_id", "url"]), told).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, folder: str) -> DataFrame:
    """``op7``: the main text of every page."""
    return extract(table(spark, folder, "pages"))
