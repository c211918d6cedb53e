"""Dates at a chosen resolution. The session time zone is expected to be UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The written form of a date at each resolution.
FORMATS = {
    "year": "yyyy",
    "month": "yyyyMM",
    "day": "yyyyMMdd",
    "hour": "yyyyMMddHH",
    "minute": "yyyyMMddHHmm",
    "second": "yyyyMMddHHmmss",
    "millisecond": "yyyyMMddHHmmssSSS",
}
# The dates found in document headers, tried in order.
HEADER_FORMATS = (
    "EEE, dd MMM yyyy HH:mm:ss z",
    "EEE MMM dd HH:mm:ss yyyy z",
    "EEE, dd-MMM-':'y HH:mm:ss z",
    "EEE, dd-MMM-yyyy HH:mm:ss z",
)


def round_date(ts: Column, resolution: str) -> Column:
    return F.date_trunc(resolution, ts)


def date_to_string(ts: Column, resolution: str) -> Column:
    return F.date_format(ts, FORMATS[resolution])


def string_to_date(text: Column) -> Column:
    """Parse a date written by :func:`date_to_string`; its length tells the resolution.

    The text is completed to milliseconds first, so one format reads them all.
    """
    digits = F.length(text)
    whole = F.concat(text, F.substring(F.lit("00000101000000000"), digits + 1, F.lit(17)))
    known = digits.isin([4, 6, 8, 10, 12, 14, 17]) & text.rlike("^[0-9]+$")
    stamp = F.regexp_replace(
        whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})$", r"$1-$2-$3 $4:$5:$6.$7"
    )
    return F.when(known, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def parse_any(text: Column, formats: Sequence[str] = HEADER_FORMATS) -> Column:
    """The first format that fits wins; NULL when none does.

    The weekday carries no information and the strict parser refuses one that
    disagrees with the date, so it is cut from both the text and the format.
    """
    tries = []
    for fmt in formats:
        value = F.trim(text)
        if fmt.startswith("EEE"):
            value = F.regexp_replace(value, r"^[A-Za-z]{3},?\s*", "")
            fmt = fmt[3:].lstrip(", ")
        tries.append(F.try_to_timestamp(value, F.lit(fmt)))
    return F.coalesce(*tries)
