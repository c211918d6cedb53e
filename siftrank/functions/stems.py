"""Porter stems as column work: the steps of the algorithm as conditions over a word
and its shape, the tables of suffixes from :mod:`siftrank.functions.porter`.

Meant for vocabularies, where each different word occurs once. Every step is a
projection of its own, so that expressions do not nest.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from siftrank.functions.porter import STEP_2, STEP_3, STEP_4

def _shape(word: Column) -> Column:
    """``1`` for a vowel and ``0`` for a consonant; y is a vowel after a consonant."""
    letters = F.regexp_extract_all(word, F.lit("(?s)(.)"), F.lit(1))

    def add(shape: Column, letter: Column) -> Column:
        vowel = letter.isin(*"aeiou") | ((letter == "y") & shape.endswith("0"))
        return F.concat(shape, F.when(vowel, "1").otherwise("0"))

    return F.aggregate(letters, F.lit(""), add)


def _less(text: Column, n: Column | int) -> Column:
    """``text`` without its last ``n`` letters."""
    return F.substr(text, F.lit(1), F.length(text) - n)


def _measure(shape: Column) -> Column:
    return F.regexp_count(shape, F.lit("10"))


def _short(word: Column, shape: Column) -> Column:
    return shape.endswith("010") & ~word.rlike(r"[wxy]\z")


def _longest(word: Column, suffixes: Iterable[str]) -> Column:
    return F.regexp_extract(word, "(" + "|".join(sorted(suffixes, key=len, reverse=True)) + r")\z", 1)


def _looked_up(found: Column, table: Iterable[tuple[str, str]]) -> Column:
    pairs = [F.lit(part) for pair in table for part in pair]
    return F.try_element_at(F.create_map(*pairs), found)


def with_stems(words: DataFrame, term: str = "term", stem: str = "stem") -> DataFrame:
    """``words`` with the stem of each ``term``; null stays null."""
    w, s, part, shape = (F.col(name) for name in ("_w", "_s", "_part", "_shape"))

    def step(df: DataFrame, changed: Column) -> DataFrame:
        return df.withColumn("_w", changed).withColumn("_s", _shape(w))

    df = words.withColumn("_w", F.col(term))
    df = step(df, F.when(w.rlike(r"(ss|i)es\z"), _less(w, 2)).when(w.rlike(r"[^s]s\z"), _less(w, 1)).otherwise(w))
    cut = F.when(w.rlike(r"eed\z"), 0).when(w.rlike(r"ed\z"), 2).when(w.rlike(r"ing\z"), 3).otherwise(0)
    df = df.withColumn("_cut", cut).withColumns({"_part": _less(w, F.col("_cut")), "_shape": _less(s, F.col("_cut"))})
    df = step(
        df,
        F.when(w.rlike(r"eed\z"), F.when(_measure(_less(s, 3)) > 0, _less(w, 1)).otherwise(w))
        .when((F.col("_cut") == 0) | ~shape.contains("1"), w)
        .when(part.rlike(r"(at|bl|iz)\z"), F.concat(part, F.lit("e")))
        .when(part.rlike(r"(.)\1\z") & shape.endswith("0"), F.when(part.rlike(r"[lsz]\z"), part).otherwise(_less(part, 1)))
        .when((_measure(shape) == 1) & _short(part, shape), F.concat(part, F.lit("e")))
        .otherwise(part),
    )
    df = step(df, F.when(w.endswith("y") & _less(s, 1).contains("1"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w))
    for table in (STEP_2, STEP_3):
        df = df.withColumn("_found", _longest(w, dict(table))).withColumn("_shape", _less(s, F.length("_found")))
        changed = F.concat(_less(w, F.length("_found")), _looked_up(F.col("_found"), table))
        df = step(df, F.when((F.col("_found") != "") & (_measure(shape) > 0), changed).otherwise(w))
    df = df.withColumn("_found", _longest(w, STEP_4)).withColumns(
        {"_part": _less(w, F.length("_found")), "_shape": _less(s, F.length("_found"))}
    )
    long = (F.col("_found") != "") & (_measure(shape) > 1) & ((F.col("_found") != "ion") | part.rlike(r"[st]\z"))
    df = step(df, F.when(long, part).otherwise(w))
    df = df.withColumns({"_part": _less(w, 1), "_shape": _less(s, 1)})
    silent = w.endswith("e") & ((_measure(shape) > 1) | ((_measure(shape) == 1) & ~_short(part, shape)))
    df = step(df, F.when(silent, part).otherwise(w))
    df = step(df, F.when(w.endswith("ll") & (_measure(_less(s, 1)) > 1), _less(w, 1)).otherwise(w))
    made = F.when(F.length(term) < 3, F.col(term)).otherwise(w)
    return df.withColumn(stem, made).drop("_w", "_s", "_cut", "_part", "_shape", "_found")
