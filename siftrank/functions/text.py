"""Tokenizing and stop words on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: a token is a run of letters, cut into pieces of at most 255.
LETTER_RUN = r"(\p{L}{1,255})"
# The same runs and everything between them, for offsets.
LETTER_RUN_OR_GAP = r"(\p{L}{1,255}|[^\p{L}]+)"


def letter_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER_RUN), F.lit(1))


def whitespace_tokens(text: Column) -> Column:
    """Maximal runs of non-space characters, case kept."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


TOKENIZERS = {"letters": letter_tokens, "whitespace": whitespace_tokens}


def without_words(tokens: Column, words: Sequence[str], ignore_case: bool = False) -> Column:
    """The token array with every token found in ``words`` taken out."""
    if ignore_case:
        folded = [w.lower() for w in words]
        return F.filter(tokens, lambda t: ~F.lower(t).isin(folded))
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def default_stop_words() -> list[str]:
    """Spark's own English stop list; any other list is a parameter."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
