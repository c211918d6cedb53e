"""Porter's algorithm for one word, letter by letter: what the column work is held against."""

from __future__ import annotations

import re

from siftrank.functions.porter import STEP_2, STEP_3, STEP_4

_RESTORE_E = ("at", "bl", "iz")


def _longest_first(suffixes):
    return re.compile("(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + r")\Z")


_STEP_2, _STEP_2_MAP = _longest_first([s for s, _ in STEP_2]), dict(STEP_2)
_STEP_3, _STEP_3_MAP = _longest_first([s for s, _ in STEP_3]), dict(STEP_3)
_STEP_4 = _longest_first(STEP_4)


def shape(word: str) -> str:
    """``c`` or ``v`` per letter; ``y`` is a vowel only after a consonant."""
    out = []
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How many vowel-to-consonant passages the stem has."""
    return shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_syllable(word: str) -> bool:
    """Ends consonant-vowel-consonant with the last letter not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if not _has_vowel(stem):
                return word
            if stem.endswith(_RESTORE_E):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            if measure(stem) == 1 and _short_syllable(stem):
                return stem + "e"
            return stem
    return word


def _final_y(word: str) -> str:
    return word[:-1] + "i" if word.endswith("y") and _has_vowel(word[:-1]) else word


def _replace(word: str, pattern: re.Pattern, table: dict[str, str]) -> str:
    found = pattern.search(word)
    if found and measure(word[: found.start()]) > 0:
        return word[: found.start()] + table[found.group()]
    return word


def _long_suffix(word: str) -> str:
    found = _STEP_4.search(word)
    if not found:
        return word
    stem = word[: found.start()]
    if found.group() == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem if measure(stem) > 1 else word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        size = measure(stem)
        if size > 1 or (size == 1 and not _short_syllable(stem)):
            word = stem
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_word(word: str) -> str:
    if len(word) < 3:
        return word
    word = _final_y(_past_and_progressive(_plural(word)))
    word = _replace(word, _STEP_2, _STEP_2_MAP)
    word = _replace(word, _STEP_3, _STEP_3_MAP)
    return _tidy(_long_suffix(word))
