"""Porter stems in SQL, step by step over a table ``voc`` of terms.

Written apart from the column work: suffixes are tried one by one, and a word's shape is
spelt with c and v.
"""

from __future__ import annotations

from siftrank.functions.porter import STEP_2, STEP_3, STEP_4

TERMS = r"""WITH voc AS MATERIALIZED (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents
)"""


def _shape(word: str) -> str:
    vowel = "x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(a, 1) = 'c')"
    return (
        f"list_reduce(list_concat([''], string_split({word}, '')), "
        f"lambda a, x: a || CASE WHEN {vowel} THEN 'v' ELSE 'c' END)"
    )


def _cut(n: int, of: str = "w") -> str:
    return f"substr({of}, 1, length({of}) - {n})"


def _size(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'vc'))"


def _swap(table) -> str:
    rules = sorted(table, key=lambda rule: -len(rule[0]))
    return " ".join(
        f"WHEN suffix(w, '{old}') THEN CASE WHEN {_size(_cut(len(old), 's'))} > 0 THEN {_cut(len(old))} || '{new}' ELSE w END"
        for old, new in rules
    )


def _without(n: int) -> str:
    """Step 1b once its suffix of ``n`` letters is gone."""
    w, s = _cut(n), _cut(n, "s")
    return f"""CASE WHEN NOT contains({s}, 'v') THEN w
  WHEN suffix({w}, 'at') OR suffix({w}, 'bl') OR suffix({w}, 'iz') THEN {w} || 'e'
  WHEN right({w}, 1) = substr({w}, length({w}) - 1, 1) AND length({w}) > 1 AND right({s}, 1) = 'c'
    THEN CASE WHEN right({w}, 1) IN ('l', 's', 'z') THEN {w} ELSE {_cut(n + 1)} END
  WHEN {_size(s)} = 1 AND right({s}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y') THEN {w} || 'e'
  ELSE {w} END"""


def _long() -> str:
    rules = []
    for old in sorted(STEP_4, key=len, reverse=True):
        also = f" AND right({_cut(3)}, 1) IN ('s', 't')" if old == "ion" else ""
        rules.append(f"WHEN suffix(w, '{old}') THEN CASE WHEN {_size(_cut(len(old), 's'))} > 1{also} THEN {_cut(len(old))} ELSE w END")
    return " ".join(rules)


_E = f"""WHEN suffix(w, 'e') AND ({_size(_cut(1, 's'))} > 1 OR ({_size(_cut(1, 's'))} = 1
  AND NOT (right({_cut(1, 's')}, 3) = 'cvc' AND right({_cut(1)}, 1) NOT IN ('w', 'x', 'y')))) THEN {_cut(1)}"""

_STEPS = [
    f"WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_cut(1)}",
    f"WHEN suffix(w, 'eed') THEN CASE WHEN {_size(_cut(3, 's'))} > 0 THEN {_cut(1)} ELSE w END "
    f"WHEN suffix(w, 'ed') THEN {_without(2)} WHEN suffix(w, 'ing') THEN {_without(3)}",
    f"WHEN suffix(w, 'y') AND contains({_cut(1, 's')}, 'v') THEN {_cut(1)} || 'i'",
    _swap(STEP_2),
    _swap(STEP_3),
    _long(),
    _E,
    f"WHEN suffix(w, 'll') AND {_size(_cut(1, 's'))} > 1 THEN {_cut(1)}",
]


def _chain() -> str:
    parts = [f"p0 AS MATERIALIZED (SELECT term, term AS w, {_shape('term')} AS s FROM voc WHERE length(term) > 2)"]
    for k, rules in enumerate(_STEPS):
        parts.append(f"q{k} AS (SELECT term, CASE {rules} ELSE w END AS w FROM p{k})")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT term, w, {_shape('w')} AS s FROM q{k})")
    last = f"SELECT term, w AS stem FROM p{len(_STEPS)} UNION ALL SELECT term, term FROM voc WHERE length(term) < 3"
    return ",\n".join([*parts, f"stems AS MATERIALIZED ({last})"])


STEMS = _chain()
