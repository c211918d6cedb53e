"""Ranking models as column expressions.

A model gives a score to a (document, query term) pair. ``present`` is the
score when the document has the term. A candidate lacking the term gets a
default, written in one of two ways:

* ``absent_term + absent_doc``, where the first part depends on the term only
  and the second on the document only, so that a whole query's defaults are
  two sums and need no (candidate x term) rows;
* ``absent``, any expression, evaluated per (candidate, term).

A model with neither has default 0.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Pair(NamedTuple):
    """The columns a model may use."""

    tf: Column
    dl: Column
    df: Column
    ctf: Column
    n_docs: Column
    cl: Column
    avg_dl: Column


Expr = Callable[[Pair], Column]


class Model(NamedTuple):
    name: str
    present: Expr
    absent_term: Expr | None = None
    absent_doc: Expr | None = None
    absent: Expr | None = None
    # Further per-pair values summed beside the score: name -> (present, absent).
    extras: dict[str, tuple[Expr, Expr]] = {}
    # The model compares whole vectors rather than adding up term scores.
    cosine: bool = False


# The default parameters.
BM25_K1, BM25_B = 1.6, 0.5
DIRICHLET_MU = 1000.0
JELINEK_LAMBDA = 0.1
RISK_LAMBDA = 0.1
SMALLEST = 4.9e-324  # the smallest positive double


def idf(p: Pair, kind: str = "log2") -> Column:
    if kind == "log2":
        return F.log2(p.n_docs / p.df)
    if kind == "ln_plus1":
        return F.log(p.n_docs / (p.df + 1))
    raise ValueError(f"unknown idf: {kind}")


def tf_idf(idf_kind: str = "log2") -> Model:
    return Model("tf_idf", lambda p: p.tf / p.dl * idf(p, idf_kind))


def vector_space() -> Model:
    """Cosine of the raw term-frequency vectors of query and document."""
    return Model("vector_space", lambda p: p.tf.cast("double"), cosine=True)


def bm25(k1: float | Column = BM25_K1, b: float | Column = BM25_B) -> Model:
    k1, b = _number(k1), _number(b)

    def present(p: Pair) -> Column:
        rarity = F.log2((p.n_docs - p.df + 0.5) / (p.df + 0.5))
        return rarity * (p.tf * (k1 + 1)) / (p.tf + k1 * (1 - b + b * p.dl / p.avg_dl))

    return Model("bm25", present)


def dirichlet(mu: float | Column = DIRICHLET_MU) -> Model:
    mu = _number(mu)
    return Model(
        "dirichlet",
        present=lambda p: F.log((p.tf + mu * p.ctf / p.cl) / (p.dl + mu)),
        absent_term=lambda p: F.log(mu * p.ctf / p.cl),
        absent_doc=lambda p: -F.log(p.dl + mu),
    )


def jelinek_mercer(lam: float | Column = JELINEK_LAMBDA) -> Model:
    lam = _number(lam)
    return Model(
        "jelinek_mercer",
        present=lambda p: F.log((1 - lam) * p.tf / p.dl + lam * p.ctf / p.cl),
        absent_term=lambda p: F.log(lam * p.ctf / p.cl),
        absent_doc=lambda p: F.lit(0.0),
    )


def _posterior(p: Pair, lam: float | Column) -> tuple[Column, Column]:
    """Mean and variance of the smoothed term probability (a Dirichlet posterior)."""
    u = p.dl * lam / (1 - lam)
    t = p.tf + u * p.ctf / p.cl
    d = p.dl + u
    # A document made of one term only would reach 1, where the logit has no value.
    m = F.least(t / d, F.lit(1.0 - 1e-12))
    v = t * (d - t) / (d * d * (d + 1))
    return m, v


def risk_adjusted(a: float | Column = 0.0, lam: float | Column = RISK_LAMBDA) -> Model:
    """Log-odds of the posterior with a penalty of ``a`` standard deviations."""
    a, lam = _number(a), _number(lam)

    def mean(p: Pair) -> Column:
        m, v = _posterior(p, lam)
        return F.log(m / (1 - m)) + (2 * m - 1) * v / (2 * m * m * (1 - m) * (1 - m))

    def variance(p: Pair) -> Column:
        m, v = _posterior(p, lam)
        return v / (m * m * (1 - m) * (1 - m))

    def score(p: Pair) -> Column:
        return mean(p) - a * F.sqrt(variance(p))

    def without(expr: Expr) -> Expr:
        return lambda p: expr(p._replace(tf=F.lit(0.0)))

    return Model(
        "risk_adjusted",
        present=score,
        absent=without(score),
        extras={"mean": (mean, without(mean)), "variance": (variance, without(variance))},
    )


def risk_adjusted_plain(a: float | Column = 0.0, lam: float | Column = RISK_LAMBDA) -> Model:
    """The same posterior without the log-odds step."""
    a, lam = _number(a), _number(lam)

    def score(p: Pair) -> Column:
        m, v = _posterior(p, lam)
        lowered = F.greatest(m - a * F.sqrt(v), F.lit(SMALLEST))
        return F.when(F.lit(a) == 0, F.log(m)).otherwise(F.log(lowered))

    return Model(
        "risk_adjusted_plain", present=score, absent=lambda p: score(p._replace(tf=F.lit(0.0)))
    )


# The model numbers of the command line, in order.
MODELS = (tf_idf, vector_space, bm25, dirichlet, jelinek_mercer, risk_adjusted)


def _number(value: float | Column) -> float | Column:
    return value if isinstance(value, Column) else float(value)
