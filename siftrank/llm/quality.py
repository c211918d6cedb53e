"""Quality rules: text statistics and robust multivariate outliers.

Every text gets base statistics; texts that are short or repeat themselves fail
at once. For the others a vector of transformed statistics is judged against the
minimum-covariance-determinant estimate of its language and source: a location and
scatter from the half of the rows that lie closest together, found by
concentration steps. A row too far away by Mahalanobis distance is rejected.

The steps run for all groups at once over a narrow table with one row per document.
A step is two aggregates with map-side sums: one gives the half's radius from a
histogram of distances with a fixed number of bins, the other the moments inside
that radius. So a group may hold any share of the rows; no group is ever gathered.
A group's estimate is pooled with that of its language, and that one with the whole
table's, each by a fixed prior weight, so small groups need no rule of their own.

Null text is an empty one, a null language or source is a group like any other,
repeated rows count as often as they occur, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftrank.llm.common import WORD_SPACE, by_batch, carried, stored, table, text_of

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: The vector's statistics and the standard deviation that each is credited with besides
#: what is seen, so that one that is zero for most rows does not make all others outliers.
FEATURES = {
    "f_length": 0.5,
    "f_word": 0.15,
    "f_symbols": 0.06,
    "f_lines": 0.25,
    "f_repeats": 0.25,
    "f_distinct": 0.15,
}

#: The share of a group's rows that its estimate rests on, the share of a normal group
#: that lies within the cutoff, the rows that a prior estimate weighs as much as.
CORE_SHARE = 0.5
KEPT_SHARE = 0.9999
PRIOR_ROWS = 100.0
STEPS = 4

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines"]
_PAIRS = [(a, b) for k, a in enumerate(FEATURES) for b in list(FEATURES)[k:]]
_SUMS = [f"s_{a}" for a in FEATURES] + [f"s_{a}_{b}" for a, b in _PAIRS]


def repeated_words(words: Sequence[bytes], width: int = 3) -> int:
    """How many words lie in a window of ``width`` words found twice or more."""
    grams = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for start, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += start + width - max(start, end)
            end = start + width
    return covered


def text_statistics(text: str) -> tuple[int, ...]:
    """The base statistics of one text, in the order of the result's columns."""
    words = text.encode().split()
    seen: set[str] = set()
    repeated = 0
    lines = text.split("\n")
    for line in lines:
        if line in seen:
            repeated += bool(line.strip(WORD_SPACE))
        else:
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, WORD_SPACE)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        repeated_words(words),
        len(set(words)),
        len(lines),
    )


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = np.array([text_statistics(t) for t in batch.column("text").to_pylist()], dtype=np.int64)
    kept = [k for k, name in enumerate(batch.schema.names) if name != "text"]
    return pa.RecordBatch.from_arrays(
        [batch.column(k) for k in kept] + [pa.array(c) for c in made.reshape(-1, len(_BASE)).T],
        names=[batch.schema.names[k] for k in kept] + _BASE,
    )


def base_statistics(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Base statistics of each row, with its group and the columns ``carry`` in ``row``."""
    rows = docs.select(
        carried(docs, carry).alias("row"),
        F.coalesce(F.col("lang").cast("string"), F.lit("\x00")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("source"),
        text_of().alias("text"),
    )
    schema = rows.drop("text").schema
    for name in _BASE:
        schema = schema.add(name, "long")
    return by_batch(rows, _measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """The transformed vector: logarithms and variance-stabilised shares."""

    def share(part: Column, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))

    n = F.col("n_words")
    return stats.withColumns({
        "f_length": F.log1p(n),
        "f_word": F.log((F.col("word_chars") + 1) / (n + 1)),
        "f_symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "f_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "f_repeats": share(F.col("n_repeat_words"), n),
        # different words grow as a power of the length
        "f_distinct": F.log((F.col("n_distinct_words") + 1) / F.pow(n + 1, F.lit(0.85))),
    })


def chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def _consistency(share: float) -> float:
    """What the scatter of a normal sample's central ``share`` is multiplied by."""
    p = len(FEATURES)
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


_GROUP = ["lang", "source"]


def _upper_bins(counts: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The first bin up to which at least ``share`` of a key's rows lie.

    ``counts`` has a row per key and bin; there is a fixed number of bins.
    """
    key = Window.partitionBy(*keys)
    return (
        counts.withColumn("so_far", F.sum("n").over(key.orderBy("bin")))
        .withColumn("all", F.sum("n").over(key))
        .where(F.col("so_far") >= F.ceil(F.col("all") * share))
        .groupBy(*keys).agg(F.min("bin").alias("upper"))
    )


def _medians(rows: DataFrame) -> DataFrame:
    """Each group's medians, to 1/256; the start of the concentration steps."""
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.floor(F.col(a) * 256).alias("bin")) for k, a in enumerate(FEATURES)
    ]))
    counts = rows.select(*_GROUP, each.alias("x")).groupBy(*_GROUP, "x.k", "x.bin").agg(F.count("*").alias("n"))
    middle = _upper_bins(counts, [*_GROUP, "k"], 0.5)
    p = len(FEATURES)
    identity = [1 / floor if i == j else 0.0 for i, floor in enumerate(FEATURES.values()) for j in range(p)]
    return middle.groupBy(*_GROUP).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "upper"))), lambda x: (x["upper"] + 0.5) / 256).alias("mean"),
        F.array(*map(F.lit, identity)).alias("white"),
    )


def _with_distance(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Each row's Mahalanobis distance from its group's estimate."""
    p = len(FEATURES)
    centred = [F.col(a) - F.col("mean")[k] for k, a in enumerate(FEATURES)]
    along = [sum((F.col("white")[i * p + j] * centred[j] for j in range(p)), F.lit(0.0)) for i in range(p)]
    length = F.sqrt(sum((x * x for x in along), F.lit(0.0)))
    return rows.join(fitted, _GROUP, "left").withColumn("distance", length).drop("mean", "white")


#: Bins of distances, even on a logarithmic scale between these bounds.
_BINS, _LOW, _HIGH = 8192, 1e-4, 1e4


def _core(rows: DataFrame) -> DataFrame:
    """The rows of each group within the least radius that holds the core's share."""
    width = math.log(_HIGH / _LOW) / _BINS
    place = F.floor(F.log(F.greatest(F.col("distance"), F.lit(_LOW)) / _LOW) / width)
    binned = rows.withColumn("bin", F.least(place, F.lit(_BINS)))
    counts = binned.groupBy(*_GROUP, "bin").agg(F.count("*").alias("n"))
    return binned.join(_upper_bins(counts, _GROUP, CORE_SHARE), _GROUP).where("bin <= upper")


def _pooled(sums: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None):
    """Location and scatter from a count and sums, pooled with a prior estimate."""
    p = len(FEATURES)
    n, first, second = sums[0], sums[1 : p + 1], np.zeros((p, p))
    second[np.triu_indices(p)] = sums[p + 1 :]
    second = np.triu(second) + np.triu(second, 1).T
    if prior is None:
        mean = first / n
        return mean, second / n - np.outer(mean, mean)
    mean = (first + PRIOR_ROWS * prior[0]) / (n + PRIOR_ROWS)
    own = second - np.outer(first, mean) - np.outer(mean, first) + n * np.outer(mean, mean)
    gap = prior[0] - mean
    return mean, (own + PRIOR_ROWS * (prior[1] + np.outer(gap, gap))) / (n + PRIOR_ROWS)


def _whitening(cov: np.ndarray) -> np.ndarray:
    """The matrix whose product with a centred row has the row's Mahalanobis length."""
    p = len(FEATURES)
    # what a normal sample's core is scaled by to have the sample's own scatter
    scale = CORE_SHARE / chi2_cdf(chi2_quantile(CORE_SHARE, p), p + 2)
    values, vectors = np.linalg.eigh(scale * cov + np.diag(np.square(list(FEATURES.values()))))
    return (vectors / np.sqrt(values)).T


def _fitted(core: DataFrame) -> DataFrame:
    """Location and whitening matrix of each group from the rows of its core."""
    sums = ["n", *_SUMS]
    groups = core.groupBy(*_GROUP).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(a).alias(f"s_{a}") for a in FEATURES],
        *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _PAIRS],
    )
    groups = stored(groups, "moments")
    languages = groups.groupBy("lang").agg(*[F.sum(x).alias(f"l_{x}") for x in sums])
    whole = languages.agg(*[F.sum(f"l_{x}") for x in sums]).first()  # one row
    if whole[0] is None:
        return groups.select(*_GROUP, F.array().cast("array<double>").alias("mean"), F.array().cast("array<double>").alias("white"))
    of_all = _pooled(np.array(whole, dtype=float), None)

    def estimate(batches):
        for batch in batches:
            means, whites = [], []
            own, of_language = batch[sums].to_numpy(), batch[[f"l_{x}" for x in sums]].to_numpy()
            for row, above in zip(own, of_language, strict=True):
                mean, cov = _pooled(row, _pooled(above, of_all))
                means.append(mean.tolist())
                whites.append(_whitening(cov).ravel().tolist())
            yield batch[_GROUP].assign(mean=means, white=whites)

    return groups.join(languages, "lang").mapInPandas(
        estimate, "lang string, source string, mean array<double>, white array<double>"
    )


def cutoff() -> float:
    return math.sqrt(chi2_quantile(KEPT_SHARE, len(FEATURES)))


def judge(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every row's statistics and verdict.

    Columns: ``row`` (struct of the columns ``carry``), the base statistics,
    ``base_failed``, ``distance`` (null where the base rules fail) and ``kept``.
    """
    rows = stored(with_features(base_statistics(docs, carry)).withColumn("base_failed", base_failed()), "quality")
    sound = rows.where(~F.col("base_failed")).select(*_GROUP, *FEATURES)
    fitted = stored(_medians(sound), "location")
    for _ in range(STEPS):
        fitted = stored(_fitted(_core(_with_distance(sound, fitted))), "location")
    far = F.when(~F.col("base_failed"), F.col("distance"))
    return (
        _with_distance(rows, fitted)
        .withColumn("distance", far)
        .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff()))
        .select("row", *_BASE, "base_failed", "distance", F.coalesce("kept", F.lit(False)).alias("kept"))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return judge(docs, docs.columns).where("kept").select("row.*")


def query(spark, folder: str) -> DataFrame:
    """``op5``: the verdict on every document."""
    return judge(table(spark, folder, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance",
    )
