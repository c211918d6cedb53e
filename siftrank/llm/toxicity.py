"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguise: case, accents, look-alike letters of other scripts, and digits
or signs that stand for letters within a word. The lexicon has words and beginnings of
words. An entry's weight is the lower confidence bound of its log odds between labelled
documents, where a toxic passage that is copied often counts once (by a sketch of the
surroundings), so what a few copies happen to share weighs little. One automaton finds all
entries at starts of words in one pass; of the entries that match a word the weightiest
counts. Phrases of an entry and a neighbour that labelled clean documents hold and toxic
ones do not are exceptions: an entry inside one does not count. The weightiest words, their
sum over the text's length and the length make the score by a logistic curve.

The curve is fitted on weights learned without the fold of the document they score, or it
would trust words that only the training documents happen to share.

Fitting uses a sample of at most ``SAMPLE`` labelled rows of either label, the first by a
hash of their id, which bounds the lexicon too; counting runs as Spark aggregates, and only
the lexicon and three numbers a sampled row reach the driver. Every document is scored, whole.

Null and empty texts, and texts without a word, are scored like a text without a hit; a
null doc_id counts as an empty one. Labels that contradict count as toxic. Without labels
of both kinds there is no lexicon and every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import by_batch, stored, table, text_of

FOLDS = 5
HELD_OUT = 0
SAMPLE = 10_000
PREFIXES = range(4, 9)
LEAST_DOCS = 2
LEAST_WEIGHT = 0.5
BOUND_DEVIATIONS = 1.5
LEAST_EXCEPTIONS = 5

#: Letters of other scripts and signs by the Latin letter they look like.
LOOKALIKES = {
    "a": "аα@4", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еε3€", "g": "ɡ", "h": "һ", "i": "іιı1!|", "j": "ј", "k": "кκ",
    "m": "м", "n": "η", "o": "оο0", "p": "рρ", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ν", "w": "ѡω", "x": "хχ", "y": "уγ", "z": "ʐ",
}
_FOLD = str.maketrans({sign: letter for letter, signs in LOOKALIKES.items() for sign in signs if sign.isalpha()})
_SIGNS = str.maketrans({sign: letter for letter, signs in LOOKALIKES.items() for sign in signs if not sign.isalpha()})
_DISGUISED = re.compile(r"(?=[^\W_]*[@€!|$0-9])[^\W\d_][\w@€!|$]*[^\W_]|[@€$0-9][\w@€!|$]*[^\W\d_]\w*")
_WORDS = re.compile(r"[^\W\d_]+")


def folded_words(text: str) -> list[str]:
    """The words of a text without disguise, in order."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
        text = "".join([c for c in text if not unicodedata.combining(c)])
    text = _DISGUISED.sub(lambda m: m[0].translate(_SIGNS), text)
    return _WORDS.findall(text)


def surroundings(words: list[str], width: int = 1) -> dict[str, int]:
    """Each run of ``width`` words with a 64-bit sketch of the words around it."""
    padded = ["", *words, ""]
    seen: dict[str, int] = {}
    for k in range(1, len(words) - width + 2):
        run = " ".join(padded[k : k + width])
        around = zlib.crc32(f"{padded[k - 1]} {padded[k + width]}".encode())
        seen[run] = seen.get(run, 0) | 1 << (around & 63)
    return seen


def distinct(sketch: int, at_most: int) -> float:
    """About how many surroundings a sketch holds: a passage copied often has one."""
    unset = 64 - (sketch & (1 << 64) - 1).bit_count()
    return min(float(at_most), 64 * math.log(64 / unset)) if unset > 4 else float(at_most)


def entries_of(words: dict[str, int]) -> dict[str, int]:
    """Possible entries: the words, and their beginnings marked with a star."""
    made = dict(words)
    for word, sketch in words.items():
        for size in PREFIXES:
            if len(word) <= size:
                break
            entry = word[:size] + "*"
            made[entry] = made.get(entry, 0) | sketch
    return made


_SEEN = "fold int, label int, n long, sketch long"


def _counter(of) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Counts of what ``of`` finds in a text: documents by fold and label, and sketches."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, int, int], list[int]] = {}
        for text, fold, label in zip(*(batch.column(n).to_pylist() for n in ("text", "fold", "label")), strict=True):
            for item, sketch in of(text).items():
                count = counts.setdefault((item, fold, label), [0, 0])
                count[0] += 1
                count[1] |= sketch
        item, fold, label = zip(*counts, strict=True) if counts else ((), (), ())
        n, sketches = zip(*counts.values(), strict=True) if counts else ((), ())
        signed = [x - (1 << 64) if x >> 63 else x for x in sketches]
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.string()), pa.array(fold, pa.int32()), pa.array(label, pa.int32()), pa.array(n, pa.int64()), pa.array(signed, pa.int64())],
            names=["item", "fold", "label", "n", "sketch"],
        )

    return run


def _counted(sample: DataFrame, of) -> DataFrame:
    """Per item: ``n<fold>_<label>`` documents and ``s<fold>_<label>`` sketches."""
    rows = by_batch(sample, _counter(of), f"item string, {_SEEN}")
    parts = []
    for fold in range(FOLDS):
        for label in (0, 1):
            here = (F.col("fold") == fold) & (F.col("label") == label)
            parts.append(F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"n{fold}_{label}"))
            parts.append(F.bit_or(F.when(here, F.col("sketch")).otherwise(0)).alias(f"s{fold}_{label}"))
    return rows.groupBy("item").agg(*parts)


def _of_folds(row, label: int, held: int | None = None) -> tuple[int, float]:
    """Documents, and different surroundings, outside the held fold."""
    folds = [fold for fold in range(FOLDS) if fold != held]
    n, sketch = sum(row[f"n{fold}_{label}"] for fold in folds), 0
    for fold in folds:
        sketch |= row[f"s{fold}_{label}"]
    return n, distinct(sketch, n)


def weight(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Lower bound of the log odds of an entry seen in so many documents of all."""
    odds = math.log((toxic + 0.05) / (all_toxic + 0.1)) - math.log((clean + 0.5) / (all_clean + 1.0))
    return odds - BOUND_DEVIATIONS * math.sqrt(1 / (toxic + 0.05) + 1 / (clean + 0.5))


class Lexicon:
    """Entries with a weight for each held fold (last: none held), and exceptions."""

    def __init__(self, entries: list[str], weights: list[list[float]], exceptions: list[str]):
        self.entries, self.weights, self.exceptions = entries, weights, exceptions
        self.automaton = None

    def __getstate__(self):
        return self.entries, self.weights, self.exceptions

    def __setstate__(self, state):
        self.__init__(*state)

    def _compile(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, entry in enumerate(self.entries):
            self.automaton.add_word(" " + (entry[:-1] if entry[-1] == "*" else entry + " "), k)
        for phrase in self.exceptions:
            self.automaton.add_word(f" {phrase} ", -1 - len(phrase))
        self.automaton.make_automaton()

    def hits(self, words: list[str]) -> tuple[str, dict[int, list[int]]]:
        """The words as one string and, by the place of each word hit, its entries."""
        if self.automaton is None:
            self._compile()
        line = f" {' '.join(words)} "
        found: dict[int, list[int]] = {}
        excepted: list[tuple[int, int]] = []
        if self.entries and words:
            for end, k in self.automaton.iter(line):
                if k < 0:
                    excepted.append((end + k, end))
                else:
                    entry = self.entries[k]
                    found.setdefault(end - (len(entry) - 2 if entry[-1] == "*" else len(entry)), []).append(k)
        for first, last in excepted:
            for at in [at for at in found if first <= at <= last]:
                del found[at]
        return line, found

    def features(self, text: str, fold: int) -> tuple[float, float, float]:
        words = folded_words(text)
        line, found = self.hits(words)
        best: dict[str, float] = {}
        total = 0.0
        for at, entries in found.items():
            w = max(self.weights[k][fold] for k in entries)
            if w >= LEAST_WEIGHT:
                total += w
                word = line[at : line.index(" ", at)]
                best[word] = max(best.get(word, 0.0), w)
        top = sorted(best.values(), reverse=True)[:2] + [0.0, 0.0]
        return top[0], top[1], math.log1p(100 * total / (len(words) + 50.0))


def _logistic_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients with an intercept first, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fold_of() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text``, ``fold`` and ``label`` of the sampled rows of the training folds."""
    told = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .withColumn("fold", fold_of()).where(F.col("fold") != HELD_OUT)
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [told.where(F.col("label") == label).orderBy(*order).limit(SAMPLE) for label in (0, 1)]
    chosen = stored(first[0].unionByName(first[1]), "sample")
    return docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").select("text", "fold", "label")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the curve of the score, from labelled documents."""
    sample = stored(_sample(docs, labels).repartition(F.xxhash64("text")), "labelled")
    sizes = Counter({(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()})
    all_of = [sum(n for (_, label), n in sizes.items() if label == k) for k in (0, 1)]
    if not all(all_of):
        return Lexicon([], [], []), np.array([-30.0, 0.0, 0.0, 0.0])
    rows = _counted(sample, lambda text: entries_of(surroundings(folded_words(text))))
    toxic = sum((F.col(f"n{fold}_1") for fold in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"n{fold}_0") for fold in range(FOLDS)), F.lit(0))
    odds = F.log((toxic + 0.05) / (all_of[1] + 0.1)) - F.log((clean + 0.5) / (all_of[0] + 1.0))
    bound = odds - BOUND_DEVIATIONS * F.sqrt(1 / (toxic + 0.05) + 1 / (clean + 0.5))
    found = rows.where((toxic >= LEAST_DOCS) & (bound >= LEAST_WEIGHT)).orderBy("item").collect()  # bounded by the sample
    learned: dict[str, list[float]] = {}
    for row in sorted(found, key=lambda r: (len(r["item"]) if r["item"][-1] == "*" else 99, r["item"])):
        own = []
        for held in [*range(FOLDS), None]:
            of = [sum(sizes[fold, label] for fold in range(FOLDS) if fold != held) for label in (0, 1)]
            own.append(weight(_of_folds(row, 1, held)[1], _of_folds(row, 0, held)[0], of[1], of[0]))
        item = row["item"].rstrip("*")
        shorter = [learned[b] for b in (item[:size] + "*" for size in PREFIXES if size < len(item)) if b in learned]
        # what a shorter beginning tells as well needs no entry of its own
        if own[-1] >= LEAST_WEIGHT and all(own[-1] > w[-1] + 0.1 for w in shorter):
            learned[row["item"]] = own
    weights = list(learned.values())
    lexicon = Lexicon(list(learned), weights, [])
    lexicon = Lexicon(lexicon.entries, weights, _exceptions(sample, lexicon))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [lexicon.features(t, f) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
        columns = [pa.array([row[k] for row in made], pa.float64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*columns, batch.column("label")], names=["a", "b", "c", "label"])

    points = by_batch(sample, measured, "a double, b double, c double, label int").collect()
    data = np.array(sorted(map(tuple, points)), dtype=float)
    return lexicon, _logistic_fit(data[:, :3], data[:, 3])


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of an entry and its neighbour that only clean documents hold."""

    def phrases(text: str) -> dict[str, int]:
        words = folded_words(text)
        line, found = lexicon.hits(words)
        hit = {line[at : line.index(" ", at)] for at in found}
        return {p: s for p, s in surroundings(words, 2).items() if hit.intersection(p.split())} if hit else {}

    toxic = sum((F.col(f"n{fold}_1") for fold in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"n{fold}_0") for fold in range(FOLDS)), F.lit(0))
    seen = _counted(sample, phrases).where((clean >= LEAST_EXCEPTIONS) & (toxic == 0)).orderBy("item").collect()
    return [row["item"] for row in seen if _of_folds(row, 0)[1] >= LEAST_EXCEPTIONS]


def score(docs: DataFrame, lexicon: Lexicon, curve: np.ndarray) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([(1.0, *lexicon.features(t, FOLDS)) for t in batch.column("text").to_pylist()])
        p = 1 / (1 + np.exp(-np.clip(made.reshape(-1, 4) @ curve, -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (fold_of() == HELD_OUT).alias("held_out"), text_of().alias("text"))
    schema = rows.select("doc_id", "held_out").schema.add("score", "double")
    return by_batch(rows, run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, folder: str) -> DataFrame:
    """``op8``: every document's toxicity."""
    docs = table(spark, folder, "documents")
    return score(docs, *fit(docs, table(spark, folder, "labels")))
