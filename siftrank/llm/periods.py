"""Periodic runs of words, found online by catchers over power-of-two blocks.

A run is a stretch of words that repeats with its smallest period ``q``, is at least
``max(LEAST, TIMES * q)`` words long and cannot be made longer. Words are appended in
pieces of any size. On level ``k`` each completed block of ``2**k`` words has a catcher;
the suffix of ``2**k`` words that ends with each appended word is compared with the block
that lies ``q`` words back, for ``2**k <= q < 2**(k+1)``. A suffix that equals its block is
half a square; blocks in a row that are met again at one distance are a square, and
squares that continue each other merge into one stretch. Any run of four periods holds two such
blocks of the level of its period, wherever it starts. A stretch ends at the first
block not met; its two ends, less than a block away, are then found word by word.

Suffixes are compared by a 64-bit hash that the next level makes of two halves; the
stretches that come out are compared word by word, so a hash that happens to be equal
costs time and never a wrong run. Multiples of a period are left out as soon as the run of
the period itself is known, which keeps a text of one repeated word linear in each level.

A null text has no words, as an empty one; documents never touch each other. Rows alike are
treated alike. An empty table gives an empty result. Extra columns are ignored. A text is held by
one task, as it is in its row; beside its words there are a few numbers for each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Sequence
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from siftrank.llm.common import by_batch, sha256_hex, table, text_of

#: A run has at least so many words, and so many times its period.
LEAST = 6
TIMES = 4

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the double blocks made of ``left`` and ``right``."""
    mixed = (left ^ (left >> np.uint64(32))) * _ODD[0] + right
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    return mixed


class _Level:
    """The catchers of one block size: what was appended of the hashes of its suffixes,
    and the stretches still open, by distance."""

    def __init__(self, k: int) -> None:
        self.k, self.size = k, 1 << k
        self.tail = np.empty(0, np.uint64)  # hashes from the last completed block's start on
        self.first = 0  # where the first of them starts
        self.open: dict[int, tuple[int, int]] = {}  # distance -> first and last block met

    def append(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """New suffix hashes; gives the stretches (first block, last block, distance) that ended."""
        size, done = self.size, self.first + len(self.tail)
        held = np.concatenate([self.tail, hashes]) if len(self.tail) else hashes
        at = np.arange(max(done, size), done + len(hashes))  # starts of the suffixes to compare
        back = (at >> self.k) - 1
        met = at[held[at - self.first] == held[(back << self.k) - self.first]] if len(at) else at
        ended = self._stretched(met, done + len(hashes))
        keep = max(0, ((done + len(hashes)) >> self.k) - 1) << self.k
        self.tail, self.first = held[keep - self.first :], keep
        return ended

    def _stretched(self, met: np.ndarray, upto: int) -> list[tuple[int, int, int]]:
        ended = []
        if len(met):
            block = (met >> self.k) - 1
            distance = met - (block << self.k)
            order = np.lexsort((block, distance))
            block, distance = block[order], distance[order]
            cut = np.flatnonzero((distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)) + 1
            firsts, lasts = np.append(0, cut), np.append(cut, len(block)) - 1
            for a, b, q in zip(block[firsts].tolist(), block[lasts].tolist(), distance[firsts].tolist(), strict=True):
                before = self.open.get(q)
                if before and before[1] + 1 == a:
                    a = before[0]
                elif before:
                    ended.append((*before, q))
                self.open[q] = (a, b)
        # the suffix that would go on from block b to b + 1 starts at (b + 1) * size + q
        over = [q for q, (_, b) in self.open.items() if ((b + 1) << self.k) + q < upto]
        ended += [(*self.open.pop(q), q) for q in over]
        return ended

    def finish(self) -> list[tuple[int, int, int]]:
        ended = [(a, b, q) for q, (a, b) in self.open.items()]
        self.open.clear()
        return ended


class Catchers:
    """Runs of a sequence of words, given as numbers, that is appended to."""

    def __init__(self, least: int = LEAST, times: int = TIMES) -> None:
        if times < 4:
            raise ValueError("the blocks of a level are sure to be met twice from four periods on")
        self.least, self.times = least, times
        self.words = np.empty(0, np.int64)
        self.levels: list[_Level] = []
        self.halves: list[np.ndarray] = []  # hashes of a level that wait for their right halves
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by level: starts, ends, periods

    def append(self, words: np.ndarray) -> None:
        """The next words; squares that they complete are merged into runs."""
        self.words = np.concatenate([self.words, words]) if len(self.words) else np.asarray(words, np.int64)
        k, hashes = 0, _joined(np.asarray(words).astype(np.uint64), _ODD[0])
        ended = []
        while len(hashes) and (not k or self.times << k <= len(self.words)):
            if k == len(self.levels):
                self.levels.append(_Level(k))
                self.halves.append(np.empty(0, np.uint64))
                self.found.append((*(np.empty(0, np.int64) for _ in range(3)),))
                if k:  # the level starts late: all that its lower level has held back belongs to it
                    hashes = self._doubled(k - 1)
                    self.halves[k - 1] = self.halves[k - 1][len(hashes) :]
            ended.append((k, self.levels[k].append(hashes)))
            self.halves[k] = np.concatenate([self.halves[k], hashes])
            if k + 1 < len(self.levels):
                hashes = self._doubled(k)
                self.halves[k] = self.halves[k][len(hashes) :]
            k += 1
        for level, stretches in ended:
            self._merge(level, stretches)

    def _doubled(self, k: int) -> np.ndarray:
        size, held = 1 << k, self.halves[k]
        return _joined(held[:-size], held[size:]) if len(held) > size else np.empty(0, np.uint64)

    def _merge(self, k: int, stretches: list[tuple[int, int, int]]) -> None:
        """The ended stretches of a level that are runs, beside those known."""
        if not stretches:
            return
        a, b, q = np.array(stretches, np.int64).T
        start, end = a << k, ((b + 1) << k) + q  # all words in it repeat at distance q
        wide = end - start + 2 * (1 << k) > np.maximum(self.least, self.times * q)
        start, end, q = start[wide], end[wide], q[wide]
        for starts, ends, periods in self.found[:k]:  # a known run of a divisor of q that holds all of it
            if len(starts) and len(start):
                last = np.searchsorted(starts, start, "right") - 1
                inside = (last >= 0) & (ends[last] >= end) & (q % periods[last] == 0)
                start, end, q = start[~inside], end[~inside], q[~inside]
        made = []
        for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
            if (self.words[s : e - p] == self.words[s + p : e]).all():
                s, e = self._widened(s, e, p)
                if e - s >= max(self.least, self.times * p):
                    made.append((s, e, p))
            else:  # equal hashes of different words: seek in it word by word
                made += self._by_word(max(0, s - (1 << k)), min(len(self.words), e + (1 << k)), p)
        if made:
            joined = np.concatenate([np.stack(self.found[k]), np.array(made, np.int64).T], axis=1)
            joined = np.unique(joined, axis=1)  # sorted by start
            self.found[k] = (joined[0], joined[1], joined[2])

    def _widened(self, start: int, end: int, q: int) -> tuple[int, int]:
        words, step = self.words, 16
        while end < len(words):
            same = words[end : end + step] == words[end - q : min(end - q + step, len(words) - q)]
            n = len(same) if same.all() else int(same.argmin())
            end, step = end + n, step * 2
            if n < len(same):
                break
        step = 16
        while start:
            low = max(0, start - step)
            same = (words[low:start] == words[low + q : start + q])[::-1]
            n = len(same) if same.all() else int(same.argmin())
            start, step = start - n, step * 2
            if n < len(same):
                break
        return start, end

    def _by_word(self, low: int, high: int, q: int) -> list[tuple[int, int, int]]:
        same = (self.words[low : high - q] == self.words[low + q : high]).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
        made = [(*self._widened(int(a) + low, int(b) + low + q, q), q) for a, b in edges.reshape(-1, 2)]
        return [(a, b, q) for a, b, q in made if b - a >= max(self.least, self.times * q)]

    def runs(self) -> np.ndarray:
        """All runs of what was appended: start, end and smallest period, sorted."""
        for k, level in enumerate(self.levels):
            held = dict(level.open)
            self._merge(k, level.finish())
            level.open = held  # more may be appended
        found = np.concatenate([np.empty((3, 0), np.int64), *[np.stack(x) for x in self.found]], axis=1)
        found = found[:, np.lexsort((found[2], found[1], found[0]))]
        # a stretch of a multiple ends where its run does; one taken while open is not yet maximal
        first = np.ones(found.shape[1], bool)
        first[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
        found = found[:, first]
        words, n = self.words, len(self.words)
        maximal = [e == n or words[e] != words[e - q] for _, e, q in found.T.tolist()]
        return found[:, np.array(maximal, bool)].T


def find_runs(words: Sequence, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, sorted."""
    if len(words) < least:
        return []
    numbers: dict = defaultdict(count().__next__)
    catchers = Catchers(least, times)
    catchers.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    return [(s, e - s, q) for s, e, q in catchers.runs().tolist()]


def collapsed(words: list, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words less those of each run after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


Prepare = Callable[[object, list], list]


def _report(prepare: Prepare | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(7)]
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            words = text.encode().split()  # the six ASCII spaces only
            words = prepare(doc_id, words) if prepare else words
            runs = find_runs(words)
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            made = (
                len(runs),
                *(best or (None, None, None)),
                1000 * best[1] // best[2] if best else None,
                sha256_hex("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()),
                sha256_hex(b" ".join(collapsed(words, runs))),
            )
            for column, value in zip(columns, made, strict=True):
                column.append(value)
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def report(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """Number of runs, the one of greatest exponent, and digests of all runs and of the
    text without repetitions, for each row. ``prepare`` may change a row's words before."""
    schema = docs.select("doc_id").schema
    for name in _NAMES[1:6]:
        schema = schema.add(name, "long")
    schema = schema.add(_NAMES[6], "string").add(_NAMES[7], "string")
    return by_batch(docs.select("doc_id", text_of().alias("text")), _report(prepare), schema)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with columns ``runs`` (start, length, period in words) and ``collapsed``, the
    words without repetitions, joined by one blank."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("text"))
    kind = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, texts = [], []
        for text in batch.column("text").to_pylist():
            words = text.encode().split()
            runs = find_runs(words)
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            texts.append(b" ".join(collapsed(words, runs)).decode())
        place = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(found, place), pa.array(texts, pa.string())], names=["row", "runs", "collapsed"]
        )

    made = by_batch(held, run, held.select("row").schema.add("runs", kind).add("collapsed", "string"))
    return made.select(*[f"row.`{c}`" for c in docs.columns if c not in ("runs", "collapsed")], "runs", "collapsed")


def planted(doc_id: int | None, words: list) -> list:
    """The query's documents: every tenth by hash repeats itself from a place on. A null
    id plants nothing."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + [root[i % p] for i in range(n - a)]


def query(spark, folder: str) -> DataFrame:
    """``op11``: periodic runs of every document."""
    return report(table(spark, folder, "documents"), planted)
