"""Periodic runs against every pair of words."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from siftrank.llm import periods

FOLDER = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """Maximal stretches of every distance, the least distance of each."""
    found, seen, n = [], set(), len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] == words[i + q]:
                j = i
                while j < n - q and words[j] == words[j + q]:
                    j += 1
                if j - i + q >= max(least, times * q) and (i, j + q) not in seen:
                    seen.add((i, j + q))
                    found.append((i, j + q - i, q))
                i = j
            i += 1
    return sorted(found)


def nested(rng, depth):
    word = [rng.randint(0, 3) for _ in range(rng.randint(1, 4))]
    for _ in range(depth):
        word = word * rng.randint(1, 6) + [rng.randint(0, 3)] * rng.randint(0, 1)
    return word[:400]


def samples(rng):
    yield [rng.randint(0, 1) for _ in range(rng.randint(0, 120))]
    yield nested(rng, 3)
    yield [x for _ in range(5) for x in [rng.randint(0, 2) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)]


def test_runs_appended_at_once_and_in_pieces():
    rng = random.Random(5)
    for _ in range(150):
        for words in samples(rng):
            want = brute(words)
            assert periods.find_runs(words) == want
            catchers, at = periods.Catchers(), 0
            while at < len(words):
                size = rng.choice([1, 1, 2, 5, 17])
                catchers.append(np.array(words[at : at + size]))
                at += size
                if rng.random() < 0.1:  # runs of what has come so far, and then more words
                    assert [(s, e - s, q) for s, e, q in catchers.runs().tolist()] == brute(words[:at])
            assert [(s, e - s, q) for s, e, q in catchers.runs().tolist()] == want


def test_equal_hashes_of_different_words(monkeypatch):
    true = periods._joined
    monkeypatch.setattr(periods, "_joined", lambda a, b: true(a, b) & np.uint64(1))
    rng = random.Random(6)
    for _ in range(60):
        for words in samples(rng):
            assert periods.find_runs(words) == brute(words)


def test_other_bounds():
    rng = random.Random(7)
    for _ in range(80):
        for words in samples(rng):
            assert periods.find_runs(words, 11, 5) == brute(words, 11, 5)
    with pytest.raises(ValueError):
        periods.Catchers(6, 3)


def test_long_texts():
    rng = random.Random(8)
    assert periods.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    words = [str(rng.random()) for _ in range(50_000)]
    words[20_000:20_000] = [f"w{i}" for i in range(777)] * 6
    assert periods.find_runs(words) == [(20_000, 777 * 6, 777)]


def naive(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = None
    for s, n, q in runs:
        if best is None or (n * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
            best = (s, n, q)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
    )


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' WHERE len(text) < 12000").fetchall()
    got = {r[0]: tuple(r)[1:] for r in periods.query(spark, FOLDER).collect()}
    want = {i: naive(i, t) for i, t in rows}
    assert {i: got[i] for i in want} == want
    assert sum(v[0] > 0 for v in want.values()) > 5 and len(got) >= len(want)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "a " * 6, "a " * 5, "x y " * 4 + "x", "é é " * 9, "a " * 6, "x y " * 3 + "x"]
    rows = [(i if i != 3 else None, t, 7, "z") for i, t in enumerate(texts)] + [(4, "a " * 6, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, start string")
    got = sorted(tuple(r) for r in periods.report(df).fillna(-1).collect())
    want = []
    for i, t, *_ in rows:
        runs = brute((t or "").split(" ") if t and " " in t else (t or "").split())
        want.append((-1 if i is None else i, len(runs)))
    assert [r[:2] for r in got] == sorted(want)
    empty = df.limit(0)
    assert periods.report(empty).count() == 0 and periods.collapse(empty).count() == 0
    made = {r["doc_id"]: r for r in periods.collapse(df).collect()}
    assert made[4]["collapsed"] == "a" and made[6]["collapsed"] == "x y" and made[9]["collapsed"] == "x y x y x y x"
    assert made[6]["runs"][0].asDict() == {"start": 0, "length": 9, "period": 2} and made[6]["start"] == "z"
    assert made[0]["collapsed"] == "" and made[0]["text"] is None
