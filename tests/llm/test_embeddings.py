"""Near-duplicate vectors against all cosines of a label."""

import math

import duckdb
import numpy as np
import pytest

from siftrank.llm import embeddings


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs of a label and a dimension."""
    def usable(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    groups, links, parent = {}, [0] * len(rows), list(range(len(rows)))
    for i, (_, label, v) in enumerate(rows):
        if usable(label, v):
            groups.setdefault((label, len(v)), []).append(i)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for own in groups.values():
        x = np.array([rows[i][2] for i in own], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near), strict=True):
            links[own[i]] += 1
            a, b = find(own[i]), find(own[j])
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    made = [(r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)]
    return sorted(((*m, m[0] is not None and m[0] == m[2]) for m in made), key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **how).collect()), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")


@pytest.fixture(scope="module")
def crowd():
    """Groups of near copies, a chain, exact copies and pairs at the threshold."""
    rng = np.random.default_rng(2)
    rows = []

    def add(label, v):
        rows.append((len(rows) * 3 % 1009, label, [float(np.float32(x)) for x in v]))

    for _ in range(150):
        add(int(rng.integers(0, 3)), rng.standard_normal(24))
    for size in (60, 8, 2):
        centre = rng.standard_normal(24)
        for _ in range(size):
            add(1, centre + 0.09 * rng.standard_normal(24) * rng.random())
    for _ in range(20):
        add(1, rows[-1][2])
    a, b = np.eye(24)[:2]
    for k in range(30):
        add(2, math.cos(k * 0.15) * a + math.sin(k * 0.15) * b)
    return rows


@pytest.mark.parametrize("block", [embeddings.BLOCK, 4])
def test_links_and_components(spark, crowd, block):
    assert got(frame(spark, crowd), block=block) == brute(crowd)


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    made = sorted((tuple(r) for r in embeddings.query(spark, folder).collect()), key=repr)
    assert made == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.standard_normal((4000, 48)))
    y = rng.standard_normal((4000, 48))
    y = embeddings.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    near = 0.98 * x + math.sqrt(1 - 0.98**2) * y
    for n in (100, 10**6):
        shape = embeddings.layout(n)
        met = (embeddings.table_keys(x, *shape) == embeddings.table_keys(near, *shape)).any(axis=1)
        assert met.mean() > 0.998
    assert embeddings.layout(10**6) > embeddings.layout(100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 2, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 1, None), (6, 1, []),
        (7, 1, [0.0, 0.0]), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [None, 1.0]), (None, 1, [1.0, 0.0]),
        (11, 1, [1.0, 0.0, 0.0]), (2, 1, [2.0, 0.0]), (12, 1, [1e-300, 1e-300]), (13, 1, [1e300, 1e300]),
        (None, 3, [0.5, 0.5]), (14, 1, [-0.0, 0.5]), (15, 1, [0.0, 0.5]), (16, 4, [1.0] * 3000), (17, 4, [1.0] * 3000),
    ]
    df = frame(spark, rows, "double")
    assert got(df) == brute(rows)
    assert got(df.selectExpr("*", "label as n", "vec_id as root", "'x' as key")) == brute(rows)
    assert got(df.limit(0)) == [] and got(df.where("label is null")) == [(4, 0, 4, True)]
