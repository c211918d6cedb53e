"""The SQL of the shards on rows that repeat each other."""

import duckdb

from siftrank.llm import sharding


def test_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "c"), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in sharding.assign(df, 6).select("doc_id", "n_bytes", "shard", "shard_bytes").collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, n_bytes, shard, shard_bytes FROM ({sharding.sql(6)})").fetchall()
    assert got == sorted(want, key=repr) and len(got) == len(rows)
