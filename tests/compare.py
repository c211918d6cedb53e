"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6) + 0.0
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA else str(v))
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def type_difference(df, con, sql: str) -> str | None:
    """Column types that differ between a Spark result and its SQL."""
    want = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = [
        f"{name} {DUCK_TYPES.get(kind, kind)} != {want.get(name)}"
        for name, kind in df.dtypes
        if DUCK_TYPES.get(kind, kind) != want.get(name)
    ]
    return "; ".join(wrong) or None


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = normal(got), normal(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return (
                f"{(~same).sum()} of {len(got)} differ in {c}: "
                f"{got.loc[i].to_dict()} != {want.loc[i].to_dict()}"
            )[:600]
    return None


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry

    from siftrank.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con = entry.queries(), entry.oracle_sql(), duck(folder)
    for name in names or list(queries):
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
        except Exception as error:  # report and go on
            print(f"ERROR {name}: {str(error)[:900]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"ROWS  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(sql[name]).df()
        except Exception as error:
            print(f"SQL   {name}: {str(error)[:900]}", flush=True)
            continue
        problem = difference(got, want)
        print(
            f"{'ok   ' if problem is None else 'DIFF '} {name}: {len(got)} rows, spark {took:.1f}s, "
            f"duckdb {time.time() - start:.1f}s {problem or ''}",
            flush=True,
        )


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
