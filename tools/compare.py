"""Compare registered queries with their SQL on DuckDB: compare.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from oracles import oracles  # noqa: E402
from pageloom.catalog import QUERIES  # noqa: E402
from pageloom.sources.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value == int(value) else round(value, 6)
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


def difference(spark, con, folder: str, name: str, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    want = rows(columns, relation.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return f"{sum(got.values())} / {sum(want.values())} rows; only here {list(extra)[:2]}; only there {list(missing)[:2]}"


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, sqls = local_session(), connect(folder), oracles()
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        if name not in sqls:
            print(f"{name:32s} no SQL", flush=True)
            continue
        try:
            found = difference(spark, con, folder, name, sqls[name])
        except Exception as error:  # keep going: one failing query must not hide the others
            found = f"FAILED {str(error)[:700]}"
        bad += found is not None
        print(f"{name:32s} {'ok' if found is None else found[:900]} {time.time() - start:.1f}s", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
