"""Digests over texts too short for the two bytes left out, and over repeated ids, against the SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from compare import difference  # noqa: E402

from oracles import oracles  # noqa: E402


def test_short_and_repeated_texts(spark, tmp_path):
    texts = ["", "a", "é", "ab", "abc", None, "a longer text"]
    rows = [(7 * k + turn, text) for k, text in enumerate(texts) for turn in range(7)] + [(0, "x"), (0, "another"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert difference(spark, con, str(tmp_path), "j9_verify_digest", oracles()["j9_verify_digest"]) is None
