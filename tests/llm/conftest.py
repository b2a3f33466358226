from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_rows import ROWS, SCHEMA, SF  # noqa: E402


@pytest.fixture(scope="session")
def few(spark):
    """The session with few shuffle partitions, as the tables here are small."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="session")
def documents(few):
    return few.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge(few):
    extra = "score string, row string, label string, key string, mark string, size string, found string, shard string"
    schema = f"{SCHEMA}, {extra}"
    return few.createDataFrame([(*r, *"abcdefgh") for r in ROWS], schema)


@pytest.fixture(scope="session")
def empty(few):
    return few.createDataFrame([], SCHEMA)
