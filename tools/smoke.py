"""Run registered queries once and print row counts and seconds: smoke.py FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pageloom.catalog import QUERIES  # noqa: E402
from pageloom.sources.session import local_session  # noqa: E402


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    for name in names or QUERIES:
        start = time.time()
        try:
            rows = QUERIES[name](spark, folder).count()
            print(f"{name:32s} {rows:8d} rows {time.time() - start:6.2f}s", flush=True)
        except Exception as error:  # a failing query must not hide the others
            print(f"{name:32s} FAILED {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
