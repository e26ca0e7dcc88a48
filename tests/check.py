"""Compare named queries with their SQL: python tests/check.py SF_DIR [prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlift.catalog import QUERIES  # noqa: E402
from ledgerlift.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    good = bad = 0
    for name in QUERIES:
        if prefixes and not any(name == p or name.startswith(p + "_") or p.endswith("*") and name.startswith(p[:-1]) for p in prefixes):
            continue
        start = time.time()
        try:
            n, m, rows = compare(spark, con, name, sf_dir)
            ok = m == -1 or (n == m and not rows)
            note = f"{n} rows" if m == -1 else f"{n} / {m}"
        except Exception as error:  # report and go on
            ok, note, rows = False, str(error)[:700], []
        good, bad = good + ok, bad + (not ok)
        print(("ok  " if ok else "BAD ") + name, note, f"{time.time() - start:.1f}s", flush=True)
        for row in rows:
            print("    ", str(row)[:900])
    print(good, "good", bad, "bad")
