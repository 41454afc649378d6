"""Run registered queries against DuckDB: python tests/check.py [name-prefix ...] [--sf 0.01]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from hearthgraph.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = compare(df, con, oracles[name])
                n = "" if diff else df.count()
            else:
                diff, n = None, f"rows-only {df.count()}"
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", ""
            if "-v" in argv:
                traceback.print_exc()
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.1f}s {n} {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
