"""Run registered queries against their twins: python tests/check_queries.py [sf_dir] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import compare, duck_connection  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from workloads import load_all  # noqa: E402
from workloads.registry import ORACLES, QUERIES  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    names = sys.argv[2:] or list(QUERIES)
    names = [q for n in names for q in QUERIES if q == n or (n.endswith("*") and q.startswith(n[:-1]))]
    spark, con = local_session(8), duck_connection(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                n = len(QUERIES[name](spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"@ {name}: {'ok' if problem is None else problem} ({time.time() - started:.1f}s)", flush=True)
    print(f"@ {len(names)} queries, {bad} bad, {len(QUERIES) - len(ORACLES)} without twin")


main()
