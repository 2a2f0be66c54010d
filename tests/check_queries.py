"""python tests/check_queries.py <folder> [name ...]: run queries against their SQL and print what differs."""

import sys
import time

sys.path[:0] = [__file__.rsplit("/", 2)[0], __file__.rsplit("/", 1)[0]]

from oracle import SPENT, compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from loamlake.runtime import local_session  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session("check", "8"), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            verdict = compare(spark, con, folder, name, queries, oracle)
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        state = "ok  " if verdict is None else "FAIL"
        print(f"{state} spark {SPENT.get(name, 0):5.1f}s all {time.time() - began:5.1f}s {'sql ' if name in oracle else 'rows'} {name} {verdict or ''}", flush=True)
