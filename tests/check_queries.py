"""Command line: compare registered queries against DuckDB. Usage: check_queries.py FOLDER [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridloom.session import get_spark
from tests.compare import compare, duck
import __spark_entry__ as entry


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or sorted(queries):
        t = time.time()
        try:
            if name in oracles:
                said = compare(queries[name](spark, folder), con, oracles[name])
            else:
                said = None
                print(f"     {name}: {queries[name](spark, folder).count()} rows, no SQL")
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += said is not None
        print(f"{'ok  ' if said is None else 'FAIL'} {name} {time.time() - t:.1f}s {said or ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
