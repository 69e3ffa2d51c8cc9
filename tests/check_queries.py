"""Run registered queries against their oracles: python -m tests.check_queries [name ...]"""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from flowprism.session import build_session
from tests.oracle import compare, connect


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        begin = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problems = compare(df, con, oracles[name]) if name in oracles else []
            rows = "" if name in oracles else f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            problems, rows = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        took = time.time() - begin
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.1f}s {rows} {problems or ''}", flush=True)
        bad += bool(problems)
    print(f"{len(names or queries)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
