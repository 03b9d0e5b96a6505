"""python -m tests.run_oracle [sf_dir] [name prefix …]: compare the registered queries."""

import sys

from skyledger.session import build
from tests.compare import compare, connect

if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            res = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as error:
            res = {"name": name, "ok": False, "note": f"{type(error).__name__}: {str(error)[:900]}", "rows": -1, "sec": 0}
        bad += not res["ok"]
        print("ok  " if res["ok"] else "FAIL", name, res["rows"], res["sec"], res.get("sql_sec", ""), res["note"][:1500], flush=True)
    print("failed", bad, "missing sql", sorted(set(queries) - set(oracle)), "orphan sql", sorted(set(oracle) - set(queries)))
