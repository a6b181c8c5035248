"""Developer check: run registered queries against their DuckDB oracle.

usage: python tools/check_oracles.py [sf_dir] [name-substring ...]
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from decantry.plans.compare import compare, duck_connect, type_diff
from decantry.plans.registry import load_all
from decantry.session import build_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
pats = sys.argv[2:]
spark = build_session("local[8]", shuffle_partitions=8)
con = duck_connect(sf)
bad = 0
for name, q in sorted(load_all().items()):
    if pats and not any(p in name for p in pats):
        continue
    t = time.time()
    try:
        df = q.fn(spark, sf)
        if q.oracle is None:
            res = {"rows": df.count(), "oracle": None}
        else:
            res = compare(df, con, q.oracle)
            types = type_diff(df, con, q.oracle)
            if types:
                res["type_mismatch"] = types
            if types or not (res["columns_match"] and res["values_match"] and res["spark_rows"] == res["oracle_rows"]):
                bad += 1
    except Exception as e:  # noqa: BLE001
        bad += 1
        res = {"error": f"{type(e).__name__}: {str(e)[:800]}"}
    res["sec"] = round(time.time() - t, 2)
    print(name, json.dumps(res, default=str), flush=True)
print("FAILURES", bad)
