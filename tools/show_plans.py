"""Write docs/PLANS.md: condensed physical plans of headline queries (operators, exchanges,
pushed filters and read schemas), so plan claims in the README can be checked.

usage: python tools/show_plans.py [sf_dir]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from decantry.plans.registry import load_all  # noqa: E402
from decantry.session import build_session  # noqa: E402

HEADLINE = ["catalog_with_stock", "best_sellers", "kpi_cube", "order_status_final", "loyalty_with_resets",
            "collection_sources", "unlocked_rewards", "number_orders", "customer_order_history", "dashboard"]


def condensed(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    keep = []
    for line in text.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if "FileScan" in line:
            head = line[:line.index("FileScan")] + "FileScan " + line.split("FileScan", 1)[1].split(" ", 2)[1]
            pushed = re.search(r"PushedFilters: \[[^\]]*\]", line)
            schema = re.search(r"ReadSchema: \S+", line)
            line = " ".join(x for x in [head, pushed.group(0) if pushed else "", schema.group(0) if schema else ""] if x)
        elif len(line) > 220:
            line = line[:217] + "..."
        keep.append(line)
    return "\n".join(keep)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=8)
    qs = load_all()
    out = ["# Physical plans of headline queries", "",
           f"Generated by `tools/show_plans.py` on `{sf}` (local[8], AQE on; the initial plan is shown,",
           "AQE may still coalesce partitions or switch join strategy at runtime from real sizes).", ""]
    for name in HEADLINE:
        q = qs[name]
        out += [f"## {name} ({q.survey_id})", "", "```", condensed(q.fn(spark, sf)), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
