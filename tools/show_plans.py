"""Print the formatted physical plan of registered queries (after running
them, so AQE's final plan is shown) and a one-line summary of exchanges,
joins and scans.

    python tools/show_plans.py [sf_dir] name ...
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from skyledger.plans.registry import QUERIES  # noqa: E402
from skyledger.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    for name in names:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        kinds = {k: len(re.findall(k, plan)) for k in
                 ("Exchange hashpartitioning", "Exchange rangepartitioning", "BroadcastExchange",
                  "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "HashAggregate",
                  "SortAggregate", "ObjectHashAggregate", "Window", "FileScan", "ReusedExchange")}
        print(f"== {name}: " + ", ".join(f"{k}={v}" for k, v in kinds.items() if v))
        for line in plan.splitlines():
            if "FileScan" in line:
                m = re.search(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: (\[[^\]]*\])", line)
                if m:
                    print(f"   scan cols=[{m.group(1)[:100]}] pushed={m.group(2)[:120]}")


if __name__ == "__main__":
    main()
