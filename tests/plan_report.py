"""Write PLANS.md: the physical plan shape of every registered query.

    python tests/plan_report.py /root/testdata/sf0.1

For each query the plan is taken after execution (AQE final plan) and
summarised: shuffles, join strategies, aggregations, windows, Python stages,
and the filters / columns each Parquet scan receives.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def summarize(plan: str) -> dict:
    # An adaptive plan prints its final plan and then its initial plan.
    plan = plan.split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    c = Counter()
    joins = Counter()
    scans = []
    for ln in lines:
        s = ln.strip().lstrip(":+- ").strip()
        if s.startswith("Exchange hashpartitioning") or s.startswith("Exchange rangepartitioning") or s.startswith("Exchange RoundRobin") or s.startswith("Exchange SinglePartition"):
            c["shuffle"] += 1
        if s.startswith("BroadcastExchange"):
            c["broadcast"] += 1
        if s.startswith("ReusedExchange"):
            c["reused"] += 1
        for j in JOINS:
            if j in s.split(" ")[0] or s.startswith("*(") and j in s.split(" ")[1:2]:
                m = re.search(j + r" .*?(Inner|LeftOuter|LeftSemi|LeftAnti|FullOuter|RightOuter)", s)
                joins[f"{j} {m.group(1) if m else ''}".strip()] += 1
        if "HashAggregate(" in s:
            c["aggregate"] += 1
        if s.split(" ")[0].endswith("Window") or " Window [" in s:
            c["window"] += 1
        if "MapInPandas" in s or "FlatMapGroupsInPandas" in s or "ArrowEvalPython" in s:
            c["python"] += 1
        if "FileScan parquet" in s or "Scan parquet" in s:
            m = re.search(r"\[(.*?)\]", s)
            cols = m.group(1) if m else ""
            loc = re.search(r"/([a-z_]+)\.parquet", s)
            pf = re.search(r"PushedFilters: \[([^\]]*)", s)
            scans.append((loc.group(1) if loc else "?", len(cols.split(",")) if cols else 0, pf.group(1) if pf else ""))
    return {"counts": c, "joins": joins, "scans": scans}


def main(sf_dir: str) -> None:
    from ledgerlens.session import local_session

    from ledgerlens.plans.queries import QUERIES
    from ledgerlens.session import release

    spark = local_session(8, 16)
    out = [
        "# PLANS — physical plan shape of every registered query",
        "",
        f"Generated by `tests/plan_report.py` on `{sf_dir}` (Spark {spark.version}, local[8], AQE final plans).",
        "Shuffles count hash / range / round-robin exchanges; scans list table, columns read and pushed filters.",
        "Queries that write an intermediate table while being built (vendors_paid_both_ways, invoice_payment_mix,",
        "recurring_sundry, recurrence_profile, consecutive_run_lengths, ar_aging_by_customer) show the plan that",
        "reads it (`scan ?`); the write is a job of its own that reads the big tables once.",
        "",
    ]
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        release(spark)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        c = s["counts"]
        joins = ", ".join(f"{k} x{v}" for k, v in sorted(s["joins"].items())) or "none"
        out.append(f"## {name}")
        out.append("")
        out.append(
            f"- shuffles {c['shuffle']}, broadcasts {c['broadcast']}, reused exchanges {c['reused']}, "
            f"aggregates {c['aggregate']}, windows {c['window']}, Python stages {c['python']}"
        )
        out.append(f"- joins: {joins}")
        for t, n, pf in s["scans"]:
            out.append(f"- scan `{t}`: {n} columns; pushed: {pf or '—'}")
        out.append("")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
