"""Write the physical plans of representative queries to docs/PLANS.md.

    python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SHOWN = {
    "q07_null_profile": "one aggregate for all columns, then unpivot",
    "q15_value_counts": "stacked pairs, partial count before the shuffle",
    "q16_distinct_counts": "distinct (column, value) with partial dedupe",
    "q22_tag_buckets": "top-k table (k rows) broadcast into a left join",
    "q24_frequency_index": "feature chain: one projection over the join",
    "q45_label_correlation": "p correlations in one global aggregate",
}


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from paysift.plans.queries import QUERIES
    from paysift.session import get_session
    spark = get_session(shuffle_partitions=8)
    out = ["# Physical plans", "",
           f"Generated by `scripts/explain_plans.py` on `{sf}` "
           "(local, AQE on; the physical plan before AQE's runtime "
           "re-planning, which may still coalesce partitions or switch a "
           "join to broadcast).", ""]
    for name, why in SHOWN.items():
        df = QUERIES[name](spark, sf)
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        out += [f"## {name}", "", why + ".", "", "```"]
        out += [line[:200] for line in plan.splitlines()]
        out += ["```", ""]
    from paysift.plans.features import learning_counts
    from paysift.sources.tables import comp_view
    df = learning_counts(comp_view(spark, sf))
    out += ["## learning pass (plans.features.learning_counts)", "",
            "mode, skill mean and the labels of six indexed columns in one "
            "stacked, partially aggregated pass.", "", "```"]
    out += [line[:200] for line in
            df._jdf.queryExecution().executedPlan().toString().splitlines()]
    out += ["```", ""]
    path = os.path.join(ROOT, "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main(sys.argv)
