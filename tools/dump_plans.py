"""Write the physical operator trees of headline queries (sf0.1) to docs/plans.md."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cohortlake.plans.queries import QUERIES  # noqa: E402
from cohortlake.session import get_spark  # noqa: E402

NAMES = ["registry_coverage", "harmonized_union", "eav_pivot", "sample_mutation_flags", "roc_auc", "stratified_folds",
         "fold_metrics", "batch_scoring", "event_time_table"]


def tree(df) -> str:
    """Operator tree after execution (AQE final plan), without per-node details."""
    df.write.format("noop").mode("overwrite").save()
    txt = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for line in txt.splitlines():
        m = re.match(r"^([\s:+\-]*)(\*?\(?\d*\)?\s*[A-Za-z][A-Za-z ]*?)(\s|\[|\(|$)", line)
        if m:
            lines.append((m.group(1) + m.group(2)).rstrip())
    return "\n".join(lines)


def main():
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("local[8]", shuffle_partitions=16)
    out = ["# Physical plans of headline queries", "",
           f"Final adaptive plans at `{sf}` (`local[8]`), node names only. Regenerate with "
           "`python tools/dump_plans.py`.", ""]
    for n in NAMES:
        out += [f"## {n}", "", "```", tree(QUERIES[n](spark, sf)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
