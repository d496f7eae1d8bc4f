"""A result as text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .model import Result
from .results import OPTIONAL, REQUIRED, WRONG, binding_gaps, problem_summary, skip_group, summary


#: Missing members that the report names; it counts the others.
NAMED = 8


def report_text(result: Result, most: int = 20) -> str:
    """Headline, the largest problems by triage, and why rules were left out."""
    s = summary(result).first()
    lines = [f"{s['checks_run']} checks run, {s['problems']} problems in {s['records']} records, {s['skipped']} checks left out", ""]
    order = F.when(F.col("triage") == WRONG, 0).when(F.col("triage") == REQUIRED, 1).when(F.col("triage") == OPTIONAL, 2).otherwise(3)
    nth = F.row_number().over(W.partitionBy("rule_id", "Dataset").orderBy("member"))
    lacking = binding_gaps(result)
    first = lacking.withColumn("k", nth).filter(F.col("k") <= NAMED).groupBy("rule_id", "Dataset").agg(F.first("label").alias("label"), F.array_sort(F.collect_list("member")).alias("some"))
    counts = lacking.groupBy("rule_id", "Dataset").agg(F.count(F.lit(1)).alias("n"))
    gaps = {(r["rule_id"], r["Dataset"]): r for r in first.join(counts, ["rule_id", "Dataset"]).collect()}  # a row per rule and dataset that compare sets
    for r in problem_summary(result.findings).orderBy(order, F.desc("records"), "rule_id").limit(most).collect():  # the report's top problems
        gap = gaps.get((r["rule_id"], r["Dataset"]))
        lines.append(f"[{r['triage']}] {r['Dataset']} {r['rule_id']}: {r['records']} records. {r['issue']} ({r['variables']})")
        lines += [f"    missing {gap['label']}: {', '.join(gap['some'])}{f', ... ({gap["n"]} in all)' if gap['n'] > NAMED else ''}"] if gap else []
    left = [(r["reason"], r["n"]) for r in result.skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per reason
    if left:
        groups: dict[str, int] = {}
        for reason, n in left:
            groups[skip_group(reason)] = groups.get(skip_group(reason), 0) + n
        lines += ["", "Not checked:", *(f"  {k}: {n}" for k, n in sorted(groups.items(), key=lambda kv: (-kv[1], kv[0])))]
    return "\n".join(lines)
