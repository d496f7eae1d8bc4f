"""Findings: assembling, capping, triage, filtering, summaries."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .model import Result, Rule

FINDING_COLUMNS = ["Dataset", "Record", "USUBJID", "SEQ", "Variable", "Value", "issue", "triage", "rule_id"]
NOT_IN_DATASET = "Not in dataset"
#: Variables that tell which record is meant (fixed values); with them goes a domain's sequence number.
IDENTIFIERS = ("STUDYID", "DOMAIN", "USUBJID", "POOLID", "APID", "SPDEVID", "variable_name")
WRONG, REQUIRED, OPTIONAL = "wrong value", "missing required", "missing optional"
_PRESENCE = {"exists", "not_exists", "empty", "non_empty"}


def check_names(node: dict | str) -> list[str]:
    """The variables that a Check names, in order."""
    if isinstance(node, str):
        return []
    if "name" in node:
        return [str(node["name"])]
    out: list[str] = []
    for k in ("all", "any"):
        for n in node.get(k) or []:
            out += check_names(n)
    if node.get("not"):
        out += check_names(node["not"])
    return list(dict.fromkeys(out))


def conditions(node: dict) -> list[dict]:
    """The conditions of a Check, however nested."""
    if "operator" in node:
        return [node]
    out: list[dict] = []
    for key in ("all", "any"):
        for n in node.get(key) or []:
            out += conditions(n)
    return out + (conditions(node["not"]) if node.get("not") else [])


def _negates(node: dict) -> bool:
    return "not" in node or any(_negates(n) for key in ("all", "any") for n in node.get(key) or [])


def _selects(c: dict) -> bool:
    """Equality with a text that can be no variable's name: it chooses records and judges nothing."""
    value = c.get("value")
    value = value[0] if isinstance(value, list) and len(value) == 1 else value
    if c["operator"] != "equal_to" or value is None or isinstance(value, list) or str(value).startswith("$"):
        return False
    return c.get("value_is_literal") is True or not re.fullmatch(r"(--)?[A-Z][A-Z0-9]{1,7}", str(value))


def absence_pattern(check: dict | str) -> str:
    """A pattern of the variables whose absence a Check reports; empty if it judges values too.

    Such a Check holds nothing but presence tests and conditions that select
    records, on variables and not on bindings, and negates nothing.
    """
    found = conditions(check) if check and not isinstance(check, str) else []
    if not found or _negates(check) or any(str(c["name"]).startswith("$") or not (c["operator"] in _PRESENCE or _selects(c)) for c in found):
        return ""
    tested = [str(c["name"]) for c in found if c["operator"] in ("not_exists", "empty")]
    return "|".join("^" + ("[A-Z0-9]{2}" + re.escape(n[2:]) if n.startswith("--") else re.escape(n)) + "$" for n in tested)


def _about(rule: Rule) -> tuple:
    """What triage needs of a rule: id, level by rule type, absence pattern, level by message, whether the message speaks of absence."""
    said = rule.message.lower()
    by_type = None
    if "domain presence" in rule.rule_type.lower():
        by_type = WRONG if re.search("(must|should|shall) not be present", said) else REQUIRED
    by_message = REQUIRED if re.search("required|(must|should|shall) be present", said) else OPTIONAL if re.search("expected|permissible", said) else None
    return rule.id, by_type, absence_pattern(rule.check), by_message, bool(re.search("missing|absent|not present", said))


def with_triage(findings: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Add triage per (rule, dataset): one aggregate over the findings, and the catalogue's words.

    A value that is there is wrong, unless the rule reports an absent column and
    that one is absent. Where none is there, the bindings reported, then the message
    tell what is missing; else a blank is a value required, and identifiers alone are what the rule is about.
    """
    spark = findings.sparkSession
    about = spark.createDataFrame([_about(r) for r in rules.values()] or [("", None, "", None, False)], "rule_id string, by_type string, absence string, by_message string, of_absence boolean")
    binding = F.startswith("Variable", F.lit("$"))
    identifier = ~binding & (F.col("Variable").isin(*IDENTIFIERS) | F.col("Variable").rlike("^[A-Z]{2}SEQ$"))
    evidence = ~binding & ~identifier
    absent = ~binding & (F.col("Value") == NOT_IN_DATASET)
    filled = (F.col("Value") != NOT_IN_DATASET) & (F.col("Value") != "")
    named = F.lower("Variable")

    def some(test: object) -> object:
        return F.coalesce(F.bool_or(test), F.lit(False))

    # One row per rule of the catalogue is broadcast.
    facts = findings.join(F.broadcast(about), "rule_id").groupBy("rule_id", "Dataset", "by_type", "by_message", "of_absence").agg(
        some(evidence & filled).alias("value"), some(evidence).alias("evidence"), some(evidence & ~absent).alias("there"),
        some(identifier & ~absent).alias("id_there"), some(identifier & filled).alias("id_filled"), some(~binding).alias("real"),
        some(binding & F.contains(named, F.lit("required"))).alias("required"), some(binding & named.rlike("expected|permissible")).alias("optional"),
        some(absent & (F.col("absence") != "") & F.expr("Variable RLIKE absence")).alias("column_absent"),
    )
    triage = F.coalesce(
        F.col("by_type"),
        F.when(F.col("value") & ~F.col("column_absent"), WRONG),
        F.when(F.col("required"), REQUIRED).when(F.col("optional"), OPTIONAL),
        F.col("by_message"),
        F.when(F.col("there"), REQUIRED),
        F.when(~F.col("evidence") & F.col("id_there"), F.when(F.col("id_filled"), WRONG).otherwise(REQUIRED)),
        F.when(~F.col("real") & ~F.col("of_absence"), WRONG),
        F.lit(OPTIONAL),
    )
    facts = facts.select("rule_id", "Dataset", triage.alias("triage"))
    # One row per rule and dataset is broadcast, so that findings are not dealt by rule.
    return findings.drop("triage").join(F.broadcast(facts), ["rule_id", "Dataset"], "left").select(*FINDING_COLUMNS)


def melt(hits: DataFrame) -> DataFrame:
    """One row per violating record and output variable."""
    return hits.select("Dataset", "Record", "USUBJID", "SEQ", F.explode("values").alias("v"), "issue", "rule_id").select("Dataset", "Record", "USUBJID", "SEQ", "v.Variable", "v.Value", "issue", F.lit(None).cast("string").alias("triage"), "rule_id")


def with_texts(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (rule_id, Dataset, Variable, Value) of sets of a whole dataset, put into the findings that report them.

    They come last, as triage does not look at bindings, so no pass or shuffle carries a text per violating row.
    """
    keys = ["rule_id", "Dataset", "Variable"]
    # A row per rule and set that it reports, of bounded length, is broadcast.
    found = findings.join(F.broadcast(texts.select(*keys, F.col("Value").alias("__text"))), keys, "left")
    return found.withColumn("Value", F.coalesce("__text", "Value")).select(*FINDING_COLUMNS)


def capped(hits: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` records per (rule, dataset), and the true counts of those cut.

    The rank is a limit per group, which Spark applies within tasks before the shuffle.
    """
    spark = hits.sparkSession
    if most is None:
        return hits, spark.createDataFrame([], "rule_id string, domain string, records_found bigint, records_kept bigint")
    counts = hits.groupBy("rule_id", "Dataset").agg(F.count(F.lit(1)).alias("records_found")).filter(F.col("records_found") > most)
    nth = F.row_number().over(W.partitionBy("rule_id", "Dataset").orderBy("Record"))
    kept = hits.withColumn("__n", nth).filter(F.col("__n") <= most).drop("__n")
    return kept, counts.select("rule_id", F.col("Dataset").alias("domain"), "records_found", F.lit(most).cast("bigint").alias("records_kept"))


def filter_findings(result: Result, triage: str | list | None = None, dataset: str | list | None = None, rule: str | list | None = None, variable: str | list | None = None) -> Result:
    """Narrow a result; the other tables follow where they name a rule or dataset."""
    out = result.findings
    for column, wanted in (("triage", triage), ("Dataset", dataset), ("rule_id", rule), ("Variable", variable)):
        if wanted is not None:
            out = out.filter(F.col(column).isin(wanted if isinstance(wanted, list) else [wanted]))
    skipped, truncated = result.skipped, result.truncated
    for column, wanted in (("domain", dataset), ("rule_id", rule)):
        if wanted is not None:
            keep = F.col(column).isin(wanted if isinstance(wanted, list) else [wanted])
            skipped, truncated = skipped.filter(keep), truncated.filter(keep)
    return replace(result, findings=out, skipped=skipped, truncated=truncated)


def records(findings: DataFrame) -> DataFrame:
    """One row per violating record: its variables and values side by side."""
    pair = F.concat_ws("=", "Variable", "Value")
    return findings.groupBy("Dataset", "rule_id", "Record", "USUBJID", "SEQ", "issue", "triage").agg(F.concat_ws("; ", F.sort_array(F.collect_list(pair))).alias("details"))


def problem_summary(findings: DataFrame) -> DataFrame:
    """One row per problem: how many records and which variables."""
    return findings.groupBy("Dataset", "rule_id", "issue", "triage").agg(
        F.countDistinct(F.coalesce(F.col("Record"), F.lit(-1))).alias("records"), F.countDistinct("USUBJID").alias("subjects"), F.concat_ws(", ", F.array_sort(F.collect_set("Variable"))).alias("variables")
    )


def binding_sets(result: Result) -> tuple[DataFrame, DataFrame]:
    """The sets that findings report, whole: their names (rule_id, Dataset, Variable) and their members (with member).

    Sets of a dataset come from the operands that the rules compared, not from the text of
    findings. A set of single records counts if it is the same in all that a rule reports.
    """
    spark = result.findings.sparkSession
    told = result.findings.filter(F.startswith("Variable", F.lit("$"))).select("rule_id", "Dataset").distinct()
    sets, names, rows, tables = result.info.get("sets", {}), [], [], []
    for key in sorted((r["rule_id"], r["Dataset"]) for r in told.collect()):  # a row per rule and dataset that report a set
        for name, members in sets.get(key, {}).items():
            names.append((*key, name))
            if isinstance(members, list):
                rows += [(*key, name, v) for v in dict.fromkeys(members)]
            else:
                tables.append(members.select(F.lit(key[0]).alias("rule_id"), F.lit(key[1]).alias("Dataset"), F.lit(name).alias("Variable"), F.col("v").alias("member")))
    schema = "rule_id string, Dataset string, Variable string"
    named, members = spark.createDataFrame(names, schema), reduce(DataFrame.union, tables, spark.createDataFrame(rows, schema + ", member string"))
    if "hits" in result.info:
        own = result.info["hits"].select("rule_id", "Dataset", F.explode("values").alias("v")).filter("v.Members IS NOT NULL").join(told, ["rule_id", "Dataset"], "left_semi")
        own = own.groupBy("rule_id", "Dataset", F.col("v.Variable").alias("Variable")).agg(F.min("v.Members").alias("a"), F.max("v.Members").alias("b")).filter("a = b")
        named = named.union(own.select("rule_id", "Dataset", "Variable"))
        members = members.union(own.select("rule_id", "Dataset", "Variable", F.explode(F.array_distinct("a"))))
    return named, members


def binding_gaps(result: Result) -> DataFrame:
    """rule_id, Dataset, label, member: what a rule wanted and a dataset lacks, a row per member.

    Told where a rule reports one set whose name says what is missing, or several sets of
    which one is named for the dataset and one is not; the second less the first is an anti join.
    """
    named, members = binding_sets(result)
    own = F.contains("Variable", F.lit("dataset"))
    per = named.groupBy("rule_id", "Dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own).alias("have"), F.max(F.when(own, F.col("Variable"))).alias("held"), F.max(F.when(~own, F.col("Variable"))).alias("wanted"), F.min("Variable").alias("lone")
    )
    lone = (F.col("n") == 1) & F.contains("lone", F.lit("missing"))
    paired = (F.col("n") == 2) & (F.col("have") == 1)
    source = F.when(lone, F.col("lone")).when(paired, F.col("wanted"))
    label = F.translate(F.regexp_replace(source, r"^\$?(missing_)?", ""), "_", " ")
    per = per.select("rule_id", "Dataset", source.alias("Variable"), F.when(paired, F.col("held")).alias("held"), label.alias("label")).filter("Variable IS NOT NULL")
    wanted = members.join(per, ["rule_id", "Dataset", "Variable"])
    held = members.select("rule_id", "Dataset", F.col("Variable").alias("held"), "member")
    return wanted.join(held, ["rule_id", "Dataset", "held", "member"], "left_anti").select("rule_id", "Dataset", "label", "member")


def summary(result: Result) -> DataFrame:
    """A single row: problems, records by triage, checks run and left out."""
    f = result.findings
    key = F.struct("Dataset", "rule_id", "Record")

    def of(kind: str) -> object:
        return F.countDistinct(F.when(F.col("triage") == kind, key))

    totals = f.agg(F.countDistinct("Dataset", "rule_id").alias("problems"), F.countDistinct(key).alias("records"), of(WRONG).alias("wrong_value"), of(REQUIRED).alias("missing_required"), of(OPTIONAL).alias("missing_optional"))
    return totals.withColumns({"checks_run": F.lit(result.info.get("checks_run", 0)), "skipped": F.lit(result.info.get("skipped", 0))})


def skip_group(reason: str) -> str:
    """The kind of reason for which a rule was left out."""
    r = reason.lower()
    for kind, pattern in (("dictionary not supplied", "dictionary"), ("terminology not known", "terminology|codelist"), ("define.xml missing", "define"), ("dataset missing", "not in this study|not supplied"), ("variable missing", "does not have|this dataset lacks"), ("not supported", "unimplemented|not supported|not implemented")):
        if re.search(pattern, r):
            return kind
    return "could not be decided"
