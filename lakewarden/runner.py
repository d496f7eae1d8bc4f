"""Planning and running: rules by dataset and source, one pass over a source for all its rules.

The rules that look at the same rows are compiled against one table, so their
windows, bindings and date fields are shared, and their verdicts come out of one
projection. A pass runs once and is kept on disk for the counts, the
refusals and the findings that are read from it: a row per record, with a bit per rule.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .model import RECORD, Dataset, Dialect, Result, Rule, RuleSkipped, Study
from .plans import document, scope
from .plans.early import early
from .plans.evaluate import Compiler
from .plans.guards import check_inputs
from .plans.matching import match
from .plans.operations import shown
from .plans.relations import relation
from .plans.reshape import DATASET_TYPES, STUDY_TYPES, SUPPORTED, VALUE_TYPES, as_table, build
from .plans.table import tidy
from .results import NOT_IN_DATASET, capped, check_names, melt, with_texts, with_triage

#: Rules compiled into one projection at most; more would outgrow what generated code may hold, and more than 63 the bits of a pass.
FUSE = 40
HIT_SCHEMA = "rule_id string, Dataset string, Record bigint, USUBJID string, SEQ double, values array<struct<Variable: string, Value: string, Members: array<string>>>, issue string"


@dataclass
class Compiled:
    rule: Rule
    verdict: Column
    reasons: list[str]
    values: Column
    group: Column | None
    #: Sets of the whole dataset among the output variables: a list known at plan time, or a relation (v).
    sets: dict[str, list[str] | DataFrame]
    #: Those of them that are tables: their text is joined to the findings, and is not in ``values``.
    texts: list[str]
    #: Where ``values`` are texts of columns: each variable, its column or None, and its text if it has none.
    shows: list[tuple[str, str | None, str]] | None


def _values(compiler: Compiler, rule: Rule) -> tuple[Column, dict[str, list[str] | DataFrame], list[str], list[tuple[str, str | None, str]]]:
    """The output variables of a rule as an array of (Variable, Value, Members of a record's own set), the sets of the dataset, which of them have no text there, and what columns show."""
    t, out, sets, texts, shows = compiler.table, [], {}, [], []
    none = F.lit(None).cast("array<string>")
    for name in rule.output or check_names(rule.check):
        members = none
        if name.startswith("$"):
            bound = t.bindings.get(name)
            if bound is None:
                continue
            value = F.lit("") if bound.source is not None else bound.text()
            if bound.source is not None:
                texts.append(name)
            if bound.is_set and bound.values is not None:
                sets[name] = [tidy(v) for v in bound.values]
            elif bound.is_set and (bound.source is not None or bound.collection):
                sets[name] = relation(bound, t)
            elif bound.is_set:
                members = bound.col
            shows.append((name, None, ""))
        else:
            found = t.find(name, rule.dialect)
            name = found or t.resolve(name)
            value = t.text(found) if found else F.lit(NOT_IN_DATASET)
            shows.append((name, found, NOT_IN_DATASET))
        out.append(F.struct(F.lit(name).alias("Variable"), F.coalesce(value, F.lit("")).alias("Value"), members.alias("Members")))
    if rule.rule_type in VALUE_TYPES and not rule.output:
        out = [F.struct(F.col("variable_name").alias("Variable"), F.col("variable_value").alias("Value"), none.alias("Members"))]
    return F.array(*(out or [F.struct(F.lit("").alias("Variable"), F.lit("").alias("Value"), none.alias("Members"))])), sets, texts, shows or [("", None, "")]


def compile_rules(rules: list[Rule], table_of, study: Study, dialect: Dialect) -> tuple[list[Compiled], object, list[tuple[str, str]]]:
    """Compile rules over one table; those that cannot run come back with their reasons."""
    table = table_of()
    compiler, done, skipped = Compiler(table, study, dialect), [], []
    for rule in rules:
        before = table.df
        try:
            check_inputs(rule, table, study)
            verdict, reasons = compiler.rule(rule)
            group = None
            if rule.sensitivity == "Group" and rule.grouping:
                keys = [table.resolve(g) for g in rule.grouping]
                group = F.concat_ws("\x1f", *(tx.group_key(table.col(k), table.kind(k)) for k in keys if table.has(k)))
            values, sets, texts, shows = _values(compiler, rule)
            # Verdicts are written out, as conditions may hold windows, which no array of structs can; so are values with
            # bindings. Others are built of columns where a rule is violated, so that no row carries them through the plan.
            if any(n.startswith("$") and n not in texts for n in rule.output or check_names(rule.check)):
                values, shows = table.add(values), None
            elif rule.rule_type in VALUE_TYPES and not rule.output:
                shows = None
            done.append(Compiled(rule, table.add(verdict), reasons, values, table.add(group) if group is not None else None, sets, texts, shows))
        except RuleSkipped as e:
            table.df = before
            compiler._seen.clear()
            table.dates.clear()
            table._made = {k: v for k, v in table._made.items() if v in before.columns}
            skipped.append((rule.id, str(e)))
    return done, table, skipped


def _any(tests: Iterable[tuple[int, Column]]) -> Column:
    """The bits of the rules whose test is met."""
    return reduce(Column.bitwiseOR, (F.when(test, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, test in tests), F.lit(0).cast("bigint"))


class Pass:
    """Violations and undecided rows of rules that were compiled over one table.

    ``rows`` has a row per record: its keys, a bit per rule (``hit``, ``open``), and the text of each column that
    findings show, once for all rules. It is kept on disk alone: what stays in memory would grow with the records.
    A row per rule and record (``of``) is made when findings are read, and never kept.
    """

    def __init__(self, done: list[Compiled], table, label: str):
        self.done, self.label = done, label
        names = {c.upper(): c for c in table.names}
        seq = next((c for c in table.names if c.endswith("SEQ") and len(c) <= 5), None)
        subject = tx.text_of(table.col(names["USUBJID"]), table.kind(names["USUBJID"])) if "USUBJID" in names else F.lit(None).cast("string")
        number = tx.number(table.col(seq), table.kind(seq)) if seq else F.lit(None).cast("double")
        hit = _any((i, F.coalesce(c.verdict, F.lit(False))) for i, c in enumerate(done))
        undecided = _any((i, c.verdict.isNull()) for i, c in enumerate(done) if c.reasons)
        sure = table.settled(hit.bitwiseOR(undecided) != 0)
        #: The text of each column that findings show.
        self.text = {column: f"t{k}" for k, column in enumerate(dict.fromkeys(column for c in done for _, column, _ in c.shows or [] if column))}
        held = [F.coalesce(table.text(column), F.lit("")).alias(name) for column, name in self.text.items()]
        for i, c in enumerate(done):
            verdict = F.coalesce(c.verdict, F.lit(False))
            held += [F.when(verdict, c.values).alias(f"v{i}")] if c.shows is None else []
            held += [F.when(verdict, c.group).alias(f"g{i}")] if c.group is not None else []
        self.rows = table.df.filter(sure).select(F.col(RECORD).alias("Record"), subject.alias("USUBJID"), number.alias("SEQ"), hit.alias("hit"), undecided.alias("open"), *held).persist(StorageLevel.DISK_ONLY)

    def undecided(self) -> set[int]:
        """The rules that a row could not decide."""
        if not any(c.reasons for c in self.done):
            return set()
        found = self.rows.agg(F.bit_or("open")).first()[0] or 0
        return {i for i in range(len(self.done)) if found >> i & 1}

    def _values(self, i: int) -> Column:
        c, none = self.done[i], F.lit(None).cast("array<string>")
        if c.shows is None:
            return F.col(f"v{i}")
        return F.array(*(F.struct(F.lit(name).alias("Variable"), (F.col(self.text[column]) if column else F.lit(text)).alias("Value"), none.alias("Members")) for name, column, text in c.shows))

    def of(self, some: list[int]) -> DataFrame:
        """A row per violation of some rules: rule number, keys, values and group."""
        rows, i = self.rows.filter(F.col("hit").bitwiseAND(F.lit(sum(1 << i for i in some)).cast("bigint")) != 0), F.col("i")
        if len(some) == 1:
            rows = rows.withColumn("i", F.lit(some[0]))
        else:
            rows = rows.withColumn("i", F.explode(F.array(*map(F.lit, some)))).filter(F.expr("shiftright(hit, i) & 1") == 1)
        alike: dict[str, list[int]] = {}
        for k in some:
            alike.setdefault(repr(self.done[k].shows or k), []).append(k)
        values = reduce(lambda out, ks: F.when(i.isin(ks), self._values(ks[0])).otherwise(out), list(alike.values())[1:], self._values(some[0]))
        groups = [F.when(i == k, F.col(f"g{k}")) for k in some if self.done[k].group is not None]
        group = F.coalesce(*groups) if groups else F.lit(None).cast("string")
        return rows.select("Record", "USUBJID", "SEQ", "i", values.alias("values"), group.alias("grp"), F.lit(self.label).alias("Dataset"))


def _reported(hits: DataFrame, c: Compiled, joined: bool, study_wide: bool) -> DataFrame:
    """The hits of one rule as its sensitivity reports them."""
    rule, rows = c.rule, hits
    if rule.sensitivity in ("Dataset", "Study") or rule.rule_type in DATASET_TYPES or study_wide:
        rows = rows.groupBy("Dataset").agg(F.min_by("values", "Record").alias("values")).select(F.lit(None).cast("bigint").alias("Record"), F.lit(None).cast("string").alias("USUBJID"), F.lit(None).cast("double").alias("SEQ"), "values", F.lit("STUDY").alias("Dataset") if study_wide else F.col("Dataset"))
    elif c.group is not None:
        rows = rows.groupBy("Dataset", "grp").agg(F.min_by(F.struct("Record", "USUBJID", "SEQ", "values"), "Record").alias("r")).select("r.*", "Dataset")
    elif joined:
        # Joins may repeat a record: its first row stands for it.
        rows = rows.groupBy("Dataset", "Record").agg(F.min(F.struct("USUBJID", "SEQ", "values")).alias("r")).select("Record", "r.*", "Dataset")
    return rows.select(F.lit(rule.id).alias("rule_id"), "Dataset", "Record", "USUBJID", "SEQ", "values", F.lit(rule.message).alias("issue"))


def _source_key(rule: Rule) -> tuple:
    kind = rule.rule_type
    own = repr(sorted(kind)) if kind == "Record Data" else repr((kind, rule.check, rule.output))
    return (kind, rule.dialect, repr(rule.match_datasets), "" if kind == "Record Data" else own)


def run(spark: SparkSession, rules: list[Rule], study: Study, max_records: int | None = 1000, only: list[str] | None = None) -> Result:
    """Run every applicable rule on every dataset."""
    hits: list[DataFrame] = []
    skipped: list[tuple[str, str, str]] = []
    ran: list[tuple[str, str]] = []
    kept: list[DataFrame] = []
    passes: list[DataFrame] = []
    sets: dict[tuple[str, str], dict] = {}
    texts: list[DataFrame] = []
    asked: set[str] = set()
    for d in study.datasets.values():
        if only and d.name.upper() not in only:
            continue
        groups: dict[tuple, list[Rule]] = {}
        for rule in rules:
            if rule.rule_type == "JSONata" or not scope.applies(rule, d, study):
                continue
            if rule.rule_type not in SUPPORTED:
                skipped.append((rule.id, d.name, f"rule type not supported: {rule.rule_type}"))
                continue
            if rule.rule_type in STUDY_TYPES or rule.sensitivity == "Study":
                if rule.id in asked:
                    continue
                asked.add(rule.id)
            groups.setdefault(_source_key(rule), []).append(rule)
        for some in groups.values():
            for i in range(0, len(some), FUSE):
                _run_group(some[i : i + FUSE], d, study, hits, skipped, ran, kept, passes, sets, texts)
    if study.document is not None and not only:  # rules over the document, whatever their scope
        for rule in (r for r in rules if r.rule_type == "JSONata"):
            try:
                hits.append(document.hits(spark, rule, study, HIT_SCHEMA))
                ran.append((rule.id, "STUDY"))
            except RuleSkipped as e:
                skipped.append((rule.id, "STUDY", str(e)))
    found = reduce(DataFrame.union, hits) if hits else spark.createDataFrame([], HIT_SCHEMA)
    found, truncated = capped(found, max_records)
    by_id = {r.id: r for r in rules}
    findings = with_triage(melt(found), by_id)
    if texts:
        kept.append(reduce(DataFrame.union, texts).persist(StorageLevel.MEMORY_AND_DISK))
        findings = with_texts(findings, kept[-1])
    skip = spark.createDataFrame(skipped, "rule_id string, domain string, reason string") if skipped else spark.createDataFrame([], "rule_id string, domain string, reason string")
    info = {"checks_run": len(ran), "skipped": len(skipped), "ran": ran, "domains": sorted(study.datasets), "standard": (study.product, study.version), "ct_package": study.ct_package, "passes": passes, "kept": kept, "sets": sets, "hits": found}
    return Result(findings, skip, truncated, info)


def _run_group(some: list[Rule], d: Dataset, study: Study, hits: list, skipped: list, ran: list, kept: list, passes: list, sets: dict, texts: list) -> None:
    first, dialect = some[0], some[0].dialect

    def table_of():
        rows = build(first, d, study)
        if first.rule_type == "Record Data":
            rows = early(rows, some, d)
        return as_table(match(rows, first, d, study), d, study, dialect)

    try:
        done, table, failed = compile_rules(some, table_of, study, dialect)
    except RuleSkipped as e:
        skipped += [(r.id, d.name, str(e)) for r in some]
        return
    skipped += [(r, d.name, why) for r, why in failed]
    if not done:
        return
    found = Pass(done, table, d.name.upper())
    kept.append(found.rows)
    passes.append(found.of(list(range(len(done)))))
    undecided = found.undecided()
    plain: list[int] = []
    for i, c in enumerate(done):
        if i in undecided:
            skipped.append((c.rule.id, d.name, "; ".join(dict.fromkeys(c.reasons))))
            continue
        ran.append((c.rule.id, d.name))
        presence = c.rule.rule_type == "Domain Presence Check"
        about = c.rule.id, "STUDY" if presence else d.name.upper()
        sets[about] = c.sets
        texts += [shown(c.sets[n]).select(F.lit(about[0]).alias("rule_id"), F.lit(about[1]).alias("Dataset"), F.lit(n).alias("Variable"), "Value") for n in c.texts]
        joined = bool(c.rule.match_datasets) and c.rule.rule_type not in VALUE_TYPES
        about_dataset = c.rule.rule_type in DATASET_TYPES
        if c.rule.sensitivity in ("Dataset", "Study") or about_dataset or presence or joined or c.group is not None:
            hits.append(_reported(found.of([i]), c, joined, presence))
        else:
            plain.append(i)
    if plain:  # all rules that report record by record, in one reading of the pass
        at = F.col("i") + 1
        ids, messages = (F.element_at(F.array(*(F.lit(getattr(c.rule, what)) for c in done)), at) for what in ("id", "message"))
        hits.append(found.of(plain).select(ids.alias("rule_id"), "Dataset", "Record", "USUBJID", "SEQ", "values", messages.alias("issue")))
