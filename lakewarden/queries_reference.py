"""Registered queries of what reads reference tables: operations, rule types and refusals.

The reference tables (guide, model, terminology, define) are made of the driver's
``nation`` and ``region``, so that SQL can say what must come out of them. An
operation that gives one list or value for a dataset is shown as that list; one that
gives a value per row is shown for all rows of ``events``; a rule type is shown by
the findings of a rule over it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import RECORD, Dataset, Dialect, Library, Operation, Rule, Study, VariableMeta
from .operators import OPERATORS
from .plans.operations import compute, materialised
from .plans.table import Table
from .results import binding_gaps
from .runner import run
from .shared import new_folder
from .sources.frame import normal_types
from .sources.usdm import read_usdm

_ISO = "replace(left(CAST(ts AS STRING), 19), ' ', 'T')"
#: The dataset that is checked: events with the nation and region their number names.
EVENTS = f"""SELECT event_id AS id, CAST(user_id AS STRING) AS USUBJID, 'EV' AS DOMAIN, event_type AS EVTERM, CAST(event_id % 25 AS DOUBLE) AS EVK, 'NATION_' || CAST(event_id % 25 AS STRING) AS EVNAME,
  'R' || CAST(event_id % 5 AS STRING) AS EVCODE, CASE event_id % 3 WHEN 0 THEN '2024-03-29' WHEN 1 THEN '2023-12-15' ELSE '1999-01-01' END AS EVVER, {_ISO} AS EVDTC,
  CASE event_id % 4 WHEN 0 THEN 'EV' WHEN 1 THEN 'CU' WHEN 2 THEN 'cu' ELSE 'ZZ' END AS RDOMAIN, CASE event_id % 5 WHEN 0 THEN 'EVTERM' WHEN 1 THEN 'CUNAME' ELSE 'NONE' END AS EVVAR, CASE event_id % 3 WHEN 0 THEN '<p>good</p>' WHEN 1 THEN '<p>bad' ELSE '' END AS EVHTML FROM {{t}}"""
CUSTOMERS = "SELECT c_custkey AS id, 'CU' AS DOMAIN, c_name AS CUNAME, c_mktsegment AS CUSEG, CAST(c_nationkey AS DOUBLE) AS EVK, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS EVNAME FROM {t}"
#: Each subject's start of study: the day of the user's first event and a few days more.
SUBJECTS = "SELECT CAST(user_id AS STRING) AS USUBJID, left(CAST(min(ts) + INTERVAL '3' DAY AS STRING), 10) AS RFSTDTC, min(event_id) AS id FROM {t} GROUP BY user_id"

_CORE, _ROLE, _CLASS = ("Req", "Exp", "Perm"), ("Identifier", "Topic", "Timing"), ("Identifiers", "Events", "Timing")
#: One variable per column of EVENTS beside those the guide and the model take from ``nation``.
_LENGTHS = {"EVNAME": 9, "EVTERM": 8, "EVCODE": 2}


def library(spark: SparkSession, sf_dir: str) -> Library:
    """Guide, model and terminology: a variable, a model variable and a term per nation, a codelist per region."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # 25 rows
    regions = {r["r_regionkey"]: r["r_name"] for r in rows}

    def lists(package: str, keep: int) -> list[dict]:
        return [
            {"package": package, "codelist_code": f"R{k}", "codelist": name, "extensible": "Yes" if k % 2 == (keep == 5) else "No",
             "terms": [(f"T{r['n_nationkey']}", r["n_name"], r["n_name"].title(), [f"OLD {r['n_nationkey']}"]) for r in rows if r["n_regionkey"] == k]}
            for k, name in sorted(regions.items()) if k < keep
        ]

    guide = [
        {"standard": "SDTMIG", "version": "3-4", "domain": "EV" if k < 15 else "CU", "variable": "EVNAME" if k == 1 else f"EVX{k}", "label": r["n_name"] if k % 2 else "Even", "role": _ROLE[k % 3], "type": "Char", "core": _CORE[k % 3], "ordinal": k, "ccode": f"R{r['n_regionkey']}" if k < 4 else ""}
        for k, r in enumerate(rows)
    ]
    model = [{"class": _CLASS[k % 3], "variable": "--TERM" if k == 1 else f"--M{k}", "label": r["n_name"], "role": _ROLE[r["n_regionkey"] % 3], "type": "Char", "ordinal": 100 - k} for k, r in enumerate(rows)]
    labels = [{"standard": "SDTMIG", "version": v, "domain": "EV", "label": regions[k]} for k, v in ((1, "3.3"), (2, "3.4"))]
    packages = [{"package_type": "SDTM" if k % 2 else "ADAM", "package_date": f"202{k}-01-01"} for k in sorted(regions)]
    countries = [{"code": f"N{r['n_nationkey']}", "name": r["n_name"]} for r in rows]
    return Library(guide, model, {"EV": "Events", "CU": "Special Purpose"}, labels, [*lists("sdtmct-2024-03-29", 5), *lists("sdtmct-2023-12-15", 3)], packages, countries)


def define(spark: SparkSession, sf_dir: str) -> dict:
    """A define with EV (two variables that are there and one that is not), CU and a dataset the study lacks."""
    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows

    def variable(dataset: str, name: str, order: int, **more: object) -> dict:
        return {"define_dataset_name": dataset, "define_variable_name": name, "define_variable_label": f"Label of {name}", "define_variable_data_type": "text", "define_variable_length": 8.0, "define_variable_order_number": order, "define_variable_key_sequence": "", **more}

    variables = [variable("EV", "EVNAME", 1, define_variable_key_sequence="2"), variable("EV", "USUBJID", 2, define_variable_key_sequence="1"), variable("EV", "EVGONE", 3), variable("CU", "CUNAME", 1)]
    datasets = [{"define_dataset_name": n, "define_dataset_label": label, "define_dataset_structure": "One record"} for n, label in (("EV", "Events"), ("CU", "Customers"), ("XX", "Absent"))]
    levels = [
        {"define_dataset_name": "EV", "define_variable_name": "EVNAME", "where": [{"variable": "EVTERM", "comparator": "EQ", "values": ["click"]}], "define_vlm_length": 8.0},
        {"define_dataset_name": "EV", "define_variable_name": "EVNAME", "where": [{"variable": "EVK", "comparator": "GE", "values": ["20"]}, {"variable": "EVTERM", "comparator": "NOTIN", "values": ["click", "view"]}], "define_vlm_length": 9.0},
    ]
    extended = [{"name": "x", "codelist": f"R{k % 5}", "value": n if k % 3 == 0 else f"OLD {k}" if k % 3 == 1 else f"NEW {k}"} for k, n in enumerate(names)]
    return {"datasets": datasets, "variables": variables, "codelists": [], "value_levels": levels, "standards": [], "external_dictionaries": [{"dictionary": "MedDRA", "version": "26.0"}], "extended_terms": extended}


def _base(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return normal_types(spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))).withColumn(RECORD, F.col("id") + 1)


def study(spark: SparkSession, sf_dir: str) -> Study:
    events = _base(spark, sf_dir, "events", EVENTS)
    meta = [VariableMeta(f.name, f"Label of {f.name}" if f.name == "EVNAME" else f.name.title(), "Num" if f.name in ("id", "EVK") else "Char", _LENGTHS.get(f.name, 20)) for f in events.schema if not f.name.startswith("__")]
    customers = _base(spark, sf_dir, "customer", CUSTOMERS)
    own = [VariableMeta(f.name, "", "Num" if f.name in ("id", "EVK") else "Char", {"EVNAME": 12, "CUNAME": 18}.get(f.name, 20)) for f in customers.schema if not f.name.startswith("__")]
    datasets = {
        "EV": Dataset("EV", events, meta, "Events", 4096, "ev.xpt", "EV"), "CU": Dataset("CU", customers, own, "Customers", 2048, "cu.xpt", "CU"),
        "DM": Dataset("DM", _base(spark, sf_dir, "events", SUBJECTS), [], "Subjects", 1024, "dm.xpt"),
    }
    stf = [{"document": f"doc{i}", "file_tag": tag, "file_name": f"f{i}.xpt"} for i, tag in enumerate(("data-tabulation-dataset", "pre-clinical-study-report", ""))]
    return Study(datasets, define(spark, sf_dir), stf, "sdtmct-2024-03-29", "SDTMIG", "3.4", library=library(spark, sf_dir))


def nations(spark: SparkSession, sf_dir: str) -> Study:
    """A dataset of customers per nation: its domain is that of the region (the last region's have none), those of region 1 have a balance, and the file's size is told by its customers.

    The guide knows the nations' domains by class.
    """
    customers, places = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    per = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    rows = places.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).join(per, "n_nationkey", "left").orderBy("n_nationkey").collect()  # 25 rows
    datasets = {}
    for r in rows:
        own = customers.filter(F.col("c_nationkey") == r["n_nationkey"])
        df = own.select("c_custkey", *(["c_acctbal"] if r["n_regionkey"] == 1 else []), F.col("c_custkey").cast("bigint").alias(RECORD))
        domain = r["r_name"][:2] if r["n_regionkey"] < 4 else ""
        datasets[r["n_name"]] = Dataset(r["n_name"], df, label=r["r_name"], file_size=100 * (r["customers"] or 0), file_name=f"{r['n_name'].lower()}.xpt", domain_value=domain)
    guide = [{"standard": "SDTMIG", "version": "3-4", "domain": r["n_name"], "variable": "c_custkey", "label": "Key", "role": "Identifier", "type": "Num", "core": "Req", "ordinal": 1} for r in rows]
    return Study(datasets, product="SDTMIG", version="3.4", library=Library(guide, domain_classes={r["n_name"]: _CLASS[r["n_nationkey"] % 3] for r in rows}))


def _operand(s: Study, operation: Operation, name: str = "EV", core1: bool = False, df: DataFrame | None = None):
    d = s.get(name)
    table = Table(d.df if df is None else df, d, s, "EV")
    return table, materialised(compute(operation, table, s, Dialect.CORE1 if core1 else Dialect.CDISC), table)


def listed(operator: str, options: dict, core1: bool = False, of: Callable[[SparkSession, str], Study] = study, name: str = "EV") -> Callable[[SparkSession, str], DataFrame]:
    """What an operation gives for the dataset as a whole: one row per member, in order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, found = _operand(of(spark, sf_dir), Operation("$v", operator, options), name, core1)
        if found.values is None:  # joined to each row
            return table.df.limit(1).select(F.posexplode(found.col).alias("place", "member")).select(F.col("place").cast("bigint").alias("place"), "member")
        column = found.col if found.is_set else F.array(found.text())
        return spark.range(1).select(F.posexplode(column).alias("place", "member")).select(F.col("place").cast("bigint").alias("place"), "member")

    return query


def per_row(operator: str, options: dict, core1: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """What an operation gives for each row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, found = _operand(study(spark, sf_dir), Operation("$v", operator, options), core1=core1)
        value = F.array_join(found.col, ",") if found.is_set else found.text()
        return table.df.select("id", value.alias("value"))

    return query


def per_variable(operator: str) -> Callable[[SparkSession, str], DataFrame]:
    """What an operation gives for each variable of EV, as a variable metadata rule asks for it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = study(spark, sf_dir)
        names = spark.createDataFrame([(v.name, i + 1) for i, v in enumerate(s.get("EV").variables)], f"variable_name string, {RECORD} bigint")
        table, found = _operand(s, Operation("$v", operator, {}), df=names)
        return table.df.select("variable_name", found.text().alias("value"))

    return query


def findings(check: dict, rule_type: str, output: list[str], core1: bool = False, only: str = "EV", sensitivity: str = "Record", operations: list[Operation] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The findings of one rule: Dataset, Record, Variable, Value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = Rule("R", check, rule_type, sensitivity, operations or [], output=output, source="core_contributor" if core1 else "")
        return run(spark, [rule], study(spark, sf_dir), None, [only]).findings.select("Dataset", "Record", "Variable", "Value")

    return query


def refused(check: dict, operations: list[Operation] | None = None, rule_type: str = "Record Data") -> Callable[[SparkSession, str], DataFrame]:
    """Why a rule over EV is left out."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, [Rule("R", check, rule_type, operations=operations or [])], study(spark, sf_dir), None, ["EV"]).skipped

    return query


def document(spark: SparkSession, sf_dir: str) -> str:
    """A document of regions and their nations; every nation refers to its region by id, and some to a nation after it."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # 25 rows
    regions = [
        {"id": f"R{k}", "instanceType": "Region", "name": next(r["r_name"] for r in rows if r["r_regionkey"] == k),
         "nations": [{"id": f"N{r['n_nationkey']}", "instanceType": "Nation", "key": r["n_nationkey"], "name": r["n_name"], "regionId": f"R{k}", **({"after": f"N{r['n_nationkey'] + 5}"} if r["n_nationkey"] < 20 else {})} for r in rows if r["r_regionkey"] == k]}
        for k in sorted({r["r_regionkey"] for r in rows})
    ]
    return json.dumps({"usdmVersion": "4.0", "study": {"id": "S", "instanceType": "Study", "regions": regions}})


def jsonata(expression: str, output: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """The findings of a JSONata rule over the document, which is read from a file as a study is."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_folder(spark, "document") / "study.json"
        path.write_text(document(spark, sf_dir), encoding="utf-8")
        s = read_usdm(spark, path)
        return run(spark, [Rule("R", expression, "JSONata", output=output)], s, None).findings.select("Dataset", "Record", "Variable", "Value")

    return query


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required variables that EV lacks, as a report names them."""
    operations = [Operation("$required_variables", "required_variables", {}), Operation("$dataset_variables", "get_column_order_from_dataset", {})]
    rule = Rule("R", _leaf("$dataset_variables", "not_contains_all", "$required_variables"), sensitivity="Dataset", operations=operations, output=["$required_variables", "$dataset_variables"])
    return binding_gaps(run(spark, [rule], study(spark, sf_dir), None, ["EV"])).select("rule_id", "label", "member")


def large_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, all of them beyond a text's bound, that no dataset of line items holds; every name has an apostrophe."""
    name = "concat('O''Part, ', CAST({} AS STRING))"
    parts = _base(spark, sf_dir, "part", f"SELECT p_partkey AS id, {name.format('p_partkey')} AS PANAME FROM {{t}}")
    lines = _base(spark, sf_dir, "lineitem", f"SELECT l_orderkey * 8 + l_linenumber AS id, {name.format('l_partkey')} AS LINAME FROM {{t}} WHERE l_linenumber = 1 AND l_partkey % 3 > 0")
    s = Study({"LI": Dataset("LI", lines), "PA": Dataset("PA", parts)})
    operations = [Operation("$all_parts", "distinct", {"name": "PANAME", "domain": "PA"}), Operation("$dataset_parts", "distinct", {"name": "LINAME"})]
    rule = Rule("R", _leaf("LINAME", "is_contained_by", "$all_parts"), sensitivity="Dataset", operations=operations, output=["$all_parts", "$dataset_parts"])
    return binding_gaps(run(spark, [rule], s, None, ["LI"])).select("rule_id", "label", "member")


def _leaf(name: str, operator: str, value: object = None, **more: object) -> dict:
    return {"name": name, "operator": operator, **({} if value is None else {"value": value}), **more}


_E, _C = f"({EVENTS.format(t='events')}) e", f"({CUSTOMERS.format(t='customer')}) c"
_EV_COLUMNS = ["id", "USUBJID", "DOMAIN", "EVTERM", "EVK", "EVNAME", "EVCODE", "EVVER", "EVDTC", "RDOMAIN", "EVVAR", "EVHTML"]
_CU_COLUMNS = ["id", "DOMAIN", "CUNAME", "CUSEG", "EVK", "EVNAME"]
_GUIDE_NAME = "CASE n_nationkey WHEN 1 THEN 'EVNAME' ELSE 'EVX' || CAST(n_nationkey AS STRING) END"
_MODEL_NAME = "CASE n_nationkey WHEN 1 THEN 'EVTERM' ELSE 'EVM' || CAST(n_nationkey AS STRING) END"


def _list_sql(value: str, source: str, order: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS place, {value} AS member FROM {source}"


def _literal(*members: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS place, '{m}' AS member" for i, m in enumerate(members))


def _row_sql(value: str) -> str:
    return f"SELECT id, {value} AS value FROM {_E}"


def _finding(pairs: dict[str, str], where: str = "true", record: str = "id + 1", source: str = _E, dataset: str = "EV") -> str:
    """One row per pair of a variable and the SQL of its value."""
    return " UNION ALL ".join(f"SELECT '{dataset}' AS \"Dataset\", CAST({record} AS BIGINT) AS \"Record\", '{k}' AS \"Variable\", {v} AS \"Value\" FROM {source} WHERE {where}" for k, v in pairs.items())


def _rows(columns: list[str], rows: list[tuple]) -> str:
    """Findings of a small table: the record and the values of its columns, by hand."""
    cells = [(n, c, v) for n, *values in rows for c, v in zip(columns, values)]
    return " UNION ALL ".join(f"SELECT 'EV' AS \"Dataset\", CAST({n} AS BIGINT) AS \"Record\", '{c}' AS \"Variable\", '{v}' AS \"Value\"" for n, c, v in cells)


_NATION = "nation JOIN region ON n_regionkey = r_regionkey"
_DAYS = "date_diff('day', CAST(s.r AS DATE), CAST(left(e.EVDTC, 10) AS DATE))"
_SUBJECT = "(SELECT CAST(user_id AS STRING) AS u, left(CAST(min(ts) + INTERVAL '3' DAY AS STRING), 10) AS r FROM events GROUP BY user_id) s"
_LONGEST = " UNION ALL ".join([f"SELECT '{c}' AS v, max(length(CAST({c} AS STRING))) AS n FROM {_E}" for c in _EV_COLUMNS if c != "EVK"] + [f"SELECT 'EVK', max(length(CAST(CAST(EVK AS BIGINT) AS STRING))) FROM {_E}"]
                                + [f"SELECT '{c}', max(length(CAST({c} AS STRING))) FROM {_C}" for c in _CU_COLUMNS if c != "EVK"] + [f"SELECT 'EVK', max(length(CAST(CAST(EVK AS BIGINT) AS STRING))) FROM {_C}"]
                                + ["SELECT 'id', max(length(CAST(i AS STRING))) FROM (SELECT min(event_id) AS i FROM events GROUP BY user_id) x", "SELECT 'USUBJID', max(length(CAST(user_id AS STRING))) FROM events"])


def _declared(pick: Callable, lengths: dict[str, list[int]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable_name, '{pick(lengths[c])}' AS value" for c in _EV_COLUMNS)


_DECLARED = {c: [_LENGTHS.get(c, 20)] + ([{"EVNAME": 12}.get(c, 20)] if c in _CU_COLUMNS else []) for c in _EV_COLUMNS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


# Operations over the guide, the model and the study.
for _core, _operation in (("0", "required_variables"), ("1", "expected_variables")):
    _add(f"op_{_operation}", listed(_operation, {}), _list_sql(_GUIDE_NAME, f"nation WHERE n_nationkey < 15 AND n_nationkey % 3 = {_core}", "n_nationkey"))
_ORDER = f"""SELECT {_MODEL_NAME} AS m, n_nationkey % 3 * 10 AS part, -n_nationkey AS spot FROM nation UNION ALL
SELECT {_GUIDE_NAME}, CASE n_nationkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 25 END, n_nationkey FROM nation WHERE n_nationkey < 15"""
_add("op_get_column_order_from_library", listed("get_column_order_from_library", {}), _list_sql("m", f"({_ORDER}) o", "part, spot"))
_add("op_get_model_column_order", listed("get_model_column_order", {}), _list_sql(_MODEL_NAME, "nation", "n_nationkey % 3, -n_nationkey"))
_add("op_get_model_filtered_variables", listed("get_model_filtered_variables", {"key_name": "role", "key_value": "timing"}), _list_sql(_MODEL_NAME, "nation WHERE n_regionkey % 3 = 2", "n_nationkey % 3, -n_nationkey"))
_add("op_get_dataset_filtered_variables", listed("get_dataset_filtered_variables", {"key_name": "type", "key_value": "Char"}), _literal("EVNAME", "EVTERM"))
_OF = {"of": nations, "name": "NATION_7"}
_SEVENTH = "n_name = 'NATION_7'"
_add("op_standard_domains", listed("standard_domains", {}, **_OF), _list_sql("n_name", "nation", "n_nationkey"))
_add("op_standard_domains_class", listed("standard_domains", {"domain_class": "Events"}, **_OF), _list_sql("n_name", "nation WHERE n_nationkey % 3 = 1", "n_nationkey"))
_add("op_study_domains", listed("study_domains", {}, **_OF), _list_sql("d", "(SELECT DISTINCT CASE WHEN r_regionkey < 4 THEN left(r_name, 2) ELSE '' END AS d FROM nation JOIN region ON n_regionkey = r_regionkey) x", "d"))
_add("op_study_domains_core1", listed("study_domains", {}, True, **_OF), _list_sql("d", "(SELECT DISTINCT CASE WHEN r_regionkey < 4 THEN left(r_name, 2) ELSE n_name END AS d FROM nation JOIN region ON n_regionkey = r_regionkey) x", "d"))
_add("op_dataset_names", listed("dataset_names", {}, **_OF), _list_sql("n_name", "nation", "n_name"))
_add("op_domain_is_custom", listed("domain_is_custom", {}), _literal("false"))
_add("op_domain_label", listed("domain_label", {}), "SELECT CAST(0 AS BIGINT) AS place, r_name AS member FROM region WHERE r_regionkey = 2")
_add("op_variable_count", listed("variable_count", {"name": "c_acctbal"}, **_OF), "SELECT CAST(0 AS BIGINT) AS place, CAST(count(*) AS STRING) AS member FROM nation WHERE n_regionkey = 1")
_add("op_extract_metadata", listed("extract_metadata", {"name": "dataset_size"}, **_OF), f"SELECT CAST(0 AS BIGINT) AS place, CAST(100 * count(c_custkey) AS STRING) AS member FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE {_SEVENTH}")
_add("op_extract_metadata_name", listed("extract_metadata", {"name": "dataset_name"}, **_OF), f"SELECT CAST(0 AS BIGINT) AS place, n_name AS member FROM nation WHERE {_SEVENTH}")
_add("op_get_countries", listed("get_countries", {"attribute_name": "name"}), _list_sql("n_name", "nation", "n_nationkey"))
_add("op_get_parent_model_column_order", per_row("get_parent_model_column_order", {}), _row_sql(f"CASE upper(RDOMAIN) WHEN 'EV' THEN (SELECT string_agg({_MODEL_NAME}, ',' ORDER BY n_nationkey % 3, -n_nationkey) FROM nation) ELSE '' END"))
_add("op_referenced_domain_variable_names", per_row("referenced_domain_variable_names", {"name": "RDOMAIN"}), _row_sql(f"CASE upper(RDOMAIN) WHEN 'EV' THEN '{','.join(c.upper() for c in _EV_COLUMNS)}' WHEN 'CU' THEN '{','.join(c.upper() for c in _CU_COLUMNS)}' ELSE '' END"))
_add("op_label_referenced_variable_metadata", per_row("label_referenced_variable_metadata", {"name": "EVNAME", "attribute_name": "name"}), _row_sql(f"(SELECT {_GUIDE_NAME} FROM nation WHERE n_name = EVNAME AND n_nationkey % 2 = 1)"))
_add("op_distinct_reference", listed("distinct", {"name": "EVVAR", "value_is_reference": True, "filter": {"EVTERM": "click"}}), _list_sql("v", f"(SELECT DISTINCT EVVAR AS v FROM {_E} WHERE EVTERM = 'click' AND ((EVVAR = 'EVTERM' AND upper(RDOMAIN) = 'EV') OR (EVVAR = 'CUNAME' AND upper(RDOMAIN) = 'CU'))) d", "v"))
_add("op_dy", per_row("dy", {"name": "--DTC"}), f"SELECT e.id, CAST({_DAYS} + CASE WHEN {_DAYS} >= 0 THEN 1 ELSE 0 END AS STRING) AS value FROM {_E} JOIN {_SUBJECT} ON s.u = e.USUBJID")
_add("op_get_xhtml_errors", findings(_leaf("$e", "non_empty"), "Record Data", ["EVHTML"], operations=[Operation("$e", "get_xhtml_errors", {"name": "EVHTML"})]), _finding({"EVHTML": "EVHTML"}, "EVHTML = '<p>bad'"))
_add("op_max_variable_value_length", per_variable("max_variable_value_length"), f"SELECT v AS variable_name, CAST(max(n) AS STRING) AS value FROM ({_LONGEST}) l WHERE v IN ({', '.join(repr(c) for c in _EV_COLUMNS)}) GROUP BY v")
_add("op_global_max_variable_length", per_variable("global_max_variable_length"), _declared(max, _DECLARED))
_add("op_global_min_variable_length", per_variable("global_min_variable_length"), _declared(min, _DECLARED))

# Operations over the terminology and the define.
_add("op_valid_codelist_dates", listed("valid_codelist_dates", {"ct_package_types": ["SDTM"]}), _list_sql("'202' || CAST(r_regionkey AS STRING) || '-01-01'", "region WHERE r_regionkey % 2 = 1", "r_regionkey"))
_add("op_codelist_terms", listed("codelist_terms", {"codelists": ["R1", "ASIA"]}), _list_sql("n_name", "nation WHERE n_regionkey IN (1, 2)", "n_regionkey, n_nationkey"))
_add("op_codelist_terms_row", per_row("codelist_terms", {"codelists": ["R1", "R2"], "term_value": "EVNAME", "returntype": "code"}), _row_sql("(SELECT 'T' || CAST(n_nationkey AS STRING) FROM nation WHERE n_name = EVNAME AND n_regionkey IN (1, 2))"))
_add("op_get_codelist_attributes", listed("get_codelist_attributes", {"ct_attribute": "Term CCODE"}), _list_sql("'T' || CAST(n_nationkey AS STRING)", "nation", "n_regionkey, n_nationkey"))
_add("op_get_codelist_attributes_row", per_row("get_codelist_attributes", {"ct_attribute": "Codelist CCODE", "version": "EVVER"}), _row_sql("CASE EVVER WHEN '2024-03-29' THEN 'R0,R1,R2,R3,R4' WHEN '2023-12-15' THEN 'R0,R1,R2' ELSE '' END"))
_add("op_codelist_extensible", per_row("codelist_extensible", {"version": "EVVER", "codelist_code": "EVCODE"}), _row_sql("CASE WHEN EVVER = '2024-03-29' THEN CASE WHEN EVCODE IN ('R1', 'R3') THEN 'true' ELSE 'false' END WHEN EVVER = '2023-12-15' AND EVCODE IN ('R0', 'R1', 'R2') THEN CASE WHEN EVCODE IN ('R0', 'R2') THEN 'true' ELSE 'false' END END"))
_add("op_define_extended_terms_in_ct", listed("define_extended_terms_in_ct", {}), _list_sql("CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE 'OLD ' || CAST(n_nationkey AS STRING) END", "nation WHERE n_nationkey % 3 < 2 AND n_nationkey % 5 = n_regionkey", "n_nationkey"))
_add("op_define_variable_metadata", listed("define_variable_metadata", {"name": "--NAME", "attribute_name": "define_variable_label"}), _literal("Label of EVNAME"))
_add("op_get_define_external_dictionary_version", listed("get_define_external_dictionary_version", {"external_dictionary_type": "meddra"}), _literal("26.0"))


def _why(reason: str) -> str:
    return f"SELECT 'R' AS rule_id, 'EV' AS domain, '{reason}' AS reason"


_add("op_get_external_dictionary_version", refused(_leaf("$v", "equal_to", "x"), [Operation("$v", "get_external_dictionary_version", {"external_dictionary_type": "loinc"})]), _why("needs the loinc dictionary, which is not supplied"))
for _name in sorted(n for n in OPERATORS if n.endswith("_reference") and "_valid_" in n):
    _title = {"meddra": "MedDRA", "whodrug": "WHODrug", "unii": "UNII", "loinc": "LOINC", "snomed": "SNOMED", "medrt": "MED-RT"}[_name.split("_valid_")[1].split("_")[0]]
    _add(_name, refused(_leaf("EVTERM", _name, "EVCODE")), _why(f"needs the {_title} dictionary"))

# Rule types.
_add("type_domain_presence", findings(_leaf("TS", "not_exists"), "Domain Presence Check", []), "SELECT 'STUDY' AS \"Dataset\", CAST(NULL AS BIGINT) AS \"Record\", 'TS' AS \"Variable\", 'Not in dataset' AS \"Value\"")
_add("type_domain_presence_define", findings(_leaf("filename", "empty"), "Domain Presence Check against Define XML", ["define_dataset_name", "domain"], sensitivity="Record"), _rows(["define_dataset_name", "domain"], [(3, "XX", "")]))
_add("type_dataset_metadata", findings(_leaf("record_count", "greater_than", 10), "Dataset Metadata Check", ["dataset_name", "dataset_label", "record_count"]), f"""
SELECT 'EV' AS "Dataset", CAST(NULL AS BIGINT) AS "Record", v AS "Variable", CASE v WHEN 'dataset_name' THEN 'EV' WHEN 'dataset_label' THEN 'Events' ELSE n END AS "Value"
FROM (SELECT CAST(count(*) AS STRING) AS n FROM events HAVING count(*) > 10) c CROSS JOIN (VALUES ('dataset_name'), ('dataset_label'), ('record_count')) x(v)""")
_add("type_dataset_metadata_define", findings(_leaf("dataset_label", "equal_to", "define_dataset_label"), "Dataset Metadata Check against Define XML", ["define_dataset_label", "define_dataset_structure"]),
     """SELECT 'EV' AS "Dataset", CAST(NULL AS BIGINT) AS "Record", 'define_dataset_label' AS "Variable", 'Events' AS "Value" UNION ALL SELECT 'EV', NULL, 'define_dataset_structure', 'One record'""")  # fmt: skip
_add("type_variable_metadata_library", findings(_leaf("library_variable_name", "non_empty"), "Variable Metadata Check against Library Metadata", ["variable_name", "library_variable_core", "library_variable_role", "library_variable_has_codelist"]), f"""
SELECT 'EV' AS "Dataset", CAST(CASE n_nationkey WHEN 1 THEN {_EV_COLUMNS.index('EVNAME') + 1} END AS BIGINT) AS "Record", v AS "Variable",
  CASE v WHEN 'variable_name' THEN 'EVNAME' WHEN 'library_variable_core' THEN 'Exp' WHEN 'library_variable_role' THEN 'Topic' ELSE 'True' END AS "Value"
FROM nation CROSS JOIN (VALUES ('variable_name'), ('library_variable_core'), ('library_variable_role'), ('library_variable_has_codelist')) x(v) WHERE n_nationkey = 1
UNION ALL SELECT 'EV', {_EV_COLUMNS.index('EVTERM') + 1}, v, CASE v WHEN 'variable_name' THEN 'EVTERM' WHEN 'library_variable_core' THEN '' WHEN 'library_variable_role' THEN CASE n_regionkey % 3 WHEN 0 THEN 'Identifier' WHEN 1 THEN 'Topic' ELSE 'Timing' END ELSE 'False' END
FROM nation CROSS JOIN (VALUES ('variable_name'), ('library_variable_core'), ('library_variable_role'), ('library_variable_has_codelist')) x(v) WHERE n_nationkey = 1""")
_add("type_variable_metadata_define", findings(_leaf("variable_label", "equal_to", "define_variable_label"), "Variable Metadata Check against Define XML", ["variable_name", "define_variable_length"]), _rows(["variable_name", "define_variable_length"], [(_EV_COLUMNS.index("EVNAME") + 1, "EVNAME", "8")]))
_add("type_variable_metadata_define_library", findings(_leaf("define_variable_name", "non_empty"), "Variable Metadata Check against Define XML and Library Metadata", ["define_variable_name", "library_variable_name"], core1=True),
     _rows(["define_variable_name", "library_variable_name"], [(_EV_COLUMNS.index("USUBJID") + 1, "USUBJID", ""), (_EV_COLUMNS.index("EVNAME") + 1, "EVNAME", "EVNAME"), (len(_EV_COLUMNS) + 1, "EVGONE", "")]))
_add("type_value_dataset_metadata", findings({"all": [_leaf("variable_name", "equal_to", "EVTERM", value_is_literal=True), _leaf("variable_value_length", "greater_than", 5), _leaf("record_count", "greater_than", 1)]}, "Value Check with Dataset Metadata", ["variable_value", "dataset_label"]),
     _finding({"variable_value": "EVTERM", "dataset_label": "'Events'"}, "length(EVTERM) > 5"))
_add("type_value_define_variable", findings(_leaf("variable_value_length", "greater_than", "define_variable_length"), "Value Check against Define XML Variable", ["variable_name", "variable_value"]),
     _finding({"variable_name": "'EVNAME'", "variable_value": "EVNAME"}, "length(EVNAME) > 8"))
_add("type_value_library", findings({"all": [_leaf("library_variable_has_codelist", "equal_to", "True", value_is_literal=True), _leaf("variable_value", "is_not_substring_of", "library_variable_ccode_values")]}, "Value Check against Library Metadata", ["variable_value", "library_variable_codelist_value"], core1=True),
     _finding({"variable_value": "EVNAME", "library_variable_codelist_value": "(SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 1)"}, "EVNAME NOT IN (SELECT n_name FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1))"))
_add("type_value_level", findings(_leaf("variable_value_length", "greater_than_or_equal_to", "define_vlm_length", type_insensitive=True), "Value Check against Define XML VLM", ["variable_value", "define_vlm_length"], core1=True),
     _finding({"variable_value": "EVNAME", "define_vlm_length": "'8.0'"}, "EVTERM = 'click' AND length(EVNAME) >= 8") + " UNION ALL " + _finding({"variable_value": "EVNAME", "define_vlm_length": "'9.0'"}, "EVK >= 20 AND EVTERM NOT IN ('click', 'view') AND length(EVNAME) >= 9"))
_add("type_define_item", findings(_leaf("define_variable_key_sequence", "empty"), "Define Item Metadata Check", ["define_variable_name", "define_variable_label"]), _rows(["define_variable_name", "define_variable_label"], [(3, "EVGONE", "Label of EVGONE")]))
_add("type_define_item_library", findings(_leaf("library_variable_core", "empty"), "Define Item Metadata Check against Library Metadata", ["define_variable_name", "library_variable_name"]), _rows(["define_variable_name", "library_variable_name"], [(2, "USUBJID", ""), (3, "EVGONE", "")]))
_add("type_dataset_contents", findings(_leaf("define_key_sequence_is_unique", "equal_to", False), "Dataset Contents Check against Define XML", ["USUBJID", "EVNAME", "define_dataset_label"]),
     _finding({"USUBJID": "USUBJID", "EVNAME": "EVNAME", "define_dataset_label": "'Events'"}, "n > 1", source=f"(SELECT *, count(*) OVER (PARTITION BY USUBJID, EVNAME) AS n FROM {_E}) k"))
_add("type_stf", findings(_leaf("file_tag", "empty"), "STF Metadata Check", ["document", "file_name"]), _rows(["document", "file_name"], [(3, "doc2", "f2.xpt")]))
_add("type_json_schema", refused({}, rule_type="JSON Schema Check"), _why("rule type not supported: JSON Schema Check"))

# A document's rules. Records of an entity are numbered in the order of the document: nations by region, then key.
_NATIONS = "(SELECT *, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey) x"


def _document_sql(pairs: dict[str, str], where: str) -> str:
    return _finding(pairs, where, "place", _NATIONS, "NATION")


_add("type_jsonata", jsonata("study.regions.nations[key % 2 = 1 and key > 4].{'entity': instanceType, 'path': _path, 'name': name, 'region': %.name}", ["name", "region"]), _document_sql({"name": "n_name", "region": "r_name"}, "n_nationkey % 2 = 1 AND n_nationkey > 4"))
_add("type_jsonata_functions", jsonata("""
  ( $big := function($n) { $n.key >= 10 };
    $names := $map($filter(**.nations, $big), function($n) { $n.name });
    study.regions@$r.$r.nations[$not(name in $names)].{'instanceType': 'Nation', '_path': _path, 'label': $uppercase($substringBefore(name, '_')) & '/' & $string(key * 2), 'same': $r.id = regionId} )""", ["label", "same", "absent"]),
     _document_sql({"label": "upper(split_part(n_name, '_', 1)) || '/' || CAST(n_nationkey * 2 AS STRING)", "same": "'TRUE'", "absent": "''"}, "n_nationkey < 10"))
_add("type_jsonata_utilities", jsonata("""
  ( $all := study.regions.nations;
    $chains := $utils.parse_refs('after', 'next', $all);
    $chains[key < 5].{'entity': instanceType, 'path': _path, 'last': **[key >= 20].name, 'links': $count(**.next),
      'sifted': ($n := $; $last := 'NATION_' & $string(key + 20); $join($keys($utils.sift_tree($n, $last, ['key'], true)), '+'))} )""", ["last", "links", "sifted"]),
     _document_sql({"last": "'NATION_' || CAST(n_nationkey + 20 AS STRING)", "links": "'4'", "sifted": "'Nation.key+Nation.next'"}, "n_nationkey < 5"))
_add("binding_gap", gaps, f"SELECT 'R' AS rule_id, 'required variables' AS label, {_GUIDE_NAME} AS member FROM nation WHERE n_nationkey < 15 AND n_nationkey % 3 = 0")
_add("binding_gap_large", large_gaps, "SELECT 'R' AS rule_id, 'all parts' AS label, 'O''Part, ' || CAST(p_partkey AS STRING) AS member FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 > 0)")
