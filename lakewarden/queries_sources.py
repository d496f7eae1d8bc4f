"""Registered queries of sources, scope, results and sinks, each with the SQL it must equal.

A source query writes a driver table as a file of one format, by tasks, and reads it
with the engine's reader.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .model import RECORD, Dataset, Library, Rule, Study, VariableMeta
from .plans.asof import as_of
from .queries import BASES, base, base_sql
from .results import filter_findings, records, summary
from .runner import run
from .shared import new_folder, new_path, write_file
from .sources import dataset_json, define_xml, study_folder
from .sources.frame import normal_types, parquet
from .sources.testcase import read_case
from .sources.usdm import read_usdm
from .sources.xpt import front, observations, rest
from .streaming import violation_counts, violations
from .streaming.stateful import duplicates, with_counts, without_next

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return add


def _folder(spark: SparkSession) -> Path:
    """A folder for sample files, in the one that driver and executors share; it lives as long as the application."""
    return new_folder(spark, "files")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers in order, as rows for a sample file."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey")
    return table.select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("CUID"), F.concat("c_name", F.lit(', "é"\n')).alias("CUNAME"), "c_acctbal", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise("").alias("CUSEG"))


def _tuples(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns)))


def _csv_text(rows: list) -> bytes:
    text = io.StringIO(newline="")
    csv.writer(text).writerows(rows)
    return text.getvalue().encode()


def _write_csv(spark: SparkSession, sf_dir: str, path: Path) -> None:
    write_file(_customers(spark, sf_dir), path, lambda batch: _csv_text(_tuples(batch)), _csv_text([[v.name for v in _FIELDS]]))


def _write_xpt(rows: DataFrame, path: Path, name: str, variables: list[VariableMeta], label: str) -> None:
    write_file(rows, path, lambda batch: observations(variables, _tuples(batch)), front(name, variables, label), rest(variables, rows.count()))


_FIELDS = [VariableMeta("CUID", "Identifier", "Char", 6), VariableMeta("CUNAME", "Name", "Char", 30), VariableMeta("CUBAL", "Balance", "Num", 8), VariableMeta("CUSEG", "Segment", "Char", 10)]
#: What every file of the customers must give: the record, the identifier with its zeros, length of the name, the balance and the segment.
_SHOWN = """SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS record, lpad(CAST(c_custkey AS STRING), 6, '0') AS cuid, CAST(length(c_name) + {} AS BIGINT) AS name_length, c_acctbal AS balance,
CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE '' END AS segment FROM customer"""


def _shown(d: Dataset) -> DataFrame:
    return d.df.select(F.col(RECORD).alias("record"), F.col("CUID").alias("cuid"), F.length("CUNAME").cast("bigint").alias("name_length"), F.col("CUBAL").alias("balance"), F.col("CUSEG").alias("segment"))


@_query("source_csv", _SHOWN.format(6))
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) / "cu.csv"
    _write_csv(spark, sf_dir, path)
    return _shown(study_folder.read_file(spark, path))


@_query("source_test_case", _SHOWN.format(6))
def source_test_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    _write_csv(spark, sf_dir, folder / "cu.csv")
    (folder / "_datasets.csv").write_text("Filename,Label\ncu.csv,Customers\n")
    (folder / "_variables.csv").write_text("dataset,variable,label,type,length\n" + "".join(f"cu.csv,{v.name},{v.label},{v.type},{v.length}\n" for v in _FIELDS))
    (folder / "_env").write_text("PRODUCT=sdtmig\nVERSION=3-4\n")
    return _shown(read_case(spark, folder).datasets["CU"])


@_query("source_xpt", _SHOWN.format(1))
def source_xpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) / "cu.xpt"
    rows = _customers(spark, sf_dir).withColumn("CUNAME", F.concat(F.substring_index("CUNAME", ",", 1), F.lit(",")))
    _write_xpt(rows, path, "CU", _FIELDS, "Customers")
    return _shown(study_folder.read_file(spark, path))


def _json_head() -> dict:
    return {"datasetJSONVersion": "1.1.0", "name": "CU", "label": "Customers", "columns": [{"itemOID": v.name, "name": v.name, "label": v.label, "dataType": "string" if v.type == "Char" else "double", "length": v.length} for v in _FIELDS]}


@_query("source_dataset_json", _SHOWN.format(6))
def source_dataset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _folder(spark) / "cu.json", _customers(spark, sf_dir)
    before, after = json.dumps(_json_head() | {"records": rows.count(), "rows": []}, indent=1).encode().rsplit(b"]", 1)
    write_file(rows, path, lambda batch: b"".join(b",\n  " + json.dumps(r, indent=1).replace("\n", "\n  ").encode() for r in _tuples(batch)), before, b"\n ]" + after, skip=1)
    return _shown(dataset_json.read_dataset_json(spark, path))


@_query("source_ndjson", _SHOWN.format(6))
def source_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _folder(spark) / "cu.ndjson", _customers(spark, sf_dir)
    head = json.dumps(_json_head() | {"records": rows.count()}).encode() + b"\n"
    write_file(rows, path, lambda batch: b"".join(json.dumps(r).encode() + b"\n" for r in _tuples(batch)), head)
    return _shown(dataset_json.read_dataset_json(spark, path))


@_query("source_parquet", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE 1 END, l_orderkey, l_linenumber) AS BIGINT) AS record FROM lineitem")
def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are numbered over many files of unlike size, in the order of the files' names."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7 != 0).cast("int").alias("part"))
    by, path = ("part", "l_orderkey", "l_linenumber"), new_path(spark, "lines")
    lines.repartitionByRange(6, *by).sortWithinPartitions(*by).write.partitionBy("part").parquet(path)
    return parquet(spark, path, "LI").df.select("l_orderkey", "l_linenumber", F.col(RECORD).alias("record"))


@_query("source_parquet_one", "SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS last, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem")
def source_parquet_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one file are numbered from one without a gap."""
    d = parquet(spark, f"{sf_dir}/lineitem.parquet", "LI")
    return d.df.agg(F.count_distinct(RECORD).alias("records"), F.max(RECORD).alias("last"), F.sum("l_linenumber").cast("bigint").alias("numbers"))


@_query("source_usdm", "SELECT upper(r_name) AS parent, n_name AS name, CAST(n_nationkey AS DOUBLE) AS key, '/study/regions/' || CAST(r_regionkey AS STRING) || '/nations/' || CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS STRING) AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_usdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries_reference import document

    path = _folder(spark) / "study.json"
    path.write_text(document(spark, sf_dir), encoding="utf-8")
    s = read_usdm(spark, path)
    regions = s.get("Region").df.filter("rel_type = 'definition'").select(F.col("id").alias("rid"), F.upper("name").alias("parent"))
    nations = s.get("Nation").df
    return nations.join(regions, nations["parent_id"] == regions["rid"]).select("parent", "name", "key", F.col("_path").alias("path"))


def _define_text(names: list[str]) -> str:
    items = "".join(f'<ItemDef OID="IT.{n}" Name="{n}" DataType="text" Length="{len(n)}"><Description><TranslatedText>About {n}</TranslatedText></Description></ItemDef>' for n in names)
    refs = "".join(f'<ItemRef ItemOID="IT.{n}" OrderNumber="{i + 1}" Mandatory="{"Yes" if i % 2 else "No"}"{" KeySequence=" + chr(34) + "1" + chr(34) if i == 0 else ""}/>' for i, n in enumerate(names))
    return f'<ODM xmlns="http://www.cdisc.org/ns/odm/v1.3"><Study><MetaDataVersion><ItemGroupDef OID="IG.NT" Name="NT" Domain="NT"><Description><TranslatedText>Nations</TranslatedText></Description>{refs}</ItemGroupDef>{items}</MetaDataVersion></Study></ODM>'


@_query("source_define_xml", "SELECT n_name AS name, 'About ' || n_name AS label, CAST(length(n_name) AS DOUBLE) AS length, CASE WHEN n_nationkey % 2 = 1 THEN 'Yes' ELSE 'No' END AS mandatory, CAST(n_nationkey + 1 AS BIGINT) AS place FROM nation")
def source_define_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows
    path = _folder(spark) / "define.xml"
    path.write_text(_define_text(names), encoding="utf-8")
    found = define_xml.read_define(path)["variables"]
    rows = [(v["define_variable_name"], v["define_variable_label"], v["define_variable_length"], v["define_variable_mandatory"], v["define_variable_order_number"]) for v in found]
    return spark.createDataFrame(rows, "name string, label string, length double, mandatory string, place bigint")


@_query("source_folder", """SELECT left(c_mktsegment, 2) AS dataset, CASE WHEN c_mktsegment < 'C' THEN '.xpt' WHEN c_mktsegment < 'G' THEN '.json' ELSE '.csv' END AS form, CAST(count(*) AS BIGINT) AS records,
CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_mktsegment >= 'G' OR c_custkey % CASE WHEN c_mktsegment < 'C' THEN 2 ELSE 3 END = 0 GROUP BY c_mktsegment""")
def source_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset per market segment, as CSV; of several forms of one dataset the first in order is read, which holds fewer customers here."""
    folder, key = _folder(spark), VariableMeta("K", "Key", "Num", 8)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    for (segment,) in customers.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect():  # a row per segment
        path, keys = folder / segment[:2].lower(), customers.filter(F.col("c_mktsegment") == segment).select("c_custkey").orderBy("c_custkey")
        write_file(keys, path.with_suffix(".csv"), lambda batch: "".join(f"{k}\n" for (k,) in _tuples(batch)).encode(), b"K\n")
        if segment < "G":
            rows = keys.filter("c_custkey % 3 = 0")
            about = {"datasetJSONVersion": "1.1.0", "name": segment[:2], "label": segment, "columns": [{"itemOID": "K", "name": "K", "label": "Key", "dataType": "integer"}], "records": rows.count(), "rows": []}
            before, after = json.dumps(about).encode().rsplit(b"]", 1)
            write_file(rows, path.with_suffix(".json"), lambda batch: b"".join(b", " + json.dumps(r).encode() for r in _tuples(batch)), before, b"]" + after, skip=2)
        if segment < "C":
            _write_xpt(keys.filter("c_custkey % 2 = 0"), path.with_suffix(".xpt"), segment[:2], [key], segment)
    out = None
    for name, d in study_folder.read_folder(spark, folder).datasets.items():
        one = d.df.agg(F.lit(name).alias("dataset"), F.lit(Path(d.file_name or "x.csv").suffix).alias("form"), F.count(F.lit(1)).alias("records"), F.sum("K").cast("bigint").alias("keys"))
        out = one if out is None else out.union(one)
    return out


# Scope, planning and results.

_ON = {"Include": ["EVENTS"]}


def _blank(**more: object) -> Rule:
    return Rule("EV1", {"name": "tb", "operator": "empty"}, output=["id", "tb"], domains=_ON, message="Type is required", **more)


def _events(spark: SparkSession, sf_dir: str) -> Study:
    return Study({"EVENTS": Dataset("EVENTS", base(spark, sf_dir, "events")), "ORDERS": Dataset("ORDERS", base(spark, sf_dir, "orders"))})


@_query("group_first", f"SELECT min(id) + 1 AS \"Record\", CAST(min(id) AS STRING) AS \"Value\" FROM ({base_sql('events')}) e WHERE tb = '' GROUP BY u")
def group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity Group: the first violation of each user."""
    out = run(spark, [_blank(sensitivity="Group", grouping=["u"])], _events(spark, sf_dir), None)
    return out.findings.filter("Variable = 'id'").select("Record", "Value")


@_query("filter_findings", f"SELECT 'EVENTS' AS \"Dataset\", 'EV1' AS rule_id, id + 1 AS \"Record\" FROM ({base_sql('events')}) e WHERE tb = ''")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [_blank(), Rule("OD1", {"name": "status", "operator": "equal_to", "value": "P", "value_is_literal": True}, output=["status"], domains={"Include": ["ORDERS"]})]
    out = filter_findings(run(spark, rules, _events(spark, sf_dir), None), triage="wrong value", dataset="EVENTS", rule=["EV1", "OD1"], variable="tb")
    return out.findings.select("Dataset", "rule_id", "Record")


@_query("record_sheet", f"SELECT id + 1 AS \"Record\", 'id=' || CAST(id AS STRING) || '; tb=' AS details, 'wrong value' AS triage FROM ({base_sql('events')}) e WHERE tb = ''")
def record_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(run(spark, [_blank()], _events(spark, sf_dir), None).findings).select("Record", "details", "triage")


@_query("result_summary", f"""SELECT CAST(2 AS BIGINT) AS problems, (SELECT count(*) FROM ({base_sql('events')}) e WHERE tb = '') + 1 AS records, (SELECT count(*) FROM ({base_sql('events')}) e WHERE tb = '') + 1 AS wrong_value,
CAST(2 AS BIGINT) AS checks_run, CAST(1 AS BIGINT) AS skipped""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [_blank(), Rule("OD1", {"name": "status", "operator": "equal_to", "value": "P", "value_is_literal": True}, output=["status"], sensitivity="Dataset", domains={"Include": ["ORDERS"]}), Rule("EV3", {"name": "zz", "operator": "empty"}, domains=_ON)]
    out = summary(run(spark, rules, _events(spark, sf_dir), None))
    return out.select("problems", "records", "wrong_value", F.col("checks_run").cast("bigint").alias("checks_run"), F.col("skipped").cast("bigint").alias("skipped"))


@_query("split_files", f"SELECT id + 1 AS \"Record\" FROM (SELECT *, count(*) OVER (PARTITION BY u, q) AS many FROM ({base_sql('events')}) b) e WHERE many > 1 AND id % 3 = 0")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness over all files of a split domain; findings stay with their file."""
    events = base(spark, sf_dir, "events")
    files = {f"EV{k}": Dataset(f"EV{k}", events.filter(f"id % 3 = {k}"), domain_value="EV") for k in range(3)}
    rule = Rule("S", {"name": "u", "operator": "is_not_unique_set", "value": ["q"]}, output=["u"])
    return run(spark, [rule], Study(files), None).findings.filter("Dataset = 'EV0'").select("Record")


@_query("ct_release", "SELECT 'sdtmct-' || v AS release FROM (SELECT '2024-0' || CAST(1 + c_custkey % 3 AS STRING) || '-01' AS v, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY n DESC, v DESC LIMIT 1) t")
def ct_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release that TS cites most, of equals the newest."""
    ts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(F.col("c_mktsegment") != "BUILDING", "CDISC CT").otherwise("OTHER").alias("TSVCDREF"), F.concat(F.lit("2024-0"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("-01")).alias("TSVCDVER"), (F.col("c_custkey") + 1).alias(RECORD))
    return spark.createDataFrame([(study_folder.ct_package_of(Study({"TS": Dataset("TS", normal_types(ts))})),)], "release string")


@_query("value_rows", f"SELECT id + 1 AS \"Record\", 't' AS \"Variable\", t AS \"Value\" FROM ({base_sql('events')}) e WHERE length(t) = 8")
def value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value check without output variables reports each value under the name of its variable."""
    check = {"all": [{"name": "variable_name", "operator": "equal_to", "value": "t", "value_is_literal": True}, {"name": "variable_value", "operator": "has_equal_length", "value": 8}]}
    rule = Rule("V", check, "Value Check with Variable Metadata", domains=_ON)
    return run(spark, [rule], _events(spark, sf_dir), None).findings.select("Record", "Variable", "Value")


_SCOPED = [("all", "AE"), ("all", "DM"), ("all", "SUPPAE"), ("all", "VS"), ("pattern", "SUPPAE"), ("exclude", "DM"), ("exclude", "SUPPAE"), ("exclude", "VS"), ("class", "AE"), ("findings", "VS"), ("named", "DM"), ("entity", "VS"), ("use case", "AE")]
#: Table, key and the column that tells the class.
_SCOPES = {"AE": ("events", "event_id", "event_type AS AETERM"), "DM": ("customer", "c_custkey", "c_mktsegment AS SEX"), "VS": ("part", "p_partkey", "p_type AS VSTESTCD"), "SUPPAE": ("orders", "o_orderkey", "o_orderpriority AS QNAM")}


@_query("scope_predicates", "SELECT rule_id, t.dataset, n AS findings FROM (VALUES " + ", ".join(map(str, _SCOPED)) + ") t(rule_id, dataset) JOIN ("
        + " UNION ALL ".join(f"SELECT '{d}' AS dataset, CAST(count(*) AS BIGINT) AS n FROM {t} WHERE {k} % 10 < 3" for d, (t, k, _) in _SCOPES.items()) + ") c ON t.dataset = c.dataset WHERE n > 0")
def scope_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one check by rules of unlike scope: by domain, pattern, class (from its table or a topic variable), entity and use case."""

    def data(name: str, table: str, key: str, column: str) -> Dataset:
        return Dataset(name, spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(column, f"CAST({key} % 10 AS DOUBLE) AS K", f"CAST({key} AS BIGINT) AS {RECORD}"), domain_value=name)

    s = Study({n: data(n, *c) for n, c in _SCOPES.items()}, use_case="INDH", library=Library(domain_classes={"DM": "Special Purpose"}))

    def rule(name: str, **scope: object) -> Rule:
        return Rule(name, {"name": "K", "operator": "less_than", "value": 3}, output=["K"], **scope)

    rules = [
        rule("all", domains={"Include": ["ALL"]}), rule("pattern", domains={"Include": ["SUPP--"]}), rule("exclude", domains={"Exclude": ["AE"]}), rule("class", classes={"Include": ["EVENTS"]}),
        rule("findings", classes={"Include": ["Findings"]}), rule("named", domains={"Include": ["DM"]}, classes={"Include": ["SPECIAL PURPOSE"]}), rule("entity", entities={"Include": ["VS"]}),
        rule("use case", domains={"Include": ["AE"]}, use_cases=["INDH"]), rule("other case", use_cases=["PROD"]),
    ]
    found = run(spark, rules, s, None).findings
    return found.groupBy("rule_id", F.col("Dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("findings"))


@_query("sink_csv", f"SELECT 'EV1' AS rule_id, id + 1 AS record, 'tb' AS variable FROM ({base_sql('events')}) e WHERE tb = ''")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as a CSV file and read again."""
    path = _folder(spark) / "findings.csv"
    api.write_findings(run(spark, [_blank()], _events(spark, sf_dir), None), str(path))
    back = spark.read.option("header", True).csv(str(path))
    return back.filter("Variable = 'tb'").select("rule_id", F.col("Record").cast("bigint").alias("record"), F.col("Variable").alias("variable"))


# Streams.


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violations of row-local rules over the events, read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = spark.sql(BASES["events"][1], t=events)
    rules = [
        Rule("EV1", {"name": "tb", "operator": "empty"}), Rule("EV2", {"name": "p", "operator": "invalid_date"}),
        Rule("EV4", {"all": [{"name": "d7", "operator": "less_than", "value": 2}, {"name": "t", "operator": "starts_with", "value": "c"}]}),
    ]
    return violations(rows, rules, "EVENTS", ["id", "iso"])


_STREAM_SQL = f"""SELECT 'EV1' AS rule_id, id, iso FROM ({base_sql('events')}) a WHERE tb = '' UNION ALL SELECT 'EV2', id, iso FROM ({base_sql('events')}) b WHERE p = '' OR p LIKE '%-32'
UNION ALL SELECT 'EV4', id, iso FROM ({base_sql('events')}) c WHERE id % 7 < 2 AND t LIKE 'c%'"""


@_query("stream_violations", f"SELECT rule_id, id FROM ({_STREAM_SQL}) s")
def stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    found = _stream(spark, sf_dir).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    found.awaitTermination()
    return spark.read.parquet(str(folder / "out")).select("rule_id", "id")


@_query("stream_counts", f"SELECT rule_id, left(iso, 13) AS hour, count(*) AS violations FROM ({_STREAM_SQL}) s GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations per rule and hour; a row per rule and window is kept."""
    name = f"counts_{uuid.uuid4().hex}"
    counts = violation_counts(_stream(spark, sf_dir).withColumn("at", F.to_timestamp("iso")), "at")
    found = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(_folder(spark))).trigger(availableNow=True).start()
    found.awaitTermination()
    return spark.table(name).select("rule_id", F.date_format("start", "yyyy-MM-dd'T'HH").alias("hour"), F.col("count").alias("violations"))



def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with the moment of each."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(BASES["events"][1], t=events).select("id", "u", "t", "q", F.to_timestamp("iso").alias("at"))


def _written(spark: SparkSession, found: DataFrame) -> DataFrame:
    """What a stream gives, through a table; state and table lie in the shared folder."""
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@_query("stream_duplicates", f"SELECT u, q, id FROM (SELECT *, count(*) OVER (PARTITION BY u, q) AS many FROM ({base_sql('events')}) e) x WHERE many > 1")
def stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as is_not_unique_set finds in a batch."""
    return _written(spark, duplicates(_live(spark, sf_dir), ["u", "q"], ["id"]))


@_query("stream_next_record", f"SELECT u, id FROM (SELECT *, lead(t) OVER w AS after, lead(iso) OVER w AS later FROM ({base_sql('events')}) e WINDOW w AS (PARTITION BY u ORDER BY iso, id)) x WHERE t <> after AND later <= (SELECT max(iso) FROM ({base_sql('events')}) m)")
def stream_next_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as does_not_have_next_corresponding_record finds in a batch, once the watermark has passed their followers."""
    return _written(spark, without_next(_live(spark, sf_dir), "t", "t", "u", "at", ["id"], late="0 seconds"))


@_query("stream_record_count", f"SELECT id, record_count FROM (SELECT id, iso, count(*) OVER (PARTITION BY t, left(iso, 13)) AS record_count FROM ({base_sql('events')}) e) x WHERE left(iso, 13) < (SELECT max(left(iso, 13)) FROM ({base_sql('events')}) m)")
def stream_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding per type and hour joined back to the events of that hour, for hours that the watermark has closed."""
    return _written(spark, with_counts(_live(spark, sf_dir), ["t"], "at", late="0 seconds")).select("id", "record_count")


# As-of joins.

_RELEASES = "SELECT o_orderpriority AS prio, left(CAST(o_orderdate AS STRING), 10) AS day, max(o_orderkey) AS release FROM {t} WHERE o_orderkey % 40 = 1 GROUP BY 1, 2"


@_query("as_of_orders", f"SELECT o.o_orderkey, r.release FROM (SELECT o_orderkey, o_orderpriority AS prio, left(CAST(o_orderdate AS STRING), 10) AS day FROM orders) o ASOF LEFT JOIN ({_RELEASES.format(t='orders')}) r ON o.prio = r.prio AND o.day >= r.day")
def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To each order the last release of its priority that is not later."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("prio"), F.left(F.col("o_orderdate").cast("string"), F.lit(10)).alias("day"))
    return as_of(rows, spark.sql(_RELEASES, t=orders), ["prio"], "day", "release").select("o_orderkey", "release")


@_query("latest_release_of_table", "SELECT o_orderkey + 1 AS \"Record\" FROM (SELECT o_orderkey, left(CAST(o_orderdate AS STRING), 10) AS day FROM orders) o ASOF JOIN (SELECT left(CAST(o_orderdate AS STRING), 10) AS since, 'v' || CAST(max(o_orderkey) % 3 AS STRING) AS version FROM orders WHERE o_orderkey % 40 = 1 GROUP BY 1) r ON o.day >= r.since WHERE version = 'v1'")
def latest_release_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders whose day falls to a release called v1, by the operator, over a table of releases."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    releases = spark.sql("SELECT 'Own' AS dictionary, left(CAST(o_orderdate AS STRING), 10) AS since, 'v' || CAST(max(o_orderkey) % 3 AS STRING) AS version FROM {t} WHERE o_orderkey % 40 = 1 GROUP BY 2", t=orders)
    s = Study({"ORDERS": Dataset("ORDERS", base(spark, sf_dir, "orders"))}, library=Library(releases=releases))
    check = {"name": "day", "operator": "is_latest_available_external_dictionary_version", "external_dictionary_type": "own", "version": "v1"}
    return run(spark, [Rule("R", check, output=["day"], domains={"Include": ["ORDERS"]})], s, None).findings.select("Record")
