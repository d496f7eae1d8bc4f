"""Small tables and studies for the engine's tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewarden.model import RECORD, Dataset, Operation, Rule, Study
from lakewarden.plans.evaluate import Compiler
from lakewarden.plans.table import Table


def frame(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], f"{schema}, {RECORD} long").coalesce(1)


def dataset(spark, name: str, schema: str, rows: list[tuple], domain: str = "") -> Dataset:
    return Dataset(name, frame(spark, schema, rows), domain_value=domain or name)


def verdicts(df, check: dict, core1: bool = False, operations: list[Operation] | None = None, study: Study | None = None, data: Dataset | None = None) -> list:
    """The verdict of each record, in order."""
    study = study or Study()
    data = data or Dataset("XX", df)
    table = Table(df, data, study, data.domain[:2])
    rule = Rule("R", check, operations=operations or [], source="core_contributor" if core1 else "")
    column, _ = Compiler(table, study, rule.dialect).rule(rule)
    column = table.add(column)
    return [r[0] for r in table.df.orderBy(RECORD).select(F.coalesce(column, F.lit(None))).collect()]


def leaf(name: str, operator: str, value: object = None, **more: object) -> dict:
    return {"name": name, "operator": operator, **({} if value is None else {"value": value}), **more}
