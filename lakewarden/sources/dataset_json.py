"""Dataset-JSON and its line form."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import RECORD, Dataset, VariableMeta
from .frame import with_record
from .json_rows import read_rows

#: Data types of the format that hold numbers (fixed values).
_NUMBERS = {"integer", "float", "double", "decimal"}


def read_dataset_json(spark: SparkSession, path: str | Path) -> Dataset:
    """One dataset. Rows are read by many tasks, in the line form as lines and else by byte ranges; the driver sees what stands beside them."""
    path = Path(path)
    if path.suffix == ".ndjson":
        about, n = json.loads(spark.read.text(str(path)).first()[0]), None
        read = with_record(spark.read.text(str(path))).filter(F.col(RECORD) > 1).withColumn(RECORD, F.col(RECORD) - 1)
    else:
        about, read, n = read_rows(spark, path)
        read = read.withColumnRenamed("record", RECORD)
    columns = about["columns"]
    numeric = [c.get("dataType") in _NUMBERS and c.get("targetDataType") in (None, "integer", "decimal") for c in columns]
    names = [c["name"] for c in columns]
    broken = F.raise_error(F.concat(F.lit(f"{path.name}: no JSON in row "), F.col(RECORD).cast("string")))
    rows = read.select(F.coalesce(F.from_json("value", "array<string>"), broken).alias("cells"), RECORD)
    cells = [F.get("cells", F.lit(i)) for i in range(len(names))]
    df = rows.select(*((c.try_cast("double") if k else F.coalesce(c, F.lit(""))).alias(n) for c, n, k in zip(cells, names, numeric)), RECORD)
    n = df.count() if n is None else n
    if about.get("records") is not None and int(about["records"]) != n:
        raise ValueError(f"{path.name} declares {about['records']} records and holds {n}")
    metas = [VariableMeta(c["name"], c.get("label") or "", "Num" if k else "Char", c.get("length")) for c, k in zip(columns, numeric)]

    def first(c: str) -> str:
        if c not in names:
            return ""
        row = df.filter(f"trim(`{c}`) <> ''").select(c).first()
        return row[0].strip() if row else ""

    return Dataset(str(about.get("name") or path.stem).upper(), df, metas, about.get("label") or "", path.stat().st_size, path.name, first("DOMAIN"), first("RDOMAIN"))
