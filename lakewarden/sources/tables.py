"""A single CSV file as a dataset: cut at rows, parsed by Spark, with types found in one pass over it."""

from __future__ import annotations

import csv
import io
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import RECORD, Dataset, VariableMeta
from .csv_rows import read_rows
from .testcase import make_dataset

_BAD = "__bad"
#: A text in a quoted field may hold line ends, and a quote is doubled.
_OPTIONS = {"escape": '"', "columnNameOfCorruptRecord": _BAD, "maxCharsPerColumn": "-1", "maxColumns": "100000"}


def _needless_zero(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^[+-]+", "").rlike(r"^0\d")


def read_csv(spark: SparkSession, path: str | Path, name: str) -> Dataset:
    """A column is a number if every filled value is one and none begins with a needless zero.

    Rows with another number of fields than the header are refused. Rows are read by
    many tasks (``csv_rows``); a file that is no UTF-8 is taken for Windows-1252.
    """
    first, read = read_rows(spark, path)
    if first is None:
        return make_dataset(spark, name, [], [], [])
    head = [h for h in next(csv.reader(io.StringIO(first, newline=""))) if h]
    twice = [n for n, k in Counter(h.upper() for h in head).items() if k > 1]
    if twice:
        raise ValueError(f"columns whose names are the same: {', '.join(sorted(twice))}")
    schema = ", ".join([*(f"`{h}` string" for h in head), f"{_BAD} string"])
    rows = read.select(F.from_csv("value", schema, _OPTIONS).alias("cells"), F.col("record").alias(RECORD)).select("cells.*", RECORD)
    texts = {h: F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in head}
    tests = []
    for i, c in enumerate(texts.values()):
        filled = F.trim(c) != ""
        tests.append(F.bool_and(F.when(filled, tx.number(c).isNotNull() & ~_needless_zero(c))).alias(f"n{i}"))
    for key in ("DOMAIN", "RDOMAIN"):
        c = texts.get(key, F.lit(""))
        tests.append(F.min_by(F.trim(c), F.when(F.trim(c) != "", F.col(RECORD))).alias(key))
    anything = F.concat(*texts.values())
    ragged = F.col(_BAD).isNotNull() & (F.trim(anything) != "")
    about = rows.agg(*tests, F.min(F.when(ragged, F.col(RECORD))).alias("ragged"), F.count(_BAD).alias("blank")).first()
    if about["ragged"] is not None:
        raise ValueError(f"{Path(path).name}: row {about['ragged'] + 1} has another number of fields than the header")
    numeric = [about[f"n{i}"] is True for i in range(len(head))]
    typed = [(tx.number(c) if n else c).alias(h) for (h, c), n in zip(texts.items(), numeric)]
    df = (rows.filter(F.col(_BAD).isNull()) if about["blank"] else rows).select(*typed, RECORD)
    metas = [VariableMeta(h, "", "Num" if n else "Char") for h, n in zip(head, numeric)]
    return Dataset(name.upper(), df, metas, domain_value=about["DOMAIN"] or "", rdomain_value=about["RDOMAIN"] or "")
