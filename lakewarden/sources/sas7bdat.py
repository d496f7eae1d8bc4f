"""SAS data files (.sas7bdat), compressed ones too, through the reader of pandas behind a Spark DataSource.

The format can only be read from its front, so one task reads a file, page by page
and a chunk of rows at a time; the driver reads the head alone. Dates and moments become ISO
text, as of every source; their variables stay numbers in the metadata.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pandas.io.sas import sas_constants as known
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Dataset, VariableMeta
from . import frame

CHUNK = 50_000
#: Names of formats that make a number a day or a moment.
_DATES, _MOMENTS = set(known.sas_date_formats), set(known.sas_datetime_formats)


def _open(path: str):
    return pd.read_sas(path, format="sas7bdat", chunksize=CHUNK, encoding="infer")


def head_of(path: str) -> list[tuple[VariableMeta, str]]:
    """(variable, kind) of each column: num, text, date or moment."""
    def plain(x: str | bytes) -> str:
        return x if isinstance(x, str) else x.decode("utf-8", "replace")

    with _open(path) as reader:
        out = []
        for column in reader.columns:
            number, form = column.ctype == b"d", plain(column.format)
            what = "text" if not number else "date" if form in _DATES else "moment" if form in _MOMENTS else "num"
            out.append((VariableMeta(plain(column.name), plain(column.label), "Num" if number else "Char", int(column.length)), what))
        return out


def _texts(column: pd.Series, kind: str) -> list:
    if kind == "num":
        return [None if x != x else float(x) for x in column]
    if kind in ("date", "moment"):
        return ["" if pd.isna(x) else x.strftime("%Y-%m-%d" if kind == "date" else "%Y-%m-%dT%H:%M:%S") for x in column]
    return ["" if not isinstance(x, (str, bytes)) else (x if isinstance(x, str) else x.decode("utf-8", "replace")).rstrip(" \x00") for x in column]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.kinds = [kind for _, kind in head_of(path)]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = 0
        with _open(self.path) as chunks:
            for chunk in chunks:
                for row in zip(*(_texts(chunk.iloc[:, i], kind) for i, kind in enumerate(self.kinds))):
                    n += 1
                    yield (*row, n)


class Sas7bdatDataSource(DataSource):
    """``spark.read.format("sas7bdat").load(path)``; the last column is the record number."""

    @classmethod
    def name(cls) -> str:
        return "sas7bdat"

    def schema(self) -> str:
        return ", ".join([*(f"`{v.name}` {'double' if kind == 'num' else 'string'}" for v, kind in head_of(self.options["path"])), "__record bigint"])

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_sas7bdat(spark: SparkSession, path: Path, name: str | None = None) -> Dataset:
    spark.dataSource.register(Sas7bdatDataSource)
    out = frame.from_frame(spark.read.format("sas7bdat").load(str(path)), name or path.stem, [v for v, _ in head_of(str(path))])
    out.file_size, out.file_name = path.stat().st_size, path.name
    return out
