"""Datasets from DataFrames and Parquet."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RECORD, Dataset, VariableMeta


def normal_types(df: DataFrame) -> DataFrame:
    """Text without NULL, numbers as they are, dates and times as ISO text."""
    twice = [n for n, k in Counter(c.upper() for c in df.columns).items() if k > 1]
    if twice:
        raise ValueError(f"columns whose names are the same: {', '.join(sorted(twice))}")
    out = []
    for f in df.schema:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(t, T.DateType):
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
        elif isinstance(t, T.NullType):
            c = F.lit("")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_record(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add 1-based record numbers.

    A file source numbers its own rows (see ``parquet``). For a DataFrame without
    positions the rows of each partition are counted and numbered after those of
    the partitions before it, so no row moves.
    """
    if RECORD in df.columns:
        return df
    if order:
        df = df.orderBy(*order)
    numbered = df.withColumn("__m", F.monotonically_increasing_id())
    part, within = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if len(starts) <= 1:
        return numbered.withColumn(RECORD, within + 1).drop("__m")
    begin = df.sparkSession.createDataFrame(starts, "__part bigint, __begin bigint")
    # One row per partition is broadcast.
    return numbered.join(F.broadcast(begin), part == F.col("__part")).withColumn(RECORD, F.col("__begin") + within + 1).drop("__m", "__part", "__begin")


def from_frame(df: DataFrame, name: str | None = None, variables: list[VariableMeta] | None = None, label: str = "") -> Dataset:
    """A dataset of any DataFrame; the domain comes from DOMAIN where no name is given."""
    raw = with_record(df)
    df = normal_types(raw)
    first = {}
    for c in ("DOMAIN", "RDOMAIN"):
        if c in df.columns:
            row = df.filter(F.trim(c) != "").select(F.trim(c)).first()
            first[c] = row[0] if row else ""
    name = name or first.get("DOMAIN") or ""
    if not name:
        raise ValueError("the dataset has no DOMAIN column; name its domain")
    return Dataset(name.upper(), df, variables or [], label, domain_value=first.get("DOMAIN", ""), rdomain_value=first.get("RDOMAIN", ""), raw=raw)


def parquet(spark: SparkSession, path: str, name: str) -> Dataset:
    """A Parquet table; record numbers are row positions in a file, counted on over its files."""
    return from_frame(with_file_record(spark.read.parquet(path)), name)


def with_file_record(df: DataFrame) -> DataFrame:
    """Record numbers by the position in a file, after the rows of the files that come before by name.

    However files are split into tasks, the numbers are the same.
    """
    at = F.col("_metadata.row_index") + 1
    if len(df.inputFiles()) == 1:
        return df.select("*", at.alias(RECORD))
    begin, total = [], 0
    for f, n in sorted((r["f"], r["n"]) for r in df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per file
        begin.append((f, total))
        total += n
    starts = df.sparkSession.createDataFrame(begin, "__file string, __begin bigint")
    placed = df.select("*", F.col("_metadata.file_path").alias("__of"), at.alias("__at")).join(F.broadcast(starts), F.col("__of") == F.col("__file"))  # a row per file
    return placed.withColumn(RECORD, F.col("__begin") + F.col("__at")).drop("__of", "__at", "__file", "__begin")
