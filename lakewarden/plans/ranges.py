"""Order over a whole dataset by ranges, so that no task sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import keep

_LOW = (1 << 33) - 1


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place from 1 in the order, which must leave no ties.

    Rows are sorted by ranges and written; a range begins after the counts of those before it.
    """
    ranged = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    begin, total = [(-1, 0)], 0
    for p, n in sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per range
        begin.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(begin, "__part bigint, __begin bigint")
    placed = ranged.join(F.broadcast(starts), part == F.col("__part"))  # a row per range
    return placed.withColumn(rank, F.col("__begin") + F.col("__m").bitwiseAND(_LOW) + 1).drop("__m", "__part", "__begin")
