"""As-of joins: to each row the last event of the same key that is not later, whatever the number of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import keep


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``rows`` (``keys``, ``at`` and more) with ``value`` of the last of ``events`` (``keys``, ``at``, ``value``) up to ``at``.

    Rows and events are sorted together by ranges of key and time, and each row takes the last value
    before it in its range. What a range hands on to the next is its last key and that key's last
    value, so neither a key nor the events need fit into one task. Of events of one key and time the
    greatest value counts; NULL keys meet NULL keys; a row without ``at``, or before all events, gets NULL.
    """
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.lit(0)
    rest = [c for c in rows.columns if c not in (*keys, at)]
    left = rows.select(key.alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__row"), F.lit(None).cast(events.schema[value].dataType).alias("__v"), F.struct(*rest, F.lit(0).alias("__")).alias("__rest"))
    right = events.filter(F.col(at).isNotNull()).select(key.alias("__k"), F.col(at).cast(rows.schema[at].dataType).alias("__t"), F.lit(0).alias("__row"), F.col(value).alias("__v"), F.lit(None).cast(left.schema["__rest"].dataType).alias("__rest"))
    by = ["__k", "__t", "__row", "__v"]
    both = keep(left.union(right).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()), "as-of")
    both = both.withColumn("__part", F.shiftright("__m", 33))
    seen = F.last("__v", ignorenulls=True).over(W.partitionBy("__part", "__k").orderBy("__m"))  # within a range
    per = both.groupBy("__part").agg(F.min("__k").alias("first"), F.max("__k").alias("last"))
    last = both.groupBy("__part", "__k").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__m"))).alias("v"))
    ends = per.join(last, (per["__part"] == last["__part"]) & per["last"].eqNullSafe(last["__k"])).select(per["__part"].alias("p"), "first", "last", "v").orderBy("p")
    handed, known, held = [], None, None
    for r in ends.collect():  # a row per range
        if known is not None and r["first"] == known[0] and held is not None:
            handed.append((r["p"], held))
        carry = held if known is not None and r["last"] == known[0] and r["first"] == r["last"] else None
        known, held = (r["last"],), r["v"] if r["v"] is not None else carry
    schema = f"__p bigint, __h {events.schema[value].dataType.simpleString()}"
    begun = rows.sparkSession.createDataFrame(handed, schema)
    firsts = per.select(F.col("__part").alias("__p"), F.col("first").alias("__first"))
    # A row per range is broadcast.
    out = both.withColumn("__seen", seen).join(F.broadcast(firsts.join(begun, "__p")), F.col("__part") == F.col("__p"), "left")
    found = F.coalesce(F.col("__seen"), F.when(F.col("__k").eqNullSafe(F.col("__first")), F.col("__h")))
    names = [*(F.col(f"__k.`{k}`").alias(k) for k in keys), F.col("__t").alias(at), *(F.col(f"__rest.`{c}`").alias(c) for c in rest)]
    return out.filter("__row = 1").select(*names, F.when(F.col("__t").isNotNull(), found).alias(value))
