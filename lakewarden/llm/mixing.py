"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, its
source's target over its source's size. The whole part is taken outright; the
fraction is a probability. A fractional document is paired with another, or with
all smaller ones together, and words of expected mass are moved between the two
in a random direction that keeps all expectations, until one of them is
integral; so the expected words of the source never change. Sources are dealt into buckets of about ``BUCKET``
documents, each bucket leaves one fractional document at most, and those are
combined by 64 in each level of a reduction tree until a source has one left,
which is rounded to the nearer side. A source's words thus miss its target by
half a document at most.

Sources may be many (hosts, say): they are numbered by ranges, and the level to
which targets fill up is found by a few sums over all of them.

Randomness comes from the source, bucket and level. Rows are numbered in the order
of source, doc_id and size, and buckets come from that number, so reruns agree and
rows equal in all three crowd no bucket. Defined results: null text has no words; the null source
is a source of its own, last; sources without words have target 0; repeated rows
count as documents of their own; very long texts are only counted, within their
row; an empty table gives an empty result; other columns are kept by ``mix``,
whatever their names, and ignored by ``mixture``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, keyed, placed, unkeyed, whole, words_of

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKET, FAN_IN, SEED = 8192, 64, 20_240_607
_ROW = "sid long, bucket long, rid long, doc_id {id}, size long, place long, order long, whole long, p double, open boolean"


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source of ``sizes`` (source, size): sid, source_size, documents and target.

    Targets fill up like water: all sources rise in proportion to their weights
    until ``limit`` times their size. The level is a root of a sum over sources
    that bends at each source's limit; Newton's steps reach it exactly, as each
    takes the limits passed so far into account.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    per = placed(per, scratch, F.col("source").asc_nulls_last()).withColumnRenamed("place", "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    per = scratch.keep(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(limit)))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, below = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, held, rising = per.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == below or not rising:
            break
        level, below = (total - (held or 0.0)) / rising, n
    filled = F.least("cap", F.lit(level) * F.col("weight")) if rising else F.col("cap")
    return scratch.keep(per.select("source", "sid", "source_size", "documents", filled.alias("target")))


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the probabilities ``p`` in place; the index of the one left open, or -1. Sizes must fall.

    While all open documents share one probability, each in turn is paired with
    all the smaller ones together: it becomes whole or nought and they take or
    give the difference alike, which keeps every expectation. Where they could
    not bear it, documents are paired one with one.
    """
    i = -1
    draws = rng.random(len(p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) and np.all(p[open_] == p[open_[0]]):
        share, rest = float(p[open_[0]]), float(size[open_].sum())
        for k, j in enumerate(open_):
            rest -= size[j]
            one, none = (share + size[j] * (share - x) / rest if rest > 0 else -1.0 for x in (1, 0))
            if not (0 < one and none < 1):
                p[open_[k:]] = share
                break
            p[j], share = (1.0, one) if draws[j] < share else (0.0, none)
    for j in range(len(p)):
        if p[j] <= 0 or p[j] >= 1:
            continue
        if i < 0:
            i = j
            continue
        a, b, pi, pj = size[i], size[j], p[i], p[j]
        up = min(1 - pi, pj * b / a)  # by which i may rise
        down = min(pi, (1 - pj) * b / a)  # by which i may fall
        if draws[j] * (up + down) < down:
            full, empty = up == 1 - pi, up == pj * b / a
            p[i], p[j] = 1.0 if full else pi + up, 0.0 if empty else pj - up * a / b
        else:
            empty, full = down == pi, down == (1 - pj) * b / a
            p[i], p[j] = 0.0 if empty else pi - down, 1.0 if full else pj + down * a / b
        if 0 < p[j] < 1:
            i = j
        elif not 0 < p[i] < 1:
            i = -1
    return p, i


def _round_bucket(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # By falling size: partners are of like size, and the one left open at the end is small.
        rows = rows.sort_values(["size", "order", "place"], ascending=[False, True, True], kind="stable")
        sid, bucket = int(rows["sid"].iloc[0]), int(rows["bucket"].iloc[0])
        p, left = pivot(rows["size"].to_numpy(float), rows["p"].to_numpy(float, copy=True), np.random.Generator(np.random.PCG64([SEED, level, sid, bucket])))
        still = np.zeros(len(rows), bool)
        if left >= 0 and last:
            p[left] = round(p[left])
        elif left >= 0:
            still[left] = True
        return rows.assign(p=p, open=still, bucket=bucket // FAN_IN)

    return run


def _copies(sized: DataFrame, scratch: Scratch, weights: tuple, share: float, limit: float) -> DataFrame:
    """Per row of ``sized`` (rid, doc_id, source, size, mark): rid, doc_id, size, source_size, target, copies.

    ``mark`` and ``rid`` order the rows that agree in source, doc_id and size.
    """
    per = targets(sized, scratch, weights, share, limit)
    rows = placed(sized, scratch, F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size"), F.col("mark"), F.col("rid"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(limit))).otherwise(0.0)
    joined = rows.join(per, rows["source"].eqNullSafe(per["source"])).drop("source")
    order = F.xxhash64("doc_id", "size", "place")
    kind = sized.schema["doc_id"].dataType.simpleString()
    schema = _ROW.format(id=kind)
    state = joined.withColumn("rate", rate).select(
        "sid",
        F.pmod(F.xxhash64(order), F.ceil(F.col("documents") / BUCKET)).alias("bucket"),
        "rid",
        "doc_id",
        "size",
        "place",
        order.alias("order"),
        F.floor("rate").alias("whole"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p"),
        F.lit(True).alias("open"),
    )
    most = per.agg(F.max("documents")).first()[0] or 0
    buckets, level, closed = math.ceil(most / BUCKET), 0, []
    while True:
        last = buckets <= 1
        state = scratch.keep(state.groupBy("sid", "bucket").applyInPandas(_round_bucket(level, last), schema))
        closed.append(state.filter("not open"))
        if last:
            break
        state = state.filter("open")
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.union(more)
    sizes = per.select("sid", "source_size", "target")
    return out.join(sizes, "sid").select("rid", "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.size(words_of(whole("text"))).cast("long")
    sized = scratch.keep(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size"), F.lit(0).alias("mark")))
    found = _copies(sized, scratch, weights, share, limit)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all their columns.

    Each row gets copies of its own, also where others agree with it in doc_id, source and text.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = whole("text")
    rows = scratch.keep(keyed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=F.size(words_of(text)).cast("long"), mark=F.xxhash64(text)))
    taken = _copies(rows.select("rid", "doc_id", "source", "size", "mark"), scratch, weights, share, limit).filter("copies > 0").select("rid", "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    # The rows that are taken grow with the input: no broadcast, at any size.
    return unkeyed(rows.select("rid", "row").join(scratch.keep(taken).hint("merge"), "rid").select("row", times.alias("k")))
