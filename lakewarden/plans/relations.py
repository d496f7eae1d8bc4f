"""Sets of a whole dataset as relations: a table of members (v) that is never gathered into one value.

Union, difference and intersection are joins of such tables; conditions end in
existence joins. Sets that differ from row to row stay arrays; where one meets a
relation, its distinct values are compared by a join and the answer comes back by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .table import Operand, Table, tidy


def relation(x: Operand, table: Table) -> DataFrame | None:
    """The distinct members of a set of the whole dataset; None for sets and values of single rows."""
    if x.source is not None:
        return x.source.select("v")
    if x.values is not None:
        return members_of([tidy(v) for v in x.values], table)
    if x.is_set and x.collection:  # joined to every row; the first one has it
        return table.df.limit(1).select(F.explode(F.coalesce(x.col, F.array().cast("array<string>"))).alias("v")).distinct()
    return None


def members_of(values: list[str], table: Table) -> DataFrame:
    return table.df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "v string")


def folded(members: DataFrame) -> DataFrame:
    return members.select(F.upper("v").alias("v")).distinct()


def as_set(members: DataFrame) -> Operand:
    return Operand(F.array().cast("array<string>"), "set", collection=True, source=members)


def difference(left: DataFrame, right: DataFrame) -> Operand:
    return as_set(left.join(right, "v", "left_anti"))


def intersection(left: DataFrame, right: DataFrame) -> Operand:
    return as_set(left.join(right, "v", "left_semi"))


def union(left: DataFrame, right: DataFrame) -> Operand:
    return as_set(left.union(right).distinct())


def among(table: Table, sets: Column, members: DataFrame) -> Column:
    """The members of each row's own set that are in the relation, in the row's order.

    Each distinct set is taken apart once, so what is gathered is one row's set again.
    """
    own = table.df.select(sets.alias("k")).distinct()
    found = own.select("k", F.explode("k").alias("v")).join(members, "v", "left_semi").groupBy("k").agg(F.collect_set("v").alias("__v"))
    there = table.join(found, [(sets, "k")], "__v", "set")
    return F.filter(sets, lambda x: F.coalesce(F.array_contains(there, x), F.lit(False)))


def holds(table: Table, value: Column, members: DataFrame) -> Column:
    """Whether each row's value is in the relation."""
    return table.join(members.withColumn("hit", F.lit(True)), [(value, "v")], "hit", "bool").isNotNull()


def is_blank(table: Table, members: DataFrame) -> Column:
    """Whether the relation has no member that is filled; a single row, joined."""
    none = members.filter("v <> ''").limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return table.join(none, [], "none", "bool")


def disjoint(table: Table, left: DataFrame, right: DataFrame) -> Column:
    shared = left.join(right, "v", "left_semi").limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return table.join(shared, [], "none", "bool")
