"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of ``block`` characters. The distinct blocks are
dealt out by content, sorted inside each partition and numbered in that order,
so a block has one integer name and two blocks never share one. Then adjacent
names are paired and the distinct pairs named in the same way, until every
document has one name; (round, name) is its identity, equal for equal texts only.

Names are looked up by a 128-bit key of the block in place of its content, so
texts are shuffled once, after a map-side distinct. That the key is one to one
on this corpus is proved on every run (no key may have two names); if it fails,
the keys are taken anew with another seed.

Defined results: null text counts as empty; empty texts are equal to each other;
equal texts keep the row with the largest doc_id (null is smallest, and of fully
equal keys one row); very long texts are cut and named block by block; an empty
table gives an empty result; other columns are kept by ``drop_exact_copies``,
whatever their names, and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, unkeyed, whole

BLOCK = 4096


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number the distinct rows in sorted order within each partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _key(block, seed: int):
    return F.struct(F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(seed), block).alias("h2"))


def _first_names(scratch: Scratch, docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, sha, keys of its blocks) and (h1, h2, name of that block)."""
    text = F.col("text")
    blocks = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0)))
    cut = docs.select("row", "doc_id", "text", blocks.alias("blocks"))
    distinct = docs.select(F.explode(blocks).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    seed = 1
    while True:
        names = scratch.keep(_named(distinct, ["block"]).select(_key(F.col("block"), seed).alias("k"), "name").select("k.h1", "k.h2", "name"))
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        scratch.drop(names)
        seed += 1
    rows = cut.select(
        "row",
        "doc_id",
        F.sha2(F.col("text"), 256).alias("sha"),
        F.transform("blocks", lambda b: _key(b, seed)).alias("keys"),
    )
    return scratch.keep(rows), names


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (row, doc_id, text): row, doc_id, sha, and its identity (round, name)."""
    rows, names = _first_names(scratch, docs, block)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")
    state = scratch.keep(rows.select("row", F.posexplode("keys").alias("pos", "k")).select("row", "pos", "k.h1", "k.h2").join(names, ["h1", "h2"]).groupBy("row").agg(ordered))
    scratch.drop(names)
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    done, level = [], 0
    while True:
        done.append(state.filter(F.size("names") == 1).select("row", F.lit(level).alias("round"), F.element_at("names", 1).alias("name")))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        # Adjacent names; the last one of an odd number is paired with -1, which no block or pair is named.
        adjacent = F.transform(
            F.sequence(F.lit(0), F.expr("int((size(names) - 1) div 2)")),
            lambda i: F.struct(F.get("names", i * 2).alias("l"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("r")),
        )
        pairs = state.filter(F.size("names") > 1).select("row", F.posexplode(adjacent).alias("pos", "p")).select("row", "pos", "p.l", "p.r")
        names = scratch.keep(_named(pairs.select("l", "r").distinct(), ["l", "r"]))
        state = scratch.keep(pairs.join(names, ["l", "r"]).groupBy("row").agg(ordered))
        scratch.drop(names)
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return scratch.keep(rows.select("row", "doc_id", "sha").join(found, "row"))


def _groups(docs: DataFrame, scratch: Scratch, block: int) -> tuple[DataFrame, DataFrame]:
    """The identities of ``docs`` (row, doc_id, text), and per identity its best row and size."""
    found = identities(docs, scratch, block)
    groups = found.groupBy("round", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # A written table leaves the join free to split the rows of a large group.
    return found, scratch.keep(groups)


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    found, groups = _groups(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole("text").alias("text")), scratch, block)
    return found.join(groups, ["round", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact-kept")
    rows = scratch.keep(keyed(docs))
    _, groups = _groups(rows.select(F.col("rid").alias("row"), "row.doc_id", whole(F.col("row.text")).alias("text")), scratch, block)
    # The rows that stay grow with the input: no broadcast, at any size.
    return unkeyed(rows.select("rid", "row").join(groups.select(F.col("best.row").alias("rid")).hint("merge"), "rid"))
