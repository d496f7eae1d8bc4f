"""Merkle manifest of a dataset: a tree of threes per group, one over the groups, and a proof for every row.

Leaves are hashed where the rows are; only digests are sorted, by ranges of group
and order, so a group of any size lies in consecutive ranges. Each task numbers its rows per group and packs them into
chunks; the counts per (range, group), summed over the ranges before, are the offset of
each chunk in its group. A chunk then builds every complete subtree that is aligned in the group's own
coordinates. The nodes at its ragged ends, a few per level, are shuffled by the block of
``WIDTH ** k`` leaves that they lie in, and finish one level-``k`` node per block; with ``k``
rising by ``RISE`` a round, two rounds do for any number of rows. The groups' roots are the
leaves of one more such tree. Proofs come down the same way: a block's nodes
take what leads from the block to the root, and each subtree adds its own levels.

A proof is a list of (left, right): the digests of a node's run before and after it,
joined, level by level from the leaf to the root; a run of one node has neither. ``fold``
computes the root from a leaf and its proof.

Defined results: a null group is a group of its own, the first one; null values are
``-`` in a leaf, and a null in the order comes first; rows of equal order stand by their
digests, so repeated rows stand together, each a leaf; null and empty texts differ; a very long
text is hashed within its row; an empty table gives an empty result; columns other
than the fields are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, arrow_rows

WIDTH, CHUNK_LEVELS, FIRST_RISE, RISE, OUT_ROWS = 3, 8, 6, 9, 2000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in proof:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def depth_of(total: int, width: int = WIDTH) -> int:
    """The level of the root over ``total`` leaves."""
    level, reach = 0, 1
    while reach < total:
        level, reach = level + 1, reach * width
    return level


def subtrees(begin: int, n: int, total: int, most: int, width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(level, first leaf, leaves) of the largest complete aligned subtrees, up to level ``most``, of the leaves from ``begin``, of ``total`` in the group."""
    at, end, top = begin, begin + n, min(depth_of(total, width), most)
    while at < end:
        level, reach = 0, 1
        while level < top and at % (reach * width) == 0 and min(at + reach * width, total) <= end:
            level, reach = level + 1, reach * width
        size = min(at + reach, total) - at
        yield level, at, size
        at += size


def levels_of(leaves: list[str], height: int, width: int = WIDTH) -> list[list[str]]:
    """All levels of a subtree, from its leaves up to its one node."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([digest(below[i : i + width]) for i in range(0, len(below), width)])
    return out


def beside(level: list[str], at: int, width: int = WIDTH) -> tuple[str, str]:
    first = at - at % width
    return "".join(level[first:at]), "".join(level[at + 1 : first + width])


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field ``-`` if null, else its length in bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields]
    shown = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*shown), 256))


def _pack(kind: pa.DataType, size: int):
    """Sorted rows (part, grp, item, digest, other) as chunks of a group: part, grp, local, n, items, digests, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, rows, local = None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, rows, local
            if rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                digests = b"".join(whole.column("digest").to_pylist())
                out.append((held[0].column("part")[0].as_py(), group, local, rows, whole.column("item").to_pylist(), digests, whole.column("other").to_pylist()))
            held, local, rows = [], local + rows, 0

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(kind), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "grp", "local", "n", "items", "digests", "others"])

        for batch in batches:
            at = 0
            for g, same in groupby(batch.column("grp").to_pylist()):
                n = sum(1 for _ in same)
                if g != group:
                    close()
                    group, local = g, 0
                while n:
                    take = min(n, size - rows)
                    held.append(batch.slice(at, take))
                    at, n, rows = at + take, n - take, rows + take
                    if rows == size:
                        close()
            if sum(r[3] for r in out) > size:
                yield ready()
        close()
        if out:
            yield ready()

    return run


def _grow(kind: pa.DataType, most: int):
    """The subtrees of each chunk: grp, total, level, start, node, items, digests, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                leaves = [r["digests"][k : k + 32].hex() for k in range(0, len(r["digests"]), 32)]
                for level, start, n in subtrees(r["begin"] + r["local"], r["n"], r["total"], most):
                    at = start - r["begin"] - r["local"]
                    node = levels_of(leaves[at : at + n], level)[-1][0]
                    out.append((r["grp"], r["total"], level, start, node, r["items"][at : at + n], r["digests"][32 * at : 32 * (at + n)], r["others"][at : at + n]))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(kind), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["grp", "total", "level", "start", "node", "items", "digests", "others"])

    return run


def _finish(height: int, width: int = WIDTH):
    """The nodes of one block joined into its one node of level ``height``, or into the group's root below that."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        total = int(nodes["total"].iloc[0])
        top = min(height, depth_of(total, width))
        known: list[dict[int, str]] = [{} for _ in range(top + 1)]
        keys = [(int(v), int(s) // width**v) for v, s in zip(nodes["level"].tolist(), nodes["start"].tolist())]
        for (level, i), node in zip(keys, nodes["node"]):
            known[level][i] = node
        runs: list[dict[int, list[str]]] = []
        for level in range(top):
            here: dict[int, list[str]] = {}
            for i in sorted(known[level]):
                here.setdefault(i // width, []).append(known[level][i])
            runs.append(here)
            known[level + 1].update({j: digest(r) for j, r in here.items()})
        paths, ((up, node),) = [], known[top].items()
        for level, i in keys:
            path = []
            for v in range(level, top):
                left, right = beside(runs[v][i // width], i % width, width)
                path.append({"left": left, "right": right})
                i //= width
            paths.append(path)
        start = up * width**top
        return nodes[["grp", "total", "level", "start"]].assign(path=paths, up_level=top, up_start=start, up_node=node, head=nodes["start"] == nodes["start"].min())

    return run


class Forest:
    """A tree per group over ``leaves`` (grp, item, digest, other), where ``other`` is carried along."""

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        self.scratch, kind = scratch, leaves.schema["item"].dataType
        self.kind, self.item = kind.simpleString(), to_arrow_type(kind)
        # The row number keeps very many equal rows from meeting in one range.
        by = ["grp", "item", "digest", "other", "rid"]
        ranged = leaves.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
        packed = ranged.select(F.spark_partition_id().alias("part"), "grp", "item", "digest", "other")
        body = f"items array<{self.kind}>, digests binary, others array<binary>"
        chunks = scratch.keep(packed.mapInArrow(_pack(self.item, WIDTH**CHUNK_LEVELS), f"part int, grp string, local bigint, n int, {body}"))
        counts = chunks.groupBy("part", "grp").agg(F.sum("n").alias("rows"))
        before = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range of the group
        offsets = scratch.keep(counts.select("part", "grp", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"), F.sum("rows").over(W.partitionBy("grp")).alias("total")))
        placed = chunks.join(offsets, ["part", "grp"]).select("grp", "local", "n", "begin", "total", "items", "digests", "others")
        self.trees = scratch.keep(placed.mapInArrow(_grow(self.item, CHUNK_LEVELS), f"grp string, total bigint, level int, start bigint, node string, {body}"))
        scratch.drop(chunks)
        most = offsets.agg(F.max("total")).first()[0] or 0
        depth = F.lit(0)
        for level in range(depth_of(most)):
            depth = depth + (F.col("total") > WIDTH**level).cast("int")
        nodes = self.trees.select("grp", "total", "level", "start", "node").withColumn("depth", depth)
        tops, open_ = [nodes.filter("level = depth").select("grp", "level", "node")], nodes.filter("level < depth")
        self.rounds: list[DataFrame] = []
        height = CHUNK_LEVELS + FIRST_RISE
        while not self.rounds or height - RISE < depth_of(most):
            schema = f"grp string, total bigint, level int, start bigint, path {_PATH}, up_level int, up_start bigint, up_node string, head boolean"
            blocks = open_.select("grp", "total", "level", "start", "node").groupBy("grp", F.expr(f"start div {WIDTH**height}L").alias("block"))
            made = scratch.keep(blocks.applyInPandas(_finish(height), schema))
            self.rounds.append(made)
            nodes = made.filter("head").select("grp", "total", F.col("up_level").alias("level"), F.col("up_start").alias("start"), F.col("up_node").alias("node")).withColumn("depth", depth)
            tops.append(nodes.filter("level = depth").select("grp", "level", "node"))
            open_, height = nodes.filter("level < depth"), height + RISE
        self.tops = scratch.keep(reduce(DataFrame.union, tops))

    def proofs(self, above: DataFrame) -> DataFrame:
        """item, grp, leaf, top, proof, folded: ``above`` (grp, path) leads from a group's root to the root of all.

        ``folded`` is the root from ``other`` where that is given, else from the leaf itself.
        """
        ready = self.tops.join(above, "grp").select("grp", "level", F.lit(0).cast("bigint").alias("start"), "path", F.col("node").alias("top"))
        for made in reversed(self.rounds):
            up = ready.select("grp", F.col("level").alias("up_level"), F.col("start").alias("up_start"), F.col("path").alias("more"), "top")
            ready = ready.union(made.join(up, ["grp", "up_level", "up_start"]).select("grp", "level", "start", F.concat("path", "more").alias("path"), "top"))
        ready = self.scratch.keep(ready)
        rows = self.trees.join(ready, ["grp", "level", "start"]).select("grp", "level", "items", "digests", "others", "path", "top")
        return rows.mapInArrow(_prove(self.item), f"item {self.kind}, grp string, leaf string, top string, proof {_PATH}, folded string")


def _prove(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, groups, leaves, tops, folded, size, left, right = [], [], [], [], [], [], [], []

        def ready() -> pa.RecordBatch:
            ends = [0]
            for n in size:
                ends.append(ends[-1] + n)
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            columns = [pa.array(items, kind), *(pa.array(c, pa.string()) for c in (groups, leaves, tops)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(folded, pa.string())]
            for c in (items, groups, leaves, tops, folded, size, left, right):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["item", "grp", "leaf", "top", "proof", "folded"])

        for batch in batches:
            for r in batch.to_pylist():
                mine = [r["digests"][k : k + 32].hex() for k in range(0, len(r["digests"]), 32)]
                levels, above = levels_of(mine, r["level"]), [(x["left"], x["right"]) for x in r["path"]]
                for i, (item, leaf, other) in enumerate(zip(r["items"], mine, r["others"])):
                    proof = [beside(levels[v], i // WIDTH**v) for v in range(r["level"])] + above
                    items.append(item)
                    groups.append(r["grp"])
                    leaves.append(leaf)
                    tops.append(r["top"])
                    folded.append(fold(leaf if other is None else other.hex(), proof))
                    size.append(len(proof))
                    left += [x[0] for x in proof]
                    right += [x[1] for x in proof]
                    if len(items) >= OUT_ROWS:
                        yield ready()
        if items:
            yield ready()

    return run


def merkle_manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, presented: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``order``, ``group``, leaf, subroot, root, proof, folded_root, verified.

    ``presented`` gives fields as they are presented for verification, in place of those that the
    manifest was made of; ``folded_root`` is computed from the leaf of the presented row and the manifest's proof.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    arrow_rows(spark)
    leaf = leaf_of([F.col(f) for f in fields])
    other = F.lit(None).cast("binary")
    if presented:
        changed = F.lit(False)
        for f, c in presented.items():
            changed = changed | ~c.eqNullSafe(F.col(f))
        other = F.when(changed, leaf_of([presented.get(f, F.col(f)) for f in fields]))
    # A null group sorts before all others, the empty one too.
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    trees = Forest(docs.select(key.alias("grp"), F.col(order).alias("item"), leaf.alias("digest"), other.alias("other")), scratch)
    over = Forest(trees.tops.select(F.lit("").alias("grp"), F.col("grp").alias("item"), F.unhex("node").alias("digest"), F.lit(None).cast("binary").alias("other")), scratch)
    root = over.tops.first()
    root = root["node"] if root else ""
    none = spark.createDataFrame([("", [])], f"grp string, path {_PATH}")
    above = scratch.keep(over.proofs(none).select(F.col("item").alias("grp"), F.col("proof").alias("path")))
    found = trees.proofs(above)
    named = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).cast(docs.schema[group].dataType)
    return found.select(F.col("item").alias(order), named.alias(group), "leaf", F.col("top").alias("subroot"), F.lit(root).alias("root"), "proof", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, from the leaf to the root and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)
