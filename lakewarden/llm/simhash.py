"""Near duplicates by SimHash and a hierarchical index in Gray order.

Fingerprints are made distinct first, so groups of copies weigh nothing. Two
fingerprints within ``radius`` bits agree on one of ``radius + 1`` bands at
least, so each is routed to one bucket per band. A bucket's fingerprints are
sorted by Gray rank; runs of ``FANOUT`` form a node that keeps the bits all of
them share (mask and value), runs of nodes form upper nodes. A search walks
pairs of nodes from the roots, carries the number of shared bits that differ
and drops a pair of whole groups once that passes the radius. Only a spanning
forest of a bucket's links leaves its task; components are then contracted in
rounds over edge tables.

A bucket of over ``most`` fingerprints is routed on: its members agree on
the bits of its bands, so two of them within the radius agree on one of
``radius + 1`` bands of the bits that are left. Each level leaves a third or so of a
bucket's bits less, and a bucket whose bits are all used holds one fingerprint, so every bucket
comes down to a size that one task can index, at any size of the corpus and
however the fingerprints lie.

Defined results: null text counts as empty; a text without words has
fingerprint zero and is linked like any other; ties take the smallest doc_id;
repeated rows are repeated in the result; very long texts are cut into words and
hashed a portion at a time; an empty table gives an empty result; other columns
are ignored. ``near_copies`` builds the stage that drops near copies on this index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, whole, word_blocks
from .components import components

#: ``MOST`` is what a task indexes at once; a larger bucket is routed on.
RADIUS, SEED, FANOUT, MOST = 2, 42, 8, 8192


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles in order, a portion at a time; a shorter text is one shingle, a text without words none."""
    kept: list[bytes] = []
    short = True
    for words in word_blocks(text.lower()):  # ASCII letters and ASCII white space only, as it is bytes
        words = kept + words
        if len(words) >= shingle:
            short = False
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
            parts = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist())]
            yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
            words = words[len(words) - shingle + 1 :]
        kept = words
    if short and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def majority(portions: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes."""
    counts, n, step = np.zeros(64, np.int64), 0, 1 << 16
    for hashes in portions:
        for i in range(0, len(hashes), step):
            some = hashes[i : i + step]
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    return majority(shingle_hashes(text, shingle))


def bands(used: int, radius: int) -> list[int]:
    """The bits outside the mask ``used`` in ``radius + 1`` bands of adjacent ones, each added to the mask."""
    free = [1 << i for i in range(64) if not used >> i & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [used | sum(free[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(bucket: np.ndarray, fps: np.ndarray) -> list[dict]:
    """The index from its leaves up. Entries of all buckets of a task are built side by side."""
    full = np.full(len(fps), ~np.uint64(0))
    levels = [{"bucket": bucket, "mask": full, "value": fps}]
    while True:
        low = levels[-1]
        first = np.flatnonzero(np.concatenate(([True], low["bucket"][1:] != low["bucket"][:-1])))
        size = np.diff(np.append(first, len(low["bucket"])))
        if len(first) == len(low["bucket"]):
            return levels
        nodes = -(-size // FANOUT)
        owner = np.repeat(np.arange(len(first)), nodes)
        start = first[owner] + FANOUT * (np.arange(len(owner)) - np.repeat(np.cumsum(nodes) - nodes, nodes))
        stop = np.minimum(start + FANOUT, (first + size)[owner])
        ones = np.bitwise_and.reduceat(low["value"] & low["mask"], start)
        zeros = np.bitwise_and.reduceat(~low["value"] & low["mask"], start)
        levels.append({"bucket": low["bucket"][first][owner], "mask": ones | zeros, "value": ones, "start": start, "stop": stop})


def _expand(a: np.ndarray, b: np.ndarray, node: dict) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (a, b), each unordered pair once."""
    na, nb = node["stop"][a] - node["start"][a], node["stop"][b] - node["start"][b]
    n = na * nb
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(nb, n)
    x = np.repeat(node["start"][a], n) + at // wide
    y = np.repeat(node["start"][b], n) + at % wide
    once = (np.repeat(a, n) != np.repeat(b, n)) | (x <= y)
    return x[once], y[once]


def linked(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 14, label: np.ndarray | None = None, confirm: Callable | None = None) -> np.ndarray:
    """For each entry, the index of an entry that stands for its component among links within its bucket.

    Entries must be sorted by bucket, then by Gray rank. ``label`` holds what is
    linked beforehand; ``confirm`` takes pairs within the radius, of components that
    are still apart, and tells which of them are links.
    """
    label = np.arange(len(fps)) if label is None else label
    if not len(fps):
        return label
    levels = _levels(bucket, fps)
    top = np.arange(len(levels[-1]["value"]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > chunk:
            stack.append((depth, a[chunk:], b[chunk:]))
            a, b = a[:chunk], b[:chunk]
        if depth == 0:
            if confirm is not None:
                apart = _root(label, a) != _root(label, b)
                a, b = a[apart], b[apart]
                sure = confirm(a, b) if len(a) else apart[:0]
                a, b = a[sure], b[sure]
            _hook(label, a, b)
            continue
        x, y = _expand(a, b, levels[depth])
        low = levels[depth - 1]
        apart = np.bitwise_count((low["value"][x] ^ low["value"][y]) & low["mask"][x] & low["mask"][y])
        near = apart <= radius
        if depth == 1:
            near &= x != y
        if near.any():
            stack.append((depth - 1, x[near], y[near]))
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _root(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = label[x]
        if np.array_equal(up, x):
            return x
        x = up


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each linked pair, the larger root below the smaller."""
    while len(a):
        a, b = _root(label, a), _root(label, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _search(radius: int):
    """Search the buckets of a partition sorted by (mask, value); a bucket may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            mask, value, fps = rows[0], rows[1], rows[2].view(np.uint64)
            order = np.lexsort((gray_rank(fps), value, mask))
            mask, value, fps = mask[order], value[order], fps[order]
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
            label = linked(np.cumsum(new), fps, radius)
            moved = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= 100_000:
                rows = np.concatenate(held, axis=1)
                last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
                if not last.all():
                    yield done(rows[:, ~last])
                held = [rows[:, last]] if not last.all() else [rows]
        if held and held[0].shape[1]:
            yield done(np.concatenate(held, axis=1))

    return run


def _routed(nodes: DataFrame, masks: dict[int, list[int]], by: str | None) -> DataFrame:
    """(mask, value, fp) of each fingerprint under the bands that follow its mask."""
    lists = {m: F.array(*(F.lit(_signed(x)) for x in found)) for m, found in masks.items()}
    if by is None:
        following = next(iter(lists.values()))
    else:  # three times as many masks at each level, whatever the number of rows
        following = F.create_map(*(x for m, found in lists.items() for x in (F.lit(_signed(m)), found)))[F.col(by)]
    return nodes.select("fp", F.explode(following).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``nodes`` (fp) that span every link within the radius."""
    most = max(most, 1 << radius)  # a larger bucket has more free bits than the radius, so each of its bands takes some
    masks, found = {0: bands(0, radius)}, []
    routed = _routed(nodes, masks, None)
    while True:
        large = scratch.keep(routed.groupBy("mask", "value").count().filter(F.col("count") > most).select("mask", "value"))
        if large.isEmpty():
            found.append(routed)
            break
        found.append(routed.join(large, ["mask", "value"], "left_anti"))
        rows = scratch.keep(routed.join(large, ["mask", "value"], "left_semi").select("mask", "fp"))
        masks = {m: bands(m, radius) for m in dict.fromkeys(x for some in masks.values() for x in some)}
        routed = _routed(rows, masks, "mask")
    small = found[0]
    for more in found[1:]:
        small = small.union(more)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.repartition(parts, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_search(radius), "a bigint, b bigint")


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, shingle))
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(scratch.keep(links(nodes.select("fp"), scratch, radius, most)), scratch)
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    labelled = scratch.keep(labelled)
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.keep(labelled.join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
