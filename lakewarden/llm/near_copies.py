"""The stage that drops near copies: SimHash fingerprints and their Gray-order index, with links by Jaccard similarity.

Two texts are linked when their sets of shingles (as 64-bit hashes) have a
similarity of ``SIMILAR`` at least, counted exactly. Each set has ``WORDS``
fingerprints of 64 bits, the SimHash of its hashes mixed anew for each. As in ``simhash`` a fingerprint
is routed by the bands of its bits, and each bucket is searched by the Gray-order
index, here for fingerprints within ``RADIUS`` bits; what the index finds, and nothing else, is
counted. Fingerprints of a pair at 0.8 differ in 10 of 64 bits on average, so one of them agrees on
a band and lies within the radius, and the next two within ``WIDER``, with a probability of 0.45: all ``WORDS`` miss such a pair with
4e-9 (1e-7 where a set of four hashes lies in one of five), a closer one more seldom.

Sets that the index finds together in a bucket are a group; most of the fingerprints find the same
groups, which are made one, as are those of over two sets with the same first one. What is joined to a set is
joined once, beside the list of its groups (one per band at most), and not for each group. Each set is counted against one other first, the smallest that leads a group of
its own, which settles most near copies at a cost that grows with their number alone. Groups whose members are not all linked
by then make families, those that share a set being one, and each family is searched by the index once more, now with the
sets at hand. Families of over ``CROWD`` sets (or ``HASHES`` hashes),
and buckets of over ``MOST`` times as many, are routed on by the prefixes that
two similar sets must share a hash of (``_by_prefixes``), which leaves no pair out; sets that meet in a
hash are dealt out so that no search holds much more. That search looks for fingerprints within ``BITS`` bits (a
pair at the threshold passes 24 with a probability of 3e-5 at most, where the sets are tiny). Only a spanning forest leaves a task.

Defined results: null text counts as empty; words are those of ``simhash``; a
text of fewer words than a shingle is one shingle, and texts without words are
equal; of each group the row with the smallest doc_id stays (null is smallest, and
of equal ids one row); very long texts are hashed a portion at a time; an empty table gives an
empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, hub_join, keyed, unkeyed, whole
from .components import components
from .simhash import SEED, bands, gray_rank, linked, majority, shingle_hashes

#: The least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BITS = 24
CROWD, HASHES, MOST = 512, 1 << 22, 16
#: Fingerprints of a set, the bits within which two are near, those within which the next two of both are, and in how many turns they are searched.
WORDS, RADIUS, WIDER, TURNS = 32, 12, 30, 4
#: Five bands of 12 or 13 bits.
BANDS = [int(m) - (1 << 64 if m >> 63 else 0) for m in bands(0, 4)]
#: Routed fingerprints in one task of a turn.
ROUTED = 1 << 20
#: A set of fewer hashes has several votes of each, as the majority of a few is often close.
FEW, VOTES = 64, 3
#: Hashes of a set in one Arrow batch.
PORTION = 1 << 16
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 63, WORDS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_VOTE = _RNG.integers(0, 1 << 63, VOTES, np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = [(1, np.uint64(0x5555555555555555), 3), (2, np.uint64(0x3333333333333333), 5), (4, np.uint64(0x0F0F0F0F0F0F0F0F), 0)]


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; without words, the hash of nothing."""
    parts = [np.unique(x) for x in shingle_hashes(text, n)]
    return np.unique(np.concatenate(parts)) if parts else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def fingerprints(own: np.ndarray) -> np.ndarray:
    """The SimHashes of a set: of its hashes mixed anew for each, the bits set in over half."""
    if len(own) < FEW:
        own = (own[:, None] * _VOTE).ravel()
    counts, step = np.zeros((8, WORDS, 8), np.int64), 255
    for i in range(0, len(own), step):
        some = own[i : i + step, None]
        mixed = np.zeros((-(-len(some) // 15) * 15, WORDS), np.uint64)
        np.multiply(some ^ _FLIP, _TIMES, out=mixed[: len(some)])
        mixed ^= mixed >> np.uint64(32)
        # Added up by threes in lanes of 2 bits, by fives of those in 4 bits, and then in bytes.
        lanes = {0: mixed}
        for shift, mask, rows in _LANES:
            halves = {bit + k * shift: (x >> np.uint64(k * shift)) & mask for bit, x in lanes.items() for k in (0, 1)}
            lanes = {bit: sum(x[k::rows] for k in range(rows)) if rows else x.sum(axis=0) for bit, x in halves.items()}
        for bit, x in lanes.items():
            counts[bit] += x.view(np.uint8).reshape(WORDS, 8)
    return np.packbits(2 * counts > len(own), axis=0, bitorder="little").reshape(-1).view(np.uint64)


class _Counted:
    """Sets of one bucket, ready to be counted against each other."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        names, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mine = np.zeros(len(names), bool)

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are as similar to set ``i`` as a link asks."""
        own = self.code[self.start[i] : self.start[i] + self.size[i]]
        size = self.size[others]
        spots = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.start[others], size)
        self.mine[own] = True
        shared = np.add.reduceat(self.mine[self.code[spots]], np.cumsum(size) - size, dtype=np.int64)
        self.mine[own] = False
        # shared / (both - shared) >= p / q
        return sum(SIMILAR) * shared >= SIMILAR[0] * (self.size[i] + size)


def alike(sets: list[np.ndarray], groups: np.ndarray | None = None) -> np.ndarray:
    """For each set, the index of one that stands for its component; equal ``groups`` are linked beforehand."""
    fps = np.array([majority([s]) for s in sets], np.uint64)
    order = np.argsort(gray_rank(fps), kind="stable")
    counted = _Counted([sets[i] for i in order])
    label = np.arange(len(sets))
    if groups is not None:
        _, first, at = np.unique(groups[order], return_index=True, return_inverse=True)
        label = first[at]

    def confirm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sure = np.zeros(len(a), bool)
        by = np.argsort(a, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], a[by][1:] != a[by][:-1], [True])))
        for i, j in zip(cuts, cuts[1:]):
            sure[by[i:j]] = counted.like(a[by[i]], b[by[i:j]])
        return sure

    label = linked(np.zeros(len(sets), np.int64), fps[order], BITS, 1 << 10, label, confirm)
    out = np.empty(len(sets), np.int64)
    out[order] = order[label]
    return out


def _prints(docs: DataFrame, n: int) -> DataFrame:
    """(rid, doc_id, name, size, prints) of each row: hash of its set, size of the set, fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prints = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, t in enumerate(batch.column(2).cast(pa.binary())):
                own = shingles(t.as_py(), n)
                names[i], sizes[i], prints[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), fingerprints(own)
            offsets = pa.array(np.arange(0, prints.size + 1, WORDS, dtype=np.int32))
            flat = pa.ListArray.from_arrays(offsets, pa.array(prints.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names.view(np.int64)), pa.array(sizes), flat], ["rid", "doc_id", "name", "size", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "doc_id", "text").mapInArrow(run, f"rid bigint, doc_id {kind}, name bigint, size bigint, prints array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(name, own) of the ``wanted`` (rid, name): the hashes of the set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), n).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["name", "own"])

    return docs.select("rid", "text").join(wanted.hint("merge"), "rid").select("name", "text").mapInArrow(run, "name bigint, own binary")


def _own(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s.as_py(), np.uint64) for s in group["own"]]


def _with_first(group: pa.Table) -> pa.Table:
    """Links between the members of a part and the first one of their bucket."""
    names, sets, first = group["name"].to_numpy(), _own(group), group["lead"].to_numpy()[0]
    i = int(np.flatnonzero(names == first)[0])
    others = np.flatnonzero(names != first)
    near = names[others[_Counted(sets).like(i, others)]] if len(others) else names[:0]
    return pa.table({"a": pa.array(near), "b": pa.array(np.full(len(near), first))})


def _searched(group: pa.Table) -> pa.Table:
    names = group["name"].to_numpy()
    label = alike(_own(group), group["root"].to_numpy())
    moved = label != np.arange(len(label))
    return pa.table({"a": pa.array(names[moved]), "b": pa.array(names[label[moved]])})


def _grouped(crowd: int):
    """Groups that the index finds in the buckets of a partition sorted by key; a bucket may span batches."""

    def done(rows: np.ndarray, over: list[int]) -> pa.RecordBatch:
        """Rows of whole buckets; those of the bucket ``over`` (key, first name) are the rest of one."""
        order = np.lexsort((gray_rank(rows[1].view(np.uint64)), rows[0]))
        key, fp, one, two, name, size = rows[:, order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(start, len(key)))
        large = np.repeat((count > MOST * crowd) | (key[start] == over[0] if over else False), count)
        label = np.repeat(start, count)
        few = np.flatnonzero(~large)
        fp, one, two = (x[few].view(np.uint64) for x in (fp, one, two))

        def confirm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.bitwise_count(one[a] ^ one[b]) + np.bitwise_count(two[a] ^ two[b]) <= WIDER

        label[few] = few[linked(label[few], fp, RADIUS, confirm=confirm)]
        # Members of a group side by side, in the order of their names.
        order = np.lexsort((name, label))
        key, name, size, large, label = (x[order] for x in (key, name, size, large, label))
        start = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        count = np.diff(np.append(start, len(label)))
        lead = name[start]
        if over:
            lead[large[start] & (key[start] == over[0])] = over[1]
        # A group is named by its first member, as groups that share it are searched together anyway; a pair by both, as it is settled alone.
        mixed = name.view(np.uint64) * _TIMES[0]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _TIMES[1]
        mark = np.where(large[start] | (count > 2), lead, np.add.reduceat(mixed, start).view(np.int64))
        crowded = large[start] | (count > crowd) | (np.add.reduceat(size, start) > HASHES)
        some = np.repeat((count > 1) | large[start], count)
        columns = [np.repeat(mark, count), name, size, np.repeat(lead, count), np.repeat(crowded, count)]
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], ["key", "name", "size", "lead", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        over: list[int] = []
        enough = max(100_000, 2 * MOST * crowd)
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(x.shape[1] for x in held) < enough:
                continue
            rows = np.concatenate(held, axis=1)
            last = rows[0] == rows[0, -1]
            if last.all():  # a large bucket passes without being held
                over = over if over and over[0] == rows[0, 0] else [rows[0, 0], rows[4].min()]
                yield done(rows, over)
                held = []
            else:
                yield done(rows[:, ~last], over)
                held = [rows[:, last]]
        if held and held[0].shape[1]:
            yield done(np.concatenate(held, axis=1), over)

    return run


def groups(nodes: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(key, name, size, lead, crowded): groups of ``nodes`` (name, size, prints) that the Gray-order index finds within a bucket, each once."""
    step = WORDS // TURNS
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * step * len(BANDS) // ROUTED))
    found = None
    for turn in range(TURNS):  # so that a part of the routed fingerprints lies on disk at a time
        each = nodes.select("name", "size", "prints", F.posexplode(F.slice("prints", turn * step + 1, step)).alias("word", "fp"))
        others = [F.get("prints", (F.col("word") + turn * step + k) % WORDS).alias(f"fp{k}") for k in (1, 2)]
        routed = each.select(F.explode(F.array(*(F.xxhash64(F.lit(turn), "word", F.lit(m), F.col("fp").bitwiseAND(F.lit(m))) for m in BANDS))).alias("key"), "fp", *others, "name", "size")
        some = routed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_grouped(crowd), "key bigint, name bigint, size bigint, lead bigint, crowded boolean")
        some = scratch.keep(some)
        found = some if found is None else found.union(some)
    return scratch.keep(found.groupBy("key", "name").agg(F.first("size").alias("size"), F.min("lead").alias("lead"), F.max("crowded").alias("crowded")))


def _by_set(found: DataFrame) -> DataFrame:
    """(name, size, first, met): each set once, with the groups ``found`` of it and the smallest other set that leads one.

    A set has a group per band of its fingerprints at most, however many others are near it.
    """
    first = F.min(F.when(F.col("lead") != F.col("name"), F.col("lead"))).alias("first")
    return found.groupBy("name").agg(F.first("size").alias("size"), first, F.collect_list(F.struct("key", "lead", "crowded")).alias("met"))


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, n: int, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct sets ``nodes`` (name, rid, size, prints) that span every link."""
    edge = "a bigint, b bigint"
    met = scratch.keep(_by_set(groups(nodes, scratch, crowd)))
    wanted = met.select("name").join(nodes.select("name", "rid").hint("merge"), "name")
    sets = scratch.keep(_sets(docs, wanted, n))

    # Each set meets one that leads a group of its own; that one goes to each part.
    pairs = scratch.keep(met.filter("first is not null").select("name", "first", "size"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) * 2 / crowd), F.ceil(F.sum("size") * 2 / HASHES)).cast("int")
    per = scratch.keep(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")))
    members = hub_join(pairs, per, ["first"], "name").select(F.col("first").alias("lead"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), "name")
    firsts = members.select("lead", "part").distinct().select("lead", "part", F.col("lead").alias("name"))
    one = members.union(firsts).join(sets.hint("merge"), "name")
    near = scratch.keep(one.groupBy("lead", "part").applyInArrow(_with_first, edge))
    roots = scratch.keep(components(near, scratch))

    # A group whose members are one component by now has nothing left to link, nor has a pair that was counted.
    rest = met.join(roots.withColumnRenamed("node", "name").hint("merge"), "name", "left").select("name", "size", F.coalesce("root", "name").alias("root"), "first", F.explode("met").alias("met"))
    rest = scratch.keep(rest.select("met.*", "name", "size", "root", F.coalesce(F.col("first") == F.col("met.lead"), F.lit(False)).alias("counted")))
    split = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"), F.max("counted").alias("counted"), F.max("crowded").alias("crowd"))
    split = scratch.keep(split.filter("x < y and (crowd or n > 2 or not counted)").select("key", "n"))
    left = scratch.keep(hub_join(rest, split, ["key"], "name").select("name", "lead", "size", "crowded", "root"))
    # Groups that share a set are one family, so that each set is searched once.
    families = components(left.select(F.col("name").alias("a"), F.col("lead").alias("b")), scratch)
    each = left.groupBy("name").agg(F.first("size").alias("size"), F.first("root").alias("root"), F.max("crowded").alias("crowded"))
    each = scratch.keep(each.join(families.select(F.col("node").alias("name"), F.col("root").alias("key")).hint("merge"), "name"))
    large = (F.count(F.lit(1)) > crowd) | (F.sum("size") > HASHES) | F.max("crowded")
    asked = hub_join(each.drop("crowded"), scratch.keep(each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), large.alias("large"))), ["key"], "name")
    asked = scratch.keep(asked.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "name", "root", "large"))
    crowds = scratch.keep(asked.filter("large").select("name", "root"))
    small = asked.filter("not large").drop("large")
    asked = small if crowds.isEmpty() else small.union(_by_prefixes(crowds, sets, scratch, crowd))
    found = asked.join(sets.hint("merge"), "name").groupBy("key", "i", "j").applyInArrow(_searched, edge)
    return near.union(scratch.keep(found))


def _by_prefixes(crowds: DataFrame, sets: DataFrame, scratch: Scratch, crowd: int) -> DataFrame:
    """(key, i, j, name, root): searches that meet every link between different roots of ``crowds`` (name, root).

    In one order of all hashes, rare ones first, the first hash that two similar
    sets share lies among the first ninth of the smaller one and the first fifth of the larger one
    (for a similarity of 4/5: as many hashes of a set may be missing in the other at most). So sets meet
    by these prefixes, and a hash that is in no set's first ninth needs no search: the
    common hashes of a template do not bring its pages together unless little else is in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                for at in range(0, len(own), PORTION):
                    part = own[at : at + PORTION]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(k)[i].as_py())) for k in (0, 1)] + [pa.array(np.full(len(part), len(own))), pa.array(part)], ["name", "root", "size", "hash"])

    hashes = crowds.join(sets.hint("merge"), "name").select("name", "root", "own").mapInArrow(run, "name bigint, root bigint, size bigint, hash bigint")
    often = scratch.keep(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("often", F.col("n")))
    shared = hub_join(hashes, often, ["hash"], "name")
    p, q = SIMILAR
    own = shared.groupBy("name", "root", "size").agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("own"))
    # Hashes that no other set has come first and need no search.
    alone = F.col("size") - F.size("own")
    first, last = F.col("size") - F.ceil(F.col("size") * 2 * p / (p + q)), F.col("size") - F.ceil(F.col("size") * p / q)
    prefix = own.select("name", "root", "size", F.posexplode(F.slice("own", F.lit(1), F.greatest(last + 1 - alone, F.lit(0)).cast("int"))).alias("at", "x"), (first - alone).alias("till"))
    prefix = scratch.keep(prefix.select(F.col("x.hash").alias("hash"), "name", "root", "size", (F.col("at") <= F.col("till")).alias("early")))

    # Hashes with the same sets in the same roles are one.
    mark = F.sum(F.xxhash64("name", "early").cast("decimal(20,0)")).alias("mark")
    early = F.col("early").cast("bigint")
    groups = prefix.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum(early).alias("k"), F.sum("size").alias("all"), F.sum(early * F.col("size")).alias("some"), F.min("root").alias("x"), F.max("root").alias("y"), mark
    ).filter("k > 0 and x < y").groupBy("n", "k", "all", "some", "mark").agg(F.min("hash").alias("hash"))

    def parts(count: str, size: str) -> Column:
        """So many that two of them fill a search."""
        return F.when((F.col("n") <= crowd) & (F.col("all") <= HASHES), 1).otherwise(F.greatest(F.ceil(F.col(count) * 2 / crowd), F.ceil(F.col(size) * 2 / HASHES))).cast("int")

    groups = scratch.keep(groups.select("hash", "n", parts("k", "some").alias("rows"), parts("n", "all").alias("columns")))
    dealt = hub_join(prefix, groups, ["hash"], "name")
    # A set is a column's, beside each row; one with the hash early is also a row's, beside each column.
    row, column = (F.pmod(F.xxhash64("name"), F.col(c)).cast("int") for c in ("rows", "columns"))
    as_column = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), column.alias("j")))
    as_row = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(row.alias("i"), j.alias("j")))
    cells = F.when(F.col("early"), F.array_distinct(F.concat(as_column, as_row))).otherwise(as_column)
    return dealt.select(F.col("hash").alias("key"), "name", "root", F.explode(cells).alias("p")).select("key", "p.i", "p.j", "name", "root")


def least_rows(docs: DataFrame, n: int, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(rid) of the row with the smallest doc_id in each component of ``docs`` (rid, doc_id, text)."""
    arrow_rows(docs.sparkSession)
    prints = scratch.keep(_prints(docs, n))
    nodes = scratch.keep(prints.groupBy("name").agg(F.min(F.struct("doc_id", "rid")).alias("best"), F.min("rid").alias("rid"), F.first("size").alias("size"), F.first("prints").alias("prints")))
    roots = components(links(docs, nodes, scratch, n, crowd), scratch)
    named = nodes.join(roots.hint("merge"), nodes["name"] == roots["node"], "left").select("best", F.coalesce("root", "name").alias("root"))
    return scratch.keep(named.groupBy("root").agg(F.min("best").alias("best")).select("best.rid"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, crowd: int = CROWD) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, with all its columns."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    rows = scratch.keep(keyed(docs))
    stay = least_rows(rows.select("rid", "row.doc_id", whole(F.col("row.text")).alias("text")), shingle, scratch, crowd)
    # The rows that stay grow with the input: no broadcast, at any size.
    return unkeyed(rows.join(stay.hint("merge"), "rid"))
