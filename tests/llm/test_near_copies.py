from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

import corpus_pipeline as cp
from lakewarden.llm.common import Scratch
from lakewarden.llm.near_copies import WORDS, _by_prefixes, _by_set, _grouped, alike, drop_near_copies, fingerprints, groups, shingles


def brute_least(rows, n=5):
    """The smallest doc_id of each component, from the similarity of all pairs of word lists."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    label = [i for i, _, _ in rows]
    while True:
        after = [min(label[j] for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)) for a in sets]
        if after == label:
            return set(label)
        label = after


def edited(rng, count, words=200, most=6):
    bases = [[f"w{rng.randrange(5000)}" for _ in range(words)] for _ in range(8)]
    rows = []
    for i in range(count):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(most)):
            text[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "s"))
    return rows


def test_stage_drops_edited_copies(spark, documents):
    rows = edited(random.Random(1), 60) + [(90, "", "s"), (91, None, "s"), (92, "one two", "s"), (93, "One  two", "s"), (94, "one three", "s")]
    (near,) = (f for _, f in cp.STAGES if f is cp.near)
    got = [r.doc_id for r in near(spark, documents(rows), "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_least(rows)


@pytest.mark.parametrize("crowd", [2, 10, 512])
def test_crowded_buckets_lose_no_pair(documents, crowd):
    rows = edited(random.Random(2), 50, most=20)
    assert {r.doc_id for r in drop_near_copies(documents(rows), crowd=crowd).collect()} == brute_least(rows)


def test_similarity_at_the_threshold():
    h = np.random.default_rng(4).integers(0, 1 << 63, 10, np.uint64)
    a, x = h[:9], h[9]
    assert len(set(alike([a, a[1:].copy(), np.append(a[1:], x)]))) == 1  # 8/9 twice, 8/10
    assert len(set(alike([a[:8], np.append(a[1:8], x)]))) == 2  # 7/9
    assert len(set(alike([a[:8], np.append(a[1:8], x)], np.array([5, 5])))) == 1  # linked beforehand


def test_fingerprints_are_majorities_of_bits():
    """All of a set's fingerprints against SimHashes counted bit by bit, over several portions."""
    h = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 700, np.uint64))
    own, other = fingerprints(h), fingerprints(h[::-1])
    assert len(own) == WORDS == len(set(own.tolist())) and own.tolist() == other.tolist()
    apart = np.bitwise_count(own ^ fingerprints(h[: 560 + 70]))
    assert 6 < apart.mean() < 12
    unlike = np.bitwise_count(own ^ fingerprints(h * np.uint64(3)))
    assert 28 < unlike.mean() < 36


def test_the_index_finds_pairs_at_the_threshold(spark):
    """Pairs of 0.8 reach a count through their fingerprints alone, and unlike sets do not meet."""
    rng, sets = np.random.default_rng(6), []
    for common in (4, 8, 40, 80, 400):
        for _ in range(40):
            h = rng.integers(0, 1 << 63, common * 5 // 4, np.uint64)
            rest = h[common:]
            sets += [h[:common], h] if common == 4 else [np.append(h[:common], rest[::2]), np.append(h[:common], rest[1::2])]
    rows = [(i, len(s), fingerprints(np.unique(s)).view(np.int64).tolist()) for i, s in enumerate(sets)]
    scratch = Scratch(spark, "groups")
    nodes = scratch.keep(spark.createDataFrame(rows, "name bigint, size bigint, prints array<bigint>"))
    found = {}
    for r in groups(nodes, scratch).collect():
        found.setdefault(r.key, []).append(r.name)
        assert not r.crowded and r.lead == r.name // 2 * 2 and r.size == len(sets[r.name])
    assert sorted(sorted(names) for names in found.values()) == [[i, i + 1] for i in range(0, len(sets), 2)]


def test_one_large_group_of_near_copies_is_a_row_per_set(spark):
    """300 near copies meet in other company under each band: groups with one first set are one, and a set is joined once."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 100, np.uint64)
    sets = [np.append(rng.permutation(base)[:95], rng.integers(0, 1 << 63, 5, np.uint64)) for _ in range(300)]
    rows = [(i, len(s), fingerprints(np.unique(s)).view(np.int64).tolist()) for i, s in enumerate(sets)]
    scratch = Scratch(spark, "large group")
    nodes = scratch.keep(spark.createDataFrame(rows, "name bigint, size bigint, prints array<bigint>"))
    found = scratch.keep(groups(nodes, scratch))
    by_key = {}
    for r in found.collect():
        by_key.setdefault((r.key, r.lead), []).append(r.name)
    large = [lead for (_, lead), names in by_key.items() if len(names) > 2]
    assert len(large) == len(set(large)) > 10
    assert all(min(names) == lead and len(set(names)) == len(names) for (_, lead), names in by_key.items())
    each = _by_set(found).collect()
    assert sorted(r.name for r in each) == list(range(300))
    assert sorted((m.key, m.lead, r.name) for r in each for m in r.met) == sorted((*k, name) for k, names in by_key.items() for name in names)
    assert all(r.first == min((m.lead for m in r.met if m.lead != r.name), default=None) and r.size == 100 for r in each)


def test_a_bucket_beyond_a_task_passes_whole():
    """250,000 fingerprints of one bucket and two of another, in batches: none is lost, and the large one has one lead."""
    n = 250_000
    key = np.append(np.full(n, 3), [8, 8])
    fp = np.random.default_rng(7).integers(0, 1 << 63, n + 2)
    fp[-1] = fp[-2]
    name = np.append(np.random.default_rng(8).permutation(n), [n, n + 1])
    rows = [key, fp, fp, fp, name, np.full(n + 2, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 40_000]) for c in rows], ["key", "fp", "fp1", "fp2", "name", "size"]) for i in range(0, n + 2, 40_000)]
    out = pa.Table.from_batches(list(_grouped(4)(iter(batches))))
    large = out.filter(out["crowded"])
    assert sorted(large["name"].to_pylist()) == list(range(n))
    assert len(set(large["lead"].to_pylist())) == len(set(large["key"].to_pylist())) == 1
    few = out.filter(pa.compute.invert(out["crowded"]))
    assert few["name"].to_pylist() == [n, n + 1] and few["lead"].to_pylist() == [n, n]


def routed(spark, sets, roots=None, crowd=512):
    scratch = Scratch(spark, "prefixes")
    names = scratch.keep(spark.createDataFrame([(i, roots[i] if roots else i) for i in range(len(sets))], "name bigint, root bigint"))
    own = scratch.keep(spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)], "name bigint, own binary"))
    searches = {}
    for r in _by_prefixes(names, own, scratch, crowd).collect():
        searches.setdefault((r.key, r.i, r.j), []).append(r.name)
    return searches


@pytest.mark.parametrize("crowd", [4, 30, 512])
def test_prefixes_bring_all_similar_pairs_together(spark, crowd):
    """Sets of unlike sizes about a few bases, similarities on both sides of the threshold and on it."""
    rng = random.Random(crowd)
    bases = [rng.sample(range(400), 60) for _ in range(4)]
    sets = []
    for _ in range(120):
        own = set(rng.choice(bases)[: rng.choice([1, 2, 9, 40, 50, 60])])
        own = own - set(rng.sample(sorted(own), min(len(own) - 1, rng.randrange(5)))) | {rng.randrange(400, 10**6) for _ in range(rng.randrange(5))}
        sets.append(own)
    searches = routed(spark, sets, crowd=crowd)
    met = {(a, b) for names in searches.values() for a in names for b in names if a < b}
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(similar) > 50 and similar <= met
    assert all(len(set(names)) == len(names) for names in searches.values())
    # Sets that are one component already are not searched again.
    assert not routed(spark, sets, roots=[0] * len(sets), crowd=crowd)


@pytest.mark.parametrize("own", [9, 15, 30])
def test_pages_of_a_template_are_written_in_proportion(spark, own):
    """20,000 pages with most of their hashes in common, no two similar but for a few copies: they do not all meet."""
    rng, template = random.Random(own), list(range(60 - own))
    sets = [{*template, *(rng.randrange(1000, 1 << 60) for _ in range(own))} for _ in range(20_000)]
    sets += [set(s) - {0} for s in sets[:10]]
    searches = routed(spark, sets)
    assert sum(len(names) for names in searches.values()) <= 2 * 60 * 10
    met = {tuple(sorted(names)) for names in searches.values()}
    assert {(i, 20_000 + i) for i in range(10)} <= met


def test_rows_equal_in_every_column_are_one(documents):
    rows = [(None, "a b c d e f", "s")] * 3 + [(4, "a b c d e f", "s"), (4, "x y", "s"), (4, "x y", "s")]
    assert sorted((r.doc_id or 0, r.text) for r in drop_near_copies(documents(rows)).collect()) == [(0, "a b c d e f"), (4, "x y")]
    assert len(shingles(b"", 5)) == len(shingles(b"a b", 5)) == 1


def test_empty(nothing):
    assert drop_near_copies(nothing).count() == 0
