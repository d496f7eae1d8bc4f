from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm.common import Scratch
from lakewarden.llm.near_copies import drop_near_copies
from lakewarden.llm.simhash import bands, fingerprint, gray_rank, linked, links, near_dedup


def brute_print(text: str, n: int = 3) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.array(ids, dtype=np.int64)
    while True:
        after = np.array([label[near[i]].min() for i in range(len(label))])
        if (after == label).all():
            return label
        label = after


@given(st.text(alphabet="aA bB\t\né", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_equals_brute_force(text):
    assert fingerprint(text.encode()) == brute_print(text)


def test_gray_rank_orders_by_single_bit_steps():
    codes = np.arange(256, dtype=np.uint64) ^ (np.arange(256, dtype=np.uint64) >> np.uint64(1))
    assert (gray_rank(codes) == np.arange(256)).all()


def _close_prints(rng, n):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 10))]
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_index_search_loses_no_link(n):
    fps = _close_prints(random.Random(n), n)
    fps = fps[np.argsort(gray_rank(fps))]
    label = linked(np.zeros(len(fps), np.int64), fps)
    want = brute_components(np.arange(len(fps)), fps)
    groups = {}
    assert all(groups.setdefault(a, b) == b for a, b in zip(label, want)) and len(set(label)) == len(set(want))


def spanned(edges, fps):
    """The number of components that the edges leave."""
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return len({find(int(x)) for x in fps.view(np.int64)})


@pytest.mark.parametrize("most", [1, 5, 8192])
def test_components_equal_brute_force(spark, most):
    fps = _close_prints(random.Random(7), 150)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = {(r.a, r.b) for r in links(nodes, Scratch(spark, "t"), most=most).collect()}
    assert spanned(edges, fps) == len(set(brute_components(np.arange(len(fps)), fps)))


def test_bucket_of_many_prints_is_routed_on(spark):
    # 12,000 prints that agree on their lowest 22 bits, so that one bucket holds them all; half of them have a neighbour.
    rng = np.random.default_rng(8)
    low = rng.integers(0, 1 << 42, 6000, np.uint64) << np.uint64(22)
    flip = np.uint64(1) << rng.integers(22, 64, 6000).astype(np.uint64)
    fps = np.unique(np.concatenate([low, low ^ flip]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = {(r.a, r.b) for r in links(nodes, Scratch(spark, "t")).collect()}
    label = np.arange(len(fps))
    at = {int(x): i for i, x in enumerate(fps)}
    pairs = [(i, at[y]) for i, x in enumerate(fps.tolist()) for one in range(64) for y in (x ^ 1 << one,) if y in at]
    pairs += [(i, at[y]) for i, x in enumerate(fps.tolist()) for a in range(64) for b in range(a) for y in (x ^ 1 << a ^ 1 << b,) if y in at]
    while True:
        before = label.copy()
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if (before == label).all():
            break
    assert spanned(edges, fps) == len(set(label.tolist()))


@pytest.mark.parametrize(("used", "radius"), [(0, 2), ((1 << 21) - 1, 2), (0b1011, 5)])
def test_bands_share_out_the_free_bits(used, radius):
    found = [m ^ used for m in bands(used, radius)]
    assert len(found) == radius + 1 and sum(found) == used ^ (1 << 64) - 1 and not any(m & used for m in found)


def test_portions_of_a_long_text_make_one_print(monkeypatch):
    import lakewarden.llm.simhash as m
    from lakewarden.llm.common import word_blocks

    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(m, "word_blocks", lambda t: word_blocks(t, 100))
    assert fingerprint(text.encode()) == whole == brute_print(text)


def test_query_equals_brute_force(spark, documents):
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(80):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(words), "s"))
    rows += [(90, "", "s"), (91, None, "s"), (92, "one two", "s")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dedup(documents(rows)).collect()}
    fps = np.array([brute_print(t or "") for _, t, _ in rows], np.uint64)
    want = brute_components([i for i, _, _ in rows], fps)
    assert got == {i: (f"{int(f):016x}", int(w)) for (i, _, _), f, w in zip(rows, fps, want)}


def test_awkward_and_empty(awkward, nothing):
    got = near_dedup(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    out = drop_near_copies(awkward)
    assert out.columns == awkward.columns
    assert near_dedup(nothing).count() == 0 and drop_near_copies(nothing).count() == 0
