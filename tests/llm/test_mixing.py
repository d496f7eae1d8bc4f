from __future__ import annotations

import random

import numpy as np
import pytest

from lakewarden.llm.mixing import mix, mixture, pivot


def expected_targets(sizes: dict, weights=(5, 2, 1), share=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, done, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(done.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > limit * sizes[s] + 1e-9]
        if not over:
            return done | {s: level * w[s] for s in open_}
        for s in over:
            done[s] = limit * sizes[s]
            open_.discard(s)
    return done


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1)))), rng.choice(["b", "b", "b", "a", "é", None, "Z"])) for i in range(n)]


def test_targets_and_sizes(documents):
    data = rows(1)
    sizes: dict = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = expected_targets(sizes)
    source = {i: s for i, _, s in data}
    got = mixture(documents(data)).collect()
    assert len(got) == len(data)
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(documents):
    data = rows(2)
    a = mixture(documents(data)).collect()
    b = mixture(documents(list(reversed(data))).repartition(7)).collect()
    assert sorted(a) == sorted(b)


def test_buckets_meet_in_a_tree(documents, monkeypatch):
    import lakewarden.llm.mixing as m

    monkeypatch.setattr(m, "BUCKET", 10)
    monkeypatch.setattr(m, "FAN_IN", 3)
    data = rows(3)
    got = mixture(documents(data)).collect()
    assert len(got) == len(data)
    source = {i: s for i, _, s in data}
    for s in {x for x in source.values()}:
        mine = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)


def test_pivot_keeps_mass_and_expectations():
    size = np.sort(np.random.default_rng(0).integers(1, 50, 40).astype(float))[::-1]
    mean = np.zeros(40)
    for seed in range(400):
        p, left = pivot(size, np.full(40, 0.3), np.random.default_rng(seed))
        assert (p * size).sum() == pytest.approx(0.3 * size.sum())
        assert sum((0 < x < 1) for x in p) <= 1 and (left < 0) == all(x in (0, 1) for x in p)
        mean += p / 400
    assert abs(mean - 0.3).max() < 0.12


def test_mix_repeats_documents(documents, awkward, nothing):
    data = rows(4, 120)
    df = documents(data)
    want = {r.doc_id: r.taken // r.size for r in mixture(df).collect() if r.taken}
    out = mix(df)
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    total = sum(r.taken for r in mixture(awkward).collect())
    assert sum(len((r.text or "").split()) for r in mix(awkward).collect()) == total
    assert mixture(nothing).count() == 0 and mix(nothing).count() == 0
