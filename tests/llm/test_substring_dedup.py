from __future__ import annotations

import random

import numpy as np
import pytest

from lakewarden.llm import substring_dedup as sd


def brute(rows):
    first: dict = {}
    for i, t in sorted(((-1 if i is None else i), t or "") for i, t in rows):
        w = t.encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (-1 if i is None else i):
                gone[k : k + 50] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(20)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([20, 49, 50, 51, 80, 260]))) for _ in range(10)]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            t = " ".join(["a"] * rng.randrange(130))
        elif kind == 1:
            t = " ".join((["a", "b", "c"][: rng.randrange(1, 4)] * 100)[: rng.randrange(200)])
        elif kind == 2:
            t = rng.choice(base) + " " + rng.choice(base)
        elif kind == 3:
            w = rng.choice(base).split()
            s = rng.randrange(len(w))
            t = " ".join(w[s : s + rng.randrange(120)] + [rng.choice(vocab)] + w[:s])
        elif kind == 4:
            t = (rng.choice(base) + "\n") * rng.randrange(4)
        else:
            t = " ".join(rng.choice(vocab) for _ in range(rng.randrange(200)))
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.substring_dedup(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    rows = corpus(seed)
    assert result(documents([(i, t, "s") for i, t in rows])) == brute(rows)


def test_repeated_ids_nulls_and_empty(documents, nothing):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(5, long), (5, long + " x"), (5, "short"), (9, long), (None, long), (7, None), (8, ""), (3, "y " + long)]
    assert result(documents([(i, t, "s") for i, t in rows])) == brute(rows)
    assert sd.substring_dedup(nothing).count() == 0


def test_repeated_rows_and_ids_that_are_no_numbers(spark):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [("b", long)] * 3 + [("a", "x " + long), ("c", long + " y"), (None, "z"), ("10", "q " + long + " r")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = {"a": 70, "b": 70, "c": 70, None: 0, "10": 0}  # "10" is the smallest of them
    got = sd.substring_dedup(df).collect()
    assert len(got) == len(rows) and all(r.n_removed == want[r.doc_id] for r in got)


@pytest.mark.parametrize("size", [60, 130])
def test_portions_change_nothing(size, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_WORDS", size)
    monkeypatch.setattr(sd, "word_blocks", lambda t: (t.split()[i : i + 7] for i in range(0, len(t.split()), 7)))
    texts = [t.encode() for _, t in corpus(3, 40)]
    seen: dict = {}
    for words, parts in sd._portions(texts):
        assert sum(n for _, _, n in parts) == len(words) < size + 60
        begin = 0
        for i, at, n in parts:
            assert words[begin : begin + n] == texts[i].split()[at : at + n]
            for k in range(n - 49):
                assert (i, at + k) not in seen
                seen[i, at + k] = True
            begin += n
    assert len(seen) == sum(max(0, len(t.split()) - 49) for t in texts)


def test_a_long_text_in_portions_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(400)}" for _ in range(420_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[399_990:400_090])), (3, "x " + " ".join(words[5:80])), (4, " ".join(words[:300_000]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (420_000, 0), 2: (100, 100), 3: (76, 75), 4: (300_000, 300_000)}


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_take_equal_anchors(seed):
    texts = [t.encode() for _, t in corpus(seed, 60)]
    flat = [w for t in texts for w in t.split()]
    doc = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
    p1, p2, symbol, _, _ = sd.runs(sd._hashed(flat), doc)
    anchor = {p: int(s) for a, b, s in zip(p1, p2, symbol) for p in range(a, b + 1)}
    assert sorted(anchor) == [p for p in range(len(flat) - 49) if doc[p] == doc[p + 49]]
    seen: dict = {}
    for p, s in anchor.items():
        assert seen.setdefault(tuple(flat[p : p + 50]), s) == s
