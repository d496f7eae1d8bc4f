from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakewarden.llm import packing as pk


def test_encoder_equals_tokenizers():
    rng = random.Random(1)
    texts = ["", "a  b", "<|endoftext|> x<|endoftext|>", "  lead", "tab\t \n x", "日本語 漢字　x", "\x85\xa0 é", "a'ss 'S I'll  ", " " * 50 + "x", "\U0001f600" * 2, "x" * 3000]
    texts += ["".join(rng.choice(" \n\tab1,é'") for _ in range(50)) for _ in range(500)]
    encoder = pk.Encoder(pk.default_tokenizer())
    plain = Tokenizer.from_file(pk.default_tokenizer())
    assert encoder.fast is not None
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_pieces_round_trip_and_packing_is_gapless(documents, awkward):
    tokenizer = Tokenizer.from_file(pk.default_tokenizer())
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 300, 900, 4000]))), "s") for i in range(60)]
    for df, texts in ((documents(rows), {i: t for i, t, _ in rows}),):
        got = pk.pack(df).toPandas()
        for i, g in got.groupby("doc_id"):
            ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
            g = g.sort_values("piece")
            assert g["piece"].tolist() == list(range(len(g))) and g["start"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() == len(ids)
            assert all(g["length"].iloc[1:] == 1024) and g["length"].iloc[0] <= 1024
            assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g["start"], g["length"])] == g["ids_crc32"].tolist()
        assert set(got["doc_id"]) == set(texts)
        got = got.sort_values(["sequence_id", "offset"])
        by = got.groupby("sequence_id")
        assert (got["offset"] == by["length"].cumsum() - got["length"]).all() and by["length"].sum().max() <= 1024
    assert pk.pack(awkward).select("doc_id").distinct().count() == len({r.doc_id for r in awkward.collect()})


@pytest.mark.parametrize("seed", range(30))
def test_bound_is_below_every_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 65, rng.integers(1, 60)))[::-1]
    bins, offsets, room = pk.best_fit(lengths, 64)
    assert pk.lower_bound(lengths, 64) <= len(room)
    fill = np.bincount(bins, weights=lengths, minlength=len(room))
    assert fill.max() <= 64 and (64 - fill == room).all()
    for b in range(len(room)):
        at = bins == b
        assert sorted(offsets[at].tolist()) == (np.cumsum(lengths[at]) - lengths[at]).tolist()


def test_bounds_know_sizes_over_half():
    assert pk.lower_bound(np.full(10, 600)) == 10
    assert pk.lower_bound(np.full(9, 342)) == 5  # two fit in a bin, three do not


def test_exchange_between_groups_saves_bins(spark, monkeypatch):
    monkeypatch.setattr(pk, "GROUP", 20)
    from lakewarden.llm.common import Scratch

    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([100, 300, 424, 500, 600]), i) for i in range(300)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pk.pack_pieces(found, Scratch(spark, "t")).toPandas()
    lengths = np.array([r[3] for r in rows])
    alone = sum(len(pk.best_fit(np.sort(lengths[i : i + 20])[::-1])[2]) for i in range(0, 300, 20))
    used = out["sequence_id"].nunique()
    assert len(out) == 300 and pk.lower_bound(lengths) <= used <= alone + 3
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by["length"].sum().max() <= 1024 and (out["gap"] >= 0).all()
    assert pk.certificate(spark.createDataFrame(out)) == (used, pk.lower_bound(lengths))


def test_equal_pieces_are_dealt_over_the_groups(spark, monkeypatch):
    monkeypatch.setattr(pk, "GROUP", 20)
    from lakewarden.llm.common import Scratch

    found = spark.createDataFrame([(None, 0, 0, 300, 7)] * 200, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pk.pack_pieces(found, Scratch(spark, "t")).toPandas()
    assert out.groupby(out["sequence_id"] // (1 << 24)).size().max() < 60
    assert 67 <= out["sequence_id"].nunique() <= 72


def test_empty_table(nothing):
    assert pk.pack(nothing).count() == 0
