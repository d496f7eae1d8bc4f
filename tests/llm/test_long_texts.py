"""Every operator on a text of some megabytes, one word of half a million characters, and short neighbours."""

from __future__ import annotations

import random

import pytest

from lakewarden.llm import chat, queries
from lakewarden.llm.exact_dedup import exact_dedup
from lakewarden.llm.mixing import mixture
from lakewarden.llm.near_copies import drop_near_copies
from lakewarden.llm.packing import pack
from lakewarden.llm.quality_classifier import quality_classifier
from lakewarden.llm.quality_rules import quality_rules
from lakewarden.llm.simhash import near_dedup
from lakewarden.llm.substring_dedup import substring_dedup
from lakewarden.llm.token_counts import token_counts
from lakewarden.llm.toxicity import toxicity

N = 400_000


@pytest.fixture(scope="module")
def long_texts(spark, documents):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(N))
    rows = [(1, text, "s"), (2, text, "s"), (3, text + " end", "t"), (4, "x" * 500_000, "s"), (5, "日本" * 100_000, "t"), (6, "a few words", "s")]
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    return documents(rows).repartition(2).cache(), labels


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_counts_and_copies(long_texts):
    docs, _ = long_texts
    assert {i: r.group_size for i, r in by_id(exact_dedup(docs)).items()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert {i: r.n_words for i, r in by_id(quality_rules(docs)).items()} == {1: N, 2: N, 3: N + 1, 4: 1, 5: 1, 6: 3}
    assert {i: r.size for i, r in by_id(mixture(docs)).items()} == {1: N, 2: N, 3: N + 1, 4: 1, 5: 1, 6: 3}
    assert {i: r.component_id for i, r in by_id(near_dedup(docs)).items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert set(by_id(drop_near_copies(docs))) == {1, 4, 5, 6}
    assert {i: (r.n_words, r.n_removed) for i, r in by_id(substring_dedup(docs)).items()} == {1: (N, 0), 2: (N, N), 3: (N + 1, N), 4: (1, 0), 5: (1, 0), 6: (3, 0)}


def test_tokens(long_texts):
    docs, _ = long_texts
    counts = by_id(token_counts(docs))
    assert counts[1].n_tokens == counts[2].n_tokens > N and counts[4].n_tokens > 1000
    pieces = pack(docs)
    total = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert total[1] == total[2] > N and pieces.filter("length > 1024").count() == 0


def test_scores(long_texts):
    docs, labels = long_texts
    assert len(by_id(toxicity(docs, labels))) == len(by_id(quality_classifier(docs, labels))) == 6


def test_turns(spark, long_texts):
    docs, _ = long_texts
    text = docs.filter("doc_id = 1").first().text
    turns = spark.createDataFrame([(1, 0, "user", "</s>" + text), (1, 1, "assistant", text + "[INST]")], "conv_id long, turn int, role string, text string")
    r = chat.digests(chat.format_conversations(turns)).first()
    assert r.n_turns == 2 and r.loss_chars == len(text) + 6 and queries.QUERIES["op6_chat"]
