from __future__ import annotations

import re
from collections import Counter

import pytest

from lakewarden.llm.quality_rules import host_rates, quality_rules


def brute(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    "a b c d e f a b c d e g", "x " * 40, "one\none\n \n\ntwo\none", "# * $ % & | < >\x0b\x0c\r end", None, "", "é\U0001f600 \x1f y", "a b c d", "p q r s t " * 3 + "u v w p q r s t",
    " ".join(str(i % 37) for i in range(900)), "w " * 9, " ".join(f"k{i}" for i in range(50)),
]


def test_counts_equal_brute_force(documents):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None), (0, TEXTS[0], "s0")]
    got = quality_rules(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[0] if r.doc_id is None else TEXTS[r.doc_id]
        n, chars, symbols, dup, rep = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.kept and r.base_failed)


def test_mixed_hashes_are_sorted_again(documents, monkeypatch):
    """With hashes that say little, windows that differ meet; the words then decide."""
    import lakewarden.llm.quality_rules as q

    real = q.F.xxhash64
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: q.F.pmod(real(*c), q.F.lit(3)) * 2**40)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules(documents(rows)).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(TEXTS)}


def test_bad_host_fails_and_small_hosts_shrink(spark):
    rows = [("bad", True)] * 95 + [("bad", False)] * 5 + [(f"h{k}", False) for k in range(20) for _ in range(30)] + [("tiny", True)]
    rates = {r.source: r.rate for r in host_rates(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert rates["bad"] > 0.8 and rates["h1"] < 0.1
    assert sum(f for _, f in rows) / len(rows) < rates["tiny"] < 0.9


def test_verdicts_are_joined_back(documents):
    good = " ".join(f"k{i}" for i in range(30))
    rows = [(i, "w " * 30, "bad") for i in range(60)] + [(60 + i, good, "bad") for i in range(3)] + [(100 + i, good, f"g{i % 9}") for i in range(90)]
    kept = {r.doc_id for r in quality_rules(documents(rows)).filter("kept").collect()}
    assert kept == set(range(100, 190))


def test_native_plan_and_empty(documents, nothing):
    out = quality_rules(documents([(1, "a b", "s")]))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert quality_rules(nothing).count() == 0


@pytest.mark.parametrize("n", [5, 6, 9])
def test_short_texts(documents, n):
    text = " ".join("ab"[i % 2] for i in range(n))
    assert quality_rules(documents([(1, text, "s")])).first().n_repeat_words == brute(text)[4]
