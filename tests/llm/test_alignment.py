from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

import lakewarden.llm.alignment as m
from lakewarden.llm.alignment import Aligner, Transducer, align, default_tokenizers
from lakewarden.llm.packing import _byte_letters

A_PATH, B_PATH = default_tokenizers()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain(texts, libraries):
    """By the libraries on whole texts: the ids, the byte offsets where both end, the links."""
    a_tool, b_tool = libraries
    letters = _byte_letters()
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
        sides = ([bytes(letters[c] for c in a_tool.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_tool.id_to_piece, b))])
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            rows.append(None)
            continue
        ends = []
        for side in sides:
            at, of = 0, {}
            for k, token in enumerate(side):
                at += len(token)
                of[at] = k
            ends.append(of)
        groups, links, i, j = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][at] + 1, ends[1][at] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        rows.append((len(a), len(b), groups, links))
    counts = Counter(x for r in rows if r for x in r[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def result(docs, **options):
    rows = align(docs, **options).documents.collect()
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


def odd_texts():
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "the", "don't", "'s", "1234", "é", "日本", "\U0001f600", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", "ſ", "ﬁ", "!!", "é", "​", "\x00", "Ａ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    return texts + ["", None, " ", "\n", "a", " a", "a ", "▁", "a ▁ b", "x" * 3000, "the cat sat on the mat " * 50]


@pytest.mark.parametrize("small", [False, True])
def test_equals_the_libraries(spark, documents, libraries, monkeypatch, small):
    if small:  # portions, caches and the head of the pairs change nothing
        for name in ("PORTION", "CACHE", "MEMO", "BATCH_UNITS"):
            monkeypatch.setattr(m, name, 20)
    texts = odd_texts()
    if small:
        aligner, rows = Aligner(A_PATH, B_PATH), plain(texts, libraries)
        for (*got, said, links, times), want in zip(aligner.align(texts, True), rows):
            assert (got[0], got[1], got[2], int(times.sum()), got[3]) == (*want[:4], want[6]) and (not want[6] or hashlib.sha256(said.encode()).hexdigest() == want[6])
        return
    want = dict(enumerate(plain(texts, libraries)))
    docs = documents([(i, t, "s") for i, t in enumerate(texts)])
    assert result(docs) == want
    assert result(docs, head=20) == want and result(docs, head=1) == want


def test_the_query_on_given_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert result(docs) == {r.doc_id: x for r, x in zip(rows, plain([r.text for r in rows], libraries))}


def test_pairs_and_groups(documents):
    found = align(documents([(1, "the cat", "s"), (2, "the dog", "s"), (2, "the dog", "s"), (3, None, "s")]), with_groups=True)
    counts = [r.n for r in found.pairs.collect()]
    assert max(counts) == 3 and all(r.best for r in found.pairs.collect())
    for r in found.documents.collect():
        assert len(r.groups.split(";")) == r.n_groups if r.n_groups else r.groups == ""


def test_steps():
    t = Transducer({1: b"ab", 2: b"c", 3: b"a"}, {1: b"a", 2: b"bc", 3: b"ab", 4: b"c", 5: b"x"})
    assert t.groups([1, 2], [1, 2]) == [(2, 2)] and t.groups([1, 2], [3, 4]) == [(1, 1), (2, 2)]
    assert t.groups([1, 2], [3]) is None and t.groups([1], [3, 4]) is None and t.groups([1], [5]) is None and t.groups([], []) == []
    assert len(t.memo) < 12


def test_files_that_do_not_cut_are_run_whole(documents, libraries, monkeypatch):
    texts = odd_texts()[:60] + ["many words in a row  here"]
    aligner = Aligner(A_PATH, B_PATH)
    aligner.cuts = False
    for (*got, _, _, _), want in zip(aligner.align(texts, False), plain(texts, libraries)):
        assert (got[0], got[1], got[2], got[3]) == (*want[:3], want[6])


def test_awkward(awkward, nothing):
    got = align(awkward).documents.collect()
    assert len(got) == awkward.count()
    assert {(r.n_a, r.groups_sha256) for r in got if r.doc_id in (3, 4)} == {(0, "")}
    assert align(nothing).documents.count() == 0


def test_long_texts(documents):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    rows = {r.doc_id: r for r in align(documents([(1, text, "s"), (2, text + " end", "s"), (3, "x" * 500_000, "s"), (4, "日本" * 100_000, "t"), (5, "a few words", "s")])).documents.collect()}
    assert rows[1].n_links > 400_000 and rows[2].n_a == rows[1].n_a + 1 and rows[3].n_groups > 0 and rows[4].n_b > 0
