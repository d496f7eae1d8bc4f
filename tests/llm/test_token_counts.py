from __future__ import annotations

import random

import sentencepiece
from tokenizers import Tokenizer, models

from lakewarden.llm.token_counts import MARK, UnigramCounter, default_vocabulary, load_vocabulary, token_counts


def reference(vocabulary):
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def test_equals_the_library_on_the_public_vocabulary():
    model = sentencepiece.SentencePieceProcessor(model_file=default_vocabulary())
    plain = reference([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])
    counter = UnigramCounter(load_vocabulary(default_vocabulary()))
    assert counter.by_word
    rng = random.Random(1)
    texts = ["日本語 漢字 \U0001f600\U0001f600 a", "   lead", "trail   ", "a  b   c", "\t\n x", "é́ ǆ", "ﷺ" * 3, "▁x▁", "᎐᎑Ꮳx"] + ["".join(rng.choice("abcde ▁é日\n1") for _ in range(40)) for _ in range(300)]
    for t in texts:
        marked = MARK + t.replace(" ", MARK)
        n = len(plain.encode(marked, add_special_tokens=False).ids)
        assert counter.count(t) == counter.viterbi(marked) == n, t


def test_ties_go_as_in_the_library():
    rng = random.Random(2)
    for _ in range(40):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(9)} - {"a"}
        vocabulary = [("<unk>", 0.0), *((p, -float(rng.randrange(3))) for p in sorted(pieces))]
        plain = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
        counter = UnigramCounter([("", 0.0), *vocabulary[1:]], byte_fallback=False)
        for _ in range(20):
            t = "".join(rng.choice("abc") for _ in range(12))
            assert counter.viterbi(t) == len(plain.encode(t, add_special_tokens=False).ids), (vocabulary, t)


def test_portions_and_long_words_change_nothing(monkeypatch):
    import lakewarden.llm.token_counts as m

    rng = random.Random(3)
    counter = UnigramCounter(load_vocabulary(default_vocabulary()))
    texts = ["".join(rng.choice("abcde   é日1") for _ in range(600)) for _ in range(20)] + ["x" * 700 + " y " + "日本" * 400, " " * 90 + "a" + " " * 90]
    want = [counter.viterbi(MARK + t.replace(" ", MARK)) for t in texts]
    monkeypatch.setattr(m, "PORTION", 50)
    monkeypatch.setattr(m, "LONG", 5)
    monkeypatch.setattr(m, "CACHE", 40)
    counter.known.clear()
    assert [counter.count(t) for t in texts] == want


def test_a_long_word_needs_little_memory():
    import tracemalloc

    counter = UnigramCounter(load_vocabulary(default_vocabulary()))
    word = "日本語漢字かな" * 30_000
    tracemalloc.start()
    assert counter.count(word) > 30_000
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()


def test_query(awkward, nothing):
    got = token_counts(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert token_counts(nothing).count() == 0
