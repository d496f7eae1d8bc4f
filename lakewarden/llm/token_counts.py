"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary entries that end at each
character; dynamic programming keeps, per character, the best score and the
number of pieces on the best path, no path itself, and of these only as many as the
longest entry reaches back. The tie rules are those of
the unigram tokenizer of the installed libraries: a candidate replaces the best
path to a place only if it scores strictly more, and candidates come by rising
start, so the longest last piece wins a tie. A place that no entry of one
character starts at may be crossed as unknown at the least score less 10;
adjacent unknowns are fused and written out as their UTF-8 bytes if the
vocabulary has all byte entries.

White space is the vocabulary's own (U+2581 for a space, one put in front). If
no entry holds U+2581 after another character, best paths never cross from a
word to the next, so words are counted on their own and each worker keeps the
counts of distinct words of at most ``CACHE`` characters together; otherwise texts are counted whole.

Defined results: null text counts as empty, and an empty text has no tokens;
repeated rows are repeated; a very long text is taken a portion of whole words at a
time, and a very long word in the memory of the longest entry; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PORTION, arrow_rows, whole

CACHE, LONG, UNKNOWN_PENALTY, MARK = 1 << 22, 256, 10.0, "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model; control, unknown and byte entries match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [("" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.reach = max((len(p) for p, _ in vocabulary), default=1) + 1
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        self.known: dict[str, int] = {}
        self.held = 0
        self._word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")

    def _ends(self, text: str) -> Iterator[list[tuple[int, float]]]:
        """The entries that end after each character, as (length, score), longest first."""
        at, found = 0, []
        for last, entry in self.automaton.iter(text):
            while at < last:
                yield found
                at, found = at + 1, []
            found.append(entry)
            found.sort(reverse=True)
        while at < len(text):
            yield found
            at, found = at + 1, []

    def viterbi(self, text: str) -> int:
        """Pieces of the best path over the whole of ``text``."""
        reach = self.reach
        best, pieces = [0.0] * reach, [0] * reach
        #: Whether the best path to a place ends in an unknown run.
        run = [False] * reach
        for end, entries in enumerate(self._ends(text), 1):
            top, length, known = None, 1, True
            for size, score in entries:
                total = best[(end - size) % reach] + score
                if top is None or total > top:
                    top, length = total, size
            if text[end - 1] not in self.single:
                total = best[(end - 1) % reach] + self.unknown
                if top is None or total > top:
                    top, length, known = total, 1, False
            at, start = end % reach, (end - length) % reach
            if known:
                count = pieces[start] + 1
            elif self.byte_fallback:
                count = pieces[start] + len(text[end - 1].encode())
            else:
                count = pieces[start] + (0 if run[start] else 1)
            best[at], pieces[at], run[at] = top, count, not known
        return pieces[len(text) % reach]

    def _count_words(self, text: str) -> int:
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        words, known, long = self._word.findall(text), self.known, 0
        for word in set(words).difference(known):
            if len(word) <= LONG:
                known[word] = self.viterbi(word)
                self.held += len(word)
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        for word in words:
            long += known[word] if word in known else self.viterbi(word)
        return long

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.viterbi(text)
        total, at = 0, 0
        while at < len(text):
            # Cut before a word: where a mark follows another character.
            end = at + PORTION
            while end < len(text) and not (text[end] == MARK and text[end - 1] != MARK):
                end = text.find(MARK, end + 1)
                end = len(text) if end < 0 else end
            total += self._count_words(text[at:end])
            at = end
        return total


_counters: dict[tuple[str, bool], UnigramCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, byte_fallback) not in _counters:
            _counters[path, byte_fallback] = UnigramCounter(load_vocabulary(path), byte_fallback)
        counter = _counters[path, byte_fallback]
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
