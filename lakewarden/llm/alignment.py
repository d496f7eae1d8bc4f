"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both tokenizers' tokens spell the same bytes. The transducer reads the token of
the side that is behind; its state is which side leads and the bytes it leads by. A step
hangs on the state and the next token's id alone, so steps are remembered by them. Where
nothing dangles both sides end together: a group closes, and its last two tokens
are linked.

Where neither tokenizer can join what stands before a lone space with what
follows, nothing dangles there whatever the texts are: byte-level BPE with the usual
pre-token pattern starts a pre-token at the space, and pieces hold U+2581 at their
start alone. So texts are cut there into units, and a worker remembers the
groups of a unit as one long step, for units of at most ``CACHE`` characters together. Other
tokenizer files are run over whole texts.

How often an id pair is linked is counted over the whole corpus. Pairs with at least one in ``HEAD``
of all links are at most ``HEAD`` and are sent to the tasks, which look up most links of a
text there; the rest, of which none is frequent, are joined with the
counts by Spark.

Defined results: null and empty texts, and those that either side does not spell
byte for byte (U+2581 itself in a text), have no tokens: zeros and an empty digest; repeated
rows are repeated and count each; ties for a piece's most frequent pair are all best; a very
long text is taken a portion of units at a time, its links held at 8 bytes each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PORTION, Scratch, arrow_rows, whole
from .packing import PATTERN, _byte_letters, byte_ranks

CACHE, MEMO, BATCH_UNITS, HEAD, MARK = 1 << 22, 1 << 20, 400_000, 100_000, "▁"
#: A lone space between two characters that are no white space to either tokenizer.
_CUT = re.compile(r" (?<=\S )(?=\S)")
_LOW = (1 << 32) - 1


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteSide:
    """Byte-level BPE: ids of ``" " + text`` and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        found = byte_ranks(spec)
        self.cuts = found is not None
        if found:
            import tiktoken

            one = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=found[0], special_tokens=found[1]).encode_ordinary
            self.encode = lambda texts: [one(" " + t) for t in texts]
            self.spelled = {i: token for token, i in found[0].items()}
        else:
            from tokenizers import Tokenizer

            tool, letters = Tokenizer.from_file(path), _byte_letters()
            tool.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in tool.encode_batch([" " + t for t in texts], add_special_tokens=False)]
            self.spelled = {i: bytes(letters[c] for c in token) for token, i in tool.get_vocab().items() if all(c in letters for c in token)}


class PieceSide:
    """SentencePiece, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [tool.id_to_piece(i) for i in range(tool.get_piece_size())]
        self.size = len(pieces)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.encode = lambda texts: tool.encode(texts, num_threads=1)
        self.spelled = {i: bytes([int(p[3:5], 16)]) if tool.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}


class Transducer:
    """Steps by (state, id of the next token of the side behind), remembered; state 0 is the empty residual."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.spelled = (a, b)
        self.clear()

    def clear(self) -> None:
        #: (the side to read, what the other one leads by)
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.number: dict[tuple[int, bytes], int] = {self.states[0]: 0}
        self.reads = [0]
        self.memo: dict[tuple[int, int], int] = {}

    def _step(self, state: int, token: int) -> int:
        """The next state; -1 where the bytes differ."""
        side, ahead = self.states[state]
        spelled = self.spelled[side].get(token, b"")
        if not spelled:
            return -1
        if ahead.startswith(spelled):
            after = (side, ahead[len(spelled) :])
        elif spelled.startswith(ahead):
            after = (1 - side, spelled[len(ahead) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
            self.reads.append(after[0])
        return self.number[after]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """The ends (in ``a``, in ``b``) of the groups, or None if the bytes differ."""
        if len(self.memo) > MEMO:
            self.clear()
        memo, reads, out, state, i, j = self.memo, self.reads, [], 0, 0, 0
        n, m = len(a), len(b)
        while True:
            if reads[state]:
                if j == m:
                    return None
                token, j = b[j], j + 1
            else:
                if i == n:
                    return out if state == 0 and j == m else None
                token, i = a[i], i + 1
            after = memo.get((state, token))
            if after is None:
                after = memo[state, token] = self._step(state, token)
            if after == 0:
                out.append((i, j))
            elif after < 0:
                return None
            state = after


class Aligner:
    """Units numbered as they are met, with their counts, groups and links."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteSide(byte_level), PieceSide(pieces)
        self.cuts = self.a.cuts and self.b.cuts
        self.transducer = Transducer(self.a.spelled, self.b.spelled)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.said: list[str] = []
        #: Per unit: a, b, groups (-1: not spelled alike), and where its links begin.
        self.counts = np.zeros((0, 4), np.int64)
        self.links = np.zeros(0, np.int64)
        self.held = 0

    def learn(self, units: list[str]) -> None:
        new = list(set(units).difference(self.index))
        counts: list[tuple[int, int, int, int]] = []
        links: list[int] = []
        for unit, a, b in zip(new, self.a.encode(new), self.b.encode(new)):
            ends = self.transducer.groups(a, b)
            self.index[unit] = len(self.said)
            self.held += len(unit)
            if ends is None:
                self.said.append("")
                counts.append((0, 0, -1, 0))
                continue
            counts.append((len(a), len(b), len(ends), len(self.links) + len(links)))
            parts, i, j = [], 0, 0
            for p, q in ends:
                parts.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                links.append(a[p - 1] << 32 | b[q - 1])
                i, j = p, q
            self.said.append(";".join(parts))
        if new:
            self.counts = np.concatenate((self.counts, np.array(counts, np.int64)))
            self.links = np.concatenate((self.links, np.array(links, np.int64)))

    def portions(self, text: str) -> Iterator[list[str]]:
        if not self.cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            found = _CUT.search(text, at + PORTION) if at + PORTION < len(text) else None
            yield _CUT.split(text[at : found.start()] if found else text[at:])
            at = found.end() if found else len(text)

    def look_up(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of each unit its number, its counts (a, b, groups; -1 groups: not spelled alike), and all links in order."""
        if self.held > CACHE or not self.cuts:
            self.clear()
        self.learn(units)
        known = list(map(self.index.__getitem__, units))
        counts = self.counts[np.array(known, np.int64)]
        size = np.maximum(counts[:, 2], 0)
        spots = np.arange(size.sum()) + np.repeat(counts[:, 3] - np.cumsum(size) + size, size)
        return known, counts[:, :3], self.links[spots]

    def align(self, texts: list[str], with_groups: bool) -> Iterator[tuple]:
        """Per text: n_a, n_b, n_groups, digest, groups, distinct links and how often each."""
        held: list[str] = []
        parts: list[tuple[int, int]] = []
        sums = np.zeros((len(texts), 3), np.int64)
        good = [bool(t) for t in texts]
        digests = [hashlib.sha256() if t else None for t in texts]
        said: list[list[str]] = [[] for _ in texts]
        links: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        begun = [False] * len(texts)

        def settle() -> None:
            known, counts, pairs = self.look_up(held)
            at = 0
            distinct, code = np.unique(pairs, return_inverse=True)
            owner = np.repeat(np.repeat([p[0] for p in parts], [p[1] for p in parts]), np.maximum(counts[:, 2], 0))
            cells, times = np.unique(owner * len(distinct) + code, return_counts=True)
            whose = cells // max(len(distinct), 1)
            for i, n in parts:
                mine = counts[at : at + n]
                if (mine[:, 2] < 0).any():
                    good[i] = False
                if good[i]:
                    sums[i] += mine.sum(0)
                    text = ";".join(map(self.said.__getitem__, known[at : at + n]))
                    digests[i].update((";" + text if begun[i] else text).encode())
                    begun[i] = True
                    if with_groups:
                        said[i].append(text)
                    a, b = np.searchsorted(whose, [i, i + 1])
                    links[i].append((distinct[cells[a:b] - i * len(distinct)], times[a:b]))
                at += n

        for i, text in enumerate(texts):
            for units in self.portions(text) if text else ():
                if parts and parts[-1][0] == i or len(held) + len(units) > BATCH_UNITS and held:
                    settle()
                    held, parts = [], []
                held += units
                parts.append((i, len(units)))
        if held:
            settle()
        empty = np.zeros(0, np.int64)
        for i in range(len(texts)):
            if good[i]:
                pairs, times = (np.concatenate(x) for x in zip(*links[i])) if links[i] else (empty, empty)
                yield (*sums[i].tolist(), digests[i].hexdigest(), ";".join(said[i]) if with_groups else None, pairs, times)
            else:
                yield (0, 0, 0, "", "" if with_groups else None, empty, empty)


class Alignment(NamedTuple):
    #: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null unless asked for)
    documents: DataFrame
    #: pair (a id << 32 | b id), n (links corpus-wide), best (no pair with the same b id has more)
    pairs: DataFrame


_aligners: dict[tuple[str, str], Aligner] = {}


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _aligned(paths: tuple[str, str], with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _aligners:
            _aligners[paths] = Aligner(*paths)
        for batch in batches:
            rows = list(zip(*_aligners[paths].align(batch.column(2).to_pylist(), with_groups)))
            if rows:
                counts = [pa.array(rows[k], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *counts, pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string()), _lists(list(rows[5]), pa.int64()), _lists(list(rows[6]), pa.int64())],
                    ["rid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "pairs", "times"],
                )

    return run


def _looked_up(head):
    """Sums over the links that the head holds, and the other links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, many, best = head.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            spot = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            hit = known[spot] == pairs
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], owner[hit], times[hit] * best[spot[hit]])
            np.add.at(sums[1], owner[hit], times[hit] * many[spot[hit]])
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows)))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *rest], ["rid", "best_head", "sum_head", "pairs", "times"])

    return run


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, with_groups: bool = False, head: int = HEAD) -> Alignment:
    """Align every text's tokens; ``tokenizers`` are a byte-level BPE file (A) and a SentencePiece model (B)."""
    spark, paths = docs.sparkSession, tokenizers or default_tokenizers()
    scratch = Scratch(spark, "alignment")
    arrow_rows(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", whole("text").alias("text"))
    schema = f"rid bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<bigint>"
    found = scratch.keep(rows.mapInArrow(_aligned(paths, with_groups), schema))

    def links(of: DataFrame) -> DataFrame:
        return of.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", "l.pairs", "l.times").withColumnRenamed("pairs", "pair")

    counts = scratch.keep(links(found).groupBy("pair").agg(F.sum("times").alias("n")))
    piece = F.col("pair").bitwiseAND(_LOW)
    most = counts.groupBy(piece.alias("piece")).agg(F.max("n").alias("most"))
    # At most one row per piece of the vocabulary is broadcast.
    pairs = scratch.keep(counts.join(F.broadcast(most), piece == F.col("piece")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    # Each of these pairs has one in ``head`` of all links, so there are at most ``head``.
    top = pairs.filter(F.col("n") * head >= total).toPandas().sort_values("pair")
    table = (top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)) if len(top) else (np.array([-1]), np.zeros(1, np.int64), np.zeros(1, np.int64))
    sent = spark.sparkContext.broadcast(table)
    scored = scratch.keep(found.select("rid", "pairs", "times").mapInArrow(_looked_up(sent), "rid bigint, best_head bigint, sum_head bigint, pairs array<bigint>, times array<bigint>"))
    rest = links(scored).join(pairs, "pair").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_rest"), F.sum(F.col("times") * F.col("n")).alias("sum_rest"))
    out = found.join(scored.select("rid", "best_head", "sum_head"), "rid").join(rest, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("best_head") + F.coalesce("best_rest", F.lit(0))).alias("n_best"), (F.col("sum_head") + F.coalesce("sum_rest", F.lit(0))).alias("count_sum"), "groups_sha256", "groups",
    )
    return Alignment(out, pairs)
