"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenised whole and those over the capacity cut into pieces. The
pieces are dealt into groups of about ``GROUP``; each group is packed by
best-fit decreasing, and lower bounds from dual-feasible functions (the volume,
the Martello-Toth family and the Fekete-Schepers family) certify its number of
bins. A group with a gap between bins and bound gives up the pieces of all bins
that are not full; those are exchanged, dealt into new groups (two at least) and
packed again. A turn that saves no bin is taken back and tried with another
dealing, until no group has a gap or ``PATIENCE`` turns on end have saved nothing. So
a turn never adds a bin, and a group holds about ``GROUP`` pieces of
whatever source, also where many pieces are equal. The result says of each piece
how many bins its group has beyond its bound (0: certified), and ``certificate``
holds the whole against the bound over all pieces.

Tokenising: where the tokenizer file is plain byte-level BPE whose merges stand in
the order of their ids, its ranks are loaded into the faster of the two installed
BPE encoders, which then gives the same ids; any other file is run by the
tokenizers library itself. Texts are encoded one by one, without a cache.

Defined results: null text counts as empty and gives one piece with the end
token alone; equal lengths are ordered by doc_id, piece and checksum; repeated
rows are packed once each; a very long text is encoded at once, in memory that
grows with it; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, whole

CAPACITY, END_ID, GROUP, PATIENCE = 1024, 2, 8192, 3
#: The pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens of a tokenizer file, or None if ranks alone do not tell its ids."""
    model, pre, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or normal or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    added = spec.get("added_tokens") or []
    if merged != sorted(merged) or model.get("dropout") or model.get("ignore_merges") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}, special


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            found = byte_ranks(json.load(f))
        if found:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=found[0], special_tokens=found[1])
        else:
            from tokenizers import Tokenizer

            self.fast, self.tokenizer = None, Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes() for t in texts]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; the first piece takes the odd length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(tokenizer, None) or Encoder(tokenizer)
        _encoders[tokenizer] = encoder
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += tail
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1 if start == 0 else capacity)
                    rows.append((piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    owner.append(i)
                    start, piece = stop, piece + 1
            cols = list(zip(*rows)) or [(), (), (), ()]
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, many_of: np.ndarray | None = None) -> int:
    """Bins that any packing needs, by dual-feasible functions of the lengths; ``many_of`` says how many pieces have each."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    if many_of is not None:
        count[lengths] = many_of
    mass = count * np.arange(capacity + 1)
    best = -(-int(mass.sum()) // capacity)
    many, heavy = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(mass)))
    for low in range(1, capacity // 2 + 1):  # over capacity - low: a bin each; under low: nothing
        big = int(many[-1] - many[capacity - low + 1])
        mid = int(heavy[capacity - low + 1] - heavy[low])
        best = max(best, big + -(-mid // capacity))
    sizes = np.arange(capacity + 1)
    for k in range(1, 24):
        exact = (k + 1) * sizes % capacity == 0
        total = int((count * np.where(exact, sizes * k, (k + 1) * sizes // capacity * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, which must fall, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offsets, room


def _pack_group(turn: int, capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "rid"], ascending=[False, True, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        first = (turn << 56) | (int(rows["part"].iloc[0]) << 24)
        return rows.assign(sequence_id=first + bins, offset=offsets, gap=gap, loose=(np.array(room)[bins] > 0) & (gap > 0))

    return run


def pack_pieces(found: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id, offset and gap to ``found`` (doc_id, piece, start, length, ids_crc32)."""
    found = scratch.keep(found.withColumn("rid", F.monotonically_increasing_id()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", part bigint, sequence_id bigint, offset bigint, gap bigint, loose boolean"

    def packed(rows: DataFrame, groups: int, turn: int) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(turn), "rid"), F.lit(groups))
        return scratch.keep(rows.withColumn("part", part).groupBy("part").applyInPandas(_pack_group(turn, capacity), schema))

    state, settled, turn, barren = packed(found, max(1, -(-found.count() // GROUP)), 0), [], 0, 0
    while barren < PATIENCE:
        loose = state.filter("loose")
        n, bins = loose.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if bins <= 1:
            break
        turn += 1
        again = packed(loose.select(found.columns), max(2, -(-n // GROUP)), turn)
        if again.agg(F.countDistinct("sequence_id")).first()[0] < bins:
            settled.append(state.filter("not loose"))
            state, barren = again, 0
        else:
            scratch.drop(again)
            barren += 1
    for more in settled:
        state = state.union(more)
    return state.drop("part", "loose", "rid")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """The number of sequences, and the least number that any packing of all the pieces needs."""
    per = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length, so at most ``capacity``
    lengths, many = (np.array([r[c] for r in per], np.int64) for c in ("length", "n"))
    return packed.select("sequence_id").distinct().count(), lower_bound(lengths, capacity, many)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack_pieces(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id), scratch, capacity)
