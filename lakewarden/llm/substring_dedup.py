"""Repeated passages by recompression.

Rounds over each document's words name runs of equal symbols and then pairs (a
symbol's name decides whether it may only open or only close a pair, so pairs
never overlap). A name is a 64-bit hash of what it stands for, so it is the same
all over the corpus without a dictionary to share; equal stretches of text get
equal symbols but for their borders. With each symbol goes the stretch of words
that its being there depends on. Of the symbols that depend on a window's words
alone, the window takes the one with the least name as its anchor: equal
windows, wherever they are, take the same anchor.

Spark rounds then compare what the corpus shares:

1. anchors found in one document only are put aside;
2. consecutive windows with one anchor form a run; a run whose words also occur
   in a smaller document is repeated, all its windows at once;
3. of the runs left over, those whose anchor other documents still share are
   compared window by window.

Names only bring passages together; what is removed is decided by 128 bits of all the
words of a run or window: two lanes that share nothing, each built from its own 64-bit hash of
every word. Sums are combined before every shuffle, so a passage in a third of all documents is
one row per task, and its rows meet that sum in many tasks (``hub_join``). Documents travel to their ranges as zstandard blocks, written
once.

A very long text is cut into portions that overlap by a window less one word. An
anchor depends on its window's words alone, so portions change no anchor; a run
that a border cuts is compared window by window.

Defined results: null text has no words; documents of fewer than ``WINDOW``
words lose none; a null doc_id counts as smaller than any; rows with the same
doc_id are not smaller than each other; doc_ids that are no whole numbers are
compared by their order; repeated rows are repeated; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_rows, hub_join, placed, whole, word_blocks

WINDOW, ROUNDS, BATCH_WORDS = 50, 4, 400_000
_FAR = np.int64(1) << np.int64(40)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S32, _S29 = np.uint64(32), np.uint64(29)
_NULL_ID = -(1 << 63)


def combine(a: np.ndarray, b: np.ndarray | np.uint64, salt: int) -> np.ndarray:
    """A 64-bit hash of ordered pairs."""
    x = a * _K1 + np.atleast_1d((b ^ (b >> _S29))) * _K2 + np.uint64((salt * 0x2545F4914F6CDD1D + 0x1B873593) & (2**64 - 1))
    x ^= x >> _S32
    x *= _K3
    x ^= x >> _S29
    x *= _K1
    return x ^ (x >> _S32)


def _edges(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each entry is the first, and the last, of its document."""
    change = doc[1:] != doc[:-1]
    return np.concatenate(([True], change)), np.concatenate((change, [True]))


def _reach(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the entries before and after depend on; beyond all bounds at a document's ends."""
    first, last = _edges(doc)
    before_lo, before_hi = np.roll(lo, 1), np.roll(hi, 1)
    after_lo, after_hi = np.roll(lo, -1), np.roll(hi, -1)
    before_lo[first], before_hi[first] = -_FAR, -_FAR
    after_lo[last], after_hi[last] = _FAR, _FAR
    return before_lo, before_hi, after_lo, after_hi


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols, and the first and last word each depends on."""
    name, lo, hi = words, np.arange(len(words), dtype=np.int64), np.arange(len(words), dtype=np.int64)
    for r in range(rounds):
        # Runs of one symbol; that a run ends there depends on its neighbours.
        b_lo, b_hi, a_lo, a_hi = _reach(lo, hi, doc)
        new = np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(name)))
        last = first + length - 1
        lo = np.minimum(np.minimum.reduceat(lo, first), np.minimum(b_lo[first], a_lo[last]))
        hi = np.maximum(np.maximum.reduceat(hi, first), np.maximum(b_hi[first], a_hi[last]))
        name, doc = name[first], doc[first]
        long = length > 1
        if long.any():
            name = name.copy()
            name[long] = combine(name[long], length[long].astype(np.uint64), 2 * r + 1)
        # Pairs of an opening and a closing symbol; a lone one depends on the neighbour it might have joined.
        opens = (combine(name, np.uint64(r + 1), 7) >> np.uint64(63)) == 0
        b_lo, b_hi, a_lo, a_hi = _reach(lo, hi, doc)
        joins = np.concatenate((opens[:-1] & ~opens[1:] & (doc[1:] == doc[:-1]), [False]))
        kept = ~np.concatenate(([False], joins[:-1]))
        after = joins | opens
        lo, hi = np.minimum(lo, np.where(after, a_lo, b_lo)), np.maximum(hi, np.where(after, a_hi, b_hi))
        name = np.where(joins, combine(name, np.roll(name, -1), 2 * r + 2), name)[kept]
        lo, hi, doc = lo[kept], hi[kept], doc[kept]
    return name, lo, hi


def window_hashes(lanes: tuple[np.ndarray, np.ndarray], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per lane of the ``size`` words from each place, by doubling; past the end they mean nothing."""
    out = []
    for lane, words in enumerate(lanes, 1):
        power, width = combine(words, np.uint64(lane), lane), 1
        total, done = None, 0
        while True:
            if size & width:
                part = power if done == 0 else np.roll(power, -done)
                total = part if total is None else combine(total, part, 16 * lane + width)
                done += width
            if width * 2 > size:
                break
            power = combine(power, np.roll(power, -width), 1024 * lane + width)
            width *= 2
        out.append(total)
    return out[0], out[1]


def runs(lanes: tuple[np.ndarray, np.ndarray], doc: np.ndarray, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash of all words by each lane) of the runs; windows by place in the text."""
    words = lanes[0]
    n = len(words)
    first, last = _edges(doc)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    stop = np.minimum.accumulate(np.where(last, np.arange(n) + 1, n)[::-1])[::-1]
    valid = np.arange(n) + size <= stop
    if not valid.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    name, lo, hi = parse(words, doc, rounds)
    inside = (lo >= 0) & (hi < n) & (hi - lo < size)
    name, lo, hi = name[inside], lo[inside], hi[inside]
    low, high = np.maximum(hi - size + 1, begin[lo]), np.minimum(lo, stop[lo] - size)
    fits = high >= low
    name, low, high = name[fits], low[fits], high[fits]
    rank = combine(name, np.uint64(5), 9)
    # In falling order, so that the least rank, and of equal ones the leftmost, is written last.
    order = np.lexsort((low, rank))[::-1]
    low, high, by = low[order], high[order], order
    count = high - low + 1
    spots = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    best = np.full(n, -1, np.int64)
    best[spots] = np.repeat(by, count)
    at = np.flatnonzero(valid)
    chosen = best[at]
    w1, w2 = window_hashes(lanes, size)
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (chosen[1:] != chosen[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (chosen[1:] < 0)))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    p1, p2, anchor = at[head], at[tail], chosen[head]
    symbol = np.where(anchor >= 0, name[anchor] if len(name) else np.uint64(0), combine(w1[p1], np.uint64(3), 11))
    # All windows of a run hold its anchor, so the first and the last one overlap: they and their distance tell all words.
    more = (p2 - p1).astype(np.uint64)
    return p1, p2, symbol, combine(w1[p1], w1[p2], 21) + more * _K2, combine(w2[p1], w2[p2], 22) + more * _K2


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two unrelated 64-bit hashes of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _portions(texts: Iterable[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words of about ``BATCH_WORDS`` at a time, with (place of the text, first word there, words) of each stretch.

    The stretches of a long text overlap by ``WINDOW - 1`` words, so each window is in one of them just once.
    """
    held: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        at, begin = 0, len(held)
        for words in word_blocks(text):
            held += words
            if len(held) >= BATCH_WORDS:
                parts.append((i, at, len(held) - begin))
                yield held, parts
                tail = held[max(begin, len(held) - WINDOW + 1) :]
                at += len(held) - begin - len(tail)
                held, parts, begin = list(tail), [], 0
        parts.append((i, at, len(held) - begin))
    if held:
        yield held, parts


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        rids, ids = batch.column(0), batch.column(1)
        for words, parts in _portions(tool.decompress(b.as_py()) for b in batch.column(2)):
            place, offset, size = (np.array(c, np.int64) for c in zip(*parts))
            begin = np.cumsum(size) - size
            p1, p2, symbol, span1, span2 = runs(_hashed(words), np.repeat(np.arange(len(size)), size))
            owner = np.searchsorted(begin, p1, side="right") - 1
            at = pa.array(place[owner])
            p = p1 - begin[owner] + offset[owner]
            yield pa.RecordBatch.from_arrays(
                [rids.take(at), ids.take(at), pa.array(p.astype(np.int32)), pa.array((p2 - p1).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (symbol, span1, span2))],
                ["rid", "id", "p", "more", "symbol", "span1", "span2"],
            )


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [tool.compress(t.as_py()) for t in batch.column(3).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], ["rid", "id", "doc_id", "block"])


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs asked for: rid, id, p, w1, w2."""
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        asked = batch.column(3)
        flat = asked.flatten()
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        first = flat.field("p").to_numpy(zero_copy_only=False).astype(np.int64)
        last = first + flat.field("more").to_numpy(zero_copy_only=False)
        for words, parts in _portions(tool.decompress(b.as_py()) for b in batch.column(2)):
            w1, w2 = window_hashes(_hashed(words))
            spots, texts, places, begin = [], [], [], 0
            for i, offset, size in parts:
                mine = slice(*np.searchsorted(owner, [i, i + 1]))
                a, b = np.maximum(first[mine], offset), np.minimum(last[mine], offset + size - WINDOW)
                a, b = a[a <= b], b[a <= b]
                count = b - a + 1
                p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - a, count)
                spots.append(p - offset + begin)
                places.append(p)
                texts.append(np.full(len(p), i))
                begin += size
            spot, at = np.concatenate(spots), pa.array(np.concatenate(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(places).astype(np.int32)), pa.array(w1[spot].view(np.int64)), pa.array(w2[spot].view(np.int64))],
                ["rid", "id", "p", "w1", "w2"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for block, ranges in zip(batch.column(1), batch.column(2)):
            text = tool.decompress(block.as_py())
            gone = None
            if ranges.is_valid and len(ranges):
                p = ranges.values.field("p").to_numpy(zero_copy_only=False).astype(np.int64)
                stop = p + ranges.values.field("more").to_numpy(zero_copy_only=False) + WINDOW
                gone = np.zeros(int(stop.max()) + 1, np.int32)
                np.add.at(gone, p, 1)
                np.add.at(gone, stop, -1)
                gone = np.cumsum(gone) > 0
            n, parts, removed = 0, [], 0
            for words in word_blocks(text):
                stay = words
                if gone is not None and n < len(gone):
                    out = gone[n : n + len(words)]
                    free = np.flatnonzero(~out)
                    stay = [words[k] for k in free.tolist()] + words[len(out) :]
                n += len(words)
                removed += len(words) - len(stay)
                if stay:
                    parts.append(b" ".join(stay))
            n_words.append(n)
            n_removed.append(removed)
            kept.append(b" ".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose symbol is found in two documents or more."""
    many = rows.groupBy("symbol").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b")
    return hub_join(rows, scratch.keep(many.select("symbol", "n")), ["symbol"], "rid", "left_semi")


def _earlier(rows: DataFrame, by: list[str], scratch: Scratch, how: str = "left") -> DataFrame:
    """``rows`` with the smallest document that has the same key, if it has one in two documents."""
    least = rows.groupBy(*by).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    return hub_join(rows, scratch.keep(least.select(*by, "least", "n")), by, "rid", how)


def _ranges() -> Column:
    return F.collect_list(F.struct("p", "more")).alias("ranges")


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, id (a long in the order of doc_id, null first), doc_id, text."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", whole("text").alias("text"))
    if isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return rows.select("rid", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("id"), "doc_id", "text")
    order = scratch.keep(placed(docs.select(F.col("doc_id").alias("known")).dropna().distinct(), scratch, F.col("known")))
    return rows.join(order.hint("merge"), rows["doc_id"] == order["known"], "left").select("rid", F.coalesce("place", F.lit(_NULL_ID)).alias("id"), "doc_id", "text")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by a space)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    arrow_rows(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    squeezed = _numbered(docs, scratch).select("rid", "id", "doc_id", "text").mapInArrow(_squeezed, f"rid bigint, id bigint, doc_id {kind}, block binary")
    blocks = scratch.keep(squeezed)

    found = scratch.keep(blocks.select("rid", "id", "block").mapInArrow(_find_runs, "rid bigint, id bigint, p int, more int, symbol bigint, span1 bigint, span2 bigint"))
    met = scratch.keep(_shared(found, scratch))
    scratch.drop(found)
    judged = scratch.keep(_earlier(met, ["symbol", "span1", "span2"], scratch))
    scratch.drop(met)
    whole_runs = scratch.keep(judged.filter("least < id").select("rid", "p", "more"))
    open_ = scratch.keep(judged.filter("least is null or least >= id").select("symbol", "rid", "id", "p", "more"))
    scratch.drop(judged)
    left = scratch.keep(_shared(open_, scratch).groupBy("rid").agg(_ranges()))
    scratch.drop(open_)
    # Hashed twice, for the sums and for the join, as a table of all windows would outgrow the text.
    windows = blocks.select("rid", "id", "block").join(left, "rid").select("rid", "id", "block", "ranges").mapInArrow(_find_windows, "rid bigint, id bigint, p int, w1 bigint, w2 bigint")
    single = _earlier(windows, ["w1", "w2"], scratch, "inner").filter("least < id").select("rid", "p", F.lit(0).alias("more"))
    ranges = scratch.keep(whole_runs.union(single).groupBy("rid").agg(_ranges()))
    scratch.drop(whole_runs, left)
    return blocks.join(ranges, "rid", "left").select("doc_id", "block", "ranges").mapInArrow(_cut_out, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
