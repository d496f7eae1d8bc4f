"""Checks on streams that need other records: duplicates, the next record, counts per window.

State is kept per key by Spark, in the checkpoint that the query names; it survives lost executors with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


#: Keys share this many states; one call of Python takes all rows of a state, so calls do not grow with the keys.
STATES = 1 << 13
#: Rows that are remembered are kept as text that reads back as it was.
_AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _text(stream: DataFrame, columns: list[str]) -> Column:
    # Adding zero makes one of the two zeros, which are equal as keys.
    cells = (F.col(c) + F.lit(0).cast(kind) if (kind := stream.schema[c].dataType.simpleString()) in ("float", "double") else F.col(c) for c in columns)
    return F.to_json(F.struct(*(x.alias(f"c{i}") for i, x in enumerate(cells))), _AS_TEXT)


def _read(stream: DataFrame, columns: list[str], text: str) -> Column:
    return F.from_json(text, ", ".join(f"c{i} {stream.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)), _AS_TEXT)


def duplicates(stream: DataFrame, by: list[str], keys: list[str], time: str | None = None, late: str = "1 hour", horizon_ms: int | None = None, states: int = STATES) -> DataFrame:
    """``keys`` (and ``by``) of all rows whose ``by`` another row has, as ``is_not_unique_set`` finds them in a batch.

    The first row of a key waits in the state and is told when a second one comes; later ones are told at once. With
    a ``horizon_ms`` a key is forgotten that long (of the event time ``time``) after its last row; a row later than
    ``late`` is still compared with what is remembered. Without one, keys are kept for good.

    Keys are dealt by their hash to ``states`` states, each with all that is remembered of its keys: a state is read and
    written whole when one of its keys has a row. A checkpoint holds for one number of states.
    """
    rest = [c for c in dict.fromkeys(keys) if c not in by]
    rows = stream.withWatermark(time, late) if time else stream
    moment = F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(0).cast("bigint")
    rows = rows.select(_text(stream, by).alias("k"), (_text(stream, rest) if rest else F.lit("")).alias("v"), moment.alias("ms"), *([F.col(time).alias("t")] if time else []))  # t carries the watermark
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(states)))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Of each key: its first row until that is told, then nothing; and the moment of its last row.
        known: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        for batch in batches:
            told_k, told_v = [], []
            for k, v, ms in zip(batch["k"].tolist(), batch["v"].tolist(), batch["ms"].tolist()):
                ms = 0 if ms != ms else int(ms)  # rows without a time
                seen = known.get(k)
                if seen is None:
                    known[k] = [v, ms]
                    continue
                if seen[0] is not None:
                    told_k.append(k)
                    told_v.append(seen[0])
                    seen[0] = None
                told_k.append(k)
                told_v.append(v)
                seen[1] = max(seen[1], ms)
            if told_k:
                yield pd.DataFrame({"k": told_k, "v": told_v})
        if horizon_ms is not None:
            mark = state.getCurrentWatermarkMs()
            known = {k: x for k, x in known.items() if x[1] + horizon_ms >= mark}
            if not known:
                state.remove()
                return
        state.update((json.dumps(known, ensure_ascii=False, separators=(",", ":")),))
        if horizon_ms is not None:
            state.setTimeoutTimestamp(max(min(x[1] for x in known.values()) + horizon_ms, mark + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if horizon_ms is not None else GroupStateTimeout.NoTimeout
    found = rows.groupBy("b").applyInPandasWithState(run, "k string, v string", "known string", "append", timeout)
    cells = found.select(_read(stream, by, "k").alias("k"), (_read(stream, rest, "v") if rest else F.lit(None)).alias("v"))
    shown = [F.col(f"k.c{by.index(c)}") if c in by else F.col(f"v.c{rest.index(c)}") for c in dict.fromkeys([*by, *keys])]
    return cells.select(*(x.alias(c) for x, c in zip(shown, dict.fromkeys([*by, *keys]))))


def without_next(stream: DataFrame, target: str, value: str, within: str, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """``within`` and ``keys`` of rows whose ``target`` is not the ``value`` of the next row of their group by ``time``,
    as ``does_not_have_next_corresponding_record`` finds them in a batch.

    Rows wait until the watermark has passed them, as an earlier one may still come, and are then judged in order of
    ``time`` and ``keys``; the last one waits for its follower. A row that comes after a later one was judged is late and is left out.
    """
    shown = list(dict.fromkeys([within, *keys]))
    fields = list(dict.fromkeys([*shown, target, value]))
    rows = stream.select(*dict.fromkeys([*fields, time])).withWatermark(time, late)
    kinds = {f: stream.schema[f].dataType.simpleString() for f in shown}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        judged, waiting = (json.loads(x) for x in state.get) if state.exists else (None, [])
        if not state.hasTimedOut:
            for batch in batches:
                moments = [x.value // 1_000_000 for x in batch[time]]
                cells = json.loads(batch[fields].to_json(orient="values"))
                waiting += [[m, *c] for m, c in zip(moments, cells) if judged is None or [m, *c[: len(shown)]] > judged[: len(shown) + 1]]
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: r[: len(shown) + 1])
        ready = [r for r in waiting if r[0] <= mark]
        waiting = waiting[len(ready) :]
        wrong = []
        at, of = 1 + fields.index(target), 1 + fields.index(value)
        for r in ready:
            if judged is not None and judged[at] != r[of]:
                wrong.append(judged[1 : len(shown) + 1])
            judged = r
        state.update((json.dumps(judged), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], mark + 1))
        if wrong:
            out = pd.DataFrame(wrong, columns=shown)
            yield out.astype({f: "int64" for f, k in kinds.items() if k in ("bigint", "int")})

    return rows.groupBy(within).applyInPandasWithState(run, _schema(stream, shown), "judged string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def with_counts(stream: DataFrame, by: list[str], time: str, window: str = "1 hour", late: str = "1 hour", name: str = "record_count") -> DataFrame:
    """The rows of a stream, ``start`` of their window for ``time``, and the number of rows of their ``by`` and window: a binding, joined back stream to stream.

    The count of a window is told once the watermark has passed its end; later rows are in neither side.
    """
    rows = stream.withWatermark(time, late)
    counts = rows.groupBy(*by, F.window(time, window).alias("__w")).agg(F.count(F.lit(1)).alias(name))
    left = rows.withColumn("__w", F.window(time, window)).drop(time)  # a stream has one column of event time, here the window
    right = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__w").alias("__v"), name)
    on = F.col("__w") == F.col("__v")
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return left.join(right, on).withColumn("start", F.col("__w.start")).drop("__w", "__v", *(f"__{c}" for c in by))
