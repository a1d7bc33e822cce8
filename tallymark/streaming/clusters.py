"""The corpus signal over a stream: how often an output repeats, with earlier rows put right when a cluster grows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymark.functions.text import normal_output
from tallymark.operators.scoring import weight

#: The store that state of this kind needs; set ``spark.sql.streaming.stateStore.providerClass`` to it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Cluster sizes at which the signal rises, and its values.
LEVELS = ((2, 0.6), (5, 1.0))
OUT = "call_id string, model string, out_key string, low_output_diversity double, revision int"


def level(n: int) -> int:
    return sum(n >= least for least, _ in LEVELS)


class Clusters(StatefulProcessor):
    """Counts the calls of one (model, output); below the last level it keeps the few calls whose signal may still rise.

    As each call weighs 1 at least, fewer calls are kept than the last level's size. ``keep_ms``: a cluster without calls for
    so long is forgotten, by a timer on event time that frees its state; a later call begins a new one.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.size = handle.getValueState("size", "n bigint, last bigint")
        self.open = handle.getListState("open", "call_id string")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.size.get() if self.size.exists() else (0, None)
        waiting = [r[0] for r in self.open.get()] if self.open.exists() else []
        before, at, out = level(n), level(n), []
        calls = [c for batch in rows for c in zip(batch["ms"], batch["call_id"], batch["w"], strict=True)]  # of one trigger
        for ms, call, w in sorted(calls, key=lambda c: c[0]):
            if self.keep_ms is not None and last is not None and ms - last > self.keep_ms:
                n, at, waiting = 0, 0, []
            n, last = n + int(w), max(int(ms), last or int(ms))
            if level(n) > at:  # earlier calls of this cluster had less
                at = level(n)
                out += [(c, at) for c in waiting]
            out.append((call, at))
            waiting = waiting + [call] if at < len(LEVELS) else []
        self.size.update((n, last))
        if waiting:
            self.open.put([(c,) for c in waiting])
        elif before < len(LEVELS):
            self.open.clear()
        if self.keep_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            until = max(last, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
            self.handle.registerTimer(until)
            self.timer.update((until,))
        values = [0.0, *(v for _, v in LEVELS)]
        yield pd.DataFrame([(c, *key, values[k], k) for c, k in out], columns=["call_id", "model", "out_key", "low_output_diversity", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.size, self.open, self.timer):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def diversity_stream(calls: DataFrame, time: str | None = None, late: str = "10 minutes", keep: int | None = None) -> DataFrame:
    """(call_id, model, out_key, low_output_diversity, revision) of a stream of calls, a row again with a higher revision when its signal rises.

    Of a call the row of the highest revision counts; when the stream has ended, these rows are those of a batch over everything. An empty
    output has 0. ``time`` is the column of event time, needed only with ``keep``, the seconds after which an idle cluster is forgotten.
    """
    if keep is not None and time is None:
        raise ValueError("forgetting clusters needs a time")
    if time:
        calls = calls.withWatermark(time, late)
    ms = F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(0).cast("bigint")
    rows = calls.select("call_id", "model", normal_output(F.col("output_excerpt")).alias("out_key"), weight().alias("w"), ms.alias("ms"), *([time] if time else []))
    some = rows.filter("out_key != ''").groupBy("model", "out_key").transformWithStateInPandas(Clusters(None if keep is None else keep * 1000), OUT, "append", "None" if keep is None else "EventTime")
    none = rows.filter("out_key = ''").select("call_id", "model", "out_key", F.lit(0.0).alias("low_output_diversity"), F.lit(0).alias("revision"))
    return some.unionByName(none)
