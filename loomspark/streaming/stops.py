"""Stop rules over a stream of trace rows that may arrive in any order, with ``transformWithState``.

A run's rows are numbered from ``first`` without gaps. A row waits, in a list state, until all before it came; it is then judged with the last rows,
another list state, and whether a marker was seen, a value state. What still waits after ``idle`` seconds without a row of its run is judged
as it is, in order of its step, and the run is over: rows that come later start nothing and are dropped. States live for ``keep`` seconds after their
last change, so what ended runs leave behind goes by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import LONGEST, TRACE, numbered, stop_reason

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "step long, " + ", ".join(f"{c} double" for c in TRACE)


class _Rules(StatefulProcessor):
    def __init__(self, key: str, step: str, first: int, idle: float, keep: float):
        self.key, self.step, self.first, self.idle, self.keep = key, step, first, idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, ttl = handle, int(self.keep * 1000)
        self.waiting = handle.getListState("waiting", _ROW, ttl)
        self.ring = handle.getListState("ring", _ROW, ttl)
        self.seen = handle.getValueState("seen", "next long, marked boolean, over boolean", ttl)

    def _judge(self, key: tuple, rows: list[tuple], expected: int, marked: bool) -> tuple[list[tuple], list[tuple], bool]:
        ring, out = [tuple(r) for r in self.ring.get()] if self.ring.exists() else [], []
        for row in rows:
            ring = [*ring, row][-LONGEST:]
            marked = marked or row[1 + TRACE.index("marker_rate")] > 0
            out.append((key[0], row[0], stop_reason([r[1:] for r in ring], marked)))
        return out, ring, marked

    def _store(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[self.key, self.step, "stop"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, marked, over = self.seen.get() if self.seen.exists() else (self.first, False, False)
        if over:
            return
        came = [tuple(r) for b in rows for r in b[[self.step, *TRACE]].itertuples(index=False, name=None)]
        # by step; a step that comes again counts once
        known = {int(r[0]): (int(r[0]), *map(float, r[1:])) for r in [*(self.waiting.get() if self.waiting.exists() else []), *came] if r[0] >= expected}
        ready = []
        while expected in known:
            ready.append(known.pop(expected))
            expected += 1
        out, ring, marked = self._judge(key, ready, expected, marked)
        self._store(self.ring, ring)
        self._store(self.waiting, [known[k] for k in sorted(known)])
        self.seen.update((expected, marked, False))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, marked, _ = self.seen.get() if self.seen.exists() else (self.first, False, False)
        left = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        out, _, marked = self._judge(key, left, expected, marked)
        self.waiting.clear()
        self.ring.clear()
        self.seen.update((expected, marked, True))
        yield from self._frame(out)

    def close(self) -> None:
        pass


def ordered_stops(trace: DataFrame, key: str = "run", step: str = "step", *, first: int = 1, idle: float = 600, keep: float = 86_400, finite: tuple[str, ...] = ("loss",)) -> DataFrame:
    """(key, step, stop) of a stream as ``groups.early_stop`` gives them for the whole trace. The session's state store must be RocksDB's.
    Timers go by the clock, so batches follow one another without data, and a run with ``availableNow`` doesn't end by itself."""
    if trace.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    kind = trace.schema[key].dataType.simpleString()
    rules = _Rules(key, step, first, idle, keep)
    return numbered(trace, key, step, finite).groupBy(key).transformWithStateInPandas(rules, outputStructType=f"{key} {kind}, {step} long, stop string", outputMode="append", timeMode="processingTime")
