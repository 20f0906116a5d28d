"""Keyed state that takes the rows of a stream in the order of their times, whatever the order in which they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ready

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: fold(key, state or None, rows in order) gives the new state (None: forget it) and what comes out.
Fold = Callable[[tuple, tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame]]


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds those that are due in order; a key without rows for `keep` microseconds is forgotten.

    Without waiting the rows of each trigger are folded at once, in order among themselves.
    """

    def __init__(self, columns: list[str], waiting: str | None, state: str, time: str, order: list[str], fold: Fold, keep: int):
        self.columns, self.ddl, self.state_ddl, self.time, self.order, self.fold, self.keep = columns, waiting, state, time, order, fold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.ddl is None:
            self.state = handle.getValueState("state", self.state_ddl, ttlDurationMs=self.keep // 1000)
            return
        self.waiting = handle.getListState("waiting", self.ddl)
        self.state = handle.getValueState("state", self.state_ddl)
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x[self.columns].astype(object) for x in rows]
        if self.ddl is None:
            yield self._folded(key, pd.concat(new, ignore_index=True))
        else:
            yield from self._due(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, [], timerValues)

    def _folded(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(self.order, kind="stable", na_position="first").reset_index(drop=True)
        state, out = self.fold(key, self.state.get() if self.state.exists() else None, rows)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        return out

    def _due(self, key, new: list[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.columns, dtype=object)
        rows = pd.concat([held, *new], ignore_index=True)
        due = rows[self.time].astype("int64") <= now
        if due.any():
            self.last.update((int(rows[self.time][due].max()),))
            yield self._folded(key, rows[due])
            rows = rows[~due]
        if len(rows):
            self.waiting.put([tuple(None if pd.isna(x) else x for x in r) for r in rows.itertuples(index=False)])
            for at in sorted({-(-int(t) // 1_000_000) * 1000 for t in rows[self.time]}):  # a timer for each second
                self.handle.registerTimer(at)
            return
        self.waiting.clear()
        if self.last.exists():
            end = (self.last.get()[0] + self.keep) // 1000 + 1
            if end * 1000 <= now:
                self.state.clear()
                self.last.clear()
            else:
                self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: list[str], time: str, order: list[str], state: str, fold: Fold, out: str, watermark: str | None = "10 seconds", keep_s: int = 86_400) -> DataFrame:
    """What fold makes of the rows of each key of a stream, taken in order (time, a column of microseconds, first).

    Rows come out once the watermark has passed their time; rows later than the watermark are dropped. A watermark that rows have
    already is taken. Without one (None) each trigger's rows come out at once, and fold sees to those that are late. The state store must
    be RocksDB: set spark.sql.streaming.stateStore.providerClass before the query starts. No column but _at may begin with an underscore.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    ready(spark)
    marked = [f.name for f in rows.schema.fields if "spark.watermarkDelayMs" in f.metadata]
    columns = [c for c in rows.columns if c not in key and c not in marked]
    waiting = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    order = [time, *(c for c in order if c != time)]
    if watermark and not marked:
        rows = rows.withColumn("_at", F.timestamp_micros(time)).withWatermark("_at", watermark)
    waits = bool(watermark or marked)
    held = InOrder(columns, waiting if waits else None, state, time, order, fold, keep_s * 1_000_000)
    return rows.groupBy(*key).transformWithStateInPandas(held, out, "append", "eventTime" if waits else "processingTime")
