"""Ordered folds: per key a small state that goes from row to row in order, the same over a batch and over a stream.

A step takes the state (a JSON object, or None) and a row (a dict), and gives the next state and an output row.

In a batch each key's rows are sorted by Spark and pass through one after another; a task holds the state of
the key it is at. In a stream, rows wait in the key's state until the watermark has passed their time, and are
then folded in order, so rows that come late, out of order or over several batches give the batch's result; rows
later than the watermark's delay are dropped. A key that had no row for ``idle`` starts anew in either, and in
the stream its state goes, so state is bounded by the keys and rows of that time. A key's rows follow one another,
so one key's rows take one task, as an order demands, but never more memory than its state and one Arrow batch, of
which ``LOT`` rows at a time are Python's.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are unpacked, and whose output is held, at once.
LOT = 64
Step = Callable[[dict | None, dict], tuple[dict | None, tuple]]


def kept_state(spark: SparkSession) -> None:
    """Timers and lists in state need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def packed(rows: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Key, time in milliseconds, the row as JSON, and columns to order by. A null time counts as the least."""
    return rows.select(F.col(key), *(c.alias(n) for n, c in _packing(rows, time).items()), *(F.col(c) for c in order if c not in (key, time)))


def _packing(rows: DataFrame, time: str) -> dict[str, Column]:
    at = F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(0))
    return {"at_": at, "row_": F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})}


def _advance(step: Step, state: dict | None, last: int | None, at: int, row: str, idle: int | None) -> tuple[dict | None, tuple]:
    if idle is not None and last is not None and at - last > idle:
        state = None
    return step(state, json.loads(row))


def fold(rows: DataFrame, key: str, time: str, order: list[str], step: Step, schema: str, idle: int | None = None) -> DataFrame:
    """The step's output for every row, in order of time and then ``order`` within its key. idle: milliseconds."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last, started = None, None, None, False
        for part in (batch.slice(a, LOT) for batch in batches for a in range(0, batch.num_rows, LOT)):
            made = []
            for k, at, row in zip(*(part.column(c).to_pylist() for c in (key, "at_", "row_")), strict=True):
                if not started or k != now and not (k != k and now != now):
                    now, state, last, started = k, None, None, True
                state, one = _advance(step, state, last, at, row, idle)
                last = at
                made.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), out.types, strict=True)], schema=out)

    own = packed(rows, key, time, order)
    return own.repartition(key).sortWithinPartitions(key, "at_", *(c for c in order if c not in (key, time))).mapInArrow(run, schema)


class Ordered(StatefulProcessor):
    """Rows wait until the watermark has passed them, then are folded in order. A key has one timer a batch, for its first row, not one a row."""

    def __init__(self, step: Step, out: list[str], order: list[str], idle: int | None):
        self.step, self.out, self.order, self.idle = step, out, order, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, last long")
        self.waiting = handle.getListState("waiting", "at long, row string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(at), row) for part in rows for at, row in zip(part["at_"], part["row_"], strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(at for at, _ in new))  # the key's next one; what still waits then gets the one after
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [(int(at), row) for at, row in self.waiting.get()]
        if self.idle is None and not any(at <= passed for at, _ in held):
            return
        ready = sorted(((at, row) for at, row in held if at <= passed), key=lambda r: (r[0], *((v is not None, v) for v in map(json.loads(r[1]).get, self.order))))
        state, last = None, None
        if self.state.exists():
            state, last = self.state.get()
            state, last = json.loads(state), int(last)
        made = []
        for at, row in ready:
            state, one = _advance(self.step, state, last, at, row, self.idle)
            last = at
            made.append(one)
        if ready:
            rest = [r for r in held if r[0] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(at for at, _ in rest))
            else:
                self.waiting.clear()
            self.state.update((json.dumps(state), last))
        if self.idle is not None and last is not None:
            if last + self.idle < passed:
                self.state.clear()  # what comes now comes later than that
            elif ready:
                self.handle.registerTimer(last + self.idle + 1)
        if made:
            yield pd.DataFrame(made, columns=self.out)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, key: str, time: str, order: list[str], step: Step, schema: str, delay: str, idle: int | None = None) -> DataFrame:
    """The same over a stream; a row's output comes once the watermark, ``delay`` behind the latest row, has passed it."""
    kept_state(rows.sparkSession)
    timed = rows.withWatermark(time, delay)
    own = timed.select(F.col(key), F.col(time), *(c.alias(n) for n, c in _packing(timed, time).items()))
    return own.groupBy(key).transformWithStateInPandas(Ordered(step, T.StructType.fromDDL(schema).names, [c for c in order if c not in (key, time)], idle), schema, "Append", "EventTime")
