"""Streams with typed state: values, lists, maps, timers and initial state, carried from micro-batch to micro-batch and over restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..env import scratch, stored
from ..operators.objects import EVENTS
from .state import BACKGROUND, run_in_batches

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Rows of a stream that one bucket of keys is meant for.
BUCKET_ROWS = 1 << 15


def ranges(held: DataFrame, at: str, n: int) -> Iterator[DataFrame]:
    """The rows of n even ranges of at, in order. held is scanned for each."""
    low, high = held.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0) + n) // n
    for i in range(n):
        yield held.filter(F.col(at).between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1))


def slices(spark: SparkSession, df: DataFrame, at: str, n: int) -> str:
    """Writes df as one file for each of n even ranges of at, one after another, and gives the folder: a stream reads them in that order.

    One task writes a range; fed() is for tables.
    """
    path = scratch(spark)
    for part in ranges(stored(df), at, n):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return f"{path}/in"


def stream_of(spark: SparkSession, folder: str, schema, files: int | None = 1) -> DataFrame:
    """The files of a folder as a stream, so many in a micro-batch; None: all that are there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def fed(held: DataFrame, at: str, n: int, plan: Callable[[DataFrame], DataFrame], mode: str = "update") -> DataFrame:
    """What plan makes of held as a stream in n even ranges of at, with the number of its micro-batch.

    A range is written by all tasks and is one micro-batch, whatever its files; the stream is then drained and goes on from its checkpoint with
    the next range. Only after the last one a micro-batch without rows moves the watermark on.
    """
    spark, path = held.sparkSession, scratch(held.sparkSession)
    idle = spark.conf.get(IDLE)
    try:
        for i, part in enumerate(ranges(held, at, n), 1):
            part.write.mode("append").parquet(f"{path}/in")
            spark.conf.set(IDLE, idle if i == n else "false")
            run_in_batches(plan(stream_of(spark, f"{path}/in", held.schema, None)), f"{path}/out", f"{path}/state", mode)
    finally:
        spark.conf.set(IDLE, idle)
    return spark.read.parquet(f"{path}/out")


def buckets_for(rows: int) -> int:
    """Buckets of keys for a stream of about so many rows."""
    return rows // BUCKET_ROWS + 1


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df with the bucket of its key; the null key has bucket -1, as key 0."""
    k = F.col(key).cast("long")
    to = F.when(k.isNull(), -1).otherwise(F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int"))
    return df.select(to.alias("bucket"), F.coalesce(k, F.lit(0).cast("long")).alias(key), *[c for c in df.columns if c != key])


class Buckets(StatefulProcessor):
    """Keys share a bucket, whose state is one value with an array per column, keys first and in order: numpy goes over all keys of a bucket at once.

    State and timers of each key apart cost milliseconds a key and micro-batch. The number of buckets holds as long as the checkpoint.
    """

    #: The value's type, and what stands for a key that is new.
    STATE, NEW = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("bucket", self.STATE)

    def held(self) -> list[np.ndarray]:
        columns = self.value.get() if self.value.exists() else ([] for _ in range(len(self.NEW) + 1))
        return [np.array(c, type(new)) for c, new in zip(columns, (0, *self.NEW), strict=True)]

    def with_keys(self, keys: np.ndarray) -> list[np.ndarray]:
        """The state, with these keys as well."""
        old, *columns = self.held()
        out = [np.union1d(old, keys)]
        at = np.searchsorted(out[0], old)
        for column, new in zip(columns, self.NEW, strict=True):
            out.append(np.full(len(out[0]), new, type(new)))
            out[-1][at] = column
        return out

    def keep(self, columns: list[np.ndarray]) -> None:
        self.value.update(tuple(c.tolist() for c in columns))

    def close(self) -> None:
        pass


class Background(Buckets):
    """BACKGROUND after each row of a cell; state: the background, the last value and its frame. Older rows than that are dropped.

    Initial state (cell, bg, last, frame) lets a stream go on from what a batch job has worked out. A bucket's rows of one micro-batch are held.
    """

    UNSEEN = -(2**40)
    STATE, NEW = "cell array<bigint>, bg array<double>, last array<double>, frame array<bigint>", (0.0, 0.0, UNSEEN)

    def __init__(self, alpha: float, still: float, near: float) -> None:
        self.alpha, self.still, self.near = alpha, still, near

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # of rows of one cell and frame the first counts
        df = pd.concat(list(rows)).sort_values(["cell", "frame"], kind="stable").drop_duplicates(["cell", "frame"])
        cells, bg, last, seen = self.with_keys(df["cell"].to_numpy())
        at = np.searchsorted(cells, df["cell"].to_numpy())
        later = df["frame"].to_numpy() > seen[at]
        df, at = df[later], at[later]
        frames, values, out = df["frame"].to_numpy(np.int64), df["v"].to_numpy(float), np.empty(len(df))
        # the first rows of all cells, then the second ones, and so on
        nth = df.groupby("cell").cumcount().to_numpy()
        for rows_of in np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1]):
            i, v = at[rows_of], values[rows_of]
            moved = np.where((abs(v - last[i]) < self.still) & (abs(v - bg[i]) < self.near), (1 - self.alpha) * bg[i] + self.alpha * v, bg[i])
            bg[i] = np.where(seen[i] == self.UNSEEN, v, moved)
            last[i], seen[i], out[rows_of] = v, frames[rows_of], bg[i]
        self.keep([cells, bg, last, seen])
        yield pd.DataFrame({"cell": df["cell"].to_numpy() if key[0] >= 0 else None, "frame": frames, "background": out})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        columns = self.with_keys(initialState["cell"].to_numpy())
        at = np.searchsorted(columns[0], initialState["cell"].to_numpy())
        for column, name in zip(columns[1:], ("bg", "last", "frame"), strict=True):
            column[at] = initialState[name].to_numpy()
        self.keep(columns)


def background(df: DataFrame, alpha: float = 0.05, still: float = 2, near: float = 4, initial: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    start = _dealt(initial, "cell", buckets).groupBy("bucket") if initial is not None else None
    return _dealt(df, "cell", buckets).groupBy("bucket").transformWithStateInPandas(Background(alpha, still, near), BACKGROUND, "Update", "None", initialState=start)


class Silent(Buckets):
    """(key, last_ms, silent): keys whenever they were heard, and when they have been without an event for gap_ms of event time.

    State: the last event of each key, and a timer for the one that falls silent first.
    """

    STATE, NEW = "key array<bigint>, last array<bigint>", (-(2**63),)

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.concat([r.groupby("key")["ms"].max() for r in rows]).groupby(level=0).max()
        heard = newest.index.to_numpy()
        before = self.held()[1]
        keys, last = self.with_keys(heard)
        at = np.searchsorted(keys, heard)
        last[at] = np.maximum(last[at], newest.to_numpy())
        self._remind(before, last)
        self.keep([keys, last])
        yield self._told(key, heard, last[at], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, last = self.held()
        gone = last + self.gap_ms < timerValues.getCurrentWatermarkInMs()
        if gone.all():
            self.value.clear()
        else:
            # the timer that went off is deleted by Spark
            self._remind(last[:0], last[~gone])
            self.keep([keys[~gone], last[~gone]])
        yield self._told(key, keys[gone], last[gone], True)

    def _remind(self, before: np.ndarray, last: np.ndarray) -> None:
        """A timer for the first of last, in place of that for the first of before. One in the past goes off at the next watermark."""
        old, new = (int(x.min()) + self.gap_ms if len(x) else None for x in (before, last))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if old != new:
            self.handle.registerTimer(new)

    def _told(self, key, keys: np.ndarray, last: np.ndarray, silent: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": keys if key[0] >= 0 else None, "last_ms": last, "silent": silent})


def silent(events: DataFrame, key: str, at: str, gap_ms: int, late: str = "0 seconds", buckets: int = 64) -> DataFrame:
    held = events.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return _dealt(held, "key", buckets).groupBy("bucket").transformWithStateInPandas(Silent(gap_ms), "key long, last_ms long, silent boolean", "Append", "EventTime")


def _rows(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order; its input bounds them."""
    return pd.concat(list(batches)).sort_values(by, kind="stable")


class MicroStates(StatefulProcessor):
    """EVENTS of one object's rows, as operators.objects.micro_events has them.

    State: a list of the last boxes, a value (whether locked now, whether ever), a map from a part's key to its state, one from a part to its
    state now, and one from a part and state to that state's mask.
    """

    def __init__(self, history: int, overlap: float, stray: float) -> None:
        self.history, self.overlap, self.stray = history, overlap, stray

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.boxes = handle.getListState("boxes", "x int, y int, w int, h int, cx double, cy double")
        self.lock = handle.getValueState("lock", "now boolean, ever boolean")
        self.states = handle.getMapState("states", "part int, key string", "state int")
        self.current = handle.getMapState("current", "part int", "state int, n int")
        self.masks = handle.getMapState("masks", "part int, state int", "w int, h int, mask array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past = [tuple(b) for b in self.boxes.get()]
        was, ever = self.lock.get() if self.lock.exists() else (False, False)
        out = []
        for r in _rows(rows, "frame").itertuples(index=False):
            past = [*past, (int(r.left), int(r.top), int(r.right - r.left + 1), int(r.bottom - r.top + 1), float(r.cx), float(r.cy))][-self.history :]
            now = len(past) == self.history and self._steady(past)
            if now and not was:
                out.append((*key, int(r.frame), "LOCK", None, None, None, None))
            was, ever = now, ever or now
            if ever:
                out += [(*key, int(r.frame), *e) for p in r.parts if (e := self._told(p)) is not None]
        self.boxes.put(past)
        self.lock.update((bool(was), bool(ever)))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in EVENTS.split(", ")])

    def _steady(self, past: list[tuple]) -> bool:
        x, y, w, h = past[-1][:4]
        total = 0.0
        for a, b, c, d, _, _ in past[:-1]:
            inter = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
            total += inter / (w * h + c * d - inter)
        return total / (self.history - 1) > self.overlap or all(max(b[i] for b in past) - min(b[i] for b in past) <= self.stray for i in (4, 5))

    def _told(self, p) -> tuple | None:
        part, key = int(p["part"]), (int(p["part"]), p["key"])
        old, n = self.current.getValue((part,)) if self.current.containsKey((part,)) else (None, 0)
        area, fresh = None, not self.states.containsKey(key)
        if fresh:
            state, mask = n, np.array(p["mask"]).reshape(p["h"], p["w"])
            self.states.updateValue(key, (state,))
            self.masks.updateValue((part, state), (int(p["w"]), int(p["h"]), [int(v) for v in p["mask"]]))
            if old is not None:
                w, h, before = self.masks.getValue((part, old))
                both = np.zeros((2, max(h, mask.shape[0]), max(w, mask.shape[1])), int)
                both[0, :h, :w] = np.array(before).reshape(h, w)
                both[1, : mask.shape[0], : mask.shape[1]] = mask
                area = int((both[0] != both[1]).sum())
        else:
            state = self.states.getValue(key)[0]
        self.current.updateValue((part,), (state, n + fresh))
        if old == state:
            return None
        return ("INIT_MICRO_STATE" if old is None else "MICRO_STATE_CHANGE", part, old, state, area)

    def close(self) -> None:
        pass


def micro_states(df: DataFrame, history: int = 5, overlap: float = 0.85, stray: float = 2) -> DataFrame:
    return df.groupBy("video", "obj").transformWithStateInPandas(MicroStates(history, overlap, stray), EVENTS, "Append", "None")
