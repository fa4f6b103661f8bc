"""Keyed state over streams: the batch folds of tessera.operators, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import Tracker

BACKGROUND = "cell long, frame int, background double"


def stream_ema(df: DataFrame, alpha: float = 0.05, still: float = 2, near: float = 4) -> DataFrame:
    """BACKGROUND after each row of a stream (cell, frame, v): state is (background, last value) per cell.

    Within a micro-batch rows are taken in order of frame; across them they are expected in that order. A row that is
    older than what its cell has seen is dropped. A cell's rows of one micro-batch are held, which maxFilesPerTrigger bounds.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for frame, v in zip(rows["frame"], rows["v"].astype(float), strict=True):
            if seen is None:
                seen = (v, v, int(frame))
            elif frame > seen[2]:
                bg, last, _ = seen
                seen = ((1 - alpha) * bg + alpha * v if abs(v - last) < still and abs(v - bg) < near else bg, v, int(frame))
            else:
                continue
            out.append((key[0], int(frame), seen[0]))
        if seen is not None:
            state.update(seen)
        yield pd.DataFrame(out, columns=["cell", "frame", "background"])

    return df.groupBy("cell").applyInPandasWithState(run, BACKGROUND, "bg double, last double, frame int", "update", GroupStateTimeout.NoTimeout)


def stream_objects(df: DataFrame, within: float, patience: int) -> DataFrame:
    """EVENTS of a stream of (video, frame, regions): the batch tracker with its live objects as state.

    A scene cut is a row whose regions are null: it ends all objects.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(within, patience)
        if state.exists:
            tracker.next, ids, values = state.get
            tracker.objects = {i: [*values[5 * k : 5 * k + 4], int(values[5 * k + 4])] for k, i in enumerate(ids)}
        out = []
        for frame, regions in pd.concat(list(batches)).sort_values("frame")[["frame", "regions"]].itertuples(index=False):
            if regions is None:
                out += [(key[0], int(frame), i, "DESPAWN", int(o[2]), int(o[3])) for i, o in sorted(tracker.objects.items())]
                tracker.objects = {}
            else:
                out += [(key[0], int(frame), i, kind, int(x), int(y)) for i, kind, x, y in tracker.step(int(frame), [(r["cx"], r["cy"], r["x"], r["y"]) for r in regions])]
        state.update((tracker.next, list(tracker.objects), [float(v) for o in tracker.objects.values() for v in o]))
        yield pd.DataFrame(out, columns=["video", "frame", "obj_id", "type", "x", "y"])

    return df.groupBy("video").applyInPandasWithState(run, "video int, frame int, obj_id int, type string, x int, y int", "next int, ids array<int>, vals array<double>", "update", GroupStateTimeout.NoTimeout)


def stream_inactive(events: DataFrame, key: str, at: str, gap_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, last_ms) of keys that have been silent for gap_ms when the watermark of at passes: a timer per key, set anew by each event."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone = []
        if state.hasTimedOut:
            gone.append((k[0], state.get[0]))
            state.remove()
        else:
            last = max(int(rows["ms"].max()) for rows in batches)
            last = max(last, state.get[0]) if state.exists else last
            if last + gap_ms <= state.getCurrentWatermarkMs():  # silent already when it came
                gone.append((k[0], last))
                if state.exists:
                    state.remove()
            else:
                state.update((last,))
                state.setTimeoutTimestamp(last + gap_ms)
        yield pd.DataFrame(gone, columns=["key", "last_ms"])

    held = events.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return held.groupBy("key").applyInPandasWithState(run, "key long, last_ms long", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, cents) of an event stream: tumbling windows that close once the watermark passes them."""
    held = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    df = held.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
    return df.select(F.col("w.start").alias("window_start"), "event_type", "n", "cents")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what a stream has into Parquet at path; a later call goes on where this one stopped."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_in_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """The same for streams that Parquet can't append, such as those in update mode: each micro-batch is a folder of its own, which writing it again replaces."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
