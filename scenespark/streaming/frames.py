"""Frame and pose streams: admission, keyframe gate, sync, pose lookup, stop, operation feeds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import geometry as G
from ..operators import joins as J
from ..operators.scans import kept, scan_runs
from ..sources.store import FoldedTable

POSE = ["tx", "ty", "tz", "qw", "qx", "qy", "qz"]
#: The gate's defaults: seconds, metres, radians.
MIN_DT, MIN_TRANS, MIN_ROT = 0.5, 0.25, 0.15


def admit(batch: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """The first ``n`` frames of each key in a batch; later ones are dropped (use in foreachBatch)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return batch.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def _gate(columns: list[list], last: tuple | None, limits: tuple) -> tuple[list[int], tuple | None]:
    """Positions of the accepted rows (columns t, tx .. qz in time order) and the last accepted one."""
    dt, trans, rot = limits
    far, half = trans * trans, math.cos(rot / 2)
    out = []
    for i, r in enumerate(zip(*columns, strict=True)):
        if last is not None:
            if r[0] - last[0] < dt:
                continue
            x, y, z = r[1] - last[1], r[2] - last[2], r[3] - last[3]
            # turned by more than rot: the half angle's cosine is smaller
            if x * x + y * y + z * z <= far and abs(r[4] * last[4] + r[5] * last[5] + r[6] * last[6] + r[7] * last[7]) >= half:
                continue
        out.append(i)
        last = r
    return out, last


def select_keyframes(frames: DataFrame, run: str = "run_id", key: str = "frame_id", min_dt: float = MIN_DT, min_trans: float = MIN_TRANS, min_rot: float = MIN_ROT) -> DataFrame:
    """Batch form of the gate: the first frame, then each that is late and far or turned enough from the last accepted one.

    Frames stream past in time order; the last accepted one is all that is kept of a run.
    """
    names, limits = [run, key, "t", *POSE], (min_dt, min_trans, min_rot)

    def step(last, batch):
        rows, last = _gate([batch.column(c).to_pylist() for c in ("t", *POSE)], last, limits)
        return last, kept(batch, rows)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*names).schema)
    return scan_runs(frames.select(*names), run, ["t", key], lambda: None, step, schema)


class KeyframeGate(StatefulProcessor):
    """State: time and pose of the last accepted frame of a run."""

    def __init__(self, run: str, key: str, limits: tuple):
        self.run, self.key, self.limits = run, key, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, " + ", ".join(f"{p} double" for p in POSE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", self.key])
        rows, last = _gate([pdf[c].tolist() for c in ("t", *POSE)], self.last.get(), self.limits)
        if last is not None:
            self.last.update(tuple(map(float, last)))
        yield pdf.iloc[rows][[self.run, self.key, "t", *POSE]]

    def close(self) -> None:
        pass


def select_keyframes_stream(frames: DataFrame, run: str = "run_id", key: str = "frame_id", min_dt: float = MIN_DT, min_trans: float = MIN_TRANS, min_rot: float = MIN_ROT) -> DataFrame:
    """The gate on a stream; rows of a batch are taken in time order, earlier batches first."""
    names = [run, key, "t", *POSE]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*names).schema)
    gate = KeyframeGate(run, key, (min_dt, min_trans, min_rot))
    return frames.select(*names).groupBy(run).transformWithStateInPandas(gate, schema, "Append", "None")


def sync_streams(a: DataFrame, b: DataFrame, slop_seconds: float, wait: str = "10 seconds", seconds: str | None = None) -> DataFrame:
    """a(event_time, id), b(event_time, id) -> a_time, a_id, b_id, gap: each a with the nearest b within the slop, ties to the smaller id.

    Time is cut into slots of the slop: a lies in one, b is sent to its own and the two beside it, and they meet
    by an equality.  The nearest is an aggregate by message, given out when the watermark has passed it; rows
    later than ``wait`` are dropped.  Tables give the same rows at once.

    Whole microseconds decide what lies within the slop; with ``seconds``, a column of both that holds the time as
    a double, those doubles do (a double between microseconds, or rounded, may lie on the other side of the slop).
    """
    # microseconds that two rounded times can be off
    reach = round(slop_seconds * 1e6) + (2 if seconds else 0)
    slot = lambda t: F.floor(F.unix_micros(t) / reach).cast("long")
    exact = lambda name: [F.col(seconds).alias(name)] if seconds else []
    left = _marked(a, wait).select(F.col("event_time").alias("a_time"), F.col("id").alias("a_id"), slot("event_time").alias("a_slot"), *exact("a_seconds"))
    right = _marked(b, wait).select(F.col("event_time").alias("b_time"), F.col("id").alias("b_id"), slot("event_time").alias("own"), *exact("b_seconds"))
    right = right.select("b_time", "b_id", F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])).alias("b_slot"), *(["b_seconds"] if seconds else []))
    span = F.expr(f"interval {reach} microseconds")
    near = (F.col("a_slot") == F.col("b_slot")) & (F.col("b_time") >= F.col("a_time") - span) & (F.col("b_time") <= F.col("a_time") + span)
    if seconds:
        near = near & (F.col("b_seconds") >= F.col("a_seconds") - slop_seconds) & (F.col("b_seconds") <= F.col("a_seconds") + slop_seconds)
    both = left.join(right, near)
    gap = F.abs(F.unix_micros("a_time") - F.unix_micros("b_time"))
    best = both.groupBy("a_time", "a_id").agg(F.min(F.struct(gap.alias("gap"), "b_id")).alias("m"))
    return best.select("a_time", "a_id", "m.b_id", (F.col("m.gap") / 1e6).alias("gap"))


def _marked(df: DataFrame, wait: str) -> DataFrame:
    return df.withWatermark("event_time", wait) if df.isStreaming else df


def interpolate_pose_stream(frames: DataFrame, poses: DataFrame, wait_seconds: float = 0.5, before_seconds: float | None = None, late: str = "10 seconds") -> DataFrame:
    """frames(event_time, run_id, frame_id), poses(event_time, run_id, pose) -> frames with the pose interpolated between the two around them.

    A frame waits ``wait_seconds`` for a pose at or after it and looks ``before_seconds`` back (by default as far)
    for one at or before it; without either it is dropped.  Given out when the watermark has passed the frame.
    """
    back = wait_seconds if before_seconds is None else before_seconds
    f = _marked(frames, late).select("run_id", "frame_id", F.col("event_time").alias("f_time"))
    p = _marked(poses, late).select(F.col("run_id").alias("p_run"), F.col("event_time").alias("p_time"), *POSE)
    near = (F.col("p_time") >= F.col("f_time") - F.expr(f"interval {back} seconds")) & (F.col("p_time") <= F.col("f_time") + F.expr(f"interval {wait_seconds} seconds"))
    both = f.join(p, (F.col("run_id") == F.col("p_run")) & near)
    micros = lambda t: F.unix_micros(t) / 1e6
    pose = F.struct(micros("p_time").alias("t"), *POSE)
    a = F.max_by(F.when(F.col("p_time") <= F.col("f_time"), pose), F.when(F.col("p_time") <= F.col("f_time"), F.col("p_time")))
    b = F.min_by(F.when(F.col("p_time") >= F.col("f_time"), pose), F.when(F.col("p_time") >= F.col("f_time"), F.col("p_time")))
    around = both.groupBy("f_time", "run_id", "frame_id").agg(a.alias("a"), b.alias("b")).filter("a is not null and b is not null")
    return J.between_poses(around.withColumn("t", micros("f_time")), ["run_id", "frame_id", "f_time"], "t").withColumnRenamed("f_time", "event_time")


def stream_stop(df: DataFrame, key: str, gap: str = "20 seconds", late: str = "1 second") -> DataFrame:
    """A row for each silence longer than ``gap`` after data: when the session of a key closed."""
    if df.isStreaming:
        df = df.withWatermark("event_time", late)
    return df.groupBy(key, F.session_window("event_time", gap).alias("s")).agg(F.count("*").alias("frames")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stopped"), "frames")


def latest_frame(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def operation_order(batch: DataFrame) -> DataFrame:
    """Operations of a batch in the order they are applied: local adjustments before loop closures; other kinds are errors."""
    rank = F.when(F.col("op_type") == "LocalBA", 0).when(F.col("op_type") == "LoopClosingBA", 1)
    return batch.withColumn("error", rank.isNull()).withColumn("rank", rank)


def apply_operations(keyframes: DataFrame, batch: DataFrame) -> DataFrame:
    """Keyframes after a batch of pose updates (op_id orders within a kind); rows of unsupported kinds are left out."""
    good = operation_order(batch).filter("not error")
    ordered = good.withColumn("op_id", F.struct("rank", "op_id"))
    return J.apply_pose_updates(keyframes, ordered)


def admitted_stream(frames: DataFrame, path: str, state: str, key: str, order: str, n: int = 20):
    """Writes what ``admit`` lets through of each batch below ``path``, a folder a batch; a repeated batch overwrites its own.  Gives a writer to start."""
    return frames.writeStream.option("checkpointLocation", state).foreachBatch(lambda batch, i: admit(batch, key, order, n).write.mode("overwrite").parquet(f"{path}/batch={i}"))


def operations_stream(operations: DataFrame, keyframes: FoldedTable, state: str):
    """Applies a feed of pose updates to the table of keyframes batch after batch, each once.  Gives a writer to start."""

    def fold(table: DataFrame, batch: DataFrame) -> DataFrame:
        return apply_operations(table, batch).drop("state")

    return operations.writeStream.option("checkpointLocation", state).foreachBatch(lambda batch, i: keyframes.merge(batch, i, fold) and None)


def latest_frame_stream(frames: DataFrame, latest: FoldedTable, state: str, key: str, order: str, value: str):
    """Keeps the last value of each key in a table, batch after batch, each once.  Gives a writer to start."""

    def fold(table: DataFrame, batch: DataFrame) -> DataFrame:
        return latest_frame(table.unionByName(batch.select(table.columns)), key, order, value)

    return frames.writeStream.option("checkpointLocation", state).foreachBatch(lambda batch, i: latest.merge(batch, i, fold) and None)


def snapshot_metrics(df: DataFrame, iteration: str, n: int = 1000) -> DataFrame:
    from ..operators.schedule import every_n

    return every_n(df, iteration, n)


def keyframe_stream(frames: DataFrame, size: float, **gate) -> DataFrame:
    """Frames with poses (a stream or a table) -> accepted keyframes with their chunk."""
    pick = select_keyframes_stream if frames.isStreaming else select_keyframes
    return pick(frames, **gate).withColumn("chunk_id", G.chunk_id("tx", "ty", "tz", size))
