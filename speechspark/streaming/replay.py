"""Batch replay of the streaming rules over stored frame scores, and operators on events.

One exchange brings every buffer's frames together: frames are grouped into blocks of
consecutive analyses plus the one buffer length that precedes them, so a group is bounded
whatever the length of the stream, and no frame is copied once per analysis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.functions.blocks import BLOCK, framed
from speechspark.operators.segmenting import SegmentParams, resolve, speech_state
from speechspark.streaming.analysers import BufferedScores
from speechspark.streaming.params import StreamParams

KEYS = ("clip_id",)


def frame_stream_params(preset: str | SegmentParams, **changes) -> StreamParams:
    """Stream rules over frames of the preset's step instead of samples."""
    return StreamParams(rate=1000.0 / resolve(preset).step_ms, **changes)


def analyses(frames: DataFrame, preset: str | SegmentParams, chunk_frames: int, params: StreamParams | None = None,
             keys: Sequence[str] = KEYS, order: str = "frame_idx", p: str = "p", per_block: int = 256) -> DataFrame:
    """One row per buffer analysis: keys, analysis, buf_start, now_frame, eos, active, starts[], ends[].

    ``starts`` / ``ends`` are the segments that became final, without those that an earlier
    analysis of the same block already reported; ``active`` tells whether speech reaches the end.
    Chunks hold ``chunk_frames`` frames (the last may be shorter), so an analysis happens every
    ceil(min / chunk) chunks and at the end of the stream.  Frame numbers are absolute.
    """
    seg = resolve(preset)
    params = params or frame_stream_params(seg)
    per = max(1, math.ceil(params.min_values / chunk_frames)) * chunk_frames
    cap = params.max_values
    span = per * per_block
    # A block reads from one buffer length before its first analysis to one frame past its
    # last one; that extra frame tells whether the stream goes on.
    first, last = F.expr(f"greatest({order} - 1, 0) div {span}"), F.expr(f"({order} + {cap + per}) div {span}")
    spread = frames.select(
        *keys, F.col(order).alias("_i"), F.col(p).cast("double").alias("_p"), F.explode(F.sequence(first, last)).alias("_blk")
    )

    step_ms, tol, wait = seg.step_ms, params.active_tol_s * 1000 + 1e-6, params.finalize_s * 1000 - 1e-6

    def start_key(frame: int) -> int:
        return params.start_key(frame * step_ms / 1000) if params.dedupe == "bucket" else frame

    def run(group, pdf):
        blk = int(group[-1])
        pdf = pdf.sort_values("_i")
        first, x = int(pdf["_i"].iat[0]), pdf["_p"].to_numpy()
        stop = first + len(x)  # one past the last frame this block can see
        buffers = BufferedScores(x, seg)
        ks = np.arange(blk * per_block, (blk + 1) * per_block)
        ks = ks[ks * per < stop]
        now = np.minimum((ks + 1) * per, stop)
        begin = np.maximum(now - cap, 0)
        seen: set[int] = set()
        active, starts, ends = [], [], []
        for lo, hi in zip(begin.tolist(), now.tolist()):
            found = [(first + s, first + e) for s, e in buffers.frames(lo - first, hi - first)]
            active.append(any((hi - e) * step_ms <= tol for _, e in found))
            fresh = []
            for s, e in found:
                cut = params.suppress_left_edge and s <= lo and lo > 0
                if not cut and (hi == stop or (hi - e) * step_ms >= wait) and start_key(s) not in seen:
                    seen.add(start_key(s))
                    fresh.append((s, e))
            starts.append([s for s, _ in fresh])
            ends.append([e for _, e in fresh])
        out = pd.DataFrame({"analysis": ks, "buf_start": begin, "now_frame": now, "eos": now == stop, "active": active})
        out["starts"], out["ends"] = pd.Series(starts, dtype=object), pd.Series(ends, dtype=object)
        for name, value in zip(keys, group):
            out[name] = pd.Series([value] * len(ks), dtype=pdf[name].dtype)
        return out

    kt = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return spread.groupBy(*keys, "_blk").applyInPandas(
        run, f"{kt}, analysis bigint, buf_start bigint, now_frame bigint, eos boolean, active boolean, starts array<bigint>, ends array<bigint>"
    )


def abs_time(rel_s: Column, buf_start: Column, rate: float) -> Column:
    """Seconds since the start of the stream of a time relative to the buffer."""
    return buf_start.cast("double") / F.lit(float(rate)) + rel_s


def replay_stream(frames: DataFrame, preset: str | SegmentParams, chunk_frames: int, params: StreamParams | None = None,
                  keys: Sequence[str] = KEYS, order: str = "frame_idx", p: str = "p", per_block: int = 256) -> DataFrame:
    """Events of the streaming segmenter: keys, analysis, event_type, timestamp, emitted_at_s,
    speech_active, start_s, end_s."""
    seg = resolve(preset)
    params = params or frame_stream_params(seg)
    step = F.lit(float(seg.step_ms))
    runs = analyses(frames, seg, chunk_frames, params, keys, order, p, per_block)
    ms = lambda frame: F.col(frame).cast("double") * step

    done = runs.select(*keys, "analysis", "now_frame", F.explode(F.arrays_zip("starts", "ends")).alias("_s")).select(
        *keys, "analysis", "now_frame", F.col("_s.starts").alias("start_frame"), F.col("_s.ends").alias("end_frame")
    )
    start_key = F.col("start_frame")
    if params.dedupe == "bucket":
        start_key = F.floor(F.round(ms("start_frame") / 1000.0 / params.bucket_s, 6)).cast("bigint")
    # First emission per start: the earliest analysis, then its segment order.
    first = F.min(F.struct("analysis", "start_frame", "end_frame", "now_frame")).alias("_e")
    segments = done.groupBy(*keys, start_key.alias("_key")).agg(first).select(
        *keys, F.col("_e.analysis").alias("analysis"), F.lit("segment").alias("event_type"),
        (ms("_e.end_frame") / 1000.0).alias("timestamp"), (ms("_e.now_frame") / 1000.0).alias("emitted_at_s"),
        F.lit(None).cast("boolean").alias("speech_active"),
        (ms("_e.start_frame") / 1000.0).alias("start_s"), (ms("_e.end_frame") / 1000.0).alias("end_s"),
    )
    activity = framed(
        runs.select(*keys, "analysis", "now_frame", "eos", F.col("active").alias("speech_active")), keys, "analysis",
        {"_was": lambda w: F.lag("speech_active", 1, False).over(w)}, back=1,
    )
    # A change is one event; the end of the stream forces one more if speech is still active.
    moves = F.array_compact(F.array(
        F.when(F.col("speech_active") != F.col("_was"), F.col("speech_active")),
        F.when(F.col("eos") & F.col("speech_active"), F.lit(False)),
    ))
    at = ms("now_frame") / 1000.0
    none = F.lit(None).cast("double")
    changes = activity.select(
        *keys, "analysis", F.lit("activity").alias("event_type"), at.alias("timestamp"), at.alias("emitted_at_s"),
        F.explode(moves).alias("speech_active"), none.alias("start_s"), none.alias("end_s"),
    )
    return segments.unionByName(changes)


def activity_series(frames: DataFrame, preset, chunk_frames: int, params: StreamParams | None = None, **kw) -> DataFrame:
    """Activity flag of every analysis: keys, analysis, now_frame, speech_active."""
    seg = resolve(preset)
    params = params or frame_stream_params(seg)
    runs = analyses(frames, seg, chunk_frames, params, **kw)
    return runs.select(*kw.get("keys", KEYS), "analysis", "now_frame", F.col("active").alias("speech_active"))


def debounce(series: DataFrame, hold: int, keys: Sequence[str] = KEYS, order: str = "analysis", flag: str = "speech_active",
             block: int = BLOCK) -> DataFrame:
    """Flip only after the new value has held for ``hold`` consecutive rows: adds ``debounced``."""
    rule = SegmentParams(step_ms=1, on=0.5, min_on=hold, min_off=hold)
    state = speech_state(series.withColumn("_p", F.col(flag).cast("double")), rule, p="_p", out="_d", keys=keys, order=order, block=block)
    return state.withColumn("debounced", F.col("_d") == 1).drop("_p", "_d")


def dedupe_bucketed(segments: DataFrame, bucket_s: float = 0.1, keys: Sequence[str] = KEYS, order: str = "analysis") -> DataFrame:
    """First segment per start bucket; bucket edges are taken to the microsecond."""
    bucket = F.floor(F.round(F.col("start_s") / bucket_s, 6)).cast("bigint")
    rest = [c for c in segments.columns if c not in keys and c != order]
    best = F.min(F.struct(order, "start_s", *[c for c in rest if c != "start_s"])).alias("_b")
    return segments.groupBy(*keys, bucket.alias("bucket")).agg(best).select(*keys, "bucket", "_b.*")


def stream_latency(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Events by type with the delay between the audio time and the moment of emission."""
    delay = F.col("emitted_at_s") - F.col("timestamp")
    return events.groupBy(*keys, "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(delay).alias("avg_delay_s"), F.max(delay).alias("max_delay_s")
    )
