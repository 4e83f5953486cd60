"""Multi-class frame scores -> per-speaker segments.

A frame's class stands for a set of at most two of three speakers.  Runs are found inside
one analysis window (a bounded group); merging across windows passes only the last run of a
window on, so the windows of one recording are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechspark.functions.blocks import FAN, carry, pack
from speechspark.functions.numeric import argmax, class_confidence

KEYS = ("clip_id",)

# Frames per 10 s window, and the speakers of each class
# (silence, A, B, A+B, C, A+C, B+C).
FRAMES_PER_WINDOW = 589
WINDOW_SEC = 10.0
N_SPEAKERS = 3
CLASS_SPEAKERS = [[], [0], [1], [0, 1], [2], [0, 2], [1, 2]]
CLASS_LABELS = ["∅", "A", "B", "A+B", "C", "A+C", "B+C"]


def speakers_of(cls: Column) -> Column:
    sets = F.array(*[F.array(*[F.lit(s) for s in who]).cast("array<int>") for who in CLASS_SPEAKERS])
    return F.element_at(sets, cls + 1)


def decode_classes(df: DataFrame, logits: str = "logits", keys: Sequence[str] = KEYS) -> DataFrame:
    """Winning class and its probability per frame."""
    return df.select(
        *keys, "window_idx", "frame_idx", argmax(logits).alias("cls"), class_confidence(logits).alias("conf")
    )


def expand_speakers(decoded: DataFrame) -> DataFrame:
    """One row per active speaker of a frame; silent frames give none."""
    return decoded.withColumn("speaker_id", F.explode(speakers_of(F.col("cls"))))


def speaker_runs(
    expanded: DataFrame,
    keys: Sequence[str] = KEYS,
    frames_per_window: int = FRAMES_PER_WINDOW,
    window_sec: float = WINDOW_SEC,
) -> DataFrame:
    """Contiguous runs per (clip, window, speaker) in clip time, before merging."""
    unit = [*keys, "window_idx", "speaker_id"]
    w = Window.partitionBy(*unit).orderBy("frame_idx")
    runs = (
        expanded.withColumn("_island", F.col("frame_idx") - F.row_number().over(w))
        .groupBy(*unit, "_island")
        .agg(
            F.min("frame_idx").cast("bigint").alias("start_frame"),
            (F.max("frame_idx") + 1).cast("bigint").alias("end_frame"),
            F.avg(F.col("conf").cast("double")).cast("float").alias("confidence"),
        )
    )
    offset = F.col("window_idx").cast("double") * F.lit(window_sec)
    step = F.lit(window_sec / frames_per_window)
    end = F.when(F.col("end_frame") >= frames_per_window, offset + F.lit(window_sec)).otherwise(
        offset + F.col("end_frame").cast("double") * step
    )
    return runs.select(
        *unit,
        "start_frame",
        "end_frame",
        (offset + F.col("start_frame").cast("double") * step).alias("start_s"),
        end.alias("end_s"),
        "confidence",
        ((F.col("window_idx") * (frames_per_window + 1) + F.col("end_frame")) * N_SPEAKERS + F.col("speaker_id"))
        .cast("bigint")
        .alias("emit_order"),
    )


def merge_adjacent(
    runs: DataFrame, merge_gap: float = 0.1, keys: Sequence[str] = KEYS, fan: int = FAN
) -> DataFrame:
    """Join a run to the one emitted right before it: same speaker and gap < ``merge_gap``.

    Emission order is (window, closing frame, speaker).  A merged segment keeps the start and
    confidence of its first run and ends where the run before the next unmerged one ends.
    """
    payload = ["start_s", "end_s", "speaker_id", "confidence"]
    bt = pack(runs, keys, ["emit_order"], payload, "window_idx")
    tail = F.element_at("items", -1)
    bt = bt.withColumns(
        {"_tail": F.struct(tail["speaker_id"].alias("speaker_id"), tail["end_s"].alias("end_s")), "_end": tail["end_s"]}
    )
    bt = carry(bt, keys, before={"_prev": "_tail"}, final={"_clip_end": "_end"}, fan=fan)

    def flag(x, i):
        prior = F.get("items", i - 1)
        spk = F.when(i == 0, F.col("_prev.speaker_id")).otherwise(prior["speaker_id"])
        end = F.when(i == 0, F.col("_prev.end_s")).otherwise(prior["end_s"])
        joined = (spk == x["speaker_id"]) & (x["start_s"] - end < F.lit(merge_gap))
        return F.struct(
            x["emit_order"].alias("emit_order"), x["start_s"].alias("start_s"),
            x["speaker_id"].alias("speaker_id"), x["confidence"].alias("confidence"),
            end.alias("prev_end"), (~F.coalesce(joined, F.lit(False))).alias("fresh"),
        )

    bt = bt.withColumn("_heads", F.filter(F.transform("items", flag), lambda x: x["fresh"])).drop("items", "_tail", "_prev", "_end")
    bt = bt.withColumn("_head_prev", F.get("_heads", F.lit(0))["prev_end"])
    bt = carry(bt, keys, after={"_next_prev": "_head_prev"}, fan=fan)
    heads = bt.select(*keys, "_heads", "_next_prev", "_clip_end", F.posexplode("_heads").alias("_i", "_h"))
    end = F.coalesce(F.get("_heads", F.col("_i") + 1)["prev_end"], "_next_prev", "_clip_end")
    return heads.select(
        *keys,
        F.col("_h.start_s").alias("start_s"),
        end.alias("end_s"),
        F.col("_h.speaker_id").alias("speaker_id"),
        F.col("_h.confidence").alias("confidence"),
        F.col("_h.emit_order").alias("emit_order"),
    )


def diarize(
    class_scores: DataFrame,
    frames_per_window: int = FRAMES_PER_WINDOW,
    window_sec: float = WINDOW_SEC,
    merge_gap: float = 0.1,
    keys: Sequence[str] = KEYS,
    logits: str = "logits",
    fan: int = FAN,
) -> DataFrame:
    """Class scores per frame -> merged per-speaker segments.

    The decoded frames are exchanged once on (clip, window); runs and the per-window lists
    reuse that partitioning.
    """
    decoded = decode_classes(df=class_scores, logits=logits, keys=keys).repartition(*keys, "window_idx")
    runs = speaker_runs(expand_speakers(decoded), keys, frames_per_window, window_sec)
    return merge_adjacent(runs, merge_gap, keys, fan)
