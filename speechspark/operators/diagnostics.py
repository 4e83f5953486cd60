"""Frame diagnostics over class scores; every window group is one analysis window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechspark.functions.numeric import argmax, duration, entropy_bits
from speechspark.operators.powerset import CLASS_LABELS, FRAMES_PER_WINDOW, WINDOW_SEC

KEYS = ("clip_id",)


def probabilities(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("probs", F.transform(logits, lambda x: F.exp(x.cast("double"))))


def _speech(probs: str = "probs") -> Column:
    return F.slice(probs, 2, len(CLASS_LABELS) - 1)


def frame_time(frames_per_window: int = FRAMES_PER_WINDOW, window_sec: float = WINDOW_SEC) -> Column:
    step = F.lit(window_sec / frames_per_window)
    return F.col("window_idx").cast("double") * F.lit(window_sec) + F.col("frame_idx").cast("double") * step


def labelled(probs: str = "probs", above: float = 0.01) -> Column:
    """Map label -> probability of the classes above a level."""
    labels = F.array(*[F.lit(x) for x in CLASS_LABELS])
    return F.map_filter(F.map_from_arrays(labels, F.col(probs)), lambda k, v: v > above)


def active_frames(df: DataFrame, level: float = 0.1, list_above: float = 0.01) -> DataFrame:
    """Frames with any speech class above ``level``, with the classes worth listing."""
    return (
        probabilities(df)
        .filter(F.exists(_speech(), lambda x: x > level))
        .withColumn("listed", labelled(above=list_above))
    )


def class_transitions(df: DataFrame, keys: Sequence[str] = KEYS, frames_per_window=FRAMES_PER_WINDOW) -> DataFrame:
    """Frames whose winning class differs from the frame before; the first always counts."""
    w = Window.partitionBy(*keys, "window_idx").orderBy("frame_idx")
    return (
        df.select(*keys, "window_idx", "frame_idx", argmax("logits").alias("cls"),
                  F.exp(F.array_max("logits").cast("double")).alias("p"))
        .withColumn("_was", F.lag("cls", 1, -1).over(w))
        .filter("cls <> _was")
        .drop("_was")
        .withColumn("time_s", frame_time(frames_per_window))
    )


def overlap_frames(df: DataFrame) -> DataFrame:
    """Frames where several speakers overlap or compete."""
    d = probabilities(df)
    overlap = F.exists(F.slice("probs", 4, 4), lambda x: x > 0.08)
    rivals = F.size(F.filter(_speech(), lambda x: x > 0.05))
    return d.withColumn("n_rivals", rivals).filter(overlap | ((rivals >= 2) & (F.col("probs")[0] < 0.85)))


def window_summary(df: DataFrame, keys: Sequence[str] = KEYS, frames_per_window=FRAMES_PER_WINDOW) -> DataFrame:
    """Silence share, strongest speech frame (the first one on a tie) and mean entropy."""
    d = probabilities(df).select(
        *keys, "window_idx", "frame_idx",
        (argmax("logits") == 0).cast("int").alias("_sil"),
        F.array_max(_speech()).alias("_top"),
        entropy_bits("probs").alias("_ent"),
    )
    best = F.max(F.struct(F.col("_top").alias("p"), (-F.col("frame_idx")).alias("neg")))
    return (
        d.groupBy(*keys, "window_idx")
        .agg(
            F.sum("_sil").alias("silence_frames"),
            (F.sum("_sil") / F.lit(float(frames_per_window)) * 100.0).alias("silence_pct"),
            best.alias("_b"),
            (F.sum("_ent") / F.lit(float(frames_per_window))).alias("mean_entropy"),
        )
        .select(
            *keys, "window_idx", "silence_frames", "silence_pct",
            F.col("_b.p").alias("max_speech_p"), (-F.col("_b.neg")).alias("max_speech_frame"), "mean_entropy",
        )
    )


def every_nth(df: DataFrame, n: int = 20) -> DataFrame:
    """Systematic sample: the first of every ``n`` frames of a window."""
    return probabilities(df).filter(F.col("frame_idx") % n == 0)


def top_frames(df: DataFrame, k: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k frames of each window with the strongest speech class; earlier frames first on a tie."""
    w = Window.partitionBy(*keys, "window_idx").orderBy(F.col("best_p").desc(), F.col("frame_idx"))
    d = probabilities(df).select(
        *keys, "window_idx", "frame_idx",
        F.array_max(_speech()).alias("best_p"), (argmax(_speech()) + 1).alias("best_cls"),
    )
    return d.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("best_p") > 0))


def window_inventory(blocks: DataFrame, window: int = 160_000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples, seconds and number of analysis windows per clip; empty clips have none of each.

    Every block knows its clip's length, so the first one tells all and nothing is exchanged.
    """
    n = blocks.filter("block_idx = 0").select(*keys, "n_samples")
    return n.withColumn("duration_s", duration("n_samples")).withColumn(
        "n_windows", F.expr(f"(n_samples + {window - 1}) div {window}")
    )
