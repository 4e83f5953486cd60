"""Inputs that Spark derives from the given tables.

Every derivation is row-local or groups a bounded number of rows, so the fixtures grow with
the tables: more rows give more clips, not longer ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES_PER_CLIP = 1_250
FRAMES_PER_WINDOW = 125
VECTORS_PER_CLIP = 25
CHUNK_FRAMES = 10
N_CLASSES = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_scores(spark: SparkSession, sf_dir: str, period: int = 61, on: int = 34) -> DataFrame:
    """clip_id, frame_idx, p: a square wave plus the noise in ``events.value``."""
    ev = table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {FRAMES_PER_CLIP}").alias("clip_id"),
        F.expr(f"event_id % {FRAMES_PER_CLIP}").alias("frame_idx"),
        "value",
    )
    high = (F.col("frame_idx") + 17 * F.col("clip_id")) % period < on
    level = F.when(high, F.lit(0.8)).otherwise(F.lit(0.15))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), level + (F.col("value") - 50) / 1000))
    return ev.select("clip_id", "frame_idx", p.alias("p"))


def long_wave_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a period long enough to close the 80-frame hang-over."""
    return frame_scores(spark, sf_dir, period=611, on=340)


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, window_idx, frame_idx (in window), w: integer weight of each class, with noise from ``events.value``."""
    f = F.col("f")
    ev = table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {FRAMES_PER_CLIP}").alias("clip_id"),
        F.expr(f"event_id % {FRAMES_PER_CLIP}").alias("f"),
        F.floor("value").cast("bigint").alias("v"),
    )
    turn = (F.expr("f div 23") + F.col("clip_id")) % N_CLASSES

    def weight(c: int):
        noise = (f * (c + 3) + 7 * c + F.col("clip_id") + F.col("v")) % 11
        return F.when(f % 97 == 0, F.lit(1)).otherwise(1 + noise + F.when(turn == c, 40).otherwise(0)).cast("double")

    return ev.select(
        "clip_id",
        F.expr(f"f div {FRAMES_PER_WINDOW}").alias("window_idx"),
        (f % FRAMES_PER_WINDOW).alias("frame_idx"),
        F.array(*[weight(c) for c in range(N_CLASSES)]).alias("w"),
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, window_idx, frame_idx, logits: log-probabilities of the seven classes."""
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return class_weights(spark, sf_dir).select(
        "clip_id", "window_idx", "frame_idx", F.transform("w", lambda x: F.log(x / total)).alias("logits")
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, samples: 25 consecutive vectors of 64 values joined to 1 600 samples."""
    parts = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.expr(f"vec_id div {VECTORS_PER_CLIP}").alias("clip_id"))
        .agg(F.flatten(F.transform(parts, lambda x: x["embedding"])).alias("samples"))
    )


def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_idx, mel: every vector as a feature frame of its clip."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {VECTORS_PER_CLIP}").alias("clip_id"),
        F.expr(f"vec_id % {VECTORS_PER_CLIP}").alias("frame_idx"),
        F.col("embedding").alias("mel"),
    )


def cut_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine overlapping, empty and out-of-range intervals per clip of ``clips``."""
    ids = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {VECTORS_PER_CLIP}").alias("clip_id")).distinct()
    k = F.col("k")
    return ids.select("clip_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))).alias("k")).select(
        "clip_id",
        k.alias("emit_order"),
        (k % 3).cast("int").alias("speaker_id"),
        ((k * 13).cast("double") / 1000).alias("start_s"),
        ((k * 13 + (k * 7) % 31).cast("double") / 1000).alias("end_s"),
    )


def chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK_FRAMES) -> DataFrame:
    """Frame scores as chunk rows: stream_id, seq, samples, sample_rate, end_of_stream."""
    ordered = F.sort_array(F.collect_list(F.struct("frame_idx", F.col("p").cast("float").alias("p"))))
    f = frame_scores(spark, sf_dir)
    ends = f.groupBy("clip_id").agg(F.expr(f"max(frame_idx) div {size}").alias("_last"))
    grouped = f.groupBy("clip_id", F.expr(f"frame_idx div {size}").alias("seq")).agg(F.transform(ordered, lambda x: x["p"]).alias("samples"))
    return grouped.join(ends, "clip_id").select(
        F.col("clip_id").alias("stream_id"), "seq", "samples",
        F.when(F.col("seq") == 0, 16_000).otherwise(0).alias("sample_rate"),
        (F.col("seq") == F.col("_last")).alias("end_of_stream"),
    )
