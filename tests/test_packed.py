"""Packed frames against one row per frame, with clips that end anywhere in their blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechspark.operators import packed
from speechspark.operators import segmenting as seg

MODELS = {
    "plain": seg.SegmentParams(step_ms=10, on=0.5), "silero": seg.resolve("silero"), "marblenet": seg.resolve("marblenet"),
    "firered": seg.resolve("firered", backfill=30), "smooth": seg.SegmentParams(step_ms=10, on=0.6, off=0.3, min_on=3, min_off=4, smooth=3),
    "vote": seg.SegmentParams(step_ms=10, on=0.4, invert=True, vote_half=6, vote_need=7, min_off=9),
}
COLUMNS = ["clip_id", "model", "start_frame", "end_frame", "start_s", "end_s"]


def frames(spark, lengths, seed=1, values=None):
    rng = np.random.default_rng(seed)
    rows = []
    for clip, n in enumerate(lengths):
        level = np.repeat(rng.random(n // 7 + 1) > 0.5, rng.integers(1, 25, n // 7 + 1))[:n]
        level = np.resize(level if len(level) else [True], n)
        p = np.clip(np.where(level, 0.75, 0.2) + rng.normal(0, 0.2, n), 0, 1)
        rows += [(clip, i, float(x)) for i, x in enumerate(p)]
    rows += values or []
    return spark.createDataFrame(rows, "clip_id long, frame_idx long, p double")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("block", [90, 128, 1000])
def test_same_segments_as_one_row_per_frame(spark, block):
    edge = [1, 2, 5, 30, block - 1, block, block + 1, block + 20, 2 * block - 10, 2 * block, 2 * block + 44, 2 * block + 46, 700, 1501]
    df = frames(spark, edge)
    blocks = packed.pack_frames(df, block=block)
    got = rows_of(packed.segment_packed(blocks, MODELS, block=block, fan=3))
    assert got == rows_of(seg.segment_models(df, MODELS, block=block, fan=3))
    assert {m for _, m, *_ in got} == set(MODELS)


def test_holes_nulls_and_odd_values(spark):
    """A clip with a hole, a null or a missing block has no segments; NaN counts as the largest score."""
    df = frames(spark, [300, 300, 300, 300, 300], values=[(9, 0, math.nan), (9, 1, math.nan), (9, 2, 0.1)])
    df = df.filter("not (clip_id = 1 and frame_idx = 150) and not (clip_id = 2 and frame_idx between 90 and 179)")
    df = df.filter("not (clip_id = 4 and frame_idx < 90)").withColumn("p", F.when(F.expr("clip_id = 3 and frame_idx = 91"), None).otherwise(F.col("p")))
    models = {"a": seg.SegmentParams(step_ms=10, on=0.5, min_on=2, min_off=2, smooth=2)}
    got = rows_of(packed.segment_packed(packed.pack_frames(df, block=90), models, block=90))
    assert got == rows_of(seg.segment_models(df, models, block=90))
    assert {r[0] for r in got} == {0, 9}


def test_empty_blocks_tables_and_repeats(spark):
    schema = "clip_id string, block_idx long, p array<float>"
    models = {"a": seg.SegmentParams(step_ms=10, on=0.5)}
    df = spark.createDataFrame([("x", 0, [0.9, 0.1, 0.9]), ("y", 0, []), ("z", 0, None), (None, 0, [0.9])], schema)
    assert sorted((r["clip_id"] or "", r["start_frame"], r["end_frame"]) for r in packed.segment_packed(df, models, block=3).collect()) == [
        ("", 0, 1), ("x", 0, 1), ("x", 2, 3)]
    assert packed.segment_packed(df.limit(0), models).collect() == []
    assert packed.segment_packed(df.filter("clip_id = 'x'").unionAll(df.filter("clip_id = 'x'")), models, block=3).collect() == []
    with pytest.raises(ValueError):
        packed.segment_packed(df, ["fsmn"], block=100)


def test_no_exchange_of_frames(spark):
    """Frames that arrive packed are read by one Arrow job; what is exchanged has no scores but those of edges."""
    df = spark.range(4).select(
        F.lit(1).alias("clip_id"), F.col("id").alias("block_idx"), F.transform(F.sequence(F.lit(0), F.lit(32_767)), lambda i: (i % 50) / 50.0).alias("p"))
    out = packed.segment_packed(df, ["marblenet"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
    path = packed.packed_switches(df, {"m": seg.PRESETS["marblenet"]}, "p", ["clip_id"], 32_768)
    assert path.agg(F.sum("_rows")).first()[0] == 4 * 32_768
