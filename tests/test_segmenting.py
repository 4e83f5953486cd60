"""Window segmenter against a plain search, with one clip holding most frames."""

import numpy as np
import pandas as pd
import plain
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechspark.functions import blocks
from speechspark.operators import segmenting as seg

PARAMS = {
    **seg.PRESETS,
    "clamped": seg.SegmentParams(step_ms=10, on=0.5, min_on=3, min_off=2, backfill=15, smooth=2),
    "short": seg.SegmentParams(step_ms=10, on=0.5, min_on=1, min_off=1),
    "two": seg.SegmentParams(step_ms=10, on=0.5, min_on=1, min_off=1, entry_untested=True),
    "fsmn_fast": seg.resolve("fsmn", min_off=9, on=0.45),
}


def series(rng, n):
    """Random walk between speech-like and silence-like stretches."""
    out = np.empty(0)
    while len(out) < n:
        level = rng.choice([0.05, 0.35, 0.45, 0.55, 0.9])
        out = np.append(out, level + rng.normal(0, 0.12, rng.integers(1, 60)))
    return np.clip(out[:n], 0, 1)


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(7)
    lengths = [1, 3, 40, 64, 65, 200, 1500]  # the last clip holds most frames
    clips = {c: series(rng, n) for c, n in enumerate(lengths)}
    rows = pd.concat([pd.DataFrame({"clip_id": c, "frame_idx": np.arange(len(p)), "p": p}) for c, p in clips.items()])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1)).cache()
    return clips, df


@pytest.mark.parametrize("block,fan", [(128, 2), (512, 3), (blocks.BLOCK, blocks.FAN)])
def test_all_models_in_one_pass(frames, block, fan):
    clips, df = frames
    got = seg.segment_models(df, PARAMS, block=block, fan=fan).toPandas()
    for name, prm in PARAMS.items():
        for c, p in clips.items():
            mine = got[(got.clip_id == c) & (got.model == name)].sort_values("start_frame")
            assert list(zip(mine.start_frame, mine.end_frame)) == plain.segments(p, prm), (name, c)


@pytest.mark.parametrize("name", ["silero", "marblenet", "fsmn_fast"])
def test_state_and_transitions(frames, name):
    clips, df = frames
    state = seg.speech_state(df, PARAMS[name], block=128, fan=2)
    moves = seg.backdate(seg.transitions(state, block=128), PARAMS[name]).toPandas()
    prm = PARAMS[name]
    for c, p in clips.items():
        want = plain.segments(p, prm)
        m = moves[moves.clip_id == c].sort_values("frame_idx")
        ends = [e for s, e in want if e < len(p)]
        assert list(m[m.speech == 1].boundary_frame) == [s for s, _ in want]
        assert list(m[m.speech == 0].boundary_frame)[: len(ends)] == ends


def test_framed_equals_whole_window(frames):
    _, df = frames
    whole = Window.partitionBy("clip_id").orderBy("frame_idx")
    a = seg.boxcar(df, 5, block=32).select("clip_id", "frame_idx", F.round("p_mean", 9).alias("v"))
    b = df.select("clip_id", "frame_idx", F.round(F.avg("p").over(whole.rowsBetween(-4, 0)), 9).alias("v"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_number_rows_and_carry(frames):
    _, df = frames
    got = blocks.number_rows(df, ["clip_id"], "frame_idx", "nr", block=16, fan=2)
    assert got.filter("nr <> frame_idx").count() == 0 and got.count() == df.count()


def test_halo_must_fit():
    with pytest.raises(ValueError):
        blocks.with_halo(None, "i", back=9, block=8)
    with pytest.raises(ValueError):
        seg.SegmentParams(step_ms=10, on=0.3, off=0.5)


def test_silence_and_full_speech(spark):
    rows = [(c, i, v) for c, v in ((0, 0.0), (1, 1.0)) for i in range(300)]
    df = spark.createDataFrame(rows, "clip_id int, frame_idx bigint, p double")
    got = seg.segment_frames(df, "silero", block=64).collect()
    assert [(r.clip_id, r.start_frame, r.end_frame) for r in got] == [(1, 0, 300)]
