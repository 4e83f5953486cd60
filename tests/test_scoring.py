"""Scorer plumbing: parts with context, error isolation, carried state, hand-built graphs."""

import numpy as np
import onnx_bytes as ox
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_features import clip_table

from speechspark.operators import pcm, presets, scoring
from speechspark.operators import segmenting as seg


class Neighbours:
    """Depends on three frames each side; fails where a frame holds 99."""

    frames_per_output = 1

    def score(self, x):
        if (x == 99).any():
            raise RuntimeError("bad frame")
        pad = np.pad(x[:, 0], 3)
        return np.array([pad[i:i + 7].sum() for i in range(len(x))])


class Short(Neighbours):
    def score(self, x):
        return np.zeros(len(x) - 1)


def frame_table(spark, lengths):
    rng = np.random.default_rng(0)
    data = {c: rng.normal(size=(n, 4)).astype(np.float32) for c, n in enumerate(lengths)}
    rows = [(c, t, m[t].tolist()) for c, m in data.items() for t in range(len(m))]
    return data, spark.createDataFrame(rows, "clip_id bigint, frame_idx bigint, mel array<float>")


def by_clip(df):
    pdf = df.toPandas()
    return {c: g.sort_values("frame_idx") for c, g in pdf.groupby("clip_id")}


def test_parts_equal_whole_clip(spark):
    data, df = frame_table(spark, [1, 10, 75])
    got = by_clip(scoring.score_frames(df, Neighbours(), frames_per_part=16, context=4))
    for c, m in data.items():
        assert list(got[c].frame_idx) == list(range(len(m)))
        assert np.allclose(got[c].p.astype(float), Neighbours().score(m), atol=1e-5)


def test_errors_stay_with_their_part(spark):
    _, df = frame_table(spark, [10, 10])
    bad = df.withColumn("mel", F.when(F.expr("clip_id = 1 and frame_idx = 3"), F.array(*[F.lit(99.0).cast("float")] * 4)).otherwise(F.col("mel")))
    got = scoring.score_frames(bad, Neighbours())
    assert got.filter("clip_id = 0 and error is null").count() == 10
    assert [(r.clip_id, r.error) for r in got.filter("error is not null").collect()] == [(1, "RuntimeError: bad frame")]
    wrong = scoring.score_frames(df, Short()).select("error").distinct().collect()
    assert [r.error for r in wrong] == ["scorer returned 9 values for 10 frames"]


def test_onnx_frame_probs(spark):
    graph = ox.model(
        [ox.node("ReduceMean", ["feat"], ["m"], axes=[-1], keepdims=1), ox.node("Sigmoid", ["m"], ["probs"])],
        [("feat", (1, "T", 4))], [("probs", (1, "T", 1))],
    )
    data, df = frame_table(spark, [12, 30])
    got = by_clip(scoring.score_frames(df, scoring.FrameProbScorer(scoring.load_model(spark, graph))))
    for c, m in data.items():
        assert got[c].error.isna().all()
        assert np.allclose(got[c].p.astype(float), 1 / (1 + np.exp(-m.mean(axis=1))), atol=1e-5)


def test_onnx_recurrent_state_is_reset_per_clip(spark):
    graph = ox.model(
        [
            ox.node("ReduceSum", ["input"], ["s"], keepdims=1),
            ox.node("Add", ["state", "s"], ["stateN"]),
            ox.node("ReduceMax", ["stateN"], ["prob"], keepdims=0),
            ox.node("Identity", ["context"], ["contextN"]),
        ],
        [("input", (1, 64)), ("state", (2, 1, 4)), ("context", (1, 8))],
        [("prob", ()), ("stateN", (2, 1, 4)), ("contextN", (1, 8))],
    )
    clips, df = clip_table(spark, [640, 200, 64 * 30])
    chunks = pcm.chunk(pcm.pcm_blocks(df, 640), 64, "drop", 640)
    scorer = scoring.RecurrentScorer(graph, state_shape=(2, 1, 4), context=8)
    got = by_clip(scoring.score_chunks(chunks, scorer))
    for c, x in clips.items():
        n = len(x) // 64
        want = np.cumsum(x[: n * 64].reshape(n, 64).sum(axis=1))
        assert np.allclose(got[c].p, want, atol=1e-3)


def test_onnx_windows_and_pairs(spark):
    graph = ox.model(
        [ox.node("Identity", ["input_values"], ["logits"])], [("input_values", (1, 1, "W"))], [("logits", (1, 1, "W"))]
    )
    clips, df = clip_table(spark, [70])
    win = pcm.chunk(pcm.pcm_blocks(df, 64), 32, "pad", 64)
    out = scoring.score_windows(win, scoring.WindowClassScorer(graph)).toPandas().sort_values("window_idx")
    assert np.allclose(np.concatenate(list(out.logits))[:70], clips[0]) and len(out) == 3

    class Pair(scoring.PairLogitScorer):
        def __init__(self):
            pass

        class session:  # noqa: N801
            @staticmethod
            def run(_, feeds):
                x = feeds["audio_signal"]
                assert x.shape[:2] == (1, 4)
                return [np.stack([np.zeros(x.shape[2] // 2), x[0, 0, ::2]], axis=1)[None]]

        feed, fetch = "audio_signal", "logits"

    data, frames = frame_table(spark, [20, 90])
    got = by_clip(scoring.score_frames(frames, Pair(), frames_per_part=30, context=4))
    for c, m in data.items():
        assert np.allclose(got[c].p.astype(float), 1 / (1 + np.exp(-m[::2, 0].astype(float))), atol=1e-5)
        assert list(got[c].frame_idx) == list(range(len(m) // 2))


def test_model_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MAX_MODEL_BYTES", 3)
    with pytest.raises(ValueError):
        scoring.load_model(spark, b"1234")


def test_names_and_comparison(spark):
    asked = spark.createDataFrame([("vad_model_SILERO",), (" Firered",), ("nope",), ("unspecified",)], "requested string")
    assert {r.model for r in presets.select_models(asked, spark).collect()} == {"silero", "firered"}
    assert {r.model for r in presets.unknown_models(asked, spark).collect()} == {"nope", "unspecified"}
    frames = spark.createDataFrame([(0, i, 0.9) for i in range(30)], "clip_id int, frame_idx bigint, p double")

    def broken(_):
        raise RuntimeError("no weights")

    segs, res = scoring.compare_models(frames, {"silero": lambda d: seg.segment_frames(d, "silero"), "x": broken})
    assert {(r.model, r.error, r.n_segments) for r in res.collect()} == {("silero", None, 1), ("x", "no weights", 0)}
    assert segs.select("model").distinct().count() == 1


def test_from_samples_to_segments(spark):
    noise = np.random.default_rng(0).normal(0, 0.1, 16_000)
    x = np.concatenate([np.zeros(8_000), noise, np.zeros(16_000)])
    clips = spark.createDataFrame(pd.DataFrame({"clip_id": [0], "samples": [x.tolist()]}), "clip_id bigint, samples array<float>")
    from speechspark.operators import features as feat

    mel = feat.log_mel_kaldi(pcm.pcm_blocks(clips, 1_600), block_samples=1_600)
    scored = scoring.energy_score(mel, mid=-10.0)
    segs = seg.segment_frames(scored, "firered", block=128).collect()
    assert len(segs) == 1 and abs(segs[0].start_s - 0.5) < 0.1 and abs(segs[0].end_s - 1.5) < 0.1
