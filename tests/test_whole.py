"""Nothing is dropped, bridged or split: long clips, holes, failures, empty clips, block edges."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from speechspark.operators import detect, diagnostics, pcm, scoring, segments
from speechspark.operators import features as feat
from speechspark.operators import segmenting as seg
from speechspark.sources import pcm as src


def clip_frames(spark, arrays):
    rows = [(c, t, float(p)) for c, x in arrays.items() for t, p in enumerate(x)]
    return spark.createDataFrame(rows, "clip_id bigint, frame_idx bigint, p double")


@pytest.mark.parametrize("block,fan", [(8, 2), (13, 3), (64, 2), (1_000, 4)])
def test_back_fill_never_overlaps_at_any_block_edge(spark, block, fan):
    """Random scores with segments over several blocks, and a back-fill longer than the pause."""
    rng = np.random.default_rng(block)
    prm = seg.SegmentParams(step_ms=10, on=0.5, min_on=2, min_off=3, backfill=12)
    arrays = {}
    for c in range(6):
        x, level = [], 0.9
        while len(x) < 400:
            x += [level] * int(rng.integers(1, 60 if level > 0.5 else 12))
            level = 0.1 if level > 0.5 else 0.9
        arrays[c] = np.array(x)
    arrays[6] = np.array([0.1] * 40 + [0.9] * 53 + [0.1] * 4 + [0.9] * 40 + [0.1] * 10)
    got = seg.segment_frames(clip_frames(spark, arrays), prm, block=max(block, prm.back + 1), fan=fan)
    got = {c: [] for c in arrays} | {
        c: sorted(zip(g.start_frame, g.end_frame)) for c, g in got.toPandas().groupby("clip_id")}
    for c, x in arrays.items():
        mine = [(int(a), int(b)) for a, b in got[c]]
        assert mine == [tuple(map(int, s[:2])) for s in plain.segments(x, prm)]
        assert all(b <= a2 for (_, b), (a2, _) in zip(mine, mine[1:]))


def test_missing_frames_are_not_bridged(spark):
    x = np.full(40, 0.9)
    df = clip_frames(spark, {0: x, 1: x, 2: x}).filter("not (clip_id = 1 and frame_idx between 2 and 7)")
    df = df.withColumn("p", F.when((F.col("clip_id") == 2) & (F.col("frame_idx") == 39), None).otherwise(F.col("p")))
    got = seg.segment_frames(df, "silero", block=16).select("clip_id", "start_frame", "end_frame").collect()
    assert [tuple(r) for r in got] == [(0, 0, 40)]
    assert [tuple(r) for r in seg.incomplete_clips(df).collect()] == [(1, 6, "6 of 40 frames are missing")]


def test_one_record_per_clip(spark):
    clips = spark.createDataFrame([(0, 9_000.0), (1, 5.0)], "clip_id bigint, duration_s double")
    rows = [(0, k * 1_000, k * 1.0, k + 0.5, 0, 1.0) for k in range(6_000)]
    segs = spark.createDataFrame(rows, "clip_id bigint, emit_order bigint, start_s double, end_s double, speaker_id int, confidence float")
    got = {r.clip_id: r for r in segments.nest(clips, segs.repartition(7)).collect()}
    assert set(got) == {0, 1} and got[1].segments == []
    assert [s.start_s for s in got[0].segments] == [float(k) for k in range(6_000)]


class Fragile:
    frames_per_output = 1

    def __init__(self, context):
        self.context = context

    def score(self, features):
        if (features == 99).any():
            raise RuntimeError("no")
        return np.convolve(features[:, 0], [1, 1, 1], "same")


@pytest.mark.parametrize("context", [1, None])
def test_a_failing_part_fails_its_clip_once(spark, context):
    rng = np.random.default_rng(1)
    arrays = {c: rng.integers(0, 9, n).astype(float) for c, n in ((0, 100), (1, 64), (2, 90), (3, 20))}
    arrays[2][70] = 99
    arrays[2][12] = 99
    df = clip_frames(spark, arrays).select("clip_id", "frame_idx", F.array(F.col("p").cast("float")).alias("mel"))
    out = scoring.score_frames(df, Fragile(context), frames_per_part=16).toPandas()
    bad = out[out.error.notna()]
    assert list(bad.clip_id) == [2] and bad.frame_idx.isna().all() and bad.error.iloc[0] == "RuntimeError: no"
    for c in (0, 1, 3):
        mine = out[out.clip_id == c].sort_values("frame_idx")
        assert list(mine.frame_idx) == list(range(len(arrays[c])))
        assert np.allclose(mine.p, np.convolve(arrays[c], [1, 1, 1], "same"))
    assert len(out[out.clip_id == 2]) == 1


def test_chunk_scores_stop_at_a_failure(spark):
    class Steps:
        def start(self):
            return 0

        def step(self, x, carried):
            if x[0] < 0:
                raise ValueError("bad chunk")
            return carried / 10, carried + 1

    rows = [(c, k, [-1.0 if (c, k) == (1, 2) else 1.0]) for c in range(2) for k in range(4)]
    out = scoring.score_chunks(spark.createDataFrame(rows, "clip_id bigint, chunk_idx bigint, samples array<float>"), Steps()).toPandas()
    assert list(out[out.clip_id == 1].sort_values("frame_idx").error.fillna("")) == ["", ""] + ["ValueError: bad chunk"] * 2
    assert out[out.clip_id == 0].error.isna().all()
    assert list(seg.incomplete_clips(out_frames := spark.createDataFrame(out.drop(columns="error"))).collect()) == []
    assert seg.segment_frames(out_frames, seg.SegmentParams(step_ms=1, on=0.0, min_on=1, min_off=1)).select("clip_id").distinct().collect()[0][0] == 0


def test_empty_clips_stay(spark):
    df = spark.createDataFrame([(0, [0.5] * 10), (1, []), (2, None)], "clip_id bigint, samples array<float>")
    for source in (df, df.select("clip_id", pcm.encode_f32("samples").alias("pcm"))):
        blocks = pcm.pcm_blocks(source, 4)
        got = {r.clip_id: (r.n_samples, r.duration_s, r.n_windows) for r in diagnostics.window_inventory(blocks, 4).collect()}
        assert got == {0: (10, 10 / 16_000, 3), 1: (0, 0.0, 0), 2: (0, 0.0, 0)}
        assert pcm.to_long(blocks, 4).count() == 10
        env = pcm.envelope(blocks, 3, 4).filter("clip_id > 0").collect()
        assert len(env) == 6 and all(r.lo == r.hi == 0 for r in env)
        assert feat.frames(blocks, 4, 2, 4).select("clip_id").distinct().count() == 1


def test_empty_oversized_and_nested_files(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for name, size in (("a", 40), ("empty", 0), ("big", 4_000), ("sub/a", 8), ("sub/none", 0)):
        (tmp_path / f"{name}-16k.f32").write_bytes(b"\0" * size)
    (tmp_path / "empty.txt").write_bytes(b"")
    monkeypatch.setattr(src, "MAX_CLIP_BYTES", 1_000)
    flat = src.validate_clips(src.read_pcm(spark, str(tmp_path)))
    assert {r.clip_id: r.error for r in flat.collect()} == {"a": None, "empty": src.MSG_EMPTY, "big": src.MSG_LARGE}
    deep = src.read_pcm(spark, str(tmp_path), recursive=True)
    assert {r.clip_id for r in deep.collect()} == {"a", "empty", "big", "sub/a", "sub/none"}


def test_the_file_does_not_travel_with_its_blocks(spark, tmp_path):
    clips = spark.createDataFrame([(0, bytes(4_000))], "clip_id bigint, pcm binary")
    plan = pcm.pcm_blocks(clips, 100)._jdf.queryExecution().executedPlan().toString()
    generate = next(x for x in plan.split("\n") if "Generate posexplode" in x)
    assert generate.split("lambda", 1)[1].rsplit("[clip_id", 1)[1].count("pcm") == 0
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow")
    (tmp_path / "m.f32").write_bytes(bytes(4_800))
    rows = src.read_f32_matrix(spark, str(tmp_path), 3, rows_per_part=10)
    assert rows.count() == 400 and rows.agg(F.max("row_idx")).first()[0] == 399


def test_context_is_never_cut_short(spark):
    b = pcm.pcm_blocks(spark.createDataFrame([(0, [0.0] * 20)], "clip_id bigint, samples array<float>"), 4)
    with pytest.raises(ValueError, match="longer than"):
        pcm.with_context(b, pcm.CONTEXT + 1, 0)
    with pytest.raises(ValueError, match="longer than"):
        pcm.with_context(pcm.without_context(b), 6, 0, block_samples=4)


def test_equal_segments_are_all_matched(spark):
    kind = "clip_id bigint, speaker_id int, start_s double, end_s double"
    a = spark.createDataFrame([(0, 0, 1.0, 2.0)] * 2 + [(0, 0, 30.0, 31.0)] * 3, kind)
    b = spark.createDataFrame([(0, 0, 1.0, 2.0)] * 3 + [(0, 0, 90.0, 95.0)], kind)
    got = segments.match_segments(a, b).groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in got} == {"both": 6, "a_only": 3, "b_only": 1}


def test_decimate_and_envelope_over_block_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1_003).astype(np.float32)
    df = spark.createDataFrame([(0, x.tolist())], "clip_id bigint, samples array<float>")
    for block in (7, 100, 5_000):
        blocks = pcm.pcm_blocks(df, block)
        got = pcm.decimate(blocks, 44_100, block).orderBy("sample_idx").toPandas()
        keep = [i for i in range(len(x)) if (i + 1) * 16_000 // 44_100 > i * 16_000 // 44_100]
        assert list(got.sample_idx) == list(range(len(keep))) and np.array_equal(got.x.to_numpy(np.float32), x[keep])
        env = pcm.envelope(blocks, 37, block).orderBy("bucket").toPandas()
        edge = [int(np.floor(k * (len(x) / 37.0))) for k in range(38)]
        want = [(min(0, x[a:b].min()), max(0, x[a:b].max())) for a, b in zip(edge, edge[1:])]
        assert np.allclose(env[["lo", "hi"]].to_numpy(), np.array(want))


def test_detect_with_a_plugged_in_scorer(spark):
    class Loud:
        frames_per_output, context = 1, 0

        def score(self, features):
            if features.max() > 20:
                raise ValueError("overload")
            return (features.max(axis=1) > -2).astype(np.float32)

    t = np.arange(16_000)
    tone = np.where((t > 4_000) & (t < 9_000), 0.5 * np.sin(t / 3), 0).astype("<f4")
    clips = [(0, tone.tobytes(), 16_000), (1, (tone * 1e6).astype("<f4").tobytes(), 16_000), (2, b"", 16_000), (3, b"\0" * 400, 0), (4, tone.tobytes(), 8_000)]
    df = spark.createDataFrame(clips, "clip_id bigint, pcm binary, sample_rate int")
    got = {r.clip_id: r for r in detect.detect(df, seg.SegmentParams(step_ms=10, on=0.5, min_on=3, min_off=3), feat.KaldiOptions(), Loud()).collect()}
    assert got[1].error == "ValueError: overload" and got[1].segments == []
    assert got[2].error == src.MSG_EMPTY and got[3].error == detect.MSG_SHORT and "8000" in got[4].error
    (only,) = got[0].segments
    assert 0.2 <= only.start_s <= 0.26 and 0.55 <= only.end_s <= 0.6 and got[0].error is None
