import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_features import clip_table

from speechspark.operators import pcm, segments


def some_segments(spark, rng, clips, n=40):
    rows = []
    for c, x in clips.items():
        dur = len(x) / 16_000
        for k in range(n):
            s = float(rng.uniform(-0.01, dur * 1.1))
            rows.append((c, k, int(rng.integers(0, 3)), s, s + float(rng.uniform(0, dur / 2)) * (k % 7 > 0)))
    return spark.createDataFrame(rows, "clip_id bigint, emit_order bigint, speaker_id int, start_s double, end_s double"), rows


@pytest.mark.parametrize("block", [100, 160_000])
def test_cut_and_mask(spark, block):
    clips, df = clip_table(spark, [50, 730, 3_000])
    b = pcm.pcm_blocks(df, block)
    segs, rows = some_segments(spark, np.random.default_rng(1), clips)
    cut = segments.cut_segments(b, segs, block_samples=block).toPandas()
    masked = segments.mask_streams(b, segs, block_samples=block).toPandas()
    for c, x in clips.items():
        streams = {s: np.zeros(len(x), np.float32) for _, _, s, *_ in [r for r in rows if r[0] == c]}
        number = {}
        for _, _, spk, s, e in [r for r in rows if r[0] == c]:
            a, z = max(int(s * 16_000), 0), min(int(e * 16_000), len(x))
            if a >= z:
                continue
            streams[spk][a:z] = x[a:z]
            k = number.get(spk, 0)
            number[spk] = k + 1
            m = cut[(cut.clip_id == c) & (cut.speaker_id == spk) & (cut.segment_idx == k)].sort_values("piece_idx")
            assert np.array_equal(np.concatenate(list(m.samples)).astype(np.float32), x[a:z])
        assert len(cut[cut.clip_id == c].groupby(["speaker_id", "segment_idx"])) == sum(number.values())
        for spk, want in streams.items():
            m = masked[(masked.clip_id == c) & (masked.speaker_id == spk)].sort_values("block_idx")
            assert np.array_equal(np.concatenate(list(m.samples)).astype(np.float32), want)


def test_match_segments_brute_force(spark):
    rng = np.random.default_rng(4)

    def side(seed):
        starts = np.sort(rng.uniform(0, 300, 60))
        return [(0, 0, float(s), float(s + rng.uniform(0.1, 25))) for s in starts]

    a, b = side(0), side(1)
    ddl = "clip_id int, speaker_id int, start_s double, end_s double"
    got = segments.match_segments(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), bucket_s=7.0).toPandas()
    pairs = {(x[2], y[2]) for x in a for y in b if max(x[2], y[2]) < min(x[3], y[3])}
    both = got[got.side == "both"]
    assert len(both) == len(pairs) and set(zip(both.a_start, both.b_start)) == pairs
    assert set(got[got.side == "a_only"].a_start) == {x[2] for x in a} - {p[0] for p in pairs}
    assert set(got[got.side == "b_only"].b_start) == {x[2] for x in b} - {p[1] for p in pairs}


@pytest.mark.parametrize("kind", ["spread", "ties", "zeros", "one", "narrow"])
def test_exact_rank(spark, kind):
    rng = np.random.default_rng(2)
    v = {
        "spread": np.exp(rng.normal(0, 9, 3_000)), "ties": rng.integers(0, 5, 2_000).astype(float),
        "zeros": np.zeros(500), "one": np.array([3.5]), "narrow": 1 + rng.random(4_000) * 1e-9,
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"d": v}))
    for q in (0.0, 0.5, 0.99, 1.0):
        r = segments.exact_rank(df, "d", q).collect()[0]
        assert (r.n, r.v_max, r.v_rank) == (len(v), v.max(), np.sort(v)[int((len(v) - 1) * q)])


def test_parity_reports_missing_rows(spark):
    a = spark.range(100).select(F.col("id").alias("i"), F.lit(1.0).alias("value"))
    r = segments.compare_tables(a, a.filter("i > 0"), ["i"]).collect()[0]
    assert (r.n_unmatched, r.max_abs, r.passed) == (1, 0.0, False)


def test_summary_keeps_silent_runs(spark):
    runs = spark.createDataFrame([(1, "m", 10.0), (2, "m", 0.0)], "clip_id int, model string, duration_s double")
    segs = spark.createDataFrame([(1, "m", 1.0, 3.5, 0)], "clip_id int, model string, start_s double, end_s double, speaker_id int")
    out = {r.clip_id: (r.n_segments, r.speech_s, r.speech_pct) for r in segments.summarize(runs, segs).collect()}
    assert out == {1: (1, 2.5, 25.0), 2: (0, 0.0, 0.0)}
