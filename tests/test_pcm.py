import numpy as np
import pytest
from test_features import clip_table

from speechspark.operators import pcm

LENGTHS = [1, 7, 64, 100, 1_000, 2_500]


def arrays(df, column="sample_idx"):
    pdf = df.toPandas()
    return {c: g.sort_values(column) for c, g in pdf.groupby("clip_id")}


@pytest.mark.parametrize("block", [64, 640, 160_000])
def test_blocks_and_bytes(spark, block):
    clips, df = clip_table(spark, LENGTHS)
    raw = df.select("clip_id", pcm.encode_f32("samples").alias("pcm"))
    for source in (df, raw):
        got = arrays(pcm.to_long(pcm.pcm_blocks(source, block), block))
        for c, x in clips.items():
            assert np.array_equal(got[c].x.to_numpy(np.float32), x)


@pytest.mark.parametrize("block", [640, 160_000])
def test_chunks(spark, block):
    clips, df = clip_table(spark, LENGTHS)
    b = pcm.pcm_blocks(df, block)
    for tail in ("keep", "drop", "pad"):
        got = arrays(pcm.chunk(b, 64, tail, block), "chunk_idx")
        for c, x in clips.items():
            parts = [x[i:i + 64] for i in range(0, len(x), 64)]
            if tail == "drop":
                parts = [p for p in parts if len(p) == 64]
            if tail == "pad":
                parts = [np.pad(p, (0, 64 - len(p))) for p in parts]
            if not parts:
                assert c not in got
                continue
            assert [list(np.float32(v)) for v in got[c].samples] == [list(p) for p in parts]
            if tail != "drop":
                assert list(got[c].end_of_stream) == [False] * (len(parts) - 1) + [True]
    with pytest.raises(ValueError):
        pcm.chunk(b, 7, "keep", block)


def test_envelope_covers_every_sample(spark):
    clips, df = clip_table(spark, [3, 10, 48, 1_000, 1_357])
    got = arrays(pcm.envelope(pcm.pcm_blocks(df, 100), 48, 100), "bucket")
    for c, x in clips.items():
        per = len(x) / 48
        assert len(got[c]) == 48
        for k, lo, hi in zip(got[c].bucket, got[c].lo, got[c].hi):
            part = x[int(k * per): min(len(x), int((k + 1) * per))]
            assert (np.float32(lo), np.float32(hi)) == (min(0, part.min(initial=0)), max(0, part.max(initial=0)))


@pytest.mark.parametrize("src,block", [(24_000, 64), (44_100, 640), (8_000, 64), (48_000, 100)])
def test_resample_is_independent_of_blocks(spark, src, block):
    clips, df = clip_table(spark, [700, 1_500], 5)
    up, down = {24_000: (2, 3), 44_100: (160, 441), 8_000: (2, 1), 48_000: (1, 3)}[src]
    half = 10 * max(up, down)
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / max(up, down)) * np.kaiser(len(n), 5.0)
    taps *= up / taps.sum()
    got = arrays(pcm.resample(pcm.pcm_blocks(df, block), src, block_samples=block), "first_sample")
    for c, x in clips.items():
        y = np.concatenate(list(got[c].samples))
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        want = np.convolve(wide, taps)[half::down][: -(-len(x) * up // down)]
        assert len(y) == len(want) and np.abs(y - want).max() < 1e-5


def test_decimate_and_mono(spark):
    clips, df = clip_table(spark, [900], 6)
    x = clips[0]
    got = arrays(pcm.decimate(pcm.pcm_blocks(df, 64), 44_100, 64))[0]
    acc, kept = 0, []
    for v in x:  # accumulate in 1/16000 units, so that nothing is rounded
        acc += 16_000
        if acc >= 44_100:
            kept.append(v)
            acc -= 44_100
    assert list(got.x.to_numpy(np.float32)) == kept and list(got.sample_idx) == list(range(len(kept)))
    mono = arrays(pcm.to_long(pcm.mono_mix(pcm.pcm_blocks(df, 64)), 32))[0]
    assert np.allclose(mono.x, x.reshape(-1, 2).mean(axis=1), atol=1e-7)
