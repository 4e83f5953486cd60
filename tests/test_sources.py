import io
import json
import os
import wave

import numpy as np
import pytest
from test_features import clip_table

from speechspark.operators import pcm, segments
from speechspark.sources import pcm as src
from speechspark.sources import sinks


def test_read_pcm_filters_and_splits(spark, tmp_path):
    x = np.linspace(-1, 1, 700, dtype="<f4")
    (tmp_path / "a-16k.f32").write_bytes(x.tobytes())
    (tmp_path / "b-16k.f32").write_bytes(x.tobytes() + b"\0\0")
    (tmp_path / "notes.txt").write_text("no audio")
    clips = src.validate_clips(src.read_pcm(spark, str(tmp_path)))
    good, bad = src.split_failures(clips)
    assert {r.clip_id: r.error for r in bad.collect()} == {
        "b": "samples length 2802 is not a multiple of 4 (expected float32 little-endian)"
    }
    long = pcm.to_long(pcm.pcm_blocks(good, 100), 100).orderBy("sample_idx").toPandas()
    assert set(long.clip_id) == {"a"} and np.array_equal(long.x.to_numpy(np.float32), x)
    loose = src.validate_clips(src.read_pcm(spark, str(tmp_path)), strict=False)
    assert loose.filter("error is null").count() == 2


def test_matrix_files(spark, tmp_path):
    m = np.arange(30, dtype="<f4").reshape(10, 3)
    (tmp_path / "m.f32").write_bytes(m.tobytes())
    (tmp_path / "odd.f32").write_bytes(b"\0" * 8)
    (tmp_path / "m.meta.json").write_text(json.dumps({"shape": [10, 3]}, indent=1))
    got = src.read_f32_matrix(spark, str(tmp_path), 3, rows_per_part=4).toPandas()
    rows = got[got.name == "m.f32"].sort_values("row_idx")
    assert np.array_equal(np.stack(rows.row), m)
    assert list(got[got.name == "odd.f32"].error) == ["length 8 is not a multiple of 12"]
    assert src.read_matrix_meta(spark, str(tmp_path), "shape array<int>").collect()[0].shape == [10, 3]


def test_raw_export_and_parquet_sinks(spark, tmp_path):
    clips, df = clip_table(spark, [500])
    b = pcm.pcm_blocks(df, 100)
    segs = spark.createDataFrame(
        [(0, 0, 1, 0.001, 0.02), (0, 1, 1, 0.021, 0.03)], "clip_id bigint, emit_order bigint, speaker_id int, start_s double, end_s double"
    )
    pieces = segments.cut_segments(b, segs, block_samples=100)
    sinks.write_speaker_chunks(pieces, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert {r.file_name for r in back.select("file_name").distinct().collect()} == {"0-speaker1-segment0.f32", "0-speaker1-segment1.f32"}
    os.mkdir(tmp_path / "raw")
    sinks.export_raw(back, str(tmp_path / "raw"), "piece_idx")
    assert sorted(os.listdir(tmp_path / "raw")) == ["0-speaker1-segment0.f32", "0-speaker1-segment1.f32"]
    assert np.array_equal(np.fromfile(tmp_path / "raw" / "0-speaker1-segment0.f32", "<f4"), clips[0][16:320])
    streams = segments.mask_streams(b, segs, block_samples=100)
    sinks.write_speaker_streams(streams, str(tmp_path / "streams"))
    assert spark.read.parquet(str(tmp_path / "streams")).filter("file_name = '0-speaker1.f32'").count() == 5


@pytest.mark.parametrize("block", [100, 160_000])
def test_wav(spark, block):
    clips, df = clip_table(spark, [333])
    parts = sinks.export_wav(pcm.pcm_blocks(df, block), "pcm16").orderBy("block_idx").collect()
    with wave.open(io.BytesIO(b"".join(bytes(r.payload) for r in parts))) as w:
        assert (w.getnframes(), w.getframerate(), w.getsampwidth(), w.getnchannels()) == (333, 16_000, 2, 1)
        x = np.frombuffer(w.readframes(333), "<i2")
    assert np.abs(x / 32_768 - clips[0]).max() < 1e-4
    body = b"".join(bytes(r.payload) for r in sinks.export_wav(pcm.pcm_blocks(df, block)).orderBy("block_idx").collect())
    assert np.array_equal(np.frombuffer(body[44:], "<f4"), clips[0]) and body[20:22] == b"\3\0"


def test_content_ids_collapse(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b"x")], "clip_id int, pcm binary")
    out = {r.clip_id: (r.content_id, r.n_submitted) for r in src.dedupe_by_content(df, "pcm").collect()}
    assert out[1] == ("u-a9993e364706816a", 2) and out[3][1] == 1 and len(out) == 2
