"""Odd matrix files, repeats in a stream, and models that all fail."""

from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from speechspark.operators import scoring
from speechspark.sources import pcm as src


def test_empty_and_large_matrices_are_told(spark, tmp_path):
    (tmp_path / "m.f32").write_bytes(np.arange(6, dtype="<f4").tobytes())
    (tmp_path / "none.f32").write_bytes(b"")
    (tmp_path / "odd.f32").write_bytes(b"\0" * 8)
    with open(tmp_path / "large.f32", "wb") as f:
        f.truncate(3 * (1 << 30))
    rows = src.read_f32_matrix(spark, str(tmp_path), 3).collect()
    assert {r.name: r.error for r in rows if r.error} == {
        "none.f32": "samples cannot be empty", "odd.f32": "length 8 is not a multiple of 12", "large.f32": "samples do not fit into one row"}
    assert sorted((r.row_idx, r.row) for r in rows if not r.error) == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]


def test_repeats_in_later_triggers_collapse(spark, tmp_path):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    schema = "clip_id bigint, pcm binary, ts timestamp"
    triggers = [[(1, b"a", 0), (2, b"b", 1), (3, b"a", 2)], [(4, b"b", 5), (5, b"c", 6)], [(6, b"a", 8), (7, b"d", 9), (8, None, 9)], [(9, None, 10)]]
    for i, rows in enumerate(triggers):
        made = [(c, None if x is None else bytearray(x), t0 + timedelta(seconds=s)) for c, x, s in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in/*")
    first = src.dedupe_stream(stream, "pcm", "ts", "1 hour")
    q = first.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(None if r.pcm is None else bytes(r.pcm) for r in got if r.pcm is not None) == [b"a", b"b", b"c", b"d"]
    assert {r.clip_id for r in got} >= {2, 5, 7, 8} and len(got) == 5


def test_models_that_all_fail_are_told(spark):
    frames = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.5)], "clip_id bigint, frame_idx bigint, p double")

    def broken(df):
        raise RuntimeError("no weights")

    def failing(df):
        return df.select("clip_id", F.raise_error(F.lit("broke")).cast("double").alias("start_s"))

    segs, res = scoring.compare_models(frames, {"x": broken, "y": failing})
    assert segs.count() == 0 and {"clip_id", "start_s", "end_s", "model"} <= set(segs.columns)
    told = {(r.clip_id, r.model): (r.error, r.n_segments) for r in res.collect()}
    assert set(told) == {(c, m) for c in (1, 2) for m in "xy"} and told[1, "x"] == ("no weights", 0) and "broke" in told[2, "y"][0]
