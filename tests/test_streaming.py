"""Stateful segmenter: sizes, disorder, restarts; replay and batch as references."""

import os

import numpy as np
import pandas as pd
import plain
import pytest
from pyspark.sql import functions as F
from test_segmenting import series

from speechspark.operators import segmenting as seg
from speechspark.schemas import CHUNKS
from speechspark.sources.chunks import read_chunks, validate_chunks
from speechspark.sources import sinks
from speechspark.sources.sinks import events_to_json
from speechspark.streaming import replay
from speechspark.streaming.analysers import BufferedScores, EnergyAnalyser, ScoreAnalyser
from speechspark.streaming.params import StreamParams
from speechspark.streaming.segmenter import segment_stream, segment_stream_incremental

STREAMS = {0: 700, 1: 31, 2: 1_900}
PARAMS = replay.frame_stream_params("silero", max_buffer_s=6.4)


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(11)
    return {c: series(rng, n).astype(np.float32) for c, n in STREAMS.items()}


def chunk_rows(scores, rng=None, size=10):
    rows, lists = [], {}
    for c, p in scores.items():
        at, seq, lists[c] = 0, 0, []
        while at < len(p):
            step = size if rng is None else int(rng.integers(0, 40))
            part, eos = p[at:at + step], at + step >= len(p)
            rows.append((c, seq, part.tolist(), 16_000 if seq == 0 else 0, eos, None))
            lists[c].append((part, eos))
            at, seq = at + step, seq + 1
    return rows, lists


def write_files(spark, rows, folder, n, seed):
    """Chunks shuffled over ``n`` files, written one after the other."""
    os.makedirs(folder, exist_ok=True)
    for i, part in enumerate(np.array_split(np.random.default_rng(seed).permutation(len(rows)), n)):
        spark.createDataFrame([rows[j] for j in part], CHUNKS).coalesce(1).write.parquet(f"{folder}/batch{i}")


def run_stream(spark, build, folder, tmp, files=1):
    chunks = read_chunks(spark, f"{folder}/*", maxFilesPerTrigger=str(files))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sinks, "checkpoint_dir", lambda _: f"{tmp}/ckpt")
        q = sinks.write_events(build(chunks), f"{tmp}/out", "events", {"availableNow": True})
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp}/out")


def told(df, c):
    out = []
    for r in df.filter(F.col("stream_id") == c).toPandas().itertuples():
        out.append(("segment", round(r.start_s, 5), round(r.end_s, 5)) if r.event_type == "segment" else ("activity", round(r.timestamp, 5), bool(r.speech_active)))
    return sorted(out)


def test_disorder_and_restart_equal_plain_rules(spark, scores, tmp_path):
    rows, lists = chunk_rows(scores, np.random.default_rng(5))
    half = f"{tmp_path}/in"
    order = np.random.default_rng(6).permutation(len(rows))
    cut = len(rows) // 2
    write_files(spark, [rows[i] for i in order[:cut]], half, 3, 1)
    build = lambda ch: segment_stream(ch, ScoreAnalyser("silero"), PARAMS)
    run_stream(spark, build, half, tmp_path)
    write_files(spark, [rows[i] for i in order[cut:]] + rows[:5], f"{half}/../in2", 2, 2)  # with repeats
    for i in range(2):
        os.rename(f"{tmp_path}/in2/batch{i}", f"{half}/late{i}")
    out = run_stream(spark, build, half, tmp_path)  # restarts from the checkpoint
    for c in STREAMS:
        assert told(out, c) == sorted(plain.stream_events(lists[c], ScoreAnalyser("silero"), PARAMS)), c


@pytest.mark.parametrize("name", ["silero", "marblenet", "firered", "wide"])
def test_incremental_equals_batch(spark, scores, tmp_path, name):
    prm = seg.SegmentParams(step_ms=10, on=0.5, min_on=3, min_off=2, backfill=15, smooth=3) if name == "wide" else seg.resolve(name)
    rows, _ = chunk_rows(scores, np.random.default_rng(8))
    out = segment_stream_incremental(spark.createDataFrame(rows, CHUNKS), prm).filter("event_type = 'segment'")
    got = {c: sorted((round(r.start_s, 5), round(r.end_s, 5)) for r in out.filter(F.col("stream_id") == c).collect()) for c in STREAMS}
    for c, p in scores.items():
        step = prm.step_ms / 1000
        assert got[c] == [(round(s * step, 5), round(e * step, 5)) for s, e in plain.segments(p, prm)]


def test_incremental_vote_over_micro_batches(spark, scores, tmp_path):
    prm = seg.resolve("fsmn", min_off=9, on=0.45)
    rows, _ = chunk_rows(scores, np.random.default_rng(9))
    write_files(spark, rows, f"{tmp_path}/in", 4, 3)
    build = lambda ch: segment_stream_incremental(ch, prm, idle_ttl_s=3600)
    out = run_stream(spark, build, f"{tmp_path}/in", tmp_path).filter("event_type = 'segment'")
    for c, p in scores.items():
        mine = sorted((round(r.start_s * 100), round(r.end_s * 100)) for r in out.filter(F.col("stream_id") == c).collect())
        assert mine == plain.segments(p, prm)


@pytest.mark.parametrize("per_block", [2, 64])
@pytest.mark.parametrize("preset", ["silero", "firered", "fsmn"])
def test_replay_equals_plain_rules(spark, scores, per_block, preset):
    prm = seg.resolve(preset, min_off=9) if preset == "fsmn" else seg.resolve(preset)
    params = replay.frame_stream_params(prm, max_buffer_s=3.0)
    _, lists = chunk_rows(scores, size=7)
    rows = pd.concat([pd.DataFrame({"clip_id": c, "frame_idx": np.arange(len(p)), "p": p.astype(float)}) for c, p in scores.items()])
    out = replay.replay_stream(spark.createDataFrame(rows), prm, 7, params, per_block=per_block).withColumnRenamed("clip_id", "stream_id")
    for c in STREAMS:
        assert told(out, c) == sorted(plain.stream_events(lists[c], ScoreAnalyser(prm), params)), c


@pytest.mark.parametrize("name", ["silero", "marblenet", "firered", "fsmn", "wide"])
def test_buffers_of_one_array(name):
    prm = seg.SegmentParams(step_ms=10, on=0.5, min_on=3, min_off=2, backfill=15, smooth=3) if name == "wide" else seg.resolve(name)
    prm = seg.resolve("fsmn", min_off=9, on=0.45) if name == "fsmn" else prm
    rng = np.random.default_rng(21)
    x = series(rng, 3_000)
    many = BufferedScores(x, prm)
    for _ in range(400):
        lo = int(rng.integers(0, 2_990))
        hi = int(min(len(x), lo + rng.integers(1, 900)))
        assert many.frames(lo, hi) == [(lo + s, lo + e) for s, e in plain.segments(x[lo:hi], prm)]


def test_options_bucket_and_left_edge(spark, scores):
    rows = pd.DataFrame({"clip_id": 2, "frame_idx": np.arange(STREAMS[2]), "p": 0.9})  # one endless segment
    df = spark.createDataFrame(rows)
    quiet = replay.frame_stream_params("silero", max_buffer_s=6.4, suppress_left_edge=True)
    kinds = replay.replay_stream(df, "silero", 10, quiet).groupBy("event_type").count().collect()
    assert {r.event_type: r["count"] for r in kinds} == {"activity": 2}
    assert StreamParams(dedupe="bucket").start_key(0.3) == 3 and StreamParams(dedupe="bucket").start_key(0.29) == 2


def test_invalid_chunk_ends_its_stream_only(spark):
    rows = [
        (1, 0, bytes(40), 16_000, False, None), (1, 1, bytes(41), 0, False, None), (1, 2, bytes(40), 0, True, None),
        (2, 0, bytes(40), 44_100, True, None), (3, 0, b"", 0, True, None),
    ]
    raw = spark.createDataFrame(rows, "stream_id bigint, seq bigint, pcm binary, sample_rate int, end_of_stream boolean, ts timestamp")
    out = segment_stream(validate_chunks(raw), EnergyAnalyser())
    got = {r.stream_id: r.message for r in out.collect()}
    assert got == {1: "samples length 41 is not a multiple of 4 (expected float32 little-endian)", 2: "sample rate must be 16000, got 44100"}
    line = events_to_json(out).filter("stream_id = 2").collect()[0].json
    assert line == '{"message":"sample rate must be 16000, got 44100","timestamp":0.0,"type":"error"}'


def test_pcm_stream_with_energy(spark):
    t = np.arange(16_000) / 16_000
    x = np.concatenate([np.zeros(8_000), 0.3 * np.sin(2 * np.pi * 200 * t), np.zeros(16_000)]).astype(np.float32)
    rows = [(5, i, x[i * 1_600:(i + 1) * 1_600].tolist(), 16_000, i == len(x) // 1_600 - 1, None) for i in range(len(x) // 1_600)]
    out = segment_stream(spark.createDataFrame(rows, CHUNKS), EnergyAnalyser()).toPandas()
    s = out[out.event_type == "segment"].iloc[0]
    assert (round(s.start_s, 2), round(s.end_s, 2)) == (0.5, 1.5)
    assert list(out[out.event_type == "activity"].speech_active) == [True, False]


def test_debounce(spark):
    flags = [0, 1, 0, 1, 1, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(0, i, bool(v)) for i, v in enumerate(flags)], "clip_id int, analysis bigint, speech_active boolean")
    got = [r.debounced for r in replay.debounce(df, 2).orderBy("analysis").collect()]
    assert [int(v) for v in got] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0]


def test_a_missing_chunk_ends_a_stream_that_waits_too_long(spark):
    """At most ``max_waiting`` chunks wait; a stream beyond that ends with an error, others go on."""
    rows = [(s, k, [0.9] * 10, 16_000, k == 30) for s in ("whole", "gap") for k in range(31) if not (s == "gap" and k == 4)]
    chunks = spark.createDataFrame(rows, "stream_id string, seq bigint, samples array<float>, sample_rate int, end_of_stream boolean")
    out = segment_stream_incremental(chunks, "firered", max_waiting=8)
    errors = out.filter("event_type = 'error'").select("stream_id", "message", "timestamp", "emitted_at_s").collect()
    assert [tuple(r) for r in errors] == [("gap", "chunk 4 is missing and 8 chunks wait for it", 0.4, 0.4)]
    assert out.filter("stream_id = 'whole' and event_type = 'segment'").count() == 1
    patient = segment_stream_incremental(chunks, "firered").filter("event_type = 'error'")
    assert patient.count() == 0


def test_without_a_bound_any_number_of_chunks_waits(spark):
    rows = [(s, k, [0.9], 16_000, k == 4_200) for s in ("whole", "late") for k in range(4_201) if not (s == "late" and k == 0)]
    chunks = spark.createDataFrame(rows, "stream_id string, seq bigint, samples array<float>, sample_rate int, end_of_stream boolean")
    errors = lambda bound: segment_stream_incremental(chunks, "firered", max_waiting=bound).filter("event_type = 'error'").collect()
    assert [r["stream_id"] for r in errors(4_096)] == ["late"]
    assert errors(None) == []
