"""Streams that never end: closed by a timer, told, and deaf to what comes later."""

from datetime import datetime, timedelta, timezone

import pytest
from test_streaming import run_stream

from speechspark.operators.segmenting import SegmentParams
from speechspark.schemas import CHUNKS
from speechspark.streaming import replay
from speechspark.streaming.analysers import ScoreAnalyser
from speechspark.streaming.segmenter import IncrementalSegmenter, segment_stream, segment_stream_incremental

RULE = SegmentParams(step_ms=10, on=0.5, min_on=2, min_off=3)
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def chunk(stream, seq, at, level, eos=False):
    return (stream, seq, [level] * 10, 16_000 if seq == 0 else 0, eos, T0 + timedelta(seconds=at))


TRIGGERS = [
    # 0 breaks off in speech, 1 lacks a chunk, 3 goes on, 4 breaks off in silence
    [chunk(0, 0, 0, 0.1), chunk(0, 1, 1, 0.9), chunk(0, 2, 2, 0.9), chunk(1, 0, 1, 0.9), chunk(1, 2, 2, 0.9), chunk(3, 0, 3, 0.9), chunk(4, 0, 2, 0.1)],
    [chunk(2, 0, 60, 0.9), chunk(3, 1, 60, 0.9)],
    [chunk(2, 1, 100, 0.9, True), chunk(3, 2, 100, 0.9)],
    # the timers run out after this one
    [chunk(3, 3, 101, 0.9)],
    # too late for 0 and 1; 3 is behind the watermark but open
    [chunk(0, 3, 3, 0.9, True), chunk(1, 1, 3, 0.9), chunk(3, 4, 65, 0.9, True)],
]


def events(spark, tmp_path, build):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(TRIGGERS):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.parquet(f"{folder}/batch{i}")
    out = run_stream(spark, build, str(folder), tmp_path).collect()
    told = {}
    for r in out:
        told.setdefault(r.stream_id, []).append(
            (r.event_type, None if r.start_s is None else (round(r.start_s, 3), round(r.end_s, 3)), r.speech_active, r.message))
    return {k: sorted(v, key=str) for k, v in told.items()}


@pytest.mark.parametrize("mode", ["incremental", "rolling"])
def test_abandoned_and_late_streams(spark, tmp_path, mode):
    def build(chunks):
        timed = chunks.withWatermark("ts", "5 seconds")
        if mode == "incremental":
            return segment_stream_incremental(timed, RULE, close_after_s=60, event_time="ts")
        return segment_stream(timed, ScoreAnalyser(RULE), replay.frame_stream_params(RULE), close_after_s=60, event_time="ts")

    told = events(spark, tmp_path, build)
    segs = {k: [e[1] for e in v if e[0] == "segment"] for k, v in told.items()}
    assert segs == {0: [(0.1, 0.3)], 1: [(0.0, 0.1)], 2: [(0.0, 0.2)], 3: [(0.0, 0.5)], 4: []}
    gone = {k: [e[3] for e in v if e[0] == "abandoned"] for k, v in told.items()}
    assert gone == {
        0: ["no chunk 3 for 60 s, 0 chunks waited for it"], 1: ["no chunk 1 for 60 s, 1 chunks waited for it"], 2: [], 3: [],
        4: ["no chunk 1 for 60 s, 0 chunks waited for it"]}
    assert not any(e[0] == "error" for v in told.values() for e in v)
    for k in (0, 1, 2, 3):
        assert sum(e[0] == "activity" and e[2] for e in told[k]) == sum(e[0] == "activity" and not e[2] for e in told[k]) == 1


class Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_a_timer_follows_the_newest_chunk():
    """One timer a stream on the clock, moved by every chunk and taken back at the end."""
    import pandas as pd
    from test_stream_order import Handle

    class Timed(Handle):
        def __init__(self):
            self.timers = set()

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    p, handle, clock = IncrementalSegmenter(RULE), Timed(), Clock()
    p.close_ms = 1_000
    p.init(handle)
    frame = lambda seq, eos: iter([pd.DataFrame({"seq": [seq], "samples": [[0.9] * 10], "end_of_stream": [eos]})])
    for now, seq in ((0, 0), (400, 1)):
        clock.now = now
        list(p.handleInputRows((7,), frame(seq, False), clock))
        assert handle.timers == {now + 1_000}
    list(p.handleInputRows((7,), frame(2, True), clock))
    assert handle.timers == set() and list(p.handleExpiredTimer((7,), clock, None)) == []


def test_options_that_exclude_each_other(spark):
    df = spark.createDataFrame([], CHUNKS)
    for bad in ({"event_time": "ts"}, {"event_time": "ts", "close_after_s": 1, "idle_ttl_s": 1}):
        with pytest.raises(ValueError):
            segment_stream_incremental(df, RULE, **bad)
