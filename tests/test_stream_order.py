"""Complete streams give whole results in whatever order one trigger hands their chunks over."""

import random

import numpy as np
import pandas as pd

from speechspark.streaming.segmenter import IncrementalSegmenter


class Place:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Waiting:
    def __init__(self):
        self.rows = {}

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def clear(self):
        self.rows.clear()


class Handle:
    def getValueState(self, *_):
        return Place()

    def getMapState(self, *_):
        return Waiting()


def events(batches, triggers=1):
    machine = IncrementalSegmenter("firered")
    machine.init(Handle())
    cut = -(-len(batches) // triggers)
    frames = [x for k in range(0, len(batches), cut) for x in machine.handleInputRows((1,), iter(batches[k:k + cut]), None)]
    return pd.concat(frames).drop(columns="emitted_at_s").reset_index(drop=True)


def frame(rows):
    return pd.DataFrame([(k, np.full(10, 0.9 if k // 50 % 2 else 0.1, np.float32), k == 9_999, None) for k in rows],
                        columns=["seq", "samples", "end_of_stream", "error"])


def test_ten_thousand_shuffled_chunks_of_one_stream():
    order = list(range(1, 10_000))
    random.Random(4).shuffle(order)
    order.append(0)  # the first comes last
    want = events([frame(range(10_000))])
    got = events([frame(order[k:k + 500]) for k in range(0, 10_000, 500)])
    assert not (got.event_type == "error").any() and (want.event_type == "segment").sum() == 100
    pd.testing.assert_frame_equal(got, want)


def test_a_missing_chunk_is_told_when_the_trigger_ends():
    batches = [frame(range(1, 5_000)), frame(range(5_000, 10_000))]
    got = events(batches, triggers=2)
    assert list(got.message) == ["chunk 0 is missing and 4096 chunks wait for it"]


def test_shuffled_chunks_through_spark(spark):
    from speechspark.streaming.segmenter import segment_stream_incremental

    order = list(range(1, 10_000))
    random.Random(5).shuffle(order)
    rows = [(1, k, [0.9 if k // 50 % 2 else 0.1] * 10, 16_000, k == 9_999, None) for k in [*order, 0]]
    chunks = spark.createDataFrame(
        rows, "stream_id bigint, seq bigint, samples array<float>, sample_rate int, end_of_stream boolean, error string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = segment_stream_incremental(chunks, "firered").groupBy("event_type").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r["event_type"]: r["count"] for r in got}
    assert "error" not in got and got["segment"] == 100
