"""The shape of the plans: what is read, how often rows move, and what must not appear."""

import __spark_entry__ as entry
import pytest

from speechspark.operators import features as feat
from speechspark.operators import pcm
from speechspark.operators import segmenting as seg
from speechspark.plans import fixtures as fx
from speechspark.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_of_frames_for_all_models(spark):
    df = fx.frame_scores(spark, SF)
    one = plan(seg.segment_frames(df, "silero")).count("Exchange hashpartitioning")
    many = plan(seg.segment_models(df, ["silero", "marblenet", "firered"])).count("Exchange hashpartitioning")
    assert one == many == 4  # frames once, then three rounds over block rows


def test_feature_job_moves_no_audio(spark):
    clips = spark.createDataFrame([(0, [0.0] * 900)], "clip_id bigint, samples array<float>")
    b = pcm.pcm_blocks(clips)
    for df in (feat.log_mel_kaldi(b), feat.log_mel_nemo(b), feat.frames(b, 400, 160), pcm.resample(b, 24_000)):
        assert "Exchange" not in plan(df)


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["seg_silero"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    assert "ReadSchema: struct<text" not in text


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join_or_row_wise_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
