import numpy as np
import pandas as pd
import plain
import pytest

from speechspark.operators import powerset


@pytest.mark.parametrize("fan", [2, 4096])
@pytest.mark.parametrize("gap", [0.1, 3.0])
def test_diarize_matches_sequential(spark, fan, gap):
    rng = np.random.default_rng(3)
    clips, rows = {}, []
    for c, windows in enumerate([1, 3, 25]):
        w = rng.integers(1, 5, size=(windows, 20, 7)).astype(float)
        stay = np.repeat(rng.integers(0, 7, size=(windows, 5)), 4, axis=1)
        np.put_along_axis(w, stay[..., None], 30.0, axis=2)
        w[rng.random((windows, 20)) < 0.05] = 1.0  # ties
        if c == 2:
            w[4:9] = 1.0
            w[4:9, :, 0] = 9.0  # a silent stretch of whole windows
        clips[c] = np.log(w / w.sum(axis=2, keepdims=True))
        for i in range(windows):
            rows += [(c, i, f, clips[c][i, f].tolist()) for f in range(20)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["clip_id", "window_idx", "frame_idx", "logits"]))
    got = powerset.diarize(df, frames_per_window=20, merge_gap=gap, fan=fan).toPandas()
    for c, logits in clips.items():
        mine = got[got.clip_id == c].sort_values("emit_order")
        want = plain.diarize(logits, 10.0, powerset.CLASS_SPEAKERS, gap)
        assert [(r.speaker_id, round(r.start_s, 6), round(r.end_s, 6), round(r.confidence, 4)) for r in mine.itertuples()] == [
            (s, round(a, 6), round(b, 6), round(np.float32(v).item(), 4)) for s, a, b, v in want
        ]
