import numpy as np
import pytest

from speechspark.operators import detect, pcm
from speechspark.operators import features as feat
from speechspark.operators import segmenting as seg
from speechspark.sources import pcm as src
from speechspark.sources import recordings as rec


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(3)
    for name, n in {"a": 7_001, "b": 480, "c": 1, "d": 100_000}.items():
        (tmp_path / f"{name}-16k.f32").write_bytes(rng.normal(0, 0.1, n).astype("<f4").tobytes())
    (tmp_path / "empty-16k.f32").write_bytes(b"")
    (tmp_path / "odd-16k.f32").write_bytes(b"\0" * 6)
    (tmp_path / "_hidden-16k.f32").write_bytes(b"\0" * 8)
    (tmp_path / "notes.txt").write_text("no audio")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a-16k.f32").write_bytes(b"\0" * 8)
    return str(tmp_path)


def key(df):
    held = ["clip_id", "block_idx", "n_samples", "samples", "before", "after"]
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*held).collect())


@pytest.mark.parametrize("size", [480, 160_000])
@pytest.mark.parametrize("partition", [1, 5_000, 1 << 26])
def test_blocks_of_files_are_those_of_rows(spark, folder, size, partition):
    """Any cut of the files into tasks gives the blocks and the context that whole rows give."""
    good, bad = src.split_failures(rec.read_recordings(spark, folder, block_samples=size, partition_bytes=partition))
    rows, failed = src.split_failures(src.validate_clips(src.read_pcm(spark, folder)))
    assert key(good) == key(pcm.pcm_blocks(rows, size))
    assert {(r.clip_id, r.error) for r in bad.collect()} == {(r.clip_id, r.error) for r in failed.collect()} != set()


def test_loose_recursive_and_listed(spark, folder):
    loose = rec.read_recordings(spark, folder, strict=False, recursive=True)
    assert {r.clip_id: r.n_samples for r in loose.select("clip_id", "n_samples").collect()} == {
        "a": 7_001, "b": 480, "c": 1, "d": 100_000, "empty": 0, "odd": 1, "sub/a": 2}
    listed = {r.clip_id: (r.n_bytes, r.error is None) for r in rec.list_recordings(spark, folder).collect()}
    assert listed == {"a": (28_004, True), "b": (1_920, True), "c": (4, True), "d": (400_000, True), "empty": (0, False), "odd": (6, False)}


def test_conditions_reach_the_files(spark, folder):
    """Only the files and ranges asked for are opened, with the same rows as a filter after the fact."""
    all_rows = key(rec.read_recordings(spark, folder, block_samples=480))
    read = rec.read_recordings(spark, folder, block_samples=480, partition_bytes=1)
    for condition, want in [
        ("clip_id = 'd' and block_idx >= 3 and block_idx < 5", lambda r: r[0] == "d" and 3 <= r[1] < 5),
        ("clip_id in ('a', 'odd') and block_idx <= 1", lambda r: r[0] in ("a", "odd") and r[1] <= 1),
        ("block_idx = 2", lambda r: r[1] == 2), ("clip_id > 'c'", lambda r: r[0] > "c"), ("block_idx > 5000", lambda r: False),
        ("clip_id = 'a' and clip_id = 'b'", lambda r: False),
    ]:
        assert key(read.filter(condition)) == [r for r in all_rows if want(r)]
    assert read.filter("clip_id = 'd' and block_idx >= 3 and block_idx < 5").rdd.getNumPartitions() == 2


def test_no_recordings(spark, tmp_path):
    assert rec.read_recordings(spark, str(tmp_path)).count() == 0 and rec.list_recordings(spark, str(tmp_path)).count() == 0


def test_recording_beyond_one_row(spark, tmp_path):
    """A sparse file of 5 GB: its blocks are reached by their place, and its length is no failure."""
    n = 5 * (1 << 30)
    with open(tmp_path / "long-16k.f32", "wb") as f:
        f.truncate(n)
        f.seek(n - 4)
        f.write(np.float32(0.5).tobytes())
    read = rec.read_recordings(spark, str(tmp_path))
    last = (n // 4 - 1) // pcm.BLOCK_SAMPLES
    got = read.filter(f"block_idx >= {last}").collect()
    assert [(r.block_idx, r.n_samples, r.samples[-1], len(r.before), r.error) for r in got] == [(last, n // 4, 0.5, 512, None)]
    reader = rec.RecordingReader(rec.RecordingSource({"path": str(tmp_path)}))
    parts = reader.partitions()
    spans = [(p.first, p.end) for x in parts for p in x.pieces]
    assert spans[0][0] == 0 and spans[-1][1] == last + 1 and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert max(e - s for s, e in spans) * 4 * pcm.BLOCK_SAMPLES <= rec.PARTITION_BYTES
    sizes = [b.nbytes for b in reader.read(parts[0])]
    assert max(sizes) < rec.BATCH_BYTES + 8 * pcm.BLOCK_SAMPLES


def test_detect_files_is_detect(spark, folder):
    rule = seg.SegmentParams(step_ms=10, on=0.5, min_on=2, min_off=3)
    show = lambda df: sorted((r.clip_id, r.duration_s, [tuple(s) for s in r.segments], r.error) for r in df.collect())
    rows = detect.detect(src.read_pcm(spark, folder), rule, feat.KaldiOptions())
    assert show(detect.detect_files(spark, folder, rule, feat.KaldiOptions(), partition_bytes=5_000)) == show(rows)
