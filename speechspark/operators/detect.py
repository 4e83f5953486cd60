"""Recordings to segments in one call: checks, features, scores, decisions, one record per clip.

Every clip comes back, with its segments or with the reason why it has none; a clip that fails a check
or whose scoring fails never stops the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechspark.functions.numeric import SAMPLE_RATE, duration
from speechspark.operators import features as feat
from speechspark.operators.normalize import apply_cmvn
from speechspark.operators.pcm import BLOCK_SAMPLES, pcm_blocks
from speechspark.operators.scoring import Scorer, energy_score, score_frames
from speechspark.operators.segmenting import BLOCK, FAN, SegmentParams, segment_frames
from speechspark.operators.segments import nest
from speechspark.session import kept
from speechspark.sources.pcm import CLIP_SUFFIX, input_error
from speechspark.sources.recordings import PARTITION_BYTES, list_recordings, read_recordings

KEYS = ("clip_id",)
MSG_SHORT = "clip too short for one frame"


def front_end(blocks: DataFrame, front: feat.KaldiOptions | feat.NemoOptions, stack: tuple[int, int] | None = None,
              stats: DataFrame | None = None, block_samples: int = BLOCK_SAMPLES, keys: Sequence[str] = KEYS,
              precision: str = "float") -> DataFrame:
    """Log-mel features of either form, stacked (m frames, every n) and normalised (``fit_cmvn``) if asked."""
    job = feat.log_mel_nemo if isinstance(front, feat.NemoOptions) else feat.log_mel_kaldi
    mel = job(blocks, front, block_samples, keys, precision)
    if stack is not None:
        mel = feat.stack_frames(mel, *stack, keys=keys)
    return mel if stats is None else apply_cmvn(mel, stats)


def detect(clips: DataFrame, preset: str | SegmentParams, front: feat.KaldiOptions | feat.NemoOptions,
           scorer: Scorer | None = None, stack: tuple[int, int] | None = None, stats: DataFrame | None = None,
           mid: float = -8.0, slope: float = 1.0, keys: Sequence[str] = KEYS, block_samples: int = BLOCK_SAMPLES,
           block: int = BLOCK, fan: int = FAN, precision: str = "float") -> DataFrame:
    """keys, duration_s, segments (start_s, end_s, speaker_id, confidence in order), error.

    ``clips`` holds raw float32 bytes in ``pcm`` and, if present, ``sample_rate``.  Without a ``scorer``
    the weight-free energy score is taken.  The scores of a plugged-in one are kept in the session's
    shared folder, as segments and errors both come from one run of it.
    """
    rate = F.col("sample_rate") if "sample_rate" in clips.columns else F.lit(SAMPLE_RATE)
    n = F.floor(F.length("pcm") / 4).cast("bigint")
    checked = clips.select(*keys, "pcm", input_error(rate, F.length("pcm")).alias("error"), n.alias("_n"))
    checked = checked.withColumn("error", F.coalesce("error", F.when(F.col("_n") < _least(front), F.lit(MSG_SHORT))))
    blocks = pcm_blocks(checked.filter("error is null").select(*keys, "pcm"), block_samples, keys)
    return _decide(checked, blocks, preset, front, scorer, stack, stats, mid, slope, keys, block_samples, block, fan, precision)


def detect_files(spark: SparkSession, path: str, preset: str | SegmentParams, front: feat.KaldiOptions | feat.NemoOptions,
                 scorer: Scorer | None = None, stack: tuple[int, int] | None = None, stats: DataFrame | None = None,
                 mid: float = -8.0, slope: float = 1.0, glob: str = f"*{CLIP_SUFFIX}", recursive: bool = False,
                 block_samples: int = BLOCK_SAMPLES, block: int = BLOCK, fan: int = FAN, precision: str = "float",
                 partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``detect`` on a folder of raw recordings of any length; clip_id is the file name without its suffix.

    Recordings are read as byte ranges; their lengths and failed checks come from the listing.
    """
    listed = list_recordings(spark, path, glob, recursive)
    short = F.when(F.col("n_samples") < _least(front), F.lit(MSG_SHORT))
    checked = listed.select("clip_id", F.coalesce("error", short).alias("error"), F.col("n_samples").alias("_n"))
    read = read_recordings(spark, path, glob, recursive, True, block_samples, partition_bytes)
    blocks = read.filter(F.col("error").isNull() & (F.col("n_samples") >= _least(front)))
    blocks = blocks.select("clip_id", "block_idx", "n_samples", "samples", "before", "after")
    return _decide(checked, blocks, preset, front, scorer, stack, stats, mid, slope, KEYS, block_samples, block, fan, precision)


def _least(front: feat.KaldiOptions | feat.NemoOptions) -> int:
    """Samples of the shortest clip with a frame."""
    return front.nfft // 2 + 1 if isinstance(front, feat.NemoOptions) else front.length


def _decide(checked: DataFrame, blocks: DataFrame, preset, front, scorer, stack, stats, mid, slope, keys, block_samples, block, fan, precision) -> DataFrame:
    """Records of the clips in ``checked`` (keys, error, _n) from the ``blocks`` of those without an error."""
    mel = front_end(blocks, front, stack, stats, block_samples, keys, precision)
    if scorer is None:
        scores, failed = energy_score(mel, mid, slope).select(*keys, "frame_idx", "p"), None
    else:
        scored = kept(score_frames(mel, scorer, keys=keys))
        scores, failed = scored.filter("error is null"), scored.filter("error is not null").select(*keys, F.col("error").alias("_failed"))
    segs = segment_frames(scores, preset, keys=keys, block=block, fan=fan)
    records = nest(checked.select(*keys, duration("_n").alias("duration_s"), "error"), segs, keys)
    if failed is not None:
        records = records.join(failed, list(keys), "left").withColumn("error", F.coalesce("error", "_failed")).drop("_failed")
    return records.select(*keys, "duration_s", "segments", "error")
