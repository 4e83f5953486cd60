"""Writers for segment audio, speaker streams, WAV payloads and events."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.functions.numeric import SAMPLE_RATE
from speechspark.operators.pcm import encode_f32
from speechspark.session import checkpoint_dir

KEYS = ("clip_id",)

# Output file names, and the WAV format tags and sample widths.
SEGMENT_NAME = "%s-speaker%d-segment%d.f32"
STREAM_NAME = "%s-speaker%d.f32"
WAV_FORMATS = {"float32": (3, 4), "pcm16": (1, 2)}


def segment_name(clip: Column, speaker: Column, segment: Column) -> Column:
    return F.format_string(SEGMENT_NAME, clip.cast("string"), speaker, segment)


def stream_name(clip: Column, speaker: Column) -> Column:
    return F.format_string(STREAM_NAME, clip.cast("string"), speaker)


def _write(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Parquet sorted by clip: rows are ranged over the clips, so a clip lies in few files and a filter on
    it reads few row groups; the number of files follows the data and large clips are split."""
    df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.mode("overwrite").parquet(path)


def write_speaker_chunks(pieces: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Output of ``cut_segments``: one row per piece of a segment, with its file name."""
    named = pieces.withColumn("file_name", segment_name(F.col(keys[0]), F.col("speaker_id"), F.col("segment_idx")))
    _write(named, path, keys, ["speaker_id", "segment_idx", "piece_idx"])


def write_speaker_streams(streams: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Output of ``mask_streams``: one row per block of a speaker's stream, with its file name."""
    _write(streams.withColumn("file_name", stream_name(F.col(keys[0]), F.col("speaker_id"))), path, keys, ["speaker_id", "block_idx"])


def export_raw(named: DataFrame, folder: str, order: str) -> None:
    """Write every ``file_name`` as a raw float32 file in ``folder``, any URI that pyarrow opens.

    The pieces of one file are appended in ``order`` while streaming through the partition; the
    file gets its final name only when complete, so a retried task replaces it whole.
    """
    def save(rows):
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        suffix = f".part-{ctx.partitionId()}-{ctx.taskAttemptId()}"
        current, out = None, None

        def finish():
            out.close()
            system.move(f"{root}/{current}{suffix}", f"{root}/{current}")

        for row in rows:
            if row.file_name != current:
                if out:
                    finish()
                current = row.file_name
                out = system.open_output_stream(f"{root}/{current}{suffix}")
            out.write(row.payload)
        if out:
            finish()

    (
        named.select("file_name", order, encode_f32("samples").alias("payload"))
        .repartition("file_name")
        .sortWithinPartitions("file_name", order)
        .foreachPartition(save)
    )


def _wav_header(n_samples: int, rate: int, fmt: str) -> bytes:
    tag, width = WAV_FORMATS[fmt]
    data = n_samples * width
    return struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + data, b"WAVE", b"fmt ", 16, tag, 1, rate, rate * width, width, 8 * width, b"data", data
    )


def _wav_body(x: np.ndarray, fmt: str) -> bytes:
    x = np.asarray(x, dtype=np.float32)
    if fmt == "float32":
        return x.astype("<f4").tobytes()
    s = np.clip(x.astype(np.float64), -1.0, 1.0)
    return np.trunc(np.where(s < 0, s * 32768.0, s * 32767.0)).astype("<i2").tobytes()


def export_wav(blocks: DataFrame, fmt: str = "float32", rate: int = SAMPLE_RATE, keys: Sequence[str] = KEYS) -> DataFrame:
    """WAV payload per block: block 0 starts with the header of the whole clip.

    Joining a clip's payloads in block order gives its file.
    """
    if fmt not in WAV_FORMATS:
        raise ValueError(f"unknown format {fmt!r}")

    def run(batches):
        for pdf in batches:
            wav = [
                (_wav_header(int(n), rate, fmt) if b == 0 else b"") + _wav_body(x, fmt)
                for b, n, x in zip(pdf.block_idx, pdf.n_samples, pdf.samples)
            ]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "block_idx": pdf.block_idx, "payload": wav})

    kt = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.mapInPandas(run, f"{kt}, block_idx bigint, payload binary")


def events_to_json(events: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Event rows as tagged JSON; fields that do not belong to the type are left out.

    Works on a streaming DataFrame as well as on a batch one.
    """
    is_seg = F.col("event_type") == "segment"
    seg = lambda c: F.when(is_seg, F.col(c))
    body = F.struct(
        seg("confidence").alias("confidence"),
        seg("end_s").alias("end"),
        F.when(F.col("event_type") == "error", F.col("message")).alias("message"),
        seg("speaker_id").alias("speaker_id"),
        F.when(F.col("event_type") == "activity", F.col("speech_active")).alias("speech_active"),
        seg("start_s").alias("start"),
        F.col("timestamp").alias("timestamp"),
        F.col("event_type").alias("type"),
    )
    return events.select(*keys, F.to_json(body).alias("json"))


def write_events(events: DataFrame, path: str, name: str, trigger: dict | None = None):
    """Start appending streaming events to ``path``; progress is kept under the shared
    checkpoint folder in ``name``, so the same name resumes after a restart."""
    writer = (
        events.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{checkpoint_dir(events.sparkSession)}/{name}")
    )
    return (writer.trigger(**trigger) if trigger else writer).start(path)
