"""PCM as bounded blocks, and sample-level operators.

``pcm_blocks`` is the working form of audio: clip_id, block_idx, n_samples (of the clip),
samples (at most ``BLOCK_SAMPLES``) and up to ``CONTEXT`` samples of both neighbours (before,
after).  It is made without a shuffle, keeps rows small enough for Arrow batches and lets one
long recording run in many tasks; operators that look across a block edge read the context
columns instead of exchanging audio.  Change sample values with ``map_samples``, which keeps
the context in step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechspark.functions.numeric import SAMPLE_RATE

KEYS = ("clip_id",)
BLOCK_SAMPLES = 160_000  # 10 s at 16 kHz, also the window of the class-score model
CONTEXT = 512
MODEL_CHUNK = 512
STREAM_CHUNK = 1_600


# --- bytes <-> samples --------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(data: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to samples; up to three trailing bytes are ignored."""
    return data.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4", count=len(b) // 4))


@F.pandas_udf(T.BinaryType())
def encode_f32(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


# --- blocks -------------------------------------------------------------------------


def pcm_blocks(clips: DataFrame, block_samples: int = BLOCK_SAMPLES, keys: Sequence[str] = KEYS,
               samples: str = "samples") -> DataFrame:
    """Split clips (``samples`` array, or raw float32 bytes in ``pcm``) into blocks.

    A clip is cut inside its row, so a block's row never carries the whole clip.  A clip without
    samples (or with null) gives one empty block.
    """
    raw = samples not in clips.columns
    n = F.floor(F.length("pcm") / 4) if raw else F.size(samples)
    n = F.greatest(F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))

    def context(block: Column) -> Column:
        return F.least(block * block_samples, F.lit(CONTEXT).cast("bigint"))

    def piece(block: Column) -> Column:
        first, length = block * block_samples - context(block), context(block) + block_samples + CONTEXT
        if raw:
            return F.substring(F.col("pcm"), (first * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.slice(samples, (first + 1).cast("int"), length.cast("int"))

    count = F.greatest(F.expr(f"(_n - 1) div {block_samples}"), F.lit(0).cast("bigint"))
    source = "pcm" if raw else samples
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), count), piece)
    cut = clips.select(*keys, n.alias("_n"), source).select(*keys, F.col("_n").alias("n_samples"), F.posexplode(pieces).alias("_b", "_x"))
    lead = context(F.col("_b").cast("bigint")).cast("int")
    cut = cut.select(*keys, F.col("_b").cast("bigint").alias("block_idx"), "n_samples", lead.alias("_lead"), "_x")
    if raw:
        kept = [*keys, "block_idx", "n_samples"]
        kinds = ", ".join(f"`{k}` {cut.schema[k].dataType.simpleString()}" for k in kept)
        return cut.mapInArrow(
            lambda batches: _decoded(batches, block_samples), f"{kinds}, samples array<float>, before array<float>, after array<float>")
    cut = cut.withColumn("_x", F.coalesce("_x", F.array().cast("array<float>")))
    lead = F.col("_lead")
    return cut.select(
        *keys, "block_idx", "n_samples", F.slice("_x", lead + 1, F.lit(block_samples)).alias("samples"),
        F.slice("_x", F.lit(1), lead).alias("before"), F.slice("_x", lead + 1 + block_samples, F.lit(CONTEXT)).alias("after"),
    )


def _decoded(batches: Iterator[pa.RecordBatch], block_samples: int) -> Iterator[pa.RecordBatch]:
    """Blocks of raw bytes (the last two columns: lead and bytes) with samples and context as float arrays."""
    for b in batches:
        parts: tuple[list, list, list] = ([], [], [])
        for lead, data in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1), strict=True):
            raw = data.as_buffer() if data.is_valid else b""
            x = np.frombuffer(raw, dtype="<f4", count=len(raw) // 4) if len(raw) >= 4 else np.zeros(0, "<f4")
            parts[0].append(x[lead:lead + block_samples])
            parts[1].append(x[:lead])
            parts[2].append(x[lead + block_samples:lead + block_samples + CONTEXT])
        lists = []
        for part in parts:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)
            values = np.concatenate(part) if part else np.zeros(0, "<f4")
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.float32, copy=False))))
        names = [*b.schema.names[:-2], "samples", "before", "after"]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], *lists], names=names)


def map_samples(blocks: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Apply a function of one sample to the samples and, if present, to the context."""
    held = [c for c in ("samples", "before", "after") if c in blocks.columns]
    return blocks.withColumns({c: F.transform(c, change) for c in held})


def without_context(blocks: DataFrame) -> DataFrame:
    return blocks.drop("before", "after")


def with_context(blocks: DataFrame, left: int, right: int, keys: Sequence[str] = KEYS, block_samples: int | None = None) -> DataFrame:
    """Exactly the last ``left`` and first ``right`` samples of the neighbours as ``before`` / ``after``.

    Context that came with the blocks is cut to size in place.  Blocks without it send their edges
    to the neighbours; groups then hold one row per neighbour.  Neither way gives less than asked
    for: a reach beyond the context or beyond ``block_samples`` is refused.
    """
    most = CONTEXT if "before" in blocks.columns else block_samples or BLOCK_SAMPLES
    if max(left, right) > most:
        raise ValueError(f"a reach of {max(left, right)} samples is longer than {most}")
    if "before" in blocks.columns:
        keep = F.least(F.lit(left), F.size("before"))
        return blocks.select(
            *keys, "block_idx", "n_samples", "samples",
            F.slice("before", F.size("before") - keep + 1, keep).alias("before"),
            F.slice("after", F.lit(1), F.lit(right)).alias("after"),
        )
    body = F.struct(
        F.col("block_idx").alias("b"), F.lit(0).alias("role"), F.col("n_samples").alias("n"), F.col("samples").alias("x")
    )
    tail = F.struct(
        (F.col("block_idx") + 1).alias("b"), F.lit(-1).alias("role"), F.col("n_samples").alias("n"),
        F.slice("samples", -F.least(F.lit(max(left, 1)), F.size("samples")), left).alias("x"),
    )
    head = F.struct(
        (F.col("block_idx") - 1).alias("b"), F.lit(1).alias("role"), F.col("n_samples").alias("n"),
        F.slice("samples", 1, right).alias("x"),
    )
    sent = blocks.select(*keys, F.explode(F.array(body, tail, head)).alias("_m")).select(*keys, "_m.*")

    def part(role: int) -> Column:
        return F.max(F.when(F.col("role") == role, F.struct("x")))["x"]

    none = F.array().cast("array<float>")
    return (
        sent.groupBy(*keys, F.col("b").alias("block_idx"))
        .agg(F.max("n").alias("n_samples"), part(0).alias("samples"),
             F.coalesce(part(-1), none).alias("before"), F.coalesce(part(1), none).alias("after"))
        .filter("samples is not null")
    )


def to_long(blocks: DataFrame, block_samples: int = BLOCK_SAMPLES, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per sample: keys, sample_idx, x."""
    return blocks.select(*keys, "block_idx", F.posexplode("samples").alias("_i", "x")).select(
        *keys, (F.col("block_idx") * block_samples + F.col("_i")).alias("sample_idx"), "x"
    )


# --- sample-wise operators ----------------------------------------------------------


def envelope(blocks: DataFrame, width: int, block_samples: int = BLOCK_SAMPLES, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest and largest value per bucket of n/width samples, both seeded with 0.

    Every clip gives ``width`` buckets; one without samples keeps (0, 0).
    """
    per = F.col("n_samples").cast("double") / F.lit(float(width))
    base = F.col("block_idx") * block_samples

    def bucket_of(i: Column) -> Column:
        # Last bucket whose floor(bucket * n / width) does not exceed the sample index; the
        # quotient may be off by one in floating point, hence the two checks.
        guess = F.ceil((i + 1) / per).cast("bigint") - 1
        guess = F.when(F.floor(guess * per) > i, guess - 1).otherwise(guess)
        return F.when(F.floor((guess + 1) * per) <= i, guess + 1).otherwise(guess)

    def extremes(bucket: Column) -> Column:
        lo = F.greatest(F.floor(bucket * per).cast("bigint") - base, F.lit(0).cast("bigint"))
        hi = F.least(F.floor((bucket + 1) * per).cast("bigint") - base, F.size("samples").cast("bigint"))
        part = F.slice("samples", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0).cast("bigint")).cast("int"))
        zero = F.lit(0.0).cast("float")
        return F.struct(bucket.alias("bucket"), F.least(zero, F.array_min(part)).alias("lo"), F.greatest(zero, F.array_max(part)).alias("hi"))

    touched = F.sequence(bucket_of(base), bucket_of(base + F.size("samples") - 1))
    seen = (
        blocks.filter(F.size("samples") > 0)
        .select(*keys, F.explode(F.transform(touched, extremes)).alias("_e")).select(*keys, "_e.*")
        .groupBy(*keys, "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    every = blocks.filter("block_idx = 0").select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("bucket")
    )
    return every.join(seen, [*keys, "bucket"], "left").fillna(0.0, ["lo", "hi"])


def mono_mix(blocks: DataFrame, channels: int = 2) -> DataFrame:
    """Mean over interleaved channels; the block size must be a multiple of ``channels``."""

    def channel(c: int):
        return F.filter("samples", lambda x, i: i % channels == c)

    parts = [channel(c) for c in range(channels)]
    total = F.transform(parts[0], lambda x: x.cast("double"))
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, x: a + x.cast("double"))
    mixed = F.transform(total, lambda a: (a / channels).cast("float"))
    return without_context(blocks).withColumn("samples", mixed).withColumn(
        "n_samples", F.expr(f"n_samples div {channels}")
    )


def decimate(blocks: DataFrame, src_rate: int, block_samples: int = BLOCK_SAMPLES, rate: int = SAMPLE_RATE,
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep a sample whenever the stride accumulator reaches src_rate / rate (long form)."""
    at = lambda i: F.col("block_idx") * block_samples + i
    whole = lambda i: (at(i) * rate - F.pmod(at(i) * rate, F.lit(src_rate))) / src_rate
    kept = F.filter("samples", lambda x, i: whole(i + 1) > whole(i))
    # The places of a block's kept samples follow each other.
    first = F.expr(f"block_idx * {block_samples} * {rate} div {src_rate}")
    return blocks.select(*keys, first.alias("_first"), F.posexplode(kept).alias("_i", "x")).select(
        *keys, (F.col("_first") + F.col("_i")).alias("sample_idx"), "x")


def _fir(up: int, down: int, half_width: int = 10) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of the two rates, gain ``up``."""
    top = max(up, down)
    n = np.arange(-half_width * top, half_width * top + 1)
    taps = np.sinc(n / top) / top * np.kaiser(len(n), 5.0)
    return taps * (up / taps.sum())


def resample(blocks: DataFrame, src_rate: int, rate: int = SAMPLE_RATE, block_samples: int = BLOCK_SAMPLES,
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Rational resampling with an anti-alias filter.

    An output sample belongs to the block that holds its centre; the filter's reach comes from
    the neighbours' edges, so blocks are independent.  Returns keys, block_idx, first_sample
    (output index), n_samples (of the output) and samples.
    """
    ratio = Fraction(rate, src_rate)
    up, down = ratio.numerator, ratio.denominator
    taps = _fir(up, down)
    half = (len(taps) - 1) // 2
    reach = half // up + 1
    if reach > block_samples:
        raise ValueError("block too short for the filter")

    def run(batches):
        for pdf in batches:
            starts, arrays = [], []
            for b, n, x, left, right in zip(pdf.block_idx, pdf.n_samples, pdf.samples, pdf.before, pdf.after):
                base = int(b) * block_samples
                first, end = -(-base * up // down), -(-(base + len(x)) * up // down)
                end = min(end, -(-int(n) * up // down))
                full = np.zeros(2 * reach + len(x))
                full[reach - len(left):reach] = left
                full[reach:reach + len(x)] = x
                full[reach + len(x):reach + len(x) + len(right)] = right
                out = np.zeros(max(end - first, 0))
                centre = np.arange(first, max(end, first), dtype=np.int64) * down  # on the upsampled grid
                near = centre // up  # last source sample at or before the centre
                for k in range(-reach + 1, reach + 1):
                    tap = half + centre - (near + k) * up
                    ok = (tap >= 0) & (tap < len(taps))
                    src = np.clip(near + k - base + reach, 0, len(full) - 1)
                    out += np.where(ok, taps[np.clip(tap, 0, len(taps) - 1)] * full[src], 0.0)
                starts.append(first)
                arrays.append(out.astype(np.float32))
            cols = {k: pdf[k] for k in keys}
            yield pd.DataFrame({
                **cols, "block_idx": pdf.block_idx, "first_sample": starts,
                "n_samples": [-(-int(n) * up // down) for n in pdf.n_samples], "samples": arrays,
            })

    ctx = with_context(blocks, reach, reach, keys)
    kt = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return ctx.mapInPandas(run, f"{kt}, block_idx bigint, first_sample bigint, n_samples bigint, samples array<float>")


def truncate(blocks: DataFrame, seconds: float, rate: int = SAMPLE_RATE, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """First int(seconds * rate) samples of every clip; later blocks are filtered out early."""
    n = int(rate * seconds)
    left = F.lit(n) - F.col("block_idx") * block_samples
    return (
        without_context(blocks).filter(F.col("block_idx") * block_samples < n)
        .withColumn("samples", F.slice("samples", 1, F.least(left, F.lit(block_samples)).cast("int")))
        .withColumn("n_samples", F.least("n_samples", F.lit(n).cast("bigint")))
    )


def chunk(blocks: DataFrame, size: int, tail: str = "keep", block_samples: int = BLOCK_SAMPLES,
          keys: Sequence[str] = KEYS) -> DataFrame:
    """Fixed chunks: keys, chunk_idx, samples, end_of_stream.

    tail: "keep" a short last chunk, "drop" it, or "pad" it with zeros.  Blocks must hold a
    whole number of chunks, so chunks are cut inside a row without any exchange; a chunk larger
    than a block is refused.
    """
    if block_samples % size:
        raise ValueError(f"a block of {block_samples} samples does not hold whole chunks of {size}")
    per = block_samples // size
    n = F.size("samples")
    last = F.floor((n - 1) / size).cast("int")
    cut = blocks.filter(n > 0).select(
        *keys, "block_idx", "n_samples", "samples", F.explode(F.sequence(F.lit(0), last)).alias("_c")
    )
    body = F.slice("samples", F.col("_c") * size + 1, F.lit(size))
    if tail == "pad":
        body = F.concat(body, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(body)))
    out = cut.select(
        *keys,
        (F.col("block_idx") * per + F.col("_c")).alias("chunk_idx"),
        body.alias("samples"),
        (F.expr(f"(n_samples - 1) div {size}") == F.col("block_idx") * per + F.col("_c")).alias("end_of_stream"),
    )
    if tail == "drop":
        return out.filter(F.size("samples") == size)
    if tail not in ("keep", "pad"):
        raise ValueError(f"unknown tail {tail!r}")
    return out
