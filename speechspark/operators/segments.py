"""Operators over segment tables: interval cuts, summaries, audits and agreement.

Audio is held as PCM blocks (``operators.pcm``): one row per ``block_samples`` samples.
A segment meets the audio by an equi-join on (clip, block) after it is spread over the
blocks it covers, so neither a long recording nor a long segment becomes one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechspark.functions.blocks import number_rows
from speechspark.functions.numeric import SAMPLE_RATE
from speechspark.operators.pcm import BLOCK_SAMPLES
from speechspark.session import kept

KEYS = ("clip_id",)
SALTS = 16


def _trunc(seconds: Column, rate: int) -> Column:
    return (seconds * F.lit(float(rate))).cast("bigint")


def kept_segments(blocks: DataFrame, segs: DataFrame, rate=SAMPLE_RATE, block_samples=BLOCK_SAMPLES,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments with their sample range, clamped to the clip; empty ones are dropped.

    A segment survives exactly if its first sample exists, so it is joined to the one block
    that would hold that sample, which also knows the clip length.
    """
    s = segs.withColumn("start_sample", F.greatest(_trunc(F.col("start_s"), rate), F.lit(0).cast("bigint")))
    s = s.withColumn("block_idx", F.expr(f"start_sample div {block_samples}"))
    heads = blocks.select(*keys, "block_idx", "n_samples")
    return (
        s.join(heads, [*keys, "block_idx"])
        .withColumn("end_sample", F.least(_trunc(F.col("end_s"), rate), F.col("n_samples")))
        .filter("start_sample < end_sample")
        .drop("block_idx", "n_samples")
    )


def number_segments(segs: DataFrame, keys: Sequence[str] = KEYS, out: str = "segment_idx") -> DataFrame:
    """Running number per (clip, speaker) in emission order, from 0."""
    return number_rows(segs, [*keys, "speaker_id"], "emit_order", out)


def _cover(df: DataFrame, block_samples: int) -> DataFrame:
    first, last = F.expr(f"start_sample div {block_samples}"), F.expr(f"(end_sample - 1) div {block_samples}")
    return df.withColumn("block_idx", F.explode(F.sequence(first, last)))


def cut_segments(blocks: DataFrame, segs: DataFrame, rate=SAMPLE_RATE, block_samples=BLOCK_SAMPLES,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Audio of every segment as ordered pieces (one per block it touches)."""
    kept = number_segments(kept_segments(blocks, segs, rate, block_samples, keys), keys)
    spread = _cover(kept, block_samples).withColumn("piece_idx", F.col("block_idx") - F.expr(f"start_sample div {block_samples}"))
    base = F.col("block_idx") * block_samples
    lo = F.greatest(F.col("start_sample") - base, F.lit(0).cast("bigint"))
    hi = F.least(F.col("end_sample") - base, F.lit(block_samples).cast("bigint"))
    return spread.join(blocks.select(*keys, "block_idx", "samples"), [*keys, "block_idx"]).select(
        *keys, "speaker_id", "segment_idx", "start_s", "end_s", "start_sample", "end_sample", "piece_idx",
        F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("samples"),
    )


def _mask(samples: pd.Series, spans: pd.Series) -> pd.Series:
    def one(x, iv):
        out = np.zeros(len(x), dtype=np.float32)
        for s in iv if iv is not None else ():
            out[s["lo"]:s["hi"]] = x[s["lo"]:s["hi"]]
        return out

    return pd.Series([one(x, iv) for x, iv in zip(samples, spans)])


def mask_streams(blocks: DataFrame, segs: DataFrame, rate=SAMPLE_RATE, block_samples=BLOCK_SAMPLES,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Full-length audio per (clip, speaker), zero where the speaker is not active.

    A speaker counts as soon as any of its segments is listed, even an empty one.
    """
    kept = kept_segments(blocks, segs, rate, block_samples, keys)
    base = F.col("block_idx") * block_samples
    spans = (
        _cover(kept.select(*keys, "speaker_id", "start_sample", "end_sample"), block_samples)
        .select(
            *keys, "speaker_id", "block_idx",
            F.greatest(F.col("start_sample") - base, F.lit(0).cast("bigint")).cast("int").alias("lo"),
            F.least(F.col("end_sample") - base, F.lit(block_samples).cast("bigint")).cast("int").alias("hi"),
        )
        # One span per start is enough, so a block's list is at most one entry per sample.
        .groupBy(*keys, "speaker_id", "block_idx", "lo").agg(F.max("hi").alias("hi"))
        .groupBy(*keys, "speaker_id", "block_idx").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    )
    who = segs.select(*keys, "speaker_id").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    audio = blocks.withColumn("_salt", (F.col("block_idx") % SALTS).cast("int"))
    masked = F.pandas_udf(_mask, "array<float>")
    return (
        audio.join(who, [*keys, "_salt"])
        .drop("_salt")
        .join(spans, [*keys, "speaker_id", "block_idx"], "left")
        .select(*keys, "speaker_id", "block_idx", "n_samples",
                F.when(F.col("spans").isNull(), F.transform("samples", lambda x: F.lit(0.0).cast("float")))
                .otherwise(masked("samples", "spans")).alias("samples"))
    )


def speakers(segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return segs.groupBy(*keys).agg(F.size(F.collect_set("speaker_id")).alias("n_speakers"))


def extract_range(blocks: DataFrame, start_s: float, end_s: float, rate=SAMPLE_RATE,
                  block_samples=BLOCK_SAMPLES, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples floor(start) .. ceil(end) of every clip, as pieces; other blocks are not read further."""
    lo, hi = int(np.floor(start_s * rate)), int(np.ceil(end_s * rate))
    base = F.col("block_idx") * block_samples
    a = F.greatest(F.lit(lo) - base, F.lit(0).cast("bigint"))
    b = F.least(F.lit(hi) - base, F.size("samples").cast("bigint"))
    return (
        blocks.filter(F.col("block_idx").between(lo // block_samples, max(hi - 1, 0) // block_samples))
        .filter(a < b)
        .select(*keys, "block_idx", (base + a).alias("first_sample"),
                F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("samples"))
    )


# --- summaries and audits -----------------------------------------------------------


def summarize(runs: DataFrame, segs: DataFrame, by: Sequence[str] = ("clip_id", "model")) -> DataFrame:
    """Per run: segments, speech seconds, share of the duration, speakers.

    ``runs`` has one row per ``by`` with ``duration_s``; runs without segments stay.
    """
    agg = segs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s"),
        F.size(F.collect_set("speaker_id")).alias("n_speakers"),
    )
    out = runs.join(agg, list(by), "left").fillna(0, ["n_segments", "n_speakers"]).fillna(0.0, ["speech_s"])
    pct = F.when(F.col("duration_s") > 0, F.col("speech_s") / F.col("duration_s") * 100.0).otherwise(F.lit(0.0))
    return out.withColumn("speech_pct", pct)


def audit_segments(segs: DataFrame, low: float = 0.2, high: float = 0.95, runs: DataFrame | None = None,
                   by: Sequence[str] = ("clip_id", "model"), max_speaker: int = 2) -> DataFrame:
    """Violated rules: one row per (segment, rule), and per run for the speech share."""
    broken = F.array_compact(
        F.array(
            F.when(~(F.col("end_s") > F.col("start_s")), F.lit("end_not_after_start")),
            F.when(~F.col("speaker_id").between(0, max_speaker), F.lit("speaker_out_of_range")),
            F.when(~F.col("confidence").between(0.0, 1.0), F.lit("confidence_out_of_range")),
        )
    )
    rows = segs.select(*by, "emit_order", F.explode(broken).alias("rule"))
    if runs is None:
        return rows
    share = summarize(runs, segs, by)
    fraction = F.col("speech_pct") / 100.0
    bad = share.filter(~fraction.between(low, high)).select(
        *by, F.lit(None).cast("bigint").alias("emit_order"), F.lit("speech_fraction").alias("rule")
    )
    return rows.unionByName(bad)


def check_expectations(totals: DataFrame, expected: DataFrame) -> DataFrame:
    """Per-model totals outside (min_total_s, max_total_s) or below min_segments."""
    joined = totals.join(expected, "model")
    bad = (
        (F.col("speech_s") < F.col("min_total_s"))
        | (F.col("speech_s") > F.col("max_total_s"))
        | (F.col("n_segments") < F.col("min_segments"))
    )
    return joined.withColumn("violated", bad)


def check_duration(df: DataFrame, reported: str, actual: str, tol: float = 0.05) -> DataFrame:
    ok = F.col(reported).between(F.col(actual) * (1 - tol), F.col(actual) * (1 + tol))
    return df.withColumn("duration_ok", ok)


def voiced(clips: DataFrame, segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return clips.join(segs.select(*keys).distinct(), list(keys), "left_semi")


def silent(clips: DataFrame, segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return clips.join(segs.select(*keys).distinct(), list(keys), "left_anti")


def nest(clips: DataFrame, segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One record per clip: its columns and its segments as an array in order of emission.

    Silent clips get an empty array.  A record is one row by definition, so its segments meet in one
    task; they are a small part of the frames that they come from.
    """
    fields = ["start_s", "end_s", "speaker_id", "confidence"]
    nested = (
        segs.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("emit_order", *fields))).alias("_s"))
        .select(*keys, F.transform("_s", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("segments"))
    )
    empty = F.array().cast(nested.schema["segments"].dataType)
    return clips.join(nested, list(keys), "left").withColumn("segments", F.coalesce("segments", empty))


def realtime_factor(results: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Audio seconds per wall second."""
    return results.groupBy(*by).agg(
        F.sum("duration_s").alias("audio_s"),
        F.sum("elapsed_s").alias("wall_s"),
        (F.sum("duration_s") / F.sum("elapsed_s")).alias("realtime_factor"),
    )


# --- agreement ----------------------------------------------------------------------


def _holding(hist: DataFrame, order: str, rank: Column, *fields: str) -> DataFrame:
    """The one histogram row that holds place ``rank``, and the place left inside it (``rest``)."""
    w = Window.orderBy(order)
    below = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    placed = hist.withColumns({"_below": below, "_rank": rank})
    inside = (F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("c"))
    return placed.filter(inside).select(*fields, (F.col("_rank") - F.col("_below")).alias("rest"))


def exact_rank(df: DataFrame, value: str, fraction: float, cells: int = 1 << 16) -> DataFrame:
    """One row: n, n_null, v_max, v_mean and v_rank, the element at sorted place floor((n - 1) * fraction).

    Exact without a total sort, in three passes that each leave a bounded histogram.  Cells of
    fixed relative width (1024 per octave) give the totals and the cell of the rank; that cell is
    split again; only the distinct values of the last cell are ordered.  The cell to look into is
    a single row, broadcast to the next pass.  ``value`` must not be negative.
    """
    v = df.select(F.col(value).cast("double").alias("v"))
    octave = F.when(F.col("v") > 0, F.floor(F.log2("v") * 1024)).when(F.col("v") == 0, F.lit(-(1 << 40)))
    coarse = v.withColumn("cell", octave.cast("bigint"))
    hist = coarse.groupBy("cell").agg(
        F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    some = F.col("cell").isNotNull()
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.floor((F.sum("c").over(everything) - 1) * F.lit(fraction)).cast("bigint")
    first = _holding(hist.filter(some), "cell", rank, "cell", "lo", "hi")

    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    fine = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise(F.lit(0))
    split = coarse.join(F.broadcast(first), "cell").select("v", "rest", fine.cast("bigint").alias("part"))
    parts = split.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.max("rest").alias("_r"))
    second = _holding(parts, "part", F.col("_r"), "part")

    last = split.drop("rest").join(F.broadcast(second), "part").groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max("rest").alias("_r"))
    return hist.agg(
        F.coalesce(F.sum(F.when(some, F.col("c"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~some, F.col("c"))), F.lit(0)).alias("n_null"),
        F.max("hi").alias("v_max"), F.sum("s").alias("_s"),
    ).select(
        "n", "n_null", "v_max", (F.col("_s") / F.col("n")).alias("v_mean"),
        _holding(last, "v", F.col("_r"), "v").select("v").scalar().alias("v_rank"),
    )


def compare_tables(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value",
                   tol_p99: float = 5e-2, tol_max: float = 1e-1) -> DataFrame:
    """Parity of two value tables: shape, max / mean / p99 of |a - b|, verdict."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on), "full_outer")
    # A row that only one side has gives a null difference.  The narrow column is kept, as the rank
    # takes several passes over it and the join should run once.
    diff = kept(both.select(F.abs(F.col("_a") - F.col("_b")).alias("d")))
    return exact_rank(diff, "d", 0.99).select(
        F.col("n").alias("n_compared"), F.col("n_null").alias("n_unmatched"),
        F.col("v_max").alias("max_abs"), F.col("v_mean").alias("mean_abs"), F.col("v_rank").alias("p99_abs"),
        ((F.col("n_null") == 0) & (F.col("v_max") <= tol_max) & (F.col("v_rank") <= tol_p99)).alias("passed"),
    )


def match_segments(a: DataFrame, b: DataFrame, tol: float = 0.1, bucket_s: float = 10.0,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping pairs of the same speaker with their IoU, and the unmatched rest of both sides.

    The interval join is an equi-join on time buckets; a pair is kept in the bucket where the
    later of the two starts lies, so it appears once.  Identical rows of one side are matched once
    and given back as often as they (or their combinations) occur.
    """
    def spread(df, tag):
        lo, hi = F.floor(F.col("start_s") / bucket_s), F.floor(F.col("end_s") / bucket_s)
        df = df.groupBy(*keys, "speaker_id", "start_s", "end_s").agg(F.count(F.lit(1)).alias(f"{tag}_n"))
        return df.select(
            *keys, "speaker_id", F.col("start_s").alias(f"{tag}_start"), F.col("end_s").alias(f"{tag}_end"), f"{tag}_n",
            F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))).alias("_b"),
        )

    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    joined = spread(a, "a").join(spread(b, "b"), [*keys, "speaker_id", "_b"], "full_outer")
    has_a, has_b = F.col("a_start").isNotNull(), F.col("b_start").isNotNull()
    overlap = has_a & has_b & (start < end)
    none = F.lit(None).cast("double")

    def record(side, a_cols, b_cols, hit):
        times = F.lit(1).cast("bigint")
        for tag, used in (("a", a_cols), ("b", b_cols)):
            times = times * F.col(f"{tag}_n") if used else times
        return F.struct(
            F.lit(side).alias("side"),
            *[(F.col(c) if a_cols else none).alias(c) for c in ("a_start", "a_end")],
            *[(F.col(c) if b_cols else none).alias(c) for c in ("b_start", "b_end")],
            hit.alias("hit"), times.alias("times"),
        )

    # Every bucket row reports its pair (in one bucket only) and, for each side, whether the
    # segment overlapped something there; a segment without any hit is unmatched.
    reports = F.array_compact(F.array(
        F.when(overlap & (F.floor(start / bucket_s) == F.col("_b")), record("both", True, True, F.lit(True))),
        F.when(has_a, record("a_only", True, False, overlap)),
        F.when(has_b, record("b_only", False, True, overlap)),
    ))
    told = joined.select(*keys, "speaker_id", F.explode(reports).alias("_r")).select(*keys, "speaker_id", "_r.*")
    bounds = ["a_start", "a_end", "b_start", "b_end"]
    kept_rows = told.groupBy(*keys, "speaker_id", "side", *bounds).agg(
        F.max("hit").alias("hit"), F.max("times").alias("times")).filter("side = 'both' or not hit")
    kept_rows = kept_rows.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    iou = (end - start) / (F.greatest("a_end", "b_end") - F.least("a_start", "b_start"))
    near = (F.abs(F.col("a_start") - F.col("b_start")) <= tol) & (F.abs(F.col("a_end") - F.col("b_end")) <= tol)
    paired = F.col("side") == "both"
    return kept_rows.select(
        *keys, "speaker_id", *bounds, F.when(paired, iou).otherwise(F.lit(0.0)).alias("iou"),
        F.when(paired, near).otherwise(F.lit(False)).alias("same_bounds"), "side",
    )
