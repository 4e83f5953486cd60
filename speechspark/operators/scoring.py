"""Plugging a scoring model into the frame tables.

A scorer sees one bounded matrix at a time: a stretch of feature frames with context on both
sides, one analysis window, or the chunks of a clip in order.  Spark decides where it runs; a
failing stretch gives a row with ``error`` and leaves the rest alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechspark.functions.blocks import with_halo
from speechspark.session import kept
from speechspark.sources.pcm import check_output_length

KEYS = ("clip_id",)
MAX_MODEL_BYTES = 256 << 20

# Tensor shapes of the models that carry state.
CACHE_SHAPE, N_CACHES = (1, 128, 19, 1), 4
RNN_STATE_SHAPE, RNN_CONTEXT = (2, 1, 128), 64


class Scorer(Protocol):
    """``score`` maps a [T, D] matrix to one value per ``frames_per_output`` frames.

    ``context``, if a scorer has it, is its receptive field in frames on either side.
    """

    frames_per_output: int

    def score(self, features: np.ndarray) -> np.ndarray: ...


def load_model(spark: SparkSession, data: bytes):
    """Broadcast model bytes; larger models must be read by path on the executors."""
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"model of {len(data)} bytes exceeds {MAX_MODEL_BYTES}")
    return spark.sparkContext.broadcast(data)


class OnnxSession:
    """Builds the runtime session once per Python worker from broadcast bytes or a shared path."""

    def __init__(self, model):
        if isinstance(model, bytes) and len(model) > MAX_MODEL_BYTES:
            raise ValueError(f"model of {len(model)} bytes exceeds {MAX_MODEL_BYTES}")
        self.model = model
        self._session = None

    def __getstate__(self):
        return {"model": self.model, "_session": None}

    def run(self, outputs: Sequence[str], feeds: Mapping[str, np.ndarray]) -> list[np.ndarray]:
        if self._session is None:
            import onnxruntime as ort

            opts = ort.SessionOptions()
            opts.intra_op_num_threads = 1
            source = self.model if isinstance(self.model, (str, bytes)) else self.model.value
            self._session = ort.InferenceSession(source, opts, providers=["CPUExecutionProvider"])
        return self._session.run(list(outputs), dict(feeds))


class FrameProbScorer:
    """[1, T, D] -> [1, T, 1] probabilities."""

    frames_per_output = 1

    def __init__(self, model, feed="feat", fetch="probs"):
        self.session, self.feed, self.fetch = OnnxSession(model), feed, fetch

    def score(self, features):
        return self.session.run([self.fetch], {self.feed: features[None]})[0].reshape(-1)


class CachedClassScorer:
    """[1, T, D] with zero caches -> [1, T, C]; keeps class 0 (silence)."""

    frames_per_output = 1

    def __init__(self, model, feed="speech", cache="in_cache", fetch="logits", n_caches=N_CACHES, shape=CACHE_SHAPE):
        self.session, self.feed, self.fetch = OnnxSession(model), feed, fetch
        self.caches = {f"{cache}{i}": np.zeros(shape, np.float32) for i in range(n_caches)}

    def score(self, features):
        return self.session.run([self.fetch], {self.feed: features[None], **self.caches})[0][0, :, 0]


class PairLogitScorer:
    """Channels first [1, D, T] -> [1, T / 2, 2] logits; softmax of class 1."""

    frames_per_output = 2

    def __init__(self, model, feed="audio_signal", fetch="logits"):
        self.session, self.feed, self.fetch = OnnxSession(model), feed, fetch

    def score(self, features):
        logits = self.session.run([self.fetch], {self.feed: np.ascontiguousarray(features.T)[None]})[0][0].astype(np.float64)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return (e[:, 1] / e.sum(axis=1)).astype(np.float32)


class WindowClassScorer:
    """[1, 1, W] samples -> [1, F, C] log-probabilities."""

    def __init__(self, model, feed="input_values", fetch="logits"):
        self.session, self.feed, self.fetch = OnnxSession(model), feed, fetch

    def score(self, samples):
        return self.session.run([self.fetch], {self.feed: samples[None, None]})[0][0]


class RecurrentScorer:
    """One chunk of samples at a time with (state, context) carried inside a clip."""

    def __init__(self, model, feeds=("input", "state", "context"), fetches=("prob", "stateN", "contextN"),
                 state_shape=RNN_STATE_SHAPE, context=RNN_CONTEXT):
        self.session, self.feeds, self.fetches = OnnxSession(model), feeds, fetches
        self.state_shape, self.context = state_shape, context

    def start(self):
        return np.zeros(self.state_shape, np.float32), np.zeros((1, self.context), np.float32)

    def step(self, samples, carried):
        prob, state, context = self.session.run(self.fetches, dict(zip(self.feeds, (samples[None], *carried))))
        return float(prob.reshape(-1)[0]), (state, context)


def energy_score(features: DataFrame, mid: float = -8.0, slope: float = 1.0, column: str = "mel", out: str = "p") -> DataFrame:
    """Weight-free baseline: logistic of the mean log-mel energy, as a column expression."""
    total = F.aggregate(column, F.lit(0.0), lambda a, v: a + v.cast("double"))
    mean = total / F.size(column)
    return features.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(slope) * (mean - F.lit(mid)))))


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def score_frames(features: DataFrame, scorer: Scorer, frames_per_part: int = 3_000, context: int | None = None,
                 keys: Sequence[str] = KEYS, column: str = "mel") -> DataFrame:
    """keys, frame_idx, p, error, elapsed_ms.

    A scorer that declares its receptive field (``context``, frames on both sides, or the argument)
    scores a clip in parts of ``frames_per_part`` frames with that overlap, which equals scoring it
    whole.  Without one, every clip is scored in one piece.  A clip of which any part fails gives
    one row with ``error`` (that of its first failing part) and no frames.
    """
    ratio = scorer.frames_per_output
    context = getattr(scorer, "context", None) if context is None else context
    rows = features.select(*keys, "frame_idx", column)
    if context is None:
        rows = rows.withColumn("_blk", F.lit(0).cast("bigint")).withColumn("_own", F.lit(True))
    else:
        context = -(-context // ratio) * ratio
        if frames_per_part % ratio:
            raise ValueError("a part must hold whole strides of the model")
        rows = with_halo(rows, "frame_idx", context, context, frames_per_part)
    parts = (
        rows.groupBy(*keys, "_blk")
        .agg(F.sort_array(F.collect_list(F.struct("frame_idx", "_own", column))).alias("_f"))
        .filter(F.exists("_f", lambda x: x["_own"]))
        .select(*keys, "_blk", F.col("_f.frame_idx").alias("idx"), F.col("_f._own").alias("own"), F.col(f"_f.{column}").alias("mat"))
    )

    def run(batches):
        for pdf in batches:
            out = {"idx": [], "p": [], "error": [], "ms": []}
            for indexes, own, frames in zip(pdf.idx, pdf.own, pdf.mat):
                begin = time.perf_counter()
                try:
                    mat = np.stack(frames).astype(np.float32)
                    p = np.asarray(scorer.score(mat), dtype=np.float32)
                    error = check_output_length(p, len(mat) // ratio)
                except Exception as e:  # noqa: BLE001 - one clip must not stop the others
                    p, error = np.zeros(0, np.float32), f"{type(e).__name__}: {e}"
                ms = (time.perf_counter() - begin) * 1000
                keep = np.asarray(own, dtype=bool)[: len(p) * ratio : ratio]
                at = np.asarray(indexes)[: len(p) * ratio : ratio] // ratio
                out["idx"].append([] if error else at[keep])
                out["p"].append([] if error else p[keep])
                out["error"].append(error)
                out["ms"].append(ms)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "_blk": pdf["_blk"], **out})

    scored = parts.mapInPandas(
        run, f"{_key_types(features, keys)}, _blk bigint, idx array<bigint>, p array<float>, error string, ms double")
    # One row per part meets here, not one per frame.
    clip = Window.partitionBy(*keys)
    scored = scored.withColumn("_bad", F.min(F.when(F.col("error").isNotNull(), F.struct("_blk", "error"))).over(clip))
    frames = F.transform(F.arrays_zip("idx", "p"), lambda x: F.struct(x["idx"].alias("frame_idx"), x["p"].alias("p")))
    void = F.array(F.struct(F.lit(None).cast("bigint").alias("frame_idx"), F.lit(None).cast("float").alias("p")))
    shown = F.when(F.col("_bad").isNull(), frames).when(F.col("_bad._blk") == F.col("_blk"), void)
    each = F.col("ms") / F.greatest(F.size("idx"), F.lit(1))
    return scored.select(*keys, F.explode(shown).alias("_x"), F.col("_bad.error").alias("error"), each.alias("elapsed_ms")).select(
        *keys, "_x.frame_idx", "_x.p", "error", "elapsed_ms")


def score_windows(windows: DataFrame, scorer: WindowClassScorer, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows from ``chunk(..., tail="pad")`` -> keys, window_idx, frame_idx, logits, error.

    A window that fails gives one row with ``error`` and neither frames nor logits.
    """

    def run(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                try:
                    out = list(np.asarray(scorer.score(np.asarray(pdf.samples.iat[i], dtype=np.float32)), dtype=np.float32))
                    at, error = list(range(len(out))), None
                except Exception as e:  # noqa: BLE001 - one window must not stop the others
                    at, out, error = [None], [None], f"{type(e).__name__}: {e}"
                yield pd.DataFrame({
                    **{k: [pdf[k].iat[i]] * len(out) for k in keys}, "window_idx": pdf.chunk_idx.iat[i],
                    "frame_idx": pd.array(at, dtype="Int64"), "logits": out, "error": pd.Series([error] * len(out), dtype=object),
                })

    return windows.select(*keys, "chunk_idx", "samples").mapInPandas(
        run, f"{_key_types(windows, keys)}, window_idx bigint, frame_idx bigint, logits array<float>, error string"
    )


def score_chunks(chunks: DataFrame, scorer, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sequential scoring of a clip's chunks: keys, frame_idx, p, error.

    The state depends on every earlier chunk, so a clip stays in one task; its chunks are sorted
    by Spark and pass through in batches, never held as a whole.  From a failing chunk on, a clip
    has rows with ``error`` and no score, so that the segmenters leave the clip out.
    """
    def run(batches):
        last, carried, failed = None, None, None
        for pdf in batches:
            p, errors = [], []
            for key, x in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf.samples):
                prob = None
                try:
                    if key != last:
                        last, failed = key, None
                        carried = scorer.start()
                    if failed is None:
                        prob, carried = scorer.step(np.asarray(x, dtype=np.float32), carried)
                except Exception as e:  # noqa: BLE001 - one clip must not stop the others
                    failed = f"{type(e).__name__}: {e}"
                p.append(prob)
                errors.append(failed)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "frame_idx": pdf.chunk_idx, "p": pd.array(p, dtype="Float32"),
                                "error": pd.Series(errors, dtype=object)})

    ordered = chunks.select(*keys, "chunk_idx", "samples").repartition(*keys).sortWithinPartitions(*keys, "chunk_idx")
    return ordered.mapInPandas(run, f"{_key_types(chunks, keys)}, frame_idx bigint, p float, error string")


SEGMENT_COLUMNS = (("start_s", "double"), ("end_s", "double"), ("speaker_id", "int"), ("confidence", "double"), ("model", "string"))


def compare_models(clips: DataFrame, models: Mapping[str, Callable[[DataFrame], DataFrame]], keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Run several models over the same clips: (segments with ``model``, results).

    ``models`` maps a name to a function from clips to segments.  Each model is run on its own and
    its segments are kept in the session's shared folder, so a failure while setting up or running
    ends that model alone: it gives results with ``error`` and no segments, also when no model is left.  Results have one row
    per (clip, model) with ``n_segments`` and the model's ``elapsed_ms``.
    """
    segs, notes = None, []
    for name, run in models.items():
        begin, error = time.perf_counter(), None
        try:
            out = kept(run(clips).withColumn("model", F.lit(name)))
            segs = out if segs is None else segs.unionByName(out)
        except Exception as e:  # noqa: BLE001 - reported per model
            error = f"{e}"
        notes.append((name, error, (time.perf_counter() - begin) * 1000))
    if segs is None:
        segs = clips.select(*keys).limit(0).selectExpr(*keys, *(f"cast(null as {kind}) as {c}" for c, kind in SEGMENT_COLUMNS))
    listed = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit(e).cast("string").alias("error"), F.lit(t).alias("elapsed_ms")) for n, e, t in notes]))
    results = clips.select(*keys).distinct().select(*keys, listed.alias("_m")).select(*keys, "_m.*")
    counts = segs.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("n_segments"))
    return segs, results.join(counts, [*keys, "model"], "left").fillna(0, ["n_segments"])
