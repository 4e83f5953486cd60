"""Segmenters over packed frames: one array of scores per (clip, block), no exchange of the frames.

A block decides all frames whose look-back and look-ahead lie inside it and is then summarised by its
alternating switches (state in -> state out).  Of the scores themselves only the frames next to its two
edges leave the task, some hundreds of bytes for ``BLOCK`` frames; the two sides of an edge meet and decide
the frames around it.  Edges and inner parts, in turn, are the blocks whose switches ``segmenting`` composes
across a recording of any length.  Results equal those of ``segment_models`` on one row per frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechspark.functions.blocks import BLOCK, FAN
from speechspark.operators.segmenting import KEYS, SegmentParams, resolve, segments_of_switches

_ITEM = pa.struct([("at", pa.int64()), ("ev", pa.int32())])
_PART = pa.struct([("model", pa.string()), ("items", pa.list_(_ITEM))])
_PARTS = "array<struct<model: string, items: array<struct<at: bigint, ev: int>>>>"


def pack_frames(df: DataFrame, p: str = "p", keys: Sequence[str] = KEYS, order: str = "frame_idx", block: int = BLOCK) -> DataFrame:
    """Keys, ``block_idx`` and ``p`` as an array, from one row per frame; a hole in a block becomes nulls."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(p).cast("double").alias("v"))))
    packed = df.groupBy(*keys, F.expr(f"`{order}` div {block}").cast("bigint").alias("block_idx")).agg(rows.alias("_r"))
    first = F.col("block_idx") * block
    whole = F.element_at("_r", -1)["i"] == first + F.size("_r") - 1
    by_place = F.map_from_entries("_r")
    places = F.sequence(first, F.element_at("_r", -1)["i"].cast("bigint"))
    return packed.select(*keys, "block_idx", F.when(whole, F.transform("_r", lambda x: x["v"])).otherwise(
        F.transform(places, lambda i: by_place[i])).alias(p))


def _means(scores, width: int):
    """Trailing means, summed from the oldest frame on; shorter where ``scores`` begin."""
    import numpy as np

    total = np.zeros(len(scores))
    for back in range(min(width, len(scores)) - 1, -1, -1):
        total[back:] += scores[:len(scores) - back]
    return total / np.minimum(np.arange(1, len(scores) + 1), width)


def _held(flag, k: int):
    """True where ``flag`` held on this and the k - 1 frames before it."""
    import numpy as np

    place = np.arange(len(flag))
    return place - np.maximum.accumulate(np.where(flag, -1, place)) >= k if len(flag) else flag


def switches(scores, params: SegmentParams):
    """1 where speech may switch on, 0 where it may switch off, else -1; ``scores`` are consecutive frames."""
    import numpy as np

    x = _means(scores, params.smooth) if params.smooth > 1 else scores
    x = x.astype(np.float32)
    x = np.where(np.isnan(x), np.float32(np.inf), x)  # as in SQL, nothing is above a NaN
    on = x <= np.float32(params.on) if params.invert else x >= np.float32(params.on)
    if params.vote_half:
        run = np.concatenate([[0], np.cumsum(on)])
        place = np.arange(len(on))
        on = run[np.minimum(place + params.vote_half, len(on))] - run[np.maximum(place - params.vote_half, 0)] >= params.vote_need
    off = ~on if params.off is None else x < np.float32(params.off)
    return np.where(_held(on, params.k), 1, np.where(_held(off, params.m), 0, -1))


def _items(scores, first: int, lo: int, hi: int, models: Mapping[str, SegmentParams]) -> list[dict]:
    """Alternating switches per model at the frames [lo, hi) of the clip; ``scores`` begin at frame ``first``."""
    import numpy as np

    out = []
    for name, params in models.items():
        ev = switches(scores, params)[lo - first:hi - first]
        at = np.flatnonzero(ev >= 0)
        at = at[np.concatenate([[True], np.diff(ev[at]) != 0])] if len(at) else at
        out.append({"model": name, "items": [{"at": int(lo + i), "ev": int(ev[i])} for i in at]})
    return out


def packed_switches(
    df: DataFrame, models: Mapping[str, SegmentParams], p: str, keys: Sequence[str], block: int, index: str = "block_idx",
) -> DataFrame:
    """Keys, ``_blk``, ``_end``, ``_rows``, ``model``, ``items`` of inner parts (odd) and edges (even)."""
    back, ahead = max(m.back for m in models.values()), max(m.ahead for m in models.values())
    reach = back + ahead
    if block < 2 * reach:
        raise ValueError(f"block of {block} frames is smaller than twice its reach of {reach}")
    schema = df.select(*keys).schema
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            take, rows = [], []
            for r in range(b.num_rows):
                blk, scores = b.column(len(keys))[r].as_py(), b.column(len(keys) + 1)[r]
                values = scores.values
                if values is None or blk is None or not len(values):
                    continue
                first, n = blk * block, len(values)
                missing = values.is_null().to_numpy(zero_copy_only=False)
                x = np.where(missing, 0.0, values.fill_null(0.0).to_numpy(zero_copy_only=False))
                raw = [None if m else v for m, v in zip(missing[:reach], x[:reach].tolist(), strict=True)]
                last = [None if m else v for m, v in zip(missing[-reach:], x[-reach:].tolist(), strict=True)] if reach else []
                lo, hi = min(back, n), max(n - ahead, min(back, n))
                if n > block:
                    raise ValueError(f"a block has {n} frames, more than {block}")
                rows.append((2 * blk, None, raw if reach else [], first, n, None, None, None))
                if hi > lo:
                    rows.append((2 * blk + 1, None, None, None, None, _items(x, first, first + lo, first + hi, models), first + hi, int((~missing[lo:hi]).sum())))
                rows.append((2 * blk + 2, last, None, None, n, None, None, None))
                take += [r] * (2 + (hi > lo))
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.list_(_PART), pa.int64(), pa.int64()]
            cols = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)]
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(at) for k in range(len(keys))), *cols],
                names=[*keys, "_blk", "tail", "head", "first", "n", "parts", "_end", "_rows"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["parts"] is not None:
                    continue
                tail, head, n = r["tail"] or [], r["head"] or [], r["head_n"]
                start = r["_blk"] // 2 * block  # the first frame behind the edge
                both = [*tail, *head]
                missing = np.array([v is None for v in both], dtype=bool)
                x = np.array([0.0 if v is None else v for v in both])
                # Behind the edge to the inner part, before it from the inner part on; a short last block has none.
                left = min(ahead, max(r["tail_n"] - min(back, r["tail_n"]), 0)) if r["tail_n"] is not None else 0
                # The last block's tail ends at the clip's end, which is not the grid of blocks.
                edge = start if r["head"] is not None else start - block + (r["tail_n"] or 0)
                right = min(back, n) if n is not None else 0
                a, e = len(tail) - left, len(tail) + right
                r["_end"], r["_rows"] = edge + right, int((~missing[a:e]).sum())
                r["parts"] = _items(x, edge - len(tail), edge - left, edge + right, models)
            cols = [b.column(k) for k in range(len(keys))]
            parts, end, count = (pa.array([r[c] for r in rows], kind) for c, kind in (
                ("parts", pa.list_(_PART)), ("_end", pa.int64()), ("_rows", pa.int64())))
            yield pa.RecordBatch.from_arrays([*cols, b.column(len(keys)), parts, end, count], names=[*keys, "_blk", "parts", "_end", "_rows"])

    rows = df.select(*keys, F.col(index).cast("bigint"), F.col(p).cast("array<double>")).mapInArrow(
        inner, f"{typed}, _blk bigint, tail array<double>, head array<double>, first bigint, n bigint, parts {_PARTS}, _end bigint, _rows bigint")
    some = lambda c: F.first(c, ignorenulls=True)
    met = rows.groupBy(*keys, "_blk").agg(
        some("tail").alias("tail"), some("head").alias("head"),
        some(F.when(F.col("tail").isNotNull(), F.col("n"))).alias("tail_n"), some(F.when(F.col("head").isNotNull(), F.col("n"))).alias("head_n"),
        some("parts").alias("parts"), some("_end").alias("_end"), F.sum("_rows").alias("_rows"))
    done = met.mapInArrow(edges, f"{typed}, _blk bigint, parts {_PARTS}, _end bigint, _rows bigint")
    whole = [*keys, "_blk", "_end", "_rows"]
    return done.select(*whole, F.explode("parts").alias("_m")).select(*whole, "_m.*")


def segment_packed(
    df: DataFrame, models: Mapping[str, str | SegmentParams] | Sequence[str], p: str = "p", keys: Sequence[str] = KEYS,
    block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """``segment_models`` for packed frames: keys, ``block_idx``, ``p`` with the block's scores in order.

    All blocks of a clip but the last have ``block`` frames.  A missing block, a short one inside a clip or a
    null score leave the clip without segments, as there; so does a block that comes twice, unless it is so
    short that edges cover it.  Empty and null arrays are no blocks.
    """
    models = {n: resolve(v) for n, v in (models.items() if isinstance(models, Mapping) else ((n, n) for n in models))}
    return segments_of_switches(packed_switches(df, models, p, keys, block), models, keys, block, fan)
