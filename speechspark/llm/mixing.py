"""Mixing sources to target weights by a splitting tree over exact block quotas.

A source's documents fall into ``BLOCKS`` blocks by a hash.  Its target in words is met by whole passes
over its blocks plus a part of one more pass: blocks in permuted order as long as they fit, and the one
further block that comes nearest to what is left.  That fixes how many block draws each source has.  A binary
tree over the output shards splits these quotas by the multivariate hypergeometric law, so every shard
holds an exact share; each source then deals its permuted draws to the shards in disjoint runs, and a
shard is shuffled on its own.  All randomness comes from the seed: reruns agree.

The driver holds one row per source.  Block tables have at most ``BLOCKS`` rows per source; texts take
part only in the one join that hands them out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from speechspark.llm.common import checkpointed, content_key, stored, words

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCKS = 4_096
SHARDS = 16
SEED = 20_240


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = MAX_COPIES) -> list[float]:
    """Share the sum of the sizes by weight; nothing above ``most`` times its size, the excess reshared."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Counts by shard and source; each node of the tree splits what it got hypergeometrically."""
    import numpy as np

    out: list[list[int]] = [[] for _ in range(shards)]
    todo = [(0, shards, np.array(quotas, dtype=np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts.tolist()
            continue
        mid, total = (lo + hi) // 2, int(counts.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, total * (mid - lo) // (hi - lo), method="marginals") if total else counts
        todo += [(lo, mid, left), (mid, hi, counts - left)]
    return out


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64("i", "c", F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _exchange(sizes: list[int], extra: list[int], left: float, rounds: int = 8) -> None:
    """Swap a taken block for one that isn't while that brings the sum nearer to the target."""
    for _ in range(rounds):
        out = sorted((n, k) for k, n in enumerate(sizes) if not extra[k])
        best = (abs(left), -1, -1)
        for k, n in enumerate(sizes):
            if extra[k]:
                at = bisect_left(out, (n + left, -1))
                best = min([best, *((abs(left + n - m), k, j) for m, j in out[max(at - 1, 0):at + 1])])
        if best[1] < 0:
            return
        extra[best[1]], extra[best[2]] = 0, 1
        left += sizes[best[1]] - sizes[best[2]]


def _choose(blocks: pd.DataFrame) -> pd.DataFrame:
    """Copies of each block of one source: its whole passes, and a part of one more pass.

    In permuted order a block is taken where it still fits, then the one block that brings the sum
    nearer to the target; at last a few swaps bring it nearer still.
    """
    blocks = blocks.sort_values("b")
    first = blocks.iloc[0]
    left = first["target"] - int(first["passes"]) * int(first["source_size"])
    sizes, extra = blocks["n"].tolist(), [0] * len(blocks)
    if left > 0:
        for k, n in enumerate(sizes):
            if n <= left:
                extra[k], left = 1, left - n
        beyond = [(abs(left - n), k) for k, n in enumerate(sizes) if not extra[k] and abs(left - n) < left]
        if beyond:
            extra[min(beyond)[1]], left = 1, left - sizes[min(beyond)[1]]
        _exchange(sizes, extra, left)
    return blocks.assign(copies=[int(first["passes"]) + x for x in extra])[["rank", "b", "copies"]]


def _plan(sizes: DataFrame, weights: Sequence[float], shards: int, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sources (``s``, ``source_size``, ``target``) and draws (``s``, ``b``, ``copy``, ``shard``) of (``s``, ``b``, ``n``)."""
    spark = sizes.sparkSession
    blocks = sizes.groupBy("s", "b").agg(F.sum("n").alias("n"))
    per_source = sizes.groupBy("s").agg(F.sum("n").alias("n")).collect()
    per_source.sort(key=lambda r: (r["s"] is None, r["s"] or ""))
    size = [r["n"] for r in per_source]
    goal = targets(size, [weights[k % len(weights)] for k in range(len(size))], most)
    passes = [min(int(g // n), most) if n else 0 for g, n in zip(goal, size, strict=True)]
    kind = T.StructType([
        T.StructField("s", sizes.schema["s"].dataType), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("passes", T.IntegerType()), T.StructField("rank", T.IntegerType())])
    sources = spark.createDataFrame(
        [(r["s"], n, g, p, k) for k, (r, n, g, p) in enumerate(zip(per_source, size, goal, passes, strict=True))], kind)

    left = sources.withColumnRenamed("s", "ss")
    placed = blocks.join(left, F.col("s").eqNullSafe(F.col("ss"))).select("rank", "b", "n", "passes", "source_size", "target")
    placed = checkpointed(placed.groupBy("rank").applyInPandas(_choose, "rank int, b int, copies int"))  # BLOCKS rows a group at most
    drawn = placed.filter("copies > 0").select("rank", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    place = Window.partitionBy("rank").orderBy("copy", F.xxhash64("rank", "copy", "b", F.lit(seed)))
    drawn = drawn.withColumn("place", F.row_number().over(place) - 1)

    quota = {r["rank"]: r["q"] for r in placed.groupBy("rank").agg(F.sum("copies").alias("q")).collect()}
    shares = split_quotas([quota.get(k, 0) for k in range(len(size))], shards, seed)
    ends = [[sum(shares[j][k] for j in range(i + 1)) for i in range(shards)] for k in range(len(size))]
    table = spark.createDataFrame(list(enumerate(ends)), "rank int, ends array<long>")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    draws = drawn.join(table, "rank").join(sources.select("rank", "s"), "rank").select("s", "b", "copy", shard.alias("shard"))
    return sources.select("s", "source_size", "target"), draws


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("i"), F.col(source_col).alias("s"), content_key(F.col(text_col)).alias("c"),
        F.size(words(F.col(text_col))).cast("long").alias("n"))
    return stored(rows.select("i", "s", "c", "n", _block(seed).alias("b")), "sizes")


def mix_amounts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[float] = WEIGHTS, most: int = MAX_COPIES, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target`` (its source's), ``taken`` (words, copies counted).

    Sources are ranked by code point, null last, and take the weights in turn.  Null and empty texts have
    size 0 and are drawn with their block; null ids are allowed; repeated rows share a block and are
    drawn together.  Other columns are not read.  An empty table gives no rows.
    """
    sizes = _sized(docs, id_col, text_col, source_col, seed)
    sources, draws = _plan(sizes, weights, shards, most, seed)
    copies = draws.groupBy("s", "b").agg(F.count("*").alias("copies")).withColumnsRenamed({"s": "cs", "b": "cb"})
    out = sizes.join(copies, F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb")), "left")
    out = out.join(sources.withColumnRenamed("s", "ss"), F.col("s").eqNullSafe(F.col("ss")))
    return out.select(
        F.col("i").alias(id_col), F.col("n").alias("size"), "source_size", "target",
        (F.col("n") * F.coalesce("copies", F.lit(0))).alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[float] = WEIGHTS, most: int = MAX_COPIES, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """The mixed rows: all columns of ``docs`` plus ``mix_copy``, ``mix_shard`` and ``mix_order``.

    A row appears once per draw of its block; ordering a shard by ``mix_order`` is its local shuffle.
    Input columns named like a result are replaced; otherwise as ``mix_amounts``.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_copy", "mix_shard", "mix_order")])
    _, draws = _plan(_sized(docs, id_col, text_col, source_col, seed), weights, shards, most, seed)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("i"),
        F.col(source_col).alias("s"), content_key(F.col(text_col)).alias("c")).withColumn("b", _block(seed))
    draws = draws.withColumnsRenamed({"s": "ds", "b": "db"})
    out = packed.join(draws, F.col("s").eqNullSafe(F.col("ds")) & (F.col("b") == F.col("db")))
    return out.select(
        "row.*", F.col("copy").alias("mix_copy"), F.col("shard").alias("mix_shard"),
        F.xxhash64("i", "c", "copy", F.lit(seed)).alias("mix_order"))
