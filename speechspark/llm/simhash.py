"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is compared through bit masks.  Bit i gets a vector m(i) of r + 1 digits modulo a prime
q; mask v (a point of the projective space of such vectors) keeps the bits with <m(i), v> != 0.  For
any r differing bits, r equations in r + 1 unknowns leave a non-zero v whose mask keeps none of them:
every pair within radius r agrees on some mask, so nothing is missed.  q = 2 and r = 2 give 7 masks of
about 36 bits, q = 3 gives 13 of about 43.

Buckets are counted with map-side combining, never gathered.  A bucket of two is one comparison.  The
fingerprints of larger buckets are linked exactly through their neighbours: two of them differ in at
most two bits if and only if some word of 64 bits differs from both in at most one, so each sends
itself to its 65 neighbours, where at most 65 can meet.  Work is linear however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import checkpointed, stored

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Rows from which masks of 43 instead of 36 bits keep chance meetings rare; results are the same.
WIDE_MASKS = 1 << 31
#: Links that a task of a round takes at least: each task leaves files, which outweigh a few links.
TASK_LINKS = 1 << 16


def masks(radius: int = RADIUS, prime: int = 2, bits: int = 64) -> list[int]:
    """The covering masks: (prime^(radius+1) - 1) / (prime - 1) of them."""
    dims = radius + 1
    points = [p for p in product(range(prime), repeat=dims) if any(p) and next(x for x in p if x) == 1]
    out = []
    for v in points:
        dot = (sum(a * b for a, b in zip(points[i % len(points)], v, strict=True)) % prime for i in range(bits))
        out.append(sum(1 << i for i, d in enumerate(dot) if d))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit majority vote over the XXH64 of all word shingles; zero without words."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < shingle:
        grams = [b" ".join(parts)]
    else:
        grams = map(b" ".join, zip(*(parts[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=">u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # very long texts in pieces
        votes += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(``i``, ``f``): id and fingerprint (as a signed long) of every row, read from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [fingerprint(x.as_py(), shingle) for x in b.column(1)]
            signed = [x - (1 << 64) if x >> 63 else x for x in f]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64())], names=["i", "f"])

    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(run, f"i {kind}, f long")


def links(prints: DataFrame, radius: int = RADIUS, prime: int = 2) -> DataFrame:
    """(``a``, ``b``), a < b: enough links between distinct fingerprints ``f`` to join all within the radius.

    Larger radii than two go through the pairs of two-bucket tables only for buckets of two and through
    ``radius``-step neighbours otherwise, so the radius is held at two.
    """
    if radius != 2:
        raise ValueError("the exact way for crowded buckets is made for radius 2")
    tables = F.array(*[
        F.struct(F.lit(k).alias("m"), F.col("f").bitwiseAND(F.lit(v - (1 << 64) if v >> 63 else v)).alias("k"))
        for k, v in enumerate(masks(radius, prime))
    ])
    keyed = prints.select("f", F.explode(tables).alias("t")).select("f", "t.m", "t.k")
    buckets = stored(
        keyed.groupBy("m", "k").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).filter("n > 1"),
        "buckets",
    )
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = buckets.filter("n = 2").filter(differ <= radius).select("a", "b")
    crowded = keyed.join(buckets.filter("n > 2").select("m", "k"), ["m", "k"]).select("f").distinct()
    flips = F.array(F.col("f"), *[F.col("f").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(64)])
    meet = (
        crowded.select("f", F.explode(flips).alias("z")).groupBy("z")
        .agg(F.collect_set("f").alias("s")).filter(F.size("s") > 1)
    )
    stars = meet.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a < b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``v``, ``root``): each vertex of the links (``a``, ``b``) and the least vertex of its component.

    Alternates large-star and small-star steps until the links stand still; every step is a min per
    vertex (combined before the exchange) and a join, and ends in a checkpoint.  Few links are dealt to no
    more tasks than run at once, whatever the number of shuffle partitions.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(max(cores, before[0] // TASK_LINKS))

    def hang(both: DataFrame, larger: bool) -> DataFrame:
        """Hang neighbours of u under the least of u and its neighbours."""
        side = F.col("b") > F.col("a") if larger else F.col("b") < F.col("a")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        moved = both.filter(side).join(least, "a").select(F.col("root").alias("a"), "b")
        if not larger:
            moved = moved.unionByName(least.select(F.col("root").alias("a"), F.col("a").alias("b")))
        return dealt(dealt(moved.filter("a <> b")).distinct())

    turn = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = checkpointed(edges.select("a", "b"))
    before = state(edges)
    while before[0]:
        large = hang(dealt(edges.unionByName(turn(edges))), True).select("a", "b")
        small = hang(turn(large), False)  # here every b is below its a
        edges = checkpointed(dealt(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "v")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, prime: int | None = None,
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable).

    Texts without words (null or empty too) have fingerprint zero and link like any other.  Equal
    fingerprints are one vertex, so copies cost nothing; repeated rows get equal values.  Null ids take
    part but are never a component's least id unless all of its ids are null.  Other columns are not read.
    ``prime`` picks the family of masks; by default it follows the number of rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    if prime is None:
        prime = 2 if prints.count() < WIDE_MASKS else 3
    owners = prints.groupBy("f").agg(F.min("i").alias("least"))
    roots = components(links(owners.select("f"), prime=prime))
    grouped = owners.join(roots.withColumnRenamed("v", "f"), "f", "left").select(
        "f", "least", F.coalesce("root", "f").alias("root"))
    linked = roots.select("root").distinct()
    many = grouped.join(linked, "root", "left_semi")
    of_root = many.groupBy("root").agg(F.min("least").alias("component"))
    component = grouped.join(of_root, "root", "left").select("f", F.coalesce("component", "least").alias("component"))
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return prints.join(component, "f").select(
        F.col("i").alias(id_col), hexed.alias("fingerprint"), F.col("component").alias("component_id"))
