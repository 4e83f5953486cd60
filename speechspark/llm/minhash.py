"""Near-duplicates by the Jaccard similarity of word shingles: MinHash tables, exact verification.

Each set of shingles (XXH64 of k words, lower case) gets ``TABLES`` keys of ``ROWS`` minimum hashes.  Sets
with similarity s share a key with probability 1 - (1 - s^5)^30: at 0.8 all but 7 in a million do, above it
more.  Every linked pair has been verified on whole sets; equal sets are one vertex.

The members of a bucket with up to ``CROWD`` are paired; pairs whose sizes or one-bit sketches (256 minima,
six standard deviations) rule the limit out are left before sets are fetched.  A larger bucket is a crowd of
copies, or of texts that share a passage and are unlike otherwise, and minima tell nothing about which: the
members of all such buckets are linked by the exact join of ``jaccard_join``, whose common order of the
shingles puts the frequent passage last.  So no crowd costs the square of its size, and the links inside
crowds don't depend on chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import content_key, small, stored
from speechspark.llm.jaccard_join import distinct_sets, jaccard_links, keyed_sets, plan
from speechspark.llm.simhash import SEED, components

SHINGLE = 5
PERCENT = 80
ROWS, TABLES, SLOTS = 5, 30, 256
#: Members of a bucket that are paired; larger buckets go through the exact join.
CROWD = 32
#: Bits of the sketch that a pair at the limit differs in: a tenth, and six standard deviations.
SKETCH_LIMIT = 54


def shingles(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct 64-bit hashes of all shingles; a shorter text is one shingle, none without words."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    if len(parts) < shingle:
        grams = [b" ".join(parts)]
    else:
        grams = map(b" ".join, zip(*(parts[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def factors():
    """The odd factors whose products order the hashes, one order a slot."""
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes, odd):
    """(keys of the tables, four words of sketch) of one set, as signed 64-bit values."""
    import numpy as np
    import xxhash

    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):  # in pieces that stay in the cache
        np.minimum(least, (hashes[at:at + 512, None] * odd).min(axis=0), out=least)
    raw = least[:ROWS * TABLES].tobytes()
    step = 8 * ROWS
    keys = np.array([xxhash.xxh64_intdigest(raw[k * step:(k + 1) * step], k) for k in range(TABLES)], dtype=np.uint64)
    sketch = np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.uint64)
    return keys.view(np.int64), sketch.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(``i``, ``c``, ``f``, ``n``, ``keys``, ``sketch``): ``c`` tells texts apart and ``f`` sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        odd = factors()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], [], []]
                for x in part.column(2):
                    h = shingles(x.as_py(), shingle)
                    f = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0]
                    for c, v in zip(cols, (f, len(h), *signature(h, odd)), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["i", "c", "f", "n", "keys", "sketch"])

    src = docs.select(F.col(id_col).alias("i"), content_key(F.col(text_col)).alias("c"), F.col(text_col).alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(run, f"i {kind}, c long, f long, n long, keys array<long>, sketch array<long>")


def whole_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(``f``, ``grams``) from (``f``, ``t``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                grams = [shingles(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["f", "grams"])

    return texts.select("f", "t").mapInArrow(run, "f long, grams array<long>")


def _may_reach(percent: int, x: str, y: str) -> Column:
    """Neither the sizes nor the sketches of the sets ``x`` and ``y`` rule the limit out."""
    nx, ny = F.col(f"{x}_n"), F.col(f"{y}_n")
    sizes = (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent)
    if percent < 80:
        return sizes
    differ = reduce(lambda p, q: p + q, (
        F.bit_count(F.col(f"{x}_sketch")[k].bitwiseXOR(F.col(f"{y}_sketch")[k])) for k in range(SLOTS // 64)))
    return sizes & (differ <= SKETCH_LIMIT)


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of vertices whose whole sets reach the limit."""
    left = whole.select(F.col("f").alias("a"), F.col("grams").alias("ga"))
    right = whole.select(F.col("f").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return (
        left.join(small(pairs), "a").join(right, "b")
        .filter(both * 100 >= (F.size("ga") + F.size("gb") - both) * percent).select("a", "b")
    )


def _texts_of(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """(``f``, ``c``, ``t``): one text of each row of the stored ``owners`` (``f``, ``c``); copies go before an exchange."""
    near = small(owners)
    if near is not owners:
        return texts.join(near, "c").dropDuplicates(["c"]).select("f", "c", "t")
    return texts.dropDuplicates(["c"]).join(owners, "c").select("f", "c", "t")


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``), a < b: members of a bucket with few that may reach the limit."""
    few = met.filter(F.col("members") <= CROWD)
    side = lambda p, q: few.select("k", F.col("f").alias(q), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch"))
    return side("x", "a").join(side("y", "b"), "k").filter((F.col("a") < F.col("b")) & _may_reach(percent, "x", "y")).select("a", "b").distinct()


def _crowd_links(crowd: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(``a``, ``b``): links that join all linked sets of ``crowd`` (``f``, ``c``)."""
    held = _texts_of(texts, crowd).withColumnRenamed("f", "i")
    frequent, boundary = plan(held, percent, shingle)
    rows = stored(keyed_sets(held, frequent, boundary, percent, shingle), "crowd-keys")
    sets = stored(distinct_sets(rows), "crowd-sets")
    found = jaccard_links(rows, sets, held, boundary, percent, shingle)
    name = lambda x: sets.select(F.col("v").alias(x), F.col("least").alias(f"{x}_f"))
    return found.join(name("a"), "a").join(name("b"), "b").select(F.least("a_f", "b_f").alias("a"), F.greatest("a_f", "b_f").alias("b"))


def links(sets: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(``a``, ``b``), a < b: verified links that join all candidate pairs which reach the limit.

    ``sets`` has one row per vertex: ``f``, ``c`` of one of its texts, ``n``, ``keys``, ``sketch``; ``texts`` has
    ``c`` and ``t``.  Only texts that may have a link are read again.
    """
    keyed = sets.filter("n > 0").select("f", "n", "sketch", F.posexplode("keys").alias("m", "key")).select(
        F.xxhash64("m", "key").alias("k"), "f", "n", "sketch")
    shared = keyed.groupBy("k").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(keyed.join(shared, "k"), "met")
    pairs = stored(_pairs(met, percent), "pairs")
    wanted = stored(sets.select("f", "c").join(pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct(), "f", "left_semi"), "wanted")
    whole = stored(whole_sets(_texts_of(texts, wanted), shingle), "whole")
    found = _verified(pairs, whole, percent)
    crowd = stored(sets.select("f", "c").join(met.filter(F.col("members") > CROWD).select("f").distinct(), "f", "left_semi"), "crowd")
    if crowd.isEmpty():
        return found
    return stored(found, "links").unionByName(_crowd_links(crowd, texts, percent, shingle)).distinct()


def _known_links(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(``a``, ``b``), a < b: links that join the sets ``f`` of ``rows`` (``i``, ``f``) which share a group in ``known`` (``i``, ``g``)."""
    placed = rows.select("i", "f").distinct().join(known.distinct(), "i").select("g", "f").distinct()
    return placed.join(placed.groupBy("g").agg(F.min("f").alias("a")), "g").filter("a < f").select("a", F.col("f").alias("b"))


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: id, ``component_id`` (least id reachable through pairs at ``percent`` or above).

    Texts without words (null or empty too) are one group.  Null ids take part but are never a component's
    least id unless all of its ids are null; repeated rows get equal values.  Other columns are not read.
    Rows that share a ``component_id`` in ``known`` (``id_col``, ``component_id``), such as the groups of
    another operator, are linked as well.
    """
    rows = stored(signatures(docs, id_col, text_col, shingle), "sets")
    firsts = [F.first(c).alias(c) for c in ("n", "keys", "sketch")]
    sets = stored(rows.groupBy("f").agg(F.min("c").alias("c"), *firsts), "distinct-sets")
    texts = docs.select(content_key(F.col(text_col)).alias("c"), F.col(text_col).alias("t"))
    owners = rows.groupBy("f").agg(F.min("i").alias("least"))
    found = links(sets, texts, percent, shingle)
    if known is not None:
        found = found.unionByName(_known_links(rows, known.select(F.col(id_col).alias("i"), F.col("component_id").alias("g"))))
    roots = components(found)
    grouped = owners.join(roots.withColumnRenamed("v", "f"), "f", "left").select(
        "f", "least", F.coalesce("root", "f").alias("root"))
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component"))
    component = grouped.join(of_root, "root").select("f", "component")
    return rows.select("i", "f").join(component, "f").select(F.col("i").alias(id_col), F.col("component").alias("component_id"))
