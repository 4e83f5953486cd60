"""Exact Jaccard join of word-shingle sets by size: subsets for small sets, inverted lists for large ones.

Tokens (64-bit hashes of k words) have one order for all sets: by hash, frequent ones last.  Two sets that
reach the limit share ceil(limit * n) tokens of either, so

* their first n - ceil(limit * n) + 1 tokens meet in one token at least: *large* sets are found by scanning
  the inverted lists of these tokens;
* their first n - ceil(limit * n) + 2 tokens meet in two tokens at least: *small* sets list all pairs of
  these tokens, a key that is far rarer than a token.

A set is small up to a boundary ``B``; a pair of a small and a large set meets in a list, so small sets
that a large one can reach are listed too.  ``B`` has the least cost: the keys of the small sets against the
entries of the lists and the pairs that these make, measured on all texts of one content hash in
``SAMPLE``.  The sample also gives the tokens that come last in the order.  It decides cost alone: any
boundary and any order give the same links.

A key of one set is nothing.  The sets of a key with up to ``FEW`` are paired; a pair stays if it meets in
enough of its first tokens for the limit.  The sets of more frequent keys are linked by ``crowds`` (buckets
by key and size band).  Where linked sets first meet in the order, both still have as many tokens ahead as
they must share, which rules most other pairs out: frequent tokens come last, so an edited copy has its own
tokens first.  So a crowd of like texts costs comparisons in proportion to its size.  Every link is verified
on whole sets.  Equal sets are one vertex, told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import content_key, small, stored
from speechspark.llm.crowds import link_buckets
from speechspark.llm.simhash import components

SHINGLE = 5
PERCENT = 80
SEED = 42
#: One content hash in so many is read ahead for the order and the boundary.
SAMPLE = 16
#: Sightings in the sample that make a token frequent; frequent tokens at most (a broadcast of 1 MB).
OFTEN, FREQUENT = 4, 1 << 17
#: Sets of a key that are paired directly.
FEW = 64
#: Set sizes between which the boundary is chosen, and what a pair costs against a key.
STEPS = (0, 8, 12, 18, 27, 40, 60, 90, 135)
PAIR_COST = 2


def shingle_hashes(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the word shingles, A-Z lower-cased; a shorter text is one."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    one = {w: digest(w, SEED) for w in set(words)}
    hashes = np.fromiter(map(one.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(hashes) - shingle + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):  # a mix after every word, so that their order counts
        out = (out ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def spare(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that a partner at the limit may lack."""
    return n - -(-n * percent // 100)


def ordered(tokens, frequent):
    """The tokens in the common order: by hash, those of the sorted array ``frequent`` last."""
    import numpy as np

    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    late = frequent[at] == tokens
    return np.concatenate([tokens[~late], tokens[late]])


def keys_of(tokens, boundary: int, percent: int):
    """Keys of a set, its tokens given in the common order: list tokens, then hashed pairs by their later token."""
    import numpy as np

    n = len(tokens)
    first = spare(n, percent) + 1
    keys = [tokens[:0]]
    if n * 100 >= (boundary + 1) * percent:
        keys.append(tokens[:first])
    if 1 < n <= boundary:
        later, early = np.tril_indices(min(first + 1, n), -1)
        both = (tokens[early] * np.uint64(0x94D049BB133111EB)) ^ (tokens[later] >> np.uint64(1))
        both = (both ^ (both >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append(both ^ (both >> np.uint64(29)))
    return np.concatenate(keys)


def _needed(n: Column, percent: int) -> Column:
    """Tokens of a set of ``n`` that a partner at the limit has as well."""
    return F.ceil(n * percent / 100)


def _listed(boundary: int, percent: int) -> Column:
    """Keys of a set of ``n`` that are list tokens, its first ones."""
    n = F.col("n")
    return F.when(n * 100 >= (boundary + 1) * percent, n - _needed(n, percent) + 1).otherwise(0)


def _ahead(boundary: int, percent: int) -> Column:
    """Tokens that a set of ``n`` can share with one that it first meets in its key number ``at``.

    A token: those from it on.  A pair of tokens: those from the later one on, and the earlier one.
    """
    n = F.col("n")
    s = F.col("at") - _listed(boundary, percent)
    later = F.floor((F.sqrt(1 + 8 * s) + 1) / 2)
    return F.when(s < 0, n - F.col("at")).otherwise(n - later + 1).cast("int")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("i"), content_key(F.col(text_col)).alias("c"), F.col(text_col).alias("t"))


def _sets(texts: DataFrame, shingle: int, *, at: str = "c") -> DataFrame:
    """(``at``, ``tokens``) of texts ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                sets = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=[at, "tokens"])

    return texts.select(at, "t").mapInArrow(run, f"{at} long, tokens array<long>")


def _band(n: Column, percent: int) -> Column:
    """Size bands so wide that linked sets are in the same or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def plan(texts: DataFrame, percent: int, shingle: int):
    """(frequent tokens as a sorted array, boundary) from the sample."""
    import numpy as np

    some = texts.filter(F.pmod(F.col("c"), F.lit(SAMPLE)) == 0).dropDuplicates(["c"])
    sets = stored(_sets(some, shingle).filter(F.size("tokens") > 0), "sample")
    seen = sets.select(F.explode("tokens").alias("k")).groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") >= OFTEN)
    top = seen.orderBy(F.desc("c"), "k").limit(FREQUENT).select("k").collect()
    frequent = np.sort(np.array([r["k"] for r in top], dtype=np.int64).view(np.uint64))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                tokens = ordered(x.values.to_numpy().view(np.uint64), frequent)
                n = len(tokens)
                step = int(np.searchsorted(STEPS, n))
                first = spare(n, percent) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([step] * first), pa.array(tokens[:first].view(np.int64)), pa.array([(first + 1) / 2] * first)],
                    names=["step", "k", "subsets"])

    lists = sets.select("tokens").mapInArrow(entries, "step long, k long, subsets double")
    per = lists.groupBy("step", "k").agg(F.count("*").alias("c"), F.sum("subsets").alias("s")).groupBy("step").agg(
        F.sum("s").alias("subsets"), (F.sum("c") * SAMPLE + PAIR_COST * SAMPLE * SAMPLE * F.sum(F.col("c") * (F.col("c") - 1) / 2)).alias("lists"))
    cost = {r["step"]: (r["subsets"] * SAMPLE, r["lists"]) for r in per.collect()}  # one row per step
    total = [sum(c[0] for s, c in cost.items() if s <= k) + sum(c[1] for s, c in cost.items() if s > k) for k in range(len(STEPS))]
    return frequent, STEPS[min(range(len(STEPS)), key=total.__getitem__)]


def keyed_sets(texts: DataFrame, frequent, boundary: int, percent: int, shingle: int) -> DataFrame:
    """(``i``, ``c``, ``f``, ``g``, ``n``, ``keys``) of every row; ``f`` and ``g`` are hashes of the set."""
    late = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                f, g, n, keys = [], [], [], []
                for x in part.column(2):
                    tokens = shingle_hashes(x.as_py(), shingle)
                    raw = tokens.tobytes()
                    f.append(xxhash.xxh64_intdigest(raw, 1))
                    g.append(xxhash.xxh64_intdigest(raw, 2))
                    n.append(len(tokens))
                    keys.append(keys_of(ordered(tokens, late.value), boundary, percent).view(np.int64))
                f, g = (pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (f, g))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), f, g, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["i", "c", "f", "g", "n", "keys"])

    kind = texts.schema["i"].dataType.simpleString()
    return texts.select("i", "c", "t").mapInArrow(run, f"i {kind}, c long, f long, g long, n long, keys array<long>")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(``f``, ``g``, ``c``, ``least``, ``v``) of each set that is not empty.

    The vertex ``v`` is the first hash of the set, or a hash of both where two sets share the first.
    """
    sets = rows.filter("n > 0").groupBy("f", "g").agg(F.min("c").alias("c"), F.min("i").alias("least"))
    shared = stored(sets.groupBy("f").agg(F.count("*").alias("sets"), F.min("g").alias("kept")).filter("sets > 1").select("f", "kept"), "shared")
    return sets.join(shared, "f", "left").select("f", "g", "c", "least", _vertex().alias("v"))


def _vertex() -> Column:
    return F.when(F.col("kept") != F.col("g"), F.xxhash64("f", "g")).otherwise(F.col("f"))


def _paired(met: DataFrame, may, percent: int) -> DataFrame:
    """(``a``, ``b``): pairs that share a key of few sets and may reach the limit.

    All common tokens among the first ones are counted (at most those in frequent keys are added).  Beyond
    the end of the shorter of both beginnings, a pair shares no more than what is left of that set.
    """
    few = met.filter(F.col("c") <= FEW)
    side = lambda p, q: few.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "ahead", "token")], F.col("f").alias(q))
    size = (F.col("x_n") * 100 >= F.col("y_n") * percent) & (F.col("y_n") * 100 >= F.col("x_n") * percent)
    pairs = side("x", "a").join(side("y", "b"), "key").filter((F.col("a") < F.col("b")) & size).groupBy("a", "b").agg(
        F.max("x_n").alias("x_n"), F.max("y_n").alias("y_n"), F.count_if(F.col("x_token") & F.col("y_token")).alias("both"),
        F.max(may("x", "y") & ~(F.col("x_token") & F.col("y_token"))).alias("subset"), F.max(may("x", "y")).alias("may")).filter("may")
    more = met.filter((F.col("c") > FEW) & F.col("token")).groupBy("f").agg(F.count("*").alias("more"))
    pairs = pairs.join(more.select(F.col("f").alias("a"), F.col("more").alias("ma")), "a", "left").join(
        more.select(F.col("f").alias("b"), F.col("more").alias("mb")), "b", "left")
    both = F.col("both") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    left = F.greatest(_needed(F.col("x_n"), percent), _needed(F.col("y_n"), percent)) - 1
    return pairs.filter(F.col("subset") | ((both + left) * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent)).select("a", "b")


def jaccard_links(
    rows: DataFrame, sets: DataFrame, texts: DataFrame, boundary: int, percent: int = PERCENT, shingle: int = SHINGLE,
) -> DataFrame:
    """(``a``, ``b``), a < b: verified links between vertices that join all which reach the limit."""
    twins = stored(sets.filter("v <> f").select("f", "g", "v"), "twins")  # sets that share a hash: hardly any
    keyed = rows.join(twins, ["f", "g"], "left").select(
        F.coalesce("v", "f").alias("f"), F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("at", "key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    met = keyed.join(often, "key").groupBy("key", "f", "n").agg(F.min("at").alias("at")).select(
        "key", "f", "n", _ahead(boundary, percent).alias("ahead"), (F.col("at") < _listed(boundary, percent)).alias("token"))
    met = stored(met, "met")
    counts = met.groupBy("key").agg(F.count("*").cast("int").alias("c")).filter("c > 1")
    met = stored(met.join(counts, "key"), "counted")
    may = lambda x, y: F.least(f"{x}_ahead", f"{y}_ahead") * (100 + percent) >= (F.col(f"{x}_n") + F.col(f"{y}_n")) * percent
    pairs = stored(_paired(met, may, percent), "pairs")
    band = met.filter(F.col("c") > FEW).withColumn("band", F.explode(F.array(_band(F.col("n"), percent), _band(F.col("n"), percent) + 1)))
    band = stored(band.select(F.xxhash64("key", "band").alias("k"), "f", "n", "ahead"), "banded")
    mixed = band.groupBy("k").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.min("n").alias("least")).filter("lo <> hi")
    # Members with too few tokens ahead for the smallest set of their bucket meet nobody there.
    alive = band.join(mixed.select("k", "least"), "k").filter(F.col("ahead") * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
    crowded = stored(alive.groupBy("k", "f", "n").agg(F.max("ahead").alias("ahead")), "crowded")

    def whole_sets(wanted: DataFrame) -> DataFrame:
        owner = stored(sets.select("v", "c").join(wanted.distinct(), "v", "left_semi"), "owners")
        again = texts.select("c", "t").join(small(owner), "c").dropDuplicates(["v"])
        return stored(_sets(again, shingle, at="v"), "whole")

    def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        one = whole.select(F.col("v").alias("a"), F.col("tokens").alias("ta"))
        two = whole.select(F.col("v").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        return one.join(small(stored(pairs, "pairs")), "a").join(two, "b").filter(both * 100 >= (F.size("ta") + F.size("tb") - both) * percent).select("a", "b")

    few = stored(verified(pairs, whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("v")))), "links")
    if crowded.isEmpty():
        return few
    held = whole_sets(crowded.select(F.col("f").alias("v")))
    return link_buckets(crowded, ["n", "ahead"], may, lambda pairs: verified(pairs, held), F.col("ahead") / F.col("n"), few)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT,
    boundary: int | None = None,
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the least id reachable by links.

    Texts without words (null or empty too) have no shingles and are a component of their own id each.
    Null ids take part but are never a component's least id unless all of its ids are null; repeated rows
    get equal values; an empty table gives no rows.  Other columns are not read.  ``boundary`` replaces the
    size up to which sets are small.
    """
    if not 0 < percent < 100:
        raise ValueError("the limit must be between 1 and 99 percent")
    texts = _texts(docs, id_col, text_col)
    frequent, best = plan(texts, percent, shingle)
    boundary = best if boundary is None else boundary
    rows = stored(keyed_sets(texts, frequent, boundary, percent, shingle), "keyed")
    sets = stored(distinct_sets(rows), "sets")
    roots = components(jaccard_links(rows, sets, texts, boundary, percent, shingle))
    placed = sets.select("f", "g", "v", "least").join(roots, "v", "left").select("f", "g", "least", F.coalesce("root", "v").alias("root"))
    of_root = placed.groupBy("root").agg(F.min("least").alias("component"))
    component = placed.join(of_root, "root").select("f", "g", "component")
    return rows.select("i", "f", "g", "n").join(component, ["f", "g"], "left").select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("i")).alias("component_id"))
