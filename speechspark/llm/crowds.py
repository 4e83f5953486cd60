"""Links inside buckets of any size: stars around well-connected members first, left-over pairs last.

A bucket's members are candidates of each other.  Each round takes one member of every bucket that still
joins several components, compares all others with it and takes it out: its pairs in that bucket are done.
The first is the member of the largest weight (meant for the centre of a crowd of copies), later ones
come from the smallest component of the bucket, so that stragglers are settled one by one.  As soon as the pairs that are left between components are few for the number of members, they are
compared as pairs.  Work per round is linear in the members; a bucket whose members are all unlike costs
one round per member up to ``ROUNDS``, and the rest of its pairs after that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import stored
from speechspark.llm.simhash import components

#: Star rounds at most; pairs per member that may be left for the last step.
ROUNDS = 10
FEW = 32


def _pairs_left(members: DataFrame) -> tuple[int, int]:
    """(pairs between components, members) over all buckets."""
    per = members.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("s"))
    left, n = per.agg(F.sum((F.col("c") * F.col("c") - F.col("s")) / 2), F.sum("c")).first()
    return int(left or 0), int(n or 0)


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that still join several components."""
    mixed = members.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k")
    return members.join(mixed, "k", "left_semi")


def link_buckets(
    met: DataFrame, extra: list[str], may: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], weight: Column,
    known: DataFrame | None = None,
) -> DataFrame:
    """(``a``, ``b``), a < b: verified links that join all linked members of the buckets.

    ``met`` has the bucket ``k``, the member ``f`` and the columns ``extra``, each ``k`` and ``f`` once.
    ``may(x, y)`` is a cheap condition on ``x_<extra>`` and ``y_<extra>`` that linked members fulfil in one
    common bucket at least; ``verify`` keeps those of distinct pairs (``a``, ``b``) that are links; ``weight``
    ranks a bucket's members as centres, from ``extra`` and ``keys``, the number of a member's buckets.  Members
    that ``known`` links join already need no comparison.
    """
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in extra]
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    held = met.groupBy("f").agg(F.count("*").alias("keys"))
    none = met.select(F.col("f").alias("a"), F.col("f").alias("b")).limit(0)
    roots = components(none if known is None else known)
    members = met.select("k", "f", *extra).join(held, "f").withColumn("w", weight).drop("keys")
    members = stored(_open(members.join(roots.withColumnRenamed("v", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))), "members")
    found: list[DataFrame] = [] if known is None else [known]
    for turn in range(ROUNDS + 1):
        left, n = _pairs_left(members)
        if not left:
            break
        stars = turn < ROUNDS and (turn == 0 or left > FEW * n)
        y = members.select("k", F.col("f").alias("y"), F.col("root").alias("ry"), *side("y"))
        if stars:
            if turn:
                # The member of the least component in its bucket, first of all.
                small = members.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k").agg(F.min(F.struct("c", "root")).alias("s"))
                small = small.select("k", F.col("s.root").alias("root"))
                pool = members.join(small, ["k", "root"])
            else:
                pool = members
            centre = pool.groupBy("k").agg(F.max(F.struct("w", "f", "root", *extra)).alias("x"))
            x = stored(centre.select("k", F.col("x.f").alias("x"), F.col("x.root").alias("rx"), *[F.col(f"x.{c}").alias(f"x_{c}") for c in extra]), "centres")
        else:
            x = members.select("k", F.col("f").alias("x"), F.col("root").alias("rx"), *side("x"))
        meet = y.join(x, "k").filter(F.col("rx") != F.col("ry") if stars else F.col("rx") < F.col("ry")).filter(may("x", "y"))
        found.append(stored(verify(meet.select(*pair).distinct()), "links"))
        if not stars:
            break
        roots = components(reduce(DataFrame.unionByName, found)).withColumnRenamed("v", "f")
        rest = members.drop("root").join(x.select("k", F.col("x").alias("f")), ["k", "f"], "left_anti")
        members = stored(_open(rest.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))), "members")
    return reduce(DataFrame.unionByName, found).distinct() if found else none
