"""Window work that stays bounded when one key holds most of the rows.

A window over a whole recording would put that recording into one task.  The
helpers here cut the order axis into fixed-size blocks instead:

* ``with_halo`` copies the few rows next to a block edge into the neighbouring
  block, so that a framed window partitioned by (keys, block) sees the same
  rows as one partitioned by keys alone;
* ``carry`` passes values across blocks (last seen before, first seen after,
  running sum) in two levels, so that no window group exceeds ``FAN`` rows
  until a recording has more than BLOCK * FAN * FAN positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32_768
FAN = 4_096


def with_halo(
    df: DataFrame, order: str, back: int = 0, ahead: int = 0, block: int = BLOCK
) -> DataFrame:
    """Add ``_blk`` and ``_own``; rows within ``back``/``ahead`` of an edge appear twice.

    ``order`` must be a dense non-negative index per key.
    """
    if max(back, ahead) >= block:
        raise ValueError(f"block of {block} rows is not larger than its halo ({back}, {ahead})")
    own = F.expr(f"`{order}` div {block}")
    if back == 0 and ahead == 0:
        return df.withColumn("_blk", own).withColumn("_own", F.lit(True))
    first, last = F.expr(f"(`{order}` - {ahead}) div {block}"), F.expr(f"(`{order}` + {back}) div {block}")
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_blk") == own)


def halo_window(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, "_blk").orderBy(order)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, "callable"],
    back: int = 0,
    ahead: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Add window columns that look at most ``back``/``ahead`` rows around each row.

    ``columns`` maps a name to a function of the block window.
    """
    w = halo_window(keys, order)
    out = with_halo(df, order, back, ahead, block)
    for name, make in columns.items():
        out = out.withColumn(name, make(w))
    return out.filter("_own").drop("_blk", "_own")


def pack(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    block: str,
) -> DataFrame:
    """One row per (keys, block) with the block's rows as the ordered array ``items``."""
    fields = list(dict.fromkeys([*order, *payload]))
    return (
        df.withColumn("_blk", F.expr(block))
        .groupBy(*keys, "_blk")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    )


def carry(
    bt: DataFrame,
    keys: Sequence[str],
    pos: str = "_blk",
    before: Mapping[str, str] | None = None,
    after: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    final: Mapping[str, str] | None = None,
    total: Mapping[str, str] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Pass values between the block rows of one key.

    before:  out -> column, last non-null value in earlier blocks
    after:   out -> column, first non-null value in later blocks
    running: out -> column, sum over earlier blocks (0 for the first)
    final:   out -> column, last non-null value over all blocks of the key
    total:   out -> column, sum over all blocks of the key

    Blocks are grouped by ``fan``; each group is summarised on one of its rows, only
    those rows meet in a per-key window, and the outcome is spread over the group again.
    """
    before, after, running, final, total = (dict(m or {}) for m in (before, after, running, final, total))
    group = Window.partitionBy(*keys, "_grp")
    ordered = group.orderBy(pos)
    prior = ordered.rowsBetween(Window.unboundedPreceding, -1)
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    local: dict[str, Column] = {"_lead": F.row_number().over(ordered) == 1}
    for out, c in before.items():
        local[f"_l_{out}"] = F.last(c, ignorenulls=True).over(prior)
        local[f"_g_{out}"] = F.last(c, ignorenulls=True).over(whole)
    for out, c in after.items():
        local[f"_l_{out}"] = F.first(c, ignorenulls=True).over(later)
        local[f"_g_{out}"] = F.first(c, ignorenulls=True).over(whole)
    for out, c in running.items():
        local[f"_l_{out}"] = F.coalesce(F.sum(c).over(prior), F.lit(0))
        local[f"_g_{out}"] = F.sum(c).over(whole)
    for out, c in final.items():
        local[f"_g_{out}"] = F.last(c, ignorenulls=True).over(whole)
    for out, c in total.items():
        local[f"_g_{out}"] = F.sum(c).over(whole)
    bt = bt.withColumn("_grp", F.expr(f"`{pos}` div {fan}")).withColumns(local)

    # Only the group leaders share a window group; every other row is alone in its own.
    lane = F.when(F.col("_lead"), F.lit(-1)).otherwise(F.col(pos)).cast("bigint")
    across = Window.partitionBy(*keys, "_lane").orderBy("_grp")
    prior = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead: dict[str, Column] = {}
    for out in before:
        lead[f"_c_{out}"] = F.last(f"_g_{out}", ignorenulls=True).over(prior)
    for out in after:
        lead[f"_c_{out}"] = F.first(f"_g_{out}", ignorenulls=True).over(later)
    for out in running:
        lead[f"_c_{out}"] = F.sum(f"_g_{out}").over(prior)
    for out in final:
        lead[f"_c_{out}"] = F.last(f"_g_{out}", ignorenulls=True).over(whole)
    for out in total:
        lead[f"_c_{out}"] = F.sum(f"_g_{out}").over(whole)
    bt = bt.withColumn("_lane", lane).withColumns(lead)

    spread = {
        name: F.max(F.when(F.col("_lead"), F.struct(F.col(name).alias("v")))).over(group)["v"]
        for name in lead
    }
    bt = bt.withColumns(spread)
    done: dict[str, Column] = {}
    for out in [*before, *after]:
        done[out] = F.coalesce(f"_l_{out}", f"_c_{out}")
    for out in running:
        done[out] = F.col(f"_l_{out}") + F.coalesce(f"_c_{out}", F.lit(0))
    for out in [*final, *total]:
        done[out] = F.col(f"_c_{out}")
    bt = bt.withColumns(done)
    return bt.drop(*[c for c in bt.columns if c.startswith(("_l_", "_g_", "_c_"))], "_lead", "_lane", "_grp")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, out: str, block: int = BLOCK, fan: int = FAN
) -> DataFrame:
    """``row_number() - 1`` per key for a unique integer ``order``, in bounded groups."""
    payload = [c for c in df.columns if c not in keys]
    packed = pack(df, keys, [order], payload, f"`{order}` div {block}")
    packed = packed.withColumn("_n", F.size("items").cast("bigint"))
    based = carry(packed, keys, running={"_base": "_n"}, fan=fan)
    return (
        based.select(*keys, "_base", F.posexplode("items").alias("_i", "_it"))
        .select(*keys, *[F.col(f"_it.{c}").alias(c) for c in payload], (F.col("_base") + F.col("_i")).alias(out))
    )
