"""Frame scores -> decisions -> speech segments.

The sequential on/off machines become window expressions: a frame switches speech on when
the "on" predicate held on the last K frames and off when the "off" predicate held on the
last M, and the state is the latest such switch.  All windows run inside fixed-size frame
blocks with a halo (``functions.blocks``), so one recording may be arbitrarily long.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechspark.functions.blocks import BLOCK, FAN, carry, framed, halo_window, with_halo

KEYS = ("clip_id",)


@dataclass(frozen=True)
class SegmentParams:
    """Thresholds and durations of one segmenter, in frames of ``step_ms``."""

    step_ms: float
    on: float
    off: float | None = None  # None: everything that is not "on"
    min_on: int = 1
    min_off: int = 1
    backfill: int = 0
    smooth: int = 1  # trailing mean over this many frames
    invert: bool = False  # the score is a silence probability
    vote_half: int = 0  # frames on each side of the centred vote; 0 = no vote
    vote_need: int = 0
    entry_untested: bool = False  # a switch always takes at least two frames

    def __post_init__(self):
        if self.off is not None and self.off > self.on:
            raise ValueError("the off threshold must not exceed the on threshold")
        if self.off is not None and (self.invert or self.vote_half):
            raise ValueError("a separate off threshold needs a plain score")
        if min(self.min_on, self.min_off, self.smooth) < 1 or self.backfill < 0:
            raise ValueError("durations must be positive")

    @property
    def k(self) -> int:
        return max(self.min_on, 2) if self.entry_untested else self.min_on

    @property
    def m(self) -> int:
        return max(self.min_off, 2) if self.entry_untested else self.min_off

    @property
    def back(self) -> int:
        return max(self.k, self.m) - 1 + self.smooth - 1 + self.vote_half

    @property
    def ahead(self) -> int:
        return max(self.vote_half - 1, 0)


# The decision parameters of the four frame-score models.
PRESETS = {
    "silero": SegmentParams(step_ms=32, on=0.5, min_on=4, min_off=10),
    "marblenet": SegmentParams(step_ms=20, on=0.5, off=0.3, min_on=10, min_off=5),
    "firered": SegmentParams(
        step_ms=10, on=0.4, min_on=20, min_off=20, backfill=5, smooth=5, entry_untested=True
    ),
    "fsmn": SegmentParams(
        step_ms=10, on=0.2, invert=True, vote_half=10, vote_need=15, min_on=1, min_off=80
    ),
}


def resolve(preset: str | SegmentParams, **overrides) -> SegmentParams:
    params = PRESETS[preset] if isinstance(preset, str) else preset
    return replace(params, **overrides) if overrides else params


# --- predicates ---------------------------------------------------------------------


def at_least(p, theta: float) -> Column:
    """p >= theta, both as float32."""
    p = F.col(p) if isinstance(p, str) else p
    return p.cast("float") >= F.lit(theta).cast("float")


def below(p, theta: float) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return p.cast("float") < F.lit(theta).cast("float")


def at_most(p, theta: float) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return p.cast("float") <= F.lit(theta).cast("float")


def mean_over(w, p: str, width: int) -> Column:
    return F.avg(F.col(p).cast("double")).over(w.rowsBetween(-(width - 1), 0))


def run_over(w, flag: Column, k: int, order: str) -> Column:
    """True where ``flag`` held on this and the k-1 rows before it.

    Measured from the last row where it did not hold: a growing frame costs one step per row,
    a sliding count would cost k.
    """
    if k == 1:
        return flag
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.last(F.when(~flag, F.col(order)), ignorenulls=True).over(so_far)
    return F.col(order) - F.coalesce(broken, F.first(order).over(so_far) - 1) >= k


def with_vote(df: DataFrame, w, flag: str, half: int, need: int, out: str) -> DataFrame:
    """Adds ``out``: at least ``need`` of the rows [i - half, i + half) hold ``flag``.

    The count is a difference of running counts, two steps per row whatever the width.
    """
    hits = F.col(flag).cast("int")
    df = df.withColumns({
        "_run": F.sum(hits).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum(hits).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    upto = F.coalesce(F.lead("_run", half - 1).over(w), F.col("_all"))
    return df.withColumn(out, upto - F.lag("_run", half + 1, 0).over(w) >= need).drop("_run", "_all")


def _with_switch(df: DataFrame, w, params: SegmentParams, p: str, order: str, tag: str = "") -> DataFrame:
    """Adds ``_ev{tag}``: 1 where speech may switch on, 0 where it may switch off, else null.

    Each step gets its own column: a framed sum cannot nest another one.
    """
    on_c, off_c = f"_on{tag}", f"_off{tag}"
    if params.smooth > 1:
        df = df.withColumn(f"_s{tag}", mean_over(w, p, params.smooth))
        p = f"_s{tag}"
    df = df.withColumn(on_c, at_most(p, params.on) if params.invert else at_least(p, params.on))
    if params.vote_half:
        df = with_vote(df, w, on_c, params.vote_half, params.vote_need, on_c)
    df = df.withColumn(off_c, ~F.col(on_c) if params.off is None else below(p, params.off))
    on, off = run_over(w, F.col(on_c), params.k, order), run_over(w, F.col(off_c), params.m, order)
    return df.withColumn(f"_ev{tag}", F.when(on, 1).when(off, 0))


# --- single steps as operators ------------------------------------------------------


def boxcar(df, width=5, p="p", out="p_mean", keys=KEYS, order="frame_idx", block=BLOCK) -> DataFrame:
    """Trailing mean over ``width`` frames, shorter at the head of a clip."""
    return framed(df, keys, order, {out: lambda w: mean_over(w, p, width)}, back=width - 1, block=block)


def vote(df, flag: Column, half=10, need=15, out="voted", keys=KEYS, order="frame_idx", block=BLOCK):
    """Centred vote over [i - half, i + half); frames outside the clip never count."""
    w = halo_window(keys, order)
    own = with_halo(df.withColumn("_flag", flag), order, half, half - 1, block)
    return with_vote(own, w, "_flag", half, need, out).filter("_own").drop("_flag", "_blk", "_own")


def run_length(df, flag: Column, k: int, out="run_done", keys=KEYS, order="frame_idx", block=BLOCK):
    return framed(df, keys, order, {out: lambda w: run_over(w, flag, k, order)}, back=k - 1, block=block)


def speech_state(
    df, preset: str | SegmentParams, p="p", out="speech", keys: Sequence[str] = KEYS, order="frame_idx",
    block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """Every frame with its on/off state (0/1) after the hysteresis machine."""
    params = resolve(preset)
    w = halo_window(keys, order)
    base = df.columns
    ev = _with_switch(with_halo(df, order, params.back, params.ahead, block), w, params, p, order).filter("_own")
    # State inside the block, then the carried state of earlier blocks for the frames
    # that precede the block's first switch.
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_st", F.last("_ev", ignorenulls=True).over(seen))
    bt = ev.groupBy(*keys, "_blk").agg(F.max_by("_ev", F.when(F.col("_ev").isNotNull(), F.col(order))).alias("_last"))
    bt = carry(bt, keys, before={"_prev": "_last"}, fan=fan).select(*keys, "_blk", "_prev")
    return (
        ev.join(bt, [*keys, "_blk"])
        .withColumn(out, F.coalesce("_st", "_prev", F.lit(0)))
        .select(*base, out)
    )


def transitions(
    df, state="speech", keys: Sequence[str] = KEYS, order="frame_idx", block: int = BLOCK
) -> DataFrame:
    """Frames where ``state`` differs from the frame before (0 before the first)."""
    out = framed(df, keys, order, {"_was": lambda w: F.lag(state, 1, 0).over(w)}, back=1, block=block)
    return out.filter(F.col(state) != F.col("_was")).drop("_was")


def backdate(transition_rows: DataFrame, preset, state="speech", order="frame_idx") -> DataFrame:
    """Boundary frame of a transition: the first frame of the run that caused it."""
    params = resolve(preset)
    held = F.when(F.col(state) == 1, params.k).otherwise(params.m)
    return transition_rows.withColumn("boundary_frame", F.col(order) - held + 1)


# --- the segmenter ------------------------------------------------------------------


def block_switches(df, models: Mapping[str, SegmentParams], scores: Mapping[str, str], keys, order, block) -> DataFrame:
    """One row per (frame block, model): the block's frame end and its alternating switches.

    ``items`` holds (at, ev) where ev differs from the switch before it in the block.  All
    models share one exchange on (keys, block), which the windows and the aggregate both use.
    """
    w = halo_window(keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    back, ahead = max(m.back for m in models.values()), max(m.ahead for m in models.values())
    ev = with_halo(df.select(*keys, order, *sorted(set(scores.values()))), order, back, ahead, block)
    lists = []
    for i, (name, params) in enumerate(models.items()):
        ev = _with_switch(ev, w, params, scores[name], order, str(i))
    names = [f"_ev{i}" for i in range(len(models))]
    scored = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in set(scores.values())])
    ev = ev.withColumns({c: F.when(F.col("_own"), F.col(c)) for c in names})
    ev = ev.withColumns({f"_was{c}": F.last(c, ignorenulls=True).over(before) for c in names})
    for c in names:
        fresh = F.col(c).isNotNull() & (F.col(f"_was{c}").isNull() | (F.col(f"_was{c}") != F.col(c)))
        found = F.collect_list(F.when(fresh, F.struct(F.col(order).alias("at"), F.col(c).alias("ev"))))
        lists.append(F.sort_array(found).alias(c))
    bt = ev.filter("_own").groupBy(*keys, "_blk").agg(
        (F.max(order) + 1).alias("_end"), F.count(F.when(scored, F.col(order))).alias("_rows"), *lists)
    per_model = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("items")) for n, c in zip(models, names)])
    whole = [*keys, "_blk", "_end", "_rows"]
    return bt.select(*whole, F.explode(per_model).alias("_m")).select(*whole, "_m.*")


def segment_models(
    df: DataFrame,
    models: Mapping[str, str | SegmentParams] | Sequence[str],
    p: str | Mapping[str, str] = "p",
    keys: Sequence[str] = KEYS,
    order: str = "frame_idx",
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """Speech segments of every clip for several segmenters, from one pass over the frames.

    ``models`` maps a name to a preset or parameters; ``p`` names the score column, one for all
    or one per model.  Returns keys, model, start_frame, end_frame (first frame after), start_s,
    end_s, speaker_id, confidence, emit_order (increasing in the order of emission).  A clip with
    missing frames or null scores gets no segments, as a decision must not bridge a hole; ``incomplete_clips`` lists it.
    """
    models = {n: resolve(v) for n, v in (models.items() if isinstance(models, Mapping) else ((n, n) for n in models))}
    scores = {n: p if isinstance(p, str) else p[n] for n in models}

    return segments_of_switches(block_switches(df, models, scores, keys, order, block), models, keys, block, fan)


def segments_of_switches(
    bt: DataFrame, models: Mapping[str, SegmentParams], keys: Sequence[str] = KEYS, block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """Segments from the switches of consecutive blocks, the result of ``block_switches``."""

    def setting(field):
        out = F
        for name, params in models.items():
            out = out.when(F.col("model") == name, F.lit(field(params)))
        return out

    unit = [*keys, "model"]
    first_off = F.filter("items", lambda x: x["ev"] == 0)
    bt = bt.withColumns(
        {
            "_last_ev": F.when(F.size("items") > 0, F.element_at("items", -1)["ev"]),
            "_first_off": F.get(first_off, F.lit(0))["at"],
        }
    )
    bt = carry(
        bt, unit,
        before={"_prev_ev": "_last_ev"}, after={"_next_off": "_first_off"}, final={"_n": "_end"},
        total={"_all_rows": "_rows"}, fan=fan,
    )
    on = bt.filter("_all_rows = _n").select(
        *unit, "_prev_ev", "_next_off", "_n", "items", F.posexplode("items").alias("_i", "_it")
    ).filter("_it.ev = 1 and (_i > 0 or coalesce(_prev_ev, 0) = 0)")
    # Switches alternate inside a block, so the next item, if any, is the matching "off".
    off_at = F.coalesce(F.get("items", F.col("_i") + 1)["at"], F.col("_next_off"))
    lead_in, lead_out = setting(lambda m: m.k - 1 + m.backfill), setting(lambda m: m.m - 1)
    segs = on.select(
        *unit,
        F.greatest(F.col("_it.at") - lead_in, F.lit(0)).cast("bigint").alias("start_frame"),
        F.coalesce(off_at - lead_out, F.col("_n")).cast("bigint").alias("end_frame"),
    )
    reach = max(m.backfill for m in models.values())
    if any(m.backfill > m.m for m in models.values()):
        segs = _clamp_to_previous(segs, reach, unit, block)
    step = setting(lambda m: float(m.step_ms))
    seconds = lambda c: F.col(c).cast("double") * step / F.lit(1000.0)
    return segs.select(
        *unit, "start_frame", "end_frame",
        seconds("start_frame").alias("start_s"), seconds("end_frame").alias("end_s"),
        F.lit(0).alias("speaker_id"), F.lit(1.0).cast("float").alias("confidence"),
        F.col("start_frame").alias("emit_order"),
    )


def segment_frames(df: DataFrame, preset: str | SegmentParams, p: str = "p", keys: Sequence[str] = KEYS,
                   order: str = "frame_idx", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``segment_models`` for one segmenter, without the model column."""
    return segment_models(df, {"_": preset}, p, keys, order, block, fan).drop("model")


def _clamp_to_previous(segs: DataFrame, backfill: int, keys: Sequence[str], block: int) -> DataFrame:
    """Keep a back-filled start behind the previous segment's end.

    Gaps are at least ``min_off`` frames, so this can only bind when the back-fill is longer; and
    then only for a segment that ends within ``backfill`` frames of the next start, which is why
    a copy of each segment goes to every block in which such a start can lie.
    """
    size = max(block, 4 * backfill)
    own = F.expr(f"start_frame div {size}")
    reached = F.sequence(F.expr(f"greatest(end_frame - {backfill}, 0) div {size}"), F.expr(f"(end_frame + {backfill}) div {size}"))
    # Several back-filled starts may be the clip's first frame.
    w = Window.partitionBy(*keys, "_blk").orderBy("start_frame", "end_frame")
    both = segs.withColumn("_own_blk", own).withColumn("_blk", F.explode(F.array_union(F.array(own), reached)))
    return (
        both.withColumn("_was_end", F.lag("end_frame").over(w))
        .filter("_blk = _own_blk")
        .withColumn("start_frame", F.greatest("start_frame", F.coalesce("_was_end", F.lit(0))))
        .select(*keys, "start_frame", "end_frame")
    )


def incomplete_clips(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "frame_idx") -> DataFrame:
    """Clips whose frames are not 0 .. n - 1, each once: keys, n_missing, error.  They get no segments."""
    n = df.groupBy(*keys).agg(
        F.count(order).alias("_c"), F.sum((F.col(order) >= 0).cast("bigint")).alias("_ok"), (F.max(order) + 1).alias("_n"))
    missing = F.col("_n") - F.col("_c")
    return n.filter("_n is null or _c <> _n or _ok <> _c").select(
        *keys, missing.alias("n_missing"), F.format_string("%d of %d frames are missing", missing, F.col("_n")).alias("error"))
