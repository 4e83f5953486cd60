"""Check SQL for the registered queries, in the dialect of a second engine.

The statements follow the definitions directly (whole-clip windows, plain joins, a DFT by its
sum), so they share no technique with the Spark queries they check.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r5(x: str, digits: int = 5) -> str:
    return f"(round(cast({x} as double), {digits}) + 0.0::double)"


# --- fixtures -----------------------------------------------------------------------


def scores(period: int = 61, on: int = 34) -> str:
    return f"""
select event_id // 1250 as clip_id, event_id % 1250 as frame_idx,
  least(1.0::double, greatest(0.0::double,
    (case when (event_id % 1250 + 17 * (event_id // 1250)) % {period} < {on} then 0.8::double else 0.15::double end)
    + (value - 50) / 1000)) as p
from events"""


FX1 = scores()
FX1_LONG = scores(611, 340)

WEIGHTS = """
select clip_id, f // 125 as window_idx, f % 125 as frame_idx, c as cls,
  case when f % 97 = 0 then 1
       else 1 + (f * (c + 3) + 7 * c + clip_id + v) % 11 + case when (f // 23 + clip_id) % 7 = c then 40 else 0 end end as w
from (select event_id // 1250 as clip_id, event_id % 1250 as f, cast(floor(value) as bigint) as v from events) t, range(7) r(c)"""

PROBS = f"""
select clip_id, window_idx, frame_idx, cls, w, ln(w / sum(w) over (partition by clip_id, window_idx, frame_idx)) as lp
from ({WEIGHTS}) w0"""

DECODED = f"""
select clip_id, window_idx, frame_idx, cast(arg_min(cls, -w * 100 + cls) as integer) as cls,
  exp(max(lp)) as conf
from ({PROBS}) p0 group by all"""

SPEAKERS = "(values (1,0),(2,1),(3,0),(3,1),(4,2),(5,0),(5,2),(6,1),(6,2)) m(cls, speaker_id)"

SAMPLES = """
select vec_id // 25 as clip_id, (vec_id % 25) * 64 + j as sample_idx, x
from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as j from embeddings) u"""

LENGTHS = f"select clip_id, count(*) as n from ({SAMPLES}) s0 group by clip_id"

VECTORS = """
select vec_id // 25 as clip_id, vec_id % 25 as frame_idx, cast(j as integer) as bin, cast(x as double) as v
from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as j from embeddings) u"""

CUTS = """
select c.clip_id, k as emit_order, cast(k % 3 as integer) as speaker_id,
  cast(k * 13 as double) / 1000 as start_s, cast(k * 13 + (k * 7) % 31 as double) / 1000 as end_s
from (select distinct vec_id // 25 as clip_id from embeddings) c, range(9) r(k)"""

KEPT = f"""
select *, row_number() over (partition by clip_id, speaker_id order by emit_order) - 1 as segment_idx
from (select c.*, greatest(cast(trunc(start_s * 16000) as bigint), 0) as a, least(cast(trunc(end_s * 16000) as bigint), n) as b, n
      from ({CUTS}) c join ({LENGTHS}) l using (clip_id)) k0
where a < b"""


# --- decisions ----------------------------------------------------------------------


def machine(frames: str, on: float, off: float | None = None, k: int = 1, m: int = 1, smooth: int = 1,
            invert: bool = False, vote: tuple[int, int] | None = None) -> str:
    """CTE text: frames -> f0 .. st(clip_id, frame_idx, state)."""
    s = "p" if smooth == 1 else f"avg(p) over (partition by clip_id order by frame_idx rows {smooth - 1} preceding)"
    op = "<=" if invert else ">="
    raw = f"cast(s as float) {op} cast({on} as float)"
    on_x = "raw"
    if vote:
        half, need = vote
        on_x = (f"(sum(cast(raw as int)) over (partition by clip_id order by frame_idx "
                f"rows between {half} preceding and {half - 1} following) >= {need})")
    off_x = "not son" if off is None else f"cast(s as float) < cast({off} as float)"
    w = "over (partition by clip_id order by frame_idx rows {} preceding)"
    return f"""
f0 as ({frames}),
f1 as (select clip_id, frame_idx, p, {s} as s from f0),
f2 as (select *, {raw} as raw from f1),
f3 as (select *, {on_x} as son from f2),
f4 as (select *, {off_x} as soff from f3),
f5 as (select clip_id, frame_idx, case when sum(cast(son as int)) {w.format(k - 1)} = {k} then 1
         when sum(cast(soff as int)) {w.format(m - 1)} = {m} then 0 end as ev from f4),
st as (select clip_id, frame_idx,
         coalesce(last_value(ev ignore nulls) over (partition by clip_id order by frame_idx rows unbounded preceding), 0) as state from f5),
tr as (select * from (select *, lag(state, 1, 0) over (partition by clip_id order by frame_idx) as was from st) t where state <> was)"""


def segs(frames: str, step: float, k: int, m: int, backfill: int = 0, tag: str = "", **kw) -> str:
    """CTE text ending in sg(clip_id, start_frame, end_frame, start_s, end_s)."""
    return machine(frames, k=k, m=m, **kw) + f""",
nn as (select clip_id, max(frame_idx) + 1 as n from f0 group by clip_id),
pr as (select clip_id, state, frame_idx - {k - 1} - {backfill} as start0,
         coalesce(lead(frame_idx) over (partition by clip_id order by frame_idx) - {m - 1}, n) as end0
       from tr join nn using (clip_id)),
sg as (select clip_id, greatest(start0, 0, coalesce(lag(end0) over (partition by clip_id order by end0), 0)) as start_frame, end0 as end_frame
       from pr where state = 1)"""


def seg_out(cte: str, step: float) -> str:
    return f"""with {cte}
select clip_id, start_frame, end_frame, {r5(f'start_frame * {step}::double / 1000')} as start_s,
  {r5(f'end_frame * {step}::double / 1000')} as end_s, 0 as speaker_id, 1.0::double as confidence from sg"""


P_A = dict(step=32, on=0.5, k=4, m=10)
P_B = dict(step=20, on=0.5, off=0.3, k=10, m=5)
P_C = dict(step=10, on=0.4, k=20, m=20, backfill=5, smooth=5)
P_D = dict(step=10, on=0.4, k=1, m=80, invert=True, vote=(10, 15))
P_X = dict(step=10, on=0.6, off=0.3, k=3, m=4, backfill=12, smooth=3)

ORACLE["threshold"] = f"select clip_id, frame_idx, cast(p as float) >= cast(0.5 as float) as hi, cast(p as float) >= cast(0.4 as float) as lo from ({FX1}) f"
ORACLE["inverse_threshold"] = f"select clip_id, frame_idx, cast(p as float) <= cast(0.2 as float) as speech from ({FX1}) f"
ORACLE["boxcar"] = f"select clip_id, frame_idx, {r5('avg(p) over (partition by clip_id order by frame_idx rows 4 preceding)')} as p_mean from ({FX1}) f"
ORACLE["vote"] = f"""select clip_id, frame_idx, sum(cast(cast(p as float) <= cast(0.2 as float) as int))
  over (partition by clip_id order by frame_idx rows between 10 preceding and 9 following) >= 15 as voted from ({FX1}) f"""
ORACLE["run_length"] = f"""select clip_id, frame_idx, sum(cast(cast(p as float) >= cast(0.5 as float) as int))
  over (partition by clip_id order by frame_idx rows 3 preceding) = 4 as run_done from ({FX1}) f"""
ORACLE["hysteresis"] = f"with {machine(FX1, on=0.5, off=0.3, k=10, m=5)} select clip_id, frame_idx, cast(state as integer) as speech from st"
ORACLE["transitions"] = f"with {machine(FX1, on=0.5, k=4, m=10)} select clip_id, frame_idx, cast(state as integer) as speech from tr"
ORACLE["backdate"] = f"""with {machine(FX1, on=0.5, k=4, m=10)}
select clip_id, frame_idx, cast(state as integer) as speech, frame_idx - case when state = 1 then 3 else 9 end as boundary_frame from tr"""
ORACLE["tail_flush"] = f"with {segs(FX1, **P_A)} select sg.clip_id, start_frame, end_frame from sg join nn on sg.clip_id = nn.clip_id and end_frame = n"
ORACLE["frame_time"] = f"""select clip_id, frame_idx, {r5('frame_idx * 10::double / 1000')} as t10, {r5('frame_idx * 20::double / 1000')} as t20,
  {r5('frame_idx * 32::double / 1000')} as t32, {r5('frame_idx * (10.0::double / 589)')} as t_win from ({FX1}) f"""
ORACLE["seg_silero"] = seg_out(segs(FX1, **P_A), 32)
ORACLE["seg_marblenet"] = seg_out(segs(FX1, **P_B), 20)
ORACLE["seg_firered"] = seg_out(segs(FX1, **P_C), 10)
ORACLE["backfill"] = seg_out(segs(FX1, **{**P_C, "backfill": 30}), 10)
ORACLE["seg_fsmn"] = seg_out(segs(f"select clip_id, frame_idx, 1 - p as p from ({FX1_LONG}) z", **P_D), 10)
ORACLE["seg_packed"] = " union all ".join(
    f"select clip_id, '{name}' as model, start_frame, end_frame, start_s, end_s from ({ORACLE[f'seg_{name}']}) z"
    for name in ("silero", "marblenet", "firered"))
ORACLE["seg_packed_vote"] = ORACLE["seg_fsmn"]
ORACLE["seg_custom"] = seg_out(segs(FX1, **P_X), 10)
# Chunks of ten frames; a decision is told at the end of the chunk that holds the deciding frame.
ORACLE["stream_incremental"] = f"""with {segs(FX1, **P_C)},
told as (
  select sg.clip_id, 'segment' as event_type, end_frame as told_at, case when end_frame + 19 < n then end_frame + 19 else n end as decided, start_frame as a, end_frame as b, null as active
  from sg join nn on sg.clip_id = nn.clip_id
  union all select clip_id, 'activity', frame_idx + 1, frame_idx, null, null, state = 1 from tr
  union all select s0.clip_id, 'activity', n, n, null, null, false
  from (select clip_id, arg_max(state, frame_idx) as last from st group by clip_id) s0 join nn on s0.clip_id = nn.clip_id where last = 1)
select t.clip_id, event_type, {r5("told_at / 100.0::double")} as timestamp, {r5('least(n, (decided // 10 + 1) * 10) / 100.0::double')} as emitted_at_s,
  {r5('a / 100.0::double')} as start_s, {r5('b / 100.0::double')} as end_s, active as speech_active from told t join nn on t.clip_id = nn.clip_id"""

# --- powerset -----------------------------------------------------------------------

RUNS = f"""
select clip_id, window_idx, speaker_id, min(frame_idx) as start_frame, max(frame_idx) + 1 as end_frame, avg(conf) as confidence
from (select *, frame_idx - row_number() over (partition by clip_id, window_idx, speaker_id order by frame_idx) as island
      from ({DECODED}) d join {SPEAKERS} using (cls)) i
group by clip_id, window_idx, speaker_id, island"""
RUNS_S = f"""
select *, window_idx * 10.0::double + start_frame * (10.0::double / 125) as start_s,
  case when end_frame = 125 then window_idx * 10.0::double + 10 else window_idx * 10.0::double + end_frame * (10.0::double / 125) end as end_s
from ({RUNS}) r0"""


def merged(gap: float) -> str:
    order = "partition by clip_id order by window_idx, end_frame, speaker_id"
    return f"""
select clip_id, any_value(speaker_id) as speaker_id, min(start_s) as start_s, max_by(end_s, rn) as end_s, min_by(confidence, rn) as confidence
from (select *, sum(fresh) over (partition by clip_id order by rn rows unbounded preceding) as grp
      from (select *, row_number() over ({order}) as rn,
              case when speaker_id = lag(speaker_id) over ({order}) and start_s - lag(end_s) over ({order}) < {gap} then 0 else 1 end as fresh
            from ({RUNS_S}) s1) s2) s3
group by clip_id, grp"""


ORACLE["argmax_class"] = f"select clip_id, window_idx, frame_idx, cls from ({DECODED}) d"
ORACLE["class_conf"] = f"select clip_id, window_idx, frame_idx, {r5('cast(conf as float)')} as conf from ({DECODED}) d"
ORACLE["speaker_expand"] = f"select clip_id, window_idx, frame_idx, cls, speaker_id from ({DECODED}) d join {SPEAKERS} using (cls)"
ORACLE["speaker_runs"] = f"select clip_id, window_idx, speaker_id, start_frame, end_frame from ({RUNS}) r"
ORACLE["run_conf"] = f"select clip_id, window_idx, speaker_id, start_frame, {r5('confidence', 4)} as confidence from ({RUNS}) r"
ORACLE["window_close"] = f"select clip_id, window_idx, speaker_id, {r5('end_s')} as end_s from ({RUNS_S}) r where end_frame = 125"
ORACLE["window_offset"] = f"select clip_id, window_idx, speaker_id, start_frame, {r5('start_s')} as start_s from ({RUNS_S}) r"
ORACLE["merge_adjacent"] = f"select clip_id, speaker_id, {r5('start_s')} as start_s, {r5('end_s')} as end_s, {r5('confidence', 4)} as confidence from ({merged(2.0)}) m"
ORACLE["diarize"] = f"""select clip_id, speaker_id, {r5('start_s')} as start_s, {r5('end_s')} as end_s, {r5('confidence', 4)} as confidence
from ({merged(0.1)}) m"""
ORACLE["speakers"] = f"select clip_id, cast(count(distinct speaker_id) as integer) as n_speakers from ({merged(0.1)}) m group by clip_id"

# --- diagnostics --------------------------------------------------------------------

P7 = f"select *, exp(lp) as p from ({PROBS}) p1"
P7R = f"select *, exp(round(lp, 9)) as p from ({PROBS}) p1"
LABELS = "(values (0,'∅'),(1,'A'),(2,'B'),(3,'A+B'),(4,'C'),(5,'A+C'),(6,'B+C')) l(cls, label)"

ORACLE["active_frames"] = f"""
select clip_id, window_idx, frame_idx, cast(count(*) filter (p > 0.01) as integer) as n_listed,
  string_agg(label, ',' order by cls) filter (p > 0.01) as labels
from ({P7R}) p join {LABELS} using (cls)
group by clip_id, window_idx, frame_idx having max(case when cls > 0 then p end) > 0.1"""
ORACLE["class_transitions"] = f"""
select clip_id, window_idx, frame_idx, cls, {r5('conf')} as p, {r5('window_idx * 10.0::double + frame_idx * (10.0::double / 125)')} as time_s
from (select *, lag(cls, 1, -1) over (partition by clip_id, window_idx order by frame_idx) as was from ({DECODED}) d) t where cls <> was"""
ORACLE["overlap_frames"] = f"""
select clip_id, window_idx, frame_idx, cast(count(*) filter (cls > 0 and p > 0.05) as integer) as n_rivals
from ({P7R}) p group by clip_id, window_idx, frame_idx
having max(case when cls >= 3 then p end) > 0.08
    or (count(*) filter (cls > 0 and p > 0.05) >= 2 and max(case when cls = 0 then p end) < 0.85)"""
ORACLE["window_summary"] = f"""
select clip_id, window_idx, cast(count(*) filter (cls = 0) as bigint) as silence_frames,
  {r5('count(*) filter (cls = 0) / 125.0::double * 100')} as silence_pct, {r5('max(top)')} as max_speech_p,
  min(case when top = best then frame_idx end) as max_speech_frame, {r5('sum(ent) / 125')} as mean_entropy
from (select *, max(top) over (partition by clip_id, window_idx) as best
      from ({DECODED}) d join (select clip_id, window_idx, frame_idx, max(case when cls > 0 then p end) as top,
              sum(case when p > 1e-10 then -p * log2(p) else 0 end) as ent
            from ({P7}) p group by all) t using (clip_id, window_idx, frame_idx)) x
group by clip_id, window_idx"""
ORACLE["every_20th"] = f"select clip_id, window_idx, frame_idx, cast(cls as integer) as cls, {r5('p')} as p from ({P7}) p where frame_idx % 20 = 0"
ORACLE["top5_frames"] = f"""
select clip_id, window_idx, frame_idx, cast(rank as integer) as rank, cast(best_cls as integer) as best_cls, {r5('exp(best)')} as best_p
from (select *, row_number() over (partition by clip_id, window_idx order by best desc, frame_idx) as rank
      from (select clip_id, window_idx, frame_idx, max(round(lp, 9)) as best, arg_min(cls, -w * 100 + cls) as best_cls
            from ({PROBS}) p where cls > 0 group by all) t) x where rank <= 5"""
WITH_EMPTY = f"select clip_id, n from ({LENGTHS}) l1 union all select -1 - clip_id, 0 from ({LENGTHS}) l2"
ORACLE["window_inventory"] = f"select clip_id, n as n_samples, {r5('n / 16000.0::double')} as duration_s, (n + 999) // 1000 as n_windows from ({WITH_EMPTY}) l"
ORACLE["softmax_pair"] = f"""select event_id, {r5('cast(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as float)')} as p
from (select event_id, value / 40 as a, cast(event_id % 7 as double) / 2 as b from events) e"""

# --- sources ------------------------------------------------------------------------

SUBMITTED = """
select event_id, user_id, case when event_id % 3 = 2 then 'sample rate must be 16000, got 44100'
  when event_id % 9 = 0 then 'samples cannot be empty'
  when (event_id % 9) % 4 <> 0 then 'samples length ' || (event_id % 9) || ' is not a multiple of 4 (expected float32 little-endian)' end as error
from events"""
ORACLE["validate_inputs"] = f"select event_id, error from ({SUBMITTED}) s"
ORACLE["failure_isolation"] = f"select user_id, coalesce(error, 'none') as error, count(*) as n from ({SUBMITTED}) s group by all"
ORACLE["content_ids"] = """select 'u-' || substr(sha1(text), 1, 16) as content_id, min(doc_id) as clip_id, count(*) as n_submitted
from documents group by 1"""
ORACLE["sink_names"] = f"""
select clip_id || '-speaker' || speaker_id || '-segment' || segment_idx || '.f32' as file_name from ({KEPT}) k
union all select distinct clip_id || '-speaker' || speaker_id || '.f32' from ({CUTS}) c"""
ORACLE["transcode"] = f"select clip_id, sample_idx, {r5('x')} as x from ({SAMPLES}) s"


def little(x: str, size: int) -> str:
    """Little-endian hex of a non-negative integer."""
    return " || ".join(f"lpad(lower(to_hex(({x} >> {8 * k}) & 255)), 2, '0')" for k in range(size))


def wav(fmt: str, tag: str, width: int, body: str) -> str:
    """Blocks of 480 samples; the first starts with the header of the clip."""
    header = f"""'52494646' || {little(f'(36 + {width} * n)', 4)} || '57415645666d742010000000' || '{tag}' || '0100803e0000' || {little(f'(16000 * {width})', 4)} || '{width:02x}00' || '{8 * width:02x}00' || '64617461' || {little(f'({width} * n)', 4)}"""
    return f"""
select clip_id, '{fmt}' as format, cast(b as bigint) as block_idx, case when b = 0 then {header} else '' end || hexed as payload
from (select clip_id, sample_idx // 480 as b, string_agg({body}, '' order by sample_idx) as hexed
      from (select clip_id, sample_idx, cast(x * 3.0::float as float) as y from ({SAMPLES}) s0) s1 group by 1, 2) p join ({LENGTHS}) l using (clip_id)"""


def float_bits(y: str) -> str:
    """IEEE single bits of a float32 below two in size: sign, exponent by log2, 23 bits of fraction."""
    size = f"abs(cast({y} as double))"
    e = f"(case when {size} = 0 then 0 else cast(floor(log2({size})) as bigint) end)"
    exact = f"(case when {size} = 0 then 0 else {e} + (case when {size} >= pow(2.0::double, {e} + 1) then 1 when {size} < pow(2.0::double, {e}) then -1 else 0 end) end)"
    bits = f"(case when {size} = 0 then 0 else (({exact} + 127) << 23) + cast({size} * pow(2.0::double, 23 - {exact}) as bigint) - (1 << 23) end)"
    return f"({bits} + case when {y} < 0 then 2147483648 else 0 end)"


_PCM = "(65536 + cast(trunc(case when c < 0 then c * 32768 else c * 32767 end) as bigint)) % 65536".replace("c ", "greatest(-1.0::double, least(1.0::double, cast(y as double))) ")
ORACLE["wav_export"] = wav("float32", "0300", 4, little(float_bits("y"), 4)) + " union all " + wav("pcm16", "0100", 2, little(f"({_PCM})", 2))

# --- PCM ----------------------------------------------------------------------------

ORACLE["scale_pcm"] = f"select clip_id, sample_idx, {r5('cast(x as double) * 32768')} as x from ({SAMPLES}) s"
ORACLE["pcm16"] = f"""
select clip_id, sample_idx,
  cast(trunc(case when c < 0 then c * 32768 else c * 32767 end) as integer) as asymmetric,
  cast(trunc(greatest(-32768.0::double, least(32767.0::double, y * 32768))) as integer) as symmetric
from (select *, greatest(-1.0::double, least(1.0::double, y)) as c from (select clip_id, sample_idx, cast(x * 3.0::float as double) as y from ({SAMPLES}) s) a) b"""
ORACLE["mono_mix"] = f"select clip_id, sample_idx // 2 as sample_idx, {r5('cast(avg(cast(x as double)) as float)')} as x from ({SAMPLES}) s group by clip_id, sample_idx // 2"
ORACLE["decimate"] = f"""select clip_id, sample_idx * 16000 // 44100 as sample_idx, {r5('x')} as x from ({SAMPLES}) s
where (sample_idx + 1) * 16000 // 44100 > sample_idx * 16000 // 44100"""
ORACLE["duration"] = f"select clip_id, n / 16000.0::double as duration_s from ({WITH_EMPTY}) l"
ORACLE["truncate"] = f"select clip_id, sample_idx, {r5('x')} as x from ({SAMPLES}) s where sample_idx < 640"
ORACLE["envelope"] = f"""
select b.clip_id, bucket, {r5('least(0, coalesce(min(x), 0))')} as lo, {r5('greatest(0, coalesce(max(x), 0))')} as hi
from (select clip_id, bucket, cast(floor(bucket * (n / 48.0::double)) as bigint) as i0, least(n, cast(floor((bucket + 1) * (n / 48.0::double)) as bigint)) as i1
      from ({LENGTHS}) l, range(48) r(bucket)) b
left join ({SAMPLES}) s on s.clip_id = b.clip_id and sample_idx >= i0 and sample_idx < i1
group by b.clip_id, bucket"""


def chunks(size: int, total: str = "x", keep: str = "true", n: str = "count(*)") -> str:
    return f"""
select clip_id, sample_idx // {size} as chunk_idx, cast({n} as integer) as n,
  sample_idx // {size} = (any_value(n) - 1) // {size} as end_of_stream, {r5('sum(cast(x as double))')} as total
from ({SAMPLES}) s join ({LENGTHS}) l using (clip_id) group by clip_id, sample_idx // {size} having {keep}"""


ORACLE["chunk_keep"] = chunks(640)
ORACLE["chunk_drop"] = chunks(512, keep="count(*) = 512")
ORACLE["chunk_pad"] = chunks(1000, n="1000")

# Resampling 24 kHz -> 16 kHz: 61 taps of a sinc at 1/3, Kaiser window (beta 5) by the Bessel series.
ORACLE["resample"] = f"""
with taps as (
  select n, s / sum(s) over () * 2 as h from (
    select n, (case when n = 0 then 1.0::double else sin(pi() * n / 3) / (pi() * n / 3) end) / 3
      * (select sum(pow(2.5::double * sqrt(greatest(0, 1 - (n / 30.0::double) * (n / 30.0::double))), 2 * j) / pow(gamma(j + 1.0::double), 2)) from range(40) q(j)) as s
    from (select range - 30 as n from range(61)) r) t),
o as (select clip_id, m, n from ({LENGTHS}) l, lateral (select range as m from range(0, (n * 2 + 2) // 3)) q)
select o.clip_id, m as sample_idx, {r5('sum(h * x)', 4)} as x
from o join ({SAMPLES}) s on s.clip_id = o.clip_id and s.sample_idx * 2 between m * 3 - 30 and m * 3 + 30
join taps on taps.n = m * 3 - s.sample_idx * 2
group by o.clip_id, m"""

# --- framing ------------------------------------------------------------------------

ORACLE["frame_counts"] = """
select doc_id, case when n_chars < 400 then 0 else (n_chars - 400) // 160 + 1 end as snip, (n_chars + 80) // 160 as center,
  case when n_chars < 160 then 0 else (n_chars // 160 + 1) // 2 * 2 end as stft from documents"""


def frames(length: int = 400, shift: int = 160) -> str:
    return f"""
select s.clip_id, f.frame_idx, cast(s.sample_idx - f.frame_idx * {shift} as integer) as i, cast(x as double) as x
from (select clip_id, unnest(range(0, (n - {length}) // {shift} + 1)) as frame_idx from ({LENGTHS}) l) f
join ({SAMPLES}) s on s.clip_id = f.clip_id and s.sample_idx >= f.frame_idx * {shift} and s.sample_idx < f.frame_idx * {shift} + {length}"""


def chain(length: int, shift: int, window: str) -> str:
    """DC removal, pre-emphasis and window on every frame."""
    return f"""
select clip_id, frame_idx, i, (d - 0.97::double * coalesce(lag(d) over (partition by clip_id, frame_idx order by i), d)) * ({window}) as x
from (select *, x - avg(x) over (partition by clip_id, frame_idx) as d from ({frames(length, shift)}) f1) f2"""


def hann(length: int) -> str:
    return f"(0.5 - 0.5 * cos(2 * pi() * i / {length}.0::double))"


def power(source: str, nfft: int) -> str:
    return f"""
select clip_id, frame_idx, k, pow(sum(x * c), 2) + pow(sum(x * s), 2) as pw
from ({source}) fr join (select i, k, cos(2 * pi() * ((i * k) % {nfft}) / {nfft}) as c, sin(2 * pi() * ((i * k) % {nfft}) / {nfft}) as s
  from range({nfft}) a(i), range({nfft // 2 + 1}) b(k)) dft using (i)
group by clip_id, frame_idx, k"""


def to_mel(kind: str, hz: str) -> str:
    if kind == "htk":
        return f"1127.0::double * ln(1 + ({hz}) / 700.0::double)"
    return (f"case when ({hz}) < 1000 then ({hz}) / (200.0::double / 3) "
            f"else 15.0::double + ln(({hz}) / 1000.0::double) / (ln(6.4::double) / 27) end")


def to_hz(kind: str, mel: str) -> str:
    if kind == "htk":
        return f"700.0::double * (exp(({mel}) / 1127.0::double) - 1)"
    return f"case when ({mel}) < 15 then ({mel}) * (200.0::double / 3) else 1000.0::double * exp((ln(6.4::double) / 27) * (({mel}) - 15)) end"


def bank(kind: str, n_mels: int, nfft: int, rate: float, low: float) -> str:
    lo, hi = f"({to_mel(kind, f'{low}::double')})", f"({to_mel(kind, f'{rate / 2}::double')})"
    edge = lambda b: to_hz(kind, f"{lo} + ({hi} - {lo}) * ({b}) / {n_mels + 1}.0::double")
    norm = " * 2 / (r - l)" if kind == "slaney" else ""
    return f"""
select cast(bin as integer) as bin, k, greatest(0, least((hz - l) / (c - l), (r - hz) / (r - c))){norm} as w
from (select bin, k, k * {rate}::double / {nfft} as hz, {edge('bin')} as l, {edge('bin + 1')} as c, {edge('bin + 2')} as r
      from range({n_mels}) x(bin), range({nfft // 2 + 1}) y(k)) t"""


def project(pw: str, bk: str) -> str:
    return f"select clip_id, frame_idx, bin, sum(w * pw) as e from ({pw}) p join ({bk}) b using (k) group by clip_id, frame_idx, bin"


POVEY = lambda n: f"case when i in (0, {n - 1}) then 0 else pow(0.5 - 0.5 * cos(2 * pi() * i / {n - 1}.0::double), 0.85::double) end"
SMALL_PLAIN = power(frames(40, 16), 64)
SMALL_CHAIN = power(chain(40, 16, POVEY(40)), 64)
SMALL_HTK = bank("htk", 16, 64, 1600, 20)
SMALL_SLANEY = bank("slaney", 16, 64, 1600, 0)
EPS23, EPS24 = repr(2.0**-23), repr(2.0**-24)

ORACLE["frames"] = f"select clip_id, frame_idx, i, {r5('x')} as v from ({frames()}) f"
ORACLE["dc_offset"] = f"select clip_id, frame_idx, i, {r5('x - avg(x) over (partition by clip_id, frame_idx)')} as v from ({frames()}) f"
ORACLE["preemph_frame"] = f"""select clip_id, frame_idx, i,
  {r5('x - 0.97::double * coalesce(lag(x) over (partition by clip_id, frame_idx order by i), x)')} as v from ({frames()}) f"""
ORACLE["preemph_signal"] = f"""select clip_id, sample_idx,
  {r5('cast(x as double) - 0.97::double * coalesce(lag(cast(x as double)) over (partition by clip_id order by sample_idx), 0)')} as x from ({SAMPLES}) s"""
ORACLE["window_tables"] = f"""select clip_id, frame_idx, i, {r5('x * (0.54::double - 0.46::double * cos(2 * pi() * i / 399.0::double))')} as hamming,
  {r5(f'x * {POVEY(400)}')} as povey, {r5(f'x * {hann(400)}')} as hann_periodic from ({frames()}) f"""
REFLECTED = f"""
select p.clip_id, pos, cast(x as double) as x, n
from (select clip_id, n, pos, case when pos < 0 then -pos when pos >= n then greatest(2 * n - 2 - pos, 0) else pos end as src
      from (select clip_id, n, unnest(range(-256, n + 256)) as pos from ({LENGTHS}) l) q) p
join ({SAMPLES}) s on s.clip_id = p.clip_id and s.sample_idx = p.src"""
ORACLE["reflect_pad"] = f"select clip_id, pos, {r5('x')} as x from ({REFLECTED}) r"
ORACLE["zero_pad"] = f"""
select clip_id, frame_idx, 512::bigint as nfft, i + 56 as i, {r5('x')} as v from ({frames()}) f
union all
select clip_id, frame_idx, 512::bigint, cast(j as integer), 0.0::double
from (select clip_id, unnest(range(0, (n - 400) // 160 + 1)) as frame_idx from ({LENGTHS}) l) g, range(512) r(j) where j < 56 or j >= 456"""
ORACLE["dft_power"] = f"select clip_id, frame_idx, cast(k as integer) as k, {r5('pw')} as v from ({SMALL_PLAIN}) p"
ORACLE["mel_htk"] = f"select event_id, {r5(to_mel('htk', 'value * 16'))} as mel, {r5(to_hz('htk', to_mel('htk', 'value * 16')))} as hz_back from events"
ORACLE["mel_slaney"] = f"""select event_id, {r5('mel')} as mel, {r5(to_hz('slaney', 'mel'))} as hz_back
from (select event_id, {to_mel('slaney', 'value * 32')} as mel from events) e"""
ORACLE["bank_htk"] = f"select clip_id, frame_idx, bin, {r5('e')} as energy from ({project(SMALL_PLAIN, SMALL_HTK)}) e"
ORACLE["bank_slaney"] = f"select clip_id, frame_idx, bin, {r5('e')} as energy from ({project(SMALL_PLAIN, SMALL_SLANEY)}) e"
ORACLE["mel_project"] = f"select clip_id, frame_idx, bin, {r5('e')} as energy from ({project(SMALL_CHAIN, SMALL_HTK)}) e"
ORACLE["log_floor"] = f"select clip_id, frame_idx, bin, {r5(f'ln(greatest(e, {EPS23}))')} as v from ({project(SMALL_CHAIN, SMALL_HTK)}) e"
ORACLE["log_offset"] = f"select clip_id, frame_idx, bin, {r5(f'ln(e + {EPS24})')} as v from ({project(SMALL_PLAIN, SMALL_SLANEY)}) e"
ORACLE["log_mel_kaldi"] = f"""select clip_id, frame_idx, bin, {r5(f'ln(greatest(e, {EPS23}))')} as v
from ({project(power(chain(400, 160, POVEY(400)), 512), bank('htk', 80, 512, 16000, 20))}) e"""
NEMO_SIGNAL = f"""
select clip_id, sample_idx, cast(x as double) - 0.97::double * coalesce(lag(cast(x as double)) over (partition by clip_id order by sample_idx), 0) as x
from ({SAMPLES}) s"""
NEMO_FRAMES = f"""
select g.clip_id, frame_idx, i, x * {hann(400).replace(' i ', ' (i - 56) ')} as x
from (select clip_id, frame_idx, i, case when pos < 0 then -pos when pos >= n then greatest(2 * n - 2 - pos, 0) else pos end as src
      from (select *, frame_idx * 160 - 256 + i as pos from (select clip_id, n, unnest(range(0, n // 160)) as frame_idx from ({LENGTHS}) l) a, range(56, 456) r(i)) b) g
join ({NEMO_SIGNAL}) y on y.clip_id = g.clip_id and y.sample_idx = g.src"""
ORACLE["log_mel_nemo"] = f"""select clip_id, frame_idx, bin, {r5(f'ln(e + {EPS24})')} as v
from ({project(power(NEMO_FRAMES, 512), bank('slaney', 80, 512, 16000, 0))}) e
union all
select clip_id, n // 160, cast(bin as integer), 0.0::double from ({LENGTHS}) l, range(80) r(bin) where (n // 160) % 2 = 1"""

# --- feature tables -----------------------------------------------------------------

ORACLE["pad_frames"] = f"""
select clip_id, frame_idx, bin, {r5('v')} as v from ({VECTORS}) v
union all
select clip_id, t, cast(bin as integer), 0.0::double
from (select clip_id, max(frame_idx) + 1 as t from ({VECTORS}) v group by clip_id) x, range(64) r(bin) where t % 2 = 1"""
ORACLE["transpose"] = f"""select clip_id, bin * t + frame_idx as flat_idx, {r5('v')} as v
from ({VECTORS}) v join (select clip_id, max(frame_idx) + 1 as t from ({VECTORS}) v group by clip_id) x using (clip_id)"""
ORACLE["stack_frames"] = f"""
select a.clip_id, a.f as frame_idx, cast((b.frame_idx - a.f) * 64 + b.bin as integer) as bin, {r5('b.v')} as v
from (select distinct clip_id, frame_idx as f, max(frame_idx) over (partition by clip_id) as top from ({VECTORS}) v) a
join ({VECTORS}) b on b.clip_id = a.clip_id and b.frame_idx between a.f and a.f + 4 where a.f + 4 <= a.top"""
NORMS = f"""
select bin, count(*) as n, sum(v) / count(*) as mean,
  1 / sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 1e-20)) as istd from ({VECTORS}) v group by bin"""
ORACLE["fit_norm"] = f"select bin as dim, n, {r5('mean')} as mean, {r5('istd')} as istd from ({NORMS}) n"
ORACLE["norm_sub"] = f"select clip_id, frame_idx, bin, {r5('(v - mean) * istd')} as v from ({VECTORS}) x join ({NORMS}) n using (bin)"
ORACLE["norm_add"] = f"select clip_id, frame_idx, bin, {r5('(v + (-mean)) * istd')} as v from ({VECTORS}) x join ({NORMS}) n using (bin)"
ORACLE["score_stub"] = f"select clip_id, frame_idx, {r5('1 / (1 + exp(-avg(v)))', 4)} as p, cast(null as varchar) as error from ({VECTORS}) v group by clip_id, frame_idx"
ORACLE["energy_score"] = f"select clip_id, frame_idx, {r5('1 / (1 + exp(-10 * avg(v)))')} as p from ({VECTORS}) v group by clip_id, frame_idx"

# --- models -------------------------------------------------------------------------


def seg_count(name: str, p: dict) -> str:
    return f"(with {segs(FX1, **p)} select clip_id, '{name}' as model, {p['step']} as step, start_frame, end_frame from sg)"


MODEL_SEGS = " union all ".join(seg_count(n, p) for n, p in (("silero", P_A), ("marblenet", P_B), ("firered", P_C)))
CLIP_FRAMES = f"select clip_id, max(frame_idx) + 1 as n from ({FX1}) f group by clip_id"
MODELS = "(values ('silero', 32), ('marblenet', 20), ('firered', 10)) m(model, step)"
SUMMARY = f"""
select c.clip_id, m.model, n * m.step / 1000.0::double as duration_s, count(s.start_frame) as n_segments,
  coalesce(sum(end_frame - start_frame), 0) * m.step / 1000.0::double as speech_s, max(end_frame) * m.step / 1000.0::double as reported_s
from ({CLIP_FRAMES}) c cross join {MODELS} left join ({MODEL_SEGS}) s on s.clip_id = c.clip_id and s.model = m.model
group by c.clip_id, m.model, n, m.step"""
ORACLE["compare_models"] = f"""
select clip_id, model, cast(null as varchar) as error, n_segments, true as timed, cast(null as double) as start_s, cast(null as double) as end_s from ({SUMMARY}) s
union all select clip_id, m, e, 0, true, null, null from ({CLIP_FRAMES}) c, (values ('pyannote', 'no frame-score segmenter for pyannote'), ('failing', 'model broke')) v(m, e)
union all select clip_id, model, null, null, null, {r5('start_frame * step / 1000.0::double')}, {r5('end_frame * step / 1000.0::double')} from ({MODEL_SEGS}) g"""
ORACLE["scorer_failures"] = f"""
with sc as (select clip_id, frame_idx, 1 / (1 + exp(-avg(cast(v as double)))) as p, max(v) as most from ({VECTORS}) x group by all),
bad as (select clip_id, max(most) > 0.45::float as failed, count(*) as n from sc group by clip_id),
{segs("select clip_id, frame_idx, p from sc where clip_id not in (select clip_id from bad where failed)", step=10, on=0.5, k=2, m=2)}
select clip_id, case when failed then 'ValueError: value out of range' end as error, case when failed then 0 else n end as n_frames,
  case when failed then 1 else n end as n_rows, (select count(*) from sg where sg.clip_id = bad.clip_id) as n_segments from bad"""
ORACLE["missing_frames"] = f"""with {segs(f"select * from ({FX1}) f where clip_id % 3 <> 0", **P_A)},
every as (select clip_id, max(frame_idx) + 1 as n from ({FX1}) g where not (clip_id % 3 = 0 and frame_idx = 40) group by clip_id)
select clip_id, case when clip_id % 3 = 0 then 1 else 0 end::bigint as n_missing,
  case when clip_id % 3 = 0 then '1 of ' || n || ' frames are missing' end as error,
  (select count(*) from sg where sg.clip_id = every.clip_id) as n_segments from every"""
ORACLE["model_presets"] = """
select event_id, m.model, m.model_id, m.step_ms, m.on_threshold, m.min_on, m.min_off
from (select event_id, ['silero', 'firered', 'fsmn', 'marblenet', 'whisper'][event_id % 5 + 1] as model from events) e
left join (values ('silero', 5, 32.0::double, 0.5::double, 4, 10), ('firered', 3, 10.0::double, 0.4::double, 20, 20),
  ('fsmn', 2, 10.0::double, 0.2::double, 1, 80), ('marblenet', 4, 20.0::double, 0.5::double, 10, 5)) m0(model, model_id, step_ms, on_threshold, min_on, min_off)
  using (model), lateral (select e.model as model, model_id, step_ms, on_threshold, min_on, min_off) m"""
ORACLE["segment_summary"] = f"""select clip_id, model, {r5('duration_s')} as duration_s, n_segments, {r5('speech_s')} as speech_s,
  cast(least(n_segments, 1) as integer) as n_speakers, {r5('case when duration_s > 0 then speech_s / duration_s * 100 else 0 end')} as speech_pct from ({SUMMARY}) s"""
ORACLE["expectation_check"] = f"""
select model, {r5('speech_s')} as speech_s, n_segments, speech_s < lo or speech_s > hi or n_segments < least_n as violated
from (select model, sum(speech_s) as speech_s, cast(sum(n_segments) as bigint) as n_segments from ({SUMMARY}) s group by model) t
join (values ('silero', 100.0, 200.0, 50), ('marblenet', 150.0, 300.0, 10), ('firered', 1.0, 50.0, 4)) e(model, lo, hi, least_n) using (model)"""
ORACLE["duration_check"] = f"""select clip_id, model, {r5('reported_s')} as reported_s,
  reported_s between duration_s * 0.95::double and duration_s * 1.05::double as duration_ok from (select clip_id, model, duration_s, coalesce(reported_s, 0) as reported_s from ({SUMMARY}) s1) s"""
ORACLE["realtime_factor"] = f"""
select model, {r5('sum(duration_s)')} as audio_s, {r5('sum(wall)')} as wall_s, {r5('sum(duration_s) / sum(wall)', 2)} as realtime_factor
from ({SUMMARY}) s join (select event_id // 1250 as clip_id, sum(value) / 1e6 as wall from events group by 1) w using (clip_id) group by model"""
QUIET = segs(FX1_LONG, step=10, on=0.84, k=3, m=80)
ORACLE["silent_clips"] = f"with {QUIET} select clip_id from nn where clip_id not in (select clip_id from sg)"
ORACLE["voiced_clips"] = f"with {QUIET} select distinct clip_id from sg"

# --- segment tables -----------------------------------------------------------------

ORACLE["speaker_numbering"] = f"select clip_id, emit_order, speaker_id, segment_idx, a as start_sample, b as end_sample from ({KEPT}) k"
ORACLE["cut_segments"] = f"""select k.clip_id, speaker_id, segment_idx, sample_idx, {r5('x')} as x
from ({KEPT}) k join ({SAMPLES}) s on s.clip_id = k.clip_id and sample_idx >= a and sample_idx < b"""
ORACLE["range_extract"] = f"""select clip_id, sample_idx, {r5('x')} as x from ({SAMPLES}) s
where sample_idx >= floor(0.01003::double * 16000) and sample_idx < ceil(0.0301::double * 16000)"""
ORACLE["mask_streams"] = f"""
select s.clip_id, w.speaker_id, sample_idx, {r5('case when max(k.a) is null then 0 else any_value(x) end')} as x
from ({SAMPLES}) s join (select distinct clip_id, speaker_id from ({CUTS}) c) w on w.clip_id = s.clip_id
left join ({KEPT}) k on k.clip_id = s.clip_id and k.speaker_id = w.speaker_id and sample_idx >= a and sample_idx < b
group by s.clip_id, w.speaker_id, sample_idx"""
AUDITED = f"select clip_id, emit_order, start_s, end_s, cast(emit_order as float) / 6 as confidence, case when emit_order = 5 then 3 else speaker_id end as speaker_id from ({CUTS}) c"
ORACLE["segment_audit"] = f"""
select clip_id, 'cut' as model, emit_order, 'end_not_after_start' as rule from ({AUDITED}) a where not end_s > start_s
union all select clip_id, 'cut', emit_order, 'speaker_out_of_range' from ({AUDITED}) a where speaker_id not between 0 and 2
union all select clip_id, 'cut', emit_order, 'confidence_out_of_range' from ({AUDITED}) a where confidence not between 0 and 1
union all select clip_id, 'cut', null, 'speech_fraction'
from (select clip_id, sum(end_s - start_s) as s from ({AUDITED}) a group by clip_id) t join ({LENGTHS}) l using (clip_id)
where not (s / (n / 16000.0::double)) between 0.2 and 0.95"""
ORACLE["nested_segments"] = f"""with {segs(FX1, **P_C)}
select nn.clip_id, {r5('any_value(nn.n) * 10 / 1000.0::double')} as duration_s, cast(count(start_frame) as integer) as n_segments,
  coalesce(string_agg(start_frame * 10 || '-' || end_frame * 10 || '-0-1000', ',' order by start_frame), '') as segments
from nn left join sg on nn.clip_id = sg.clip_id group by nn.clip_id"""


MEL_K = f"select clip_id, frame_idx, bin, ln(greatest(e, {EPS23})) as v from ({project(power(chain(400, 160, POVEY(400)), 512), bank('htk', 80, 512, 16000, 20))}) e"
MEL_N = f"select clip_id, frame_idx, bin, ln(e + {EPS24}) as v from ({project(power(NEMO_FRAMES, 512), bank('slaney', 80, 512, 16000, 0))}) e"
STACKED = f"""select m.clip_id, m.frame_idx - j as frame_idx, j * 80 + bin as dim, v
from ({MEL_K}) m, range(3) r(j), (select clip_id, (n - 400) // 160 + 1 as t from ({LENGTHS}) l) c
where c.clip_id = m.clip_id and m.frame_idx - j between 0 and t - 3"""
NORMED = f"select clip_id, frame_idx, (v - avg(v) over (partition by dim)) / sqrt(greatest(avg(v * v) over (partition by dim) - pow(avg(v) over (partition by dim), 2), 1e-20)) as v from ({STACKED}) s"


def records(frames: str, **kw) -> str:
    """One record per clip, and the errors of the empty and short clips beside each."""
    return f"""with {segs(frames, step=10, **kw)}
select l.clip_id, {r5('any_value(l.n) / 16000.0::double')} as duration_s,
  coalesce(string_agg(start_frame * 10 || '-' || end_frame * 10, ',' order by start_frame), '') as segments, cast(null as varchar) as error
from ({LENGTHS}) l left join sg on l.clip_id = sg.clip_id group by l.clip_id
union all select -1 - clip_id, 0, '', 'samples cannot be empty' from ({LENGTHS}) l
union all select -1001 - clip_id, {r5('200 / 16000.0::double')}, '', 'clip too short for one frame' from ({LENGTHS}) l"""


ORACLE["detect_kaldi"] = records(f"select clip_id, frame_idx, 1 / (1 + exp(-avg(v))) as p from ({NORMED}) q group by all", on=0.5, k=1, m=2)
ORACLE["detect_nemo"] = records(f"select clip_id, frame_idx, 1 / (1 + exp(-20.0::double * (avg(v) + 4.08::double))) as p from ({MEL_N}) q group by all", on=0.5, off=0.4, k=2, m=1)

ORACLE["detect_files"] = ORACLE["detect_nemo"]
ORACLE["read_recordings"] = f"""
select clip_id, sample_idx, {r5('x')} as x, cast(null as varchar) as error from ({SAMPLES}) s
union all select -1001 - clip_id, sample_idx, {r5('x')}, null from ({SAMPLES}) s where sample_idx < 200
union all select -1 - clip_id, null, null, 'samples cannot be empty' from ({LENGTHS}) l"""


def parity(diffs: str, tol_p99: float, tol_max: float) -> str:
    return f"""
select n as n_compared, 0::bigint as n_unmatched, {r5('mx')} as max_abs, {r5('mn')} as mean_abs, {r5('d')} as p99_abs, mx <= {tol_max} and d <= {tol_p99} as passed
from (select d, row_number() over (order by d) - 1 as i, count(*) over () as n, max(d) over () as mx, avg(d) over () as mn from ({diffs}) x) t
where i = cast(floor((n - 1) * 0.99::double) as bigint)"""


ORACLE["feature_parity"] = parity(f"select abs(v - (v + (frame_idx + bin) % 7 / 1000.0::double)) as d from ({VECTORS}) v", 0.05, 0.1)
ORACLE["score_parity"] = parity(f"select abs(p - avg(p) over (partition by clip_id order by frame_idx rows 4 preceding)) as d from ({FX1}) f", 1e-3, 1e-3)
MATCH_A = f"(with {segs(FX1, **P_A)} select clip_id, start_frame * 32 / 1000.0::double as a_start, end_frame * 32 / 1000.0::double as a_end from sg)"
MATCH_B = f"(with {segs(FX1, step=32, on=0.9, off=0.5, k=2, m=3)} select clip_id, start_frame * 32 / 1000.0::double as b_start, end_frame * 32 / 1000.0::double as b_end from sg)"
ORACLE["match_segments"] = f"""
select coalesce(a.clip_id, b.clip_id) as clip_id, 0 as speaker_id, {r5('a_start')} as a_start, {r5('a_end')} as a_end, {r5('b_start')} as b_start, {r5('b_end')} as b_end,
  {r5('case when a_start is null or b_start is null then 0 else (least(a_end, b_end) - greatest(a_start, b_start)) / (greatest(a_end, b_end) - least(a_start, b_start)) end')} as iou,
  coalesce(abs(a_start - b_start) <= 0.1 and abs(a_end - b_end) <= 0.1, false) as same_bounds,
  case when b_start is null then 'a_only' when a_start is null then 'b_only' else 'both' end as side
from {MATCH_A} a full join {MATCH_B} b on a.clip_id = b.clip_id and greatest(a_start, b_start) < least(a_end, b_end)"""

# --- streaming ----------------------------------------------------------------------
# 10-frame chunks, 32 ms frames: an analysis every 20 frames over the last 300 (9.6 s).

ANALYSES = f"""
select clip_id, k as analysis, now, greatest(0, now - 300) as base, now = n as eos
from (select clip_id, n, k, least((k + 1) * 20, n) as now from (select clip_id, n, unnest(range(0, (n + 19) // 20)) as k from ({CLIP_FRAMES}) c) q) z"""
# Whole machine per (clip, analysis): the analysis is folded into the key.
BUFFERS = f"""
select a.clip_id * 100000 + analysis as clip_id, frame_idx, p from ({ANALYSES}) a join ({FX1}) f on f.clip_id = a.clip_id and frame_idx >= base and frame_idx < now"""
STREAM_SEGS = f"""(with {segs(BUFFERS, **P_A)}
select clip_id // 100000 as clip_id, clip_id % 100000 as analysis, start_frame, end_frame from sg)"""
ACTIVE = f"""
select a.*, exists (select 1 from {STREAM_SEGS} s where s.clip_id = a.clip_id and s.analysis = a.analysis and end_frame * 32 >= now * 32 - 100) as active
from ({ANALYSES}) a"""
FIRSTS = f"""
select clip_id, start_frame, min(analysis) as analysis, arg_min(end_frame, analysis) as end_frame, arg_min(now, analysis) as now
from (select s.*, a.now from {STREAM_SEGS} s join ({ANALYSES}) a using (clip_id, analysis) where eos or (now - end_frame) * 32 >= 500) d
group by clip_id, start_frame"""
EVENTS = f"""
select clip_id, analysis, 'segment' as event_type, end_frame * 32 / 1000.0::double as ts, now * 32 / 1000.0::double as emitted,
  start_frame * 32 / 1000.0::double as s0, end_frame * 32 / 1000.0::double as s1, cast(null as boolean) as active from ({FIRSTS}) f
union all
select clip_id, analysis, 'activity', now * 32 / 1000.0::double, now * 32 / 1000.0::double, null, null, active
from (select *, lag(active, 1, false) over (partition by clip_id order by analysis) as was from ({ACTIVE}) x) y where active <> was
union all
select clip_id, analysis, 'activity', now * 32 / 1000.0::double, now * 32 / 1000.0::double, null, null, false from ({ACTIVE}) x where eos and active"""

ORACLE["stream_replay"] = f"""select clip_id, analysis, event_type, {r5('ts')} as timestamp, {r5('emitted')} as emitted_at_s, {r5('s0')} as start_s, {r5('s1')} as end_s,
  active as speech_active from ({EVENTS}) e"""
ORACLE["segment_stream"] = ORACLE["stream_replay"]
# Sound in the chunks 2, 3, 4 and 7 of 0.1 s: 0.2-0.5 closes when twenty silent steps have passed and is
# told 0.3 s after its end, 0.7-0.8 at the end of the stream.
ORACLE["stream_pcm"] = """
with streams as (select vec_id // 250 as stream_id, max(vec_id // 25 % 10) as last, (vec_id // 250) % 5 = 1 as bad from embeddings group by all),
told as (select * from (values
  (2, 'activity', 0.3, 0.3, null, null, true), (6, 'activity', 0.7, 0.7, null, null, false), (7, 'segment', 0.5, 0.8, 0.2, 0.5, null),
  (7, 'activity', 0.8, 0.8, null, null, true), (9, 'segment', 0.8, 1.0, 0.7, 0.8, null), (9, 'activity', 1.0, 1.0, null, null, false)
  ) v(k, event_type, ts, emitted, s0, s1, active))
select stream_id, cast(k as bigint) as analysis, event_type, ts::double as timestamp, emitted::double as emitted_at_s, s0::double as start_s,
  s1::double as end_s, active as speech_active, cast(null as varchar) as message
from streams, told where k <= last and not (bad and k >= 6)
union all select stream_id, -1, 'error', 0.6, 0.6, null, null, null, 'sample rate must be 16000, got 8000' from streams where bad and last >= 6"""
ORACLE["abs_time"] = f"select clip_id, analysis, eos, {r5('base * 32 / 1000.0::double')} as buf_start_s, {r5('now * 32 / 1000.0::double')} as now_s from ({ANALYSES}) a"
ORACLE["dedupe_bucket"] = f"""
select clip_id, bucket, min(analysis) as analysis, {r5('arg_min(s0, analysis * 100000 + s0)')} as start_s, {r5('arg_min(s1, analysis * 100000 + s0)')} as end_s
from (select *, cast(floor(round(s0, 6)) as bigint) as bucket from ({EVENTS}) e where event_type = 'segment') b group by clip_id, bucket"""
ORACLE["debounce"] = f"""with {machine(f"select clip_id, analysis as frame_idx, cast(active as double) as p from ({ACTIVE}) x", on=0.5, k=2, m=2)}
select f0.clip_id, f0.frame_idx as analysis, f0.p = 1 as speech_active, state = 1 as debounced from f0 join st using (clip_id, frame_idx)"""
ORACLE["stream_hold"] = f"""with {machine(f"select clip_id, analysis as frame_idx, cast(active as double) as p from ({ACTIVE}) x", on=0.5, k=2, m=2)},
ends as (select clip_id, analysis, now from ({ANALYSES}) a0 where eos)
select 's' || t.clip_id as stream_id, t.frame_idx as analysis, {r5('now * 32 / 1000.0::double')} as timestamp, state = 1 as speech_active
from tr t join ({ANALYSES}) a on a.clip_id = t.clip_id and a.analysis = t.frame_idx
union all select 's' || e.clip_id, e.analysis, {r5('now * 32 / 1000.0::double')}, false
from ends e join st on st.clip_id = e.clip_id and st.frame_idx = e.analysis where state = 1"""
ORACLE["stream_latency"] = f"""select clip_id, event_type, count(*) as n_events, {r5('avg(emitted - ts)')} as avg_delay_s, {r5('max(emitted - ts)')} as max_delay_s
from ({EVENTS}) e group by clip_id, event_type"""
ORACLE["events_json"] = f"""
select clip_id, case event_type when 'segment' then '{{"confidence":1.0,"end":' || s1 || ',"speaker_id":0,"start":' || s0 || ',"timestamp":' || ts || ',"type":"segment"}}'
  else '{{"speech_active":' || active || ',"timestamp":' || ts || ',"type":"activity"}}' end as json from ({EVENTS}) e"""
