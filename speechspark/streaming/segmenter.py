"""Stateful streaming segmenter over chunk streams.

Two modes.  ``rolling`` re-analyses a bounded buffer (parity with the unary rules);
``incremental`` carries the state of the on/off machine and looks at each value once.
State lives in the state store, keyed by stream.  It is bounded by the buffer length, plus at most
``max_waiting`` chunks that are ahead of a missing one when a trigger ends; a stream that would need more
ends with an error event.  With None any number waits in the store, and the result is whole however late the
missing chunk is.  What stays of an ended stream is its place, so that late repeats are known; with
``idle_ttl_s`` that expires too.

A stream that stops without its end keeps a segment open.  ``close_after_s`` sets a timer on every stream: when
nothing has come for so long, the open segment is closed where the stream broke off, an ``abandoned`` event says
which chunk was expected and how many waited for it, and the state is cleared.  Chunks of the trigger in which the
timer runs out still count, later ones are ignored.
Timers run on the clock or, with ``event_time``, on the watermark of that column.  A table that is not a stream
has no timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from speechspark.operators.segmenting import SegmentParams, resolve
from speechspark.schemas import EVENTS
from speechspark.streaming.analysers import Analyser, switch_points
from speechspark.streaming.params import StreamParams

EVENT_COLUMNS = [part.split()[0] for part in EVENTS.split(", ")]


class _OrderedChunks(StatefulProcessor):
    """Hands chunks to ``consume`` in ``seq`` order without gaps.

    A chunk ahead of its turn waits in the store; one behind the consumed position is a
    repeat and is dropped.  After the end of a stream, or an invalid chunk, the rest is ignored.
    """

    max_waiting: int | None = 4_096
    ttl_ms: int | None = None  # forget a stream that has been idle this long; nothing is emitted
    close_ms: int | None = None  # close a stream that has been idle this long
    event_time = False  # ... by the watermark, the newest time of a chunk being in ``at_ms``

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next_seq bigint, done boolean, n_waiting bigint", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "seq bigint", "payload binary, eos boolean, error string", self.ttl_ms)
        self.handle = handle
        self.due = None if self.close_ms is None else handle.getValueState("due", "at bigint", self.ttl_ms)
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_seq, done, n_waiting = self.place.get() if self.place.exists() else (0, False, 0)
        out: list[dict] = []
        newest = None
        for pdf in rows:
            if done:
                continue
            if self.event_time and pdf["at_ms"].notna().any():
                newest = max(newest or 0, int(pdf["at_ms"].max()))
            errors = pdf["error"] if "error" in pdf.columns else [None] * len(pdf)
            arrived = sorted(
                zip(pdf["seq"], pdf["samples"], pdf["end_of_stream"], errors), key=lambda r: r[0]
            )
            for seq, x, eos, error in arrived:
                if done or seq < next_seq:
                    continue
                error = None if error is None or error != error else str(error)
                values = np.zeros(0, np.float32) if x is None else np.asarray(x, dtype=np.float32)
                if seq > next_seq:
                    n_waiting += not self.waiting.containsKey((int(seq),))
                    self.waiting.updateValue((int(seq),), (values.tobytes(), bool(eos), error))
                    continue
                done = self._take(values, bool(eos), error, out)
                next_seq += 1
                while not done and self.waiting.containsKey((next_seq,)):
                    data, eos2, error2 = self.waiting.getValue((next_seq,))
                    self.waiting.removeKey((next_seq,))
                    n_waiting -= 1
                    done = self._take(np.frombuffer(data, np.float32), eos2, error2, out)
                    next_seq += 1
        # Rows of one trigger come in any order: only what still waits behind it counts.
        if not done and self.max_waiting is not None and n_waiting > self.max_waiting:
            done = self._take(np.zeros(0, np.float32), True, f"chunk {next_seq} is missing and {self.max_waiting} chunks wait for it", out)
        self.place.update((int(next_seq), bool(done), 0 if done else int(n_waiting)))
        if done:
            self.waiting.clear()
            self.forget()
        self.flush()
        self._set_timer(done, newest, timerValues)
        yield from _events(key, out)

    def _set_timer(self, done: bool, newest: int | None, now) -> None:
        """One timer a stream, ``close_ms`` after its newest chunk; none after its end."""
        if self.due is None:
            return
        old = self.due.get()[0] if self.due.exists() else None
        if done:
            at = None
        elif not self.event_time:
            at = now.getCurrentProcessingTimeInMs() + self.close_ms
        elif newest is None:  # chunks without a time don't move a timer
            at = now.getCurrentWatermarkInMs() + self.close_ms if old is None else old
        else:
            at = max(newest + self.close_ms, old or 0)
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((int(at),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_seq, done, n_waiting = self.place.get() if self.place.exists() else (0, True, 0)
        self.due.clear()
        if done:
            return
        out: list[dict] = []
        self._take(np.zeros(0, np.float32), True, None, out)
        at = self.heard()
        out.append({
            "analysis": -1, "timestamp": at, "emitted_at_s": at, "event_type": "abandoned",
            "message": f"no chunk {next_seq} for {self.close_ms / 1000:g} s, {n_waiting} chunks waited for it",
        })
        self.place.update((int(next_seq), True, 0))
        self.waiting.clear()
        self.forget()
        yield from _events(key, out)

    def _take(self, values, eos, error, out) -> bool:
        first = len(out)
        if error is not None:
            out.append({"analysis": -1, "timestamp": self.heard(), "event_type": "error", "message": error})
        else:
            self.consume(values, eos, out)
        for event in out[first:]:  # as much of the stream had arrived when it was told
            event["emitted_at_s"] = self.heard()
        return eos or error is not None

    def close(self) -> None:
        pass

    # Overridden by the two modes.
    def open(self, handle) -> None: ...

    def consume(self, values: np.ndarray, eos: bool, out: list) -> None: ...

    def heard(self) -> float: ...

    def flush(self) -> None: ...

    def forget(self) -> None: ...


def _events(key, out: list[dict]) -> Iterator[pd.DataFrame]:
    if out:
        rows_out = [{"stream_id": key[0], **event} for event in out]
        yield pd.DataFrame({c: pd.Series([e.get(c) for e in rows_out], dtype=object) for c in EVENT_COLUMNS})


def _activity(analysis: int, at: float, active: bool) -> dict:
    return {"analysis": analysis, "timestamp": at, "event_type": "activity", "speech_active": active}


def _segment(analysis: int, start: float, end: float, speaker: int, confidence: float) -> dict:
    return {
        "analysis": analysis, "timestamp": end, "event_type": "segment", "start_s": start, "end_s": end,
        "speaker_id": speaker, "confidence": confidence,
    }


class RollingSegmenter(_OrderedChunks):
    """Keeps the last ``max_buffer_s`` and re-runs the analyser once enough new values came."""

    def __init__(self, analyser: Analyser, params: StreamParams):
        self.analyser, self.params = analyser, params

    def open(self, handle):
        self.state = handle.getValueState(
            "buffer", "values binary, start bigint, fresh bigint, analysis bigint, active boolean, emitted array<bigint>, streak bigint",
            self.ttl_ms,
        )
        self.live = None

    def _load(self):
        if self.live is None:
            if self.state.exists():
                data, start, fresh, analysis, active, emitted, streak = self.state.get()
                self.live = [np.frombuffer(data, np.float32), start, fresh, analysis, active, set(emitted), streak]
            else:
                # values, place of the first, new values, analyses, active, emitted starts, analyses against ``active``
                self.live = [np.zeros(0, np.float32), 0, 0, 0, False, set(), 0]
        return self.live

    def heard(self):
        live = self._load()
        return (live[1] + len(live[0])) / self.params.rate

    def flush(self):
        if self.live is not None:
            buf, start, fresh, analysis, active, emitted, streak = self.live
            self.state.update((np.ascontiguousarray(buf).tobytes(), int(start), int(fresh), int(analysis), bool(active), sorted(emitted), int(streak)))
            self.live = None

    def forget(self):
        self.live = None
        self.state.clear()

    def consume(self, values, eos, out):
        live, pr = self._load(), self.params
        buf, start = np.concatenate([live[0], values]), live[1]
        live[2] += len(values)
        if len(buf) > pr.max_values:
            start += len(buf) - pr.max_values
            buf = buf[-pr.max_values:]
        live[0], live[1] = buf, start
        if not (eos or live[2] >= pr.min_values):
            return
        live[2] = 0
        if len(buf) == 0:
            return
        base, now = start / pr.rate, (start + len(buf)) / pr.rate
        k, eps = live[3], 1e-9
        live[3] += 1
        active = False
        emitted = live[5]
        for s, e, speaker, confidence in self.analyser(buf):
            a, b = base + s, base + e
            active = active or b >= now - pr.active_tol_s - eps
            if not (eos or now - b >= pr.finalize_s - eps):
                continue
            if pr.suppress_left_edge and start > 0 and s <= 0:
                continue
            key = pr.start_key(a)
            if key not in emitted:
                emitted.add(key)
                out.append(_segment(k, a, b, speaker, confidence))
        # A later buffer cannot contain an earlier start, so older keys are of no use.
        oldest = pr.start_key(base) - 1
        live[5] = {x for x in emitted if x >= oldest}
        live[6] = live[6] + 1 if active != live[4] else 0
        if live[6] >= pr.hold:
            live[4], live[6] = active, 0
            out.append(_activity(k, now, active))
        if eos and live[4]:
            live[4] = False
            out.append(_activity(k, now, False))


class IncrementalSegmenter(_OrderedChunks):
    """Carries the on/off machine across chunks; equals the batch segmenter on the whole stream."""

    def __init__(self, preset: str | SegmentParams):
        self.params = resolve(preset)

    def open(self, handle):
        self.state = handle.getValueState(
            "machine", "tail binary, seen bigint, decided bigint, speech boolean, start bigint, last_end bigint",
            self.ttl_ms,
        )
        self.live = None

    def _load(self):
        if self.live is None:
            if self.state.exists():
                data, *rest = self.state.get()
                self.live = [np.frombuffer(data, np.float64), *rest]
            else:
                # last values, values seen, frames decided, in speech, open start, previous end
                self.live = [np.zeros(0), 0, 0, False, -1, 0]
        return self.live

    def flush(self):
        if self.live is not None:
            tail, *rest = self.live
            seen, decided, speech, start, last_end = rest
            self.state.update((np.ascontiguousarray(tail).tobytes(), int(seen), int(decided), bool(speech), int(start), int(last_end)))
            self.live = None

    def forget(self):
        self.live = None
        self.state.clear()

    def heard(self):
        return self._load()[1] * self.params.step_ms / 1000.0

    def consume(self, values, eos, out):
        live, pr = self._load(), self.params
        x = np.concatenate([live[0], values.astype(np.float64)])
        seen = live[1] + len(values)
        base = seen - len(x)
        ev = switch_points(x, pr)
        limit = seen if eos else max(seen - pr.ahead, live[2])  # frames whose look-ahead is complete
        step = pr.step_ms / 1000.0
        for i in np.flatnonzero(ev >= 0):
            at = base + int(i)
            if at < live[2] or at >= limit or bool(ev[i]) == live[3]:
                continue
            live[3] = bool(ev[i])
            if live[3]:
                live[4] = max(at - pr.k + 1 - pr.backfill, live[5] if pr.backfill > pr.m else 0, 0)
            else:
                end = at - pr.m + 1
                out.append(_segment(at, live[4] * step, end * step, 0, 1.0))
                live[5] = end
            out.append(_activity(at, (at + 1) * step, live[3]))
        live[2] = limit
        if eos and live[3]:
            live[3] = False
            out.append(_segment(seen, live[4] * step, seen * step, 0, 1.0))
            out.append(_activity(seen, seen * step, False))
        # Decisions at ``limit`` look back ``back`` values (one more keeps a mean window whole).
        keep = seen - limit + pr.back + pr.smooth
        live[0], live[1] = x[-keep:] if keep < len(x) else x, seen


def _run(chunks: DataFrame, processor: _OrderedChunks, idle_ttl_s: float | None, max_waiting: int | None,
         close_after_s: float | None, event_time: str | None) -> DataFrame:
    if event_time is not None and (close_after_s is None or idle_ttl_s is not None):
        raise ValueError("event_time is for close_after_s, and idle_ttl_s runs on the clock only")
    processor.max_waiting = max_waiting
    if idle_ttl_s is not None:
        processor.ttl_ms = int(idle_ttl_s * 1000)
    if close_after_s is not None:
        processor.close_ms = int(close_after_s * 1000)
    if "error" not in chunks.columns:
        from speechspark.sources.chunks import validate_chunks

        chunks = validate_chunks(chunks)
    # A batch run needs the state store coordinator, which the stream manager brings up.
    _ = chunks.sparkSession.streams.active
    columns = ["stream_id", "seq", "samples", "end_of_stream", "error"]
    mode = "None" if idle_ttl_s is None and close_after_s is None else "ProcessingTime"
    if event_time is not None:
        # A plain number instead of the watermarked column: a chunk behind the watermark still belongs to an open stream.
        processor.event_time, mode = True, "EventTime"
        chunks, columns = chunks.withColumn("at_ms", F.unix_millis(F.col(event_time))), [*columns, "at_ms"]
    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.select(*columns).groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=EVENTS.replace("stream_id bigint", f"stream_id {kind}"), outputMode="Append",
        timeMode=mode,
    )


def segment_stream(chunks: DataFrame, analyser: Analyser, params: StreamParams = StreamParams(),
                   idle_ttl_s: float | None = None, max_waiting: int | None = 4_096,
                   close_after_s: float | None = None, event_time: str | None = None) -> DataFrame:
    """Rolling-buffer events of every stream.

    The end-of-stream flag finalises a stream, or ``close_after_s`` without a chunk, by the clock or by the
    watermark that ``chunks`` has on ``event_time``.  ``idle_ttl_s`` drops the state of streams that stopped.
    ``max_waiting=None`` lets any number of chunks wait for a missing one.
    """
    return _run(chunks, RollingSegmenter(analyser, params), idle_ttl_s, max_waiting, close_after_s, event_time)


def segment_stream_incremental(chunks: DataFrame, preset: str | SegmentParams, idle_ttl_s: float | None = None,
                               max_waiting: int | None = 4_096, close_after_s: float | None = None,
                               event_time: str | None = None) -> DataFrame:
    """Events from frame scores without re-analysis; options as in ``segment_stream``."""
    return _run(chunks, IncrementalSegmenter(preset), idle_ttl_s, max_waiting, close_after_s, event_time)
