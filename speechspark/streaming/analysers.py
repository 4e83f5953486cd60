"""Buffer analysers: a bounded array of values -> segments relative to its start."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np

from speechspark.operators.segmenting import SegmentParams, resolve

# (start_s, end_s, speaker_id, confidence)
Segment = tuple[float, float, int, float]
Analyser = Callable[[np.ndarray], list[Segment]]


def _held(flag: np.ndarray, k: int) -> np.ndarray:
    """True where ``flag`` held on the last k positions."""
    total = np.concatenate([[0], np.cumsum(flag)])
    out = np.zeros(len(flag), dtype=bool)
    out[k - 1:] = (total[k:] - total[:-k])[: max(len(flag) - k + 1, 0)] == k if len(flag) >= k else False
    return out


def switch_points(p: np.ndarray, params: SegmentParams) -> np.ndarray:
    """1 where speech may switch on, 0 where it may switch off, -1 elsewhere."""
    n = len(p)
    if n == 0:
        return np.zeros(0, dtype=np.int8)
    s = np.asarray(p, dtype=np.float64)
    if params.smooth > 1:
        total = np.concatenate([[0.0], np.cumsum(s)])
        lo = np.maximum(np.arange(n) - params.smooth + 1, 0)
        s = (total[1:] - total[lo]) / (np.arange(n) - lo + 1)
    s = s.astype(np.float32)
    on = s <= np.float32(params.on) if params.invert else s >= np.float32(params.on)
    if params.vote_half:
        total = np.concatenate([[0], np.cumsum(on)])
        lo, hi = np.maximum(np.arange(n) - params.vote_half, 0), np.minimum(np.arange(n) + params.vote_half, n)
        on = total[hi] - total[lo] >= params.vote_need
    off = ~on if params.off is None else s < np.float32(params.off)
    return np.where(_held(on, params.k), 1, np.where(_held(off, params.m), 0, -1)).astype(np.int8)


def alternate(ev: np.ndarray, state: int = 0) -> np.ndarray:
    """Positions where the state changes, starting from ``state``."""
    at = np.flatnonzero(ev >= 0)
    return at[np.concatenate([[state], ev[at][:-1]]) != ev[at]] if len(at) else at


class ScoreAnalyser:
    """Hysteresis segmenter over a buffer of frame scores, with the machine starting afresh."""

    def __init__(self, preset: str | SegmentParams):
        self.params = resolve(preset)

    def frames(self, p: np.ndarray) -> list[tuple[int, int]]:
        ev = switch_points(p, self.params)
        flips = alternate(ev)
        starts = np.maximum(flips[::2] - self.params.k + 1 - self.params.backfill, 0)
        ends = flips[1::2] - self.params.m + 1
        if len(ends) < len(starts):
            ends = np.append(ends, len(p))
        if self.params.backfill > self.params.m and len(starts) > 1:
            starts[1:] = np.maximum(starts[1:], ends[:-1])
        return list(zip(starts.tolist(), ends.tolist()))

    def __call__(self, p: np.ndarray) -> list[Segment]:
        step = self.params.step_ms / 1000.0
        return [(s * step, e * step, 0, 1.0) for s, e in self.frames(p)]


class BufferedScores:
    """The segments of many buffers cut from one array, without re-reading each buffer.

    A switch at position i depends on ``back`` values before it and ``ahead`` after it, so only
    the edges of a buffer can differ from the switches of the whole array.  The edges are worked
    out per buffer; in between, the precomputed change points are used.
    """

    def __init__(self, x: np.ndarray, params: SegmentParams):
        self.x, self.params = x, params
        self.full = ScoreAnalyser(params)
        ev = switch_points(x, params)
        at = np.flatnonzero(ev >= 0)
        value = ev[at]
        self.changes = at[1:][value[1:] != value[:-1]].tolist()
        self.at, self.value = at.tolist(), value.tolist()
        self.back, self.ahead = params.back, params.ahead
        self.plain = params.smooth == 1 and not params.vote_half
        self.held = (params.m - 1, params.k - 1)

    def _head(self, lo: int, left: int, first: int) -> list[int]:
        """State changes among the first ``back`` positions of a buffer."""
        if not self.plain:
            head = switch_points(self.x[lo:left + self.ahead], self.params)[: self.back]
            return (lo + alternate(head)).tolist()
        flips, state = [], 0
        for j in range(bisect_left(self.at, lo), first):
            # A run counts if all of it lies inside the buffer.
            if self.value[j] != state and self.at[j] >= lo + self.held[self.value[j]]:
                state = self.value[j]
                flips.append(self.at[j])
        return flips

    def frames(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """As ``ScoreAnalyser.frames(x[lo:hi])``, with positions counted in the whole array."""
        pr = self.params
        left, right = lo + self.back, hi - self.ahead
        if right - left <= self.back:
            return [(lo + s, lo + e) for s, e in self.full.frames(self.x[lo:hi])]
        first = bisect_left(self.at, left)
        flips = self._head(lo, left, first)
        if first < len(self.at) and self.at[first] < right:
            if self.value[first] != len(flips) % 2:
                flips.append(self.at[first])
            flips += self.changes[bisect_right(self.changes, self.at[first]):bisect_left(self.changes, right)]
        if self.ahead:
            tail = switch_points(self.x[right - self.back:hi], pr)[self.back:]
            flips += (right + alternate(tail, len(flips) % 2)).tolist()
        starts = [max(f - pr.k + 1 - pr.backfill, lo) for f in flips[::2]]
        ends = [f - pr.m + 1 for f in flips[1::2]]
        if len(ends) < len(starts):
            ends.append(hi)
        if pr.backfill > pr.m:
            starts[1:] = [max(s, e) for s, e in zip(starts[1:], ends)]
        return list(zip(starts, ends))


class EnergyAnalyser:
    """Weight-free PCM analyser: level of 10 ms steps against a threshold, then hysteresis."""

    def __init__(self, level: float = 1e-3, rate: int = 16_000, params: SegmentParams | None = None):
        self.level, self.hop = level, rate // 100
        self.inner = ScoreAnalyser(params or SegmentParams(step_ms=10, on=0.5, min_on=5, min_off=20))

    def __call__(self, x: np.ndarray) -> list[Segment]:
        n = len(x) // self.hop
        power = (np.asarray(x[: n * self.hop], dtype=np.float64).reshape(n, self.hop) ** 2).mean(axis=1)
        return self.inner((np.sqrt(power) >= self.level).astype(np.float32))
