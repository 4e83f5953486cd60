"""Rules of the rolling-buffer analysis, in seconds."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class StreamParams:
    rate: float = 16_000.0  # values (samples or frames) per second
    max_buffer_s: float = 30.0
    min_analyze_s: float = 0.4
    finalize_s: float = 0.5
    active_tol_s: float = 0.1
    dedupe: str = "exact"  # or "bucket": starts within one bucket count as the same segment
    bucket_s: float = 0.1
    hold: int = 1  # an activity flag changes after so many analyses in a row agree
    suppress_left_edge: bool = False  # drop segments cut by the start of a buffer that has slid

    @property
    def max_values(self) -> int:
        return int(self.max_buffer_s * self.rate)

    @property
    def min_values(self) -> int:
        return int(self.min_analyze_s * self.rate)

    def start_key(self, start_s: float) -> int:
        if self.dedupe == "bucket":
            return math.floor(round(start_s / self.bucket_s, 6))
        return round(start_s * 1e6)
