"""Scalar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time ---------------------------------------------------------------------------


def frame_seconds(frame, step_ms: float) -> Column:
    return _c(frame).cast("double") * F.lit(float(step_ms)) / F.lit(1000.0)


def duration(n_samples, rate: int = SAMPLE_RATE) -> Column:
    return _c(n_samples).cast("double") / F.lit(float(rate))


# --- frame counts -------------------------------------------------------------------


def samples_of_ms(rate: int, ms: float) -> int:
    return int(math.floor(rate * ms / 1000.0 + 0.5))


def n_frames_snip(n, length: int, shift: int) -> Column:
    n = _c(n).cast("bigint")
    full = F.floor((n - F.lit(length)) / F.lit(shift)).cast("bigint") + 1
    return F.when(n < length, F.lit(0).cast("bigint")).otherwise(full)


def n_frames_center(n, shift: int) -> Column:
    return F.floor((_c(n).cast("bigint") + F.lit(shift // 2)) / F.lit(shift)).cast("bigint")


def n_frames_stft(n, nfft: int, hop: int, pad_to: int = 2) -> Column:
    n = _c(n).cast("bigint")
    raw = F.floor((n + F.lit(2 * (nfft // 2) - nfft)) / F.lit(hop)).cast("bigint")
    t = F.when((n > 0) & (raw > 0), raw).otherwise(F.lit(0).cast("bigint"))
    if pad_to <= 0:
        return t
    return (F.ceil(t / F.lit(pad_to)) * F.lit(pad_to)).cast("bigint")


def next_pow2(n) -> Column:
    """Smallest power of two >= n (1 for n <= 1)."""
    n = _c(n).cast("bigint")
    bits = F.length(F.bin(F.greatest(n, F.lit(1)) - 1))
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), bits).cast("bigint"))


# --- mel scales ---------------------------------------------------------------------
# Fixed values of the two published mel scales.
HTK_SCALE, HTK_BREAK_HZ = 1127.0, 700.0
SLANEY_HZ_PER_MEL = 200.0 / 3.0
SLANEY_BREAK_HZ = 1000.0
SLANEY_BREAK_MEL = SLANEY_BREAK_HZ / SLANEY_HZ_PER_MEL
SLANEY_LOG_STEP = math.log(6.4) / 27.0


def hz_to_mel_htk(hz) -> Column:
    return F.lit(HTK_SCALE) * F.log(F.lit(1.0) + _c(hz) / F.lit(HTK_BREAK_HZ))


def mel_to_hz_htk(mel) -> Column:
    return F.lit(HTK_BREAK_HZ) * (F.exp(_c(mel) / F.lit(HTK_SCALE)) - F.lit(1.0))


def hz_to_mel_slaney(hz) -> Column:
    hz = _c(hz)
    log_part = F.lit(SLANEY_BREAK_MEL) + F.log(hz / F.lit(SLANEY_BREAK_HZ)) / F.lit(SLANEY_LOG_STEP)
    return F.when(hz < SLANEY_BREAK_HZ, hz / F.lit(SLANEY_HZ_PER_MEL)).otherwise(log_part)


def mel_to_hz_slaney(mel) -> Column:
    mel = _c(mel)
    exp_part = F.lit(SLANEY_BREAK_HZ) * F.exp(F.lit(SLANEY_LOG_STEP) * (mel - F.lit(SLANEY_BREAK_MEL)))
    return F.when(mel < SLANEY_BREAK_MEL, mel * F.lit(SLANEY_HZ_PER_MEL)).otherwise(exp_part)


# --- log compression ----------------------------------------------------------------
FLOAT32_EPSILON = 2.0**-23
STFT_LOG_OFFSET = 2.0**-24


def log_floor(energy, floor: float = 0.0, use_log: bool = True) -> Column:
    energy = _c(energy)
    return F.log(F.greatest(energy, F.lit(max(floor, FLOAT32_EPSILON)))) if use_log else energy


def log_offset(energy, offset: float = STFT_LOG_OFFSET) -> Column:
    return F.log(_c(energy) + F.lit(offset))


# --- class scores -------------------------------------------------------------------


def softmax_pair(a, b) -> Column:
    """Probability of the second of two logits, shifted by the larger one, as float32."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    top = F.greatest(a, b)
    return (F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))).cast("float")


def argmax(values) -> Column:
    """Index of the largest element; the first one wins a tie."""
    values = _c(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_confidence(log_probs) -> Column:
    return F.exp(F.array_max(_c(log_probs)).cast("double")).cast("float")


def entropy_bits(probs) -> Column:
    """Shannon entropy over the terms above 1e-10."""
    return F.aggregate(
        _c(probs), F.lit(0.0), lambda acc, p: acc - F.when(p > 1e-10, p * F.log2(p)).otherwise(F.lit(0.0))
    )


# --- PCM values ---------------------------------------------------------------------


def to_int16_scale(x) -> Column:
    return _c(x) * F.lit(32768.0).cast("float")


def to_pcm16(x, mode: str = "asymmetric") -> Column:
    """Quantise [-1, 1] to int16, truncating toward zero.

    asymmetric: clip first, x32768 below zero and x32767 above; symmetric: x32768, then clip.
    """
    x = _c(x).cast("double")
    if mode == "asymmetric":
        s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
        return F.when(s < 0, s * 32768.0).otherwise(s * 32767.0).cast("int")
    if mode == "symmetric":
        return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x * 32768.0)).cast("int")
    raise ValueError(f"unknown mode {mode!r}")
