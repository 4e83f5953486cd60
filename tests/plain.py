"""Plain, slow definitions that the distributed operators are compared with."""

import numpy as np


def predicates(p, prm):
    s = np.asarray(p, dtype=np.float64)
    if prm.smooth > 1:
        s = np.array([s[max(0, i - prm.smooth + 1): i + 1].mean() for i in range(len(s))])
    s = s.astype(np.float32)
    on = s <= np.float32(prm.on) if prm.invert else s >= np.float32(prm.on)
    if prm.vote_half:
        on = np.array([on[max(0, i - prm.vote_half): i + prm.vote_half].sum() >= prm.vote_need for i in range(len(on))], dtype=bool)
    off = ~on if prm.off is None else s < np.float32(prm.off)
    return on, off


def segments(p, prm):
    """Search for the next completed run of the wanted kind, alternating on and off."""
    on, off = predicates(p, prm)
    n, out, i, floor = len(on), [], 0, 0

    def find(flag, k, begin):
        run = 0
        for j in range(begin, n):
            run = run + 1 if flag[j] else 0
            if run >= k:
                return j
        return None

    while True:
        hit = find(on, prm.k, i)
        if hit is None:
            return out
        start = max(hit - prm.k + 1 - prm.backfill, 0, floor)
        end_at = find(off, prm.m, hit + 1)
        if end_at is None:
            return out + [(start, n)]
        floor = end_at - prm.m + 1
        out.append((start, floor))
        i = end_at + 1


def diarize(logits, window_sec, speakers, gap):
    """logits [windows][frames][classes] -> merged (speaker, start, end, confidence)."""
    emitted = []
    for w, win in enumerate(logits):
        n = len(win)
        cls = [int(np.argmax(f)) for f in win]
        rows = []
        for spk in range(3):
            f = 0
            while f < n:
                if spk not in speakers[cls[f]]:
                    f += 1
                    continue
                g = f
                while g < n and spk in speakers[cls[g]]:
                    g += 1
                conf = float(np.mean([np.exp(max(win[x])) for x in range(f, g)]))
                end = w * window_sec + window_sec if g == n else w * window_sec + g * window_sec / n
                rows.append((g, spk, w * window_sec + f * window_sec / n, end, conf))
                f = g
        emitted += sorted(rows)
    out = []
    for _, spk, s, e, c in emitted:
        if out and out[-1][0] == spk and s - out[-1][2] < gap:
            out[-1][2] = e
        else:
            out.append([spk, s, e, c])
    return out


def stream_events(chunks, analyse, prm):
    """Buffer rules over one stream: list of (kind, ...)."""
    buf, start, fresh, active, seen, out = np.zeros(0, np.float32), 0, 0, False, set(), []
    for x, eos in chunks:
        buf, fresh = np.concatenate([buf, x]), fresh + len(x)
        cut = max(len(buf) - prm.max_values, 0)
        buf, start = buf[cut:], start + cut
        if not eos and fresh < prm.min_values:
            continue
        fresh = 0
        found = [(start / prm.rate + s, start / prm.rate + e) for s, e, *_ in analyse(buf)]
        now = (start + len(buf)) / prm.rate
        for s, e in found:
            if (eos or now - e >= prm.finalize_s - 1e-9) and prm.start_key(s) not in seen:
                seen.add(prm.start_key(s))
                out.append(("segment", round(s, 5), round(e, 5)))
        reach = any(e >= now - prm.active_tol_s - 1e-9 for _, e in found)
        if reach != active:
            active = reach
            out.append(("activity", round(now, 5), active))
        if eos and active:
            out.append(("activity", round(now, 5), False))
    return out
