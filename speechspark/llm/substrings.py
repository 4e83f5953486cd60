"""Exact substring de-duplication by fixed-block anchors.

Documents are cut into batches by a hash, each of a bounded amount of text.  Every batch indexes the
non-overlapping blocks of its documents (``BLOCK`` words at positions 0, BLOCK, 2 BLOCK, ...) and
probes with every rolling window of that length.  A run of ``window`` >= 2 BLOCK - 1 words holds a whole
block wherever it stands, so two equal runs meet: the block of one is a rolling window of the other.

Only sorted, de-duplicated hashes travel: one packed list per batch and bucket, in which a hash that
fills a batch counts once, with a bit for "is a block here" and one for "more than once here".  Buckets
send back a bitmap of the hits.  Hits are extended to all runs of ``window`` words through them; these
runs are compared over the whole corpus the same way, and the union of the equal ones is the maximal
repeats.  Equal means equal in 96 bits: a rolling 64-bit hash and 32 bits of a chain that is computed
apart from it, from other hashes of the words.  No pair of occurrences is ever listed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechspark.llm.common import sha256_hex

WINDOW = 35
BLOCK = 18
BATCH_MB = 2
#: Least text per batch and bucket, so that a packed list holds about a hundred hashes.
LIST_BYTES = 600
#: Bits of an anchor's hash that are compared; false hits only cost a comparison later.
ANCHOR_BITS = 46
#: Bytes of text, and windows, that a task hashes at a time.
_PIECE = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Distinct words whose digests a task remembers at a time.
_KNOWN = 1 << 16


@lru_cache(maxsize=2)
def _tables(size: int):
    """The first powers of an odd base and of its inverse, modulo 2^64."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    powers = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size + 1, b, dtype=np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return powers


def _mix(x):
    """A bijection of 64-bit numbers that spreads every bit (a public finaliser's constants)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Digests(dict):
    """128-bit digests of words; frequent words are looked up instead of hashed again."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= _KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh3_128_digest(word)
        return found


def word_digests(data: bytes, known: dict | None = None):
    """Two independent 64-bit hashes of each word of a text, in order; long texts go in pieces cut at white space."""
    import numpy as np

    digest, out, at = (_Digests() if known is None else known).__getitem__, [], 0
    while at < len(data):
        gap = _SPACE.search(data, min(at + _PIECE, len(data)))
        end = gap.start() if gap else len(data)
        out.append(np.frombuffer(b"".join(map(digest, data[at:end].split())), dtype="<u8").reshape(-1, 2))
        at = end + 1
    both = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def word_hashes(data: bytes):
    """The first hash of each word."""
    return word_digests(data)[0]


def window_hashes(words, size: int):
    """Hashes of all runs of ``size`` words of one sequence."""
    import numpy as np

    step = max(_PIECE, size)
    power, inverse = _tables(step + size)
    out = np.empty(max(len(words) - size + 1, 0), dtype=np.uint64)
    for at in range(0, len(out), step):
        part = words[at:min(at + step, len(out)) + size - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[:len(part)], out=sums[1:])
        out[at:at + step] = _mix((sums[size:] - sums[:-size]) * inverse[:len(part) - size + 1])
    return out


def run_checks(words, start, size: int):
    """32 more bits of the runs of ``size`` words that begin at ``start``: a chain through every word.

    It shares nothing with ``window_hashes``: neither the words' hashes nor the sum of products, whose low bits
    agree for some sequences of few words in regular order.
    """
    import numpy as np

    out = np.zeros(len(start), dtype=np.uint32)
    for at in range(0, len(start), _PIECE):
        first = start[at:at + _PIECE]
        chain = np.zeros(len(first), dtype=np.uint64)
        for k in range(size):
            chain = _mix(chain + np.uint64(0x9E3779B97F4A7C15) ^ words[first + k])
        out[at:at + _PIECE] = (chain >> np.uint64(32)).astype(np.uint32)
    return out


class _Batch:
    """Word hashes of a batch's texts one after the other, with the place where each text begins.

    Its arrays are what a task's memory goes to, so texts are read from the column as they are needed, and the
    words' second hashes are kept only where runs are checked.
    """

    def __init__(self, texts, checked: bool = True):
        import numpy as np

        self.column = texts.cast(pa.binary())
        known = _Digests()
        each = [word_digests(x, known)[:1 + checked] for x in self.texts()]
        self.n_words = np.array([len(x[0]) for x in each], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))
        self.words, self.again = (
            np.concatenate([x[k] for x in each]) if each and k <= checked else np.zeros(0, dtype=np.uint64) for k in range(2))

    def texts(self):
        return (x.as_py() or b"" for x in self.column)

    def windows(self, size: int):
        """Hashes of the runs that lie within one text, and where they start."""
        import numpy as np

        inside = np.ones(max(len(self.words) - size + 1, 0), dtype=bool)
        for end in self.first[1:]:
            inside[max(end - size + 1, 0):end] = False
        return window_hashes(self.words, size)[inside], np.flatnonzero(inside)

    def aligned(self, start, block: int):
        """Which of the places are a whole number of blocks away from where their text begins."""
        import numpy as np

        out = np.zeros(len(self.words), dtype=bool)
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            out[a:b:block] = True
        return out[start]


def _packed(values) -> bytes:
    """Sorted numbers as 4-byte steps where they fit, else as they are."""
    import numpy as np

    step = np.diff(values, prepend=np.uint64(0))
    if not len(step) or int(step[1:].max(initial=0)) < 1 << 32:
        return b"4" + int(values[0] if len(values) else 0).to_bytes(8, "little") + step[1:].astype("<u4").tobytes()
    return b"8" + values.astype("<u8").tobytes()


def _unpacked(data: bytes):
    import numpy as np

    if data[:1] == b"8":
        return np.frombuffer(data, dtype="<u8", offset=1).astype(np.uint64)
    steps = np.frombuffer(data, dtype="<u4", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate((np.array([int.from_bytes(data[1:9], "little")], dtype=np.uint64), steps)), dtype=np.uint64)


def _cuts(values, bits: int, n_buckets: int):
    """Where each bucket's share of the sorted numbers begins; buckets are equal ranges of the hash."""
    import numpy as np

    bounds = np.array([(k << bits) // n_buckets for k in range(1, n_buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(values, bounds), [len(values)]))


_PARCEL = pa.schema([
    ("bucket", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("many", pa.binary()), ("block", pa.binary())])
_PARCEL_DDL = "bucket int, batch int, hashes binary, checks binary, many binary, block binary"
_ANSWER = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("checks", pa.binary())])
_ANSWER_DDL = "batch int, bucket int, found binary, checks binary"


def _new(hashes, checks):
    """Where a sorted list takes a new value, told apart by both hashes."""
    import numpy as np

    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    if checks is not None:
        new[1:] |= checks[1:] != checks[:-1]
    return np.flatnonzero(new)


def _order(hashes, checks):
    import numpy as np

    return np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))


def _parcels(batch: int, hashes, block, bits: int, n_buckets: int, checks=None) -> pa.Table:
    """One row per bucket: the batch's distinct hashes, which repeat in it, which are blocks.

    Hashes with ``checks`` are equal only if both agree; a bucket's list is sorted by both.
    """
    import numpy as np

    order = _order(hashes, checks)
    hashes, checks, block = hashes[order], None if checks is None else checks[order], block[order]
    del order
    new = _new(hashes, checks)
    many = np.diff(new, append=len(hashes)) > 1
    blocks = np.maximum.reduceat(block, new) if len(new) else np.zeros(0, dtype=bool)
    values, second = hashes[new], None if checks is None else checks[new]
    del hashes, checks, new
    cut = _cuts(values, bits, n_buckets)
    rows = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    more = [None] * len(rows) if second is None else [second[s].astype("<u4").tobytes() for _, s in rows]
    return pa.table([
        pa.array([k for k, _ in rows], pa.int32()), pa.array([batch] * len(rows), pa.int32()),
        pa.array([_packed(values[s]) for _, s in rows], pa.binary()), pa.array(more, pa.binary()),
        pa.array([np.packbits(many[s]).tobytes() for _, s in rows], pa.binary()),
        pa.array([np.packbits(blocks[s]).tobytes() for _, s in rows], pa.binary()),
    ], schema=_PARCEL)


def _met(parcels: pa.Table):
    """Over a bucket's parcels: (batch, hashes, checks or None, is this one a block somewhere and found twice or more)."""
    import numpy as np

    batches = parcels["batch"].to_pylist()
    lists = [_unpacked(x.as_py()) for x in parcels["hashes"]]
    bits = lambda col: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)) for x, h in zip(col, lists, strict=True)])
    many, block, values = bits(parcels["many"]), bits(parcels["block"]), np.concatenate(lists)
    checks = None if parcels["checks"].null_count else np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in parcels["checks"]])
    order = _order(values, checks)
    new = _new(values[order], None if checks is None else checks[order])
    hit = (np.add.reduceat(many[order].astype(np.int64) + 1, new) > 1) & (np.maximum.reduceat(block[order], new) > 0)
    found = np.zeros(len(values), dtype=bool)
    found[order] = np.repeat(hit, np.diff(np.append(new, len(values))))
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    for k, batch in enumerate(batches):
        part = slice(at[k], at[k + 1])
        yield batch, lists[k], None if checks is None else checks[part], found[part]


def _known(runs, checks, hashes, seconds):
    """Which of the runs are among the sorted pairs (``hashes``, ``seconds``); ``checks`` of some runs on demand."""
    import numpy as np

    place = np.searchsorted(hashes, runs)
    maybe = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == runs)
    wanted, place = checks(maybe), place[maybe]
    out = np.zeros(len(runs), dtype=bool)
    while len(maybe):  # once, but for runs that agree in the first hash alone
        out[maybe] |= seconds[place] == wanted
        place = place + 1
        more = (place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == runs[maybe])
        maybe, wanted, place = maybe[more], wanted[more], place[more]
    return out


def remove_repeats(
    docs: DataFrame, text_col: str = "text", *, window: int = WINDOW, block: int = BLOCK,
    batch_mb: float = BATCH_MB, with_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    Each word covered by a run of ``window`` words that starts anywhere else too (in the same text
    included) is removed; runs are judged on the input.  ``kept_text`` is the rest joined by single
    blanks.  A null or empty text has no words and keeps the empty text; texts shorter than the
    window lose nothing; ``batch_mb`` is the least text of a batch; repeated rows are documents of their own and so lose all runs; null ids are
    allowed.  Input columns named like a result are replaced.  An empty table gives no rows.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    results = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])
    at = docs.columns.index(text_col)
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    # Lists grow as the square of the batches; from some 100 GB on, batches grow with the root of the corpus.
    n_batches = int(total / max(batch_mb * 2**20, (LIST_BYTES * total) ** 0.5)) + 1
    n_buckets = n_batches
    tag = "_batch_of_text"
    while tag in docs.columns:
        tag += "_"
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind])
    dealt = docs.withColumn(tag, F.pmod(spread, F.lit(n_batches)).cast("int"))
    shift = 64 - ANCHOR_BITS

    def index(rows: pa.Table) -> pa.Table:
        import numpy as np

        texts = _Batch(rows.column(at), checked=False)
        hashes, start = texts.windows(block)
        hashes >>= np.uint64(shift)
        aligned = texts.aligned(start, block)
        del texts, start
        return _parcels(rows.column(-1 % rows.num_columns)[0].as_py(), hashes, aligned, ANCHOR_BITS, n_buckets)

    def probe(parcels: pa.Table) -> pa.Table:
        import numpy as np

        bucket = parcels["bucket"][0].as_py()
        rows = [(b, np.packbits(f).tobytes()) for b, _, _, f in _met(parcels) if f.any()]
        return pa.table([
            pa.array([b for b, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()),
            pa.array([f for _, f in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], schema=_ANSWER)

    def extend(rows: pa.Table, hits: pa.Table) -> pa.Table:
        import numpy as np

        if not rows.num_rows or not hits.num_rows:
            return _PARCEL.empty_table()
        texts = _Batch(rows.column(at))
        hashes, start = texts.windows(block)
        hashes >>= np.uint64(shift)
        values, back = np.unique(hashes, return_inverse=True)
        del hashes
        cut, hit = _cuts(values, ANCHOR_BITS, n_buckets), np.zeros(len(values), dtype=bool)
        for b, f in zip(hits["bucket"].to_pylist(), hits["found"], strict=True):
            hit[cut[b]:cut[b + 1]] = np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=cut[b + 1] - cut[b])
        seen = np.zeros(len(texts.words) + 1, dtype=np.int64)
        seen[start[hit[back]] + 1] = 1
        del values, back, start
        np.cumsum(seen, out=seen)
        runs, first = texts.windows(window)
        through = seen[first + window - block + 1] > seen[first]  # an anchor starts in the run's first places
        runs, checks = runs[through], run_checks(texts.again, first[through], window)
        del texts, seen, first, through
        return _parcels(rows.column(-1 % rows.num_columns)[0].as_py(), runs, np.ones(len(runs), dtype=bool), 64, n_buckets, checks)

    def compare(parcels: pa.Table) -> pa.Table:
        bucket = parcels["bucket"][0].as_py()
        rows = [(b, _packed(h[f]), c[f].tobytes()) for b, h, c, f in _met(parcels) if f.any()]
        return pa.table([
            pa.array([b for b, _, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()),
            pa.array([h for _, h, _ in rows], pa.binary()), pa.array([c for _, _, c in rows], pa.binary())], schema=_ANSWER)

    def remove(rows: pa.Table, repeats: pa.Table) -> pa.Table:
        import numpy as np

        rows = rows.drop_columns([rows.column_names[-1]])
        texts = _Batch(rows.column(at))
        cover = np.zeros(len(texts.words) + 1, dtype=np.int64)
        if repeats.num_rows:
            known = np.concatenate([_unpacked(x.as_py()) for x in repeats["found"]])
            seconds = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in repeats["checks"]])
            order = np.lexsort((seconds, known))
            known, seconds = known[order], seconds[order]
            runs, first = texts.windows(window)
            begin = first[_known(runs, lambda some: run_checks(texts.again, first[some], window), known, seconds)]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + window, -1)
        covered = np.cumsum(cover[:-1]) > 0
        removed, sha, kept = [], [], []
        for k, text in enumerate(texts.texts()):
            gone = covered[texts.first[k]:texts.first[k + 1]]
            left = text.split()
            if n := int(gone.sum()):
                left = [left[i] for i in np.flatnonzero(~gone)]
            joined = b" ".join(left)
            removed.append(n)
            sha.append(sha256_hex(joined))
            kept.append(joined if with_text else None)
        out = [pa.array(texts.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        out += [pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []
        return pa.table([*rows.columns, *out], names=[*rows.column_names, *results[:len(out)]])

    by = lambda df, c: df.groupBy(c)
    anchors = by(dealt, tag).applyInArrow(index, _PARCEL_DDL)
    hits = by(anchors, "bucket").applyInArrow(probe, _ANSWER_DDL)
    runs = by(dealt, tag).cogroup(by(hits, "batch")).applyInArrow(extend, _PARCEL_DDL)
    repeats = by(runs, "bucket").applyInArrow(compare, _ANSWER_DDL)
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    extra += [T.StructField("kept_text", T.StringType())] if with_text else []
    schema = T.StructType([*docs.schema.fields, *extra])
    return by(dealt, tag).cogroup(by(repeats, "batch")).applyInArrow(remove, schema)
