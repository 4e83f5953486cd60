"""Spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  Each word
generates its edits as hashes only: every deletion, and every replacement by a larger code point of the
vocabulary's alphabet (insertions are the deletions of the longer word, the other replacements those of
the other word).  The hashes probe blocked Bloom filters of the vocabulary, one per word length, which all
tasks hold; only hits become strings, and an exact join with the vocabulary removes the false ones.

The broadcast is bounded by ``FILTER_MB``: a larger vocabulary is cut by a hash of the word into parts,
whose filters are built and probed one after the other.  Filters are built in segments of ``SEGMENT``
blocks, so that no task holds more than some 20 000 words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import stored

#: Letters of words: A-Z, a-z and the Latin-1 range.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: Bytes of all filters that are broadcast at once, in MB.
FILTER_MB = 32
#: Words per block of 8 lanes of 32 bits (about 12 bits a word); blocks per segment.
PER_BLOCK, SEGMENT = 21, 1024
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000
#: Edits that a task hashes at once.
AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15


def _lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def doc_words(doc_id, text: str | None, drop_every: int | None = None, least: int = LEAST_LENGTH) -> Counter:
    """Counts of the lower-cased letter runs of a text that have ``least`` code points or more.

    With ``drop_every``, a run whose CRC-32 (of ``<doc_id>:<run>``, a null id as nothing) it divides
    first loses the code point at CRC modulo length.
    """
    import re

    runs = Counter(re.findall(f"[{LETTERS}]{{{least},}}", _lower(text or "")))
    if not drop_every:
        return runs
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % drop_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, drop_every: int | None = None, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(``word``, ``n``): the words of whole texts that occur ``least_count`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                held.update(doc_words(i.as_py(), t.as_py(), drop_every))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _mix(h):
    """Spread a hash over all 64 bits."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _letters(words: list[str]):
    """Code points of words of one length, a row each."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int):
    import numpy as np

    power = np.full(n, BASE, dtype=np.uint64)
    power[0] = 1
    return np.cumprod(power, dtype=np.uint64)


def _lanes():
    import numpy as np

    return np.random.default_rng(8).integers(1 << 31, 1 << 32, 8, dtype=np.uint64) | np.uint64(1)


def _places(h, blocks: int):
    """(block, the low half for the lanes) of raw hashes."""
    import numpy as np

    h = _mix(h)
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), h & np.uint64(0xFFFFFFFF)


def _bit(low, lane):
    """The bit of a lane that a hash sets."""
    import numpy as np

    return (low * lane >> np.uint64(27) & np.uint64(31)).astype(np.uint32)


def _hit(h, table, lanes):
    """Indices of the raw hashes that a filter may hold; lanes are tested while hashes are left."""
    import numpy as np

    if table is None:
        return np.zeros(0, dtype=np.int64)
    left = np.arange(len(h))
    block, low = _places(h, len(table))
    for k, lane in enumerate(lanes):
        ok = table[block, k] >> _bit(low, lane) & np.uint32(1) > 0
        left, block, low = left[ok], block[ok], low[ok]
    return left


def _filters(words: DataFrame, sizes: dict[int, int]) -> dict:
    """Filters by length; ``words`` has ``word``, ``sizes`` the number of words of each length."""
    import numpy as np

    blocks = {n: -(-c // PER_BLOCK) for n, c in sizes.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[str]] = {}
            for w in b.column(0).to_pylist():
                by.setdefault(len(w), []).append(w)
            for n, ws in by.items():
                block, low = _places((_letters(ws) * _powers(n)).sum(axis=1, dtype=np.uint64), blocks[n])
                cols = [np.full(len(ws), n), block // SEGMENT, block, low.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["size", "segment", "block", "low"])

    def build(group: pa.Table) -> pa.Table:
        n, at = group["size"][0].as_py(), group["segment"][0].as_py()
        table = np.zeros((min(SEGMENT, blocks[n] - at * SEGMENT), 8), dtype=np.uint32)
        block, low = (group[c].to_numpy() for c in ("block", "low"))
        for k, lane in enumerate(_lanes()):
            np.bitwise_or.at(table, (block - at * SEGMENT, k), np.uint32(1) << _bit(low.astype(np.uint64), lane))
        return pa.table({"size": [n], "segment": [at], "bits": [table.tobytes()]})

    placed = words.select("word").mapInArrow(place, "size long, segment long, block long, low long")
    out = {n: np.zeros((c, 8), dtype=np.uint32) for n, c in blocks.items()}
    for r in placed.groupBy("size", "segment").applyInArrow(build, "size long, segment long, bits binary").toLocalIterator():
        part = np.frombuffer(r["bits"], dtype=np.uint32).reshape(-1, 8)
        out[r["size"]][r["segment"] * SEGMENT:][:len(part)] = part
    return out


def edits_of(words: list[str], alphabet, tables: dict) -> Iterator[tuple[str, str]]:
    """(word, edit) for the edits of words of one length that the filters ``tables`` may hold."""
    import numpy as np

    n, lanes, many = len(words[0]), _lanes(), len(alphabet)
    power, back = _powers(n), np.uint64(pow(BASE, -1, 1 << 64))
    span = max(1, min(n, AT_ONCE // max(many, 1)))  # positions at once
    rows = max(1, AT_ONCE // (span * max(many, 1)))
    for at in range(0, len(words), rows):
        some = words[at:at + rows]
        points = _letters(some)
        terms = points * power
        whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        if n > 1:
            without = ((upto - terms) + (whole - upto) * back).ravel()
            # Of equal letters in a row, only the first is taken out.
            once = np.flatnonzero(np.diff(points, axis=1, prepend=np.uint64(0)).ravel() != 0)
            for k in once[_hit(without[once], tables.get(n - 1), lanes)]:
                w, p = some[k // n], k % n
                yield w, w[:p] + w[p + 1:]
        for a in range(0, n, span):
            old = points[:, a:a + span, None]
            new = (whole[:, :, None] + (alphabet - old) * power[a:a + span, None]).ravel()
            larger = np.flatnonzero((alphabet > old).ravel())
            for k in larger[_hit(new[larger], tables.get(n), lanes)]:
                r, rest = divmod(int(k), old.shape[1] * many)
                p, w = a + rest // many, some[r]
                yield w, w[:p] + chr(alphabet[rest % many]) + w[p + 1:]


def near_pairs(words: DataFrame, filter_mb: float = FILTER_MB) -> DataFrame:
    """(``word``, ``n``, ``near``, ``near_n``), both ways, for a table of distinct ``word`` with ``n``."""
    import numpy as np

    spark = words.sparkSession
    sized = words.withColumn("size", F.length("word"))
    sizes = {r["size"]: r["c"] for r in sized.groupBy("size").agg(F.count("*").alias("c")).collect()}
    points = sized.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).distinct().collect()
    alphabet = np.array(sorted(ord(r["x"]) for r in points if r["x"]), dtype=np.uint64)
    parts = max(1, -(-sum(32 * -(-c // PER_BLOCK) for c in sizes.values()) // int(filter_mb * 2**20)))
    found = []
    for part in range(parts):
        mine = sized.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        own = sizes if parts == 1 else {r["size"]: r["c"] for r in mine.groupBy("size").agg(F.count("*").alias("c")).collect()}
        tables = spark.sparkContext.broadcast(_filters(mine, own))

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for b in batches:
                by: dict[int, list[str]] = {}
                count = dict(zip(*(c.to_pylist() for c in b.columns), strict=True))
                for w in count:
                    by.setdefault(len(w), []).append(w)
                for ws in by.values():
                    pairs = list(edits_of(ws, alphabet, tables.value))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w for w, _ in pairs], pa.string()), pa.array([count[w] for w, _ in pairs], pa.int64()),
                         pa.array([e for _, e in pairs], pa.string())], names=["word", "n", "near"])

        hits = words.select("word", "n").mapInArrow(run, "word string, n long, near string")
        found.append(hits.join(mine.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"))
    one = found[0]
    for more in found[1:]:
        one = one.unionByName(more)
    one = stored(one.select("word", "n", "near", "near_n"), "near")
    return one.unionByName(one.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots_of(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) by pointer doubling over (``word``, ``form``); a form occurs more often than its word."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        nxt = stored(now.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        now = nxt.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, drop_every: int | None = None, ratio: int = RATIO,
    filter_mb: float = FILTER_MB,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of the largest count (ties: the smallest) if that is ``ratio`` times the
    word's own or more, else null; ``root`` follows forms to their end.  Null and empty texts have no words;
    repeated rows count as often as they occur; an empty table gives no rows; other columns are not read.
    """
    words = stored(vocabulary(docs, id_col, text_col, drop_every=drop_every), "words")
    best = near_pairs(words, filter_mb).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    reach = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(reach, F.col("best.near")).alias("form"), F.when(reach, -F.col("best.less")).alias("form_n")), "forms")
    roots = roots_of(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
