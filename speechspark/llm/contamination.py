"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Normalising lower-cases A-Z and takes runs of ASCII letters, digits and all characters beyond ASCII as
words.  Each window of ``window`` consecutive item words (a shorter item whole) is a pattern framed by
blanks.  A text is normalised and scanned once; matches are mapped to words and to offsets of the
original.  The patterns are broadcast; their size is checked, and a larger set is cut into several
automata of at most that size, through which the texts pass one after the other.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
MAX_PATTERN_MB = 32
#: ASCII bytes that part words become blanks, A-Z become a-z; bytes of longer characters stay.
_TABLE = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _patterns(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items, found = [], []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = normal_words(text)
            for k in range(max(len(w) - window, 0) + 1 if w else 0):
                items.append(item)
                found.append((b" ".join([b"", *w[k:k + window], b""])).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], names=["p", "item"])


_BUILT: dict[int, object] = {}


def _automaton(sent):
    """The automaton of a broadcast pattern list; built once per Python worker."""
    import ahocorasick

    if sent.id not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for k, (pattern, _) in enumerate(sent.value):
            a.add_word(pattern, k)
        a.make_automaton()
        _BUILT[sent.id] = a
    return _BUILT[sent.id]


class _Sent:
    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _scan(text: str | None, automaton, patterns):
    """(number of words, matched word spans, items) of one text."""
    words = normal_words(text)
    line = (b" ".join([b"", *words, b""])).decode("utf-8", "surrogatepass")
    hits = list(automaton.iter(line)) if words else []
    if not hits:
        return len(words), [], []
    ends, at = {}, 0
    for k, w in enumerate(words):
        at += len(w.decode("utf-8", "surrogatepass")) + 1
        ends[at] = k + 1
    spans, items = set(), set()
    for end, k in hits:
        pattern, owners = patterns[k]
        spans.add((ends[end] - (pattern.count(" ") - 1), ends[end]))
        items.update(owners)
    return len(words), sorted(spans), sorted(items)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of merged word spans."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
RESULTS = ["n_words", "n_hit", "item_ids", "spans", "contaminated"]


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *,
    window: int = WINDOW, max_pattern_mb: float = MAX_PATTERN_MB,
) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_hit``, ``item_ids``, ``spans``, ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a pattern, ``item_ids`` are the sorted ids (as
    strings) of the items with an occurring pattern, ``spans`` the merged hits as code-point offsets in
    the original text.  Null and empty texts have no words and no hits; an item without words has no
    pattern; a null item id is reported as an empty string; equal items are all reported; repeated
    documents each get a row.  Input columns named like a result are replaced.  An empty item table
    leaves every text clean.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("t"))
    found = source.mapInArrow(lambda x: _patterns(x, window), "p string, item string")
    found = found.groupBy("p").agg(F.sort_array(F.collect_set("item")).alias("owners"))
    # Test sets are small beside a corpus; they pass through the driver in lists of checked size.
    lists, size = [[]], 0
    for row in found.toLocalIterator():
        size += len(row["p"]) + sum(map(len, row["owners"]))
        if size > max_pattern_mb * 2**20:
            lists.append([])
            size = len(row["p"]) + sum(map(len, row["owners"]))
        lists[-1].append((row["p"], list(row["owners"])))
    extra = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ])
    width = len(docs.columns)
    last = T.StructType([
        *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())), extra["spans"], T.StructField("contaminated", T.BooleanType()),
    ])
    out = docs
    for k, part in enumerate(lists):
        first, final = k == 0, k == len(lists) - 1
        sent = _Sent(spark.sparkContext.broadcast(part), uuid.uuid4().int)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first, final=final) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent) if sent.value else None
            for b in batches:
                n, hit, ids, spans = [], [], [], []
                for row in range(b.num_rows):
                    text = b.column(at)[row].as_py()
                    w, s, i = _scan(text, automaton, sent.value) if automaton else (len(normal_words(text)), [], [])
                    if not first:
                        i = sorted({*i, *b.column(width + 1)[row].as_py()})
                        s = [*s, *((x["start"], x["stop"]) for x in b.column(width + 2)[row].as_py())]
                    if final:
                        s = _merged(s)
                        hit.append(sum(y - x for x, y in s))
                        s = original_offsets(text, s) if s else s
                    n.append(w)
                    ids.append(i)
                    spans.append([{"start": x, "stop": y} for x, y in s])
                counts = [pa.array(n, pa.int64())] + ([pa.array(hit, pa.int64())] if final else [])
                cols = [*counts, pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))]
                cols += [pa.array([x > 0 for x in hit], pa.bool_())] if final else []
                names = RESULTS if final else ["n_words", "item_ids", "spans"]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *cols], names=[*b.schema.names[:width], *names])

        out = out.mapInArrow(run, last if final else T.StructType([*docs.schema.fields, *extra.fields]))
    return out
