"""Ranked lexical search over posting lists that are blocked by document similarity.

Documents become integer impact vectors over the terms of the queries.  A task takes shards of up to
``SHARD`` documents.  In a shard, a posting list that a query has to read is clustered once: documents are
projected to ``DIMS`` numbers, every ``BLOCK``-th one is a pivot, and each joins the pivot of the largest
inner product.  A block keeps, for every term, the largest impact among its documents.  A query adds the
summary's entries of its own terms; the block is skipped only if that exact bound is below the score that
the query's result needs.  Whole lists are skipped in the same way: as long as the largest impacts of the
weakest terms together stay below that score, a document needs one of the other terms.

The needed score comes from a first search over one document in ``SEED_EVERY`` (by hash): the rank that is
asked for there is a lower bound of the one among all.  So only documents that may be results leave a task,
whatever the number of shards.  Scores are 64-bit integers; results do not depend on shards or blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechspark.llm.common import stored

TOP = 50
SHARD = 2048
BLOCK = 32
DIMS = 16
SEED_EVERY = 16
#: Summary entries of blocks that a shard keeps at once (16 bytes each); more are made anew when they are asked for.
KEPT = 1 << 23
#: Queries that are searched in one pass over the vectors.
QUERIES = 4096


def table_of_bytes() -> bytes:
    """A-Z lower-cased, digits, letters and bytes above ASCII kept, all others a blank."""
    keep = re.compile(rb"[0-9a-z\x80-\xff]")
    return bytes(b if keep.match(bytes([b])) else 32 for b in bytes(range(256)).lower())


def terms_of(text: str | None, table: bytes = table_of_bytes()) -> list[bytes]:
    """The terms of a text in their order, with repeats, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(table).split()


def vectors(docs: DataFrame, id_col: str, text_col: str, terms: dict[bytes, int]) -> DataFrame:
    """(``i``, ``key``, ``n_terms``, ``terms``, ``tfs``): counts of the given terms in every whole text."""
    kept = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number = kept.value.get
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sizes, ids, counts = [], [], []
                for x in part.column(2):
                    found = terms_of(x.as_py())
                    sizes.append(len(found))
                    t, c = np.unique(np.fromiter((number(w, -1) for w in found), dtype=np.int32, count=len(found)), return_counts=True)
                    ids.append(t[t >= 0])
                    counts.append(c[t >= 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["i", "key", "n_terms", "terms", "tfs"])

    src = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(run, f"i {kind}, key long, n_terms long, terms array<int>, tfs array<long>")


class Shard:
    """Impact vectors of a bounded number of documents and the blocks of the lists that were read."""

    def __init__(self, starts, terms, impacts, n_terms: int):
        import numpy as np

        self.starts, self.terms, self.impacts = starts, terms, impacts
        self.doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        by = np.lexsort((self.doc, terms))
        self.list_docs, ends = self.doc[by], np.searchsorted(terms[by], np.arange(n_terms + 1))
        self.list_at = ends
        most = np.zeros(n_terms, dtype=np.int64)
        np.maximum.at(most, terms, impacts)
        self.most = most
        direction = np.random.default_rng(5).standard_normal((n_terms, DIMS))
        self.placed = np.zeros((len(starts) - 1, DIMS))
        for d in range(DIMS):
            self.placed[:, d] = np.bincount(self.doc, weights=impacts * direction[terms, d], minlength=len(starts) - 1)
        length = np.linalg.norm(self.placed, axis=1, keepdims=True)
        self.placed /= np.where(length > 0, length, 1)
        self.blocks: dict[int, tuple] = {}
        self.kept = 0
        self.row = np.zeros(n_terms, dtype=np.int64)

    def entries(self, docs):
        """(position in ``docs``, index into terms and impacts) of all entries of some documents."""
        import numpy as np

        sizes = self.starts[docs + 1] - self.starts[docs]
        where = np.repeat(np.arange(len(docs)), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return where, self.starts[docs][where] + inside

    def blocked(self, term: int):
        """(documents by block, ends of the blocks, block of each summary entry, its term, its maximum)."""
        import numpy as np

        if term not in self.blocks:
            docs = self.list_docs[self.list_at[term]:self.list_at[term + 1]]
            pivots = self.placed[docs[::BLOCK]]
            block = np.concatenate([
                np.argmax(self.placed[docs[at:at + 1024]] @ pivots.T, axis=1) for at in range(0, len(docs), 1024)])
            by = np.argsort(block, kind="stable")
            docs, block = docs[by], np.unique(block[by], return_inverse=True)[1]
            where, entry = self.entries(docs)
            key = block[where].astype(np.int64) * len(self.most) + self.terms[entry]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
            top = np.maximum.reduceat(self.impacts[entry][order], first)
            key = key[order][first]
            if self.kept + len(key) > KEPT:
                self.blocks.clear()
                self.kept = 0
            self.kept += len(key)
            self.blocks[term] = (docs, np.searchsorted(block, np.arange(block[-1] + 2)), (key // len(self.most)).astype(np.int32),
                                 (key % len(self.most)).astype(np.int32), top)
        return self.blocks[term]

    def search(self, query, need: int):
        """(documents, scores) of all that reach ``need``; ``query`` has the numbers of its terms."""
        import numpy as np

        query = query[self.most[query] > 0]
        query = query[np.argsort(self.most[query], kind="stable")]
        weak = int(np.searchsorted(np.cumsum(self.most[query]), need))  # these alone stay below the need
        self.row[query] = 1
        found = []
        for term in query[weak:]:
            docs, ends, block, at, top = self.blocked(int(term))
            bound = np.bincount(block, weights=top * self.row[at], minlength=len(ends) - 1)
            for b in np.flatnonzero(bound >= need):
                found.append(docs[ends[b]:ends[b + 1]])
        docs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        where, entry = self.entries(docs)
        score = np.zeros(len(docs), dtype=np.int64)
        np.add.at(score, where, self.impacts[entry] * self.row[self.terms[entry]])
        self.row[query] = 0
        return docs[score >= need], score[score >= need]


def impacts_of(terms, tfs, n_terms, weights, n_docs: int, all_terms: int):
    """Integer shares of the terms in a score; the arrays have one element per entry, ``weights`` one per term."""
    m = 50 + (50 * n_terms * n_docs) // max(all_terms, 1)
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


def _flat(column):
    """(offsets, values) of a list column or a slice of it."""
    import numpy as np

    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.int64)


def _searched(docs: DataFrame, queries: list, needs: list, weights, n_docs: int, all_terms: int, top: int) -> DataFrame:
    """(``q``, ``i``, ``key``, ``score``) of all vectors that may be among a query's best."""
    asked = docs.sparkSession.sparkContext.broadcast((queries, needs, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        qs, need, weight = asked.value
        need = list(need)
        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                part = b.slice(at, SHARD)
                (starts, terms), (_, tfs) = _flat(part.column(3)), _flat(part.column(4))
                n = np.repeat(part.column(2).to_numpy(), np.diff(starts))
                shard = Shard(starts, terms, impacts_of(terms, tfs, n, weight, n_docs, all_terms), len(weight))
                rows: list[list] = [[], [], []]
                for q, query in enumerate(qs):
                    docs, score = shard.search(query, need[q])
                    if len(docs) > top:
                        # Documents that tie with the last one stay: ids decide later.
                        last = np.partition(score, len(score) - top)[len(score) - top]
                        docs, score = docs[score >= last], score[score >= last]
                        need[q] = max(need[q], int(last))
                    for c, v in zip(rows, (np.full(len(docs), q), docs, score), strict=True):
                        c.append(v)
                q, docs, score = (np.concatenate(c).astype(np.int64) for c in rows)
                take = pa.array(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.astype(np.int32)), part.column(0).take(take), part.column(1).take(take), pa.array(score)],
                    names=["q", "i", "key", "score"])

    kind = docs.schema["i"].dataType.simpleString()
    return docs.select("i", "key", "n_terms", "terms", "tfs").mapInArrow(run, f"q int, i {kind}, key long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("i"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_all(docs: DataFrame, texts: list[str | None], id_col: str, text_col: str, top: int) -> DataFrame:
    """(``q``, ``rank``, ``i``, ``score``) for the positions of some queries."""
    import math

    import numpy as np

    lists = [sorted(set(terms_of(t))) for t in texts]
    number = {w: k for k, w in enumerate(sorted(set().union(*lists)))}
    queries = [np.array([number[w] for w in ws], dtype=np.int64) for ws in lists]
    rows = stored(vectors(docs, id_col, text_col, number), "vectors")
    n_docs, all_terms = rows.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.zeros(len(number), dtype=np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the queries
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    some = rows.filter(F.pmod(F.xxhash64("i", "key"), F.lit(SEED_EVERY)) == 0)
    seen = _ranked(_searched(some, queries, [1] * len(queries), weights, n_docs, all_terms, top), top)
    needs = [1] * len(queries)
    for r in seen.filter(F.col("rank") == top).select("q", "score").collect():  # one row per query
        needs[r["q"]] = r["score"]
    return _ranked(_searched(rows, queries, needs, weights, n_docs, all_terms, top), top).select("q", "rank", "i", "score")


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", top: int = TOP,
) -> DataFrame:
    """The ``top`` best documents of each item: ``item_col``, ``rank`` from 1, ``id_col``, ``score`` (above 0).

    Equal scores go by ascending id (null ids last, then by a hash of the text).  Null and empty texts have
    no terms: such documents are not counted and never found, such items find nothing.  Repeated rows of
    documents are documents, repeated rows of items are items of their own.  Other columns are not read.
    Items pass through the driver, ``QUERIES`` at a time; documents never do.
    """
    spark = docs.sparkSession
    rows = [(r[0], r[1]) for r in items.select(item_col, item_text).toLocalIterator()]
    out = None
    for at in range(0, max(len(rows), 1), QUERIES):
        some = rows[at:at + QUERIES]
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(some)], f"q int, item {items.schema[item_col].dataType.simpleString()}")
        found = _search_all(docs, [t for _, t in some], id_col, text_col, top).join(F.broadcast(names), "q").select(
            F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("i").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out
