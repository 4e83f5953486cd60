"""Spelling variants, lexical search and the Jaccard join against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import LONG, ODD, docs_of
from pyspark.sql import functions as F
from test_near_texts import plain_groups

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(rows, drop_every=31):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(A_Z)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows, drop_every=31, ratio=10):
    words = plain_vocabulary(rows, drop_every)
    forms, count = {}, {}
    for w, n in words.items():
        around = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        count[w] = len(around)
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, count[w], words.get(forms[w])))
    return sorted(out)


def variants(docs, **how):
    from speechspark.llm.spelling import spelling_variants

    got = spelling_variants(docs, drop_every=31, **how)
    return sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())


WORDY = [
    (1, " ".join(["neighbour"] * 200 + ["neighbor"] * 21 + ["nieghbour"] * 3 + ["neighbbor", "neighbor"] * 2)),
    (2, "Straßenbahn strassenbahn Straßenbähn straßenbahn " * 3), (3, "aaaaaaa aaaaaaaa aaaaaaaaa bbbbbbb aaaaaab " * 2),
    (None, "ÄÖÜßéèê äöüßéèê ÄÖÜßéèê"), (4, None), (5, ""), (6, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000 + " " + "x" * 4999),
    (6, "漢字neighbour漢字 neighbour's"), (6, "漢字neighbour漢字 neighbour's"), (7, LONG),
]


@pytest.mark.parametrize("filter_mb", [32, 0.0001])
def test_variants_of_odd_words(spark, filter_mb):
    docs = docs_of(spark, [(i, t, "a") for i, t in WORDY])
    assert variants(docs, filter_mb=filter_mb) == plain_variants(WORDY)


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert variants(docs) == plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_roots_follow_long_chains(spark):
    from speechspark.llm.spelling import roots_of

    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(19)], "word string, form string")
    assert {tuple(r) for r in roots_of(forms).collect()} == {(f"w{k}", "w19") for k in range(19)}


def test_filters_miss_no_edit(spark):
    """Every near pair of a crowded vocabulary is found, in one part or in several."""
    from speechspark.llm.spelling import near_pairs

    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 8))) for _ in range(600)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if a != b and near(a, b))
    for mb in (1, 0.0002):
        assert sorted((r["word"], r["near"]) for r in near_pairs(df, mb).collect()) == want


def plain_search(rows, items, top=50):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (t or "").translate(A_Z))
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    count, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, t in items:
        terms = sorted(set(words(t)))
        scores = []
        for i, c, n in docs:
            m = 50 + 50 * n * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **how):
    from speechspark.llm.lexical_search import search

    return sorted((tuple(r) for r in search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_of_odd_documents(spark, odd, none):
    items = [("a", "shared0 SHARED1 one two"), ("b", None), ("b", ""), ("c", "漢字 ünïcode Ünïcode"), (None, "a b c line"), ("c", "漢字 ünïcode Ünïcode"), ("z", "nowhere")]
    df = spark.createDataFrame(items, "item_id string, text string").withColumn("score", F.lit("clash"))
    rows = [(i, t) for i, t, _ in ODD]
    assert searched(odd, df) == plain_search(rows, items)
    assert searched(odd, df, top=2) == plain_search(rows, items, 2)
    assert searched(none, df) == searched(odd, df.limit(0)) == []


def test_search_across_shards_blocks_and_ties(spark, monkeypatch):
    """Small shards and blocks, many ties at the last rank, hot words."""
    from speechspark.llm import lexical_search

    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        n = int(rng.integers(1, 60))
        rows.append((i, " ".join(["hot"] * int(rng.integers(0, 4)) + [f"w{int(x)}" for x in rng.zipf(1.4, n) % 200])))
    rows += [(900 + i, "w3 w4 rare") for i in range(200)]
    items = [(k, " ".join(f"w{int(x)}" for x in rng.integers(0, 200, 12)) + " hot") for k in range(25)] + [(99, "rare hot")]
    want = plain_search(rows, items)
    df = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [(i, t, "a") for i, t in rows]).repartition(6)
    assert searched(docs, df) == want
    monkeypatch.setattr(lexical_search, "QUERIES", 10)
    assert searched(docs, df) == want


def test_blocks_are_skipped_only_below_the_need():
    """Any need gives the documents that reach it, and a high one reads few blocks."""
    from speechspark.llm.lexical_search import Shard

    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 30, 700)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(rng.choice(80, s, replace=False)) for s in sizes]).astype(np.int64)
    impacts = rng.integers(0, 1000, len(terms))
    full = np.zeros((700, 80), dtype=np.int64)
    full[np.repeat(np.arange(700), sizes), terms] = impacts
    shard = Shard(starts, terms, impacts, 80)
    for _ in range(40):
        query = rng.choice(80, 9, replace=False)
        score = full[:, query].sum(axis=1)
        for need in (1, 500, 2000, int(score.max()), int(score.max()) + 1):
            docs, got = shard.search(query, need)
            assert dict(zip(docs.tolist(), got.tolist(), strict=True)) == {d: s for d, s in enumerate(score.tolist()) if s >= need}


def test_a_shard_keeps_few_summaries(monkeypatch):
    """Many queries over long lists: the blocks that are held stay bounded, and results are the same."""
    from speechspark.llm import lexical_search

    rng = np.random.default_rng(5)
    starts = np.arange(0, 600 * 20 + 1, 20)
    terms = np.concatenate([np.sort(rng.choice(60, 20, replace=False)) for _ in range(600)]).astype(np.int64)
    impacts = rng.integers(1, 1000, len(terms))
    queries = [rng.choice(60, 8, replace=False) for _ in range(30)]
    whole = lexical_search.Shard(starts, terms, impacts, 60)
    want = [whole.search(q, 3000) for q in queries]
    monkeypatch.setattr(lexical_search, "KEPT", 3000, raising=False)
    shard = lexical_search.Shard(starts, terms, impacts, 60)
    for q, (docs, score) in zip(queries, want, strict=True):
        got = shard.search(q, 3000)
        assert got[0].tolist() == docs.tolist() and got[1].tolist() == score.tolist()
        assert sum(len(b[4]) for b in shard.blocks.values()) <= 3000
    assert lexical_search.SHARD <= 2048


def joined(docs, **how):
    from speechspark.llm.jaccard_join import jaccard_components

    return jaccard_components(docs, **how).collect()


@pytest.mark.parametrize("boundary", [None, 0, 12, 1000])
def test_join_of_documents_with_any_boundary(spark, boundary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("length(text) < 9000").collect()]
    got = {r["doc_id"]: r["component_id"] for r in joined(docs.filter("length(text) < 9000"), boundary=boundary)}
    assert got == plain_groups(rows)


def crowd(rng, base, n, size, edits):
    out = []
    for _ in range(n):
        w = [f"{base}{k}" for k in range(size)]
        for at in rng.choice(size, rng.integers(0, edits + 1), replace=False):
            w[at] = f"x{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("boundary", [0, 60, 1000])
def test_join_of_crowds_around_the_limit(spark, boundary):
    rng = np.random.default_rng(6)
    texts = crowd(rng, "p", 120, 100, 6) + crowd(rng, "q", 60, 30, 2) + crowd(rng, "r", 60, 12, 1)
    chain = [f"c{k}" for k in range(60)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + [f"d{k}e{j}" for j in range(3)]
    texts += ["One two", "one  two", "one three", "a b c d e", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i j"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in joined(docs_of(spark, [(i, t, "a") for i, t in rows]), boundary=boundary)}
    assert got == plain_groups(rows)


def test_join_of_a_crowd_takes_few_comparisons(spark, monkeypatch):
    """Near copies around the limit are settled by some comparisons each, not by 180 000 pairs."""
    from speechspark.llm import crowds

    rng = np.random.default_rng(7)
    texts = [" ".join(f"p{k}" for k in range(120)), *crowd(rng, "p", 600, 120, 3)]
    seen = []
    plain = crowds.link_buckets

    def counting(met, extra, may, verify, *rest):
        return plain(met, extra, may, lambda pairs: (seen.append(pairs.count()), verify(pairs))[1], *rest)

    monkeypatch.setattr("speechspark.llm.jaccard_join.link_buckets", counting)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in joined(docs_of(spark, [(i, t, "a") for i, t in rows]))}
    assert got == plain_groups(rows)
    assert sum(seen) < 2 * len(texts)


def test_join_of_odd_documents(spark, odd, none):
    rows = [tuple(r) for r in joined(odd)]
    of = {}
    for i, n, c in rows:
        of.setdefault(i, set()).add((n, c))
    assert len(rows) == len(ODD) and joined(none) == []
    assert of[1] == {(0, 1)} and of[2] == {(0, 2)} and of[3] == {(0, 3)} and of[7] == of[8] - {(39_997, 7)} | {(39_996, 7)}
    assert of[6] == {(2, 6)} and of[14] == {(1, 14)} and of[None] == {(0, None), (1, None)}


def test_sets_that_share_a_hash_stay_apart(spark):
    from speechspark.llm.jaccard_join import distinct_sets

    rows = spark.createDataFrame([(1, 5, 7, 70, 3), (2, 6, 7, 71, 3), (3, 5, 7, 70, 3), (4, 8, 9, 1, 2)], "i long, c long, f long, g long, n long")
    got = {(r["f"], r["g"]): (r["v"], r["least"]) for r in distinct_sets(rows).collect()}
    assert got[7, 70] == (7, 1) and got[9, 1] == (9, 4) and got[7, 71][0] != 7 and len(got) == 3
