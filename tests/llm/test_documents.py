"""Operators on documents against plain definitions, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
import xxhash
from conftest_llm import ODD, docs_of

from speechspark.llm import contamination, mixing, quality, simhash, substrings, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 3: SimHash


def plain_print(text, k=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints):
    """prints: id -> fingerprint; id -> least id reachable."""
    ids = list(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2)
        for b in near:
            root[max(find(a), find(int(b)))] = min(find(a), find(int(b)))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("prime", [2, 3])
def test_every_close_pair_shares_a_mask(prime):
    masks = simhash.masks(2, prime)
    assert len(masks) == (prime**3 - 1) // (prime - 1)
    for a in range(64):
        for b in range(a, 64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in masks)


def test_fingerprints_follow_the_definition():
    for _, text, _ in ODD:
        assert simhash.fingerprint(text) == plain_print(text)


def test_components_of_a_crowd(spark):
    """Hundreds of fingerprints in one ball, chains across it, and strangers."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    values = {centre}
    for _ in range(300):
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    chain = int(rng.integers(1 << 62))
    for k in range(0, 40, 2):
        chain ^= 3 << k
        values.add(chain)
    values |= {int(x) for x in rng.integers(1 << 62, size=200)} | {0, 1, 3, 7}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "f long"))
    assert edges.filter("bit_count(a ^ b) > 2").count() == 0
    roots = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    back = {s: v for (s,), v in zip(signed, values)}
    want = plain_components({v: v for v in values})
    groups, mine = defaultdict(set), defaultdict(set)
    for s, v in back.items():
        groups[want[v]].add(v)
        mine[roots.get(s, s)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("wide", [1 << 31, 0])
def test_near_duplicates_of_documents(spark, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE_MASKS", wide)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs.collect()}
    want = plain_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(prints)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_near_duplicates_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    assert simhash.near_duplicates(none).count() == 0


# --- 4: quality


def plain_counts(text):
    w = WORD.findall(text or "")
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i:i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_of_odd_rows(odd, none):
    got = quality.quality_rules(odd)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = []
    for i, t, _ in ODD:
        n = plain_counts(t)
        want.append((i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted_rows(got.select("doc_id", *cols)) == sorted(want, key=repr)
    assert quality.quality_rules(none).count() == 0


def test_frequent_lines_and_depleted_documents(spark):
    body = lambda i, n: " ".join(f"own{i}w{k}" for k in range(n))
    line = " ".join(f"common{k}" for k in range(40))
    rows = [(i, f"{line}\n{body(i, 60)}", "hot") for i in range(50)]
    rows += [(100 + i, f"{line}\n {line.upper()}\t\n{body(i, 20)}", "hot") for i in range(5)]  # depleted
    rows += [(200 + i, body(7, 80), "copies") for i in range(90)]  # copies of one text aren't a common line
    rows += [(300 + i, f"{line}\n{body(i, 60)}", "cold") for i in range(20)]  # below the limit of this host
    rows += [(400, f"{line}\n{body(1, 70)}", "hot")] * 2
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of(spark, rows)).collect()}
    for i in range(50):
        assert got[i]["kept"] and got[i]["n_removed_words"] == 40
    for i in range(100, 105):
        assert not got[i]["kept"] and not got[i]["base_failed"] and got[i]["n_removed_words"] == 80
    assert all(got[200 + i]["kept"] and got[200 + i]["n_removed_words"] == 0 for i in range(90))
    assert all(got[300 + i]["n_removed_words"] == 0 for i in range(20))
    assert got[400]["n_removed_words"] == 40 and got[400]["kept"]
    text = {r["doc_id"]: r["kept_text"] for r in quality.without_frequent_lines(docs_of(spark, rows)).collect()}
    assert text[0] == body(0, 60) and text[300] == rows[145][1]


# --- 6: substrings


def plain_repeats(texts, window):
    where = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = {i + k for i in range(len(w) - window + 1) if where[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_repeats_of_odd_rows(odd, none):
    words = [WORD.findall(t or "") for _, t, _ in ODD]
    kept = plain_repeats(words, 35)
    want = sorted([(i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest(), " ".join(k))
                   for (i, _, _), w, k in zip(ODD, words, kept)], key=repr)
    got = substrings.remove_repeats(odd, batch_mb=0.2)
    assert sorted_rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) == want
    assert set(got.columns) == set(odd.columns) | {"n_removed", "kept_sha256"}
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(40):
        w = [f"v{x}" for x in rng.integers(0, 50, rng.integers(0, 60))]
        if texts and rng.random() < 0.7:
            other = texts[rng.integers(len(texts))]
            a = int(rng.integers(0, len(other) + 1))
            piece = other[a:a + int(rng.integers(1, 14))]
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + piece + w[at:]
        texts.append(w)
    docs = docs_of(spark, [(i, " ".join(w), "a") for i, w in enumerate(texts)])
    got = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(docs, window=9, block=5, batch_mb=0.001).collect()}
    assert got == {i: " ".join(k) for i, k in enumerate(plain_repeats(texts, 9))}


def test_packed_lists_come_back():
    for values in ([], [5], [1, 2, 2**40, 2**63 + 9], list(range(0, 10**6, 7))):
        a = np.array(values, dtype=np.uint64)
        assert substrings._unpacked(substrings._packed(a))[:len(a)].tolist() == values


def test_word_hashes_do_not_depend_on_place():
    a = substrings.word_hashes(b"one two  three\n" + b"y" * 3_000_000 + b" one " + b"y" * 3_000_000)
    assert len(a) == 6 and a[0] == a[4] and a[3] == a[5] and len(set(a.tolist())) == 4


# --- 7: contamination


def plain_hits(text, items, window):
    norm = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        x = norm(t)
        for k in range(max(len(x) - window, 0) + 1 if x else 0):
            g = x[k:k + window]
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "What is the capital of the large country in the north of it?"), (2, "short item"), (10, "SHORT-item!"),
         (3, None), (4, "?!"), (None, "漢字 ünï"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l")]
TEXTS = [
    (1, "So: what is THE capital, of the large country in the north? nothing"), (2, "a short  item here; short item"), (3, None), (4, ""),
    (5, "x a b c d e f g h i j k l a b c d e f g h i"), (6, "clean words only shorti tem"), (6, "a short item"), (None, "漢字 ÜNÏ 漢字 ünï"),
]


@pytest.mark.parametrize("mb", [32, 0.0001])
def test_contamination(spark, mb):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("p", __import__("pyspark").sql.functions.lit(1))
    docs = docs_of(spark, [(i, t, "s") for i, t in TEXTS])
    got = contamination.find_contamination(docs, items, max_pattern_mb=mb).collect()
    want = sorted([(i, *plain_hits(t, ITEMS, 10)) for i, t in TEXTS], key=repr)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got], key=repr) == want
    for r in got:
        assert r["contaminated"] == (r["n_hit"] > 0)
        words = sum(len(contamination.normal_words(r["text"][a:b])) for a, b in r["spans"])
        assert words == r["n_hit"]
        for a, b in r["spans"]:
            assert r["text"][a].isalnum() and r["text"][b - 1].isalnum()


def test_contamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination.find_contamination(odd, items)
    assert got.count() == len(ODD) and contamination.find_contamination(none, items).count() == 0
    assert contamination.find_contamination(odd, items.limit(0)).filter("contaminated").count() == 0


# --- 9: token counts


def plain_tokens(word, pieces, worst):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * worst, -(best[end - 1][1] + n))]
        options += [(best[b][0] + pieces[word[b:end]], -(best[b][1] + 1)) for b in range(end) if word[b:end] in pieces]
        s, c = max(options)
        best.append((s, -c))
    return best[-1][1]


def test_token_counts_match_a_plain_search(spark, odd, none):
    pieces = token_counts.load_pieces()
    worst = min(pieces.values()) - 1.0
    memo = {}

    def tokens(text):
        w = (text or "").encode().split()
        return len(w), sum(memo.setdefault(x, None) or memo.update({x: plain_tokens("▁" + x.decode(), pieces, worst)}) or memo[x] for x in w)

    small = [r for r in ODD if r[1] is None or len(r[1]) < 10_000]
    docs = docs_of(spark, small)
    assert sorted_rows(token_counts.count_tokens(docs)) == sorted([(i, *tokens(t)) for i, t, _ in small], key=repr)
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    want = sorted([(r["doc_id"], *tokens(r["text"])) for r in table.collect()], key=repr)
    assert sorted_rows(token_counts.count_tokens(table, store=500)) == want
    assert token_counts.count_tokens(odd).count() == len(ODD) and token_counts.count_tokens(none).count() == 0


def test_shared_prefixes_are_computed_once():
    f = token_counts.Forward({"a": -1.0, "ab": -1.5, "abc": -1.6, "b": -2.0})
    assert f.counts(["abcx", "abc", "abcy", "b"]) == {"abc": 1, "abcx": 2, "abcy": 2, "b": 1}
    assert f.steps == 3 + 1 + 1 + 1


# --- 10: mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 500, 490], [5, 2, 1])  # the first is held at 30, the rest shared 2 : 1
    assert got[0] == 30 and abs(got[1] - 970 * 2 / 3) < 1e-9 and abs(sum(got) - 1000) < 1e-9
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_split_quotas_are_exact_and_repeat():
    a = mixing.split_quotas([1000, 30, 0, 7], 6)
    assert [sum(x) for x in zip(*a)] == [1000, 30, 0, 7] and a == mixing.split_quotas([1000, 30, 0, 7], 6)
    assert max(map(sum, a)) - min(map(sum, a)) <= 2


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    amounts = mixing.mix_amounts(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in amounts:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["size"] == 0 or r["taken"] % max(r["size"], 1) == 0
    names = sorted(by)
    goal = mixing.targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    for s, g in zip(names, goal):
        assert {r["target"] for r in by[s]} == {g}
        assert abs(sum(r["taken"] for r in by[s]) - g) <= 0.01 * g
    mixed = mixing.mix(docs)
    rows = mixed.selectExpr("doc_id", "mix_copy", "mix_shard", "mix_order")
    once = sorted_rows(rows)
    assert once == sorted_rows(mixing.mix(docs.repartition(7)).selectExpr("doc_id", "mix_copy", "mix_shard", "mix_order"))
    assert len({(d, c) for d, c, _, _ in once}) == len(once)
    copies = Counter(d for d, *_ in once)
    assert all(r["taken"] == r["size"] * copies[r["doc_id"]] for r in amounts)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix_amounts(odd)
    assert got.count() == len(ODD) and mixing.mix_amounts(none).count() == 0
    assert got.filter("size = 0 and taken <> 0").count() == 0
    assert mixing.mix(none).count() == 0 and set(mixing.mix(odd).columns) == set(odd.columns) | {"mix_shard", "mix_order"}


# --- the registered queries with SQL


def test_queries_against_sql(spark):
    from speechspark.llm.oracle import ORACLE
    from speechspark.llm.queries import REGISTRY

    con = compare.connect(SF)
    for name, sql in ORACLE.items():
        assert compare.differences(REGISTRY[name](spark, SF), con, sql) == [], name
