"""Operator 6 on texts whose hashes of an additive kind collide."""

import numpy as np
from conftest_llm import docs_of

from speechspark.llm import substrings



def thue_morse(n, a, b):
    return [b if k.bit_count() % 2 else a for k in range(n)]


def test_words_of_regular_letters_are_told_apart(spark):
    """Equal 34 words and then two different long words: no run of 35 words repeats."""
    lead = " ".join(f"w{i}" for i in range(34))
    one, two = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    docs = docs_of(spark, [(1, f"{lead} {one}", "a"), (2, f"{lead} {two}", "a"), (3, f"{lead} {one} end", "b"), (4, f"{two} x", "b")])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (35, 35, ""), 2: (35, 0, f"{lead} {two}"), 3: (36, 35, "end"), 4: (2, 0, f"{two} x")}


def test_runs_in_regular_order_are_told_apart(spark):
    """Runs of 2 048 words from two words, whose sums of products agree whatever the base."""
    one, two = thue_morse(2048, "ab", "cd"), thue_morse(2048, "cd", "ab")
    a, b = (substrings.word_digests(" ".join(x).encode()) for x in (one, two))
    assert substrings.window_hashes(a[0], 2048).tolist() == substrings.window_hashes(b[0], 2048).tolist()
    start = np.zeros(1, dtype=np.int64)
    assert substrings.run_checks(a[1], start, 2048) != substrings.run_checks(b[1], start, 2048)
    docs = docs_of(spark, [(1, " ".join(one), "a"), (2, " ".join(two), "a")])
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs, window=2048, block=18).collect()}
    assert got == {1: 0, 2: 0}


def test_lists_of_equal_first_hashes():
    """Lists tell entries apart by both hashes, across batches and within one."""
    h = np.array([9, 5, 5, 5, 2**63, 5], dtype=np.uint64)
    c = np.array([1, 7, 8, 7, 3, 2], dtype=np.uint32)
    other = substrings._parcels(1, np.array([5, 9, 2**63], dtype=np.uint64), np.ones(3, dtype=bool), 64, 1, np.array([2, 2, 3], dtype=np.uint32))
    both = substrings.pa.concat_tables([substrings._parcels(0, h, np.ones(6, dtype=bool), 64, 1, c), other])
    met = {batch: sorted(zip(v[f].tolist(), x[f].tolist(), strict=True)) for batch, v, x, f in substrings._met(both)}
    assert met == {0: [(5, 2), (5, 7), (2**63, 3)], 1: [(5, 2), (2**63, 3)]}
    known = sorted(met[0])
    seconds = np.array([x for _, x in known], dtype=np.uint32)
    found = substrings._known(h, lambda some: c[some], np.array([v for v, _ in known], dtype=np.uint64), seconds)
    assert found.tolist() == [False, True, False, True, True, True]


def test_digests_are_forgotten_and_found_again():
    words = [f"x{k % 90_000}" for k in range(200_000)]
    known = substrings._Digests()
    first, second = substrings.word_digests(" ".join(words).encode(), known)
    assert len(known) <= substrings._KNOWN and len(first) == len(second) == 200_000
    assert first[:20_000].tolist() == first[90_000:110_000].tolist() and len(set(first.tolist())) == len(set(second.tolist())) == 90_000
