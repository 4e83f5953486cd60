"""The near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import numpy as np
from conftest_llm import docs_of

SF = "/root/testdata/sf0.001"


def plain_groups(rows, shingle=5):
    """rows: (id, text) of distinct ids; id -> least id reachable through pairs at 0.8 or above."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + shingle]) for k in range(max(len(w) - shingle, 0) + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_stage_on_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, root in plain_groups(rows).items() if i == root}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
    assert 1 in want and 177 not in want  # 0.83 of the shingles, eleven bits apart


def test_stage_on_a_crowd_around_the_limit(spark):
    """Edited copies of a few texts, some below and some above 0.8, a chain, and short texts."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    rows = []
    for base in range(4):
        text = [f"b{base}w{k}" for k in range(120)]
        for _ in range(60):
            w = list(text)
            for at in rng.choice(120, rng.integers(0, 7), replace=False):
                w[at] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        rows.append((len(rows), " ".join(chain)))
        chain = chain[5:] + [f"d{k}e{j}" for j in range(5)]
    rows += [(len(rows) + k, t) for k, t in enumerate(["One two", "one  two", "one three", "", " ", "a b c d e", "a b c d e f g"])]
    docs = docs_of(spark, [(i, t, "a") for i, t in rows])
    want = plain_groups(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {i for i in want if want[i] == i}


def test_stage_links_by_fingerprints_too(spark):
    """Texts of one fingerprint go although their shingle sets are unlike: most of both is one repeated passage."""
    import corpus_pipeline
    from speechspark.llm.simhash import fingerprint

    passage = " ".join([f"p{k}" for k in range(11)] * 50)
    texts = [f"{passage} " + " ".join(f"{tail}{k}" for k in range(10)) for tail in "xyz"]
    rows = [(3, texts[0]), (1, texts[1]), (None, texts[2]), (2, "another text of its own"), (3, texts[0])]
    assert len({fingerprint(t) for t in texts}) == 1 and len(set(plain_groups(list(enumerate(texts))).values())) == 3
    docs = docs_of(spark, [(i, t, "a") for i, t in rows])
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [(1, texts[1]), (2, rows[3][1])]


def test_few_links_stay_in_few_tasks(spark, monkeypatch):
    """However many shuffle partitions there are, a round over few links doesn't write files for each."""
    from speechspark.llm import simhash

    parts = []

    def seen(df, real=simhash.checkpointed):
        out = real(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(simhash, "checkpointed", seen)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rng = np.random.default_rng(6)
        chain = [int(x) for x in rng.permutation(200)]
        edges = [tuple(sorted(p)) for p in zip(chain, chain[1:], strict=False)] + [(1000, 1001)]
        got = {r["v"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {v: got.get(v, v) for v in [*range(200), 1000, 1001]} == {v: 0 for v in range(200)} | {1000: 1000, 1001: 1000}
    assert len(parts) > 2 and max(parts) <= spark.sparkContext.defaultParallelism
