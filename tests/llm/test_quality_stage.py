"""The quality stage against a plain version with the line rule."""

from collections import Counter, defaultdict

from conftest_llm import docs_of
from pyspark.sql import functions as F
from test_documents import plain_counts


def plain_stage(rows, limit):
    """rows: (id, text, source); the sorted (id, text) that stay when a host's lines in over ``limit`` texts go."""
    normal = lambda x: " ".join(x.split()).lower()
    often, hosts = Counter(), defaultdict(set)
    for _, t, s in rows:
        hosts[s].add(t or "")
    for s, texts in hosts.items():
        for t in texts:
            often.update({(s, normal(x)) for x in t.split("\n") if x.split()})
    out = []
    for i, t, s in rows:
        gone = [x for x in (t or "").split("\n") if often[s, normal(x)] > limit]
        n = plain_counts(t)
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and 2 * sum(len(x.split()) for x in gone) <= n[0]:
            out.append((i, "\n".join(x for x in t.split("\n") if x not in gone) if gone else t))
    return sorted(out, key=repr)


def test_stage_writes_texts_without_frequent_lines(spark):
    import corpus_pipeline

    body = lambda i, n: " ".join(f"own{i}w{k}" for k in range(n))
    rows = [(i, f"All rights  reserved.\n\n  {body(i, 60)}\nall Rights reserved. ", s) for i, s in enumerate(["hot", None] * 40)]
    rows += [(100 + i, f"{body('c', 30)}\n{body(i, 20)}", "hot") for i in range(40)]  # depleted
    rows += [(200, f"all rights reserved.\n{body(200, 60)}", "other"), (None, rows[0][1], "hot"), rows[2], rows[2], (3, rows[2][1], "other")]
    docs = docs_of(spark, rows)
    got = corpus_pipeline.quality(spark, docs, None)
    assert got.columns == docs.columns
    assert got.filter(F.length("text") != F.col("n_chars")).count() == 0
    got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert got == plain_stage(rows, 10)
    assert dict(got)[0] == f"\n  {body(0, 60)}" and 100 not in dict(got)


def test_line_rule_rejects_documents_of_the_tables(spark):
    """A host of the check table loses documents that the base rules keep, whatever its size."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/check_h/documents.parquet").filter("source = 'src9'").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, docs, None).collect()), key=repr)
    assert got == plain_stage(rows, 10)
    base = {i for i, t, _ in rows if (n := plain_counts(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    assert len(base - {i for i, _ in got}) >= 18


def test_a_line_on_few_percent_of_a_host_goes(spark):
    import corpus_pipeline

    body = lambda i: " ".join(f"own{i}w{k}" for k in range(60))
    rows = [(i, (f"a notice\n{body(i)}" if i % 11 == 0 else body(i)), "hot") for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs_of(spark, rows), None).collect()}
    assert got == {i: body(i) for i in range(200)}
