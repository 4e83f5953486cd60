"""What a task of the substring operator takes besides its rows."""

import numpy as np
import pyspark.sql.pandas.group_ops as group_ops
from conftest_llm import docs_of

LIMIT_MB = 60


def bounded(func, two):
    def checked(*tables):
        import tracemalloc

        tracemalloc.start()
        try:
            out = func(*tables)
            peak = tracemalloc.get_traced_memory()[1] / 2**20
        finally:
            tracemalloc.stop()
        assert peak < LIMIT_MB, f"{func.__name__} took {peak:.0f} MB"
        return out

    return (lambda left, right: checked(left, right)) if two else (lambda rows: checked(rows))


def test_tasks_stay_small_whatever_the_corpus(spark, monkeypatch):
    """6 MB of texts, at the default size of a batch: no step of any batch takes more than LIMIT_MB at once."""
    from speechspark.llm import substrings

    for kind, two in ((group_ops.PandasGroupedOpsMixin, False), (group_ops.PandasCogroupedOps, True)):
        def call(self, func, schema, real=kind.applyInArrow, two=two):
            return real(self, bounded(func, two), schema)

        monkeypatch.setattr(kind, "applyInArrow", call)
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(600):
        own = " ".join(vocabulary[rng.integers(0, len(vocabulary), 1_500)])
        rows.append((i, f"{own} {passage}" if i % 50 == 0 else own, "a"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == {i: (1_540, 40, t.removesuffix(f" {passage}")) if i % 50 == 0 else (1_500, 0, t) for i, t, _ in rows}


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    """Runs at the borders of pieces, and runs longer than a piece, have the hashes that one pass gives."""
    from speechspark.llm import substrings

    words = np.random.default_rng(9).integers(0, 1 << 63, 700).astype(np.uint64)
    whole = {size: substrings.window_hashes(words, size) for size in (18, 35, 100, 700, 701)}
    monkeypatch.setattr(substrings, "_PIECE", 64)
    for size, want in whole.items():
        assert substrings.window_hashes(words, size).tolist() == want.tolist() and len(want) == max(701 - size, 0)
