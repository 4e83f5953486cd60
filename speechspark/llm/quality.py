"""Quality rules: word and repetition counts per text, and cross-document line frequency.

Everything here is DataFrame functions.  A line is normalised (white space runs to one blank,
trimmed, lower case) and hashed together with its host; a host's line is *frequent* when it occurs in
more than ``max(min_docs, max_share * documents of the host)`` of the host's documents.  Documents
with one text count once, so that copies of a text don't make its lines frequent.  Frequent lines are
removed; a document that loses more than ``max_removed`` of its words is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import SPACES, content_key, stored, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 30
MAX_SHARE = 0.10
MAX_REMOVED = 0.5


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def base_counts(rows: DataFrame) -> DataFrame:
    """Counts and lines over the whole column ``t`` of a frame (``i``, ``h``, ``c``, ``t``); ``t`` goes.

    ``lines`` holds the key and the number of words of each line with a word, in order.

    ``n_repeat_words`` counts the words inside 3-word windows that occur at least twice in the text.
    Windows are compared by a 64-bit hash within one text; only texts in which a hash repeats are
    sorted.  The cost is n log n in the words of a text.
    """
    t = F.col("t")
    out = rows.select(
        "i", "h", "c", words(t).alias("w"), _lines(t).alias("l"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    line = lambda x: F.struct(
        F.xxhash64(F.col("h"), _normal(x)).alias("k"), F.size(words(x)).cast("long").alias("n"))
    keep = ["i", "h", "c", "word_chars", "n_symbols"]
    n = F.size("w")
    at = lambda k: F.get(F.col("w"), k)
    window = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda k: F.xxhash64(at(k), at(k + 1), at(k + 2))),
    )
    out = out.select(
        *keep, n.cast("long").alias("n_words"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("l", line).alias("lines"), window.alias("x"),
    )
    keep += ["n_words", "n_dup_lines", "lines"]
    ordered = F.when(
        F.size(F.array_distinct("x")) < F.size("x"),
        F.sort_array(F.transform("x", lambda v, k: F.struct(v.alias("v"), k.alias("k")))),
    )
    out = out.select(*keep, ordered.alias("s"))
    near = lambda e, k: F.coalesce(F.get(F.col("s"), k)["v"] == e["v"], F.lit(False))
    twice = F.filter("s", lambda e, k: near(e, k - 1) | near(e, k + 1))
    out = out.select(*keep, F.sort_array(F.transform(twice, lambda e: e["k"])).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda v, k: F.coalesce(F.least(F.get(F.col("p"), k + 1) - v, F.lit(3)), F.lit(3))),
        F.lit(0), lambda a, v: a + v,
    )
    return out.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def frequent_lines(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(``k``, ``n_docs``) of the lines above their host's limit, from documents (``h``, ``c``) and lines (``h``, ``c``, ``k``)."""
    docs = docs.distinct().groupBy("h").agg(F.count("*").alias("n_host"))
    freq = lines.select("h", "c", "k").distinct().groupBy("h", "k").agg(F.count("*").alias("n_docs"))
    freq = freq.filter(F.col("n_docs") > min_docs)
    docs = docs.withColumnRenamed("h", "hh")
    return (
        freq.join(docs, F.col("h").eqNullSafe(F.col("hh")))
        .filter(F.col("n_docs") > F.col("n_host") * max_share)
        .select("k", "n_docs")
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED,
    with_lines: bool = False,
) -> DataFrame:
    """One row per input row: id, ``content_key``, counts, ``n_removed_words``, ``base_failed``, ``kept``.

    ``with_lines`` adds the host as ``host`` and the keys of the row's frequent lines as ``gone_lines`` (null if none).

    A null text counts as an empty one (no words, hence base_failed); null hosts form one host; a null
    id is kept as an id; repeated rows each get a row with the same values.  Other columns are not read.
    An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("i"), F.col(host_col).alias("h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    ).withColumn("c", content_key(F.col("t")))
    # One pass over the texts; everything after it reads narrow rows.
    base = stored(base_counts(rows), "base")
    lines = base.select("i", "h", "c", F.explode("lines").alias("x")).select("i", "h", "c", "x.k", "x.n")
    often = frequent_lines(base.select("h", "c"), lines, min_docs, max_share)
    # Repeated rows of a document have its lines several times.
    row = ["i", "h", "c"]
    copies = base.groupBy(*row).agg(F.count("*").alias("copies")).filter("copies > 1")
    removed = lines.join(often.select("k"), "k").groupBy(*row).agg(
        F.sum("n").alias("removed"), *[F.collect_set("k").alias("gone_lines")] * with_lines)
    extra = ["gone_lines"] * with_lines

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({x: f"r{x}" for x in row})
        same = F.col("i").eqNullSafe(F.col("ri")) & F.col("h").eqNullSafe(F.col("rh")) & (F.col("c") == F.col("rc"))
        return left.join(right, same, "left").drop("ri", "rh", "rc")

    per_doc = beside(removed, copies).select(*row, (F.col("removed") / F.coalesce("copies", F.lit(1))).cast("long").alias("removed"), *extra)
    joined = beside(base.drop("lines"), per_doc)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    removed = F.coalesce("removed", F.lit(0))
    return joined.select(
        F.col("i").alias(id_col), F.col("c").alias("content_key"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        removed.alias("n_removed_words"), failed.alias("base_failed"),
        (~failed & (removed <= max_removed * F.col("n_words"))).alias("kept"),
        *[F.col("h").alias("host"), F.col("gone_lines")] * with_lines,
    )


def cut_lines(text: Column, host: Column, gone: Column) -> Column:
    """``text`` without the lines whose keys are in ``gone``; the others keep their order and bytes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(host, _normal(x)))), "\n")


def without_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
) -> DataFrame:
    """The texts without their frequent lines: (id, ``kept_text``) per row; lines keep their order and bytes.

    A null text stays null.  The lines that go are gathered per document, so no group is larger than a text.
    """
    rows = docs.select(
        F.col(id_col).alias("i"), F.col(host_col).alias("h"), F.col(text_col).alias("t"),
    ).withColumn("c", content_key(F.col("t")))
    key = lambda x: F.xxhash64(F.col("h"), _normal(x))
    lines = rows.select("i", "h", "c", F.explode(F.transform(_lines(F.col("t")), key)).alias("k"))
    gone = (
        lines.join(frequent_lines(rows.select("h", "c"), lines, min_docs, max_share).select("k"), "k")
        .groupBy("i", "c").agg(F.collect_set("k").alias("gone"))
        .withColumnsRenamed({"i": "ri", "c": "rc"})
    )
    kept = F.array_join(F.filter(F.split("t", "\n"), lambda x: ~F.array_contains("gone", key(x))), "\n")
    return rows.join(gone, F.col("i").eqNullSafe(F.col("ri")) & (F.col("c") == F.col("rc")), "left").select(
        F.col("i").alias(id_col), F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
    )
