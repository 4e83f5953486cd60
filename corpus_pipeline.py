"""A corpus pipeline of five stages: quality rules, near duplicates, repeated passages, benchmarks, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the
columns that they got.  ``run`` writes every stage's result as Parquet in the shared folder and reads it
as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechspark.llm.common import content_key, stored
from speechspark.llm.contamination import RESULTS, find_contamination
from speechspark.llm.minhash import similar_texts
from speechspark.llm.mixing import mix
from speechspark.llm.quality import cut_lines, quality_rules
from speechspark.llm.simhash import near_duplicates
from speechspark.llm.substrings import remove_repeats
from speechspark.session import ship_package


#: A line in more texts of its host than this is frequent, however large the host is.  op4_quality keeps
#: the limits of its check SQL (30 documents and a tenth of the host's), which reject nothing in the tables.
LINE_DOCS = 10


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, content key) isn't in ``gone``; null ids compare as equal."""
    row, key = _fresh(docs, "_gone_id"), _fresh(docs, "_gone_key")
    gone = gone.select(F.col("doc_id").alias(row), F.col("content_key").alias(key)).distinct()
    same = docs["doc_id"].eqNullSafe(gone[row]) & (content_key(docs["text"]) == gone[key])
    return docs.join(gone, same, "left_anti")


def _rewritten(docs: DataFrame, cut: Column, text: Column) -> DataFrame:
    """``docs`` with ``text`` where ``cut`` holds, and n_chars anew there."""
    out = docs.withColumn("text", F.when(cut, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their host's frequent lines, with n_chars anew."""
    ship_package(spark)
    ruled = quality_rules(docs, min_docs=LINE_DOCS, max_share=0, with_lines=True).filter(~F.col("kept") | F.col("gone_lines").isNotNull())
    name = {c: _fresh(docs, f"_rule_{c}") for c in ("doc_id", "content_key", "host", "kept", "gone_lines")}
    ruled = ruled.select(*[F.col(c).alias(n) for c, n in name.items()]).dropDuplicates([name[c] for c in ("doc_id", "content_key", "host")])
    same = (
        docs["doc_id"].eqNullSafe(ruled[name["doc_id"]]) & (content_key(docs["text"]) == ruled[name["content_key"]])
        & docs["source"].eqNullSafe(ruled[name["host"]])
    )
    out = docs.join(ruled, same, "left").filter(F.coalesce(F.col(name["kept"]), F.lit(True)))
    gone = F.col(name["gone_lines"])
    return _rewritten(out, gone.isNotNull(), cut_lines(F.col("text"), F.col("source"), gone)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least id stays; of rows with that id and one text, one.

    Texts are linked by operator 3 (SimHash fingerprints within two bits, found by covering masks), and if they
    share 0.8 of their 5-word shingles, which fingerprints don't reach; a group is what links of either connect.
    Rows of that id with other texts of the same group go as well; a group without ids keeps one row.
    """
    ship_package(spark)
    key = _fresh(docs, "_key")
    keyed = docs.withColumn(key, content_key(F.col("text")))
    rows = keyed.select(F.struct("doc_id", F.col(key).alias("key")).alias("row"), "text")
    prints = stored(near_duplicates(rows, "row"), "prints")
    groups = similar_texts(rows, "row", known=prints)
    # Structs sort by id first, nulls first; a row without an id must not win over one with an id.
    members = groups.select("row", "component_id").distinct()
    best = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("row.doc_id").isNull().alias("void"), F.col("row").alias("row"))).alias("best"))
    gone = (
        members.join(best, "component_id").filter(F.col("row") != F.col("best.row"))
        .select("row.doc_id", F.col("row.key").alias("content_key"))
    )
    return _without(keyed.dropDuplicates(["doc_id", key]).drop(key), gone)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; documents of which nothing is left go.

    Texts that lose nothing keep their white space; the others are joined by blanks, with n_chars anew.
    """
    ship_package(spark)
    own = {c: _fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_sha256", "kept_text")}
    out = remove_repeats(docs.withColumnsRenamed(own)).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("n_removed") > 0
    out = _rewritten(out, cut, F.col("kept_text"))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    ship_package(spark)
    own = {c: _fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in RESULTS}
    found = find_contamination(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn copies of documents, with their copy number, shard and order in it."""
    ship_package(spark)
    return mix(docs)


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", decontaminate), ("mix", mixed),
]
#: Hash fingerprints, seeded draws and the like are not SQL; tests/llm compares run() with plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
