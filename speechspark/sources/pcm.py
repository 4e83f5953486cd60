"""Recordings as tables: scan, validation, content ids, raw matrices."""

from __future__ import annotations

import re
from collections.abc import Sequence
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechspark.functions.numeric import SAMPLE_RATE
from speechspark.operators.pcm import decode_f32

# File suffix and the messages of the input checks.
CLIP_SUFFIX = "-16k.f32"
MSG_RATE = "sample rate must be 16000, got %d"
MSG_EMPTY = "samples cannot be empty"
MSG_ALIGN = "samples length %d is not a multiple of 4 (expected float32 little-endian)"


MSG_LARGE = "samples do not fit into one row"
#: Arrays of the JVM end at 2 GiB.
MAX_CLIP_BYTES = (1 << 31) - (1 << 20)


def _empty_files(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    """Paths of the files of length zero, which Spark's file source leaves out; listed on the driver, as Spark lists."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system, todo, found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), [folder], []
    while todo:
        for x in system.listStatus(todo.pop()):
            if x.isDirectory() and recursive:
                todo.append(x.getPath())
            elif x.isFile() and x.getLen() == 0 and fnmatch(x.getPath().getName(), glob):
                found.append((x.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def read_pcm(spark: SparkSession, path: str, glob: str = f"*{CLIP_SUFFIX}", recursive: bool = False) -> DataFrame:
    """Raw float32 files as clips: clip_id (file name without suffix), sample_rate, pcm.

    The name filter is applied while listing, so other files are never opened.  One folder is read;
    with ``recursive`` also those below, and clip ids then hold the path from ``path`` on, so that
    equal names stay apart.  Files of length zero give an empty ``pcm``.  A file too large for one
    row gives a null one, without being opened, and is quarantined by ``validate_clips``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    fits = F.col("length") <= MAX_CLIP_BYTES
    rows = (
        files.filter(fits).select("path", F.col("content").alias("pcm"))
        .unionByName(files.filter(~fits).select("path", F.lit(None).cast("binary").alias("pcm")))
        .unionByName(_empty_files(spark, path, glob, recursive).select("path", F.lit(b"").alias("pcm")))
    )
    if recursive:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
        name = F.element_at(F.split("path", re.escape(root) + "/", 2), -1)
    else:
        name = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        F.regexp_replace(name, F.lit(CLIP_SUFFIX.replace(".", r"\.") + "$"), F.lit("")).alias("clip_id"),
        F.lit(SAMPLE_RATE).alias("sample_rate"), "pcm",
    )


def input_error(rate: Column, n_bytes: Column, allow_empty: bool = False, strict: bool = True) -> Column:
    """Message of the first failed check, or null.  Rate 0 (or null) means the default rate; a null
    length, that the payload did not fit into a row."""
    bad_rate = F.coalesce(rate, F.lit(0)).isin(0, SAMPLE_RATE) == F.lit(False)
    out = F.when(bad_rate, F.format_string(MSG_RATE, rate))
    if not allow_empty:
        out = out.when(n_bytes == 0, F.lit(MSG_EMPTY))
    out = out.when(n_bytes.isNull(), F.lit(MSG_LARGE))
    if strict:
        out = out.when(n_bytes % 4 != 0, F.format_string(MSG_ALIGN, n_bytes))
    return out


def validate_clips(df: DataFrame, allow_empty: bool = False, strict: bool = True) -> DataFrame:
    """Adds ``error``; with strict=False trailing bytes of a partial sample are accepted."""
    return df.withColumn("error", input_error(F.col("sample_rate"), F.length("pcm"), allow_empty, strict))


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows): one bad clip never stops the others."""
    return df.filter("error is null").drop("error"), df.filter("error is not null")


def content_id(payload: str | Column) -> Column:
    """"u-" and the first 8 bytes of the SHA-1 of the payload, in hex."""
    return F.concat(F.lit("u-"), F.substring(F.sha1(payload), 1, 16))


def dedupe_by_content(df: DataFrame, payload: str, id_col: str = "clip_id") -> DataFrame:
    """One row per content id: the smallest clip id and the number of submissions."""
    return (
        df.select(content_id(payload).alias("content_id"), id_col)
        .groupBy("content_id")
        .agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_submitted"))
    )


def dedupe_stream(df: DataFrame, payload: str, time_col: str, window: str) -> DataFrame:
    """The first submission of each content id in a stream, with ``content_id``.

    Repeats within ``window`` of the newest ``time_col`` are dropped, in whatever trigger they come; the state
    holds the ids of that time only.  A null payload has no id: null ones are repeats of each other.  A row later than the
    window is dropped, as Spark drops late rows.
    """
    return df.withColumn("content_id", content_id(payload)).withWatermark(time_col, window).dropDuplicatesWithinWatermark(["content_id"])


def read_f32_matrix(spark: SparkSession, path: str, ncols: int, glob: str = "*.f32", rows_per_part: int = 4_096) -> DataFrame:
    """Raw float32 row-major matrices: name, row_idx, row, error.

    A file is cut into parts of whole rows before decoding.  A file that is empty, does not fit into one row
    (it is not opened then) or whose length is not a multiple of the row size gives one row with ``error``.
    """
    row_bytes = 4 * ncols
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name, n = F.element_at(F.split("path", "/"), -1), F.col("length")
    whole = (n <= MAX_CLIP_BYTES) & (n % row_bytes == 0)
    odd = F.when(n > MAX_CLIP_BYTES, F.lit(MSG_LARGE)).otherwise(F.format_string(f"length %d is not a multiple of {row_bytes}", n))
    files = found.filter(whole).select(name.alias("name"), "content", n.alias("_n"))
    bad = found.filter(~whole).select(name.alias("name"), odd.alias("error")).unionByName(
        _empty_files(spark, path, glob, False).select(name.alias("name"), F.lit(MSG_EMPTY).alias("error")))
    last = F.expr(f"greatest((_n div {row_bytes} - 1) div {rows_per_part}, 0)")
    # Cut inside the row, so that no part's row carries the whole file.
    size = rows_per_part * row_bytes
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda p: F.substring(F.col("content"), (p * size + 1).cast("int"), F.lit(size)))
    parts = files.filter("_n > 0").select("name", F.posexplode(pieces).alias("_p", "_bytes"))
    rows = parts.select("name", "_p", decode_f32("_bytes").alias("_v")).select(
        "name", "_p", "_v", F.explode(F.sequence(F.lit(0), (F.size("_v") / ncols).cast("int") - 1)).alias("_r")
    )
    good = rows.select(
        "name", (F.col("_p").cast("bigint") * rows_per_part + F.col("_r")).alias("row_idx"),
        F.slice("_v", F.col("_r") * ncols + 1, F.lit(ncols)).alias("row"), F.lit(None).cast("string").alias("error"),
    )
    bad = bad.select(
        "name", F.lit(None).cast("bigint").alias("row_idx"), F.lit(None).cast("array<float>").alias("row"), "error"
    )
    return good.unionByName(bad)


def read_matrix_meta(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.meta.json").json(path)


def check_output_length(outputs: Sequence, expected: int) -> str | None:
    return None if len(outputs) == expected else f"scorer returned {len(outputs)} values for {expected} frames"
