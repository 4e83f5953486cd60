"""Chunk streams: the source, and the checks on each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechspark.operators.pcm import decode_f32
from speechspark.schemas import CHUNKS
from speechspark.sources.pcm import input_error


def read_chunks(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = CHUNKS, **options) -> DataFrame:
    """Streaming chunks from a folder of files; order is given by ``seq``, not by arrival."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def chunks_from_kafka(raw: DataFrame) -> DataFrame:
    """Chunks from a streaming DataFrame with a JSON ``value`` column, as a Kafka source gives it."""
    return raw.select(F.from_json(F.col("value").cast("string"), CHUNKS).alias("c")).select("c.*")


def validate_chunks(df: DataFrame) -> DataFrame:
    """Adds ``error``; an empty chunk is allowed.  Raw ``pcm`` bytes become ``samples``."""
    if "pcm" in df.columns:
        checked = df.withColumn("error", input_error(F.col("sample_rate"), F.length("pcm"), allow_empty=True))
        return checked.withColumn("samples", decode_f32("pcm")).drop("pcm")
    return df.withColumn("error", input_error(F.col("sample_rate"), F.lit(0), allow_empty=True))
