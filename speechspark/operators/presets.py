"""The model table: decision parameters by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechspark.operators.segmenting import PRESETS

# Model ids and the optional name prefix.
MODEL_IDS = {"unspecified": 0, "pyannote": 1, "fsmn": 2, "firered": 3, "marblenet": 4, "silero": 5}
NAME_PREFIX = "VAD_MODEL_"


def model_name(raw: Column) -> Column:
    """Lower-case name without prefix and surrounding blanks."""
    return F.lower(F.regexp_replace(F.upper(F.trim(raw)), f"^{NAME_PREFIX}", ""))


def presets(spark: SparkSession) -> DataFrame:
    """One row per known model; models without a frame-score segmenter have null parameters."""
    rows = []
    for name, number in MODEL_IDS.items():
        p = PRESETS.get(name)
        rows.append((name, number) + ((float(p.step_ms), p.on, p.off, p.min_on, p.min_off, p.backfill) if p else (None,) * 6))
    return spark.createDataFrame(
        rows, "model string, model_id int, step_ms double, on_threshold double, off_threshold double, min_on int, min_off int, backfill int"
    )


def select_models(requests: DataFrame, spark: SparkSession, column: str = "requested") -> DataFrame:
    named = requests.withColumn("model", model_name(F.col(column)))
    return named.join(presets(spark).filter("model_id > 0"), "model")


def unknown_models(requests: DataFrame, spark: SparkSession, column: str = "requested") -> DataFrame:
    named = requests.withColumn("model", model_name(F.col(column)))
    return named.join(presets(spark).filter("model_id > 0"), "model", "left_anti")
