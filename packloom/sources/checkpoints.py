"""The checkpoint catalog: names, latest step, tables per step, metric and log sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.plans.stash import hadoop

KINDS = ("model", "optim", "scheduler")


def file_name(kind: Column, step: Column, digits: int = 5) -> Column:
    """``kind_00042.pt``; longer steps keep all digits."""
    return F.concat(kind, F.lit("_"), F.format_string(f"%0{digits}d", step), F.lit(".pt"))


def step_of(path: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.split_part(stem, F.lit("_"), F.lit(2)).try_cast("int")


def latest_step(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: the greatest step of the model files, null if there are none."""
    name = F.substring_index(F.col(path), "/", -1)
    return files.filter(name.rlike(r"^model_.*\.pt$")).agg(F.max(step_of(F.col(path))).alias("step"))


def list_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "model_*.pt").load(folder).select("path", "length")


def mark(spark: SparkSession, folder: str, steps: list[int], kind: str = "model") -> None:
    """Files of one byte named as checkpoints of these steps, in any file system that Spark reaches."""
    for step in steps:
        fs, at = hadoop(spark, f"{folder}/{kind}_{step:05d}.pt")
        out = fs.create(at, True)
        out.writeBytes("1")
        out.close()


def publish(artifacts: DataFrame, manifest: str) -> None:
    """Append (name, step, path) of artifacts (step, path) to a manifest table; names have steps of six digits."""
    name = file_name(F.lit("checkpoint"), F.col("step"), 6)
    artifacts.select(F.regexp_replace(name, r"\.pt$", "").alias("name"), "step", "path").write.mode("append").parquet(manifest)


def save_state(state: DataFrame, folder: str, step: int) -> str:
    path = f"{folder}/step={step}"
    state.write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, folder: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/step={step}")


def append_metrics(metrics: DataFrame, folder: str) -> None:
    """Append (run, step, key, value) rows."""
    metrics.select("run", "step", "key", "value").write.mode("append").parquet(folder)


def append_log(lines: DataFrame, folder: str, line: str = "line") -> None:
    lines.select(line).write.mode("append").text(folder)


def parameter_counts(tensors: DataFrame) -> DataFrame:
    """(total, trainable) over rows of (name, shape, trainable)."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return tensors.agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(F.col("trainable"), n)), F.lit(0)).alias("trainable"))
