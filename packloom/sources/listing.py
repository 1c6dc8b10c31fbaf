"""Shard listings, language filters, corpus and configuration scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("text", T.StringType())])
VARIANTS = ("", ".noclean", ".noblocklist")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) under ``folder``, relative to it and sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    at = F.instr("path", folder.rstrip("/")) + len(folder.rstrip("/")) + 1
    return files.select(F.col("path").substr(at, F.length("path")).alias("path"), "length").orderBy("path")


def top_segment(path: Column) -> Column:
    """What stands before the first slash; the whole path if there is none."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def language_files(files: DataFrame, lang: str, variants: bool = False, split: str | None = None, path: str = "path") -> DataFrame:
    """Files of a language's folder, with its variants if asked. ``split`` keeps names that hold it, so that validation
    shards of the same folder stay out of training."""
    wanted = [lang + v for v in (VARIANTS if variants else VARIANTS[:1])]
    rows = files.filter(top_segment(F.col(path)).isin(wanted))
    return rows.filter(F.contains(path, F.lit(split))) if split else rows


def first_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def require_files(found: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """``found``, or an error that names the sorted segments there are."""
    if found.isEmpty():
        seen = [r[0] for r in listing.select(top_segment(F.col(path)).alias("s")).distinct().orderBy("s").limit(1000).collect()]
        raise ValueError(f"no files match; top-level folders are {seen}")
    return found


def to_url(path: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), path)


def train_files(spark: SparkSession, folder: str, lang: str = "en", variants: bool = False, prefix: str = "", split: str | None = None) -> DataFrame:
    """(path, url) of a language's shards: list, filter, drop repeats, refuse an empty result."""
    listing = list_files(spark, folder)
    found = require_files(language_files(listing, lang, variants, split).dropDuplicates(["path"]), listing)
    return found.select("path", to_url(F.col("path"), prefix).alias("url")).orderBy("path")


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON-lines shards, only the text column."""
    return spark.read.schema(CORPUS).json(paths)


def stream_corpus(spark: SparkSession, folder: str, files_per_trigger: int = 1, schema: T.StructType = CORPUS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def gpu_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, driver, memory) of comma-separated lines with three fields or more, trimmed."""
    parts = F.transform(F.split(F.col(line), ",", -1), lambda x: F.trim(x))
    return lines.withColumn("_p", parts).filter(F.size("_p") >= 3).select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("name", "driver", "memory"))])


def toolkit_release(lines: DataFrame, line: str = "line", order: str = "n") -> DataFrame:
    """The version after the last ``release`` of the first line that holds it, up to a comma."""
    hit = lines.filter(F.contains(line, F.lit("release"))).orderBy(order).limit(1)
    return hit.select(F.trim(F.split_part(F.substring_index(line, "release", -1), F.lit(","), F.lit(1))).alias("version"))


def short_version(version: Column) -> Column:
    """major.minor, without what follows a plus sign."""
    return F.substring_index(F.split_part(version, F.lit("+"), F.lit(1)), ".", 2)


def wheel_name(torch: Column, cuda: Column, python: Column) -> Column:
    """The pattern of a wheel's file name; ``xxx`` stands for an unknown toolkit."""
    digits = lambda v: F.replace(v, F.lit("."), F.lit(""))
    # Fixed values of the format.
    parts = ("flash_attn-*+cu", F.coalesce(digits(cuda), F.lit("xxx")), "torch", digits(short_version(torch)), "*-cp", digits(short_version(python)), "-*-linux_x86_64.whl")
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
