"""File listings, and the files that belong to a registry row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import scalar
from assayloom.sources.scan import taken_literally


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """S3: path, length and modificationTime of the raw files below a folder (contents are pruned); no Parquet, no manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(taken_literally(root)).select("path", "length", "modificationTime")
    return files.filter(~F.lower("path").endswith(".parquet") & (scalar.base_name(F.col("path")) != "manifest.json"))


def located(files: DataFrame) -> DataFrame:
    """path with its folder, the folder's name, base name and stem."""
    p = F.col("path")
    return files.select("path", scalar.dir_name(p).alias("dir"), scalar.base_name(p).alias("base"), scalar.stem(p).alias("stem")).withColumn("dir_name", scalar.base_name(F.col("dir")))


def files_of(registry: DataFrame, files: DataFrame, key: str = "raw_data_filename") -> tuple[DataFrame, DataFrame]:
    """((key, path) of every file of a registry row, (key, matches, ambiguous) of every row).

    A file hits by base name or stem, and then all files of its folder belong to the row; a folder of that name hits
    too, with the files directly in it. More than one folder by either rule is ambiguous; no hit is not found.
    """
    at = located(files)
    wanted = registry.select(F.col(key).alias("key")).filter("key is not null").distinct()
    wanted = wanted.withColumn("key_stem", scalar.stem(F.col("key")))
    by_base = wanted.join(at, wanted.key == at.base).select("key", "dir")
    by_stem = wanted.join(at, wanted.key_stem == at.stem).select("key", "dir")
    hit = by_base.union(by_stem).distinct()
    folder = wanted.join(at, wanted.key == at.dir_name).select("key", "dir").distinct()
    found = hit.union(folder).distinct().join(at.select("dir", "path"), "dir").select("key", "path").distinct()
    rule = lambda df, name: df.groupBy("key").agg(F.count_distinct("dir").alias(name))
    status = wanted.select("key").join(rule(hit, "a"), "key", "left").join(rule(folder, "b"), "key", "left").join(found.groupBy("key").agg(F.count("*").alias("matches")), "key", "left")
    status = status.select("key", F.coalesce("matches", F.lit(0)).alias("matches"), ((F.coalesce("a", F.lit(0)) > 1) | (F.coalesce("b", F.lit(0)) > 1)).alias("ambiguous"))
    return found.withColumnRenamed("key", key), status.withColumnRenamed("key", key)

