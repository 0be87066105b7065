"""Planned scan of raw text files: only the files asked for are opened, large ones in byte ranges by several tasks.

Paths go to Spark's line reader in waves of ``WAVE``, so the driver never holds more of them. Spark packs small files
into tasks and cuts large ones; a line carries its file, the first byte of its range (``part``) and a number that
rises within the range. Line numbers of a file are then the lines of the ranges before it plus the place in its own: sums over ranges, not
over lines.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.sources.shared import shared_folder, stored

WAVE = 100_000
LINES = "source_file string, part long, at long, line string"


def source_path(uri: Column) -> Column:
    """The path of a file's URI as Spark's metadata gives it (signs other than letters are percent-encoded there)."""
    return F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def taken_literally(path: str) -> str:
    """A path in which no sign is a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file (as the metadata gives it), part, at and line of the files, which Spark cuts at line ends (\\n, \\r\\n or \\r)."""
    read = spark.read.format("text").load([taken_literally(p) for p in paths])
    return read.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def line_numbers(raw: DataFrame) -> DataFrame:
    """source_file, line_no (from 0 in each file) and line of (source_file, part, at, line); ``raw`` is read twice, so it is best a written table."""
    parts = raw.groupBy("source_file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source_file", "part", source_path(F.col("source_file")).alias("path"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    offsets = stored(offsets, shared_folder(raw.sparkSession), "offsets")  # a row a range, of known size
    return raw.join(offsets, ["source_file", "part"]).select(F.col("path").alias("source_file"), (F.col("at") + F.col("offset")).cast("int").alias("line_no"), "line")


def staged_lines(paths: DataFrame, folder: str) -> DataFrame:
    """Numbered lines of the files in ``paths`` (path), each opened once and written to ``folder``."""
    spark = paths.sparkSession
    rows = paths.select("path").distinct().toLocalIterator()
    while wave := [r["path"] for r in islice(rows, WAVE)]:
        raw_lines(spark, wave).write.mode("append").parquet(folder)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)):
        return spark.createDataFrame([], "source_file string, line_no int, line string")
    return line_numbers(spark.read.schema(LINES).parquet(folder))
