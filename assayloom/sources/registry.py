"""Registries, instrument configuration, stored datasets and sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import scalar
from assayloom.operators.normalize import with_extras
from assayloom.sources.scan import source_path

KNOWN = ("name", "instrument_name", "raw_data_filename", "sample_id", "run_id", "experiment_id", "measurement_profile")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All-text registry out of CSV or Parquet; a missing required column is an error, a missing file name is the name."""
    df = spark.read.parquet(path) if path.rstrip("/").lower().endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).csv(path)
    missing = [c for c in ("name", "instrument_name") if c not in df.columns]
    if missing:
        raise ValueError(f"the registry has no column {missing}")
    df = df.select(*[scalar.blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if "raw_data_filename" not in df.columns:
        df = df.withColumn("raw_data_filename", F.col("name"))
    return df


def experiments(registry: DataFrame) -> DataFrame:
    """Experiments with folded instrument, default run, profile (explicit or inferred) and extras as a map."""
    out = registry
    for c in ("sample_id", "run_id", "measurement_profile", "description"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    profile = scalar.profile_of(F.col("measurement_profile"), F.col("description"))
    # the registry's own profile also stays among the extras
    out = out.withColumn("registry_measurement_profile", F.col("measurement_profile")).withColumn("measurement_profile", profile)
    out = out.withColumn("instrument_name", scalar.fold(F.col("instrument_name"))).withColumn("run_id", scalar.run_or_default(F.col("run_id")))
    out = out.withColumn("raw_data_filename", F.coalesce("raw_data_filename", "name"))
    return with_extras(out, KNOWN)


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """The instrument configuration with folded names."""
    return spark.read.option("multiLine", True).json(path).withColumn("name", scalar.fold(F.col("name")))


def read_dataset(spark: SparkSession, catalog: DataFrame, name: str) -> DataFrame:
    """A stored dataset by its catalogue name."""
    row = catalog.filter(F.col("table_name") == name).select("storage_path").first()
    if row is None:
        raise KeyError(name)
    return scan_storage(spark, row["storage_path"])


def scan_storage(spark: SparkSession, root: str, partitioned: bool = False) -> DataFrame:
    """All Parquet below a folder, unlike schemas merged; ``partitioned``: folders named key=value give columns."""
    read = spark.read.option("mergeSchema", True)
    return (read if partitioned else read.option("recursiveFileLookup", True)).parquet(root)


def read_sidecars(spark: SparkSession, path: str, schema: str = "experiment_id string, dataset_name string, metadata map<string,string>") -> DataFrame:
    """Metadata sidecars; a broken file gives no row, missing ids are taken from the path."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    at = source_path(F.col("_metadata.file_path"))
    parsed = files.select(at.alias("source_file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    stem = scalar.stem(F.col("source_file"))
    sound = F.greatest(F.col("r.experiment_id").isNotNull(), F.col("r.dataset_name").isNotNull(), F.col("r.metadata").isNotNull())
    return parsed.filter(sound).select("source_file", F.coalesce("r.experiment_id", scalar.base_name(scalar.dir_name(F.col("source_file")))).alias("experiment_id"), F.coalesce("r.dataset_name", stem).alias("dataset_name"), F.col("r.metadata").alias("metadata"))
