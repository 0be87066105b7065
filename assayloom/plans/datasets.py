"""Experiments of samples, dataset listings and single datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators import catalog, compare, select


def load_samples(spark: SparkSession, registry: DataFrame, stored: DataFrame, root: str, sample_ids: list[str]) -> tuple[DataFrame, list[str]]:
    """The tidy rows of all experiments of the samples, in registry order, and the names that aren't stored."""
    found = compare.of_samples(registry, sample_ids)
    order = [c for c in ("row_number", "name") if c in found.columns]
    return compare.load_experiments(spark, stored, root, [r["name"] for r in found.orderBy(*order).select("name").collect()])


def list_datasets(stored: DataFrame, metadata: DataFrame | None = None, limit: int | None = None, **filters) -> DataFrame:
    """E5: catalogue rows, filled from the newest metadata, filtered by equality, newest first."""
    rows = stored if metadata is None else catalog.enrich(stored, metadata, [c for c in metadata.columns if c in select.FILTERABLE and c != "experiment_name"])
    return select.latest_metadata(select.conjunction(rows, filters), limit, "experiment_name")


def get_dataset(stored: DataFrame, name: str) -> DataFrame:
    """E5: the newest row of a dataset by its name; an unknown name is an error."""
    out = stored.filter((F.col("table_name") == name) | (F.col("experiment_name") == name))
    if out.isEmpty():
        raise KeyError(name)
    return select.latest_metadata(out, 1, "experiment_name")
