"""Comparison sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.scalar import group_label, is_boundary

# The metadata columns of a comparison.
METADATA = ("experiment_name", "experiment_id", "sample_id", "run_id", "instrument_name", "instrument_type", "measurement_profile")
MODES = ("auto", "overlay", "facet", "stacked")


def union_all(frames: list[DataFrame], types: dict[str, str] | None = None) -> DataFrame:
    """Union by name, missing columns null; shared columns of unlike types become text unless ``types`` says otherwise."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    want = {c: "double" if ts <= numbers else "string" for c, ts in kinds.items() if len(ts) > 1} | (types or {})
    cast = [f.withColumns({c: F.col(f"`{c}`").cast(want[c]) for c in f.columns if c in want}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def union_labelled(frames: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Union of named frames with their name as a column."""
    return union_all([f.withColumn(label, F.lit(name)) for name, f in frames.items()])


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3."""
    return a.unionByName(b).distinct()


def missing_columns(required: list[str], present) -> object:
    """U4."""
    return F.array_except(F.array(*[F.lit(c) for c in required]), present)


def labelled(data: DataFrame, datasets: DataFrame) -> DataFrame:
    """comparison_label, comparison_pos and metadata columns, filled where absent or null.

    ``datasets``: experiment_id, pos and any of METADATA. Label: name, else id, else dataset_<pos>.
    """
    have = [c for c in METADATA if c in datasets.columns and c != "experiment_id"]
    right = datasets.select("experiment_id", F.col("pos").alias("comparison_pos"), *[F.col(c).alias(f"_{c}") for c in have])
    out = data.join(right, "experiment_id", "inner")
    for c in have:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.col(f"_{c}")) if c in data.columns else F.col(f"_{c}")).drop(f"_{c}")
    name = F.nullif(F.col("experiment_name").cast("string"), F.lit("")) if "experiment_name" in out.columns else F.lit(None).cast("string")
    return out.withColumn("comparison_label", F.coalesce(name, F.col("experiment_id").cast("string"), F.concat(F.lit("dataset_"), F.col("comparison_pos"))))


def stored_folders(spark: SparkSession, root: str, experiment_ids: list[str]) -> list[str]:
    """Partition folders below ``root`` that hold the experiments, whatever their instrument."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().toString() for i in experiment_ids for f in fs.globStatus(path(f"{root.rstrip('/')}/instrument_name=*/experiment_id={i}")) or []]


def load_experiments(spark: SparkSession, catalog: DataFrame, root: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """(tidy rows of the named experiments in request order, names that aren't stored); no name is an error.

    One scan of these experiments' folders only; their schemas are merged, no other file's is read.
    """
    if not names:
        raise ValueError("name at least one experiment")
    wanted = spark.createDataFrame(list(enumerate(names)), "pos int, experiment_name string")
    found = wanted.join(catalog, "experiment_name")
    rows = found.select("experiment_name", "experiment_id").distinct().collect()  # of the names asked for
    have = {r["experiment_name"] for r in rows}
    folders = stored_folders(spark, root, sorted({r["experiment_id"] for r in rows}))
    data = spark.read.option("basePath", root).option("mergeSchema", True).parquet(*folders) if folders else spark.read.parquet(root).limit(0)
    return labelled(data, found), [n for n in names if n not in have]


def of_samples(registry: DataFrame, sample_ids: list[str]) -> DataFrame:
    """Experiments of the samples, in registry order; none is an error."""
    out = registry.filter(F.col("sample_id").cast("string").isin([str(s) for s in sample_ids]))
    if out.isEmpty():
        raise ValueError(f"no experiment of {sample_ids}")
    return out


def with_metadata(data: DataFrame, metadata: DataFrame, key: str = "experiment_name") -> DataFrame:
    """Spark broadcasts the metadata itself when its measured size is small."""
    return data.join(metadata, key, "left")


def stacked(df: DataFrame, y: str, offset: float, position: str = "comparison_pos") -> DataFrame:
    """W8."""
    if offset <= 0:
        raise ValueError("the offset is above 0")
    return df.withColumn(y, F.col(y) + F.lit(float(offset)) * F.col(position))


def resolved_mode(mode: str, x_columns: list[str], offset: float | None = None) -> str:
    """Overlay for one shared x column, else facets; what can't be drawn is an error."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    shared = len(set(x_columns)) <= 1
    if mode == "auto":
        return "overlay" if shared else "facet"
    if mode in ("overlay", "stacked") and not shared:
        raise ValueError("the x columns differ")
    if mode == "stacked" and not (offset and offset > 0):
        raise ValueError("stacked needs an offset above 0")
    return mode


def compare_series(series: dict[str, tuple[str, DataFrame]], mode: str = "auto", offset: float | None = None, separator: str = " | ") -> tuple[DataFrame, str]:
    """All series under one label: (dataset label, (x column, series(group, x, y))). Boundary labels are left out."""
    how = resolved_mode(mode, [x for x, _ in series.values()], offset)
    parts = []
    for k, (name, (x, df)) in enumerate(series.items()):
        label = F.when(F.col("group").isNull() | is_boundary(F.col("group")), F.lit(name)).otherwise(F.concat(F.lit(name), F.lit(separator), group_label(F.col("group"))))
        y = F.col("y") + F.lit(float(offset or 0.0) * k) if how == "stacked" else F.col("y")
        parts.append(df.select(F.lit(k).alias("position"), F.lit(x).alias("x_column"), label.alias("series"), "x", y.alias("y")))
    return union_all(parts), how
