"""Manifest, catalogue and metadata tables, and what is written.

Tables are Parquet; those that several jobs write are kept by a commit log (``commits.Table``).
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayloom.functions import scalar
from assayloom.operators.characterize import latest_wins
from assayloom.operators.commits import Table  # noqa: F401  a table of a catalogue
from assayloom.sources.shared import shared_folder, stored

#: Driver threads that list tables or run a batch of views; views of a batch; catalogue rows the driver holds at once.
THREADS, VIEWS, ROWS = 8, 100, 1000
PAIR = ["instrument_name", "raw_data_filename"]


def resolve_manifest(registry: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with experiment_id, rows whose name differs from the manifest's).

    Known pairs keep their id; new pairs get the deterministic one.
    """
    known = manifest.select(*PAIR, "experiment_id", F.col("experiment_name").alias("known_name"))
    met = registry.drop("experiment_id").join(known, PAIR, "left")
    out = met.withColumn("experiment_id", F.coalesce("experiment_id", scalar.experiment_id(*map(F.col, PAIR))))
    return out.drop("known_name"), met.filter(F.col("known_name").isNotNull() & (F.col("known_name") != F.col("name"))).select("name", "known_name", *PAIR)


def seed(manifest: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest with the rows it hadn't, the rows inserted)."""
    keys = keys or PAIR
    new = rows.join(manifest, keys, "left_anti").dropDuplicates(keys)
    return manifest.unionByName(new, allowMissingColumns=True), new


def not_yet_stored(registry: DataFrame, catalog: DataFrame, refresh: bool = False, key: str = "experiment_id") -> DataFrame:
    """What still has to be read; everything on refresh."""
    return registry if refresh else registry.join(catalog.select(key).distinct(), key, "left_anti")


def enrich(catalog: DataFrame, metadata: DataFrame, columns: list[str], sidecars: DataFrame | None = None, key: str = "experiment_name", order: list | None = None) -> DataFrame:
    """Catalogue rows filled from the newest metadata row, then from sidecars; empty text counts as missing."""
    filled = catalog
    for right in (metadata, sidecars):
        if right is None:
            continue
        have = [c for c in columns if c in right.columns]
        newest = latest_wins(right, [key], order or [F.desc_nulls_last("updated_at") if "updated_at" in right.columns else F.lit(1)])
        filled = filled.join(newest.select(key, *[F.col(c).cast("string").alias(f"_{c}") for c in have]), key, "left")
        for c in have:
            own = F.nullif(F.col(c).cast("string"), F.lit("")) if c in filled.columns else F.lit(None).cast("string")
            filled = filled.withColumn(c, F.coalesce(own, F.nullif(F.col(f"_{c}"), F.lit("")))).drop(f"_{c}")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns if c in filled.columns})


def available(metadata: DataFrame, catalog: DataFrame, key: str = "experiment_name") -> DataFrame:
    """J11."""
    return metadata.join(catalog.select(key).distinct(), key, "left_semi")


def with_views(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results with the registered table of their storage path."""
    return results.join(catalog.select("storage_path", "table_name").dropDuplicates(["storage_path"]), "storage_path", "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], now=None) -> DataFrame:
    """K5 and K6: new rows replace old ones of the same key; created_at is kept, updated_at set."""
    now = now if now is not None else F.current_timestamp()
    fresh = new.drop("created_at", "updated_at").withColumn("created_at", now).withColumn("updated_at", now).withColumn("_new", F.lit(1))
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    first = both.groupBy(*keys).agg(F.min("created_at").alias("_first"))
    return latest_wins(both, keys, [F.desc("_new"), F.desc_nulls_last("updated_at")]).join(first, keys).withColumn("created_at", F.col("_first")).drop("_first", "_new")


def by_experiment(df: DataFrame) -> DataFrame:
    """Each experiment's rows in one task."""
    return df.repartition("instrument_name", "experiment_id")


def write_measurements(df: DataFrame, root: str, together: bool = False) -> None:
    """K1 and K2: Hive layout by instrument and experiment on any Hadoop file system; only touched experiments are replaced.

    Rows are brought together by experiment first, so that a task writes few files; ``together``: they are (``by_experiment``).
    """
    spread = df if together else by_experiment(df)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument_name", "experiment_id").parquet(root)


def stored_rows(spark: SparkSession, root: str, experiments: DataFrame, schema) -> DataFrame:
    """Rows of the experiments (instrument_name, experiment_id) below ``root``; other experiments' folders are pruned before they are read."""
    return spark.read.schema(schema).parquet(root).join(experiments.select("instrument_name", "experiment_id").distinct(), ["instrument_name", "experiment_id"], "left_semi")


def drop_folder(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_twice(df: DataFrame, primary: str, secondary: str, together: bool = False) -> str | None:
    """K3: the first write must succeed; the second's failure is returned as text."""
    kept = df.persist()
    try:
        write_measurements(kept, primary, together)
        try:
            write_measurements(kept, secondary, together)
        except Exception as e:  # the secondary copy is best effort by contract
            return str(e)[:500]
    finally:
        kept.unpersist()
    return None


def provenance(df: DataFrame, reports: DataFrame, backend: str, root: str) -> DataFrame:
    """One row an experiment: what was stored, from which files, under which schema."""
    files = F.sort_array(F.array_distinct(F.filter(F.collect_set(F.trim("source_file")), lambda x: x != "")))
    keys = ["experiment_id", "instrument_name", "type", "model"]
    counted = df.groupBy(*keys, "source_file").agg(F.count("*").alias("rows"))  # sets are made of a row a file
    grouped = counted.groupBy(*keys).agg(F.sum("rows").alias("rows"), files.alias("files"))
    met = grouped.join(reports, "experiment_id", "left")
    storage = F.struct(F.lit(backend).alias("backend"), F.lit("parquet").alias("format"), F.concat(F.lit(root.rstrip("/") + "/instrument_name="), "instrument_name", F.lit("/experiment_id="), "experiment_id").alias("path"), scalar.parser_key(F.col("type"), F.col("model")).alias("parser_key"))
    schema = F.struct(F.col("report.schema_version").alias("version"), F.col("report.schema_applied").alias("applied"), F.size("report.warnings").alias("warning_count"), F.col("report.warnings").alias("warnings"), F.col("report.missing_required_columns").alias("missing_required"))
    return met.select("experiment_id", "rows", F.struct(F.current_timestamp().alias("saved_at"), F.lit("1").alias("version"), storage.alias("storage"), schema.alias("schema"), F.struct(F.col("files"), F.size("files").alias("file_count")).alias("source")).alias("provenance"))


class Views(list):
    """Names of registered views. ``scans``: DataFrames that several views are parts of; ``parts``: of each name its scan and the URI its files lie at."""

    def __init__(self) -> None:
        super().__init__()
        self.scans: list[DataFrame] = []
        self.parts: dict[str, tuple[int, str]] = {}


def _uri(uri: str) -> str:
    """A URI as the files' metadata writes it: file:/a, not file:///a."""
    return re.sub(r"\A([^:/]+):///", r"\1:/", uri)


class _Paths:
    """Looks at paths and footers from the driver; classes are looked up once."""

    def __init__(self, spark: SparkSession) -> None:
        package = spark.sparkContext._jvm.org.apache
        self.path, self.conf = package.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self.open, self.file = package.parquet.hadoop.ParquetFileReader.open, package.parquet.hadoop.util.HadoopInputFile.fromStatus

    def place(self, path: str) -> str | None:
        """The URI of a path that is there; null for a pattern, which Spark's reader has to look up."""
        if set(path) & set("*?[]{}\\"):
            return None
        at = self.path(path)
        fs = at.getFileSystem(self.conf)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        return _uri(fs.makeQualified(at).toUri().toString()).rstrip("/")

    def written_schema(self, path: str) -> str | None:
        """The schema (JSON) that Spark wrote into every file below a path; null where files differ or another program wrote one."""
        told, left = set(), [self.path(path)]
        fs = left[0].getFileSystem(self.conf)
        while left and len(told) < 2:
            for status in fs.listStatus(left.pop()):
                name = status.getPath().getName()
                if name.startswith(("_", ".")):
                    continue
                if status.isDirectory():
                    left.append(status.getPath())
                    continue
                file = self.open(self.file(status, self.conf))
                try:
                    told.add(file.getFileMetaData().getKeyValueMetaData().get("org.apache.spark.sql.parquet.row.metadata"))
                finally:
                    file.close()
        return told.pop() if len(told) == 1 else None


def register_views(spark: SparkSession, catalog: DataFrame, names: list[str] | None = None) -> Views:
    """A temporary view for each catalogue row that can be read; others are skipped, and of one name the last stays.

    ``names``: only these tables, where a query needs a few of a large catalogue. Rows of the same columns are one scan, whose folders a job
    lists, and a view is its own files of the scan: the others are pruned before they are read. A row costs the driver a look at its path, and
    at its files' footers where the catalogue doesn't know the ``columns``; where these aren't Spark's, or differ, it is read by itself.
    """
    wanted = catalog if names is None else catalog.filter(scalar.table_name(F.col("table_name")).isin(list(names)))
    columns = F.col("columns") if "columns" in catalog.columns else F.lit(None).cast("string")
    paths = _Paths(spark)

    def alone(row) -> DataFrame | None:
        try:
            found = spark.read.option("recursiveFileLookup", True)
            return (found.schema(row["columns"]) if row["columns"] else found.option("mergeSchema", True)).parquet(row["storage_path"])
        except Exception:  # a path that is gone must not keep the others from being registered
            return None

    def look(row) -> tuple[str, str] | DataFrame | None:
        """(schema, URI) of a row that can be read with others; else its own DataFrame, null where it can't be read."""
        try:
            place = paths.place(row["storage_path"])
            schema = place and (row["columns"] or paths.written_schema(row["storage_path"]))
        except FileNotFoundError:
            return None
        except Exception:  # Spark's reader tells whether it can be read
            schema = None
        return (schema, place) if schema else alone(row)

    def together(group: list) -> tuple[DataFrame | None, list[tuple[str, DataFrame, str | None]]]:
        """One scan of rows of one schema, and (view, its rows, its URI)."""
        schema = group[0][1][0]
        try:
            scan = spark.read.schema(StructType.fromJson(json.loads(schema)) if not group[0][0]["columns"] else schema).option("recursiveFileLookup", True).parquet(*[row["storage_path"] for row, _ in group])
            if "_metadata" in scan.columns:
                raise ValueError("files can't be told apart")
        except Exception:  # a path that went away since
            return None, [(row["view"], df, None) for row, _ in group if (df := alone(row)) is not None]
        return scan, [(row["view"], scan, place) for row, (_, place) in group]

    def register(view: str, rows: DataFrame, place: str | None) -> None:
        (rows.filter(_below(place)) if place else rows).createOrReplaceTempView(view)

    made, last = Views(), {}
    rows = wanted.select(scalar.table_name(F.col("table_name")).alias("view"), "storage_path", columns.alias("columns")).toLocalIterator()
    with ThreadPoolExecutor(THREADS) as pool:
        while some := list(islice(rows, ROWS)):
            found = {row["view"]: (row, got) for row, got in zip(some, pool.map(look, some)) if got is not None}  # in the catalogue's order
            groups: dict[tuple, list] = {}
            for row, got in found.values():
                if isinstance(got, tuple):
                    groups.setdefault((got[0], bool(row["columns"])), []).append((row, got))
            registered = [(row["view"], got, None, None) for row, got in found.values() if not isinstance(got, tuple)]
            for scan, views in pool.map(together, groups.values()):
                if scan is not None:
                    made.scans.append(scan)
                registered += [(view, df, len(made.scans) - 1 if place else None, place) for view, df, place in views]
            list(pool.map(lambda x: register(x[0], x[1], x[3]), registered))
            last |= {view: (k, place) for view, _, k, place in registered}
    made.extend(last)
    made.parts = {view: (k, place) for view, (k, place) in last.items() if place}
    return made


def _below(place: str) -> str:
    """The condition that a row's file is ``place`` or lies below it."""
    at = place.replace("\\", "\\\\").replace("'", "\\'")
    return f"_metadata.file_path = '{at}' or startswith(_metadata.file_path, '{at}/')"


def query_views(spark: SparkSession, views: list[str], columns: str, sql: str, size: int = VIEWS) -> DataFrame:
    """E6 over many views: ``sql`` over {views}, which has the ``columns`` (names) of each view and its name as ``dataset``.

    Views that are parts of one scan are one query, others are in batches of ``size``; its result is written, so that no plan grows with the
    catalogue. ``sql`` has to treat each dataset by itself (as a grouping by dataset does). Without views there are no columns to answer from: an error.
    """
    if not views:
        raise ValueError("no view can be read")
    folder = shared_folder(spark)
    parts, scans = getattr(views, "parts", {}), getattr(views, "scans", [])
    mine: list[dict[str, list[str]]] = [{} for _ in scans]
    for view, (k, place) in parts.items():
        mine[k].setdefault(place, []).append(view)
    others = [v for v in views if v not in parts]

    def run(k: int, rows: str) -> DataFrame:
        out = query(spark, sql.format(views=f"({rows})"))
        out.write.parquet(f"{folder}/batch={k}")
        return out

    def of_scan(k: int) -> DataFrame:
        scan, name = scans[k], f"scan_{uuid.uuid4().hex}"
        at, view = f"file_{name}", f"view_{name}"  # names that no column has
        upto = lambda f: (f[:n] for n in range(1, len(f) + 1) if n == len(f) or f[n] == "/")  # noqa: E731  the file and the folders it lies in
        owned = [(f, v) for f in map(_uri, scan.inputFiles()) for place in upto(f) for v in mine[k].get(place, ())]
        owners = stored(spark.createDataFrame(owned, f"{at} string, {view} string").coalesce(1), shared_folder(spark), "owners")
        met = scan.withColumn(at, F.col("_metadata.file_path")).join(owners, at).drop(at)
        met.createOrReplaceTempView(name)
        try:
            return run(k, f"select {view} as dataset, {columns} from {name}")
        finally:
            spark.catalog.dropTempView(name)

    def of_names(k: int) -> DataFrame:
        return run(len(scans) + k, " union all ".join(f"select '{v}' as dataset, {columns} from {v}" for v in others[k : k + size]))

    with ThreadPoolExecutor(THREADS) as pool:
        done = [*pool.map(of_scan, [k for k, m in enumerate(mine) if m]), *pool.map(of_names, range(0, len(others), size))]
    return spark.read.schema(done[0].schema).option("recursiveFileLookup", True).parquet(folder)


def remove(spark: SparkSession, catalog: DataFrame, table_name: str) -> DataFrame:
    """K8: the catalogue without a table, whose view is dropped; the files stay. An unknown table is an error."""
    if catalog.filter(F.col("table_name") == table_name).isEmpty():
        raise KeyError(table_name)
    spark.catalog.dropTempView(table_name)
    return catalog.filter(F.col("table_name") != table_name)


def remove_all(spark: SparkSession, catalog: DataFrame, names: DataFrame) -> DataFrame:
    """K8 for many tables (table_name): as ``remove`` of each, by one join."""
    gone = names.select("table_name").distinct()
    unknown = gone.join(catalog.select("table_name"), "table_name", "left_anti").first()
    if unknown is not None:
        raise KeyError(unknown["table_name"])
    for r in gone.toLocalIterator():
        spark.catalog.dropTempView(r["table_name"])
    return catalog.join(gone, "table_name", "left_anti")


def snapshot(registry: DataFrame, names: list[str], root: str, run_id: str) -> str:
    """The chosen registry rows as the run's Parquet snapshot."""
    path = f"{root.rstrip('/')}/{run_id}"
    registry.filter(F.col("name").isin(list(names))).write.parquet(path)
    return path


def query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """E6."""
    return spark.sql(sql, args=params or {})
