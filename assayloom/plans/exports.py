"""Queries over raw exports: a table's rows are written as instrument text files by Spark and read back by the real readers.

A run is a range of ``ORDERS`` orders, so there are more runs in a larger table and a file stays small; or it is what a nation's suppliers
delivered (``delivered``), so that files grow with the table. Files lie in the shared folder ``spark.checkpoint.dir``, in a new folder for each call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import scalar
from assayloom.operators import catalog, normalize, select, validate
from assayloom.plans import ingest as plan
from assayloom.plans.queries import query, table
from assayloom.sources import files, registry, text
from assayloom.sources.shared import shared_folder, stored
from assayloom.streaming import ingest as stream

ORDERS = 2048
_POINTS = "with points as (select (l_orderkey // 2048)::int as run, l_orderkey * 10 + l_linenumber as idx, l_quantity as x, l_extendedprice as y, l_discount as z from lineitem)\n"
_DELIVERED = "with points as (select s_nationkey as run, l_orderkey * 10 + l_linenumber as idx, l_quantity as x, l_extendedprice as y, l_discount as z from lineitem join supplier on l_suppkey = s_suppkey)\n"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def exported(spark: SparkSession, rows: DataFrame, line, head: str, foot: str = "", end: str = "\n", folder: str | None = None) -> str:
    """Folder with one text file a run: ``head``, a ``line`` (column) for each row of ``rows``, ``foot``.

    Lines are sorted and written one by one, so a run may be larger than a task's memory.
    """
    folder = folder or shared_folder(spark)
    lines = rows.select("run", F.lit(1).alias("part"), F.col("idx").cast("long").alias("idx"), line.alias("value")).filter("value is not null")
    around = [F.struct(F.lit(part).alias("part"), F.lit(own).alias("value")) for part, own in ((0, head.removesuffix(end)), (2, foot.removeprefix(end))) if (head, foot)[part // 2]]
    if around:
        ends = rows.select("run").distinct().select("run", F.inline(F.array(*around)))
        lines = lines.unionByName(ends.withColumn("idx", F.lit(0).cast("long")))
    lines.repartition("run").sortWithinPartitions("run", "part", "idx", "value").select("run", "value").write.mode("append").option("lineSep", end).partitionBy("run").text(folder)
    return folder


def _run():
    return F.substring_index(F.substring_index("source_file", "run=", -1), "/", 1).try_cast("int").alias("run")


def _numbers(rows: DataFrame, **columns: str) -> DataFrame:
    found = rows.select("source_file", *[F.try_element_at("raw", F.lit(raw)).alias(name) for name, raw in columns.items()])  # looked up once, used twice
    return found.select(_run(), *[scalar.to_number(F.col(name)).alias(name) for name in columns])


_ROWS = "select run, idx::double as idx, x, y from points"
_ALL = _POINTS + _ROWS


@query(_DELIVERED + _ROWS)
def export_sectioned(spark, sf_dir):
    """Preamble, start marker, units, rows, end marker and what follows it."""
    line = F.concat_ws("   ", F.lit(" "), "idx", "x", "y")
    folder = exported(spark, delivered(spark, sf_dir), line, "Report 1.0\n\n  Index   Tr   Value\n          [°C]   [mW]\n", "\nResults:\n 1 2 3\n")
    return _numbers(text.parsed(text.read_lines(spark, folder), "dsc", "prior")[0], idx="Index", x="Tr [°C]", y="Value [mW]")


@query(_DELIVERED + _ROWS)
def export_signals(spark, sf_dir):
    """S5."""
    folder = exported(spark, delivered(spark, sf_dir), F.concat_ws("\t", "idx", "x", "y"), "Instrument\tq\nSig1\tCount\nSig2\tFrequency\nSig3\tStorage\nStartOfData\n")
    return _numbers(text.parsed(text.read_lines(spark, folder), "dma", "ta_q800")[0], idx="count", x="frequency", y="storage")


@query(_DELIVERED + "select run, idx::double as idx, x, y from points where run % 5 <> 3")
def export_strict(spark, sf_dir):
    """One bad number makes its file bad, the others are read."""
    line = F.concat_ws(",", "idx", "x", F.when((F.col("run") % 5 == 3) & (F.col("idx") % 10 == 1), F.lit("n/a")).otherwise(F.col("y").cast("string")))
    folder = exported(spark, delivered(spark, sf_dir), line, "exported by hand\nn,Wavenumber,Absorbance\n")
    return _numbers(text.parsed(text.read_lines(spark, folder), "ftir", "bruker")[0], idx="n", x="Wavenumber", y="Absorbance")


@query(_POINTS + "select distinct run, 'a value is no number' as reason from points where run % 5 = 3 and idx % 10 = 1 union all select distinct run, 'no data rows' from points where run % 5 = 4")
def export_bad_files(spark, sf_dir):
    """Which files failed, and why."""
    p = points(spark, sf_dir)
    line = F.when(F.col("run") % 5 == 4, F.lit("")).otherwise(F.concat_ws(",", "idx", F.when((F.col("run") % 5 == 3) & (F.col("idx") % 10 == 1), F.lit("n/a")).otherwise(F.col("y").cast("string"))))
    folder = exported(spark, p, line, "exported by hand\nn,Absorbance\n")
    return text.parsed(text.read_lines(spark, folder), "ftir", "bruker")[1].select(_run(), "reason")


@query(_DELIVERED + "select run, idx::double as idx, x from points")
def export_headerless(spark, sf_dir):
    """S7."""
    folder = exported(spark, delivered(spark, sf_dir), F.concat_ws(",", "idx", "x"), "")
    return _numbers(text.parsed(text.read_lines(spark, folder), "sec", "agilent")[0], idx="time (min)", x="value")


@query(_DELIVERED + """
select run, mz, first(x order by idx, x::varchar) as x, row_number() over (partition by run order by mz) - 1 as row_idx, mz in (select x from points q where q.run = g.run and q.z > 0.09) as peaks
from (select run, idx, floor(y / 1000) as mz, x from points union all select run, idx + 1152921504606846976, x, 1 from points where z > 0.09) g group by run, mz""")
def export_mass_spectrum(spark, sf_dir):
    """A run's points in any order with repeated m/z, and its peak list after them."""
    p = delivered(spark, sf_dir)
    main = p.select("run", "idx", F.concat_ws(",", F.floor(F.col("y") / 1000).cast("string"), "x").alias("line"))
    peaks = p.filter("z > 0.09").select("run", (F.col("idx") + F.lit(1 << 60)).alias("idx"), F.concat_ws(",", F.col("x").cast("long"), F.lit("1")).alias("line"))
    mark = p.select("run").distinct().select("run", F.lit(1 << 59).alias("idx"), F.lit("Peak list").alias("line"))
    folder = exported(spark, main.unionByName(peaks).unionByName(mark), F.col("line"), "")
    rows, _ = text.parsed(text.read_lines(spark, folder), "ms", "bruker")
    return rows.select(_run(), scalar.to_number(text.column("m/z")).alias("mz"), scalar.to_number(text.column("intensity")).alias("x"), "row_idx", "peaks")


@query(_DELIVERED + "select run, idx::double as idx, x, y from points where z > 0")
def export_header_csv(spark, sf_dir):
    """Incomplete rows are left out."""
    line = F.concat_ws(",", "idx", "x", F.when(F.col("z") > 0, F.col("y").cast("string")).otherwise(F.lit("")))
    return _numbers(text.parsed(text.read_lines(spark, exported(spark, delivered(spark, sf_dir), line, "n,q,I\n")), "saxs", "anton_paar")[0], idx="n", x="q", y="I")


@query(_DELIVERED + _ROWS)
def export_two_row_header(spark, sf_dir):
    """Names from two header lines; two columns are dropped."""
    line = F.concat_ws("\t", F.lit(""), F.lit("1"), "idx", "x", "y")
    head = "a\nb\nc\nd\nInterval data:\tPoint No.\tn\tw\tG'\nx\n\t\t\t[rad/s]\t[Pa]\n"
    return _numbers(text.parsed(text.read_lines(spark, exported(spark, delivered(spark, sf_dir), line, head)), "rheometer", "anton_paar")[0], idx="n", x="w [rad/s]", y="G' [Pa]")


@query(_DELIVERED + "select run, x * 20 as x, y, timestamp '2024-01-05 09:00:00' as at from points where x * 20 between 280 and 900")
def export_spectrum(spark, sf_dir):
    """The time of the Date line, and the two columns after the mark within the range of wavelengths."""
    head = "Date: Fri Jan 05 10:00:00 CET 2024\nNumber of Pixels in Spectrum: 3\n>>>>>Begin\nheader\n"
    rows, _ = text.parsed(text.read_lines(spark, exported(spark, delivered(spark, sf_dir), F.concat_ws("\t", F.col("x") * 20, "y"), head)), "uv_vis", "flame")
    return rows.select(_run(), scalar.to_number(text.column("wavelength (nm)")).alias("x"), scalar.to_number(text.column("transmission")).alias("y"), F.date_trunc("second", "timestamp").alias("at"))


@query(_ALL)
def export_shimadzu(spark, sf_dir):
    """A title line, a header, tab-separated rows with line ends of another system."""
    folder = exported(spark, points(spark, sf_dir), F.concat_ws("\t", "idx", "x", "y"), '"title"\r\n"n"\t"Wavelength (nm)"\t"Absorbance"\r\n', "\r\n", "\r\n")
    return _numbers(text.parsed(text.read_lines(spark, folder), "uv_vis", "Shimadzu")[0], idx="n", x="Wavelength (nm)", y="Absorbance")


@query(_DELIVERED + "select run, idx::double as idx, x * 2 as doubled from points where x > 25")
def export_plug_in(spark, sf_dir):
    """A user's parser that returns a bare DataFrame."""

    @text.parser("example", "doubling")
    def doubling(lines):
        cells = F.split("line", ";")
        return lines.select("source_file", "line_no", F.create_map(F.lit("n"), cells[0], F.lit("v"), (cells[1].cast("double") * 2).cast("string")).alias("raw")).filter(cells[1].cast("double") > 25)

    return _numbers(text.parsed(text.read_lines(spark, exported(spark, delivered(spark, sf_dir), F.concat_ws(";", "idx", "x"), "")), "example", "doubling")[0], idx="n", doubled="v")


@query(_POINTS + "select run, count(*) as files from (select distinct run from points) group by run")
def export_listing(spark, sf_dir):
    """S3: files below a folder, without their contents."""
    listed = files.list_files(spark, exported(spark, points(spark, sf_dir), F.col("x").cast("string"), "x\n")).filter("length > 2")
    return listed.withColumnRenamed("path", "source_file").filter(F.col("source_file").contains("/run=")).groupBy(_run()).agg(F.count("*").alias("files"))


@query(_POINTS + "select run, count(*) + 1 as lines from points group by run")
def export_stream(spark, sf_dir):
    """Every file is handed on once, also when the stream is run again."""
    folder, out = exported(spark, points(spark, sf_dir), F.col("x").cast("string"), "x\n"), shared_folder(spark)
    take = lambda df, k: text.lines_of(df).groupBy("source_file").agg(F.count("*").alias("lines")).write.mode("append").parquet(f"{out}/lines")
    for _ in range(2):
        stream.run_incremental(spark, folder, f"{out}/checkpoint", take)
    return spark.read.schema("source_file string, lines long").parquet(f"{out}/lines").select(_run(), "lines")


def _laboratory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, experiments (written: they are asked for many times) and instruments: even runs belong to a calorimeter, odd ones to a spectrometer, each with a folder of its own."""
    p = points(spark, sf_dir)
    instrument = F.when(F.col("run") % 2 == 0, "cal").otherwise("spec")
    rows = p.select("run").distinct().select(F.concat(F.lit("exp "), "run").alias("name"), instrument.alias("instrument_name"), F.concat(F.lit("run="), "run").alias("raw_data_filename"))
    devices = spark.createDataFrame([("cal", "dsc", "prior", "calorimeter", ("dsc_profiling", 0.1)), ("spec", "ftir", "bruker", "infrared", None)], "name string, type string, model string, folder_name string, characterizer struct<type: string, sensitivity: double>")
    return p, registry.experiments(stored(rows, shared_folder(spark), "registry")), devices


def _measured(p: DataFrame, raw: str) -> None:
    """Raw exports of the points' runs below ``raw``, as their instruments write them."""
    exported(p.sparkSession, p.filter("run % 2 = 0"), F.concat_ws("   ", F.lit(" "), "idx", "idx", "x", "y"), "Report\n  Index   t   Tr   Value\n       [s]   [°C]   [mW]\n", "\nResults:\n", folder=f"{raw}/calorimeter")
    exported(p.sparkSession, p.filter("run % 2 = 1"), F.concat_ws(",", "x", "y"), "exported by hand\nWavenumber,Absorbance\n", folder=f"{raw}/infrared")


_INGESTED = _POINTS + "select 'exp ' || run as experiment, case when run % 2 = 0 then x end as temperature, case when run % 2 = 0 then y end as heat, case when run % 2 = 1 then x end as wavenumber, case when run % 2 = 1 then y end as absorbance from points"


def _ingested(spark: SparkSession, store: str) -> DataFrame:
    """All rows of a store under the names of its catalogue."""
    known = catalog.Table(spark, f"{store}/catalog", plan.CATALOG).read().select("experiment_id", F.col("experiment_name").alias("experiment"))
    wanted = {"temperature": "temperature_C", "heat": "heat_flow_mW", "wavenumber": "wavenumber_cm_inv", "absorbance": "absorbance_a_u"}
    parts = []
    for kind in ("dsc", "ftir"):
        rows = registry.scan_storage(spark, f"{store}/data/{kind}", partitioned=True).join(known, "experiment_id")
        parts.append(rows.select("experiment", *[(F.col(c) if c in rows.columns else F.lit(None).cast("double")).alias(name) for name, c in wanted.items()]))
    return parts[0].unionByName(parts[1])


@query(_INGESTED)
def ingest_store(spark, sf_dir):
    """Two thirds of the experiments are ingested, then all, of which the first are registered; the store is read back."""
    p, experiments, devices = _laboratory(spark, sf_dir)
    raw, store = shared_folder(spark), shared_folder(spark)
    _measured(p, raw)
    plan.ingest(spark, experiments.filter(~F.col("name").endswith("3")), devices, raw, store)
    plan.ingest(spark, experiments, devices, raw, store)
    return _ingested(spark, store)


@query(_INGESTED)
def ingest_stream(spark, sf_dir):
    """Files that come in two portions are ingested up to the catalogue by a stream; the store is read back."""
    p, experiments, devices = _laboratory(spark, sf_dir)
    raw, store, checkpoint = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    for part in ("run % 3 <> 0", "run % 3 = 0"):
        _measured(p.filter(part), raw)
        stream.ingest_new(spark, experiments, devices, raw, store, checkpoint)
    return _ingested(spark, store)


@query("select lower(trim(' DSC_' || n_nationkey || ' ')) as name, 'dsc' as type, 'prior' as model, 'folder ' || n_nationkey as folder_name, n_nationkey / 100.0 as sensitivity from nation")
def instrument_config(spark, sf_dir):
    """An instrument configuration written as one JSON array and read with folded names."""
    n, folder = table(spark, sf_dir, "nation"), shared_folder(spark)
    entry = F.struct(F.concat(F.lit(" DSC_"), "n_nationkey", F.lit(" ")).alias("name"), F.lit("dsc").alias("type"), F.lit("prior").alias("model"), F.concat(F.lit("folder "), "n_nationkey").alias("folder_name"), F.struct((F.col("n_nationkey") / 100).alias("sensitivity")).alias("characterizer"))
    n.agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(folder)  # a configuration
    return registry.read_instruments(spark, folder).select("name", "type", "model", "folder_name", F.col("characterizer.sensitivity").alias("sensitivity"))


@query("select c_name as name, c_nationkey::varchar as instrument_name from customer where c_name in (select c_name from customer where c_custkey % 50 = 1)")
def registry_snapshot(spark, sf_dir):
    """The chosen registry rows as a job's snapshot."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("instrument_name"))
    names = [r["name"] for r in c.filter("c_custkey % 50 = 1").select("name").collect()]  # the names a user gives
    return spark.read.parquet(catalog.snapshot(c.drop("c_custkey"), names, shared_folder(spark), "job 1"))


@query("select 'n' || s_nationkey as experiment_id, 'data ' || s_nationkey as dataset_name, s_nationkey::varchar as nation, max(s_suppkey)::varchar as newest from supplier group by s_nationkey")
def sidecar_files(spark, sf_dir):
    """A metadata file for each dataset; files that are none give no row."""
    s, folder = table(spark, sf_dir, "supplier"), shared_folder(spark)
    known = s.groupBy("s_nationkey").agg(F.max("s_suppkey").cast("string").alias("newest")).withColumn("place", F.col("s_nationkey"))
    about = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("newest"), F.col("newest"))
    known.select("place", F.concat(F.lit("n"), "s_nationkey").alias("experiment_id"), F.concat(F.lit("data "), "s_nationkey").alias("dataset_name"), about.alias("metadata")).write.partitionBy("place").json(folder)
    known.select((F.col("place") + 1000).alias("place"), F.lit("oops").alias("other")).write.mode("append").partitionBy("place").json(folder)
    return registry.read_sidecars(spark, folder).select("experiment_id", "dataset_name", F.col("metadata.nation").alias("nation"), F.col("metadata.newest").alias("newest"))


def _catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of points, one a run, with their catalogue: some have a column more, some paths are gone."""
    root, p = shared_folder(spark), points(spark, sf_dir)
    for part, columns in (("run % 3 = 0", ["x", "y", "z"]), ("run % 3 <> 0", ["x", "y"])):
        p.filter(part).select("run", *columns).withColumn("dataset", F.col("run")).repartition("dataset").write.mode("append").partitionBy("dataset").parquet(root)
    runs = p.select("run").distinct()
    lost = runs.filter("run % 4 = 1").select((F.col("run") + 100000).alias("run"))
    known = F.when(F.col("run") % 3 == 0, "run int, x double, y double, z double").when(F.col("run") % 2 == 0, "run int, x double, y double")  # of some the catalogue doesn't know the columns
    rows = runs.union(lost).select(F.concat(F.lit("run "), "run").alias("table_name"), F.concat(F.lit(root + "/dataset="), "run").alias("storage_path"), known.alias("columns"))
    return stored(rows, shared_folder(spark), "catalogue")


@query(_POINTS + "select 'run_' || run as dataset, count(*) as rows, round(sum(y), 2) as total from points where run % 5 <> 2 group by run")
def catalogue_views(spark, sf_dir):
    """Views of a catalogue, some of them removed, what can't be read left out; each view is read by SQL."""
    known = _catalogued(spark, sf_dir)
    known = catalog.remove_all(spark, known, known.filter("cast(substr(table_name, 5) as int) % 5 = 2 and cast(substr(table_name, 5) as int) < 100000"))  # the names a user removes
    made = catalog.register_views(spark, known)
    return catalog.query_views(spark, made, "y", "select dataset, count(*) as rows, round(sum(y), 2) as total from {views} group by dataset")


@query(_POINTS + "select run, x, y, case when run % 3 = 0 then z end as z from points where run = 3")
def stored_dataset(spark, sf_dir):
    """A dataset by its catalogue name."""
    return registry.read_dataset(spark, _catalogued(spark, sf_dir), "run 3").select("run", "x", "y", "z")


@query("""
select s_name as name, lower(trim(' DSC_' || s_nationkey || ' ')) as instrument_name, s_name || '.txt' as raw_data_filename, case when s_suppkey % 2 = 0 then 'note ' || s_suppkey end as remark from supplier""")
def registry_files(spark, sf_dir):
    """A registry written as CSV and read as experiments, blanks as nulls, other columns as extras."""
    s, folder = table(spark, sf_dir, "supplier"), shared_folder(spark)
    rows = s.select(F.concat(F.lit(" "), "s_name").alias("name"), F.concat(F.lit(" DSC_"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("instrument_name"), F.concat("s_name", F.lit(".txt")).alias("raw_data_filename"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("note "), "s_suppkey")).otherwise(F.lit("  ")).alias("remark"))
    rows.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return registry.experiments(registry.read_registry(spark, folder)).select("name", "instrument_name", "raw_data_filename", F.try_element_at("metadata", F.lit("remark")).alias("remark"))


@query(_POINTS + "select 'n' || run as experiment_id, count(*) as rows, round(sum(case when run = 3 then 0 else y end), 2) as total from points group by run")
def stored_measurements(spark, sf_dir):
    """Written by experiment, one experiment replaced, all read back."""
    root = shared_folder(spark)
    p = points(spark, sf_dir).select(F.concat(F.lit("n"), "run").alias("experiment_id"), F.lit("dsc").alias("instrument_name"), "y")
    catalog.write_measurements(p, root)
    catalog.write_measurements(p.filter("experiment_id = 'n3'").withColumn("y", F.lit(0.0)), root)
    return spark.read.parquet(root).groupBy("experiment_id").agg(F.count("*").alias("rows"), F.round(F.sum("y"), 2).alias("total"))


@query(_POINTS + "select 'n' || run as experiment_id, 2 * count(*) as rows from points group by run")
def stored_twice(spark, sf_dir):
    """K3."""
    root = shared_folder(spark)
    p = points(spark, sf_dir).select(F.concat(F.lit("n"), "run").alias("experiment_id"), F.lit("dsc").alias("instrument_name"), "y")
    catalog.write_twice(p, f"{root}/a", f"{root}/b")
    return spark.read.parquet(f"{root}/a").unionByName(spark.read.parquet(f"{root}/b")).groupBy("experiment_id").agg(F.count("*").alias("rows"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new' else 'old' end as state from customer union all select c_custkey + 1000000000, 'added' from customer where c_custkey % 10 = 0")
def catalogue_versions(spark, sf_dir):
    """A table replaced by its upsert, then appended to."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    t = catalog.Table(spark, shared_folder(spark), "c_custkey long, state string, created_at timestamp, updated_at timestamp")
    t.replace(catalog.upsert(t.read(), c.withColumn("state", F.lit("old")), ["c_custkey"]))
    t.replace(catalog.upsert(t.read(), c.filter("c_custkey % 3 = 0").withColumn("state", F.lit("new")), ["c_custkey"]))
    t.append(c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit("added").alias("state"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")))
    return t.read().select("c_custkey", "state")


@query("select o_orderpriority, count(*) as n from orders where o_totalprice > 1000 and o_orderstatus = 'F' group by o_orderpriority")
def parameter_query(spark, sf_dir):
    """SQL with named parameters over a registered view."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("assayloom_orders")
    return catalog.query(spark, "select o_orderpriority, count(*) as n from assayloom_orders where o_totalprice > :least and o_orderstatus = :status group by o_orderpriority", {"least": 1000, "status": "F"})


@query("select p_partkey, p_brand as detector_name from part where p_brand = (select min(p_brand) from part)")
def detector_filter(spark, sf_dir):
    """P18."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("detector_name"))
    return select.detector(p, p.agg(F.min("detector_name")).first()[0])


@query("select c_name as name from customer where c_custkey % 4 <> 0")
def named_rows(spark, sf_dir):
    """P23."""
    c = table(spark, sf_dir, "customer")
    return normalize.named_rows(c.select(F.when(F.col("c_custkey") % 8 == 0, F.lit("")).when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name")))


@query("select 'duplicate name ''' || p_brand || ''' for instrument ''' || p_type || '''' as message from part group by p_brand, p_type having count(*) > 1")
def duplicate_names_as_files(spark, sf_dir):
    """A3: without a file column names count as files."""
    return validate.duplicate_files(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("instrument_name")))


@query("""
select o_orderkey, coalesce(case when o_orderstatus = 'F' then o_orderdate end, o_orderdate - interval 1 day) as changed, case when o_totalprice < 50000 then null else o_totalprice end as price,
       case when o_orderkey % 3 = 0 then 0 else 2 end::int as items from orders""")
def change_and_number_functions(spark, sf_dir):
    """F19, F20 and F21."""
    o = table(spark, sf_dir, "orders")
    items = F.when(F.col("o_orderkey") % 3 == 0, F.lit("[broken")).otherwise(F.lit('["a", "b"]'))
    price = F.when(F.col("o_totalprice") < 50000, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    changed = scalar.last_change(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.col("o_orderdate") - F.expr("interval 1 day"))
    return o.select("o_orderkey", changed.alias("changed"), scalar.no_nan(price).alias("price"), F.size(scalar.json_array(items)).alias("items"))
