"""Registered queries of the measurement operators, each with its SQL where SQL can say it.

The driver's tables stand in for measurements: events are instrument runs (run user_id, order ts and event_id,
temperature in steps of value / 50), lineitem rows are points, customers, orders and parts are registries and catalogues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import scalar, schemas
from assayloom.operators import catalog, characterize, compare, features, normalize, select, series, validate
from assayloom.plans import datasets
from assayloom.sources import files, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c, name: str):
    return scalar.rounded(c if isinstance(c, Column) else F.col(c), 4).alias(name)


# --- runs and segments -------------------------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", F.floor(F.col("value") / 50).cast("double").alias("x"))


_LABELS = """
with e as (select event_id, user_id, ts, value, floor(value / 50)::double as x from events),
a as (select *, x - lag(x) over w as d from e window w as (partition by user_id order by ts, event_id)),
b as (select *, d - lag(d) over w as d2 from a window w as (partition by user_id order by ts, event_id)),
c as (select *, case when d2 < -0.1 then case when d is not null and d <> 0 then 'Cooling_start' else 'Heating_end' end
                     when d2 > 0.1 then case when d is not null and d <> 0 then 'Heating_start' else 'Cooling_end' end
                     when d > 0 then 'Heating' when d < 0 then 'Cooling' else 'Isothermal' end as base from b),
f as (select *, lag(base, 1, '') over (partition by user_id order by ts, event_id) as before from c),
g as (select *, sum((base = 'Heating_end')::int) over w as heat, sum((base = 'Cooling_end')::int) over w as cool,
             sum((base = 'Isothermal' and before <> 'Isothermal')::int) over w - 1 as iso
      from f window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
labelled as (select event_id, user_id, value, x,
             case when base in ('Heating_end', 'Cooling_end') then base
                  when base like 'Heating%' then base || '_' || heat::bigint
                  when base like 'Cooling%' then base || '_' || cool::bigint else base || '_' || iso::bigint end as profile from g)
"""


@query("""
with e as (select event_id, user_id, ts, value, value - lag(value) over (partition by user_id order by ts, event_id) as d from events)
select event_id, round(d, 4) as d, round(d - lag(d) over (partition by user_id order by ts, event_id), 4) as d2 from e""")
def diff2(spark, sf_dir):
    out = characterize.differences(_runs(spark, sf_dir), "value", ["user_id"], ["ts", "event_id"])
    return out.select("event_id", r4("d", "d"), r4("d2", "d2"))


@query(_LABELS + "select event_id, user_id, profile from labelled")
def segment_labels(spark, sf_dir):
    out = characterize.segment_labels(_runs(spark, sf_dir), "x", ["user_id"], ["ts", "event_id"], 0.1)
    return out.select("event_id", "user_id", "profile")


@query(_LABELS + "select user_id, profile, count(*) as points, round(max(value), 4) as peak, round(min(value), 4) as low, round(sum(value), 2) as total from labelled group by user_id, profile")
def segment_features(spark, sf_dir):
    labelled = characterize.segment_labels(_runs(spark, sf_dir), "x", ["user_id"], ["ts", "event_id"], 0.1)
    out = features.features(labelled, ["user_id", "profile"], {"points": ("count", "value"), "peak": ("max", "value"), "low": ("min", "value"), "total": ("sum", "value")})
    return out.select("user_id", "profile", "points", r4("peak", "peak"), r4("low", "low"), F.round("total", 2).alias("total"))


@query(_LABELS + "select profile, count(*) as n, count(distinct user_id) as runs from labelled where regexp_matches(lower(profile), 'start|end') group by profile")
def boundary_labels(spark, sf_dir):
    labelled = characterize.segment_labels(_runs(spark, sf_dir), "x", ["user_id"], ["ts", "event_id"], 0.1)
    return labelled.filter(scalar.is_boundary(F.col("profile"))).groupBy("profile").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("runs"))


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when hi = lo then 0 else (l_quantity - lo) / nullif(hi - lo, 0) * 100 end, 4) as mass_pct
from (select *, min(l_quantity) over (partition by l_suppkey) as lo, max(l_quantity) over (partition by l_suppkey) as hi from lineitem)""")
def minmax_pct(spark, sf_dir):
    out = characterize.mass_percent(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r4("mass_pct", "mass_pct"))


@query("""
select event_id, round(value / first_value(value) over (partition by user_id order by ts, event_id) * 100, 4) as mass_pct from events""")
def initial_mass_pct(spark, sf_dir):
    out = characterize.mass_percent(table(spark, sf_dir, "events"), "value", ["user_id"], mode="initial", order=["ts", "event_id"])
    return out.select("event_id", r4("mass_pct", "mass_pct"))


@query("select o_custkey, o_orderkey, round(o_totalprice, 4) as o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n = 1")
def first_wins_dedup(spark, sf_dir):
    return characterize.first_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", r4("o_totalprice", "o_totalprice"))


@query("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) as n from orders) where n = 1")
def latest_wins_dedup(spark, sf_dir):
    return characterize.latest_wins(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("select event_type, min(event_id) as first_row from events group by event_type")
def appearance_order(spark, sf_dir):
    return characterize.appearance_order(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(_LABELS + "select event_id, user_id, profile from labelled")
def segment_labels_scanned(spark, sf_dir):
    """W1 to W4 by a segmented prefix scan: a run's rows are spread over its days."""
    out = characterize.scanned_labels(_runs(spark, sf_dir), "x", ["user_id"], ["ts", "event_id"], 0.1, F.unix_date(F.to_date("ts")).cast("long"))
    return out.select("event_id", "user_id", "profile")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when hi = lo then 0 else (l_quantity - lo) / nullif(hi - lo, 0) * 100 end, 4) as mass_pct
from (select *, min(l_quantity) over (partition by l_returnflag) as lo, max(l_quantity) over (partition by l_returnflag) as hi from lineitem)""")
def minmax_pct_large(spark, sf_dir):
    """W5 where a third of all rows are one run."""
    out = characterize.mass_percent(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"], large=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r4("mass_pct", "mass_pct"))


@query("select user_id, count(*) as points, round(max(value) - min(value), 4) as height from events group by user_id")
def user_characteriser(spark, sf_dir):
    """A registered hook over each run."""

    @characterize.characteriser("height")
    def make(by: str):
        return lambda df: df.groupBy(by).agg(F.count("*").alias("points"), r4(F.max("value") - F.min("value"), "height"))

    return characterize.characterize(table(spark, sf_dir, "events"), "height", by="user_id")[0]


# --- normalisation -----------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as temperature_C, l_extendedprice as heat_flow_mW, l_tax as time_s, l_returnflag from lineitem")
def alias_normalize(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("string").alias("Tr [°C]"), F.col("l_extendedprice").cast("string").alias("Value [mW]"), F.col("l_tax").alias("Time [s]"), "l_returnflag")
    return normalize.normalize(raw, "dsc", "prior")[0]


@query("""
select o_orderkey, case when o_orderkey % 2 = 0 then o_totalprice end as absorbance_a_u, case when o_orderkey % 2 = 0 then o_custkey::double end as wavenumber_cm_inv,
       case when o_orderkey % 2 = 1 then o_totalprice end as mass_mg, case when o_orderkey % 2 = 1 then o_custkey::double end as temperature_C from orders""")
def normalize_mixed(spark, sf_dir):
    """Two types of experiments in one pass, raw columns as maps."""
    o = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    price, cust = F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    rows = o.select(
        "o_orderkey", F.concat(F.when(even, "f").otherwise("t"), (F.col("o_custkey") % 100).cast("string")).alias("experiment_id"), F.when(even, "ftir").otherwise("tga").alias("type"), F.when(even, "bruker").otherwise("tgaX").alias("model"), F.lit(None).cast("string").alias("profile"),
        F.when(even, F.create_map(F.lit("Absorbance"), price, F.lit("Wavenumber"), cust)).otherwise(F.create_map(F.lit("Mass [mg]"), price, F.lit("Temperature [C]"), cust)).alias("raw"),
    )
    tidy, _ = normalize.normalize_mixed(rows, [("ftir", "bruker", None), ("tga", "tgaX", None)])
    return normalize.canonical_columns(tidy, ["absorbance_a_u", "wavenumber_cm_inv", "mass_mg", "temperature_C"]).drop("experiment_id", "type", "model", "profile")


@query("""
select case when o_orderkey % 2 = 0 then 'f' else 't' end || (o_custkey % 100) as experiment_id, true as schema_applied, '1.0' as schema_version, case when o_orderkey % 2 = 0 then 'Wavenumber' else 'Temperature' end as renamed_from,
       case when o_orderkey % 2 = 0 then [] else ['mass_mg'] end as missing_required_columns, []::varchar[] as warnings, null::varchar as measurement_profile,
       case when o_orderkey % 2 = 0 then ['base', 'model:bruker'] else ['base', 'model:tgaX'] end as layers_applied from orders group by all""")
def normalization_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    rows = o.select(F.concat(F.when(even, "f").otherwise("t"), (F.col("o_custkey") % 100).cast("string")).alias("experiment_id"), F.when(even, "ftir").otherwise("tga").alias("type"), F.when(even, "bruker").otherwise("tgaX").alias("model"), F.lit(None).cast("string").alias("profile"), F.create_map(F.when(even, "Wavenumber").otherwise("Temperature"), F.col("o_custkey").cast("string")).alias("raw"))
    _, reports = normalize.normalize_mixed(rows, [("ftir", "bruker", None), ("tga", "tgaX", None)])
    names = ("schema_applied", "schema_version", "missing_required_columns", "warnings", "measurement_profile", "layers_applied")
    return reports.select("experiment_id", F.array_join(F.map_values("report.renamed_columns"), ", ").alias("renamed_from"), *[F.col(f"report.{c}").alias(c) for c in names])


@query("""
with r as (select o_orderkey, 'o' || (o_custkey % 60) as experiment_id, case when o_custkey % 60 < 20 and o_orderkey % 7 = 0 then o_orderkey + 0.5 else o_orderkey end as n, case when o_orderkey % 5 = 0 then null else o_totalprice end as p from orders),
w as (select experiment_id, case when bool_or(n <> floor(n)) then 'could not cast column ''counts'' to an integer' else '' end as warnings from r group by experiment_id)
select o_orderkey, experiment_id, case when n = floor(n) then n::bigint end as counts, p as level, warnings from r join w using (experiment_id)""")
def normalize_mixed_integers(spark, sf_dir):
    """P3 and P5 of mixed rows: an integer column, and the warning of the experiments where it holds fractions."""
    own = {"counter": schemas.Schema(("counts",), {"one": {"counts": ["N", "Counts"], "level": ["Level"]}}, dtypes={"counts": "Int64"})}
    o = table(spark, sf_dir, "orders")
    key, experiment = F.col("o_orderkey"), F.concat(F.lit("o"), (F.col("o_custkey") % 60).cast("string"))
    n = F.when((F.col("o_custkey") % 60 < 20) & (key % 7 == 0), F.concat(key.cast("string"), F.lit(".5"))).otherwise(key.cast("string"))
    raw = F.create_map(F.lit("N"), n, F.lit("Level"), F.when(key % 5 == 0, "no value").otherwise(F.col("o_totalprice").cast("string")))
    rows = o.select("o_orderkey", experiment.alias("experiment_id"), F.lit("counter").alias("type"), F.lit("one").alias("model"), F.lit(None).cast("string").alias("profile"), raw.alias("raw"))
    tidy, reports = normalize.normalize_mixed(rows, [("counter", "one", None)], own)
    flat = normalize.canonical_columns(tidy, ["counts", "level"], integers=("counts",)).select("o_orderkey", "experiment_id", "counts", "level")
    return flat.join(reports.select("experiment_id", F.array_join("report.warnings", "; ").alias("warnings")), "experiment_id")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events where try_cast(json_extract_string(props, '$.k') as double) is not null")
def numeric_coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", scalar.to_number(F.get_json_object("props", "$.k")).alias("k"))
    return normalize.drop_null_rows(e)


@query("select event_type, count(*) as n, sum(case when value = floor(value) then 1 else 0 end)::bigint as integral from events group by event_type")
def integer_coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", normalize.coerced(F.col("value"), "Int64").alias("v"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("integral"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey is not null as peaks from lineitem left join (select p_partkey from part where p_size < 10) on l_partkey = p_partkey")
def peak_flag(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    peaks = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return normalize.peak_flag(points, peaks, ("l_partkey",)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "peaks")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, _y_metric, _y_value from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount from lineitem)
unpivot include nulls (_y_value for _y_metric in (l_quantity, l_extendedprice, l_discount))""")
def melt(spark, sf_dir):
    return normalize.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"])


@query("select c_custkey, c_nationkey, c_acctbal from customer")
def numeric_columns(spark, sf_dir):
    return normalize.numeric_columns(table(spark, sf_dir, "customer"))


@query("select s_acctbal, s_name, s_nationkey, s_suppkey from supplier")
def sorted_columns(spark, sf_dir):
    return normalize.sorted_columns(table(spark, sf_dir, "supplier"))


@query("select c_custkey, case when c_acctbal < 0 then null else c_acctbal end as c_acctbal from customer where not (c_acctbal < 0 and c_nationkey < 5)")
def drop_all_null(spark, sf_dir):
    """An all-null column goes, rows that are null in both measures go."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("n"), F.lit(None).cast("double").alias("empty"))
    kept = normalize.drop_null_columns(c).dropna("all", subset=["c_acctbal", "n"])
    return kept.select(*[x for x in kept.columns if x != "n"])


@query("""
select s_suppkey, s_suppkey::varchar as name, case when s_acctbal > 5000 then s_name end as metadata_s_name, s_nationkey::varchar as metadata_s_nationkey from supplier""")
def registry_extras(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("name"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("s_name"), "s_nationkey")
    out = normalize.with_extras(s, ("s_suppkey", "name"))
    return out.select("s_suppkey", "name", *[F.try_element_at("metadata", F.lit(k)).alias(f"metadata_{k}") for k in ("s_name", "s_nationkey")])


@query("select o_orderkey, coalesce(c_name, 'none') as sample_id, o_orderstatus as run_id from orders left join customer on o_custkey = c_custkey")
def attach_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("experiment_id"), F.col("o_orderstatus").alias("run_id"))
    reg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("sample_id"), F.lit("R001").alias("run_id"))
    return normalize.attach_ids(o, reg).select("o_orderkey", F.coalesce("sample_id", F.lit("none")).alias("sample_id"), "run_id")


# --- filters, sorting, limits ------------------------------------------------------------------------------------


@query("select p_partkey, p_size from part where p_size::varchar in ('1', '7', '49')")
def isin_text(spark, sf_dir):
    return select.member(table(spark, sf_dir, "part"), "p_size", [1, "7", 49]).select("p_partkey", "p_size")


@query("select event_id, value from events where value between 28 and 90")
def between(spark, sf_dir):
    return select.between(table(spark, sf_dir, "events"), "value", 28.0, 90.0).select("event_id", "value")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def conj_filter(spark, sf_dir):
    return select.conjunction(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}, ("o_orderstatus", "o_orderpriority", "o_custkey")).select("o_orderkey")


@query("select p_partkey from part where p_brand in ('Brand#11', 'Brand#12') or p_size in (3, 4)")
def any_of_filter(spark, sf_dir):
    return select.any_of(table(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#12"], "p_size": [3, 4]}).select("p_partkey")


@query("select name from (select c_name as name, case when c_acctbal > 0 then 'to_analyse' else 'done' end as status from customer) where status = 'to_analyse'")
def status_selection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, "to_analyse").otherwise("done").alias("status"))
    return select.to_analyse(c).select("name")


@query("select c_custkey, c_name from customer where c_name like 'Customer#00000001%'")
def like_prefix(spark, sf_dir):
    return select.prefixed(table(spark, sf_dir, "customer"), "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50")
def list_latest(spark, sf_dir):
    return select.latest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 50, "o_orderkey")


@query("select o_orderkey as dataset_name, updated_at, created_at from (select o_orderkey, case when o_orderstatus = 'F' then o_orderdate end as updated_at, o_orderdate as created_at from orders) order by updated_at desc nulls last, created_at desc nulls last, o_orderkey limit 40")
def list_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset_name"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("updated_at"), F.col("o_orderdate").alias("created_at"))
    return select.latest_metadata(o, 40)


@query("select o_custkey as dataset_name, o_orderkey from orders where o_custkey = 7 order by o_orderdate desc nulls last, o_orderkey limit 1")
def latest_named(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset_name"), "o_orderkey", F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp").alias("created_at"))
    return select.latest_named(o, 7, tie="o_orderkey").select("dataset_name", "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 100 offset 200")
def page(spark, sf_dir):
    return select.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 200)[0]


@query("select o_orderkey, o_orderdate as created_at from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 30")
def runs_by_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return select.runs_by_status(o, "O", 30, "o_orderkey").select("o_orderkey", "created_at")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 5")
def preview(spark, sf_dir):
    """L7, in the order of keys."""
    return select.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), order=["o_orderkey"])


# --- aggregations ------------------------------------------------------------------------------------------------


@query("""
select l_returnflag, l_linestatus, count(l_extendedprice) as "count", round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std, round(min(l_extendedprice), 4) as min,
       round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, round(max(l_extendedprice), 4) as max
from lineitem group by l_returnflag, l_linestatus""")
def describe(spark, sf_dir):
    out = features.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "count", *[r4(c, c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("select event_type, max(value) as peak from events group by event_type")
def feature_max(spark, sf_dir):
    return features.features(table(spark, sf_dir, "events"), ["event_type"], {"peak": ("max", "value")})


@query("select user_id, event_id as peak_x, value as peak_y from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events where value is not null) where n = 1")
def peak_position(spark, sf_dir):
    return features.peak_position(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", "event_id")


@query("select l_suppkey, min(l_quantity) as low, max(l_quantity) as high from lineitem group by l_suppkey")
def span(spark, sf_dir):
    return features.span(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("select user_id, count(*) as rows, (count(event_id) > 0)::int + (count(ts) > 0)::int + (count(event_type) > 0)::int + (count(value) > 0)::int + (count(props) > 0)::int as columns from events group by user_id")
def dataset_sizes(spark, sf_dir):
    return features.sizes(table(spark, sf_dir, "events"), "user_id")


@query("select o_custkey, list_sort(list_distinct(list(o_orderpriority))) as files, len(list_distinct(list(o_orderpriority))) as file_count from orders group by o_custkey")
def source_files(spark, sf_dir):
    return features.source_files(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("select conv_id, role as status, count(*) as n from conversations group by conv_id, role")
def run_status_counts(spark, sf_dir):
    return features.status_counts(table(spark, sf_dir, "conversations").withColumnRenamed("role", "status"), ["conv_id"])


@query("select conv_id, count(*)::int as n_items from conversations group by conv_id")
def run_items(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("datasets"))
    return features.items(runs).select("conv_id", "n_items")


@query("""
select 'o_orderstatus' as "column", avg((o_orderstatus is not null)::int) as non_null_ratio, count(distinct o_orderstatus) as n_distinct from orders
union all select 'big', avg((o_totalprice > 100000)::int), 1 + count(distinct case when o_totalprice > 100000 then o_orderstatus end) from orders""")
def column_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("big"))
    return features.column_profile(o, ["o_orderstatus", "big"], keep_null=True)


@query("select coalesce(sum(n), 0)::bigint as duplicates from (select count(*) as n from lineitem group by l_orderkey having count(*) > 1)")
def dup_count(spark, sf_dir):
    return features.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("""
with base as (select sum(n) as baseline from (select count(*) as n from lineitem group by l_orderkey) where n > 1),
c as (select 'l_returnflag' as "column", sum(n) as d from (select count(*) as n from lineitem group by l_orderkey, l_returnflag) where n > 1
      union all select 'l_linestatus', sum(n) from (select count(*) as n from lineitem group by l_orderkey, l_linestatus) where n > 1
      union all select 'l_linenumber', sum(n) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber) where n > 1)
select "column", d::bigint as duplicates, round(1 - d / baseline, 4) as score from c, base""")
def group_infer_scores(spark, sf_dir):
    out = features.grouping_scores(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus", "l_linenumber"])
    return out.select("column", "duplicates", r4("score", "score"))


@query("select distinct o_orderpriority as value from orders where o_orderpriority is not null")
def distinct_values(spark, sf_dir):
    return features.distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
with b as (select 'price' as which, min(o_totalprice) as low, max(o_totalprice) as high from orders union all select 'one order', min(o_totalprice), min(o_totalprice) from orders union all select 'zero', min(0.0), max(0.0) from orders)
select which, (low - case when low = high then case when low = 0 then 1 else abs(low) * 0.05 end else 0 end)::double as low, (high + case when low = high then case when low = 0 then 1 else abs(low) * 0.05 end else 0 end)::double as high from b""")
def padded_bounds(spark, sf_dir):
    """A16, with both paddings of equal bounds."""
    o = table(spark, sf_dir, "orders")
    least = o.agg(F.min("o_totalprice").alias("o_totalprice"))
    cases = {"price": o, "one order": least, "zero": o.select(F.lit(0.0).alias("o_totalprice"))}
    return compare.union_labelled({name: features.bounds(df, "o_totalprice") for name, df in cases.items()}, "which")


@query("select o_orderstatus, case when o_totalprice < 0 then 0 when o_totalprice >= 500000 then 21 else floor(o_totalprice / 25000)::bigint + 1 end as bin, count(*) as n from orders group by 1, 2")
def histogram(spark, sf_dir):
    return features.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0, 500000, 20, ["o_orderstatus"])


@query("select o_orderpriority, min(o_totalprice) as low, round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.5), 4) as q50, round(quantile_cont(o_totalprice, 0.75), 4) as q75, max(o_totalprice) as high from orders group by o_orderpriority")
def box(spark, sf_dir):
    out = features.box(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", "low", r4("q25", "q25"), r4("q50", "q50"), r4("q75", "q75"), "high")


@query("select o_orderstatus as instrument_type, o_orderpriority as measurement_profile, count(distinct o_custkey) as datasets, count(*) as rows from orders group by 1, 2")
def set_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("instrument_type"), F.col("o_orderpriority").alias("measurement_profile"), F.col("o_custkey").alias("experiment_id"))
    return features.set_summary(o)


@query("""
select n_name as sample_id, c_mktsegment as measurement_profile, count(o_totalprice) as "count", round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as q50
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
def describe_by_metadata(spark, sf_dir):
    """J10 then A19."""
    meta = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("sample_id"), F.col("c_mktsegment").alias("measurement_profile"))
    joined = compare.with_metadata(table(spark, sf_dir, "orders"), meta, "o_custkey")
    return features.describe(joined, ["sample_id", "measurement_profile"], "o_totalprice").select("sample_id", "measurement_profile", "count", r4("mean", "mean"), r4("q50", "q50"))


# --- joins, unions, catalogue ------------------------------------------------------------------------------------


@query("select c_name as name, c_acctbal as acctbal, c_mktsegment as segment, 'customer' as label from customer union all select s_name, s_acctbal, null, 'supplier' from supplier")
def union_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return compare.union_labelled({"customer": c, "supplier": s})


@query("select c_nationkey as nationkey from customer union select s_nationkey from supplier")
def union_distinct(spark, sf_dir):
    return compare.union_distinct(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def enrich_left(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return compare.with_metadata(table(spark, sf_dir, "orders"), meta, "o_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("""
with m as (select o_custkey, o_orderpriority, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1)
select c_custkey as experiment_name, coalesce(nullif(case when c_acctbal < 0 then '' else c_mktsegment end, ''), nullif(o_orderpriority, ''), '') as sample_id, coalesce(o_orderstatus, '') as run_id from customer left join m on c_custkey = o_custkey""")
def coalesce_fill(spark, sf_dir):
    """J9."""
    cat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("experiment_name"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("sample_id"))
    meta = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("experiment_name"), F.col("o_orderpriority").alias("sample_id"), F.col("o_orderstatus").alias("run_id"), "o_orderdate", "o_orderkey")
    return catalog.enrich(cat, meta, ["sample_id", "run_id"], order=[F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")])


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def semi_available(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return catalog.available(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
def anti_new(spark, sf_dir):
    """Customers without an urgent finished order; some are left at every scale."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return catalog.not_yet_stored(c, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), key="c_custkey")


@query("select c_custkey, c_nationkey from customer where c_custkey % 3 = 0 union all select c_custkey, null from customer where c_custkey % 3 <> 0")
def seed_insert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return catalog.seed(c.filter("c_custkey % 3 = 0").select("c_custkey", "c_nationkey"), c.select("c_custkey"), ["c_custkey"])[0]


@query("""
select c_custkey, case when c_custkey % 2 = 0 then 'known' || c_custkey else substr(sha256(c_mktsegment || chr(1) || c_name), 1, 12) end as experiment_id from customer""")
def manifest_ids(spark, sf_dir):
    """J6 and F17."""
    reg = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("instrument_name"), F.col("c_name").alias("raw_data_filename"))
    known = reg.filter("c_custkey % 2 = 0").select("instrument_name", "raw_data_filename", F.concat(F.lit("known"), "c_custkey").alias("experiment_id"), F.col("name").alias("experiment_name"))
    return catalog.resolve_manifest(reg, known)[0].select("c_custkey", "experiment_id")


@query("""
select c_custkey as table_name, coalesce(o.total, -1) as total, case when c_custkey % 2 = 0 then timestamp '2020-01-01' else timestamp '2024-01-01' end as created_at
from customer left join (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey) o on c_custkey = o_custkey where c_custkey % 2 = 0 or o.total is not null""")
def upsert_latest(spark, sf_dir):
    """K5 and K6: new totals replace old rows, the first creation time stays."""
    old = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("table_name"), F.lit(-1.0).alias("total"), F.lit("2020-01-01").cast("timestamp").alias("created_at"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("table_name")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return catalog.upsert(old, new, ["table_name"], F.lit("2024-01-01").cast("timestamp")).select("table_name", "total", "created_at")


@query("select o_orderkey, n_name as table_name from orders left join nation on o_custkey % 40 = n_nationkey")
def view_names(spark, sf_dir):
    """J14."""
    runs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("int").alias("storage_path"))
    return catalog.with_views(runs, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("storage_path"), F.col("n_name").alias("table_name"))).select("o_orderkey", "table_name")


@query("""
select n_nationkey as experiment_id, o_orderkey, coalesce(nullif(case when n_nationkey % 5 = 0 then '' else n_name end, ''), n_nationkey::varchar) as comparison_label, n_nationkey as comparison_pos
from orders join nation on o_custkey % 25 = n_nationkey""")
def comparison_labels(spark, sf_dir):
    data = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("experiment_id"))
    sets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("experiment_id"), F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("experiment_name"))
    return compare.labelled(data, sets).select("experiment_id", "o_orderkey", F.col("comparison_label").cast("string").alias("comparison_label"), "comparison_pos")


@query("select s_suppkey, s_name from supplier where s_nationkey::varchar in ('3', '5')")
def sample_experiments(spark, sf_dir):
    """J12 and E4."""
    reg = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("sample_id"))
    return compare.of_samples(reg, ["3", "5"]).select("s_suppkey", "s_name")


@query("select c_custkey, round(c_acctbal + 10.0 * c_nationkey, 4) as y from customer")
def stacked_offset(spark, sf_dir):
    return compare.stacked(table(spark, sf_dir, "customer"), "c_acctbal", 10.0, "c_nationkey").select("c_custkey", r4("c_acctbal", "y"))


@query("""
with l as (select l_extendedprice as x, l_quantity as y, case when l_linenumber = 1 then 'Heating_start_1' when l_linenumber = 2 then null else l_returnflag end as g from lineitem)
select 0 as position, 'price' as x_column, 'all' as series, x, y from l
union all select 1, 'price', case when g is null or g = 'Heating_start_1' then 'parts' else 'parts | ' || g end, x, y + 5.0 from l""")
def stacked_series(spark, sf_dir):
    """E8 in stacked mode: groups, a missing group, and a boundary label that is left out."""
    group = F.when(F.col("l_linenumber") == 1, "Heating_start_1").when(F.col("l_linenumber") != 2, F.col("l_returnflag"))
    b = table(spark, sf_dir, "lineitem").select(group.alias("group"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    a = b.withColumn("group", F.lit(None).cast("string"))
    return compare.compare_series({"all": ("price", a), "parts": ("price", b)}, "stacked", 5.0)[0]


@query("select 'heat_flow_mW' as signal, l_returnflag as \"group\", l_quantity as x, l_extendedprice as y from lineitem")
def dsc_series(spark, sf_dir):
    """E7 for a DSC dataset: grouped by its segment labels."""
    data = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("temperature_C"), F.col("l_extendedprice").alias("heat_flow_mW"), F.col("l_returnflag").alias("profile"))
    return series.series(data, "dsc")[0].select("signal", "group", "x", "y")


# --- registry rules ----------------------------------------------------------------------------------------------


@query("select list_sort(list(name)) as duplicates from (select c_nationkey::varchar as name from customer group by c_nationkey having count(*) > 1)")
def validate_dups(spark, sf_dir):
    return validate.duplicate_names(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("name")))


@query("select o_custkey as raw_data_filename, o_orderpriority as instrument_name, count(*) as rows from orders where o_orderpriority is not null group by 1, 2 having count(*) > 1")
def duplicate_files(spark, sf_dir):
    reg = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("raw_data_filename"), F.col("o_orderpriority").alias("instrument_name"))
    return validate.duplicates(reg, ["raw_data_filename", "instrument_name"], ["instrument_name"])


@query("select count(*) as total, count(*) filter (c_acctbal >= 0) as valid, count(*) filter (not c_acctbal >= 0) as invalid from customer")
def validate_summary(spark, sf_dir):
    return validate.summary(table(spark, sf_dir, "customer").select((F.col("c_acctbal") >= 0).alias("valid")))


@query("select s_suppkey, regexp_full_match('S' || s_suppkey, 'S[0-9]{3,6}') as ok_sample, regexp_full_match('R' || lpad(s_suppkey::varchar, 3, '0'), 'R[0-9]{3,6}') as ok_run, regexp_full_match(s_name, '[A-Za-z0-9_\\-\\.]+') as ok_name from supplier")
def id_regex(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", scalar.is_sample_id(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("ok_sample"), scalar.is_run_id(F.concat(F.lit("R"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0"))).alias("ok_run"), scalar.is_safe_name(F.col("s_name")).alias("ok_name"))


@query("select c_custkey, r_name as type, r_name is not null as known from customer left join (select * from nation join region on n_regionkey = r_regionkey) on c_nationkey = n_nationkey and n_nationkey < 20")
def instrument_join(spark, sf_dir):
    """J1."""
    reg = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("instrument_name"))
    ins = table(spark, sf_dir, "nation").filter("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("name"), F.col("r_name").alias("type"), F.lit("m").alias("model"))
    return validate.with_instruments(reg, ins).select("c_custkey", "type", "known")


@query("select p_partkey, p_type as type, p_brand as model from part where (p_type, p_brand) not in (select p_type, p_brand from part where p_size < 25)")
def without_parser(spark, sf_dir):
    """J2."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("type"), F.col("p_brand").alias("model"), "p_size")
    return validate.without_parser(p.drop("p_size"), p.filter("p_size < 25")).select("p_partkey", "type", "model")


@query("""
with p as (select p_partkey, p_type || '/' || (p_partkey // 3) as type from part)
select p_partkey, type from p where type not in (select type from p where p_partkey % 3 = 0)""")
def without_schema(spark, sf_dir):
    """Types that no part with a key divisible by three has; some are left at every scale."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_type", F.floor(F.col("p_partkey") / 3).cast("string")).alias("type"))
    return validate.without_schema(p, p.filter("p_partkey % 3 = 0")).select("p_partkey", "type")


@query("""
select n_nationkey::varchar as instrument_name, n_nationkey % 3 <> 0 and n_nationkey % 4 <> 0 as valid,
       case when n_nationkey % 3 = 0 then 1 else 0 end + case when n_nationkey % 4 = 0 then 1 else 0 end as n_errors from nation""")
def diagnostic(spark, sf_dir):
    """J13."""
    ins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_nationkey").cast("string").alias("type"), F.lit("m").alias("model"), "n_nationkey")
    out = validate.diagnostic(ins, ins.filter("n_nationkey % 3 <> 0"), ins.filter("n_nationkey % 4 <> 0"))
    return out.select("instrument_name", "valid", F.size("errors").alias("n_errors"))


_PROFILES = ["small polished", "large_brass", "economy anodized steel", "red", "blue green", "almond antique blue"]


@query(f"""
with p as (select unnest({_PROFILES!r}) as canonical), t as (select distinct p_name as profile from part),
tok as (select profile, canonical, list_distinct(regexp_extract_all(lower(profile), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(canonical), '[a-z0-9]+')) as b from t, p),
r as (select profile, canonical, len(b) as n, case when profile = canonical then 1 when lower(profile) = lower(canonical) then 2
        when lower(canonical) = translate(lower(profile), ' -', '__') then 3 when len(a) > 0 and list_has_all(b, a) then 4 end as k from tok),
s as (select *, row_number() over (partition by profile order by k, case when k = 4 then n end, case when k = 4 then lower(canonical) end, canonical) as m from r where k is not null)
select t.profile, s.canonical from t left join s on t.profile = s.profile and s.m = 1""")
def profile_match(spark, sf_dir):
    names = spark.createDataFrame([(p,) for p in _PROFILES], "canonical string")
    return validate.match_profiles(table(spark, sf_dir, "part").select(F.col("p_name").alias("profile")), names)


@query("""
select p_partkey, case when contains(lower(d), 'econ') or contains(lower(d), 'promo') then 'oscillatory_frequency_sweep' when contains(lower(d), 'small') then 'oscillatory_temperature_sweep'
  when contains(lower(d), 'large') or contains(lower(d), 'medium') then 'oscillatory_strain_sweep' end as profile from (select p_partkey, p_type || ' ' || p_name as d from part)""")
def profile_infer(spark, sf_dir):
    words = ((("econ", "promo"), "oscillatory_frequency_sweep"), (("small",), "oscillatory_temperature_sweep"), (("large", "medium"), "oscillatory_strain_sweep"))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.infer_profile(F.concat_ws(" ", "p_type", "p_name"), words).alias("profile"))


@query("""
with d as (select p_partkey, case p_partkey % 8 when 0 then 'Freq sweep' when 1 then 'oscillation' when 2 then 'temp ramp' when 3 then 'STRAIN' when 4 then 'amplitude freq' when 5 then 'viscosity' when 6 then 'shear' end as d,
                  case when p_partkey % 5 = 0 then 'given' when p_partkey % 5 = 1 then ' ' end as e from part)
select p_partkey, coalesce(nullif(trim(e), ''), case when contains(lower(d), 'freq') or contains(lower(d), 'oscill') then 'oscillatory_frequency_sweep' when contains(lower(d), 'temp') then 'oscillatory_temperature_sweep'
  when contains(lower(d), 'strain') or contains(lower(d), 'amplitude') then 'oscillatory_strain_sweep' when contains(lower(d), 'flow') or contains(lower(d), 'viscos') or contains(lower(d), 'shear') then 'flow_curve' end) as profile from d""")
def profile_given_or_inferred(spark, sf_dir):
    """F4 and F5 with the library's own keywords; a given profile wins."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    words = ("Freq sweep", "oscillation", "temp ramp", "STRAIN", "amplitude freq", "viscosity", "shear")
    said = F.element_at(F.array(*[F.lit(w) for w in words], F.lit(None).cast("string")), (k % 8 + 1).cast("int"))
    return p.select("p_partkey", scalar.profile_of(F.when(k % 5 == 0, "given").when(k % 5 == 1, " "), said).alias("profile"))


@query("""
select p_partkey, 'run' || p_partkey || '_' || (case p_partkey % 5 when 0 then 'RID1A' when 1 then 'vwd2' when 2 then 'MALS' when 3 then 'visc-b' else 'other' end) as name,
  case p_partkey % 5 when 0 then 'ri' when 1 then 'uv' when 2 then 'ls' when 3 then 'viscometer' else 'unknown' end as detector from part""")
def detector_names(spark, sf_dir):
    """F11 and F12 with the library's own detectors."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(k % 5 == 0, "RID1A").when(k % 5 == 1, "vwd2").when(k % 5 == 2, "MALS").when(k % 5 == 3, "visc-b").otherwise("other")
    name = F.concat(F.lit("run"), k.cast("string"), F.lit(".dx_"), kind)
    return p.select("p_partkey", scalar.without_dx(name).alias("name"), scalar.infer_detector(scalar.without_dx(name)).alias("detector"))


@query(r"""
select page_id, case when regexp_matches(d, '(^| )th') then 'ri' when regexp_matches(d, '(^| )(en|fr)') then 'uv' else 'unknown' end as detector
from (select page_id, regexp_replace(lower(string_split(url, '//')[2]), '[^a-z0-9]+', ' ', 'g') as d from pages)""")
def detector_infer(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", scalar.infer_detector(F.split("url", "//")[1], (("ri", ("th",)), ("uv", ("en", "fr")))).alias("detector"))


@query("""
with r as (select c_custkey as row_number, case when c_custkey % 50 = 0 then null else c_name end as name, case c_nationkey % 4 when 0 then 'dsc' when 1 then 'DMA' when 2 then 'laser' end as instrument_name,
                  case when c_custkey % 7 = 0 then 'S1' else 'S' || lpad((c_custkey % 1000)::varchar, 3, '0') end as sample_id from customer),
e as (select *, (name is null)::int + coalesce((instrument_name = 'laser')::int, 0) + (not regexp_full_match(sample_id, 'S[0-9]{3,6}'))::int as n_errors, (instrument_name is null)::int as n_warnings from r)
select row_number, n_errors = 0 as valid, n_errors, n_warnings, case instrument_name when 'dsc' then 'dsc' when 'DMA' then 'dma' end as type from e""")
def registry_validation(spark, sf_dir):
    """E1 over customers as registry rows."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    which = F.col("c_nationkey") % 4
    reg = c.select(
        k.alias("row_number"), F.when(k % 50 != 0, F.col("c_name")).alias("name"), F.when(which == 0, "dsc").when(which == 1, "DMA").when(which == 2, "laser").alias("instrument_name"),
        F.when(k % 7 == 0, "S1").otherwise(F.concat(F.lit("S"), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("sample_id"),
    )
    ins = spark.createDataFrame([("dsc", "dsc", "prior"), ("dma", "dma", "ta_q800")], "name string, type string, model string")
    rows, _, _ = validate.validate_registry(reg, ins, ins)
    return rows.select("row_number", "valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "type")


@query("""
select o_orderkey as experiment_name, o_custkey, o_orderstatus as run_id from orders where o_orderstatus = 'F'
order by o_orderdate desc nulls last, o_orderkey limit 25""")
def list_datasets(spark, sf_dir):
    """E5."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experiment_name"), "o_custkey", F.col("o_orderstatus").alias("run_id"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp").alias("created_at"))
    return datasets.list_datasets(o, limit=25, run_id="F").select("experiment_name", "o_custkey", "run_id")


@query("""
select o_custkey as experiment_id, count(*) as rows, list_sort(list_distinct(list(o_orderpriority))) as files, 'dsc:prior' as parser_key, 0 as warning_count from orders group by o_custkey""")
def provenance(spark, sf_dir):
    """One provenance record an experiment."""
    data = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("experiment_id"), F.lit("i").alias("instrument_name"), F.lit("dsc").alias("type"), F.lit("prior").alias("model"), F.col("o_orderpriority").alias("source_file"))
    text_list = F.array().cast("array<string>")
    report = F.struct(F.lit("1.1").alias("schema_version"), F.lit(True).alias("schema_applied"), text_list.alias("warnings"), text_list.alias("missing_required_columns"))
    out = catalog.provenance(data, data.select("experiment_id").distinct().withColumn("report", report), "local", "/store")
    return out.select("experiment_id", "rows", F.col("provenance.source.files").alias("files"), F.col("provenance.storage.parser_key").alias("parser_key"), F.col("provenance.schema.warning_count").alias("warning_count"))


# --- files and lines ---------------------------------------------------------------------------------------------


@query(r"""
with f as (select distinct url as path, regexp_extract(url, '^(.*)/[^/]*$', 1) as dir, list_last(string_split(url, '/')) as base from pages),
g as (select *, case when length(base) > 1 then regexp_replace(base, '^(.+)\.[^.]*$', '\1') else base end as stem, list_last(string_split(dir, '/')) as dir_name from f),
w as (select distinct 'en' as key union select 'fr' union select list_last(string_split(regexp_extract(url, '^(.*)/[^/]*$', 1), '/')) from pages),
a as (select key, count(distinct dir) as n from w join g on (base = key or stem = case when length(key) > 1 then regexp_replace(key, '^(.+)\.[^.]*$', '\1') else key end) group by key),
b as (select key, count(distinct dir) as n from w join g on dir_name = key group by key),
m as (select key, dir from w join g on dir_name = key or base = key or stem = case when length(key) > 1 then regexp_replace(key, '^(.+)\.[^.]*$', '\1') else key end group by all),
c as (select key, count(distinct path) as n from m join g using (dir) group by key)
select w.key as raw_data_filename, coalesce(c.n, 0) as matches, coalesce(a.n, 0) > 1 or coalesce(b.n, 0) > 1 as ambiguous from w left join a using (key) left join b using (key) left join c using (key)""")
def file_discovery(spark, sf_dir):
    """J4 over the pages' addresses as paths."""
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    keys = p.select(scalar.base_name(scalar.dir_name(F.col("path"))).alias("raw_data_filename")).union(spark.createDataFrame([("en",), ("fr",)], "raw_data_filename string")).distinct()
    return files.files_of(keys, p)[1]


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
select doc_id, count(*) as lines, count(*) filter (contains(line, 'the')) as marked, max(n) as last_line from l group by doc_id""")
def sectioned_lines(spark, sf_dir):
    """S4's numbered lines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.col("text").alias("value"))
    lines = text.lines_of(docs)
    return lines.groupBy(F.col("source_file").alias("doc_id")).agg(F.count("*").alias("lines"), F.count_if(F.col("line").contains("the")).alias("marked"), (F.max("line_no") + 1).alias("last_line"))


@query("select vec_id, (n - 1)::int as row_idx, x::double as x, y::double as y from (select vec_id, unnest(embedding) as x, unnest(embedding) as y, generate_subscripts(embedding, 1) as n from embeddings)")
def explode_spectrum(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.col("embedding").alias("b"))
    out = text.explode_spectrum(e, "a", "b", ["vec_id"])[0]
    return out.select("vec_id", "row_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


# --- scalar functions --------------------------------------------------------------------------------------------


@query(r"""
select page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '_'), ''), 'dataset') as table_name from pages""")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalar.table_name(F.col("url")).alias("table_name"))


@query("select s_suppkey, substr(sha256(s_name || chr(1) || s_nationkey), 1, 12) as experiment_id from supplier")
def hash_id(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar.experiment_id(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("experiment_id"))


@query("select p_partkey, p_name || '.txt' as name, rtrim(p_name || '.txt', '.txt') as legacy, p_name as stripped from part")
def rtrim_legacy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".txt")).alias("name"))
    return p.select("p_partkey", "name", scalar.strip_suffix(F.col("name"), ".txt", legacy=True).alias("legacy"), scalar.strip_suffix(F.col("name"), ".txt").alias("stripped"))


@query("""
select event_id, case when k % 2 = 0 then 'local' else 'cloud' end as backend, case when k % 2 = 0 then '/data/' || event_id end as local_path, case when k % 2 = 1 then 's3://b/' || event_id end as cloud_path
from (select event_id, json_extract_string(props, '$.k')::int as k from events)""")
def json_backfill(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 2 == 0, F.concat(F.lit("/data/"), "event_id")).otherwise(F.concat(F.lit("s3://b/"), "event_id")).alias("path"), F.when(k % 2 == 0, '{"storage": {"backend": "local"}}').otherwise('{"storage": {"backend": "cloud"}}').alias("provenance"))
    local, cloud = scalar.backfilled_paths(F.col("provenance"), F.col("path"))
    return e.select("event_id", scalar.storage_backend(F.col("provenance")).alias("backend"), local.alias("local_path"), cloud.alias("cloud_path"))


@query(r"""
select p_partkey, lower(trim(' ' || p_brand || ' ')) as folded, nullif(trim(case when p_size > 25 then '  ' else p_type end), '') as cleaned,
  string_split(p_name || '$x', '$')[1] as before_dollar, coalesce(nullif(ltrim(p_size::varchar, '0'), ''), '0') as titrant, translate(lower(p_name), ' -', '__') as underscored,
  case when p_size > 25 then 'cloud' else 'local' end as place, p_type || ':' || p_brand as parser_key, concat_ws('_', p_brand, nullif(case when p_size > 25 then '' else p_type end, '')) as joined
from part""")
def text_functions(spark, sf_dir):
    """F1, F2, F7, F10, F16, F22, F23."""
    p, big = table(spark, sf_dir, "part"), F.col("p_size") > 25
    return p.select(
        "p_partkey", scalar.fold(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("folded"), scalar.blank_to_null(F.when(big, "  ").otherwise(F.col("p_type"))).alias("cleaned"), scalar.before_dollar(F.concat("p_name", F.lit("$x"))).alias("before_dollar"),
        scalar.titrant(F.concat(F.lit("a_00"), F.col("p_size").cast("string"))).alias("titrant"), scalar.underscored(F.lower("p_name")).alias("underscored"), scalar.storage_label(F.when(big, "s3://b/x").otherwise("/x")).alias("place"),
        scalar.parser_key(F.col("p_type"), F.col("p_brand")).alias("parser_key"), scalar.joined("_", F.col("p_brand"), F.when(big, "").otherwise(F.col("p_type"))).alias("joined"),
    )


@query("select p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) as tokens, list_filter(list_transform(string_split(p_name || ', ,x', ','), lambda e: trim(e)), lambda e: e <> '') as listed from part")
def token_functions(spark, sf_dir):
    """F6 and F26."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.sort_array(scalar.tokens(F.col("p_name"))).alias("tokens"), scalar.listed(F.concat("p_name", F.lit(", ,x"))).alias("listed"))


@query(r"""select page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) as dir, list_last(string_split(url, '/')) as base from pages""")
def path_functions(spark, sf_dir):
    """F8."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", scalar.dir_name(F.col("url")).alias("dir"), scalar.base_name(F.col("url")).alias("base"))


@query("""
select o_orderkey, o_orderdate - case when o_orderkey % 2 = 0 then interval 1 hour else interval 2 hour end + to_milliseconds(o_orderkey % 1000) as at from orders""")
def spectrum_times(spark, sf_dir):
    """order dates written as an instrument's CET and CEST lines, milliseconds from the file name."""
    o = table(spark, sf_dir, "orders")
    zone = F.when(F.col("o_orderkey") % 2 == 0, " CET ").otherwise(" CEST ")
    line = F.concat(F.lit("Date: "), F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss"), zone, F.date_format("o_orderdate", "yyyy"))
    name = F.concat(F.lit("x_1-"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".txt"))
    return o.select("o_orderkey", scalar.spectrum_time(line, name).alias("at"))
