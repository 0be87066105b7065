"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.normalize import joined_null_safe, quoted
from assayloom.sources.shared import shared_folder, stored


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows by group and value, dealt by ranges of (group, value): ``_n`` rows in range ``_part``; written once."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n")).repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    return stored(counted, shared_folder(df.sparkSession), "counted", ("_part",))


def quantiles_of(counted: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) by group, as ``{name: share}``; groups without values are left out.

    A distributed selection over counted_values(): sums of the ranges tell in which range each wanted rank lies, and only those
    ranges are looked into, each in a task of its own.
    """
    some = counted.filter(F.col(value).isNotNull())
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row a range
    ranges = some.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    ranges = ranges.withColumn("_all", F.sum("_in").over(group)).withColumn("_upto", F.sum("_in").over(group.orderBy("_part")))
    place = lambda share: F.lit(share) * (F.col("_all") - 1)
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(place(share)).cast("long").alias("rank"), (place(share) - F.floor(place(share))).alias("part")) for name, share in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    asked = ranges.select("*", F.explode(F.array(*wanted)).alias("w")).filter((F.col("w.rank") < F.col("_upto")) & (F.col("w.rank") >= F.col("_upto") - F.col("_in")))
    asked = asked.select(*by, "_part", F.col("w.name").alias("_name"), F.col("w.side").alias("_side"), (F.col("w.rank") - F.col("_upto") + F.col("_in")).alias("_rank"), F.col("w.part").alias("_fraction"))
    keys = [*by, "_part"]
    here = joined_null_safe(some, asked.select(*keys).distinct(), keys)
    here = here.withColumn("_last", F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = joined_null_safe(here, asked, keys).filter((F.col("_rank") < F.col("_last")) & (F.col("_rank") >= F.col("_last") - F.col("_n")))
    at = lambda name, side: F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col(value)))
    between = lambda name: at(name, "low") + (at(name, "high") - at(name, "low")) * F.max(F.when(F.col("_name") == name, F.col("_fraction")))
    return found.groupBy(*by).agg(*[between(name).alias(name) for name in shares])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value by group; see quantiles_of()."""
    return quantiles_of(counted_values(df, by, value), by, value, shares)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, std, min, quartiles (linear) and max of a value by group, all from its counted values; the table is read once."""
    counted = counted_values(df, by, value)
    v, n = F.col(value).cast("double"), F.when(F.col(value).isNotNull(), F.col("_n"))
    plain = counted.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    if not by:
        plain = plain.filter("count >= 0")
    away = joined_null_safe(counted, plain.select(*by, "mean"), by).groupBy(*by).agg(F.sum(n * (v - F.col("mean")) ** 2).alias("_away"))
    q = quantiles_of(counted, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = joined_null_safe(joined_null_safe(plain, away, by), q, by, "left")
    std = F.sqrt(F.col("_away") / F.nullif(F.col("count") - 1, F.lit(0)))
    return out.select(*by, "count", "mean", std.alias("std"), "min", "q25", "q50", "q75", "max")


def features(df: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """{name: (function, column)}; functions are count, min, max, mean, sum, std, first-of-peak as ``peak:<x>``."""
    plain = {"count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "std": F.stddev_samp}
    columns = [F.max_by(how.split(":", 1)[1], c).alias(name) if how.startswith("peak:") else plain[how](c).alias(name) for name, (how, c) in aggs.items()]
    return df.groupBy(*by).agg(*columns)


def peak_position(df: DataFrame, by: list[str], x: str, y: str, tie: str) -> DataFrame:
    """The largest y and its x; ties go to the smallest ``tie``."""
    best = F.min_by(F.struct(x, y), F.struct((-F.col(y)).alias("a"), F.col(tie).alias("b")))
    return df.filter(F.col(y).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{x}").alias("peak_x"), F.col(f"b.{y}").alias("peak_y"))


def span(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A5."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def sizes(df: DataFrame, by: str) -> DataFrame:
    """Rows, and columns that hold a value, of each dataset."""
    filled = [F.max(quoted(c).isNotNull().cast("int")) for c in df.columns if c != by]
    return df.groupBy(by).agg(F.count("*").alias("rows"), sum(filled[1:], filled[0]).alias("columns"))


def source_files(df: DataFrame, by: str, column: str = "source_file") -> DataFrame:
    """A7."""
    files = F.sort_array(F.filter(F.collect_set(F.trim(column)), lambda x: x != ""))
    return df.groupBy(by).agg(files.alias("files")).withColumn("file_count", F.size("files"))


def status_counts(df: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """A10."""
    return df.groupBy(*by, status).agg(F.count("*").alias("n"))


def items(df: DataFrame, array: str = "datasets") -> DataFrame:
    """A11."""
    return df.withColumn("n_items", F.coalesce(F.size(array), F.lit(0)))


def column_profile(df: DataFrame, columns: list[str], keep_null: bool = False) -> DataFrame:
    """(column, non_null_ratio, n_distinct) of each column from one aggregate; a null counts as a value if kept."""
    aggs = []
    for k, c in enumerate(columns):
        some_null = F.max(quoted(c).isNull().cast("int")) if keep_null else F.lit(0)
        aggs += [F.avg(quoted(c).isNotNull().cast("double")).alias(f"r{k}"), (F.count_distinct(quoted(c)) + F.coalesce(some_null, F.lit(0))).alias(f"d{k}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{k}").alias("non_null_ratio"), F.col(f"d{k}").cast("bigint").alias("n_distinct")) for k, c in enumerate(columns)])
    return one.select(F.inline(rows))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their key with another row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))


def grouping_scores(df: DataFrame, x: str, candidates: list[str]) -> DataFrame:
    """(column, duplicates, score) of each candidate, from one pass over grouping sets.

    Score: 1 less the duplicates of x left inside groups over those without groups.
    """
    names = [x, *candidates]
    grouped = df.groupingSets([[quoted(x)], *[[quoted(x), quoted(c)] for c in candidates]], *[quoted(c) for c in names]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    summed = grouped.groupBy("gid").agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))
    every = (1 << len(candidates)) - 1
    label = F.create_map(*[F.lit(v) for k, c in enumerate(candidates) for v in (every & ~(1 << (len(candidates) - 1 - k)), c)])
    one = summed.agg(F.max(F.when(F.col("gid") == every, F.col("duplicates"))).alias("baseline"), F.collect_list(F.struct("gid", "duplicates")).alias("all"))  # a struct a candidate
    each = one.select("baseline", F.inline("all")).filter(F.col("gid") != every)
    return each.select(label[F.col("gid").cast("int")].alias("column"), "duplicates", F.when(F.col("baseline") > 0, 1 - F.col("duplicates") / F.col("baseline")).alias("score"))


def infer_group(df: DataFrame, x: str, y: list[str], group_by: str | None = None, max_groups: int = 20, exclude: tuple[str, ...] = ()) -> tuple[str | None, list[str]]:
    """The grouping column and warnings."""
    if max_groups < 2:
        raise ValueError("max_groups is at least 2")
    if group_by is not None:
        if group_by not in df.columns:
            raise ValueError(f"no column {group_by}")
        return group_by, []
    others = [c for c in df.columns if c not in {x, *y, *exclude}]
    if not others:
        return None, []
    good = [r["column"] for r in column_profile(df, others).collect() if (r["non_null_ratio"] or 0) >= 0.8 and r["n_distinct"] >= 2]
    good = [c for c in others if c in good]
    if not good:
        return None, []
    scores = {r["column"]: r["score"] for r in grouping_scores(df, x, good).collect()}
    best = max((s for s in scores.values() if s is not None), default=0.0)
    if best <= 0:
        return None, []
    top = [c for c in good if scores[c] == best]
    return top[0], [f"columns {top} tie; the first is used"] if len(top) > 1 else []


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A15."""
    return df.select(quoted(column).cast("string").alias("value")).filter("value is not null").distinct().orderBy("value")


def bounds(df: DataFrame, column: str) -> DataFrame:
    """Low and high; equal ones are padded by 5 % of the value or by 1; no row if there are no values."""
    out = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).filter("low is not null")
    pad = F.when(F.col("low") == F.col("high"), F.when(F.col("low") == 0, 1.0).otherwise(F.abs("low") * 0.05)).otherwise(0.0)
    return out.select((F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Rows of each bin (0 below, bins + 1 above) by group."""
    return df.filter(F.col(column).isNotNull()).groupBy(*(by or []), F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """What a box plot draws."""
    out = describe(df, by, column)
    return out.select(*by, F.col("min").alias("low"), "q25", "q50", "q75", F.col("max").alias("high"))


def set_summary(df: DataFrame) -> DataFrame:
    """Datasets and rows of a comparison set by type and profile."""
    return df.groupBy("instrument_type", "measurement_profile").agg(F.count_distinct("experiment_id").alias("datasets"), F.count("*").alias("rows"))
