"""Characterisation of runs (W1 to W6, W9, X2): temperature segments, mass percent, first-wins rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.normalize import joined_null_safe
from assayloom.sources.shared import shared_folder, stored

CHUNK = 4_000_000  # rows of a run that a task takes


def _run(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def differences(df: DataFrame, x: str, by: list[str], order: list[str]) -> DataFrame:
    """``d`` and ``d2``, first and second difference within a run."""
    w = _run(by, order)
    return df.withColumn("d", F.col(x) - F.lag(x).over(w)).withColumn("d2", F.col("d") - F.lag("d").over(w))


def base_label(sensitivity: float, d: Column | None = None, d2: Column | None = None):
    """A segment's kind from d and d2."""
    d, d2 = F.col("d") if d is None else d, F.col("d2") if d2 is None else d2
    moving = d.isNotNull() & (d != 0)
    return (
        F.when(d2 < -sensitivity, F.when(moving, "Cooling_start").otherwise("Heating_end"))
        .when(d2 > sensitivity, F.when(moving, "Heating_start").otherwise("Cooling_end"))
        .when(d > 0, "Heating")
        .when(d < 0, "Cooling")
        .otherwise("Isothermal")
    )


def _cycled(base: str = "base") -> Column:
    """The label with its cycle; the counts are in heat, cool and iso."""
    cycle = F.when(F.col(base).isin("Heating_end", "Cooling_end"), None).when(F.col(base).startswith("Heating"), F.col("heat")).when(F.col(base).startswith("Cooling"), F.col("cool")).otherwise(F.col("iso"))
    return F.concat_ws("_", base, cycle.cast("string"))


def segment_labels(df: DataFrame, x: str = "temperature_C", by: list[str] | None = None, order: list[str] | None = None, sensitivity: float = 0.1, keep_parts: bool = False) -> DataFrame:
    """``profile`` with cycle numbers for each row of each run.

    Runs are told apart by name, else run_id, else the whole table is one run (W4b); rows without a name are a
    run of their own. All windows share one partitioning and order, so there is one shuffle and one sort; a row's label and that of the row
    before it come from the last three values, so that rows pass through two windows only.
    """
    if x not in df.columns:
        raise ValueError(f"no column {x}")
    by = by if by is not None else [c for c in ("name", "run_id") if c in df.columns][:1]
    order = order or ["row_idx"]
    w = _run(by, order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = df.withColumns({"_n": F.row_number().over(w), **{f"_x{k}": F.lag(x, k).over(w) for k in (1, 2, 3)}})
    d, d2 = F.col(x) - F.col("_x1"), (F.col(x) - F.col("_x1")) - (F.col("_x1") - F.col("_x2"))
    before = F.when(F.col("_n") > 1, base_label(sensitivity, F.col("_x1") - F.col("_x2"), (F.col("_x1") - F.col("_x2")) - (F.col("_x2") - F.col("_x3")))).otherwise("")
    parts = {"d": d, "d2": d2} if keep_parts else {}
    out = near.withColumns({**parts, "base": base_label(sensitivity, d, d2), "_base": before}).drop("_n", "_x1", "_x2", "_x3")
    out = out.withColumn("starts", (F.col("base") == "Isothermal") & (F.col("_base") != "Isothermal")).drop("_base")
    ends = lambda what: F.sum(F.when(F.col("base") == what, 1).otherwise(0)).over(upto)
    out = out.withColumns({"heat": ends("Heating_end"), "cool": ends("Cooling_end"), "iso": F.sum(F.col("starts").cast("int")).over(upto) - 1})
    out = out.withColumn("profile", _cycled())
    return out if keep_parts else out.drop("base", "starts", "heat", "cool", "iso")


def row_chunks(rows: int = CHUNK, order: str = "row_idx") -> Column:
    """Chunks of a run by its row numbers."""
    return F.floor(F.col(order) / rows).cast("long")


def scanned_labels(df: DataFrame, x: str = "temperature_C", by: list[str] | None = None, order: list[str] | None = None, sensitivity: float = 0.1, chunk: Column | None = None) -> DataFrame:
    """W1 to W4 for runs larger than a task: a segmented prefix scan, equal to ``segment_labels``.

    ``chunk`` never falls along the order within a run (row numbers in ``CHUNK``s by default; a time span, for runs ordered by time). Windows look
    at one chunk only. Each chunk hands on its last three values, with which the label of every row and of the row before it is known where the row
    lies, and how many ends and starts it has; both are folded over the chunks of a run, and each chunk adds what comes before it.
    """
    if x not in df.columns:
        raise ValueError(f"no column {x}")
    by = by if by is not None else [c for c in ("name", "run_id") if c in df.columns][:1]
    order = order or ["row_idx"]
    folder = shared_folder(df.sparkSession)
    w = _run([*by, "_chunk"], order)
    lags = {f"_x{k}": F.lag(x, k).over(w) for k in (1, 2, 3)}
    near = stored(df.withColumn("_chunk", row_chunks() if chunk is None else chunk).withColumns({"_n": F.row_number().over(w), **lags}), folder, "near")
    keys = [*by, "_chunk"]
    chunks = Window.partitionBy(*by).orderBy("_chunk") if by else Window.orderBy("_chunk")  # a row a chunk
    last = near.groupBy(*keys).agg(F.max(F.struct("_n", x, "_x1", "_x2")).alias("l"))
    last = last.withColumn("v", F.slice(F.array(f"l.{x}", "l._x1", "l._x2"), F.lit(1), F.least("l._n", F.lit(3))))
    none = F.array().cast("array<" + df.schema[x].dataType.simpleString() + ">")
    carried = last.select(*keys, F.slice(F.concat(*[F.coalesce(F.lag("v", k).over(chunks), none) for k in (1, 2, 3)]), 1, 3).alias("_before"))
    met = joined_null_safe(near, carried, keys)
    x0, x1, x2, x3 = F.col(x), *[F.when(F.col("_n") > k, F.col(f"_x{k}")).otherwise(F.get("_before", F.lit(k) - F.col("_n"))) for k in (1, 2, 3)]
    base = base_label(sensitivity, x0 - x1, (x0 - x1) - (x1 - x2))
    before = F.when((F.col("_n") > 1) | (F.size("_before") > 0), base_label(sensitivity, x1 - x2, (x1 - x2) - (x2 - x3))).otherwise("")
    met = met.select(*df.columns, "_chunk", base.alias("base"), before.alias("_base")).withColumn("starts", (F.col("base") == "Isothermal") & (F.col("_base") != "Isothermal"))
    counts = {"heat": F.col("base") == "Heating_end", "cool": F.col("base") == "Cooling_end", "iso": F.col("starts")}
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    summed = met.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    summed = summed.select(*keys, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in counts])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined_null_safe(met, summed, keys).withColumns({name: F.col(f"_{name}") + F.sum(c.cast("int")).over(upto) - (1 if name == "iso" else 0) for name, c in counts.items()})
    return out.select(*df.columns, _cycled().alias("profile"))


def quotient(x: Column, y: Column) -> Column:
    """x / y in IEEE arithmetic, also where Spark's own division fails: by zero it is infinite, or NaN for zero and NaN."""
    y = y.cast("double")
    sign = F.signum(x.cast("double")) * F.when(y.cast("string").startswith("-"), -1.0).otherwise(1.0)
    by_zero = F.when(sign > 0, F.lit(float("inf"))).when(sign < 0, F.lit(float("-inf"))).when(sign.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, F.when(F.isnan(x), F.lit(float("nan"))).otherwise(by_zero)).otherwise(x / F.when(y != 0, y))


def mass_percent(df: DataFrame, mass: str = "mass_mg", by: list[str] | None = None, out: str = "mass_pct", mode: str = "minmax", order: list[str] | None = None, large: bool = False) -> DataFrame:
    """Percent of the mass span of a run (constant: 0), or of its first mass (which may be zero); a full column is left as it is.

    ``large``: a run's figures are aggregated, written and joined back, so that its rows needn't meet in one task: Spark knows
    the figures' size and sends them to the rows.
    """
    if mass not in df.columns:
        return df
    by = by or ["experiment_id"]
    figures = {"_first": F.min(F.struct(*(order or ["row_idx"]), mass))[mass]} if mode == "initial" else {"_low": F.min(mass), "_high": F.max(mass)}
    if out in df.columns:
        figures["_full"] = F.bool_and(F.col(out).isNotNull())
    if large:
        told = df.groupBy(*by).agg(*[c.alias(name) for name, c in figures.items()])
        met = joined_null_safe(df, stored(told, shared_folder(df.sparkSession), "figures"), by)
    else:
        w = Window.partitionBy(*by)
        met = df.withColumns({name: (F.min(F.struct(*(order or ["row_idx"]), mass)).over(w)[mass] if name == "_first" else c.over(w)) for name, c in figures.items()})
    low, high = F.col("_low"), F.col("_high")
    value = quotient(F.col(mass), F.col("_first")) * 100 if mode == "initial" else F.when(high == low, F.lit(0.0)).otherwise((F.col(mass) - low) / F.nullif(high - low, F.lit(0.0)) * 100)
    if out in df.columns:
        value = F.when(F.col("_full"), F.col(out)).otherwise(value)
    return met.withColumn(out, value).drop(*figures)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(_run(keys, order))).filter("_n = 1").drop("_n")


def latest_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key; nulls are oldest."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def appearance_order(df: DataFrame, group: str, order: str = "row_idx") -> DataFrame:
    """Groups by first appearance."""
    return df.groupBy(group).agg(F.min(order).alias("first_row")).orderBy("first_row")


CHARACTERISERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "dsc_profiling": lambda sensitivity=0.1, large=False, **kw: lambda df: (scanned_labels if large else segment_labels)(df, sensitivity=sensitivity, **kw),
    "tga": lambda **kw: lambda df: mass_percent(df, **kw),
}


def characteriser(name: str):
    """Register a user's characteriser factory under a name."""

    def add(make):
        CHARACTERISERS[name] = make
        return make

    return add


def characterize(df: DataFrame, kind: str | None, **options) -> tuple[DataFrame, dict]:
    """Apply a registered characteriser, and record what was applied."""
    if kind not in CHARACTERISERS:
        return df, {"applied": False, "name": kind}
    return df.transform(CHARACTERISERS[kind](**options)), {"applied": True, "name": kind}
