"""Normalisation of raw measurements to the canonical vocabulary.

Two shapes of input: a DataFrame of one header set (columns as named by the instrument), or mixed rows
carrying ``raw`` (map of header to text) for many experiments at once, where presence is decided per experiment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.scalar import to_integer, to_number
from assayloom.functions.schemas import UNIT_CHANGES, Layers, Schema, layers_for
from assayloom.sources.shared import shared_folder, stored

INTEGERS = ("int64", "int", "int32", "integer", "long", "bigint")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def joined_null_safe(df: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``right``; null keys meet. Without keys ``right`` is one row."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & quoted(k).eqNullSafe(quoted(f"_of_{k}"))
    return df.join(other, same, how).drop(*[f"_of_{k}" for k in keys])


def chosen_aliases(headers: list[str], layers: Layers) -> tuple[dict[str, str], list[str]]:
    """P2 for known headers: {canonical: raw header} and warnings; a present canonical column is left alone."""
    taken, warnings = {}, []
    for canonical, aliases in layers.aliases.items():
        if canonical in headers:
            continue
        found = [a for a in aliases if a in headers]
        if found:
            taken[canonical] = found[0]
            if len(found) > 1:
                warnings.append(f"several columns for '{canonical}', using first: {found}")
            if (found[0], canonical) in UNIT_CHANGES:
                warnings.append(f"'{found[0]}' is in another unit than '{canonical}'; values are kept")
    return taken, warnings


def coerced(c: Column, dtype: str) -> Column:
    """Floats and integers as numbers with null for anything else, other types by try_cast."""
    if dtype in ("double", "float64", "float"):
        return to_number(c)
    if dtype.lower() in INTEGERS:
        return to_integer(c)
    return c.try_cast(dtype)


def normalize(df: DataFrame, kind: str, model: str | None = None, profile: str | None = None) -> tuple[DataFrame, dict]:
    """P1 to P5 for a DataFrame of one header set: the renamed and coerced DataFrame, and the report."""
    layers = layers_for(kind, model, profile)
    taken, warnings = chosen_aliases(df.columns, layers)
    source = {raw: [c for c, r in taken.items() if r == raw] for raw in taken.values()}
    warnings += [f"'{raw}' serves {names}; the last is used" for raw, names in source.items() if len(names) > 1]
    new_name = {raw: names[-1] for raw, names in source.items()}
    columns = []
    for c in df.columns:
        name = new_name.get(c, c)
        dtype = layers.dtypes.get(name)
        columns.append((coerced(quoted(c), dtype) if dtype else quoted(c)).alias(name))
    out = df.select(*columns)
    report = {
        "schema_applied": layers.applied,
        "schema_version": layers.version,
        "renamed_columns": {raw: name for raw, name in new_name.items()},
        "missing_required_columns": [c for c in layers.required if c not in out.columns],
        "warnings": [*layers.warnings, *warnings],
        "measurement_profile": profile,
        "layers_applied": list(layers.layers),
    }
    return out, report


def alias_table(spark, kinds: list[tuple[str, str, str | None]], schemas: dict[str, Schema] | None = None) -> DataFrame:
    """P1 as rows: (type, model, profile, aliases: [(canonical, names)], required, integer columns); bounded by the config."""
    rows = []
    for kind, model, profile in kinds:
        x = layers_for(kind, model, profile, schemas)
        integers = [c for c, t in x.dtypes.items() if t.lower() in INTEGERS]
        rows.append((kind, model, profile, list(x.aliases.items()), list(x.required), x.applied, x.version, list(x.layers), list(x.warnings), integers))
    return spark.createDataFrame(rows, "type string, model string, profile string, aliases array<struct<canonical: string, names: array<string>>>, required array<string>, applied boolean, version string, layers array<string>, notes array<string>, integers array<string>")


def normalize_mixed(rows: DataFrame, kinds: list[tuple[str, str, str | None]], schemas: dict[str, Schema] | None = None) -> tuple[DataFrame, DataFrame]:
    """P2 to P5 over many experiments at once.

    ``rows``: experiment_id, type, model, profile, raw map<string,string>, and any columns that are kept. Returns
    the rows with ``canonical`` map<string,double> plus ``text`` map<string,string> of all renamed columns, and one report row an experiment.
    An integer column that holds a number with a fraction in an experiment can't be cast there: a warning, and its values stay.
    """
    planned, reports = _planned(rows, kinds, schemas)
    plan = planned.select("experiment_id", "from_alias", "own", "integers")
    named = F.map_concat(F.map_filter("raw", lambda k, _: F.array_contains(F.col("own"), k)), F.transform_values("from_alias", lambda _, h: F.try_element_at("raw", h)))
    out = rows.join(plan, "experiment_id").withColumn("text", named).withColumn("canonical", F.transform_values("text", lambda _, v: to_number(v)))
    if any(t.lower() in INTEGERS for k in kinds for t in layers_for(*k, schemas).dtypes.values()):
        broken = F.filter(F.map_entries("canonical"), lambda e: F.array_contains(F.col("integers"), e["key"]) & (e["value"] != F.floor(e["value"])))
        uncast = out.select("experiment_id", F.explode(F.transform(broken, lambda e: e["key"])).alias("c"))
        reports = _uncast_told(reports, uncast)
    return out.drop("from_alias", "own", "raw", "integers"), reports


def normalized_columns(rows: DataFrame, kinds: list[tuple[str, str, str | None]], columns: list[str], text_columns: tuple[str, ...] = ("detector_name",), integers: tuple[str, ...] = (), schemas: dict[str, Schema] | None = None) -> tuple[DataFrame, DataFrame]:
    """``canonical_columns`` of ``normalize_mixed`` and the reports, without maps of all renamed columns.

    Which header serves a column is decided once an experiment and written, so that rows meet it where they lie and look up one key a column.
    """
    planned, _ = _planned(rows, kinds, schemas)
    planned = stored(planned, shared_folder(rows.sparkSession), "planned")
    chosen = [F.coalesce(F.try_element_at("from_alias", F.lit(c)), F.when(F.array_contains("own", c), F.lit(c))).alias(c) for c in columns]
    met = rows.join(planned.select("experiment_id", "integers", F.struct(*chosen).alias("_of") if chosen else F.lit(None).alias("_of")), "experiment_id")
    text = lambda c: F.try_element_at("raw", F.col("_of")[c])
    whole = lambda c: to_number(text(c)) == F.floor(to_number(text(c)))
    picked = [(text(c) if c in text_columns else F.when(whole(c), to_number(text(c)).cast("bigint")) if c in integers else to_number(text(c))).alias(c) for c in columns]
    reports = _reports(planned)
    known = {c for k in kinds for c, t in layers_for(*k, schemas).dtypes.items() if t.lower() in INTEGERS}
    if checked := [c for c in columns if c in known]:
        broken = [F.when(F.array_contains("integers", c) & ~whole(c), F.lit(c)) for c in checked]
        reports = _uncast_told(reports, met.select("experiment_id", F.explode(F.array(*broken)).alias("c")).filter("c is not null"))
    return met.select(*[c for c in rows.columns if c != "raw"], *picked), reports


def _uncast_told(reports: DataFrame, uncast: DataFrame) -> DataFrame:
    """Reports with a warning for each integer column of (experiment_id, c)."""
    uncast = uncast.groupBy("experiment_id").agg(F.sort_array(F.collect_set("c")).alias("uncast"))  # names of the configuration
    told = F.transform(F.coalesce("uncast", F.array().cast("array<string>")), lambda c: F.concat(F.lit("could not cast column '"), c, F.lit("' to an integer")))
    return reports.join(uncast, "experiment_id", "left").select("experiment_id", F.col("report").withField("warnings", F.concat("report.warnings", told)).alias("report"))


def _planned(rows: DataFrame, kinds: list[tuple[str, str, str | None]], schemas: dict[str, Schema] | None) -> tuple[DataFrame, DataFrame]:
    """(what an experiment's headers are renamed to, reports), a row an experiment each."""
    aliases = F.broadcast(alias_table(rows.sparkSession, kinds, schemas))  # a row a configured (type, model, profile)
    ids = ["experiment_id", "type", "model", "profile"]
    seen = rows.select(*ids, F.map_keys("raw").alias("keys")).distinct()  # few a file, so sets are made of few rows
    headers = seen.groupBy(*ids).agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("headers"))
    keys = [F.col(f"h.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("type", "model", "profile")]
    met = headers.alias("h").join(aliases.alias("a"), keys[0] & keys[1] & keys[2], "left").select("h.*", "aliases", "required", "applied", "version", "layers", "notes", "integers")
    present = lambda x: F.array_contains(F.col("headers"), x["canonical"])
    found = F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<struct<canonical:string,names:array<string>>>")), lambda x: ~present(x)), lambda x: F.struct(x["canonical"].alias("canonical"), F.filter(x["names"], lambda n: F.array_contains(F.col("headers"), n)).alias("found")))
    taken = F.filter(found, lambda x: F.size(x["found"]) > 0)
    planned = met.withColumn("taken", taken)
    renamed = F.map_from_entries(F.transform("taken", lambda x: F.struct(x["canonical"], x["found"][0])))
    own = F.filter("headers", lambda h: ~F.exists(F.col("taken"), lambda x: x["found"][0] == h))
    planned = planned.select("*", renamed.alias("from_alias"), own.alias("own"))
    return planned, _reports(planned)


def _reports(planned: DataFrame) -> DataFrame:
    missing = F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.array_union(F.map_keys("from_alias"), F.col("own")))
    several = F.transform(F.filter("taken", lambda x: F.size(x["found"]) > 1), lambda x: F.concat(F.lit("several columns for '"), x["canonical"], F.lit("', using first")))
    changes = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("raw")) for a, c in sorted(UNIT_CHANGES)])
    changed = F.transform(F.filter("taken", lambda x: F.exists(changes, lambda u: (u["canonical"] == x["canonical"]) & (u["raw"] == x["found"][0]))), lambda x: F.concat(F.lit("'"), x["found"][0], F.lit("' is in another unit than '"), x["canonical"], F.lit("'; values are kept")))
    return planned.select(
        "experiment_id",
        F.struct(
            F.coalesce("applied", F.lit(False)).alias("schema_applied"), F.col("version").alias("schema_version"), F.col("from_alias").alias("renamed_columns"), missing.alias("missing_required_columns"),
            F.concat(F.coalesce("notes", F.array(F.lit("no schema"))), several, changed).alias("warnings"), F.col("profile").alias("measurement_profile"), F.coalesce("layers", F.array().cast("array<string>")).alias("layers_applied"),
        ).alias("report"),
    )


def canonical_columns(df: DataFrame, columns: list[str], text_columns: tuple[str, ...] = ("detector_name",), integers: tuple[str, ...] = ()) -> DataFrame:
    """Project the maps of normalize_mixed to fixed columns; of ``integers``, numbers with a fraction are null."""
    value = lambda c: F.try_element_at("text" if c in text_columns else "canonical", F.lit(c))
    picked = [(F.when(value(c) == F.floor(value(c)), value(c).cast("bigint")) if c in integers else value(c)).alias(c) for c in columns]
    return df.select(*[c for c in df.columns if c not in ("canonical", "text")], *picked)


def attach_ids(df: DataFrame, registry: DataFrame, on: str = "experiment_id") -> DataFrame:
    """experiment_id, sample_id and run_id from the registry where they are absent or null."""
    ids = [c for c in ("experiment_id", "sample_id", "run_id") if c in registry.columns and c != on]
    right = registry.select(on, *[F.col(c).alias(f"registry_{c}") for c in ids])
    out = df.join(right, on, "left")
    for c in ids:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"registry_{c}")) if c in df.columns else F.col(f"registry_{c}"))
    return out.drop(*[f"registry_{c}" for c in ids])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if t in ("double", "float") else quoted(c) for c, t in df.dtypes])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate decides."""
    counts = df.agg(*[F.count(quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    return df.select(*[quoted(c) for k, c in enumerate(df.columns) if counts[k]])


def drop_null_rows(df: DataFrame, how: str = "any") -> DataFrame:
    """Rows that are null in all, or in any, columns go; NaN counts as null."""
    return nan_to_null(df).dropna(how)


def peak_flag(points: DataFrame, peaks: DataFrame, keys: tuple[str, ...] = ("source_file", "mz")) -> DataFrame:
    """``peaks`` is true where a row's keys are in the peak list."""
    listed = peaks.select(*keys).distinct().withColumn("peaks", F.lit(True))
    return points.join(listed, list(keys), "left").withColumn("peaks", F.coalesce("peaks", F.lit(False)))


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row a value column, as _y_metric and _y_value."""
    return df.unpivot(ids, values, "_y_metric", "_y_value")


def numeric_columns(df: DataFrame) -> DataFrame:
    """P19."""
    return df.select(*[quoted(c) for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")])


def sorted_columns(df: DataFrame) -> DataFrame:
    """P21."""
    return df.select(*[quoted(c) for c in sorted(df.columns)])


def with_extras(df: DataFrame, known: tuple[str, ...], name: str = "metadata") -> DataFrame:
    """Unknown columns collected into a map, without nulls; description and registry_measurement_profile too."""
    extra = [c for c in df.columns if c not in known]
    keys = F.array(*[F.lit(c) for c in extra]) if extra else F.array().cast("array<string>")
    values = F.array(*[quoted(c).cast("string") for c in extra]) if extra else F.array().cast("array<string>")
    return df.select(*[quoted(c) for c in df.columns if c in known], F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v.isNotNull() & (v != "")).alias(name))


def named_rows(df: DataFrame, column: str = "name") -> DataFrame:
    """Names that aren't null or empty; none at all is an error."""
    out = df.filter(F.col(column).isNotNull() & (F.trim(column) != "")).select(column)
    if out.isEmpty():
        raise ValueError(f"no row has a {column}")
    return out
