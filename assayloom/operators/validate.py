"""Registry rules (A1 to A4, J1 to J3, J5, J13, E1): every check is a set-oriented column or grouped count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions import scalar
from assayloom.functions.schemas import SCHEMAS, canonical_profiles
from assayloom.operators.normalize import joined_null_safe


def duplicates(df: DataFrame, keys: list[str], not_null: list[str] | None = None) -> DataFrame:
    """A1 to A3: (keys, rows) of key values met more than once; rows with a null among ``not_null`` are left out."""
    for c in not_null if not_null is not None else keys:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def duplicate_names(df: DataFrame, column: str = "name") -> DataFrame:
    """A1: one row with the sorted list of duplicate names."""
    return duplicates(df, [column]).agg(F.sort_array(F.collect_list(column)).alias("duplicates"))


def duplicate_files(df: DataFrame) -> DataFrame:
    """A2, or A3 where there is no file column: a message for each group."""
    file = "raw_data_filename" if "raw_data_filename" in df.columns else "name"
    found = duplicates(df, [file, "instrument_name"], ["instrument_name"])
    return found.select(F.concat(F.lit("duplicate "), F.lit(file), F.lit(" '"), F.coalesce(F.col(file), F.lit("")), F.lit("' for instrument '"), "instrument_name", F.lit("'")).alias("message"))


def summary(rows: DataFrame) -> DataFrame:
    """A4."""
    return rows.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def with_instruments(registry: DataFrame, instruments: DataFrame) -> DataFrame:
    """Registry rows with type and model; unknown instruments keep nulls. The configuration is a handful of rows."""
    right = instruments.select(scalar.fold(F.col("name")).alias("_key"), F.col("type"), F.col("model"), F.lit(True).alias("known"))
    out = registry.withColumn("_key", scalar.fold(F.col("instrument_name"))).join(right, "_key", "left")
    return out.withColumn("known", F.coalesce("known", F.lit(False))).drop("_key")


def without_parser(rows: DataFrame, parsers: DataFrame) -> DataFrame:
    """Rows whose (type, model) no parser serves."""
    return rows.join(parsers.select("type", "model").distinct(), ["type", "model"], "left_anti")


def without_schema(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Rows whose type has no schema."""
    return rows.join(types.select("type").distinct(), "type", "left_anti")


def match_profiles(rows: DataFrame, profiles: DataFrame, column: str = "profile", by: str | None = None) -> DataFrame:
    """``canonical`` for each distinct text of ``column``: exact, then without case, then with underscores, then token subset
    (fewest tokens, then alphabetical); null if none fits.

    Only distinct registry texts take part. The first three rules are equal keys; for the subsets an inverted index of the profiles' tokens
    is asked with each text's rarest token, if all its tokens are in the index at all, and what it gives is verified.
    """
    keys = [by] if by else []
    texts = rows.select(column, *keys).distinct()
    low, other = F.lower(F.col(column)), F.lower("canonical")
    asked = texts.filter(F.col(column).isNotNull()).select(column, *keys, low.alias("_low"), scalar.underscored(low).alias("_under"), scalar.tokens(F.col(column)).alias("_mine"))
    names = profiles.select("canonical", *keys).distinct().select("canonical", *keys, other.alias("_other"), scalar.tokens(F.col("canonical")).alias("_theirs"))
    equal = lambda mine, theirs, rank: asked.withColumn("_key", F.col(mine)).join(names.withColumn("_key", F.col(theirs)), ["_key", *keys]).withColumn("rank", F.lit(rank))
    postings = names.select("canonical", *keys, "_other", "_theirs", F.explode("_theirs").alias("_token"))
    frequent = postings.groupBy("_token", *keys).agg(F.count("*").alias("_n"))
    known = asked.select(column, *keys, "_mine", F.explode("_mine").alias("_token")).join(frequent, ["_token", *keys])
    rarest = known.groupBy(column, *keys, "_mine").agg(F.min_by("_token", F.struct("_n", "_token")).alias("_token"), F.count("*").alias("_found")).filter(F.col("_found") == F.size("_mine"))
    subsets = rarest.join(postings, ["_token", *keys]).filter(F.size(F.array_except("_mine", "_theirs")) == 0).withColumn("rank", F.lit(4))
    columns = [column, *keys, "canonical", "_other", "_theirs", "rank"]
    pairs = equal(column, "canonical", 1).select(*columns)
    for more in (equal("_low", "_other", 2), equal("_under", "_other", 3), subsets):
        pairs = pairs.union(more.select(*columns))
    order = ["rank", F.when(F.col("rank") == 4, F.size("_theirs")), F.when(F.col("rank") == 4, F.col("_other")), F.asc("canonical")]
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(column, *keys).orderBy(*order))).filter("_n = 1")
    return joined_null_safe(texts, best.select(column, *keys, "canonical"), [column, *keys], "left")


def diagnostic(instruments: DataFrame, parsers: DataFrame, types: DataFrame) -> DataFrame:
    """Instrument, errors and valid for every configured instrument."""
    a = parsers.select("type", "model").distinct().withColumn("has_parser", F.lit(True))
    b = types.select("type").distinct().withColumn("has_schema", F.lit(True))
    out = instruments.join(a, ["type", "model"], "left").join(b, "type", "left")
    errors = F.array_compact(F.array(
        F.when(F.col("type").isNull() | F.col("model").isNull(), "type or model is missing"),
        F.when(F.col("has_parser").isNull(), "no parser"),
        F.when(F.col("has_schema").isNull(), "no schema"),
    ))
    return out.select(F.col("name").alias("instrument_name"), errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


def validate_registry(registry: DataFrame, instruments: DataFrame, parsers: DataFrame, files: DataFrame | None = None, mark_first: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, global errors, summary).

    Rows: row_number, name, instrument_name, valid, errors [(field, message)], warnings [text]. Global errors: duplicate names
    or files, unsafe file names, a row each. ``files`` (name, matches, ambiguous) adds warnings. ``mark_first`` also puts global errors on row 1.
    """
    base = registry if "row_number" in registry.columns else registry.withColumn("row_number", F.monotonically_increasing_id() + 1)
    for c in ("raw_data_filename", "sample_id", "run_id", "measurement_profile", "description"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    for c in ("name", "instrument_name", "raw_data_filename", "sample_id", "run_id", "measurement_profile"):
        base = base.withColumn(c, scalar.blank_to_null(F.col(c)))
    rows = with_instruments(base, instruments)
    rows = rows.join(F.broadcast(parsers.select("type", "model").distinct().withColumn("has_parser", F.lit(True))), ["type", "model"], "left")
    wanted = scalar.profile_of(F.col("measurement_profile"), F.col("description"))
    rows = rows.withColumn("profile", wanted)
    profiles = registry.sparkSession.createDataFrame(canonical_profiles() or [("", "")], "type string, canonical string")
    rows = rows.join(match_profiles(rows.filter("profile is not null and type is not null"), profiles, "profile", "type"), ["profile", "type"], "left")
    error = lambda test, field, text: F.when(test, F.struct(F.lit(field).alias("field"), F.lit(text).alias("message")))
    has_instrument = F.col("instrument_name").isNotNull()
    errors = F.array_compact(F.array(
        error(F.col("name").isNull(), "name", "name is missing"),
        error(has_instrument & ~F.col("known"), "instrument_name", "unknown instrument"),
        error(F.col("known") & (F.col("type").isNull() | F.col("model").isNull()), "instrument_name", "instrument has no type or model"),
        error(F.col("known") & F.col("type").isNotNull() & F.col("has_parser").isNull(), "instrument_name", "no parser"),
        error(F.col("known") & F.col("type").isNotNull() & ~F.lower("type").isin(list(SCHEMAS)), "instrument_name", "no schema"),
        error(F.col("sample_id").isNotNull() & ~scalar.is_sample_id(F.col("sample_id")), "sample_id", "sample_id is malformed"),
        error(F.col("run_id").isNotNull() & ~scalar.is_run_id(F.col("run_id")), "run_id", "run_id is malformed"),
    ))
    warns = [F.when(~has_instrument, "no instrument_name; kept, not ingested"), F.when(F.col("profile").isNotNull() & F.col("known") & F.col("canonical").isNull() & F.lower("type").isin([k for k, s in SCHEMAS.items() if s.profiles]), "unknown measurement profile")]
    if files is not None:
        rows = rows.join(files.select("name", "matches", "ambiguous").withColumn("_listed", F.lit(True)), "name", "left")
        warns += [F.when(has_instrument & (F.coalesce("matches", F.lit(0)) == 0), "raw file not found"), F.when(F.coalesce("ambiguous", F.lit(False)), "raw file is ambiguous")]
    out = rows.select("row_number", "name", "instrument_name", "type", "model", F.col("canonical").alias("measurement_profile"), errors.alias("errors"), F.array_compact(F.array(*warns)).alias("warnings")).withColumn("valid", F.size("errors") == 0)
    unsafe = base.filter(F.col("raw_data_filename").isNotNull() & ~scalar.is_safe_name(F.col("raw_data_filename"))).select(F.concat(F.lit("unsafe file name '"), "raw_data_filename", F.lit("'")).alias("message")).distinct()
    files_base = base if "raw_data_filename" in registry.columns else base.drop("raw_data_filename")
    names = duplicates(base, ["name"]).select(F.concat(F.lit("duplicate name '"), "name", F.lit("'")).alias("message"))
    problems = names.union(duplicate_files(files_base)).union(unsafe)
    if mark_first:
        listed = problems.agg(F.collect_list(F.struct(F.lit("registry").alias("field"), "message")).alias("all"))
        first = listed.select(F.lit(1).cast("long").alias("row_number"), "all")
        out = out.join(first, "row_number", "left").withColumn("errors", F.when(F.col("all").isNotNull(), F.concat("errors", "all")).otherwise(F.col("errors"))).drop("all").withColumn("valid", F.size("errors") == 0)
    return out, problems, summary(out)
