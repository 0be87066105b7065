"""Scalar functions on columns; every one is a composition of Spark built-ins, so it stays in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_ID, RUN_ID, SAFE_NAME = r"\AS[0-9]{3,6}\z", r"\AR[0-9]{3,6}\z", r"\A[A-Za-z0-9_\-\.]+\z"
#: Keywords of a description, first match wins, and the profile they stand for.
PROFILE_KEYWORDS = (
    (("freq", "frequency", "oscill"), "oscillatory_frequency_sweep"),
    (("temp",), "oscillatory_temperature_sweep"),
    (("strain", "amplitude"), "oscillatory_strain_sweep"),
    (("flow", "viscos", "shear"), "flow_curve"),
)
#: What a token of a file name starts with, and the detector it stands for; first detector wins.
DETECTORS = (
    ("ri", ("ri", "refractive", "dri")),
    ("uv", ("uv", "dad", "vwd", "pda")),
    ("ls", ("ls", "lightscattering", "mals", "rals", "lals")),
    ("viscometer", ("visc", "dp")),
)
#: Decimal numbers and the names that stand for one; "1d" and "0x1" are no numbers.
NUMBER = r"\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:inity)?)\s*\z"


def blank_to_null(c: Column) -> Column:
    """trimmed text; empty, and the text of NaN, count as missing."""
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t) != "nan", F.nullif(t, F.lit("")))


def rounded(c: Column, digits: int) -> Column:
    """A double to ``digits`` decimals as SQL's round has it: times the power of ten in binary, halves away from zero.

    ``F.round`` goes by the shortest decimal text: 0.09 / 160 * 100 is 0.056249999999999994, which it takes down where SQL takes it up.
    """
    ten = float(10**digits)
    whole = F.rint(F.abs(c * ten))
    up = F.when(F.abs(c * ten) - whole == 0.5, whole + 1).otherwise(whole)  # rint goes to the even one
    out = F.signum(c) * up / ten
    return F.when(F.abs(out) == float("inf"), c).otherwise(out)


def fold(c: Column) -> Column:
    """trimmed and lower-cased, for names compared without case."""
    return F.lower(F.trim(c))


def is_sample_id(c: Column) -> Column:
    """S and 3 to 6 digits, nothing else."""
    return c.rlike(SAMPLE_ID)


def is_run_id(c: Column) -> Column:
    return c.rlike(RUN_ID)


def is_safe_name(c: Column) -> Column:
    return c.rlike(SAFE_NAME)


def infer_profile(description: Column, keywords=PROFILE_KEYWORDS) -> Column:
    """measurement profile by keywords of a description; null if none is there."""
    text = F.lower(F.coalesce(description, F.lit("")))
    out = None
    for words, profile in keywords:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, profile) if out is None else out.when(hit, profile)
    return out


def profile_of(explicit: Column, description: Column) -> Column:
    """an explicit profile wins over an inferred one."""
    return F.coalesce(blank_to_null(explicit), infer_profile(description))


def run_or_default(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("R001"))


def tokens(c: Column) -> Column:
    """the set of [a-z0-9]+ tokens of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def underscored(c: Column) -> Column:
    """blanks and hyphens become underscores."""
    return F.translate(c, " -", "__")


def base_name(path: Column) -> Column:
    """F8: last part of a path."""
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    base = base_name(path)
    before = F.length(base) - F.length(F.substring_index(base, ".", -1))  # up to the last dot; 0 without one
    return F.when(before > 1, F.substr(base, F.lit(1), before - 1)).otherwise(base)


def strip_suffix(name: Column, ext: str, legacy: bool = False) -> Column:
    """drop an extension. ``legacy`` strips any trailing characters out of the extension's letters instead."""
    if legacy:
        return F.rtrim(name, F.lit(ext))
    return F.when(name.endswith(ext), F.substr(name, F.lit(1), F.length(name) - len(ext))).otherwise(name)


def before_dollar(name: Column) -> Column:
    """what stands before the first $ of a file name."""
    return F.split(name, r"\$")[0]


def titrant(name: Column) -> Column:
    """last token after _, without leading zeros; '0' if nothing is left."""
    return F.coalesce(F.nullif(F.ltrim(F.element_at(F.split(name, "_"), -1), F.lit("0")), F.lit("")), F.lit("0"))


def without_dx(name: Column) -> Column:
    """F11."""
    return F.replace(name, F.lit(".dx_"), F.lit("_"))


def infer_detector(name: Column, detectors=DETECTORS) -> Column:
    """detector by how some token of a file name begins."""
    text = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " ")
    out = None
    for detector, starts in detectors:
        hit = text.rlike(rf"(?:\A| )(?:{'|'.join(starts)})")
        out = F.when(hit, detector) if out is None else out.when(hit, detector)
    return out.otherwise("unknown")


def spectrum_time(line: Column, file_name: Column) -> Column:
    """'Mon Jan 05 10:00:00 CET 2024' (CET or CEST) as UTC, plus the milliseconds after the file name's last '-'."""
    at = F.concat_ws(" ", *[F.regexp_extract(line, r"([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d\d:\d\d:\d\d)\s+(CES?T)\s+(\d{4})", k) for k in (1, 2, 3, 5)])
    zone = F.regexp_extract(line, r"\d\s+(CES?T)\s+\d{4}", 1)
    local = F.try_to_timestamp(at, F.lit("MMM d HH:mm:ss yyyy"))
    utc = F.when(zone == "CET", local - F.expr("interval 1 hour")).when(zone == "CEST", local - F.expr("interval 2 hours"))
    millis = F.regexp_extract(file_name, r"-(\d+)(?:\.[^.]*)?\z", 1).try_cast("int")
    return F.timestamp_millis(F.unix_millis(utc) + F.coalesce(millis, F.lit(0)))


def to_number(c: Column) -> Column:
    """double of a numeric text; anything else, and NaN, is null."""
    t = c.cast("string")
    return F.when(t.rlike(NUMBER), F.trim(t).try_cast("double"))


def to_integer(c: Column) -> Column:
    """Long of an integral number; null otherwise."""
    value = to_number(c)
    return F.when(value == F.floor(value), value.try_cast("long"))


def table_name(c: Column) -> Column:
    """a name that is safe in SQL."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_]+", "_"), F.lit("_")), F.lit("")), F.lit("dataset"))


def joined(sep: str, *parts: Column) -> Column:
    """F16: the parts that aren't empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def experiment_id(instrument: Column, file_name: Column) -> Column:
    """12 hex digits, the same at every run for the same pair."""
    return F.substr(F.sha2(F.concat_ws("\u0001", instrument, file_name), 256), F.lit(1), F.lit(12))


def storage_backend(provenance_json: Column) -> Column:
    """F18."""
    return F.get_json_object(provenance_json, "$.storage.backend")


def backfilled_paths(provenance_json: Column, path: Column) -> tuple[Column, Column]:
    """(local path, cloud path) of a stored dataset, from its provenance or else its path's kind."""
    local, cloud = F.get_json_object(provenance_json, "$.storage.local_path"), F.get_json_object(provenance_json, "$.storage.cloud_path")
    far = is_remote(path)
    return F.coalesce(local, F.when(~far, path)), F.coalesce(cloud, F.when(far, path))


def json_array(c: Column, item: str = "string") -> Column:
    """an array out of JSON; broken or missing JSON is the empty array."""
    return F.coalesce(F.from_json(c, f"array<{item}>"), F.from_json(F.lit("[]"), f"array<{item}>"))


def last_change(updated: Column, created: Column) -> Column:
    """F20."""
    return F.coalesce(updated, created, F.current_timestamp())


def no_nan(c: Column) -> Column:
    """F21."""
    return F.when(~F.isnan(c), c)


def parser_key(kind: Column, model: Column) -> Column:
    """type:model, null unless both are known."""
    return F.when(kind.isNotNull() & model.isNotNull(), F.concat_ws(":", kind, model))


def is_remote(path: Column) -> Column:
    return path.rlike(r"\A(?:s3|s3a|az|abfss|https)://")


def storage_label(path: Column) -> Column:
    """F23."""
    return F.when(is_remote(path), "cloud").otherwise("local")


def is_boundary(label: Column) -> Column:
    """labels of a segment's start or end."""
    return F.lower(label).rlike("start|end")


def group_label(c: Column) -> Column:
    """F25."""
    return F.coalesce(c.cast("string"), F.lit("<missing>"))


def listed(c: Column) -> Column:
    """comma list without blanks and empty items."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
