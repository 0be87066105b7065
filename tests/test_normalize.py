import math

import pytest
from pyspark.sql import functions as F

from assayloom.functions import scalar
from assayloom.functions.schemas import layers_for
from assayloom.operators import normalize as N

CASES = [
    ("dsc", "prior", ["Tr [°C]", "Value [mW]"], ["temperature_C", "heat_flow_mW"], None),
    ("dsc", "mettler_toledo", ["Tr [°C]", "Value [mW]"], ["temperature_C", "heat_flow_mW"], None),
    ("dsc", "perkin_elmer", ["Program Temperature", "Unsubtracted Heat Flow"], ["temperature_C", "heat_flow_mW"], None),
    ("tga", "tgaX", ["Temperature [°C]", "Mass [%]"], ["temperature_C", "mass_pct"], None),
    ("ftir", "bruker", ["Wavenumber [cm-1]", "Transmittance [%]"], ["wavenumber_cm_inv", "transmittance_pct"], None),
    ("ftir", "bruker", ["Wavenumber [cm-1]", "Absorbance"], ["wavenumber_cm_inv", "absorbance_a_u"], None),
    ("nmr", "bruker_nmr", ["ppm", "intensity"], ["chemical_shift_ppm", "intensity_a_u"], None),
    ("ms", "bruker", ["m/z", "intensity"], ["mz", "intensity_a_u"], None),
    ("saxs", "anton_paar", ["q", "I"], ["q_inv_nm", "intensity_a_u"], None),
    ("sec", "agilent", ["time (min)", "value", "detector_name"], ["retention_time_min", "detector_response_a_u", "detector_name"], None),
    ("rheometer", "anton_paar", ["w [rad/s]", "G' [Pa]", "G'' [Pa]"], ["angular_frequency_rad_s", "storage_modulus_pa", "loss_modulus_pa"], "oscillatory_frequency_sweep"),
    ("rheometer", "anton_paar", ["gamma [%]", "G' [Pa]", "G'' [Pa]"], ["strain_pct", "storage_modulus_pa", "loss_modulus_pa"], "oscillatory_strain_sweep"),
    ("dma", "ta_q800", ["Frequency [Hz]", "Storage Modulus [MPa]", "Loss Modulus [MPa]"], ["frequency_hz", "storage_modulus_mpa", "loss_modulus_mpa"], "oscillatory_frequency_sweep"),
    ("uv_vis", "flame", ["wavelength (nm)", "transmission"], ["wavelength_nm", "transmittance_pct"], None),
    ("uv_vis", "Shimadzu", ["Wavelength (nm)", "Absorbance"], ["wavelength_nm", "absorbance_a_u"], None),
]


@pytest.mark.parametrize("kind,model,raw,want,profile", CASES)
def test_renames_and_coerces(spark, kind, model, raw, want, profile):
    df = spark.createDataFrame([("1.5",) * len(raw), ("2",) * len(raw)], raw)
    out, report = N.normalize(df, kind, model, profile)
    assert out.columns == want
    assert all(t == ("string" if c == "detector_name" else "double") for c, t in out.dtypes)
    assert report["schema_applied"] and report["renamed_columns"] == {r: w for r, w in zip(raw, want) if r != w}
    if kind not in ("tga",):
        assert report["missing_required_columns"] == []
    else:
        assert report["missing_required_columns"] == ["mass_mg"]


def test_unknown_type_and_profile(spark):
    df = spark.createDataFrame([(1,)], ["x"])
    out, report = N.normalize(df, "laser")
    assert out.columns == ["x"] and not report["schema_applied"] and len(report["warnings"]) == 1
    _, report = N.normalize(df, "rheometer", "anton_paar", "spin")
    assert "spin" in report["warnings"][0]


def test_several_candidates_warn_and_first_wins(spark):
    df = spark.createDataFrame([("1", "2")], ["Tr [C]", "Tr [°C]"])
    out, report = N.normalize(df, "dsc", "prior")
    assert out.columns == ["Tr [C]", "temperature_C"] and any("several" in w for w in report["warnings"])


def test_unit_change_is_kept_and_told(spark):
    out, report = N.normalize(spark.createDataFrame([("3",)], ["time (min)"]), "dma", "ta_q800")
    assert out.first()[0] == 3.0 and any("unit" in w for w in report["warnings"])


def test_numbers(spark):
    texts = [" 1.5 ", "1d", "nan", "inf", "-2e3", "x", "", None, "0x1", ".5", "7."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.to_number(F.col("t"))).collect()]
    assert got == [1.5, None, None, math.inf, -2000.0, None, None, None, None, 0.5, 7.0]
    got = [r[0] for r in spark.createDataFrame([("3.0",), ("3.5",)], "t string").select(scalar.to_integer(F.col("t"))).collect()]
    assert got == [3, None]


def test_mixed_experiments_decide_by_experiment(spark):
    rows = spark.createDataFrame([("a", "ms", "bruker", None, {"m/z": "1", "intensity": "2"}), ("b", "ms", "bruker", None, {"mz": "3", "signal": "x"}), ("c", "laser", "q", None, {"w": "1"})], "experiment_id string, type string, model string, profile string, raw map<string,string>")
    out, reports = N.normalize_mixed(rows, [("ms", "bruker", None)])
    got = {r["experiment_id"]: (r["mz"], r["intensity_a_u"]) for r in N.canonical_columns(out, ["mz", "intensity_a_u"]).collect()}
    assert got == {"a": (1.0, 2.0), "b": (3.0, None), "c": (None, None)}
    told = {r["experiment_id"]: r["report"] for r in reports.collect()}
    assert told["a"]["renamed_columns"] == {"mz": "m/z", "intensity_a_u": "intensity"} and not told["c"]["schema_applied"]


def test_layers_merge():
    x = layers_for("dma", "ta_q800", "oscillatory_time_sweep")
    assert x.layers == ("base", "model:ta_q800", "profile:oscillatory_time_sweep") and x.required[0] == "time_s"


def test_names_and_times(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert f(scalar.strip_suffix(lit("test.txt"), ".txt")) == "test" and f(scalar.strip_suffix(lit("test.txt"), ".txt", legacy=True)) == "tes"
    assert f(scalar.titrant(lit("a_007"))) == "7" and f(scalar.titrant(lit("a_000"))) == "0"
    assert f(scalar.table_name(lit("--"))) == "dataset" and f(scalar.table_name(lit("a b-c"))) == "a_b_c"
    assert str(f(scalar.spectrum_time(lit("Date: Mon Jul 05 10:00:00 CEST 2024"), lit("a_1-250.txt")))) == "2024-07-05 08:00:00.250000"
    assert not f(scalar.is_sample_id(lit("S001\n"))) and f(scalar.is_sample_id(lit("S001")))
    for name, want in (("x_RID1A.csv", "ri"), ("VWD1A_run.csv", "uv"), ("a_LS_90.csv", "ls"), ("visc-1.csv", "viscometer"), ("other.csv", "unknown")):
        assert f(scalar.infer_detector(lit(name))) == want
    assert f(scalar.infer_profile(lit("Temperature ramp"))) == "oscillatory_temperature_sweep" and f(scalar.infer_profile(lit("spin"))) is None
    assert f(scalar.json_array(lit('["a"]'))) == ["a"] and f(scalar.json_array(lit(None).cast("string"))) == []


def test_null_columns_and_rows(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None)], "a double, b string")
    assert N.drop_null_columns(df).columns == ["a"]
    assert N.drop_null_rows(df.select("a")).count() == 1


def test_integers_of_mixed_rows(spark):
    from assayloom.functions.schemas import Schema

    own = {"c": Schema(("n",), {"m": {"n": ["N"]}}, dtypes={"n": "Int64"})}
    rows = spark.createDataFrame([("a", {"N": "1"}), ("a", {"N": "2.0"}), ("a", {"N": "x"}), ("b", {"N": "1.5"}), ("b", {"N": "3"}), ("d", {"Q": "1.5"})], "experiment_id string, raw map<string,string>").selectExpr("*", "'c' as type", "'m' as model", "cast(null as string) as profile")
    out, reports = N.normalize_mixed(rows, [("c", "m", None)], own)
    told = {r["experiment_id"]: r["report"]["warnings"] for r in reports.collect()}
    assert told == {"a": [], "b": ["could not cast column 'n' to an integer"], "d": []}
    got = sorted(((r["experiment_id"], r["n"]) for r in N.canonical_columns(out, ["n"], integers=("n",)).collect()), key=str)
    assert got == sorted([("a", 1), ("a", 2), ("a", None), ("b", None), ("b", 3), ("d", None)], key=str)
    assert dict(N.canonical_columns(out, ["n"], integers=("n",)).dtypes)["n"] == "bigint"


def test_columns_without_maps(spark):
    """the ingest's columns and reports are those of the general path, and no row's map is made anew."""
    from assayloom.functions.schemas import Schema

    rows = spark.createDataFrame([("a", "ms", "bruker", None, {"m/z": "1", "intensity": "2"}), ("a", "ms", "bruker", None, {"m/z": "x", "mz": "7"}), ("b", "ms", "bruker", None, {"mz": " 3 ", "intensity": None}), ("c", "no", "such", None, {"mz": "4"})], "experiment_id string, type string, model string, profile string, raw map<string,string>")
    whole = rows.selectExpr("experiment_id", "'c' as type", "'m' as model", "profile", "map('N', raw['m/z'], 'n2', '1.5') as raw").union(spark.createDataFrame([("d", "c", "m", None, {"N": "2.5"}), ("d", "c", "m", None, {"N": "2"})], rows.schema))
    order = lambda df: sorted(map(str, df.collect()))
    for df, kinds, columns, integers, own in ((rows, [("ms", "bruker", None)], ["mz", "intensity_a_u"], (), None), (whole, [("c", "m", None)], ["n"], ("n",), {"c": Schema(("n",), {"m": {"n": ["N"]}}, dtypes={"n": "Int64"})})):
        tidy, told = N.normalize_mixed(df, kinds, own)
        flat, reports = N.normalized_columns(df, kinds, columns, integers=integers, schemas=own)
        assert order(flat) == order(N.canonical_columns(tidy, columns, integers=integers)) and order(reports) == order(told)
        assert "transform_values" not in flat._jdf.queryExecution().executedPlan().toString()
