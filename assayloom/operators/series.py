"""Plot-ready series (E7): what kind of data a dataset is, its x and y columns and its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.scalar import group_label
from assayloom.operators.features import infer_group

# The x column of each kind, and y columns in order of preference.
X = {"uv_vis": "wavelength_nm", "ftir": "wavenumber_cm_inv", "dsc": "temperature_C", "tga": "temperature_C", "saxs": "q_inv_nm", "ms": "mz", "sec": "retention_time_min", "nmr": "chemical_shift_ppm"}
Y = {"uv_vis": ["absorbance_a_u", "transmittance_pct"], "ftir": ["absorbance_a_u", "transmittance_pct"], "dsc": ["heat_flow_mW"], "tga": ["mass_pct", "d_mass_dt_pct_min"], "saxs": ["intensity_a_u"], "ms": ["intensity_a_u"], "sec": ["detector_response_a_u"], "nmr": ["intensity_a_u"]}
SWEEPS = {
    "dma": {"frequency": "frequency_hz", "temperature": "temperature_C", "strain": "strain_pct", "time": "time_s"},
    "rheometer": {"frequency": "angular_frequency_rad_s", "strain": "strain_pct", "time": "time_s", "flow_curve": "shear_rate_s_inv"},
}
SWEEP_Y = {"dma": ["storage_modulus_mpa", "loss_modulus_mpa"], "rheometer": ["storage_modulus_pa", "loss_modulus_pa"]}
FLOW_Y = ["shear_stress_pa", "viscosity_pa_s"]


def kind_of(columns: list[str], kind: str | None = None, instrument_type: str | None = None, profile: str | None = None) -> str:
    """Explicit kind, else the instrument type, else a sweep's columns, else the first kind whose x and y are there."""
    for given in (kind, instrument_type):
        if given in X or given in SWEEPS:
            return given
    if profile:
        for name, ys in SWEEP_Y.items():
            if set(ys) & set(columns) or name == "rheometer" and set(FLOW_Y) & set(columns):
                return name
    for name, x in X.items():
        if x in columns and set(Y[name]) & set(columns):
            return name
    for name, ys in SWEEP_Y.items():
        if set(ys) & set(columns):
            return name
    raise ValueError("no kind fits the columns")


def axes_of(columns: list[str], kind: str, profile: str | None = None, signal: str | None = None) -> tuple[str, list[str]]:
    """The x column and the y columns; what is missing is an error."""
    if kind in SWEEPS:
        sweeps = SWEEPS[kind]
        told = [x for word, x in sweeps.items() if profile and word in profile]
        x = next((c for c in [*told, *sweeps.values()] if c in columns), None)
        ys = [c for c in (FLOW_Y if x == "shear_rate_s_inv" else SWEEP_Y[kind]) if c in columns]
    else:
        x, ys = (X[kind] if X[kind] in columns else None), [c for c in Y[kind] if c in columns][:1]
    if signal:
        ys = [signal] if signal in columns else []
    if x is None or not ys:
        raise ValueError(f"columns for {kind} are missing")
    return x, ys


def series(df: DataFrame, kind: str | None = None, signal: str | None = None, group_by: str | None = None, max_groups: int = 20, instrument_type: str | None = None, profile: str | None = None) -> tuple[DataFrame, dict]:
    """(signal, group, x, y, row_idx) rows, and what was resolved; too many groups give no rows and a warning."""
    kind = kind_of(df.columns, kind, instrument_type, profile)
    x, ys = axes_of(df.columns, kind, profile, signal)
    warnings: list[str] = []
    if kind == "dsc" and group_by is None and "profile" in df.columns:
        group = "profile"
    elif kind == "sec" and group_by is None and "detector_name" in df.columns:
        group = "detector_name"
    elif kind in SWEEPS and group_by is None:
        group = None
    else:
        group, warnings = infer_group(df, x, ys, group_by, max_groups, exclude=("row_idx",))
    index = F.col("row_idx") if "row_idx" in df.columns else F.lit(0)
    label = group_label(F.col(f"`{group}`")) if group else F.lit(None).cast("string")
    parts = [df.select(F.lit(y).alias("signal"), label.alias("group"), F.col(x).alias("x"), F.col(y).alias("y"), index.alias("row_idx")) for y in ys]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if group and group != "profile":
        n = df.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("\u0000"))).distinct().count()
        if n > max_groups:
            return out.limit(0), {"kind": kind, "x": x, "y": ys, "group": group, "warnings": [*warnings, f"{group} has {n} groups, more than {max_groups}"]}
    return out, {"kind": kind, "x": x, "y": ys, "group": group, "warnings": warnings}
