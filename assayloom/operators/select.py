"""Filters and predicates (P10 to P15, P18), sorting and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERABLE = ("experiment_id", "dataset_name", "experiment_name", "sample_id", "run_id", "instrument_name", "instrument_type", "measurement_profile")
#: Beyond so many values a membership filter becomes a semi-join.
IN_LIST = 1000


def between(df: DataFrame, column: str, low: float = 280.0, high: float = 900.0) -> DataFrame:
    """P10: both ends included."""
    return df.filter(F.col(column).between(low, high))


def member(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose text form is listed."""
    texts = sorted({str(v) for v in values})
    if len(texts) <= IN_LIST:
        return df.filter(F.col(column).cast("string").isin(texts))
    wanted = df.sparkSession.createDataFrame([(t,) for t in texts], "wanted string")
    return df.join(wanted, F.col(column).cast("string") == F.col("wanted"), "left_semi")


def conjunction(df: DataFrame, filters: dict, allowed: tuple[str, ...] = FILTERABLE) -> DataFrame:
    """Equality on allow-listed columns; null filters are ignored."""
    unknown = set(filters) - set(allowed)
    if unknown:
        raise ValueError(f"no filter on {sorted(unknown)}")
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), [(k, v) for k, v in filters.items() if v is not None], df)


def any_of(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Rows that match some key's list; no key at all keeps nothing out."""
    tests = [F.col(k).isin(list(v)) for k, v in choices.items()]
    return df.filter(reduce(lambda a, b: a | b, tests)) if tests else df


def to_analyse(df: DataFrame, names: list[str] | None = None, status: str = "to_analyse") -> DataFrame:
    """Explicit names win, else the status if there is such a column, else all."""
    if names:
        return df.filter(F.col("name").isin(list(names)))
    return df.filter(F.col("status") == status) if "status" in df.columns else df


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Pushed down as StringStartsWith."""
    return df.filter(F.col(column).startswith(prefix))


def like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).like(pattern))


def detector(df: DataFrame, name: str) -> DataFrame:
    """P18."""
    return df.filter(F.col("detector_name") == name)


def latest(df: DataFrame, by: str = "registered_at", limit: int | None = None, key: str | None = None) -> DataFrame:
    """L1: newest first, as a top-k when limited."""
    out = df.orderBy(F.desc(by), *([F.asc(key)] if key else []))
    return out if limit is None else out.limit(limit)


def latest_metadata(df: DataFrame, limit: int | None = None, key: str = "dataset_name") -> DataFrame:
    """L2: by update, then creation, nulls last."""
    out = df.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), key)
    return out if limit is None else out.limit(limit)


def latest_named(df: DataFrame, name: str, column: str = "dataset_name", tie: str | None = None) -> DataFrame:
    """L3; ``tie``: the column whose smallest value wins between equally new rows."""
    return latest_metadata(df.filter(F.col(column) == name), 1, tie or column)


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """L4: rows of one page under a required order, and column types."""
    if limit < 1 or offset < 0 or not order:
        raise ValueError("limit is at least 1, offset at least 0, and an order is needed")
    return df.orderBy(*order).offset(offset).limit(limit), dict(df.dtypes)


def runs_by_status(runs: DataFrame, status: str | None = None, limit: int | None = None, key: str | None = None) -> DataFrame:
    """L5."""
    return latest(runs if status is None else runs.filter(F.col("status") == status), "created_at", limit, key)


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first rows, of any order or of a given one."""
    return (df.orderBy(*order) if order else df).limit(n)
