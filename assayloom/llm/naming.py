"""Integer names of distinct rows: equal rows get one name, different rows never share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import stored


def named(rows: DataFrame, folder: str, name: str, ordered: bool = False, keep: list[Column] | None = None) -> DataFrame:
    """The distinct ``rows``, sorted, with a long column ``name``, written to the shared folder (``keep``: these columns in place of the rows').

    Copies collapse before the shuffle, whose partitions hold each distinct row once; the name is the partition's number and the
    place in its sorted order, so it depends on no hash being free of collisions. ``ordered``: names follow the order of
    the rows over all partitions, at the price of a second shuffle.
    """
    once = rows.distinct()
    sorted_rows = once.orderBy(*rows.columns) if ordered else once.sortWithinPartitions(*rows.columns)
    return stored(sorted_rows.select(*(rows.columns if keep is None else keep), F.monotonically_increasing_id().alias("name")), folder, name)
