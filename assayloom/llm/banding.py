"""Groups of like classes: buckets of band keys, comparison inside buckets, connected components.

A *class* is one distinct value (a shingle set, a fingerprint) with the smallest doc_id that has it, a hash ``h`` and its band ``keys``.
Each member of a bucket is compared with the bucket's smallest class and with the few that hashing puts
into the same bin of about four, so that a large group hangs together after work linear in its size; then all pairs of a bucket whose ends
lie in different components yet are compared too, inside the join's own condition and at the first band two members share, so no link of a
bucket that could join two components is lost and no pairs within one component are made. Buckets of more than ``CELL`` members are
compared cell by cell (pairs of bins), so that no task has a large bucket to itself.

A doc_id with several different rows is one document in several classes: those are linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import stored
from assayloom.llm.components import connected_components

CELL = 1024


def _end(df: DataFrame, x: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}_{x}") for c in df.columns])


def numbered(rows: DataFrame, classes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(``classes`` with a number c, links between classes that share a doc_id, those doc_ids).

    ``rows`` (doc_id, h) without nulls; c is the class's smallest doc_id, or h where a doc_id has several classes.
    """
    twice = stored(rows.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("doc_id"), folder, "twice")
    if twice.isEmpty():
        return classes.withColumn("c", F.col("id")), None, twice
    marked = classes.join(twice.select(F.col("doc_id").alias("id"), F.lit(True).alias("clash")), "id", "left")
    marked = stored(marked.withColumn("c", F.when(F.col("clash"), F.col("h")).otherwise(F.col("id"))).drop("clash"), folder, "numbered")
    own = rows.join(twice, "doc_id").distinct().join(marked.select("h", "c"), "h")
    least = own.groupBy("doc_id").agg(F.min("c").alias("b"))
    return marked, own.join(least, "doc_id").select(F.col("c").alias("a"), "b").filter("a <> b").distinct(), twice


def components_of(
    classes: DataFrame,
    folder: str,
    likely: Column,
    verify: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    heavy: Callable[[DataFrame], DataFrame] | None = None,
    shared: Column | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """(id of class c, component) of the classes that have a link, given ``classes`` (c, keys, attributes).

    ``likely``: condition on attributes with _a and _b; ``verify(pairs (a, b), members (c))``: the pairs that are links (none: likely ones are);
    ``heavy(members (c))``: more attributes (with c) for the second step, and ``shared`` its further condition on them.
    """
    verify = verify or (lambda pairs, members: pairs)
    banded = classes.select("c", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min("c").alias("head"), F.count("*").alias("members")).filter("members > 1")
    members = stored(banded.join(heads, "key"), folder, "members")
    wanted = members.select("c").distinct()
    about = stored(classes.drop("id", "h").join(wanted, "c", "left_semi"), folder, "about")
    star = members.filter("c <> head").select(F.col("c").alias("c_a"), F.col("head").alias("c_b")).distinct()
    bins = members.filter("members > 2 and pmod(key, 4) = 0").select("key", "c", F.pmod(F.xxhash64("c", "key"), F.ceil(F.col("members") / 4)).alias("bin"))
    binned = _end(bins, "a", ("key", "bin")).join(_end(bins, "b", ("key", "bin")), ["key", "bin"]).filter("c_a > c_b").select("c_a", "c_b")
    brief = about.drop("keys")
    star = star.union(binned).distinct().join(_end(brief, "a"), "c_a").join(_end(brief, "b"), "c_b").filter(likely).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    first = stored(verify(star, wanted), folder, "links-1")
    parts = connected_components(first, folder, "parts")
    placed = members.select("key", "c").join(parts.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    torn = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", F.ceil(F.col("n") / CELL).cast("int").alias("g"))
    left = placed.join(torn, "key").withColumn("bin", F.pmod(F.xxhash64("c", "key"), "g").cast("int"))
    whom = about.join(left.select("c").distinct(), "c", "left_semi")
    if heavy:
        whom = whom.join(heavy(left.select("c").distinct()), "c")
    left = stored(left.join(whom, "c").withColumn("band", F.array_position("keys", F.col("key")).cast("int")), folder, "torn")
    cells = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("low", F.least("bin", "other")).withColumn("high", F.greatest("bin", "other")).drop("other", "g")
    at = ("key", "low", "high")
    earlier = F.arrays_overlap(F.slice("keys_a", F.lit(1), F.col("band_a") - 1), F.slice("keys_b", F.lit(1), F.col("band_b") - 1))
    apart = (F.col("component_a") < F.col("component_b")) & ((F.col("low") == F.col("high")) | (F.col("bin_a") != F.col("bin_b"))) & likely & ~earlier
    across = _end(cells, "a", at).join(_end(cells, "b", at), list(at)).filter(apart if shared is None else apart & shared)
    across = across.select(F.greatest("c_a", "c_b").alias("a"), F.least("c_a", "c_b").alias("b")).distinct()
    second = stored(verify(across.join(first, ["a", "b"], "left_anti"), wanted), folder, "links-2")
    every = first.union(second)
    return connected_components(every.union(links.select("a", "b")) if links is not None else every, folder, "whole")


def smallest(classes: DataFrame, components: DataFrame, own: DataFrame | None) -> DataFrame:
    """(c, component): for each of ``classes`` (c, id) the smallest doc_id of its component; ``own`` as numbered() gave it."""
    if own is None:  # every c is an id
        return classes.select("c").join(components.select(F.col("id").alias("c"), "component"), "c", "left").select("c", F.coalesce("component", "c").alias("component"))
    placed = classes.select("c", "id").join(components.select(F.col("id").alias("c"), "component"), "c", "left").withColumn("k", F.coalesce("component", "c"))
    least = placed.filter("component is not null").groupBy("k").agg(F.min("id").alias("least"))
    return placed.join(least, "k", "left").select("c", F.coalesce("least", "id").alias("component"))
