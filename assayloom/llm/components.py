"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import stored

#: Rows of one node that a task can take (16 bytes each); at most so many nodes have more, and their smallest neighbours are broadcast.
NODE_ROWS, HOT = 1_000_000, 50_000


def _with_least(rows: DataFrame, ends: DataFrame, links: int) -> DataFrame:
    """``rows`` (a, b) with m, the smallest b of a in ``ends`` (a, b).

    Nodes of more than max(NODE_ROWS, 2 * links / HOT) ends, so fewer than HOT, don't go to one task each but meet their rows where these are.
    """
    least = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if 2 * links <= NODE_ROWS:  # no node can have more
        return rows.join(least.select("a", "m"), "a")
    hot = F.broadcast(least.filter(F.col("n") > max(NODE_ROWS, 2 * links // HOT)).select("a", "m"))
    cold = rows.join(hot.select("a"), "a", "left_anti").join(least.select("a", "m"), "a")
    return cold.union(rows.join(hot, "a").select(*cold.columns))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = _with_least(both.filter("b > a"), both, n).withColumn("m", F.least("a", "m"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    moved = _with_least(down, down, n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
    return moved.select("x.*").filter("a <> b").distinct()


def connected_components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    ``links`` has long columns a and b. Rounds are written to the shared folder, so that lineage stays short.
    Ends when a round changes nothing; the number of rounds is logarithmic in practice.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    seen, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen, k = tuple(mark), k + 1
        half = _large_star(now, mark[0])
        if 2 * mark[0] > NODE_ROWS:  # read more than once below
            half = stored(half, folder, f"{name}-{k}-large")
        now = stored(_small_star(half, mark[0]), folder, f"{name}-{k}")
    tops = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops.select("id", F.col("id").alias("component")))
