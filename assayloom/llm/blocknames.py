"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text, A-Z lower-cased, is cut into blocks of ``BLOCK`` bytes. All distinct blocks are sorted into integer names; the
blocks of a document become names, then adjacent names are paired and the distinct pairs named again, until each
document has one name. Two documents have the same name at the same level if and only if their texts are equal: blocks are told
apart by their bytes, pairs by their two names (a last name without a partner is paired with none, which is no name), and a document
of n blocks ends at level ceil(log2 n). No hash decides anything.

Every step is keyed by single blocks or pairs, never by a whole document, so a long text is spread over tasks. Copies of a block collapse
before they are shuffled to be named, and the joins back to the documents are plain ones that adaptive execution splits where a key
is frequent. Distinct blocks of each task go through the shuffle once; each level has half the rows of the one before, a few bytes each.

Defined cases: a null text counts as the empty one, which is one empty block; a row is a document of its own, so repeated rows are
copies of each other; the largest doc_id of a group stays, and ``kept`` marks each row with that doc_id (so repeated rows of one document
are all marked; ``deduplicated`` keeps one of them); a null doc_id is smaller than any other, and a group of null ids has the null keep_id
and is kept; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import shared_folder, stored
from assayloom.llm.naming import named

BLOCK = 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; the number of bytes stays."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _blocks(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each block: ``pos`` from 0, ``n`` blocks of its document, its bytes, and the document's ``body``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(*keep, lowered(text).cast("binary").alias("body"), F.greatest(F.lit(1), F.ceil(F.octet_length(text) / BLOCK)).cast("int").alias("n"))
    spread = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return spread.withColumn("block", F.substring("body", F.col("pos") * BLOCK + 1, F.lit(BLOCK)))


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(1), "block").alias("h1"), F.xxhash64(F.lit(2), "block").alias("h2")]


def block_names(docs: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """Names of all distinct blocks, and the columns by which they are looked up."""
    blocks = _blocks(docs).select("block")
    short = named(blocks, folder, "blocks", keep=_hashes())
    if short.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
        return short, ["h1", "h2"]
    return named(blocks, folder, "whole-blocks"), ["block"]


def identities(docs: DataFrame, folder: str) -> DataFrame:
    """A row for each row of ``docs``: row (a number), doc_id, sha (of the normalised text), and its identity (level, name)."""
    blocks, keys = block_names(docs, folder)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    first = F.col("pos") == 0
    by = ["block"] if keys == ["block"] else _hashes()
    placed = _blocks(rows, "row", "doc_id").select("row", "pos", "n", *by, F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.unhex(F.sha2("body", 256))).alias("sha"))
    ground = stored(placed.join(blocks, keys).drop(*keys), folder, "level-0")
    about = ground.filter("pos = 0").select("row", "doc_id", "sha")
    now, level, ended = ground.select("row", "pos", "n", "name"), 0, []
    most = ground.agg(F.max("n")).first()[0] or 1
    while True:
        ended.append(now.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = now.filter("n > 1").groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(F.shiftright(F.max("n") + 1, 1).alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        level, most = level + 1, (most + 1) // 2
        pairs = stored(pairs, folder, f"pairs-{level}")
        names = named(pairs.select("a", "b"), folder, f"names-{level}")
        now = stored(pairs.join(names, ["a", "b"]).select("row", "pos", "n", "name"), folder, f"level-{level}")
    whole = ended[0]
    for part in ended[1:]:
        whole = whole.union(part)
    return about.join(whole, "row")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text)."""
    folder = shared_folder(docs.sparkSession)
    found = stored(identities(docs, folder), folder, "identities")
    groups = stored(found.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), folder, "groups")
    return found.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text: of equal texts the row with the largest doc_id."""
    stays = exact_duplicates(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("sha")).distinct()
    marks = [f"_{'_'.join(docs.columns)}_{x}" for x in ("doc", "sha")]  # names no column has
    stays = stays.select(F.col("doc_id").alias(marks[0]), F.col("sha").alias(marks[1]))
    met = docs.withColumn(marks[1], F.unhex(F.sha2(lowered(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)))
    met = met.join(stays.withColumnRenamed(marks[1], f"{marks[1]}2"), F.col("doc_id").eqNullSafe(F.col(marks[0])) & (F.col(marks[1]) == F.col(f"{marks[1]}2")), "left_semi")
    return met.dropDuplicates(["doc_id", marks[1]]).drop(marks[1])
