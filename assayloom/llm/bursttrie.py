"""The prefix trie of conversations as a burst trie.

Distinct turns (role, text) get integer ids in the order of their texts, so a conversation is a sequence of ids. Equal sequences are one from then
on. At first the head of the root holds all sequences in one container. A container of more than ``LIMIT`` sequences or ``TURNS``
turns bursts by the next turn id: each id gives a smaller container, and what all sequences of it share after that id
goes into the head at once, so a long common beginning costs one round. What is left in a container is sorted and swept
into nodes in one pass: the stack of the sweep holds one path and the finished children of its nodes. Nodes of the
heads take their leaves and tokens from the containers and heads below them, round by round.

A node is named by its smallest member and its depth. Hot first turns and hot beginnings are burst, repeated conversations
collapse before they are shuffled, and the SHA-256 of a node's ends is taken over texts of many ids each, made beforehand in pieces
by ranges of (sequence, conv_id), so only the hashing itself of one node goes through one task. The rounds are as many as
branchings with oversized containers lie below each other. A conversation is one row of 12 bytes a turn.

Defined cases: rows without conv_id take no part; a null role or text is empty; turns of one number lie in order of (role, text), and a
repeated row is a turn of its own; a conversation without turns after its rebuilding ends at the root; an empty table
has no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import lean, shared_folder, stored
from assayloom.llm.naming import named

LIMIT, TURNS = 4096, 1_000_000
#: Ids of one piece of the text that is hashed for a node's ends; rows of an Arrow batch that the sweep gives.
PIECE, ROWS = 8192, 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = NODE + ", up long, up_depth int, top boolean"


def sequences_of(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id and seq: the turns of each conversation in order, as (t: id of the distinct turn, w: words of its text)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    turns = named(rows.select("role", "text"), folder, "turns", ordered=True)
    met = rows.join(turns, ["role", "text"]).select("conv_id", "turn", F.col("name").alias("t"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    return met.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t", "w"))).alias("s")).select("conv_id", F.transform("s", lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("seq"))


def rebuilt(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of c - c % ``every`` before its own turns after its first h; h = crc32(c) % ``most``."""
    c = F.col("conv_id")
    firsts = sequences.filter(c % every == 0).select(c.alias("root"), F.slice("seq", 1, most - 1).alias("first"))
    met = sequences.withColumn("root", c - c % every).join(firsts, "root", "left").withColumn("h", (F.crc32(c.cast("string").cast("binary")) % most).cast("int"))
    head = F.slice(F.coalesce("first", F.array().cast(sequences.schema["seq"].dataType)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))).alias("seq"))


def _pieces(batches):
    """Rows (sid, conv_id) in order to rows (sid, first, n, ids): runs of ids of one sequence as text."""
    for batch in batches:
        sids, convs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        out, at = ([], [], [], []), 0
        while at < len(sids):
            end = at + 1
            while end < len(sids) and end - at < PIECE and sids[end] == sids[at]:
                end += 1
            for column, x in zip(out, (sids[at], convs[at], end - at, ",".join(map(str, convs[at:end])))):
                column.append(x)
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["sid", "first", "n", "ids"])


def _hashed(batches):
    """Rows (sid, first, n, ids) in order to one row a sequence: sid, n, lo, sha."""
    now, digest, n, lo = None, None, 0, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((now, pa.int64()), (n, pa.int64()), (lo, pa.int64()))] + [pa.array([digest.hexdigest()], pa.string())], names=["sid", "n", "lo", "sha"])

    held = []
    for batch in batches:
        for sid, first, some, ids in zip(*(batch.column(c).to_pylist() for c in ("sid", "first", "n", "ids"))):
            if sid != now:
                if digest:
                    held.append(row())
                now, digest, n, lo = sid, hashlib.sha256(), 0, first
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += some
        if len(held) > ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if digest:
        held.append(row())
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def distinct_sequences(whole: DataFrame, folder: str) -> DataFrame:
    """seq, n conversations that have it, lo the smallest of them, sha of all of them: one row for each distinct sequence of ``whole`` (conv_id, seq)."""
    names = named(whole.select("seq"), folder, "sequences")
    members = whole.join(names, "seq").select(F.col("name").alias("sid"), "conv_id")
    pieces = members.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(lean(_pieces), "sid long, first long, n long, ids string")
    ends = pieces.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(lean(_hashed), "sid long, n long, lo long, sha string")
    return stored(names.withColumnRenamed("name", "sid").join(ends, "sid").drop("sid"), folder, "distinct")


def sweep(batches):
    """Nodes of containers: rows (up, depth, t, w, n, lo, sha) sorted by (up, depth, t), t and w being what follows the head.

    An open node is [t, w, n, lo, children, leaves, saved, sha, rows of its children that lack its smallest member].
    """
    out, path, before, key = [], [], [], None

    def close(to: int) -> None:
        while len(path) > to:
            t, w, n, lo, children, leaves, saved, sha, pending = path.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * w
            out.extend((c, d, lo, *rest, None, None, False) for c, d, *rest in pending)
            row = (lo, key[1] + len(path) + 1, n, children, leaves, saved, sha)
            if path:
                up = path[-1]
                up[2] += n
                up[3] = lo if up[3] is None else min(up[3], lo)
                up[4] += 1
                up[5] += leaves
                up[6] += saved
                up[8].append(row)
            else:
                out.append((row[0], row[1], key[0], *row[2:], key[0], key[1], True))

    def batch():
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in _SWEPT.split(", ")])

    for rows in batches:
        for up, depth, t, w, n, lo, sha in zip(*(rows.column(c).to_pylist() for c in ("up", "depth", "t", "w", "n", "lo", "sha"))):
            same = 0
            if (up, depth) == key:
                for x, y in zip(t, before):
                    if x != y:
                        break
                    same += 1
            close(same)
            key, before = (up, depth), t
            path.extend([x, y, 0, None, 0, 0, 0, NO_ENDS, []] for x, y in zip(t[same:], w[same:]))
            end = path[-1]
            end[2] += n
            end[3] = lo if end[3] is None else min(end[3], lo)
            end[7] = sha
            if len(out) > ROWS:
                yield batch()
                out.clear()
    close(0)
    if out:
        yield batch()


def trie(sequences: DataFrame, folder: str, limit: int = LIMIT, turns: int = TURNS) -> DataFrame:
    """The nodes of the trie over ``sequences`` (seq, n, lo, sha), as they lie in NODE."""
    spark = sequences.sparkSession
    root = sequences.agg(F.sum("n"), F.min("lo")).first()
    if root[0] is None:
        return spark.createDataFrame([], NODE)
    heads = [spark.createDataFrame([(None, -1, root[1], 0, root[0], [])], "up long, up_depth int, lo long, depth int, n long, words array<int>")]
    at = ["up", "depth", "next"]
    still = sequences.withColumns({"up": F.lit(root[1]).cast("long"), "depth": F.lit(0)})
    closed, steps_of, k = [], [], 0
    while True:
        still = still.withColumn("next", F.get("seq", F.col("depth"))["t"])
        steps = still.groupBy(*at).agg(F.count("*").alias("m"), F.sum(F.size("seq") - F.col("depth")).alias("turns"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.min("seq").alias("a"), F.max("seq").alias("b"))
        steps = stored(steps, folder, f"steps-{k}")
        steps_of.append(steps.groupBy("up", "depth").agg(F.count("next").alias("n_children")))
        alike = F.array_position(F.zip_with("a", "b", lambda x, y: x["t"].eqNullSafe(y["t"])), F.lit(False)).cast("int")
        burst = steps.filter((F.col("m") > 1) & F.col("next").isNotNull() & ((F.col("m") > limit) | (F.col("turns") > turns))).withColumn("to", F.when(alike > 0, alike - 1).otherwise(F.size("a")))
        k += 1
        words = F.transform(F.slice("a", F.col("depth") + 1, F.col("to") - F.col("depth")), lambda x: x["w"])
        new = stored(burst.select("up", "depth", "next", "lo", "to", "n", words.alias("words")), folder, f"heads-{k}")
        if new.isEmpty():
            closed.append(still.drop("next"))
            break
        heads.append(new.select("up", F.col("depth").alias("up_depth"), "lo", F.col("to").alias("depth"), "n", "words"))
        moved = stored(still.join(new.select(*at, F.col("lo").alias("new_up"), F.col("to").alias("new_depth")), at, "left").drop("next"), folder, f"moved-{k}")
        closed.append(moved.filter("new_up is null").drop("new_up", "new_depth"))
        still = moved.filter("new_up is not null").drop("up", "depth").withColumnsRenamed({"new_up": "up", "new_depth": "depth"}).select(*closed[-1].columns)
    whole, children = closed[0], steps_of[0]
    for more, counts in zip(closed[1:], steps_of[1:]):
        whole, children = whole.union(more), children.union(counts)
    rest = F.slice("seq", F.col("depth") + 1, F.size("seq") - F.col("depth"))
    inside = whole.filter(F.size("seq") > F.col("depth")).select("up", "depth", F.transform(rest, lambda x: x["t"]).alias("t"), F.transform(rest, lambda x: x["w"]).alias("w"), "n", "lo", "sha")
    swept = inside.repartition("up", "depth", F.get("t", F.lit(0))).sortWithinPartitions("up", "depth", "t").mapInArrow(lean(sweep), _SWEPT)
    swept = stored(swept, folder, "swept")
    ends = whole.filter(F.size("seq") == F.col("depth")).select("up", "depth", "sha")
    here = swept.filter("top").groupBy(F.col("up"), F.col("up_depth").alias("depth")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    about = children.join(here, ["up", "depth"], "left").join(ends, ["up", "depth"], "left").withColumnRenamed("up", "lo")
    below, found = None, []
    for k in reversed(range(len(heads))):
        got = heads[k].join(about, ["lo", "depth"], "left").na.fill(0, ["n_children", "n_leaves", "saved"])
        if below is not None:
            more = below.groupBy(F.col("up").alias("lo"), F.col("up_depth").alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("all_saved").alias("more_saved"))
            got = got.join(more, ["lo", "depth"], "left").na.fill(0, ["more_leaves", "more_saved"]).withColumns({"n_leaves": F.col("n_leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")}).drop("more_leaves", "more_saved")
        twice = (F.col("n") - 1) * F.aggregate("words", F.lit(0).cast("long"), lambda x, y: x + y)
        below = stored(got.withColumn("all_saved", F.col("saved") + twice), folder, f"rolled-{k}")
        found.append(below)
    top = below.select(F.col("lo").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))
    nodes = swept.select(top.columns).union(top)
    for head in found[:-1]:
        size = F.size("words")
        chain = head.withColumn("i", F.explode(F.sequence(F.lit(1), size)))
        later = F.aggregate(F.slice("words", F.col("i"), size - F.col("i") + 1), F.lit(0).cast("long"), lambda x, y: x + y)
        last = F.col("i") == size
        nodes = nodes.union(
            chain.select(
                F.col("lo").alias("conv_id"), (F.col("up_depth") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 1, F.col("up")).otherwise(F.col("lo")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + (F.col("n") - 1) * later).alias("saved_tokens"), F.when(last, F.coalesce("sha", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
            )
        )
    return nodes


def conversation_trie(conversations: DataFrame, limit: int = LIMIT, turns: int = TURNS) -> DataFrame:
    """The trie's nodes over the rebuilt conversations of (conv_id, turn, role, text)."""
    folder = shared_folder(conversations.sparkSession)
    whole = stored(rebuilt(sequences_of(conversations, folder)), folder, "rebuilt")
    return trie(distinct_sequences(whole, folder), folder, limit, turns)
