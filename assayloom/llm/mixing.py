"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by cell of source, language and topic. Raking finds one factor a source, a language and
a topic; a document is kept with the probability min(1, product of its cell's factors), and the factors are raked so that the expected
kept tokens of every source, language and topic meet the targets at once, the bound of 1 included: where a product would be above 1
the rest of the margin makes up for it. The draw is a hash of doc_id, so that a rerun draws the same.

Targets are shares given by the caller, or else the natural shares raised to ``temper`` (0: even, 1: natural), of ``keep`` of all tokens. What a
margin hasn't got in tokens goes to the others of its kind in proportion, so targets can be reached one kind at a time. Raking ends
when factors settle (``TOLERANCE``) or after ``ROUNDS`` jobs.

Topics are the nearest of ``TOPICS`` centres of hashed word counts. The centres come from k-means over all texts: each round is a job that
sums vectors by nearest centre in each task and then over tasks; only the seeds come from ``SEEDS`` texts. Sources may be many: their
factors are computed by grouped jobs and joined, never collected. Languages and topics are few; above ``LANGUAGES`` languages it is an error.

Defined cases: null source or language is the empty one; null or empty text has no tokens, is kept as its cell is, and
belongs to topic 0; a cell of a source without tokens is kept with probability ``keep``; a null doc_id is drawn as id 0; repeated rows
share their draw. Extra columns pass through ``keep_mixed`` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import U64, byte_texts, lean, pieces, raw, shared_folder, stored, word_hashes

TOPICS, FEATURES, SEEDS, ROUNDS, TOLERANCE, LANGUAGES, KEEP, TEMPER, SEED = 8, 256, 512, 40, 1e-4, 300, 0.75, 0.7, 17


def _profile(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of hashed word counts (square roots), and word counts."""
    hashed, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    flat = np.bincount(rows * FEATURES + (hashed & U64(FEATURES - 1)).astype(np.int64), minlength=n * FEATURES)
    root = np.sqrt(flat.reshape(n, FEATURES))
    return root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-12), np.bincount(rows, minlength=n)


def _settled(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        moved = np.array([x[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centres


def topic_centres(docs: DataFrame, folder: str, topics: int = TOPICS, rounds: int = 10) -> np.ndarray:
    """Centres of all texts with words, which are read once: their vectors are stored, a byte for each component."""

    def profiles(batches):
        for batch in batches:
            data, offsets = raw(byte_texts(batch.column("text")))
            for i, j in pieces(offsets):
                x, n = _profile(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in np.rint(x[n > 0] * 255).astype(np.uint8)], pa.binary())], names=["p"])

    vectors = stored(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(profiles), "p binary"), folder, "profiles")
    read = lambda blobs: np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, FEATURES).astype(np.float32)
    seeds = read([bytes(r["p"]) for r in vectors.orderBy(F.xxhash64("p"), "p").limit(SEEDS).collect()])
    if not len(seeds):
        return np.zeros((1, FEATURES))
    centres = _settled(seeds, seeds[np.unique(np.linspace(0, len(seeds) - 1, topics).astype(int))], 10)

    def summed(batches):
        sums = np.zeros((len(centres), FEATURES))
        for batch in batches:
            x = read(batch.column("p").to_pylist())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = (x @ centres.T.astype(np.float32)).argmax(axis=1)
            for k in np.unique(near):
                sums[k] += x[near == k].sum(axis=0, dtype=np.float64)
        k, d = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int32)), pa.array(d.ravel().astype(np.int32)), pa.array(sums.ravel())], names=["k", "d", "s"])

    for _ in range(rounds):
        moved = np.zeros(centres.shape)
        for r in vectors.mapInArrow(lean(summed), "k int, d int, s double").groupBy("k", "d").agg(F.sum("s").alias("s")).collect():  # topics * FEATURES rows
            moved[r["k"], r["d"]] = r["s"]
        size = np.linalg.norm(moved, axis=1, keepdims=True)
        moved = np.where(size > 0, moved / np.maximum(size, 1e-12), centres)
        shift, centres = float(np.abs(moved - centres).max()), moved
        if shift < 1e-3:
            break
    return np.round(centres, 9)


def described(docs: DataFrame, centres: np.ndarray, row) -> DataFrame:
    """(row, doc_id, source, lang, topic, tokens) of ``docs`` (doc_id, text, lang, source)."""

    def add(batches):
        for batch in batches:
            data, offsets = raw(byte_texts(batch.column("text")))
            topics, tokens = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for i, j in pieces(offsets):
                x, n = _profile(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                topics.append(np.where(n > 0, (x @ centres.T).argmax(axis=1), 0).astype(np.int32))
                tokens.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "source", "lang")], pa.array(np.concatenate(topics)), pa.array(np.concatenate(tokens))], names=["row", "doc_id", "source", "lang", "topic", "tokens"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text("source").alias("source"), text("lang").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(add), f"row {kind}, doc_id long, source string, lang string, topic int, tokens long")


def _reachable(sizes: np.ndarray, wanted: np.ndarray, goal: float) -> np.ndarray:
    """min(size, t * wanted) with the t that makes the sum the goal, or as near to it as sizes allow."""
    got = wanted > 0
    goal = min(goal, float(sizes[got].sum()))
    ratio = np.where(got, sizes / np.where(got, wanted, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(np.where(got, sizes, 0)[order])])
    open_ = wanted[order][::-1].cumsum()[::-1]
    for k, t in enumerate((goal - full[:-1]) / np.maximum(open_, 1e-300)):
        if t <= ratio[order[k]] * (1 + 1e-12):
            return np.minimum(sizes, t * wanted)
    return np.where(got, sizes, 0.0)


def bounded_factor(x: np.ndarray, tokens: np.ndarray, wanted: float) -> float:
    """The a for which the sum of tokens * min(1, a * x) is what is wanted, or the least that gives all there is."""
    use = x > 0
    x, tokens = x[use], tokens[use]
    if not len(x) or wanted <= 0:
        return 0.0
    order = np.argsort(-x, kind="stable")
    x, tokens = x[order], tokens[order]
    full = np.cumsum(tokens) - tokens
    a = (wanted - full) / np.cumsum((tokens * x)[::-1])[::-1]
    fits = np.flatnonzero(a * x <= 1)
    return float(max(a[fits[0]], 0.0)) if len(fits) else float(1 / x[-1])


def rake(cells: DataFrame, folder: str, keep: float = KEEP, temper: float = TEMPER, sources: DataFrame | None = None, languages: dict | None = None, topics: dict | None = None, rounds: int = ROUNDS):
    """Factors of (source, lang, topic, tokens): (DataFrame source, factor; {lang: factor}; {topic: factor}; whether they settled)."""
    full = cells.filter("tokens > 0")
    names = [r["lang"] for r in full.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: fold rare ones of the lang column before mixing")
    sizes = full.groupBy("lang", "topic").agg(F.sum("tokens").alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    goal = keep * total
    langs, kinds = sorted(names), sorted({r["topic"] for r in sizes})
    at, to = {k: i for i, k in enumerate(langs)}, {k: i for i, k in enumerate(kinds)}
    margin = np.zeros((len(langs), len(kinds)))
    for r in sizes:
        margin[at[r["lang"]], to[r["topic"]]] += r["n"]
    share = lambda keys, n, given: np.array([given.get(k, 0.0) for k in keys]) if given else n**temper
    want_lang = _reachable(margin.sum(axis=1), share(langs, margin.sum(axis=1), languages), goal)
    want_topic = _reachable(margin.sum(axis=0), share(kinds, margin.sum(axis=0), topics), goal)
    wide = full.groupBy("source").agg(F.sum("tokens").cast("double").alias("n"), F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"))
    wide = wide.join(sources.select("source", F.col("share").cast("double").alias("want")), "source", "left").fillna(0.0, ["want"]) if sources is not None else wide.withColumn("want", F.pow("n", F.lit(temper)))
    wide = stored(wide, folder, "by-source")
    # sources are many: their targets from sums over narrow bins of size by wanted share
    bins = wide.filter("want > 0").groupBy(F.floor(F.log2(F.col("n") / F.col("want")) * 64).alias("bin")).agg(F.sum("n").alias("n"), F.sum("want").alias("want")).collect()
    reached = _reachable(np.array([r["n"] for r in bins]), np.array([r["want"] for r in bins]), goal) if bins else np.empty(0)
    t = max((m / r["want"] for m, r in zip(reached, bins)), default=0.0)
    b, d, settled = np.ones(len(langs)), np.ones(len(kinds)), False

    def solved(batches, of_cells: bool):
        for batch in batches:
            for source, n, want, found in zip(*(batch.column(c).to_pylist() for c in ("source", "n", "want", "cells"))):
                l, k = np.array([at[x["lang"]] for x in found]), np.array([to[x["topic"]] for x in found])
                tokens = np.array([x["tokens"] for x in found], np.float64)
                a = bounded_factor(b[l] * d[k], tokens, min(n, t * want))
                if not of_cells:
                    yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([a])], names=["source", "factor"])
                elif a > 0:
                    yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(k), pa.array(np.full(len(l), int(np.floor(np.log2(a) * 64)))), pa.array(tokens), pa.array(tokens * a)], names=["l", "k", "bin", "n", "na"])

    for _ in range(rounds if total else 0):
        got = wide.mapInArrow(lambda batches: solved(batches, True), "l long, k long, bin long, n double, na double").groupBy("l", "k", "bin").agg(F.sum("n").alias("n"), F.sum("na").alias("na")).toArrow()
        l, k, n, na = (got.column(c).to_numpy() for c in ("l", "k", "n", "na"))
        before = np.concatenate([b, d])
        own_l, own_k = [np.flatnonzero(l == i) for i in range(len(langs))], [np.flatnonzero(k == i) for i in range(len(kinds))]
        for _ in range(100):  # languages and topics against each other need no new job
            last = np.concatenate([b, d])
            b = np.array([bounded_factor(na[o] / n[o] * d[k[o]], n[o], w) if len(o) else 1.0 for o, w in zip(own_l, want_lang)]).clip(1e-9, 1e9)
            d = np.array([bounded_factor(na[o] / n[o] * b[l[o]], n[o], w) if len(o) else 1.0 for o, w in zip(own_k, want_topic)]).clip(1e-9, 1e9)
            if np.abs(np.concatenate([b, d]) / last - 1).max() < TOLERANCE / 10:
                break
        settled = bool(np.abs(np.concatenate([b, d]) / before - 1).max() < TOLERANCE)
        if settled:
            break
    out = wide.mapInArrow(lambda batches: solved(batches, False), "source string, factor double")
    return stored(out, folder, "factors"), dict(zip(langs, b.tolist())), dict(zip(kinds, d.tolist())), settled


def weighted(rows: DataFrame, folder: str, keep: float = KEEP, **targets) -> DataFrame:
    """``rows`` of described() with weight, probability and selected."""
    cells = stored(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), folder, "cells")
    factors, lang, topic, _ = rake(cells, folder, keep, **targets)
    pick = lambda table, key: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(key)], F.lit(1.0)) if table else F.lit(1.0)
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(SEED)), 11) / F.lit(float(1 << 53))
    out = rows.join(factors, "source", "left").withColumn("weight", F.coalesce(F.col("factor") * pick(lang, "lang") * pick(topic, "topic"), F.lit(float(keep))))
    return out.withColumn("probability", F.least(F.lit(1.0), "weight")).withColumn("selected", draw < F.col("probability")).drop("factor")


def mix_documents(docs: DataFrame, keep: float = KEEP, **targets) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, selected of each row of ``docs``."""
    folder = shared_folder(docs.sparkSession)
    rows = stored(described(docs, topic_centres(docs, folder), F.lit(0)).drop("row"), folder, "described")
    return weighted(rows, folder, keep, **targets).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected")


def keep_mixed(docs: DataFrame, keep: float = KEEP, **targets) -> DataFrame:
    """The selected rows of ``docs``, all columns untouched."""
    folder = shared_folder(docs.sparkSession)
    rows = described(docs, topic_centres(docs, folder), F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return weighted(rows, folder, keep, **targets).filter("selected").select("row.*")
