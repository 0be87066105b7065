"""Hard negatives by segment summaries.

A vector is cut into up to ``SEGMENTS`` segments, and each segment's mean and deviation (root of its summed squared differences from the
mean) are stored beside it. For two vectors

    | x.y - sum_s m*mean_x*mean_y |  <=  sum_s dev_x*dev_y        (m: length of segment s)

so means' products plus or minus deviations' products bound the score. Segments are refined hierarchically: four neighbours make one
coarser segment, the coarsest bounds come first, and only pairs that they leave open meet the finer ones and at last the exact
integer product. An anchor's positives are the best of its label; a negative's score has to lie in a window below each positive's. A pair
goes as soon as its bounds lie outside all windows, or below the k-th best score that is certain so far.

Anchors and candidates are dealt into groups, and each cell (anchor group, candidate group) is one unit of work: by label for positives, so a
frequent label is many cells, and over all labels for negatives. A cell holds ``ANCHORS`` and ``ROWS`` vectors at most and gives at most k rows
for each anchor and window, which are merged by rank. A candidate is sent once to every group of anchors: N / (100 * ANCHORS) times.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part; equal rows are one row, other rows
of one vec_id are rows of their own, yet none is a positive of its own vec_id; vectors of another length are no candidates; the
floor of 256 times a component is exact for every finite one, and a score beyond 64 bits counts as the largest (smallest) long; an
anchor without positives or negatives gives no row; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import lean, list_column, shared_folder, stored
from assayloom.llm.naming import named

SEGMENTS, MERGED = 16, 4
ANCHORS, ROWS, AT_ONCE, TILE, PAIRS = 4096, 16_384, 256, 2048, 65_536
LARGEST = (1 << 63) - 1
#: Relative slack of a bound: summaries are kept in single precision.
SLACK = 1e-5


def floors(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) in double precision; infinite where that is no double."""
    with np.errstate(over="ignore"):
        return np.floor(256 * v)


def segments(dim: int) -> np.ndarray:
    """First component of each of the finest segments: as many as the largest power of two up to dim and SEGMENTS."""
    n = 1 << min(SEGMENTS.bit_length() - 1, max(dim, 1).bit_length() - 1)
    return np.arange(n) * dim // n


def summary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of row vectors."""
    starts = segments(x.shape[1])
    if not x.shape[1]:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    sizes = np.diff(np.append(starts, x.shape[1]))
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(x, starts, axis=1) / sizes
        return mean, np.sqrt(np.add.reduceat((x - np.repeat(mean, sizes, axis=1)) ** 2, starts, axis=1))


def _summarised(batches):
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        dims = rows.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = rows.filter(pa.array(dims == dim))
            mean, dev = summary(floors(_matrix(part)))
            with np.errstate(over="ignore"):
                lists = [list_column(list(m.astype(np.float32)), pa.float32()) for m in (mean, dev)]
            yield from part.append_column("mean", lists[0]).append_column("dev", lists[1]).combine_chunks().to_batches()


def _matrix(rows: pa.Table, column: str = "v") -> np.ndarray:
    flat = rows.column(column).combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1).astype(np.float64) if len(flat) else np.zeros((rows.num_rows, 0))


class Block:
    """Vectors of a cell: ids, labels, floored components, and means and deviations by level, the coarsest first, scaled for plain products."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.v = _matrix(rows)
        self.x = floors(self.v)
        mean, dev = _matrix(rows, "mean"), _matrix(rows, "dev")
        size = np.diff(np.append(segments(self.x.shape[1]), self.x.shape[1])).astype(np.float64)
        self.levels = []
        with np.errstate(over="ignore", invalid="ignore"):
            while True:
                self.levels.insert(0, (mean * np.sqrt(size), dev))
                if mean.shape[1] <= 1:
                    break
                groups = np.arange(0, mean.shape[1], MERGED)
                whole = np.add.reduceat(size, groups)
                over = np.add.reduceat(mean * size, groups, axis=1) / whole
                away = (mean - np.repeat(over, np.diff(np.append(groups, mean.shape[1])), axis=1)) ** 2 * size
                mean, dev, size = over, np.sqrt(np.add.reduceat(dev**2 + away, groups, axis=1)), whole
            self.norm = np.sqrt((self.levels[0][0] ** 2 + self.levels[0][1] ** 2).sum(axis=1))
            self.most = np.abs(self.x).max(initial=0)


def products(a: Block, r: np.ndarray, b: Block, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows r of ``a`` and rows c of ``b``, within a long."""
    most = a.most * b.most * max(1, a.x.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", a.x[r], b.x[c]).astype(np.int64)
    if most < 2.0**62 and max(a.most, b.most) < 2.0**62:
        return np.einsum("ij,ij->i", a.x[r].astype(np.int64), b.x[c].astype(np.int64))
    whole = lambda v: [int(e) * 256 if abs(e) > 1e300 else math.floor(256 * e) for e in v.tolist()]
    left, right = {i: whole(a.v[i]) for i in np.unique(r).tolist()}, {i: whole(b.v[i]) for i in np.unique(c).tolist()}
    return np.array([max(-LARGEST, min(LARGEST, sum(x * y for x, y in zip(left[i], right[j])))) for i, j in zip(r.tolist(), c.tolist())], np.int64)


def best(group: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, larger scores first, ties by smaller name."""
    order = np.lexsort((name, -score, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g)))) < k]


def search(a: Block, b: Block, allowed, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, window, score, vec_id of ``b``): for each row and each of its windows [low, high] the k best allowed rows of ``b`` within it.

    ``allowed(rows, columns)`` gives a boolean matrix; windows are columns of ``low`` and ``high``, in doubles that bound them.
    """
    windows, out = low.shape[1], []
    for begin in range(0, len(a.ids), AT_ONCE):
        rows = np.arange(begin, min(begin + AT_ONCE, len(a.ids)))
        kept = (np.empty(0, np.int64),) * 3  # group = row in this part * windows + window, score, vec_id
        least = low[rows].copy()  # a score below can't be among the k best of the window any more
        for at in range(0, len(b.ids), TILE):
            columns = np.arange(at, min(at + TILE, len(b.ids)))
            r, c = _open_pairs(a, rows, b, columns, allowed(rows, columns), least, high[rows], k)
            for p in range(0, len(r), PAIRS):
                rr, cc = r[p : p + PAIRS], c[p : p + PAIRS]
                score = products(a, rows[rr], b, columns[cc])
                fits = (score[:, None] >= low[rows[rr]]) & (score[:, None] <= high[rows[rr]])
                pair, window = np.nonzero(fits)
                kept = tuple(np.concatenate(x) for x in zip(kept, (rr[pair] * windows + window, score[pair], b.ids[columns[cc[pair]]])))
                kept = tuple(x[best(*kept, k)] for x in kept) if not len(kept[0]) else _first(kept, k)
            group, count = np.unique(kept[0], return_counts=True)
            full = group[count == k]
            if len(full):
                worst = np.full(least.size, np.inf)
                np.minimum.at(worst, kept[0], kept[1].astype(np.float64))
                flat = least.reshape(-1)
                flat[full] = np.maximum(flat[full], worst[full])
        out.append((rows[kept[0] // windows], kept[0] % windows, kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 4


def _first(kept, k: int):
    places = best(*kept, k)
    return tuple(x[places] for x in kept)


def _open_pairs(a: Block, rows, b: Block, columns, alive, least, high, k: int):
    """Pairs (row, column) that the summaries of every level leave open."""
    with np.errstate(over="ignore", invalid="ignore"):
        (ma, da), (mb, db) = a.levels[0], b.levels[0]
        near, slack = ma[rows] @ mb[columns].T, da[rows] @ db[columns].T + SLACK * (a.norm[rows][:, None] * b.norm[columns][None, :])
        up, down = near + slack, near - slack
        wanted = np.zeros_like(alive)
        for w in range(least.shape[1]):  # comparisons that aren't numbers leave a pair open
            from_, to = least[:, w : w + 1], high[:, w : w + 1]
            sure = np.where(alive & (down >= from_) & (up <= to), down, -np.inf)
            if sure.shape[1] > k and np.isfinite(sure).any():
                from_ = np.maximum(from_, np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k][:, None])
            wanted |= ~(up < from_) & ~(down > to)
        r, c = np.nonzero(alive & wanted)
        for (ma, da), (mb, db) in zip(a.levels[1:], b.levels[1:]):
            left = []
            for p in range(0, len(r), PAIRS):
                rr, cc = r[p : p + PAIRS], c[p : p + PAIRS]
                i, j = rows[rr], columns[cc]
                near = np.einsum("ij,ij->i", ma[i], mb[j])
                slack = np.einsum("ij,ij->i", da[i], db[j]) + SLACK * a.norm[i] * b.norm[j]
                left.append((~((near + slack)[:, None] < least[rr]) & ~((near - slack)[:, None] > high[rr])).any(axis=1))
            if left:
                open_ = np.concatenate(left)
                r, c = r[open_], c[open_]
        return r, c


def _positives_in(k: int):
    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64),) * 4
        if left.num_rows and right.num_rows:
            a, b = Block(left), Block(right)
            none = np.full((left.num_rows, 1), np.inf)
            found = search(a, b, lambda rows, columns: a.ids[rows][:, None] != b.ids[columns][None, :], -none, none, k)
        names = left.column("name").to_numpy() if left.num_rows else np.empty(0, np.int64)
        return pa.table({"name": names[found[0]], "positive_id": found[3], "positive_score": found[2]})

    return cell


def _negatives_in(k: int, low: int, high: int):
    """``low`` and ``high``: a negative's score in hundredths of the positive's."""

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found, places = (np.empty(0, np.int64),) * 4, np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            a, b = Block(left), Block(right)
            scores = left.column("scores").to_pylist()
            most = max(map(len, scores))
            least, top = np.full((len(scores), most), np.inf), np.full((len(scores), most), -np.inf)
            exact = {}
            for i, row in enumerate(scores):
                for w, p in enumerate(row):
                    exact[i, w] = -(-low * p // 100), high * p // 100
                    least[i, w], top[i, w] = np.nextafter(float(exact[i, w][0]), -np.inf), np.nextafter(float(exact[i, w][1]), np.inf)
            if all(abs(x) < 1 << 52 for pair in exact.values() for x in pair):
                for (i, w), (x, y) in exact.items():  # whole numbers that doubles hold: no widening needed
                    least[i, w], top[i, w] = x, y
                found = search(a, b, lambda rows, columns: a.labels[rows][:, None] != b.labels[columns][None, :], least, top, k)
            else:
                found = _widened(a, b, least, top, exact, k)
            places = found[1] + 1
        names = left.column("name").to_numpy() if left.num_rows else np.empty(0, np.int64)
        return pa.table({"name": names[found[0]], "place": places, "negative_id": found[3], "negative_score": found[2]})

    return cell


def _widened(a: Block, b: Block, least, top, exact, k: int):
    """Windows beyond the whole numbers of a double: all pairs within the widened ones, then the exact test."""
    r, w, score, name = search(a, b, lambda rows, columns: a.labels[rows][:, None] != b.labels[columns][None, :], least, top, len(b.ids))
    fits = np.array([exact[i, j][0] <= s <= exact[i, j][1] for i, j, s in zip(r.tolist(), w.tolist(), score.tolist())], bool)
    r, w, score, name = (x[fits] for x in (r, w, score, name))
    places = best(r * top.shape[1] + w, score, name, k)
    return tuple(x[places] for x in (r, w, score, name))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_a_group: int = ANCHORS, rows_a_group: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label)."""
    folder = shared_folder(vectors.sparkSession)
    v = F.col("embedding")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).filter("vec_id is not null and label is not null and v is not null and forall(v, e -> e is not null and not isnan(double(e)) and abs(double(e)) < double('Infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = named(sound.select("vec_id", label.alias("label"), F.size("v").alias("dim"), "v"), folder, "rows")
    kind = rows.schema["v"].dataType.simpleString()
    rows = stored(rows.mapInArrow(lean(_summarised), f"vec_id long, label long, dim int, v {kind}, name long, mean array<float>, dev array<float>"), folder, "summaries")
    chosen = rows.filter(F.col("vec_id") % every == 0)
    columns = ["name", "vec_id", "label", "v", "mean", "dev"]

    def cells(of: DataFrame, by: list[str], cell, schema: str) -> DataFrame:
        """``cell`` over groups of anchors ``of`` and groups of rows that have the same ``by``."""
        counts = rows.groupBy(*by).agg(F.count("*").alias("n")).join(of.groupBy(*by).agg(F.count("*").alias("a")), by)
        counts = counts.select(*by, F.ceil(F.col("a") / anchors_a_group).cast("int").alias("gs"), F.ceil(F.col("n") / rows_a_group).cast("int").alias("hs"))
        own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = of.join(counts, by).withColumn("g", own("gs")).withColumn("h", each("hs")).select(*[F.col(c).alias(c) for c in (*by, "g", "h", *[c for c in of.columns if c not in by])])  # new columns, as both sides come from one table
        right = rows.select(*by, *[c for c in columns if c not in by]).join(counts, by).withColumn("h", own("hs")).withColumn("g", each("gs")).select(*by, "g", "h", *[c for c in columns if c not in by])
        return left.groupBy(*by, "g", "h").cogroup(right.groupBy(*by, "g", "h")).applyInArrow(cell, schema)

    first = lambda df, by, order, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    near = cells(chosen.select("dim", *columns), ["dim", "label"], _positives_in(positives), "name long, positive_id long, positive_score long")
    near = stored(first(near, ["name"], [F.desc("positive_score"), "positive_id"], positives).withColumnRenamed("rank", "place"), folder, "positives")
    scores = near.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = chosen.select("dim", *columns).join(scores, "name")
    hard = cells(asked, ["dim"], _negatives_in(negatives, low, high), "name long, place long, negative_id long, negative_score long")
    hard = first(hard, ["name", "place"], [F.desc("negative_score"), "negative_id"], negatives)
    return hard.join(near, ["name", "place"]).join(chosen.select("name", F.col("vec_id").alias("anchor_id")), "name").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
