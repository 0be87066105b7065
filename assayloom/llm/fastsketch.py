"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles. A sketch has 128 coordinates, filled by rounds of
hashed bin placement: in round i every shingle falls into one bin with value (i, hash), and the least value
stays; after 128 rounds round 128+j fills bin j. So every coordinate fills, and the share of equal
coordinates of two sketches concentrates about their Jaccard similarity.

Steps: exact copies of a set collapse to one class (grouping pre-aggregates, so thousands of
copies cost one row a task); 32 bands of 4 coordinates give buckets, whose classes are linked as told in ``banding``: with the
bucket's smallest class and a few others first, then whatever is in different components yet. In that second step the join's condition
compares 32-bit hashes of the shingles, with room for the collisions that sets of their size have; what it lets through, and every pair of the
first step, is verified on full sets. A pair at similarity 0.75 misses all bands with probability
(1 - 0.75^4)^32 < 6e-6. Pairs are dropped before verification only if set sizes alone forbid the threshold, or
if the sketches' four-bit digests differ in over 51 of 128 places (expected at 0.75: 30, deviation 4.8 at most).

Defined cases: null or empty text, or no words: empty set, linked with nothing. Repeated rows stay rows of
their own in one component; rows of one doc_id with different texts are one document, with the links of all of them. A null doc_id
takes part in no link and is its own (null) component, kept. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.banding import components_of, numbered, smallest
from assayloom.llm.common import U64, byte_texts, lean, list_column, mix, pieces, raw, shared_folder, shingle_sets, stored

COORDINATES, BANDS, ROWS, DIGEST_GAP = 128, 32, 4, 51
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0xA24BAED4963EE407))
_NEVER = U64(0xFFFFFFFFFFFFFFFF)


def fast_sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` filled coordinates for each non-empty set; an empty set's row stays unfilled."""
    out = np.full((len(sets), t), _NEVER, U64)
    flat = out.reshape(-1)
    if not sets:
        return out
    items, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(items):
            break
        hashed = mix(items ^ _SEEDS[i])
        bins = (hashed & U64(t - 1)).astype(np.int64) if i < t else np.full(len(items), i - t)
        np.minimum.at(flat, rows * t + bins, (U64(i) << U64(56)) | (hashed >> U64(8)))
        open_rows = (out == _NEVER).any(axis=1)
        keep = open_rows[rows]
        items, rows = items[keep], rows[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    cut = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x8CB92BA72F3D8DD7), (len(sketches), bands)).copy()
    for k in range(rows):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return keys


def _digests(sketches: np.ndarray) -> np.ndarray:
    """Eight longs with the lowest four bits of each coordinate."""
    low = (sketches & U64(15)).astype(np.uint8)
    return np.ascontiguousarray(low[:, 0::2] | low[:, 1::2] << 4).view(np.int64)


def _differing(a: str, b: str):
    """Column: in how many places two digests differ."""
    total = F.lit(0)
    for k in range(COORDINATES // 16):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set, in two columns."""
    return np.array([(int(mix(s).sum(dtype=U64)), int(mix(s ^ _SEEDS[0]).sum(dtype=U64))) for s in sets], U64).reshape(-1, 2)


def _described(batches):
    for batch in batches:
        column = byte_texts(batch.column("text"))
        data, offsets = raw(column)
        for i, j in pieces(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sketches = fast_sketches(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            mark = _marks(sets)
            bits = _digests(sketches)
            keys = band_keys(sketches)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(sizes), pa.array(mark[:, 0].view(np.int64)), pa.array(mark[:, 1].view(np.int64)), list_column(list(bits)), list_column([k if n else k[:0] for k, n in zip(keys, sizes)])],
                names=["doc_id", "n_shingles", "mark1", "mark2", "digest", "keys"],
            )


def _with_sets(batches):
    for batch in batches:
        data, offsets = raw(byte_texts(batch.column("text")))
        for i, j in pieces(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("c").slice(i, j - i), list_column(sets)], names=["c", "items"])


def _with_marks(batches):
    for batch in batches:
        data, offsets = raw(byte_texts(batch.column("text")))
        for i, j in pieces(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            marks = np.concatenate([np.array([len(s) for s in sets], np.int64)[:, None], _marks(sets).view(np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([list_column(list(marks)), batch.column("text").slice(i, j - i)], names=["mark", "text"])


def _lists(column: pa.Array):
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _verified(batches, num: int, den: int):
    """Pairs whose similarity is num/den or more, on full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(_lists(batch.column("items_a")), _lists(batch.column("items_b"))):
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(docs.mapInArrow(lean(_described), "doc_id long, n_shingles long, mark1 long, mark2 long, digest array<long>, keys array<long>"), folder, "described")
    real = described.filter("n_shingles > 0 and doc_id is not null")
    mark = ["n_shingles", "mark1", "mark2"]
    reps = real.groupBy(*mark).agg(F.min(F.struct("doc_id", "digest", "keys")).alias("r")).select(*mark, F.xxhash64(*mark).alias("h"), F.col("r.doc_id").alias("id"), "r.digest", "r.keys")
    reps, own, twice = numbered(real.select("doc_id", F.xxhash64(*mark).alias("h")), stored(reps, folder, "classes"), folder)
    likely = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (_differing("digest_a", "digest_b") <= DIGEST_GAP)
    sets: list[DataFrame] = []

    def sets_of(members: DataFrame) -> DataFrame:
        """(c, items) of the classes in any bucket, made once."""
        if not sets:
            one = docs.select(F.col("doc_id").alias("c"), "text").join(members, "c", "left_semi").dropDuplicates(["c"])
            if own is not None:  # doc_ids of several texts: by the text's own hash
                texts = docs.join(twice, "doc_id", "left_semi").mapInArrow(lean(_with_marks), "mark array<long>, text string").select(F.xxhash64(*[F.col("mark")[k] for k in range(3)]).alias("c"), "text")
                one = one.join(twice.select(F.col("doc_id").alias("c")), "c", "left_anti").union(texts.join(members, "c", "left_semi").dropDuplicates(["c"]))
            sets.append(stored(one.mapInArrow(lean(_with_sets), "c long, items array<long>"), folder, "sets"))
        return sets[0]

    def verify(pairs: DataFrame, members: DataFrame) -> DataFrame:
        items = sets_of(members)
        joined = pairs.join(items.select(F.col("c").alias("a"), F.col("items").alias("items_a")), "a").join(items.select(F.col("c").alias("b"), F.col("items").alias("items_b")), "b")
        return joined.select("a", "b", "items_a", "items_b").mapInArrow(lean(lambda batches: _verified(batches, num, den)), "a long, b long")

    def short(members: DataFrame) -> DataFrame:
        return sets_of(members).join(members, "c", "left_semi").select("c", F.transform("items", lambda x: F.hash(x)).alias("short"))

    # equal 32-bit hashes inside a set of n lose n^2 / 2^33 shared shingles on average; 3 and twice as many are allowed for
    room = F.ceil(F.col("n_a") * F.col("n_b") / float(1 << 32)) + 3
    shared = (F.size(F.array_intersect("short_a", "short_b")) + room) * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
    whole = components_of(reps.select("c", "id", "h", F.col("n_shingles").alias("n"), "digest", "keys"), folder, likely, verify, short, shared, own)
    classes = reps.select(*mark, "c").join(smallest(reps, whole, own), "c").select(*mark, "component")
    out = described.select("doc_id", *mark).join(classes, mark, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
