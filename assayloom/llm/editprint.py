"""Document fingerprints by randomised edit embedding.

A text of n code points is embedded by a random walk that all texts share: step j writes the current symbol and
moves on by a random bit that depends on j and the symbol only, for 2n steps. Texts a few edits apart walk together
again after each edit, so edit distance turns into Hamming distance of the embeddings. The fingerprint samples 128
windows of 8 written symbols, 8 bits of hash each. Slot k samples the place where its random sequence has its
largest value among the first 2n places (a record), which is uniform and the same for most lengths near n, so
texts of unlike lengths stay comparable. Likeness is the share of equal slots.

``near_duplicates`` bands samples of the slots (32 bands of 4), verifies candidates on whole fingerprints (Hamming distance of all slots) and joins what is
alike into classes, as told in ``banding``; every pair of a bucket whose ends aren't in one class yet is compared. A pair of likeness 0.75 misses
all bands with probability (1 - 0.75^4)^32 < 6e-6.

Defined cases: null text is empty; an empty text has the fingerprint of zeros; the next document of the last is the
first, of a single document itself; rows of one doc_id follow each other in order of their text's hash; a null
doc_id sorts first. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.banding import components_of, numbered, smallest
from assayloom.llm.common import U64, byte_texts, lean, list_column, mix, shared_folder, stored

SLOTS, WINDOW, PERIOD, CHUNK_CHARS, ROWS_A_BUCKET, BANDS, BROADCAST_ROWS = 128, 8, 4096, 12_000_000, 8_000, 32, 2_000_000


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Bits of the shared walk by (step modulo the period, symbol), and each slot's record places."""
    rng = np.random.Generator(np.random.PCG64(20_240_517))
    moves = rng.integers(0, 2, (PERIOD, 256), np.uint8)
    moves[:, 0] = 0  # symbol 0 is the end: the walk stays there
    records = []
    for _ in range(SLOTS):
        places = [0]
        while places[-1] < 1 << 40:
            places.append(int((places[-1] + 1) / rng.random()))
        records.append(np.array(places))
    return moves, records


_MOVES, _RECORDS = _tables()
_MOVE_LISTS: list[list[int]] = []


def symbols(text: str) -> np.ndarray:
    """One symbol from 1 to 255 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def embed(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The 2n written symbols of each symbol array; all texts walk in step."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    flat = np.zeros(int(lengths.sum()) + len(texts), np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    for k, b in zip(order, begin):
        flat[b : b + len(texts[k])] = texts[k]
    steps = 2 * lengths
    base = np.cumsum(steps) - steps
    out = np.zeros(int(steps.sum()), np.uint8)
    at, to = begin.copy(), base.copy()
    active, j = int((steps > 0).sum()), 0
    while active > 12:
        until = int(steps[active - 1])
        while j < until:
            seen = flat[at[:active]]
            out[to[:active]] = seen
            at[:active] += _MOVES[j % PERIOD][seen]
            to[:active] += 1
            j += 1
        while active and steps[active - 1] <= j:
            active -= 1
    if active and not _MOVE_LISTS:
        _MOVE_LISTS.extend(_MOVES.tolist())
    for k in range(active):  # few long texts are left: one after another
        place, written, end = int(at[k]), bytearray(), int(begin[k] + lengths[k])
        source = flat[begin[k] : end + 1].tobytes()
        place -= int(begin[k])
        for step in range(j, int(steps[k])):
            s = source[place]
            written.append(s)
            place += _MOVE_LISTS[step % PERIOD][s]
        out[base[k] + j : base[k] + steps[k]] = np.frombuffer(bytes(written), np.uint8)
    found: list[np.ndarray] = [out[:0]] * len(texts)
    for k, b, n in zip(order, base, steps):
        found[k] = out[b : b + n]
    return found


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, slots) bytes."""
    walked = embed([symbols(t) for t in texts])
    lengths = np.array([len(w) for w in walked], np.int64)
    flat = np.concatenate([np.append(w, np.zeros(WINDOW, np.uint8)) for w in walked]) if walked else np.zeros(0, np.uint8)
    base = np.cumsum(lengths + WINDOW) - lengths - WINDOW
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for k, records in enumerate(_RECORDS):
        place = base + records[np.maximum(np.searchsorted(records, lengths) - 1, 0)]
        value = np.zeros(len(texts), U64)
        for w in range(WINDOW):
            value = (value << U64(8)) | flat[place + w]
        out[:, k] = (mix(value + U64(k)) >> U64(56)).astype(np.uint8)
    out[lengths == 0] = 0
    return out


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _described(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last of ``texts``, which only is the next document."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    prints = fingerprints(texts + changed)
    own, other = prints[: len(texts)], prints[len(texts) :]
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        pa.array([p.tobytes() for p in own[:-1]], pa.binary()),
        pa.array([p.tobytes() for p in other], pa.binary()),
        pa.array((own[:-1] == other).mean(axis=1)),
        pa.array((own[:-1] == own[1:]).mean(axis=1)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _in_order(batches):
    """Rows sorted by bucket, document, with each bucket's following document last."""
    bucket, ids, texts, size, over = None, [], [], 0, False
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for b, look, d, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "look", "doc_id", "packed"))):
            if b != bucket:
                bucket, ids, texts, size, over = b, [], [], 0, False
            if over:
                continue
            ids.append(d)
            texts.append(unpack.decompress(t).decode())
            size += len(texts[-1])
            over = bool(look)
            if len(texts) > 1 and (over or size > CHUNK_CHARS):
                yield _described(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def ordered_fingerprints(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Fingerprints, as bytes, of each row of ``docs`` (doc_id, text) and of its edited text, and likenesses.

    Documents are dealt to buckets of ascending doc_id (quantiles), and the first document of each bucket also goes to the
    bucket before it, so that one shuffle brings every document next to the following one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(1, -(-rows.count() // rows_a_bucket))
    inner = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(rows.approxQuantile("id", inner, min(0.002, 0.2 / buckets)))) if inner else []

    def bucket_of(batches):
        edges = np.array(bounds)
        for batch in batches:
            at = np.searchsorted(edges, batch.column("id").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int64())], names=["id", "bucket"])

    heads = rows.select("id").mapInArrow(bucket_of, "id long, bucket long").groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    starts = [h["id"] for h in heads]
    before = {s: len(starts) - 1 if k == 0 else k - 1 for k, s in enumerate(starts)}

    def dealt(batches):
        """Texts are packed, as they are all that is shuffled."""
        edges, packer = np.array(starts), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([packer.compress(t) for t in byte_texts(batch.column("text")).to_pylist()], pa.binary())
            batch = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), packed], names=["id", "doc_id", "packed"])
            ids = batch.column("id").to_numpy()
            at = np.maximum(np.searchsorted(edges, ids, side="right") - 1, 0)
            extra = np.flatnonzero(edges[at] == ids)
            for rows_, buckets_, look in ((np.arange(len(ids)), at, 0), (extra, np.array([before[i] for i in ids[extra].tolist()], np.int64), 1)):
                part = batch.take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays([pa.array(buckets_, pa.int32()), pa.array(np.full(len(rows_), look, np.int32)), part.column("doc_id"), part.column("packed")], names=["bucket", "look", "doc_id", "packed"])

    spread = rows.mapInArrow(lean(dealt), "bucket int, look int, doc_id long, packed binary").repartitionById(len(starts), F.col("bucket"))
    return spread.sortWithinPartitions("bucket", "look", F.asc_nulls_first("doc_id"), F.xxhash64("packed")).mapInArrow(lean(_in_order), _SCHEMA)


def _keyed(batches):
    """Eight slots a long, and a hash of each band of slots."""
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(-1, SLOTS)
        bands = np.ascontiguousarray(flat).view(np.uint32).astype(U64).reshape(len(flat), BANDS)
        keys = mix(bands | np.arange(1, BANDS + 1, dtype=U64)[None, :] << U64(32))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "h", "n")], list_column(list(np.ascontiguousarray(flat).view(np.int64))), list_column(list(keys))], names=["id", "h", "n", "bits", "keys"])


def _unequal(a: str, b: str):
    """Column: how many slots of two fingerprints differ."""
    total = F.lit(0)
    for k in range(SLOTS // 8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def near_duplicates(prints: DataFrame, folder: str, least: float = 0.75) -> DataFrame:
    """(h, class_id) of the fingerprints that more than one row of ``prints`` (doc_id, fingerprint bytes) has or that are alike by
    ``least`` with another; every other row is a class of its own. h is two hashes of the fingerprint."""
    known = prints.filter("doc_id is not null")
    reps = known.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).withColumn("h", F.xxhash64("fingerprint"))
    classes = stored(reps.mapInArrow(lean(_keyed), "id long, h long, n long, bits array<long>, keys array<long>"), folder, "fingerprint-classes")
    classes, own, _ = numbered(known.select("doc_id", F.xxhash64("fingerprint").alias("h")), classes, folder)
    found = components_of(classes.drop("n"), folder, _unequal("bits_a", "bits_b") <= int(SLOTS * (1 - least)), links=own)
    named = smallest(classes, found, own).join(classes.select("c", "h", "n", "id", F.xxhash64("bits").alias("h2")), "c")
    return named.filter((F.col("n") > 1) | (F.col("component") != F.col("id"))).select("h", "h2", F.col("component").alias("class_id"))


def fingerprint_documents(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text in hexadecimal, likenesses, and class_id: the smallest doc_id
    of those whose fingerprints hang together (null for a null doc_id)."""
    folder = shared_folder(docs.sparkSession)
    prints = stored(ordered_fingerprints(docs, rows_a_bucket), folder, "prints")
    classes = stored(near_duplicates(prints, folder), folder, "classes-of-several")
    if classes.count() <= BROADCAST_ROWS:  # 24 bytes each
        classes = F.broadcast(classes)

    def halves(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(-1, SLOTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(list(np.ascontiguousarray(flat).view(np.int64)))], names=[*batch.schema.names, "bits"])

    whole = prints.mapInArrow(halves, f"{_SCHEMA}, bits array<long>").withColumn("h", F.xxhash64("fingerprint")).withColumn("h2", F.xxhash64("bits")).drop("bits").join(classes, ["h", "h2"], "left")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return whole.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
