"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Shard file (little endian): magic ``ALTK0001``, int64 documents, int64 ids, int64 control bytes, int64 data
bytes; int64 doc_id of each document (the smallest long stands for null), int64 ids of each document; control
bytes; data bytes. A control byte holds four 2-bit codes, the byte counts less one of the next four values, low
bits first; values are ranks by falling corpus frequency (ties: smaller id). ``ranks`` holds the uint32 id of
each rank. The decoder looks up, for every control byte, the four lengths in a 256-row table.

Ranges of doc_id are written by one task each, documents ascending, as files of at most ``FILE_IDS`` ids (or one document), so
what a task holds is bounded whatever the texts' lengths. Steps: texts to ids, once, stored with each task's counts of ids;
the counts give the ranks (bounded by the vocabulary); documents are encoded where they are, dealt by range
and written, each task by its own temporary name and a rename, so a rerun only writes
the same bytes again; files are read back by Spark and decoded. Driver: one row for each file.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first; repeated rows are documents of
their own, next to each other; an empty table writes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import byte_texts, lean, pieces, raw, shared_folder
from assayloom.llm.tokens import BATCH_BYTES, default_path, ids_for

MAGIC, SHARD_IDS, FILE_IDS, NULL_ID = b"ALTK0001", 8_000_000, 4_000_000, -(1 << 63)
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of values below 2^32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes, by table lookup."""
    size = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    begin = ends - size
    out = data[begin].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard_bytes(doc_ids: list[int | None], ranks: list[np.ndarray]) -> bytes:
    control, data = encode(np.concatenate(ranks)) if ranks else (b"", b"")
    head = np.array([len(doc_ids), sum(map(len, ranks)), len(control), len(data)], "<i8")
    ids = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), ids.tobytes(), np.array([len(r) for r in ranks], "<i8").tobytes(), control, data])


def read_shard(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, ranks) of a shard file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, controls, size = (int(x) for x in np.frombuffer(content, "<i8", 4, 8))
    at = 40
    doc_ids, lengths = np.frombuffer(content, "<i8", docs, at), np.frombuffer(content, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    return doc_ids, lengths, decode(np.frombuffer(content, np.uint8, controls, at), np.frombuffer(content, np.uint8, size, at + controls), n)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(store: fs.FileSystem, path: str, content: bytes, mark: str) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.{mark}") as out:
        out.write(content)
    store.move(f"{path}.{mark}", path)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS, file_ids: int = FILE_IDS) -> dict[tuple[int, int], int]:
    """Write ``docs`` (doc_id, text) to ``folder``; ids before each file, by (range, part)."""
    path = path or default_path()
    store, _ = _open(folder)
    spark = docs.sparkSession
    kind = ids_for(path).kind
    names = ["doc_id", "n", "ids", "counts"]

    def to_ids(batches):
        ids_of = ids_for(path)
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = raw(byte_texts(batch.column("text")))
            for i, j in pieces(offsets, BATCH_BYTES):
                flat, ends = ids_of.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = np.bincount(flat, minlength=len(total))
                found[: len(total)] += total
                total, size = found, flat.itemsize
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((ends * size).astype(np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(ends)), blob.cast(pa.binary()), pa.nulls(j - i, pa.binary())], names=names)
        if len(total):  # one more row for the task: its counts
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, ids binary, counts binary"
    rows.mapInArrow(lean(to_ids), schema).write.option("compression", "zstd").parquet(f"{folder}/ids")
    written_ids = spark.read.schema(schema).parquet(f"{folder}/ids")
    tokens = written_ids.filter("n is not null").select("doc_id", "n", "ids")

    def counted(batches):
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total = np.frombuffer(blob, "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = written_ids.filter("counts is not null").select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    if not counts:
        return {}
    rank_of = np.zeros(max(r["id"] for r in counts) + 1, np.uint32)
    rank_of[[r["id"] for r in counts]] = np.arange(len(counts))
    _put(store, f"{_open(folder)[1]}/ranks", np.array([r["id"] for r in counts], "<u4").tobytes(), "new")
    shards = max(1, -(-sum(r["n"] for r in counts) // shard_ids))
    inner = [k / shards for k in range(1, shards)]
    bounds = np.array(sorted(set(tokens.approxQuantile("doc_id", inner, min(0.001, 0.1 / shards))))) if inner else np.empty(0)
    wide = "<u2" if len(rank_of) <= 65_536 else "<u4"

    def encoded(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            blobs = [rank_of[np.frombuffer(b, kind)].astype(wide).tobytes() for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, side="right").astype(np.int32)), batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["shard", "doc_id", "ranks"])

    def written(batches):
        from pyspark import TaskContext

        where, top = _open(folder)
        mark = f"t{TaskContext.get().taskAttemptId()}"
        shard, part, doc_ids, ranks, size = None, 0, [], [], 0

        def flush():
            _put(where, f"{top}/shards/shard-{shard:08d}-{part:08d}.tok", shard_bytes(doc_ids, ranks), mark)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64())], names=["shard", "part", "n"])

        for batch in batches:
            for s, d, r in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ranks"))):
                if shard is not None and (s != shard or size + len(r) // np.dtype(wide).itemsize > file_ids):
                    yield flush()
                    part, doc_ids, ranks, size = part + 1 if s == shard else 0, [], [], 0
                shard = s
                doc_ids.append(d)
                ranks.append(np.frombuffer(r, wide))
                size += len(ranks[-1])
        if shard is not None:
            yield flush()

    dealt = tokens.select("doc_id", "ids").mapInArrow(lean(encoded), "shard int, doc_id long, ranks binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", F.xxhash64("ranks"))
    sizes = dealt.mapInArrow(lean(written), "shard int, part int, n long").groupBy("shard", "part").agg(F.max("n").alias("n")).orderBy("shard", "part").collect()
    before = np.cumsum([0, *(r["n"] for r in sizes)])
    return {(r["shard"], r["part"]): int(b) for r, b in zip(sizes, before)}


def read_token_files(spark, folder: str, before: dict[tuple[int, int], int]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not before:
        return spark.createDataFrame([], schema)
    store, top = _open(folder)
    with store.open_input_stream(f"{top}/ranks") as f:
        id_of = np.frombuffer(f.read(), "<u4")

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                doc_ids, lengths, ranks = read_shard(content)
                ids = np.ascontiguousarray(id_of[ranks], "<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends)]
                shard, part = path.rsplit("/", 1)[1].split(".")[0].split("-")[1:]
                start = before[int(shard), int(part)] + ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(f"{folder}/shards").select("path", "content")
    return files.mapInArrow(lean(read), schema)


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    return read_token_files(spark, folder, write_token_files(docs, folder, path))
