"""Shared pieces of the training-data operators: shared folder, words, hashes, Arrow helpers.

A *word* is everywhere a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D`` in the UTF-8 text
with A-Z lower-cased; ``bytes.lower().split()`` gives exactly these.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text handled at once by the vectorised code in a task; bounds its memory, not its input.
CHUNK_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = U64(0xD6E8FEB86659FD93)
#: Bytes of a word that are hashed by place; a random number for each place and byte.
SHORT = 48
_TABLE = np.random.Generator(np.random.PCG64(7_031)).integers(0, 1 << 64, SHORT * 256, U64)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="assayloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/assayloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def lean(work):
    """An Arrow batch function that gives memory it no longer uses back to the system when its task ends.

    Python workers live on between tasks, and what their allocators keep would add up over the stages of a job.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, vectorised."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_texts(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a text column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a large binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) of about ``limit`` bytes; one larger row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_places(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and length of each word of each row; in text order.

    Words of up to ``SHORT`` bytes are hashed by tabulation (a random number for each place and byte, summed), so that
    any two different ones collide with probability 2^-64 whatever their letters; longer ones by xxh3 of their bytes.
    """
    none = np.empty(0, np.int64)
    if not len(data):
        return np.empty(0, U64), none, none
    solid = ~_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.empty(0, U64), none, none
    count = np.cumsum(solid)
    first = count[starts] - 1
    sizes = np.diff(np.append(first, count[-1]))
    letters = data[solid]
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    np.minimum(place, SHORT - 1, out=place)
    place <<= 8
    place |= _LOWER[letters] if lower else letters
    hashed = mix(np.add.reduceat(_TABLE[place], first) ^ (sizes.astype(U64) << U64(40)))
    for k in np.flatnonzero(sizes > SHORT).tolist():
        word = letters[first[k] : first[k] + sizes[k]]
        hashed[k] = xxhash.xxh3_64_intdigest((_LOWER[word] if lower else word).tobytes(), seed=1)
    return hashed, starts, sizes


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of each row, and the row's number; in text order."""
    hashed, starts, _ = word_places(data, offsets)
    return hashed, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    Fewer words than ``width``: the whole sequence is one shingle; no words: the empty set.
    """
    words, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    ends = np.searchsorted(rows, np.arange(n + 1))
    powers = np.cumprod(np.full(width, _STEP, U64))
    if len(words) >= width:
        rolled = sum(words[k : len(words) - width + 1 + k] * powers[k] for k in range(width))
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, U64)
    found = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= width:
            found.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * powers[: b - a]).sum(dtype=U64) + U64(b - a)
            found.append(mix(np.array([short], U64)))
        else:
            found.append(np.empty(0, U64))
    return found


def list_column(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column from numpy arrays."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    if flat.dtype == U64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))
