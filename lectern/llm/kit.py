"""Shared helpers: words and hashes of Arrow text columns in numpy, and written stages.

All text functions work on the UTF-8 bytes of a whole column at once. Word
separators are ASCII in every rule used here, so bytes can be tested alone.
Null texts are treated as empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes handled at a time inside a task. A longer document is handled alone.
CHUNK_BYTES = 1 << 20
# Shuffle partitions that share a file of a narrow table.
NARROW = 8
# Rows of a batch between Spark and Python.
BATCH_ROWS = 1024

# Separators of the word rules (bytes).
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_ALPHANUMERIC = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))

SPACE_WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share.

    It lies in the folder that the session names in ``spark.checkpoint.dir``; where
    that is unset, in the session's warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, purpose: str, narrow: bool = False) -> DataFrame:
    """Write a result that several later steps read and read it back.

    A lost executor then costs a re-read, and the lineage ends at the files. ``narrow``
    tables, a few numbers a row, are gathered into fewer files first.
    """
    path = shared_folder(df.sparkSession, purpose)
    if narrow:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(max(1, parts // NARROW))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out evenly over the session's shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if keys else df.repartition(parts)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of few rows: they hold whole texts, twice on the way to Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of unsigned 64-bit values (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence with an inverse modulo 2**64
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers."""
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any byte span follows by one subtraction."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal bytes wherever they lie."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    shifted = (sums[ends] - sums[starts]) * powers(UNBASE, int(starts.max()) + 1)[starts]
    return mix(shifted + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``budget`` bytes, at least one row each."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + budget, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def pieces(column: pa.Array, budget: int = CHUNK_BYTES):
    """(first row, last row, bytes, offsets) of each run of rows."""
    data, offsets = column_bytes(column)
    for a, b in chunks(offsets, budget):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _is_word(separators: tuple[int, ...]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...]):
    """Start, end and row of every word; words end at the end of a row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = _is_word(separators)[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = False
    after[inner[1:] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, at every word; and where they stay in one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    acc = words[:m].copy()
    for j in range(1, n):
        acc *= np.uint64(0xFF51AFD7ED558CCD)
        acc += words[j : j + m]
    return mix(acc), rows[:m] == rows[n - 1 :]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; and is it a later occurrence."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def digest_of_ids(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def null_text(column):
    return F.coalesce(column, F.lit(""))
