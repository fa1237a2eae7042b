"""Token ids in patched frame-of-reference blocks.

Documents are sorted by doc_id over the cluster and encoded; each partition writes
segments of about ``SEGMENT_IDS`` ids. A segment is a binary image: ids in blocks of
128, from which the block's minimum is subtracted; the rest is packed at the width that
holds ``PERCENTILE`` percent of the block, and the high bits of what does not fit stand
in exception lists. The starts of all blocks are indexed, so that any range of ids is
read without the blocks before it. Spark writes the images as a binary column, so a lost
task leaves nothing behind, and a reader needs the folder only.

Null texts are encoded as empty: only the end id. Null doc_ids come first. Equal doc_ids
are ordered by the hash of their text; equal rows are interchangeable. An empty table
gives an empty folder of segments. Only the named columns are read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 16
END_ID = 1
# Pieces whose ids a worker remembers, and their characters; beyond either it starts anew.
REMEMBERED = 1 << 20
REMEMBERED_CHARS = 1 << 24
# Bytes encoded at a time.
CHUNK_BYTES = 4 << 20
HEADER = "<4sHHQII"
MAGIC = b"PFOR"


def pack(ids: np.ndarray) -> bytes:
    """The image of a run of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    base = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - base[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    usual = np.partition(rest, rank, axis=1)[:, rank] if blocks else base
    width = np.zeros(blocks, np.uint8)
    for bit in range(32):
        width[usual >> np.uint32(bit) > 0] = bit + 1
    high = np.where(width[:, None] < 32, rest >> np.minimum(width, 31)[:, None].astype(np.uint32), 0)
    at_row, at_col = np.nonzero(high)
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(width.astype(np.uint32) * (BLOCK // 8), out=starts[1:])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        bits = np.empty((len(which), BLOCK, w), np.uint8)
        values = rest[which]
        for bit in range(w):
            bits[:, :, bit] = (values >> np.uint32(bit)) & 1
        packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        payload[starts[which].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    return b"".join((
        struct.pack(HEADER, MAGIC, 1, BLOCK, n, blocks, len(at_row)), starts.tobytes(), base.tobytes(), width.tobytes(),
        np.bincount(at_row, minlength=blocks).astype(np.uint8).tobytes(), at_col.astype(np.uint8).tobytes(),
        high[at_row, at_col].astype(np.uint32).tobytes(), payload.tobytes(),
    ))


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of an image; only the blocks that hold them are decoded."""
    magic, _, size, n, blocks, odd = struct.unpack_from(HEADER, image)
    if magic != MAGIC:
        raise ValueError("not a token image")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = struct.calcsize(HEADER)

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    starts, base, width = take(np.uint32, blocks + 1), take(np.uint32, blocks), take(np.uint8, blocks)
    many, column, high = take(np.uint8, blocks), take(np.uint8, odd), take(np.uint32, odd)
    payload = np.frombuffer(image, np.uint8, offset=at)
    a, b = first // size, -(-last // size)
    out = np.zeros((b - a, size), np.uint32)
    for w in np.unique(width[a:b]).tolist():
        which = np.flatnonzero(width[a:b] == w)
        if not w:
            continue
        packed = payload[starts[a:b][which].astype(np.int64)[:, None] + np.arange(w * size // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), size, w)
        values = np.zeros((len(which), size), np.uint32)
        for bit in range(w):
            values |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
        out[which] = values
    row = np.repeat(np.arange(blocks), many)
    inside = (row >= a) & (row < b)
    row, column, high = row[inside], column[inside], high[inside]
    out[row - a, column] |= high << width[row].astype(np.uint32)
    return (out + base[a:b, None]).reshape(-1)[first - a * size : last - a * size]


LETTERS, APOSTROPHE = (*range(65, 91), *range(97, 123)), 39
MARKS = tuple(i for i in range(33, 127) if not chr(i).isalnum() and i != APOSTROPHE)


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The same texts in lower ASCII case, with a space where a word tokenizer cuts anyway.

    That is between an ASCII letter and a following ASCII mark, and between a mark and a
    following letter, but not after an apostrophe, which may belong to what follows. Words
    with ``<|`` stay as they are: they may hold a special token. A letter before a character
    from U+0300 on (lead byte 0xCC) keeps its case: with a combining character a small letter
    can be composed where the capital cannot.
    """
    kind = np.zeros(256, np.uint8)
    kind[list(LETTERS)], kind[list(MARKS)], kind[APOSTROPHE] = 1, 2, 3
    kinds = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kinds[:-1] == 1) & (kinds[1:] >= 2) | (kinds[:-1] == 2) & (kinds[1:] == 1)
    lower = kit.lower_ascii(data)
    combined = np.flatnonzero(data[1:] >= 0xCC)
    lower[combined] = data[combined]
    for at in np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)).tolist():
        row = int(np.searchsorted(offsets, at, "right")) - 1
        a, b = int(offsets[row]), int(offsets[row + 1])
        text = data[a:b].tobytes()
        left, right = text[: at - a].split(), text[at - a :].split(maxsplit=1)
        start = at - (len(left[-1]) if left and not text[at - a - 1 : at - a].isspace() else 0)
        end = at + len(right[0])
        cut[start + 1 : end], lower[start:end] = False, data[start:end]
    at = np.flatnonzero(cut[:-1])
    at = at[~np.isin(at, offsets)]
    shifted = offsets + np.searchsorted(at, offsets)
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1,
        [None, pa.py_buffer(shifted.astype(np.int64)), pa.py_buffer(np.insert(lower, at, 32))],
    )


class Encoder:
    """Encodes columns of texts.

    With ``by_word`` each distinct piece of ``word_pieces`` between ASCII white space is
    encoded once, as long as it is remembered. That equals encoding whole texts only for a tokenizer that ignores case,
    drops white space and cuts between letters and marks.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.slots: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.slots.clear()
        self.ids, self.lengths, self.chars = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if not self.by_word:
            raw = data.tobytes()
            return self._encode([raw[a:b].decode() for a, b in zip(offsets, offsets[1:])])
        words = pc.ascii_split_whitespace(word_pieces(data, offsets))
        per_text = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.slots) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        slot = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = distinct[new].tolist()
            ids, lengths = self._encode(fresh)
            slot[new] = np.arange(len(self.lengths), len(self.lengths) + len(new))
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
            self.slots.update(zip(fresh, slot[new].tolist()))
            self.chars += sum(map(len, fresh))
        slot = slot[coded.indices.to_numpy(zero_copy_only=False)]
        begins = np.cumsum(self.lengths) - self.lengths
        lengths = self.lengths[slot] if len(slot) else np.zeros(0, np.int64)
        ids = self.ids[kit.ragged(begins[slot], lengths)] if len(slot) else np.zeros(0, np.uint32)
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(per_text))]
        return ids, np.diff(ends)


def worker_encoder(path: str, by_word: bool) -> Encoder:
    """The encoder of this worker process, with the pieces that its earlier tasks encoded.

    Task functions travel by value, so what outlives a task hangs on an imported module.
    """
    import tokenizers

    known = vars(tokenizers).setdefault("_remembered_encoders", {})
    if (path, by_word) not in known:
        known[path, by_word] = Encoder(path, by_word)
    return known[path, by_word]


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, by_word: bool = False, end_id: int = END_ID,
    id_column: str = "doc_id", text_column: str = "text", parts: int | None = None,
) -> None:
    """Encode documents in ascending order of id into the files of ``folder``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_column].dataType
    ordered = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).withColumns(
        {"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("inside", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_tokens", T.ArrayType(T.IntegerType())),
        T.StructField("image", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, by_word)
        part, inside = TaskContext.get().partitionId(), 0
        names, ids, lengths = [], [], []

        def close() -> pa.RecordBatch:
            all_ids, all_lengths = np.concatenate(ids), np.concatenate(lengths)
            all_names = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([inside], pa.int64()), pa.array([len(all_ids)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(all_names)], pa.int32()), all_names),
                kit.list_column(all_lengths, np.array([len(all_lengths)]), pa.int32()), pa.array([pack(all_ids)], pa.binary()),
            ], names=schema.names)

        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(1), CHUNK_BYTES):
                found, many = _with_end(*encoder(data, offsets), end_id)
                names.append(batch.column(0).slice(a, b - a))
                ids.append(found)
                lengths.append(many)
                if sum(map(len, ids)) >= SEGMENT_IDS or sum(map(len, lengths)) >= SEGMENT_DOCS:
                    yield close()
                    inside += sum(map(len, ids))
                    names, ids, lengths = [], [], []
        if lengths:
            yield close()

    kit.map_arrow(ordered.select("doc_id", "text"), run, schema).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    segments = spark.read.parquet(folder)
    # One row per written partition, of which there are as many as write_tokens was told.
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")
    parts = F.broadcast(sums.select("part", before.alias("part_start")))
    schema = T.StructType([
        T.StructField("doc_id", segments.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lengths = np.array(batch.column(2)[i].as_py(), np.int64)
                ids = unpack(batch.column(3)[i].as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends - lengths, ends)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + ends - lengths), pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ], names=schema.names)

    joined = segments.join(parts, "part").select((F.col("part_start") + F.col("inside")).alias("start"), "doc_ids", "n_tokens", "image")
    return kit.map_arrow(joined, run, schema)


def token_report(docs: DataFrame, tokenizer: str, by_word: bool = False) -> DataFrame:
    """Write the documents' ids to new files in the shared folder and read them back."""
    folder = kit.shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, by_word)
    return read_tokens(docs.sparkSession, folder)
