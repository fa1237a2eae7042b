"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

Texts are cut at places that no piece of the vocabulary spans, so the tokens of a text are
those of its pre-tokens. One pass over all documents keeps, in every task, a bounded summary
of the most frequent pre-tokens; the summaries name the entries of a compact hash table
(first tier), which is broadcast: at most ``TABLE_ENTRIES`` keys and lengths, whatever the
corpus. The counting pass looks every pre-token up by its 64-bit hash; misses are encoded
and remembered by the worker (second tier), whose memory starts anew beyond
``CACHE_ENTRIES``. The table decides the speed only, never a count.

The tokenizer is a sentencepiece model. A model whose normalizer changes single characters
is not cut: whole texts are then encoded.

Null or empty texts have no bytes and no tokens. Texts of any length are counted whole.
Repeated rows are counted each; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

LIMIT = 4096
TABLE_ENTRIES = 1 << 16
# Pre-tokens of a task's summary, and how many of them it reports.
SUMMARY, REPORTED = 1 << 16, 1 << 12
# Longer pre-tokens are not kept in the table; bytes.
LONGEST = 64
CACHE_ENTRIES = 1 << 20
CHUNK_BYTES = 1 << 20
# How the model's files write a space, and a character that stands alone.
SPACE_MARK, ALONE = "▁", "\n"
OTHER = 128


def cut_rules(path: str) -> np.ndarray | None:
    """joined[a, b], flat: some piece has a character of class a before one of class b; None for a model that can't be cut."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
    joined = np.zeros((OTHER + 1, OTHER + 1), bool)
    joined[OTHER, OTHER] = True
    for piece in pieces:
        classes = [min(ord(c), OTHER) for c in piece.replace(SPACE_MARK, " ")]
        joined[classes[:-1], classes[1:]] = True
    before_space = joined[:, ord(" ")].copy()
    before_space[ord(" ")] = False
    plain = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
    unchanged = p.normalize(plain) == SPACE_MARK + plain.replace(" ", SPACE_MARK)
    return joined.ravel() if unchanged and not before_space.any() and not any(ALONE in x for x in pieces) else None


class Model:
    """A sentencepiece model and the rules by which texts are cut for it."""

    def __init__(self, path: str, joined: np.ndarray | None):
        from sentencepiece import SentencePieceProcessor

        self.processor, self.joined = SentencePieceProcessor(model_file=path), joined
        self.before = len(self.processor.encode(ALONE))

    def whole_lengths(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.processor.encode(texts, num_threads=1)), np.int64, len(texts))

    def lengths(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of pre-tokens; the leading mark of a text's first one is part of it."""
        return self.whole_lengths([ALONE + x for x in pretokens]) - self.before

    def cut(self, column: pa.Array):
        """(first row, last row, bytes, starts, ends, rows, hashes) of the pre-tokens of runs of rows."""
        column = pc.replace_substring(pc.fill_null(column, ""), SPACE_MARK, " ")
        for a, b, data, offsets in kit.pieces(column, CHUNK_BYTES):
            filled = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][filled], ord(" "))
            offsets = offsets + np.append(0, np.cumsum(filled))
            kinds = np.minimum(data, OTHER).astype(np.int32)
            first = np.ones(len(data), bool)
            first[1:] = ~self.joined[kinds[:-1] * (OTHER + 1) + kinds[1:]]
            first[offsets[:-1][filled]] = True
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            rows = np.searchsorted(offsets, starts, "right") - 1
            yield a, b, data, starts, ends, rows, kit.span_hashes(kit.prefix_hashes(data), starts, ends)


class Table:
    """Open addressing over two numpy arrays; hash 0 marks a free slot and is never a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        left, self.steps = np.flatnonzero(keys), 0
        while len(left):
            slot = self._slot(keys[left], self.steps)
            self.steps += 1
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            placed = left[free][one]
            self.keys[slot[free][one]], self.values[slot[free][one]] = keys[placed], values[placed]
            left = left[~np.isin(left, placed)]

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys + np.uint64(step)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for step in range(self.steps):
            slot = self._slot(keys[left], step)
            held = self.keys[slot]
            same = (held == keys[left]) & (held != 0)
            out[left[same]] = self.values[slot[same]]
            left = left[~same & (held != 0)]
            if not len(left):
                break
        return out


def _worker(path: str, joined: np.ndarray | None) -> tuple[Model, dict[int, int]]:
    """The model and the remembered lengths of this worker process.

    Task functions travel by value, so what outlives a task hangs on an imported module.
    """
    import sentencepiece

    known = vars(sentencepiece).setdefault("_remembered_lengths", {})
    if path not in known:
        known[path] = (Model(path, joined), {})
    return known[path]


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]


def frequent(docs: DataFrame, path: str, joined: np.ndarray, entries: int) -> Table:
    """The table of the most frequent pre-tokens of all texts and their lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _worker(path, joined)
        keys, counts, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            for _, _, data, starts, ends, _, hashes in model.cut(batch.column(0)):
                short = ends - starts <= LONGEST
                found, first, many = np.unique(hashes[short], return_index=True, return_counts=True)
                slot = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
                old = keys[slot] == found if len(keys) else np.zeros(len(found), bool)
                counts[slot[old]] += many[old]
                new = ~old
                words = np.array(_texts(data, starts[short][first[new]], ends[short][first[new]]) + [""], object)[:-1]
                keys, counts, texts = np.append(keys, found[new]), np.append(counts, many[new]), np.append(texts, words)
                if len(keys) > SUMMARY:
                    most = np.argpartition(-counts, SUMMARY // 2)[: SUMMARY // 2]
                    keys, counts, texts = keys[most], counts[most], texts[most]
                order = np.argsort(keys)
                keys, counts, texts = keys[order], counts[order], texts[order]
        most = np.argsort(-counts, kind="stable")[:REPORTED]
        if len(most):
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts[most].tolist(), pa.string()), pa.array(counts[most])], names=["pretoken", "n"])

    # Summaries only: at most REPORTED rows a task, however many pre-tokens it has seen.
    found = kit.map_arrow(docs.select("text"), run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    words = [r["pretoken"] for r in found.orderBy(F.desc("n"), "pretoken").limit(entries).select("pretoken").collect()]
    data, offsets = kit.column_bytes(pa.array(words, pa.string()))
    keys = kit.span_hashes(kit.prefix_hashes(data), offsets[:-1], offsets[1:])
    return Table(keys, Model(path, joined).lengths(words) if words else np.zeros(0, np.int64))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, entries: int = TABLE_ENTRIES,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The table of frequent pre-tokens is made when it is called; the counting is lazy.
    """
    docs = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    joined = cut_rules(path)
    shared = None
    if joined is not None:
        shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, joined, entries))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def lengths(model: Model, known: dict[int, int], table: Table, data, starts, ends, hashes) -> np.ndarray:
        found = table(hashes)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            keys, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            values = np.array([known.get(h, -1) for h in keys.tolist()], np.int64)
            fresh = np.flatnonzero(values < 0)
            if len(fresh):
                at = missed[first[fresh]]
                values[fresh] = model.lengths(_texts(data, starts[at], ends[at]))
                if len(known) + len(fresh) > CACHE_ENTRIES:
                    known.clear()
                known.update(zip(keys[fresh].tolist(), values[fresh].tolist()))
            found[missed] = values[back]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _worker(path, joined)
        for batch in batches:
            n_bytes = np.diff(kit.column_bytes(batch.column(1))[1])
            if shared is None:
                n_tokens = model.whole_lengths(pc.fill_null(batch.column(1), "").to_pylist())
            else:
                n_tokens = np.zeros(len(batch), np.int64)
                for a, b, data, starts, ends, rows, hashes in model.cut(batch.column(1)):
                    many = lengths(model, known, shared.value, data, starts, ends, hashes)
                    n_tokens[a:b] = np.bincount(rows, many, b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=schema.names)

    return kit.map_arrow(docs, run, schema)
