"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is a run of ``window`` consecutive words of a benchmark item (a shorter item
is one window). Containment must be whole, so one token of a window is a sufficient
prefix: its rarest word over all documents. Documents look only these tokens up; the
place of the token in the window fixes where the window would start (positional
bound), the rest of the text must be long enough (length bound), and all words of
the window are then compared.

The item index is small and its size is checked: items are dealt into blocks of at
most ``block_bytes`` of text, and each block's index is broadcast and meets all
documents in turn. Documents are never shuffled by word; hits are summed per
document. Words are compared by 64-bit hashes, all words of a window at once.

Null or empty texts have no words and no hits. An item without words has no window.
Repeated documents are reported once per row; repeated items by their item_id.
An item above ``block_bytes`` is cut into parts that overlap by ``window`` - 1 words, so
it keeps all its windows; only a single window above the bound raises an error. Items
with a null item_id hit words and contaminate as all others; they have no name, so they
are not in ``item_ids``, ``n_items`` and ``items_sha256``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

WINDOW = 10
BLOCK_BYTES = 16 << 20


def _words(column: pa.Array):
    """Row ranges of a text column with the word hashes and rows of each."""
    for a, b, data, offsets in kit.pieces(column):
        data = kit.lower_ascii(data)
        starts, ends, rows = kit.word_spans(data, offsets, kit.NOT_ALPHANUMERIC)
        yield a, b, kit.span_hashes(kit.prefix_hashes(data), starts, ends), rows


class WindowIndex:
    """The distinct windows of a block of items, found by their rarest word."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words, items, at = [], [], 0
        for a, _, hashes, rows in _words(pa.array(texts, pa.large_string())):
            words.append(hashes)
            items.append(rows + a)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        items = np.concatenate(items) if items else np.zeros(0, np.int64)
        counts = kit.row_counts(items, len(texts))
        sizes = np.minimum(counts, window)
        begins = np.cumsum(counts) - counts
        per_item = np.where(counts > 0, counts - sizes + 1, 0)
        item = np.repeat(np.arange(len(texts)), per_item)
        start = kit.ragged(begins, per_item)
        self.vocabulary = np.unique(words)
        self.words, self.ids = words, [x if isinstance(x, str) else None for x in ids]
        self.start, self.size, self.item = start, sizes[item], item

    @classmethod
    def of(cls, parts: dict) -> WindowIndex:
        index = cls.__new__(cls)
        index.__dict__.update(parts)
        return index

    def order(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's rarest word, given the counts of words in all documents."""
        frequency = np.zeros(len(self.vocabulary), np.int64)
        frequency[np.searchsorted(self.vocabulary, tokens)] = counts
        rarity = frequency[np.searchsorted(self.vocabulary, self.words)]
        best = np.zeros(len(self.start), np.int64)
        lowest = np.full(len(self.start), np.iinfo(np.int64).max)
        for j in range(int(self.size.max(initial=0))):
            inside = j < self.size
            here = np.where(inside, rarity[np.minimum(self.start + j, len(rarity) - 1)], np.iinfo(np.int64).max)
            best, lowest = np.where(here < lowest, j, best), np.minimum(here, lowest)
        token = self.words[self.start + best]
        order = np.argsort(token, kind="stable")
        for name in ("start", "size", "item"):
            setattr(self, name, getattr(self, name)[order])
        self.place, token = best[order], token[order]
        self.token, self.first = np.unique(token, return_index=True)
        self.many = np.diff(np.append(self.first, len(token)))
        # A small table of low bits tells most words apart before the search.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.token & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, rows: np.ndarray):
        """(position, size, item) of every occurrence of a window in these words."""
        maybe = np.flatnonzero(self.seen[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = np.searchsorted(self.token, words[maybe])
        slot[slot == len(self.token)] = 0
        sure = self.token[slot] == words[maybe] if len(self.token) else np.zeros(0, bool)
        maybe, slot = maybe[sure], slot[sure]
        which = kit.ragged(self.first[slot], self.many[slot])
        begin = np.repeat(maybe, self.many[slot]) - self.place[which]
        last = begin + self.size[which] - 1
        fits = (begin >= 0) & (last < len(words))
        fits[fits] = rows[begin[fits]] == rows[last[fits]]
        which, begin = which[fits], begin[fits]
        for j in range(int(self.size.max(initial=0))):
            same = j >= self.size[which]
            same[~same] = words[begin[~same] + j] == self.words[self.start[which[~same]] + j]
            which, begin = which[same], begin[same]
        return begin, self.size[which], self.item[which]


def _parts(items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """Items above the bound in overlapping parts that together have all windows; the rest of one that can't be cut stays whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                if len(data) > block_bytes:
                    starts, ends, _ = kit.word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), kit.NOT_ALPHANUMERIC)
                    i = 0
                    while i < len(starts):
                        j = int(np.searchsorted(ends, starts[i] + block_bytes, "right")) - 1
                        if j - i + 1 < window:
                            j = len(starts) - 1
                        ids.append(name)
                        texts.append(data[starts[i] : ends[j]].decode())
                        i = j - window + 2 if j < len(starts) - 1 else len(starts)
                else:
                    ids.append(name)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "item_text"])

    return kit.map_arrow(items.select("item_id", "item_text"), run, "item_id string, item_text string")


def _blocks(items: DataFrame, window: int, block_bytes: int) -> list[DataFrame]:
    """Deal items out so that the text of no block exceeds the bound."""
    total, largest = items.agg(F.sum(F.octet_length("item_text")), F.max(F.octet_length("item_text"))).first()
    if not total:
        return []
    if largest > block_bytes:
        items = _parts(items, window, block_bytes)
        total, largest = items.agg(F.sum(F.octet_length("item_text")), F.max(F.octet_length("item_text"))).first()
        if not total:
            return []
        if largest > block_bytes:
            raise ValueError(f"a window or its item has {largest} bytes; block_bytes is {block_bytes}")
    n = 1 if total <= block_bytes else 2 * -(-total // block_bytes)
    while True:
        block = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n))
        heaviest = items.groupBy(block.alias("b")).agg(F.sum(F.octet_length("item_text")).alias("s")).agg(F.max("s")).first()[0]
        if heaviest <= block_bytes:
            return [items.where(block == i) for i in range(n)]
        n *= 2


def _token_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each word of the block's vocabulary occurs in all documents."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = np.zeros(1 << 20, bool)
        seen[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, words, _ in _words(batch.column(0)):
                words = words[seen[(words & np.uint64((1 << 20) - 1)).astype(np.int64)]]
                slot = np.minimum(np.searchsorted(known, words), len(known) - 1)
                counts += np.bincount(slot[known[slot] == words], minlength=len(known))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(counts[at])], names=["at", "n"])

    found = kit.map_arrow(docs.select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    return vocabulary[found["at"].to_numpy(np.int64)], found["n"].to_numpy(np.int64)


def _indexes(docs: DataFrame, items: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcast index of each block of items; docs(text), items(item_id, item_text)."""
    found = []
    for block in _blocks(items, window, block_bytes):
        rows = block.toPandas()
        index = WindowIndex(list(rows["item_id"]), list(rows["item_text"]), window)
        index.order(*_token_counts(docs, index.vocabulary))
        # At most block_bytes of item text each.
        found.append(docs.sparkSession.sparkContext.broadcast(vars(index)))
    return found


def _items(items: DataFrame, item_column: str, item_text: str) -> DataFrame:
    return items.select(
        items[item_column].cast("string").alias("item_id"), kit.null_text(items[item_text]).alias("item_text"),
    ).where(F.col("item_text") != "").distinct()


def _judged(column: pa.Array, indexes: list):
    """Row range, words, hit words and items found of each row of a text column."""
    for a, b, words, rows in _words(column):
        edges = np.zeros(len(words) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(b - a)]
        for shared in indexes:
            index = WindowIndex.of(shared.value)
            begin, size, item = index.hits(words, rows)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + size, -1)
            for row, i in set(zip(rows[begin].tolist(), item.tolist())):
                if index.ids[i] is not None:
                    found[row].add(index.ids[i])
        yield a, b, kit.row_counts(rows, b - a), kit.row_counts(rows[np.cumsum(edges[:-1]) > 0], b - a), [sorted(x) for x in found]


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    The result is lazy but for the index: the counts of item words over all documents
    are computed when it is called.
    """
    docs = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    indexes = _indexes(docs, _items(items, item_column, item_text), window, block_bytes)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, count, hit, ids in _judged(batch.column(1), indexes):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(count), pa.array(hit), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.string())), pa.array([kit.digest_of_ids(x) for x in ids]), pa.array(hit > 0),
                ], names=schema.names)

    return kit.map_arrow(docs, run, schema)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    at = docs.columns.index(text_column)
    indexes = _indexes(docs.select(docs[text_column].alias("text")), _items(items, "item_id", "text"), window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [hit for _, _, _, hit, _ in _judged(batch.column(at), indexes)]
            if hits:
                yield batch.filter(pa.array(np.concatenate(hits) == 0))

    return kit.map_arrow(docs, run, docs.schema)
