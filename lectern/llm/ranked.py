"""Ranked lexical search by the Best Position Algorithm.

Documents are read once for a block of items: each becomes a forward row of the item terms
it holds, from which Spark counts documents, lengths and document frequencies over the
whole table. The rows are then searched where they lie. A task takes its documents in
segments; a segment's postings are impact lists, one a term, highest contribution first.
For an item its lists are read in parallel. A document met in one list is looked up
directly in all of the item's other lists, which gives its score and its position in each.
Every list keeps its best position, up to which all entries are seen, by reading or by
lookup. No unseen document can score more than the contributions just after the best
positions add up to; when that is strictly below the item's k-th score so far (of all
segments of the task), the item is done with the segment. Each task hands on at most k
documents an item, which Spark ranks.

Scores are whole numbers (see ``weights`` and ``impacts``). Null or empty texts have no
terms, count in no statistic and are never ranked; an item without terms has no result.
Equal scores go by ascending doc_id, null last. Repeated documents are ranked each;
repeated item rows are each an item. Empty tables give an empty result. Long texts are
read whole. doc_id must be a whole number. Items are dealt into blocks of at most
``BLOCK_BYTES`` of text, which are broadcast one at a time (a larger item is a block of
its own: only its distinct terms are sent). Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

TOP = 10
BLOCK_BYTES = 16 << 20
# Postings of a segment, and the first reading depth of its lists (doubled each round).
SEGMENT_POSTINGS = 1 << 20
FIRST_DEPTH = 8
# Fixed values of the score: length share in percent, saturation, scale.
LENGTH_SHARE, SATURATION, UNIT = 75, 8, 1_000_000_000
# Groups in which the documents of one item are ranked first.
SALTS = 64


def _terms(column: pa.Array):
    """(first row, last row, term hashes, rows) of runs of rows."""
    for a, b, data, offsets in kit.pieces(column):
        data = kit.lower_ascii(data)
        starts, ends, rows = kit.word_spans(data, offsets, kit.NOT_ALPHANUMERIC)
        yield a, b, kit.span_hashes(kit.prefix_hashes(data), starts, ends), rows


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one occurrence in the item adds for a weight of 1."""
    m = (100 - LENGTH_SHARE) + (LENGTH_SHARE * length * documents) // max(terms, 1)
    return (UNIT * tf) // (1000 * tf + SATURATION * m)


class ItemTerms:
    """The distinct terms of a block of items, and each item's terms with their repeats."""

    def __init__(self, numbers: list[int], texts: list[str]):
        words, owner = [], []
        for a, _, hashes, rows in _terms(pa.array(texts, pa.large_string())):
            words.append(hashes)
            owner.append(rows + a)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.terms, slot = np.unique(words, return_inverse=True)
        pairs, repeats = np.unique(np.stack([owner, slot]), axis=1, return_counts=True)
        self.numbers, self.slot, self.repeats = np.array(numbers, np.int64), pairs[1], repeats
        self.first = np.searchsorted(pairs[0], np.arange(len(texts) + 1))


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Deal items out until no block of several items exceeds the bound."""
    size, n = F.octet_length("text"), 1
    while True:
        block = F.pmod(F.xxhash64("number"), F.lit(n))
        sums = items.groupBy(block.alias("b")).agg(F.sum(size).alias("s"), F.count("*").alias("c"))
        if not sums.where((F.col("s") > block_bytes) & (F.col("c") > 1)).limit(1).count():
            return [items.where(block == i) for i in range(n)]
        n *= 2


def forward_rows(docs: DataFrame, terms) -> DataFrame:
    """docs(doc_id, text) to (doc_id, length, slots, counts): the block's terms in each document that has any term."""
    schema = "doc_id long, length long, slots array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        seen = np.zeros(1 << 20, bool)
        seen[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for a, b, words, rows in _terms(batch.column(1)):
                length = kit.row_counts(rows, b - a)
                maybe = np.flatnonzero(seen[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(known, words[maybe]), max(len(known) - 1, 0))
                sure = known[slot] == words[maybe] if len(known) else np.zeros(0, bool)
                pair, many = np.unique(rows[maybe[sure]] * len(known) + slot[sure], return_counts=True)
                row = pair // max(len(known), 1)
                per_row = kit.row_counts(row, b - a)
                out = pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(length),
                    kit.list_column((pair - row * len(known)).astype(np.int32), per_row, pa.int32()),
                    kit.list_column(many.astype(np.int32), per_row, pa.int32()),
                ], names=["doc_id", "length", "slots", "counts"])
                yield out.filter(pa.array(length > 0))

    return kit.map_arrow(docs, run, schema)


class Best:
    """The k best documents so far of every item of a block."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64)
        self.null, self.many = np.zeros((items, k), bool), np.zeros(items, np.int64)

    def kth(self, item: int) -> int:
        """The score to beat; 0 while there are fewer than k documents."""
        return int(self.score[item, self.k - 1]) if self.many[item] == self.k else 0

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        held = self.many[item]
        score, doc = np.append(self.score[item, :held], score), np.append(self.doc[item, :held], doc)
        null = np.append(self.null[item, :held], null)
        order = np.lexsort((doc, null, -score))[: self.k]
        self.many[item] = n = len(order)
        self.score[item, :n], self.doc[item, :n], self.null[item, :n] = score[order], doc[order], null[order]


class Segment:
    """Impact lists of some documents, and where each document stands in each list."""

    def __init__(self, doc, null, slots, per_doc, contribution, terms: int):
        self.doc, self.null, self.slots, self.contribution = doc, null, slots, contribution
        self.per_doc = per_doc
        self.begin = np.cumsum(per_doc) - per_doc
        owner = np.repeat(np.arange(len(doc)), per_doc)
        order = np.lexsort((-contribution, slots))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.listed, self.value = owner[order], contribution[order]
        self.first = np.searchsorted(slots[order], np.arange(terms + 1))
        # Which item has seen a list entry, or scored a document, last.
        self.seen, self.scored = np.full(len(order), -1), np.full(len(doc), -1)
        self.repeats = np.zeros(terms, np.int64)

    def _advance(self, item: int, start: np.ndarray, size: np.ndarray, best: np.ndarray) -> None:
        """Move the best positions over all entries that the item has seen."""
        active, width = np.flatnonzero(best < size), 2 * FIRST_DEPTH
        while len(active):
            reach = np.minimum(width, size[active] - best[active])
            unseen = self.seen[kit.ragged(start[active] + best[active], reach)] != item
            at = np.where(unseen, np.arange(len(unseen)), len(unseen))
            cut = np.cumsum(reach) - reach
            run = np.minimum(np.minimum.reduceat(at, cut) - cut, reach)
            best[active] += run
            active = active[(run == reach) & (best[active] < size[active])]
            width *= 4

    def search(self, item: int, slots: np.ndarray, repeats: np.ndarray, top: Best) -> int:
        """Bring the item's best documents into ``top``; the number of documents looked up."""
        start, size = self.first[slots], self.first[slots + 1] - self.first[slots]
        filled = size > 0
        slots, repeats, start, size = slots[filled], repeats[filled], start[filled], size[filled]
        self.repeats[slots] = repeats
        best, read, depth, looked_up = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64), FIRST_DEPTH, 0
        while True:
            ahead = best < size
            bound = int((repeats[ahead] * self.value[start[ahead] + best[ahead]]).sum())
            # No unseen document scores above the bound: strictly below the k-th, none can enter.
            if bound == 0 or bound < top.kth(item):
                break
            # Positions up to the best one are seen already.
            read = np.maximum(read, best)
            until = np.minimum(size, depth)
            met = self.listed[kit.ragged(start + read, np.maximum(until - read, 0))]
            read, depth = np.maximum(read, until), 2 * depth
            fresh = np.unique(met[self.scored[met] != item])
            if len(fresh):
                looked_up += len(fresh)
                self.scored[fresh] = item
                entry = kit.ragged(self.begin[fresh], self.per_doc[fresh])
                many = self.repeats[self.slots[entry]]
                mine = many > 0
                self.seen[self.place[entry[mine]]] = item
                sums = np.append(0, np.cumsum(many * self.contribution[entry]))
                ends = np.cumsum(self.per_doc[fresh])
                score = sums[ends] - sums[ends - self.per_doc[fresh]]
                good = score >= max(top.kth(item), 1)
                top.add(item, score[good], self.doc[fresh[good]], self.null[fresh[good]])
            self._advance(item, start, size, best)
        self.repeats[slots] = 0
        return looked_up


def _search_block(docs: DataFrame, block: DataFrame, k: int, segment_postings: int) -> DataFrame:
    """(number, doc_id, score, part): at most k documents of each item from every task."""
    context = docs.sparkSession.sparkContext
    rows = block.orderBy("number").toPandas()
    items = ItemTerms(list(rows["number"]), list(rows["text"]))
    terms = context.broadcast(items.terms)
    forward = kit.stage(forward_rows(docs, terms), "forward")
    documents, length = forward.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    counted = forward.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).toPandas()
    terms.unpersist()
    df = np.zeros(len(items.terms), np.int64)
    df[counted["slot"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    shared = context.broadcast({"weight": weights(df, documents), **{x: getattr(items, x) for x in ("numbers", "slot", "repeats", "first")}})
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        numbers, first, weight = of["numbers"], of["first"], of["weight"]
        top = Best(len(numbers), k)

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            column = {name: table[name].chunk(0) for name in table.column_names}
            slots, tf = (column[x].flatten().to_numpy().astype(np.int64) for x in ("slots", "counts"))
            per_doc = np.diff(column["slots"].offsets.to_numpy()).astype(np.int64)
            sizes = np.repeat(column["length"].to_numpy(), per_doc)
            segment = Segment(
                column["doc_id"].fill_null(0).to_numpy(), column["doc_id"].is_null().to_numpy(zero_copy_only=False), slots, per_doc,
                weight[slots] * impacts(tf, sizes, documents, length), len(weight))
            for item in range(len(numbers)):
                span = slice(first[item], first[item + 1])
                segment.search(item, of["slot"][span], of["repeats"][span], top)

        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= segment_postings:
                search(held)
                held, postings = [], 0
        if held:
            search(held)
        item, place = np.nonzero(np.arange(k) < top.many[:, None])
        yield pa.RecordBatch.from_arrays([
            pa.array(numbers[item]), pa.array(top.doc[item, place], mask=top.null[item, place]), pa.array(top.score[item, place]),
        ], names=schema.names)

    return kit.map_arrow(forward.where(F.size("slots") > 0), run, schema)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, segment_postings: int = SEGMENT_POSTINGS,
) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score.

    The statistics are computed when it is called; the search is lazy.
    """
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    items = kit.stage(items.select(
        F.monotonically_increasing_id().alias("number"), items[item_column].alias("item_id"),
        kit.null_text(items[item_text]).alias("text")), "items")
    parts = [_search_block(docs, block.select("number", "text"), k, segment_postings) for block in _blocks(items, block_bytes)]
    found = reduce(DataFrame.unionByName, parts).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # Ranked in groups first, so that an item's rows from all tasks do not meet in one.
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(items.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
