"""Removal of byte strings that occur more than once, by sharded suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere.

1. Anchors. In every string of LENGTH bytes the k-gram with the smallest hash is its
   anchor, so equal strings have equal anchors. Starts that share an anchor are one
   segment: the run of starts and the text they cover. Segments whose anchor occurs once
   are done: nothing in them repeats.
2. Segments of equal content repeat as a whole, first those within a document (a text
   of one short phrase has thousands), then between documents. Of each content one text
   is kept.
3. Different segments with one anchor go to the same shard, of bounded bytes. A shard
   sorts its suffixes by Larsson-Sadakane refinement (prefix doubling of the groups that
   are not yet sorted) and takes the common prefixes of neighbours with Kasai's rule.
   Runs of neighbours with LENGTH bytes in common are the repeated strings.
4. An anchor with more text than a shard may hold is dealt over several shards. Each cuts
   its sorted list of distinct strings at common bounds by binary search; the pieces of
   one range meet and are merged, again by binary search.

Texts meet the repeated runs by the hash and length of the text, so copies share one
answer: the removed runs and what is left, from which counts and digest are read off. What
is left are bytes, as a run may end inside a character; it is null where nothing goes, so
whole texts need not be carried along. Tables in between are written; no step collects
more than a sum.

Null is empty. A text below LENGTH bytes loses nothing. Repeated rows repeat each other.
doc_id may be null or repeated; it is only passed on. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

LENGTH = 400
GRAM = 64
SHARD_BYTES = 1 << 20
PLACE_BITS = 24
CHUNK_BYTES = 1 << 20
# Places of a text; the row of a batch stands above them.
ROW_BITS = 40
SPANS = "spans array<struct<start: long, end: long>>"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, first start, number of starts, anchor hash and content hash of every segment."""
    many = np.maximum(0, np.diff(offsets) - length + 1)
    if not many.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = kit.prefix_hashes(data)
    n, width = len(data) - gram + 1, length - gram + 1
    grams = kit.mix((sums[gram:] - sums[:-gram]) * kit.powers(kit.UNBASE, n))
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    low = np.uint64((1 << max(PLACE_BITS, int(n).bit_length())) - 1)
    value = grams & ~low | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    start = kit.ragged(offsets[:-1], many)
    anchor = (np.minimum(behind[start], ahead[start + width - 1]) & low).astype(np.int64)
    begins = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(start)) - 1
    row = np.searchsorted(offsets, start[first], "right") - 1
    content = kit.span_hashes(sums, start[first], start[last] + length)
    return row, start[first] - offsets[row], last - first + 1, grams[anchor[first]], content


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and the eight bytes at each place."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    eight = np.zeros(n, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(eight, kind="stable")
    fresh = np.append(True, eight[order[1:]] != eight[order[:-1]])
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    step = 8
    while step < depth:
        # Only groups of several suffixes are refined; the others keep their place.
        single = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~single)
        if not len(places):
            break
        suffixes = order[places]
        by = group[places] * (n + 1) + rank[np.minimum(suffixes + step, n)] + 1
        inner = np.argsort(by, kind="stable")
        suffixes, by = suffixes[inner], by[inner]
        order[places] = suffixes
        fresh[places] = np.append(True, by[1:] != by[:-1])
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[suffixes] = group[places]
        step *= 2
    return order, eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, begins: np.ndarray, runs: np.ndarray, cap: int) -> np.ndarray:
    """For each of the sorted starts ``order``: bytes in common with the one before, at most ``cap``.

    Kasai's rule along every run of starts, all runs at once: what start p shares with its
    neighbour, less one byte, start p + 1 shares too, if the neighbour's successor is
    among the starts. Suffixes equal beyond the sorted depth stand in any order, so at the
    cap what is carried on is first compared by hash.
    """
    n = len(eight)
    data = (eight >> np.uint64(56)).astype(np.uint8)
    sums, shift = kit.prefix_hashes(data), kit.powers(kit.UNBASE, n)
    valid = np.zeros(n + 1, bool)
    valid[order] = True
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    by_length = np.argsort(-runs, kind="stable")
    begins, runs = begins[by_length], runs[by_length]
    height = np.zeros(len(begins), np.int64)
    carry = np.zeros(len(begins), bool)
    for t in range(int(runs.max(initial=0))):
        live = int(np.searchsorted(-runs, -t, "left"))
        p = begins[:live] + t
        q = before[p]
        h = np.where(carry[:live], np.clip(height[:live] - 1, 0, cap - 1), 0)
        h[q < 0] = 0
        doubt = np.flatnonzero((h == cap - 1) & (q >= 0))
        a, b, w = p[doubt], q[doubt], h[doubt]
        h[doubt[(sums[a + w] - sums[a]) * shift[a] != (sums[b + w] - sums[b]) * shift[b]]] = 0
        active = np.flatnonzero((q >= 0) & (h < cap))
        while len(active):
            a, b = p[active] + h[active], q[active] + h[active]
            inside = (a < n) & (b < n)
            active, a, b = active[inside], a[inside], b[inside]
            differ = eight[a] ^ eight[b]
            step = np.full(len(active), 8)
            for byte in range(1, 9):
                step -= differ >= np.uint64(1 << (8 * byte - 8))
            h[active] += step
            active = active[(step == 8) & (h[active] < cap)]
        height[:live] = h
        carry[:live] = (q >= 0) & valid[np.minimum(q + 1, n)]
        shared[p] = np.minimum(h, cap)
    return shared[order]


def repeated_starts(texts: list[bytes], runs: np.ndarray, length: int = LENGTH):
    """Sorted starts of a shard, their class of equal strings, and which classes repeat.

    ``texts`` are the segments' bytes, ``runs`` their numbers of starts.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, eight = suffix_order(data, length)
    valid = np.zeros(len(data), bool)
    valid[kit.ragged(begins, runs)] = True
    order = order[valid[order]]
    shared = common_prefixes(order, eight, begins, runs, length)
    kind = np.cumsum(shared < length) - 1
    return order, kind, np.bincount(kind, minlength=1) > 1, data, begins


def _runs_of(marks: np.ndarray, begins: np.ndarray, runs: np.ndarray):
    """Maximal runs of marked starts of each segment: segment, first start, number."""
    which = np.repeat(np.arange(len(runs)), runs)
    place = kit.ragged(np.zeros(len(runs), np.int64), runs)
    at = np.flatnonzero(marks[kit.ragged(begins, runs)])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.append(True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]]))
    first = np.flatnonzero(cut)
    return which[at[first]], place[at[first]], np.diff(np.append(first, len(at)))


def _documents(docs: DataFrame, length: int) -> DataFrame:
    """Hash, bytes and digest of every text, and its segments."""
    span = [T.StructField("start", T.IntegerType()), T.StructField("run", T.IntegerType())]
    segment = [*span, T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), T.StructField("times", T.LongType())]
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("sha", T.StringType()), T.StructField("segments", T.ArrayType(T.StructType(segment))),
        T.StructField("own", T.ArrayType(T.StructType(span))),
    ])

    def lists(rows: np.ndarray, n: int, **columns: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(kit.row_counts(rows, n))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(2), CHUNK_BYTES):
                row, start, many, key, content = anchors(data, offsets, length)
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
                same = kit.mix(kit.mix(key ^ row.astype(np.uint64)) ^ content)
                _, first, inverse, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
                # Runs of segments that repeat within their text.
                own = np.flatnonzero(times[inverse] > 1)
                joined = np.append(False, (row[own[1:]] == row[own[:-1]]) & (start[own[1:]] == start[own[:-1]] + many[own[:-1]]))
                head = np.flatnonzero(~joined[: len(own)])
                ends = np.append(head[1:], len(own))[: len(head)] - 1
                own_row, own_start = row[own[head]], start[own[head]]
                own_run = start[own[ends]] + many[own[ends]] - own_start
                order = np.argsort(first)
                first, times = first[order], times[order]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(sha),
                    lists(row[first], b - a, start=pa.array(start[first], pa.int32()), run=pa.array(many[first], pa.int32()),
                          key=pa.array(key[first].view(np.int64)), content=pa.array(content[first].view(np.int64)),
                          times=pa.array(times.astype(np.int64))),
                    lists(own_row, b - a, start=pa.array(own_start, pa.int32()), run=pa.array(own_run, pa.int32())),
                ], names=schema.names)

    return kit.map_arrow(docs.select("doc_id", "h", "text"), run, schema)


def _cut(texts: DataFrame) -> DataFrame:
    """The bytes of the wanted segments of texts(text, wanted)."""
    names = ["key", "content", "run", "shard", "part", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kit.column_bytes(batch.column(0))
            wanted = batch.column(1)
            row = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            field = dict(zip([f.name for f in flat.type], flat.flatten()))
            first = offsets[row] + field["start"].to_numpy()
            size = field["run"].to_numpy() + LENGTH_LESS
            for i in range(0, len(first), 4096):
                bits = [data[x : x + y].tobytes() for x, y in zip(first[i : i + 4096], size[i : i + 4096])]
                yield pa.RecordBatch.from_arrays(
                    [field[c].slice(i, 4096) for c in names] + [kit.binary_column(bits)], names=[*names, "bytes"])

    return kit.map_arrow(texts, run, "key long, content long, run int, shard long, part long, parts long, bytes binary")


LENGTH_LESS = LENGTH - 1


def _search(segments: DataFrame) -> DataFrame:
    """Per shard: runs of repeated starts; of dealt anchors also the pieces to merge."""
    schema = "key long, content long, start int, run int, part long, range long, strings binary, owners binary"

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        texts = column["bytes"].to_pylist()
        runs = column["run"].to_numpy().astype(np.int64)
        key, content = column["key"].to_numpy(), column["content"].to_numpy()
        parts = column["parts"].to_numpy()
        order, kind, twice, data, begins = repeated_starts(texts, runs)
        marks = np.zeros(len(data), bool)
        marks[order[twice[kind]]] = True
        segment, start, many = _runs_of(marks, begins, runs)
        found = pa.table({
            "key": key[segment], "content": content[segment], "start": start.astype(np.int32), "run": many.astype(np.int32),
            "part": np.full(len(segment), -1), "range": np.full(len(segment), -1),
            "strings": pa.nulls(len(segment), pa.binary()), "owners": pa.nulls(len(segment), pa.binary()),
        })
        if parts[0] < 2:
            return found
        # One string of each class, sorted by fingerprint and cut at the common bounds.
        part = int(column["part"].to_numpy()[0])
        one = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        place = order[one]
        owner = np.searchsorted(begins, place, "right") - 1
        sums = kit.prefix_hashes(data)
        print_ = kit.span_hashes(sums, place, place + LENGTH)
        by = np.argsort(print_, kind="stable")
        print_, owner, place = print_[by], owner[by], place[by] - begins[owner[by]]
        bounds = (np.arange(1, parts[0], dtype=np.float64) * (2.0**64 / parts[0])).astype(np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(print_, bounds), [len(print_)]])
        pieces = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            owners = np.stack([content[owner[a:b]], place[a:b]], axis=1)
            pieces.append((int(key[0]), 0, 0, 0, part, i, print_[a:b].tobytes(), owners.tobytes()))
        names = found.column_names
        return pa.concat_tables([found, pa.table({
            c: pa.array([x[k] for x in pieces], found.schema.field(c).type) for k, c in enumerate(names)}, schema=found.schema)])

    return segments.groupBy("shard", "part").applyInArrow(run, schema)


def _merge(pieces: DataFrame) -> DataFrame:
    """Strings of one range that several shards hold, as runs of starts."""
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        strings = [np.frombuffer(x, np.uint64) for x in table.column("strings").to_pylist()]
        owners = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("owners").to_pylist()]
        whole = np.sort(np.concatenate(strings))
        found = []
        for print_, owner in zip(strings, owners):
            times = np.searchsorted(whole, print_, "right") - np.searchsorted(whole, print_, "left")
            found.append(owner[times > 1])
        found = np.concatenate(found)
        n = len(found)
        return pa.table({
            "key": pa.array(np.full(n, key)), "content": pa.array(found[:, 0]), "start": pa.array(found[:, 1], pa.int32()),
            "run": pa.array(np.ones(n), pa.int32())})

    return pieces.groupBy("key", "range").applyInArrow(run, "key long, content long, start int, run int")


def _joined(starts: DataFrame) -> DataFrame:
    """Maximal removed runs of bytes of texts(h, n_bytes, starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            first, many = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            # Every row has places of its own, so no run reaches the next row.
            first += row << ROW_BITS
            order = np.argsort(first, kind="stable")
            first = first[order]
            reach = np.maximum.accumulate(first + many[order] + LENGTH_LESS)
            head = np.flatnonzero(np.append(True, first[1:] > reach[:-1])[: len(first)])
            end = reach[np.append(head[1:], len(first))[: len(head)] - 1]
            begin, place = first[head], (1 << ROW_BITS) - 1
            ends = np.append(0, np.cumsum(kit.row_counts(begin >> ROW_BITS, len(batch)))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(begin & place), pa.array(end & place)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), spans)], names=["h", "n_bytes", "spans"])

    return kit.map_arrow(starts, run, f"h long, n_bytes long, {SPANS}")


def _left(texts: DataFrame) -> DataFrame:
    """What is left of texts(h, n_bytes, text, spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(2), CHUNK_BYTES):
                spans = batch.column(3).slice(a, b - a)
                at = np.repeat(offsets[:-1], np.diff(spans.offsets.to_numpy()))
                first, end = (x.to_numpy() + at for x in spans.flatten().flatten())
                edges = np.bincount(first, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
                stays = np.cumsum(edges[:-1]) == 0
                ends = np.append(0, np.cumsum(stays))[offsets].astype(np.int64)
                kept = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(data[stays])])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in (0, 1)), spans, kept.cast(pa.binary())], names=["h", "n_bytes", "spans", "kept"])

    return kit.map_arrow(texts, run, f"h long, n_bytes long, {SPANS}, kept binary")


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, digest, removed runs and, where any are removed, the bytes left of every document."""
    text = kit.null_text(docs[text_column])
    docs = docs.select(docs[id_column].alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    known = kit.stage(_documents(docs, LENGTH), "segments")
    segments = known.select("h", "n_bytes", F.inline("segments"))
    keys = segments.groupBy("key").agg(F.sum("times").alias("all")).where("all > 1").select("key")
    open_ = kit.stage(segments.join(keys, "key").drop("all"), "open-segments")
    contents = kit.stage(open_.groupBy("key", "content", "run").agg(
        F.sum("times").alias("times"), F.min(F.struct("h", "n_bytes", "start")).alias("at")), "contents", narrow=True)
    sizes = contents.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("run") + LENGTH_LESS).alias("bytes")).where("kinds > 1")
    sizes = kit.stage(sizes, "anchors", narrow=True)
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes))
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") * 2 / shard_bytes)).cast("long")
    shard = F.when(F.col("bytes") <= shard_bytes, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("key"))
    placed = contents.join(sizes, "key").select(
        "at.h", "at.n_bytes", F.struct(
            F.col("at.start").alias("start"), "run", "key", "content", shard.alias("shard"),
            F.when(F.col("bytes") <= shard_bytes, -1).otherwise(F.pmod("content", parts)).cast("long").alias("part"),
            F.when(F.col("bytes") <= shard_bytes, 1).otherwise(parts).cast("long").alias("parts")).alias("segment"))
    wanted = placed.groupBy("h", "n_bytes").agg(F.collect_list("segment").alias("wanted"))
    candidates = open_.select("h", "n_bytes").distinct()
    # One text for each hash and length; copies are dropped before they are shuffled.
    single = docs.where(F.octet_length("text") >= LENGTH).groupBy("h", F.octet_length("text").cast("long").alias("n_bytes")).agg(
        F.first("text").alias("text"))
    texts = kit.stage(single.join(candidates, ["h", "n_bytes"], "left_semi").select("h", "n_bytes", "text"), "texts")
    cut = _cut(texts.join(wanted, ["h", "n_bytes"]).select("text", "wanted"))
    found = kit.stage(_search(cut), "repeats", narrow=True)
    local = found.where("part < 0").select("key", "content", "start", "run")
    merged = _merge(found.where("part >= 0").select("key", "range", "strings", "owners"))
    inner = local.unionByName(merged).select("key", "content", F.col("start").alias("from"), F.col("run").alias("many"))
    inside = open_.join(inner, ["key", "content"]).select("h", "n_bytes", (F.col("start") + F.col("from")).alias("start"), F.col("many").alias("run"))
    whole = open_.join(contents.where("times > 1").select("key", "content"), ["key", "content"]).select("h", "n_bytes", "start", "run")
    own = known.select("h", "n_bytes", F.inline("own"))
    starts = whole.unionByName(inside).unionByName(own).distinct().groupBy("h", "n_bytes").agg(F.collect_list(F.struct("start", "run")).alias("starts"))
    left = _left(texts.join(_joined(starts), ["h", "n_bytes"]).select("h", "n_bytes", "text", "spans"))
    left = kit.stage(left.withColumns({
        "n_removed": F.col("n_bytes") - F.octet_length("kept"), "n_spans": F.size("spans").cast("long"),
        "kept_sha256": F.sha2("kept", 256)}), "left")
    return known.select("doc_id", "h", "n_bytes", "sha").join(left, ["h", "n_bytes"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array()).alias("spans"), "kept")
