"""Near-duplicate detection by a signature-coordinate inverted join.

1. Every text becomes its set of word shingles, a digest of the set and a MinHash
   signature of ``COORDINATES`` values. Equal sets are one class from here on.
2. Classes are posted under each (coordinate, value). Values held by one class only
   are dropped. Two linked sets agree in ``needed(percent)`` coordinates but for a chance
   of at most ``MISS``, so they meet in each other's rarest values, all but needed - 1 of
   them (prefix filter), and a class with fewer shared values than needed has no link.
3. In every posting list, members are tried against the member whose values are most
   frequent, the centre of a group of copies. Collisions are counted over the whole
   signatures (the other lists are skipped), and what reaches the number needed is
   confirmed on the full sets. That gives at most a pair for each value in the prefix of
   a class, and one component for most groups, however large. Of several members with
   equally frequent values one can be far from the group, though. So members that stay
   outside the largest component of a list are tried against other members of it, one a
   list, in rounds, while rounds find links.
4. What may still be linked lies in lists with members of several components. These open
   classes are joined by the rarest of their shingles (prefix, size and place bounds on the
   full sets), without the pairs inside one component. Pairs that remain are counted and
   confirmed as before, so the rounds before decide how many pairs there are, never which
   documents are linked.

The similarity that links, ``percent``, is a parameter of the caller.

Links, components and lists stay in DataFrames. Steps end in written tables.

Null texts and texts without words have an empty set and no link. A text of fewer than
five words is one shingle. Equal sets are linked even if texts differ. Repeated rows
belong to one component; of equal ids each row counts as kept in the report, and
exactly one row of each component has ``first_row``. A null doc_id is larger than any
other. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit
from .graph import components

SHINGLE = 5
PERCENT = 85
COORDINATES = 48
MISS = 1e-9  # chance that a linked pair has fewer equal coordinates than needed
FEW_PAIRS = 64  # lists that can give so few pairs with their largest component go straight to the last step
LIKELY_MARGIN = 10  # rounds try pairs whose estimated similarity is at most so much below the percent that links
FRUITFUL = 50  # another round follows while one in so many pairs tried is a link

_ODD = kit.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = kit.mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))


def needed(percent: int) -> int:
    """Equal coordinates that sets of this similarity have but for a chance of at most MISS."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}, not in 1 to 100")
    s, missed = percent / 100, 0.0
    for k in range(COORDINATES):
        missed += comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)
        if missed > MISS:
            break
    if k < 1:
        raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {percent} percent")
    return k


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, rows ascending."""
    n = len(offsets) - 1
    data = kit.lower_ascii(data)
    starts, ends, rows = kit.word_spans(data, offsets, kit.WHITE_SPACE)
    words = kit.span_hashes(kit.prefix_hashes(data), starts, ends)
    count = kit.row_counts(rows, n)
    grams, whole = kit.shingles(words, rows, SHINGLE)
    row, found = [rows[: len(grams)][whole]], [grams[whole]]
    first = np.cumsum(count) - count
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        if len(short):
            grams, _ = kit.shingles(words, rows, size)
            row.append(short)
            found.append(kit.mix(grams[first[short]] + np.uint64(size)))
    row, found = np.concatenate(row), np.concatenate(found)
    salt = kit.mix(np.arange(1, n + 1, dtype=np.uint64))
    _, at = np.unique(found ^ salt[row], return_index=True)
    row, found = row[at], found[at]
    order = np.argsort(row, kind="stable")
    return row[order], found[order]


def signatures(row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a set, their signatures (rows x coordinates) and two 64-bit digests."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(first), COORDINATES), np.uint32)
    if len(first):
        for j in range(COORDINATES):
            out[:, j] = np.minimum.reduceat((((found ^ _FLIP[j]) * _ODD[j]) >> np.uint64(32)).astype(np.uint32), first)
        one, two = np.add.reduceat(kit.mix(found), first), np.add.reduceat(kit.mix(found ^ _FLIP[0]), first)
    else:
        one = two = np.zeros(0, np.uint64)
    return row[first], out, one, two


def _sketches(docs: DataFrame) -> DataFrame:
    schema = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(4)):
                n = b - a
                row, found = shingle_sets(data, offsets)
                have, sig, one, two = signatures(row, found)
                d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
                d1[have], d2[have] = one.view(np.int64), two.view(np.int64)
                width = np.zeros(n, np.int64)
                width[have] = COORDINATES
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(a, n) for i in range(4)], pa.array(kit.row_counts(row, n)), pa.array(d1), pa.array(d2),
                    kit.list_column(sig.view(np.int32).ravel(), width, pa.int32()),
                ], names=schema.names)

    return kit.map_arrow(docs.select("rid", "doc_id", "k1", "k2", "text"), run, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; texts(rid, text)."""
    left = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data_a, at_a = kit.column_bytes(batch.column(2))
            data_b, at_b = kit.column_bytes(batch.column(3))
            for i, j in kit.chunks(at_a + at_b):
                n = j - i
                row_a, set_a = shingle_sets(data_a[at_a[i] : at_a[j]], at_a[i : j + 1] - at_a[i])
                row_b, set_b = shingle_sets(data_b[at_b[i] : at_b[j]], at_b[i : j + 1] - at_b[i])
                salt = kit.mix(np.arange(1, n + 1, dtype=np.uint64))
                _, later = kit.repeated(np.concatenate([set_a ^ salt[row_a], set_b ^ salt[row_b]]))
                common = kit.row_counts(np.concatenate([row_a, row_b])[later], n)
                union = kit.row_counts(row_a, n) + kit.row_counts(row_b, n) - common
                good = pa.array((100 * common >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, n).filter(good) for k in (0, 1)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return kit.map_arrow(joined, run, "a long, b long")


def _colliding(pairs: DataFrame, suspects: DataFrame, least: int) -> DataFrame:
    """Pairs that agree in at least ``least`` coordinates of their whole signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().reshape(-1, COORDINATES) for i in (2, 3))
            good = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], names=["a", "b"])

    left = suspects.select(F.col("rid").alias("a"), F.col("sig").alias("sig_a"))
    right = suspects.select(F.col("rid").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return kit.map_arrow(both, run, "a long, b long")


def _suspects(classes: DataFrame, percent: int) -> DataFrame:
    """Classes that share enough values, with their rarest shared values and their weight as a centre."""
    least = needed(percent)
    value = F.posexplode("sig").alias("at", "value")
    posts = classes.select("rid", value).select(
        "rid", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    held = posts.join(lists, "key").groupBy("rid").agg(
        F.collect_list(F.struct("members", "key")).alias("held"), F.sum("members").alias("weight"))
    held = held.where(F.size("held") >= least)
    # Values of its own come before all others in a class's order of rarity.
    prefix = F.slice(F.array_sort("held"), F.lit(1), F.size("held") - F.lit(least - 1))
    held = held.select("rid", "weight", F.transform(prefix, lambda x: x["key"]).alias("keys"))
    return classes.join(held, "rid").select("rid", "k1", "k2", "n", "sig", "weight", "keys")


def _stars(suspects: DataFrame) -> DataFrame:
    """Each member of a posting list with the list's heaviest member."""
    posts = suspects.select("rid", "weight", F.explode("keys").alias("key"))
    centre = posts.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rid")).alias("minus"))).alias("c"))
    centre = centre.select("key", (-F.col("c.minus")).alias("centre"))
    pairs = posts.join(centre, "key").where("rid <> centre")
    return pairs.select(F.greatest("rid", "centre").alias("a"), F.least("rid", "centre").alias("b")).distinct()


def _open_posts(suspects: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, root, key) of the posting lists with members of several components."""
    labelled = suspects.join(components(links).withColumnRenamed("node", "rid"), "rid", "left").select(
        "rid", F.coalesce("root", "rid").alias("root"), F.explode("keys").alias("key"))
    several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return labelled.join(several.select("key"), "key").select("rid", "root", "key")


def _further_stars(posts: DataFrame, turn: int) -> DataFrame:
    """Members of open lists outside the list's largest component, each with a member of that component.

    The member changes with the list and the turn. Members are counted per list and component first.
    """
    order = F.struct(F.xxhash64("key", "rid", F.lit(turn)).alias("h"), "rid")
    parts = posts.groupBy("key", "root").agg(F.count("*").alias("members"), F.max(order).alias("pick"))
    main = parts.groupBy("key").agg(F.sum("members").alias("length"), F.max(F.struct("members", "root", "pick")).alias("c"))
    members = F.col("c.members")
    main = main.where((F.col("length") - members) * members > FEW_PAIRS).select("key", F.col("c.root").alias("main"), F.col("c.pick.rid").alias("centre"))
    pairs = posts.join(main, "key").where("root <> main")
    return pairs.select(F.greatest("rid", "centre").alias("a"), F.least("rid", "centre").alias("b")).distinct()


def _linked_by_stars(suspects: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs tried, links among them, and (rid, root) of the classes that are still open."""
    tried = kit.stage(_colliding(_stars(suspects), suspects, needed(percent)), "stars", narrow=True)
    links = kit.stage(_confirmed(tried, texts, percent), "star-links", narrow=True)
    posts = kit.stage(_open_posts(suspects, links), "open", narrow=True)
    likely = max(needed(percent), COORDINATES * (percent - LIKELY_MARGIN) // 100)
    turn, fruitful = 0, True
    while fruitful:
        turn += 1
        fresh = _further_stars(posts, turn).join(tried, ["a", "b"], "left_anti")
        more = kit.stage(_colliding(fresh, suspects, likely), "stars", narrow=True)
        found = kit.stage(_confirmed(more, texts, percent), "star-links", narrow=True)
        n_tried, n_found = more.count(), found.count()
        tried = tried.unionByName(more)
        if n_found:
            links = links.unionByName(found)
            posts = kit.stage(_open_posts(suspects, links), "open", narrow=True)
        fruitful = n_found * FRUITFUL > n_tried
    return tried, links, posts.select("rid", "root").distinct()


def _probes(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of open classes of different components whose full sets may be similar enough.

    Shingles are ordered by rarity among the open classes, those of one component first.
    The first shingle two sets share stands in both so early that the rest can still make
    up the overlap. Members of a list's largest component are met, but do not probe.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(2)):
                row, found = shingle_sets(data, offsets)
                count = kit.row_counts(row, b - a)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count),
                    kit.list_column(found.view(np.int64), count, pa.int64()),
                ], names=["rid", "root", "n", "shingles"])

    rows = kit.map_arrow(texts.join(open_, "rid").select("rid", "root", "text"), run, "rid long, root long, n long, shingles array<long>")
    held = rows.select("rid", "root", "n", F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(
        F.count("*").alias("times"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    kept = held.join(common.select("shingle", "times"), "shingle").groupBy("rid", "root", "n").agg(
        F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("ranked"))
    # Shingles of one component come first and cannot meet; the rest follows by rarity.
    alone = F.col("n") - F.size("ranked")
    last = F.col("n") - F.ceil(F.col("n") * percent / 100 - F.lit(1e-6))
    posts = kept.withColumn("alone", alone).where(F.col("alone") <= last).select(
        "rid", "root", "n", "alone", F.posexplode(F.slice("ranked", F.lit(1), (last - F.col("alone") + 1).cast("int"))).alias("at", "s"))
    posts = kit.stage(posts.select("rid", "root", "n", (F.col("alone") + F.col("at")).alias("place"), F.col("s.shingle").alias("shingle")), "prefixes", narrow=True)
    lists = posts.groupBy("shingle", "root").agg(F.count("*").alias("members")).groupBy("shingle").agg(
        F.count("*").alias("parts"), F.max(F.struct("members", "root")).alias("most")).where("parts > 1")
    probes = posts.join(lists.select("shingle", F.col("most.root").alias("main")), "shingle").where("root <> main").select(
        "shingle", F.col("rid").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("x_n"), F.col("place").alias("x_place"))
    overlap = F.ceil((F.col("n") + F.col("x_n")) * percent / (100 + percent) - F.lit(1e-6))
    met = probes.join(posts, "shingle").where("root <> x_root").where(
        (F.col("x_place") <= F.col("x_n") - overlap) & (F.col("place") <= F.col("n") - overlap))
    return met.select(F.greatest("x", "rid").alias("a"), F.least("x", "rid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, first_row, and the row's keys.

    Sets with a Jaccard similarity of ``percent`` in a hundred or more are linked.
    """
    docs = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    keyed = docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id")})
    sketches = kit.stage(_sketches(keyed.withColumn("rid", F.monotonically_increasing_id())), "sketches")
    classes = sketches.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("rid").alias("rep"))
    classes = kit.stage(classes, "classes", narrow=True)
    reps = sketches.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    suspects = kit.stage(_suspects(reps, percent), "suspects", narrow=True)
    keys = suspects.select("rid", "k1", "k2")
    texts = kit.stage(keyed.join(keys, ["k1", "k2"]).select("rid", "text").dropDuplicates(["rid"]), "texts")
    tried, links, open_ = _linked_by_stars(suspects, texts, percent)
    open_ = kit.stage(open_, "open-classes", narrow=True)
    probes = kit.stage(_colliding(_probes(open_, texts, percent).join(tried, ["a", "b"], "left_anti"), suspects, needed(percent)), "probes", narrow=True)
    links = links.unionByName(_confirmed(probes, texts, percent))
    roots = components(links)
    labelled = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "d1", "d2", F.coalesce("root", "rep").alias("root"))
    empty = sketches.where("n = 0").withColumn("root", F.col("rid"))
    rows = sketches.where("n > 0").join(labelled, ["n", "d1", "d2"]).select("rid", "doc_id", "k1", "k2", "n", "root").unionByName(
        empty.select("rid", "doc_id", "k1", "k2", "n", "root"))
    rows = kit.stage(rows, "labelled", narrow=True)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    return rows.join(first, "root").select(
        "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"), (F.col("rid") == F.col("first.rid")).alias("first_row"), "rid")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component; texts without words stay."""
    # Names that no column of the caller has.
    key = "k" * (max(map(len, docs.columns)) + 1)
    names = [f"{key}1", f"{key}2"]
    keys = {names[0]: F.xxhash64(docs[id_column], docs[text_column]), names[1]: F.xxhash64(docs[text_column], docs[id_column])}
    kept = near_duplicates(docs, id_column, text_column, percent).where("first_row and n_shingles > 0").select(
        F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    rows = docs.withColumns(keys).join(kept, names, "left_semi")
    # Rows equal in id and text have equal keys: one stays, and all of those without words.
    some = rows.where(_has_word(F.col(text_column))).dropDuplicates(names)
    return some.unionByName(docs.withColumns(keys).where(~_has_word(docs[text_column]))).drop(*names)


def _has_word(text: Column) -> Column:
    return F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
