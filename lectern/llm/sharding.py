"""Sharding by extendible hashing.

Documents are placed by the bits of a hash. The directory starts with one bucket of
zero bits; only buckets above the byte limit split on one more bit, so every shard is
named by a bit prefix and fits the limit. Sizes of prefixes are sums over a histogram
of some more bits than the expected depth; buckets that are still too large there go
into another round of more bits, alone. The directory is a DataFrame: it is joined to
the documents and never collected.

The hash covers doc_id and text; rows equal in both differ in the bits of a row number
that follow, so a group of repeated rows can split too. A document above the limit gets
a shard of its own and is marked ``oversized``. Null texts have 0 bytes. An empty table
gives no shards. Only the named columns are read; the others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

SHARD_BYTES = 1 << 20
MARGIN_BITS = 6
ROUND_BITS = 10
STEP_BITS = 6  # levels that one pass over the sizes of prefixes adds up
HASH_BITS = 60


def _bits(hex_digits: Column) -> Column:
    """Sixty bits, as text, of a hexadecimal hash."""
    return F.lpad(F.conv(F.substring(hex_digits, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def shard(
    docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all if None) under ``row`` with shard, depth, bytes, shard_bytes and oversized."""
    text = kit.null_text(docs[text_column])
    first = F.md5(F.concat_ws("|", docs[id_column].cast("string"), F.md5(text.cast("binary"))).cast("binary"))
    second = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    keyed = kit.stage(docs.select(
        F.concat(_bits(first), _bits(second)).alias("bits"), F.octet_length(text).cast("long").alias("bytes"),
        F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"),
    ), "shards")
    total, rows = keyed.agg(F.sum("bytes"), F.count("*")).first()
    depth = max(0, (total or 0) // shard_bytes).bit_length() + MARGIN_BITS
    low, directory, open_ = 0, None, keyed.select("bits", "bytes")
    while rows:
        found = _directory(open_, low, depth, shard_bytes)
        leaves = kit.stage(found, "directory", narrow=True)
        settled = leaves.where("shard is not null")
        directory = settled if directory is None else directory.unionByName(settled)
        rest = leaves.where("shard is null").select(F.col("bucket").alias("wide"))
        if depth == 2 * HASH_BITS or rest.isEmpty():
            break
        open_ = open_.join(rest, F.substring("bits", 1, depth) == F.col("wide"), "left_semi")
        low, depth = depth + 1, min(2 * HASH_BITS, depth + ROUND_BITS)
        if low > HASH_BITS:
            depth = 2 * HASH_BITS
    if directory is None:
        return keyed.select(F.lit("").alias("shard"), F.lit(0).alias("depth"), "bytes", F.lit(0).cast("long").alias("shard_bytes"), F.lit(False).alias("oversized"), "row")
    widths = sorted(r[0] for r in directory.select(F.length("bucket")).distinct().collect())
    placed = None
    for width in widths:
        part = directory.where(F.length("bucket") == width)
        joined = keyed.join(part, F.substring("bits", 1, width) == F.col("bucket"))
        placed = joined if placed is None else placed.unionByName(joined)
    return placed.select("shard", F.length("shard").alias("depth"), "bytes", "shard_bytes", (F.col("shard_bytes") > shard_bytes).alias("oversized"), "row")


def _prefix_sums(buckets: DataFrame, low: int, depth: int) -> DataFrame:
    """(prefix, size, docs) of every prefix of ``low`` to ``depth`` bits that has documents.

    Some levels at a time, from the longest prefixes up: the shortest of one step are the
    rows of the next, so a bucket is not repeated for every level.
    """
    rows, sums = buckets.select(F.col("bucket").alias("prefix"), F.col("bytes").alias("size"), F.col("n").alias("docs")), None
    while depth >= low:
        top = max(low, depth - STEP_BITS + 1)
        levels = F.explode(F.transform(F.sequence(F.lit(top), F.lit(depth)), lambda d: F.substring("prefix", 1, d)))
        step = kit.stage(rows.select(levels.alias("prefix"), "size", "docs").groupBy("prefix").agg(
            F.sum("size").alias("size"), F.sum("docs").alias("docs")), "prefixes", narrow=True)
        sums = step if sums is None else sums.unionByName(step)
        rows = step.where(F.length("prefix") == top).withColumn("prefix", F.substring("prefix", 1, top - 1))
        depth = top - 1
    return sums


def _directory(rows: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """bucket (``depth`` bits) with its shard: the shortest prefix, from ``low`` bits on, that fits.

    A shard is a prefix that fits although its parent, one bit shorter, does not. Each prefix
    asks for its own parent only, and each bucket for its own shard: no key of these joins has
    more rows than two children, or the buckets of one shard.
    """
    buckets = kit.stage(rows.groupBy(F.substring("bits", 1, depth).alias("bucket")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "buckets", narrow=True)
    sums = _prefix_sums(buckets, low, depth)
    fits = (F.col("size") <= limit) | (F.col("docs") == 1)
    length = F.length("prefix")
    # Prefixes at the lowest level come from parents that were found too large before.
    split = sums.where(~fits).select(F.col("prefix").alias("parent"))
    children = sums.where(fits & (length > low)).withColumn("parent", F.substring("prefix", 1, length - 1))
    leaves = kit.stage(children.join(split, "parent").drop("parent").unionByName(sums.where(fits & (length == low))), "leaves", narrow=True)
    found = leaves.where("false").select("prefix", "size", F.col("prefix").alias("bucket"), F.col("size").alias("bytes"), F.col("docs").alias("n"))
    for (width,) in sorted(leaves.select(F.length("prefix")).distinct().collect()):
        here = leaves.where(length == width).select("prefix", "size")
        found = found.unionByName(buckets.join(here, F.substring("bucket", 1, width) == F.col("prefix")))
    named = found.select("bucket", F.col("prefix").alias("shard"), F.col("size").alias("shard_bytes"))
    return buckets.select("bucket").join(named, "bucket", "left")


def shard_report(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, shard, depth, bytes, shard_bytes, oversized of every document."""
    return shard(docs, shard_bytes, keep=["doc_id"]).select(
        "row.doc_id", "shard", "depth", "bytes", "shard_bytes", "oversized")


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the documents, one folder per shard; each shard is written by one task."""
    placed = shard(docs, shard_bytes)
    placed.select("shard", "row.*").repartition(F.col("shard")).write.partitionBy("shard").parquet(folder)
