"""Which names contain which texts, without comparing every pair.

A name that contains a text also contains each of its short character runs. So names are
indexed by their runs, each text is looked up by its rarest run only, and the hits are
checked against the names as they are. The result equals the full comparison.

The index is a stored table of postings ``(gram, id)`` dealt into folders by the gram's
hash, with the number of postings of each gram beside it. It is kept by appending the names
of touched ids: a posting of a name that an id no longer has costs one check and changes no
result, because every hit is checked. A lookup reads only the folders of the grams its
texts hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, stage, stored, work_folder

GRAM = 3
BUCKETS = 16
# Tasks that share the postings of one folder, so that a frequent gram is no single task.
SALTS = 4

POSTINGS = "gram string, id {id}, batch string, bucket int"
COUNTS = "gram string, hits bigint, batch string"


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of a length; the empty run is in every text."""
    size = F.lit(size) if isinstance(size, int) else size
    count = F.length(text) - size + 1
    at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    runs = F.when(size == 0, F.array(F.lit(""))).otherwise(F.transform(at, lambda i: F.substr(text, i, size)))
    return F.array_distinct(runs)


def _bucket(gram: Column | str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


# --- the stored index ---------------------------------------------------------------


def append_names(names: DataFrame, path: str, batch: str) -> None:
    """Add the runs of ``names(id, name)`` to the index at ``path``.

    A repeated ``batch`` replaces its own folders. Null names are left out.
    """
    spark = names.sparkSession
    named = spread(names.where("name is not null"), "id")
    postings = named.select("id", F.explode(_grams(F.lower("name"), GRAM)).alias("gram"))
    dealt = postings.withColumn("bucket", _bucket("gram")).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    folder = f"{path}/postings/batch={batch}"
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = stored(spark, folder, f"gram string, id {names.schema['id'].dataType.simpleString()}, bucket int")
    written.groupBy("gram").agg(F.count("*").alias("hits")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")


def look_up_names(needles: DataFrame, names: DataFrame, path: str) -> DataFrame:
    """``needles(needle)`` and the current ``names(id, name)`` to pairs ``(needle, id, name)``.

    The index at ``path`` must have seen every current name; it may hold older ones too.
    Texts shorter than a run are compared through an index of their own lengths.
    """
    spark = names.sparkSession
    texts = stage(needles.where("needle is not null").select("needle", F.lower("needle").alias("n")).distinct(), "needles")
    kinds = texts.groupBy(F.length("n") < GRAM).count().collect()
    long = any(not r[0] for r in kinds)
    parts = []
    if long or not kinds:
        wanted = texts.where(F.length("n") >= GRAM).select("needle", "n", F.explode(_grams(F.col("n"), GRAM)).alias("gram"))
        # At most BUCKETS numbers: the folders to read.
        folders = [r[0] for r in wanted.select(_bucket("gram")).distinct().collect()]
        id_type = names.schema["id"].dataType.simpleString()
        postings = stored(spark, f"{path}/postings", POSTINGS.format(id=id_type)).where(F.col("bucket").isin(folders))
        counts = stored(spark, f"{path}/counts", COUNTS).groupBy("gram").agg(F.sum("hits").alias("hits"))
        # A name that was sent twice has its postings twice.
        parts.append(_checked(_rarest(wanted, counts), postings, names).distinct())
    if any(r[0] for r in kinds):
        parts.append(_compare(texts.where(F.length("n") < GRAM), names))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _rarest(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """``(needle, n, gram)``: of each text the run that fewest names hold.

    A run that no name has rules its text out: it must be chosen, so it counts 0. The result
    is written, so that its size is known before the postings are joined.
    """
    return stage(
        wanted.join(counts, "gram", "left")
        .groupBy("needle", "n")
        .agg(F.min_by("gram", F.struct(F.coalesce("hits", F.lit(0)), "gram")).alias("gram")),
        "rarest",
    )


def _checked(rarest: DataFrame, postings: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs ``(needle, id, name)`` of written ``rarest(needle, n, gram)`` and the names that hold their texts.

    Texts times hits are many more than names, so they are never shuffled: the postings of the
    asked runs fetch their names first, are dealt by id, and meet the texts where they are checked.
    """
    lower = names.select("id", "name", F.lower("name").alias("l"))
    hits = postings.select("gram", "id").join(rarest.select("gram"), "gram", "left_semi")
    found = spread(hits, "id").join(lower, "id").join(rarest, "gram")
    return found.where(F.contains("l", F.col("n"))).select("needle", "id", "name")


# --- without a stored index ---------------------------------------------------------


def _compare(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of written ``texts(needle, n)`` and names, by runs of the asked lengths only."""
    size = F.least(F.length("n"), F.lit(GRAM))
    wanted = texts.select("needle", "n", F.explode(_grams(F.col("n"), size)).alias("gram"))
    # There are at most four lengths.
    sizes = sorted(r[0] for r in texts.select(size).distinct().collect())
    named = spread(names.where("name is not null"), "id")
    cut = named.select(
        "id", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.lower("name"), s) for s in sizes])))).alias("gram")
    ) if sizes else names.select("id", F.lit("").alias("gram")).limit(0)
    # Only runs that some text asks for are written, once for counting and finding.
    postings = stage(cut.join(wanted.select("gram").distinct(), "gram", "left_semi").distinct(), "postings")
    counts = postings.groupBy("gram").agg(F.count("*").alias("hits"))
    return _checked(_rarest(wanted, counts), postings, names)


def contains_join(needles: DataFrame, names: DataFrame) -> DataFrame:
    """``needles(needle)`` and ``names(id, name)`` to pairs ``(needle, id, name)``.

    Comparison ignores case and keeps accents. Texts shorter than three characters are
    looked up by runs of their own length. Null texts and names match nothing. The postings
    are written when it is called; the lookup is lazy.
    """
    texts = stage(needles.where("needle is not null").select("needle", F.lower("needle").alias("n")).distinct(), "needles")
    return _compare(texts, names)


def new_index(spark: SparkSession, names: DataFrame) -> str:
    """A new index of ``names(id, name)`` in the working folder; its path."""
    path = work_folder(spark, "names")
    append_names(names, path, "0")
    return path
