"""Graph tables and document files on shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph as gr
from ..session import stage, stored


def write_json(docs: DataFrame, path: str) -> None:
    """One folder per document id, one JSON object per line, accents kept."""
    docs.write.mode("overwrite").partitionBy("doc_id").json(path)


def write_markdown(docs: DataFrame, path: str | None) -> None:
    """Refined text, one folder per document; nothing happens without a path."""
    if path:
        docs.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").option(
            "lineSep", "\n"
        ).text(path)


def _replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Rewrite only the partitions present in ``df``; the job commits all at once."""
    # Rows of one partition value stay spread over tasks: no repartition by it.
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _replace_folders(df: DataFrame, path: str, kind: str, key: str) -> None:
    """Rewrite the folders (``kind`` and bucket of ``key``) present in ``df``, all at once.

    The rows are written aside and counted first: a folder is one file, a folder with many
    rows as many as it needs, each dealt to its own task.
    """
    folder = [kind, "bucket"]
    rows = stage(df.withColumn("bucket", bucket_of(key)), "merged")
    # One row a folder.
    files = rows.groupBy(*folder).agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
    dealt = rows.join(F.broadcast(files), folder).withColumn("file", F.pmod(F.xxhash64(key), F.col("files")))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(tasks, *folder, "file").drop("file", "files").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*folder).parquet(path)


NODE_TABLE = "id string, props map<string,string>, label string"
EDGE_TABLE = "source string, target string, props map<string,string>, type string"
# Folders of one label or type. Changing it needs a new table.
BUCKETS = 32
# Rows of a file; a folder with more is written by several tasks.
FILE_ROWS = 1_000_000


def bucket_of(id_column: str) -> Column:
    """The folder of an id, from its part before the first underscore.

    The parts of a regulation begin with its own id, so a document's rows share a folder of
    each label: storing it again rewrites few folders, whatever the table's size.
    """
    return F.pmod(F.xxhash64(F.substring_index(id_column, "_", 1)), F.lit(BUCKETS)).cast("int")


def buckets_of(ids: DataFrame, *columns: str) -> list[int]:
    """The folders of all ids in some columns: at most ``BUCKETS`` numbers."""
    every = ids.select(F.explode(F.array(*[bucket_of(c) for c in columns])).alias("b"))
    return [r[0] for r in every.where("b is not null").distinct().collect()]


def _rows(spark: SparkSession, path: str, table: str, buckets: list[int] | None) -> DataFrame:
    """Stored rows that are not removed, with their bucket; a list of buckets prunes folders."""
    rows = stored(spark, path, f"{table}, bucket int").where("props is not null")
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def read_nodes(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Stored nodes; a filter on ``label`` prunes folders. Removed ones do not show.

    With ``ids(id)`` only the folders that can hold these ids are read.
    """
    return _rows(spark, path, NODE_TABLE, None if ids is None else buckets_of(ids, "id")).drop("bucket")


def read_edges(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """Stored edges; with ``sources(id)`` only of the folders that can hold edges from these ids."""
    return _rows(spark, path, EDGE_TABLE, None if sources is None else buckets_of(sources, "id")).drop("bucket")


def _touched(existing: DataFrame, incoming: DataFrame, *columns: str) -> DataFrame:
    return existing.join(incoming.select(*columns).distinct(), list(columns), "left_semi")


def _versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows are version 0, incoming ones come later in their own order."""
    old = existing.withColumns({"gen": F.lit(0), "doc_id": F.lit(""), "seq": F.array().cast("array<bigint>")})
    new = incoming.withColumn("gen", F.lit(1)).withColumn("doc_id", F.col("doc_id").cast("string"))
    return old.unionByName(new.select(*old.columns))


VERSION = ("gen", "doc_id", "seq")


def _with_removed(merged: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Removed rows stay as marks without properties, so that their folder is rewritten too.

    Readers leave marks out; the next rewrite of the folder drops them.
    """
    marks = removed.select(*keys).join(merged.select(*keys), keys, "left_anti")
    return merged.unionByName(marks.withColumn("props", F.lit(None).cast("map<string,string>")))


def upsert_nodes(nodes: DataFrame, path: str, replaced: DataFrame | None = None) -> None:
    """Merge ``nodes(label, id, text, props, doc_id, seq)`` into the table at ``path``.

    Stored nodes whose id is in ``replaced(id)`` are removed first.

    Only the folders (label and bucket) of the ids in ``nodes`` and ``replaced`` are read and
    rewritten. ``nodes`` is read several times, so give a written table where it is costly to
    compute.
    """
    spark, folder = nodes.sparkSession, ("label", "bucket")
    incoming = gr.unify_nodes(nodes).withColumn("bucket", bucket_of("id"))
    ids = incoming.select("id") if replaced is None else incoming.select("id").unionByName(replaced.select("id"))
    rows = _rows(spark, path, NODE_TABLE, buckets_of(ids, "id"))
    if replaced is None:
        merged = gr.upsert_nodes(_versions(_touched(rows, incoming, *folder), incoming), VERSION)
    else:
        removed = rows.join(replaced, "id", "left_semi")
        touched = incoming.select(*folder).unionByName(removed.select(*folder))
        kept = _touched(rows, touched, *folder).join(replaced, "id", "left_anti")
        merged = _with_removed(gr.upsert_nodes(_versions(kept, incoming), VERSION), removed, ["label", "id"])
    _replace_folders(merged, path, "label", "id")


ROUTES = "target_bucket int, bucket int"


def _add_routes(edges: DataFrame, path: str) -> None:
    """Remember from which folders edges lead into which: at most BUCKETS * BUCKETS rows a table."""
    known = stored(edges.sparkSession, f"{path}_routes", ROUTES)
    new = edges.select(bucket_of("target").alias("target_bucket"), bucket_of("source").alias("bucket")).distinct()
    new.join(known.distinct(), ["target_bucket", "bucket"], "left_anti").coalesce(1).write.mode("append").parquet(f"{path}_routes")


def upsert_edges(edges: DataFrame, path: str, nodes: DataFrame | None = None, replaced: DataFrame | None = None,
                 nodes_path: str | None = None) -> None:
    """Merge ``edges(source, type, target, props, doc_id, seq)`` into the table at ``path``.

    Stored edges that touch an id of ``replaced(id)`` are removed first.
    With ``nodes``, or ``nodes_path`` of a stored table, edges whose ends do not both exist
    are left out first; of a stored table only the folders of these ends are read.

    Edges lie in the folder (type and bucket) of their source. Edges that lead into replaced
    ids are found through the routes between folders, so neither step reads the whole table.
    """
    spark, folder = edges.sparkSession, ("type", "bucket")
    incoming = edges
    if nodes_path is not None:
        nodes = _rows(spark, nodes_path, NODE_TABLE, buckets_of(edges, "source", "target"))
    if nodes is not None:
        ids = nodes.select("id").distinct()
        incoming = incoming.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
            ids.withColumnRenamed("id", "target"), "target", "left_semi"
        )
    incoming = incoming.withColumns({
        "type": F.coalesce("type", F.lit(gr.DEFAULT_RELATION)), "bucket": bucket_of("source"),
    })
    buckets = set(buckets_of(edges, "source"))
    if replaced is not None:
        targets = buckets_of(replaced, "id")
        routes = stored(spark, f"{path}_routes", ROUTES).where(F.col("target_bucket").isin(targets))
        buckets |= {*targets, *(r[0] for r in routes.select("bucket").distinct().collect())}
    _add_routes(edges.where("source <> '' and target <> ''"), path)
    rows = _rows(spark, path, EDGE_TABLE, sorted(buckets))
    if replaced is None:
        merged = gr.upsert_edges(_versions(_touched(rows, incoming, *folder), incoming), VERSION)
    else:
        kept = rows
        for end in ("source", "target"):
            kept = kept.join(replaced.withColumnRenamed("id", end), end, "left_anti")
        keys = ["source", "type", "target"]
        removed = rows.join(kept.select(*keys), keys, "left_anti")
        touched = incoming.select(*folder).unionByName(removed.select(*folder))
        merged = _with_removed(
            gr.upsert_edges(_versions(_touched(kept, touched, *folder), incoming), VERSION), removed, keys
        )
    _replace_folders(merged, path, "type", "source")


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """Leave an empty table of the same schema."""
    column = T._parse_datatype_string(schema).names[-1]
    empty = spark.createDataFrame([], T._parse_datatype_string(schema))
    empty.drop(column).write.mode("overwrite").parquet(path)


def replace_documents(rows: DataFrame, path: str) -> None:
    """Rewrite the documents present in ``rows`` (by ``doc_id``), leave the others."""
    _replace_partitions(rows, path, "doc_id")


def table_corpus(stored: DataFrame) -> DataFrame:
    """``(id, text, vector)`` of the stored nodes that have a vector."""
    vector = F.from_json(F.col("props")["embedding"], "array<float>")
    return stored.where(F.col("props")["embedding"].isNotNull()).select(
        "id", F.col("props")["text"].alias("text"), vector.alias("vector")
    )


def table_nodes(stored: DataFrame) -> DataFrame:
    """Stored nodes with the text as a column again."""
    return stored.select("label", "id", F.col("props")["text"].alias("text"), "props")
