"""Uploads and questions as streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import graph as gr
from ..operators import vectors as ve
from ..operators.contains import append_names
from ..plans import ingestion as ing
from ..plans import retrieval as ret
from ..sources import readers, writers


def ingest_batch(batch: DataFrame, batch_id: int, out: str,
                 pipelines: Mapping[str, ing.Pipeline] = ing.PIPELINES, model=None,
                 candidates: tuple[str, ...] = ()) -> None:
    """Process one micro-batch of ``(doc_id, file_name, category, size, text, arrived[, job_id, table_rows])``.

    ``candidates`` names columns with the texts of several extractors, best first: the first
    that is not blank becomes the text, and its name the job's extraction source.

    ``model`` is a ``vectors.TextModel``: the texts of nodes that it has not embedded before get
    their vectors in the table ``vectors``, by the text's hash. Given as a loader and its number of
    dimensions, nodes are stored with their vectors in the properties instead.

    A job is one upload: without ``job_id`` the document's id names it. That it waits and
    runs is recorded before the work, how it ended after it; events are ordered by batch
    and step. A document stored before is replaced as a whole.

    Graph tables are merged, so a repeated batch changes nothing; the job events
    of a batch overwrite their own folder for the same reason. A document that is refused,
    blank, or raises in a pipeline made by ``ingestion.guarded`` is recorded as failed with
    its message and does not stop the others.
    """
    spark = batch.sparkSession
    # The batch is read by several writes; a written copy keeps them the same.
    staged = f"{out}/staged/batch_id={batch_id}"
    refused = readers.rejection(F.col("file_name"), F.col("category"), F.col("size"))
    if candidates:
        text, source = tx.first_nonblank([(c, F.col(c)) for c in candidates])
        batch = batch.withColumns({"text": text, "extraction_source": source}).drop(*(c for c in candidates if c != "text"))
    elif "extraction_source" not in batch.columns:
        batch = batch.withColumn("extraction_source", F.lit(None).cast("string"))
    batch.withColumn("error", F.coalesce(refused, ing.failure(batch))).write.mode("overwrite").parquet(staged)
    docs = spark.read.parquet(staged)
    if "job_id" not in docs.columns:
        docs = docs.withColumn("job_id", F.col("doc_id").cast("string"))
    good = docs.where("error is null")
    none = F.lit(None).cast("bigint")
    _record(docs.withColumns({"nodes": none, "edges": none, "section_count": none}), ("queued", "processing"), 0, batch_id, out, pipelines)

    # Texts are parsed once for nodes and once for edges; merges and counts read the rows.
    submitted = []
    *graph, failed = ing.run_guarded(good, pipelines)
    for name, rows in zip(("nodes", "edges"), graph):
        if name == "nodes" and isinstance(model, tuple):
            rows = ing.with_vectors(rows, *model)
        path = f"{out}/submitted/{name}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        submitted.append(spark.read.schema(rows.schema).parquet(path))
    nodes, edges = submitted
    path = f"{out}/replaced/batch_id={batch_id}"
    below = lambda ids: writers.read_edges(spark, f"{out}/edges", ids)
    gr.descendants(ing.replaced_roots(nodes), below).write.mode("overwrite").parquet(path)
    replaced = spark.read.schema("id string").parquet(path)
    writers.upsert_nodes(nodes, f"{out}/nodes", replaced)
    writers.upsert_edges(edges, f"{out}/edges", replaced=replaced, nodes_path=f"{out}/nodes")
    append_names(ret.courses_of(nodes), f"{out}/names", str(batch_id))
    if isinstance(model, ve.TextModel):
        ve.embed_missing(nodes.select("text"), f"{out}/vectors", model, str(batch_id))

    per_doc = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    done = docs.withColumn("doc_id", F.col("doc_id").cast("string")).join(
        per_doc(nodes, "nodes"), "doc_id", "left"
    ).join(per_doc(edges, "edges"), "doc_id", "left").join(
        ing.section_counts(good, nodes), "doc_id", "left"
    ).join(failed.withColumnRenamed("error", "raised"), "doc_id", "left")
    applied = ing.has_pipeline(F.col("category"), pipelines)
    empty = applied & F.col("nodes").isNull()
    done = done.withColumn("error", F.coalesce("error", "raised", F.when(empty, F.lit(ing.NO_NODES)))).drop("raised")
    _record(done, (None,), 2, batch_id, out, pipelines)


def _record(jobs: DataFrame, states: tuple[str | None, ...], first_step: int, batch_id: int, out: str,
            pipelines: Mapping[str, ing.Pipeline]) -> None:
    """Write the events of some steps of all jobs of a batch; the last state depends on the error."""
    applied, fine = ing.has_pipeline(F.col("category"), pipelines), F.col("error").isNull()
    ended = F.when(fine, F.lit("completed")).otherwise(F.lit("failed"))
    steps = F.array(*[ended if s is None else F.lit(s) for s in states])
    last = F.lit(states[-1] is None)
    events = jobs.select("*", F.posexplode(steps).alias("at_step", "status")).withColumn(
        "step", F.col("at_step") + first_step
    ).select(
        F.col("job_id").cast("string").alias("job_id"),
        # Three steps a batch: the order of batches, then of steps.
        (F.lit(batch_id) * 3 + F.col("step")).cast("bigint").alias("event_seq"),
        "status",
        F.when(F.col("step") == 0, F.col("arrived")).otherwise(F.current_timestamp()).alias("at"),
        F.col("file_name").alias("filename"), "category", "size",
        F.when(last & fine, applied).alias("ingestion_applied"),
        F.when(last & applied & fine, F.coalesce("nodes", F.lit(0))).alias("nodes"),
        F.when(last & applied & fine, F.coalesce("edges", F.lit(0))).alias("edges"),
        F.when(last, F.col("error")).alias("error"),
        F.when(last & fine, F.length("text")).alias("extracted_text_length"),
        F.when(last & fine, tx.preview(F.col("text"))).alias("extracted_preview"),
        F.when(last & fine, F.col("extraction_source")).alias("extraction_source"),
        F.when(last & fine & applied, F.coalesce("section_count", F.lit(0))).alias("section_count"),
    )
    events.write.mode("overwrite").parquet(f"{out}/job_events/batch_id={batch_id}/first_step={first_step}")


def start_ingest(files: DataFrame, to_text: Callable[[DataFrame], DataFrame], out: str,
                 pipelines: Mapping[str, ing.Pipeline] = ing.PIPELINES, model=None,
                 candidates: tuple[str, ...] = ()) -> StreamingQuery:
    """Run over all files that are there, each once, then stop.

    ``files`` is a stream from ``landed_files``; ``to_text`` adds the ``text``
    column (or the ``candidates``) and, for course tables, ``table_rows`` (PDF decoding is
    the caller's). ``out`` is a folder on shared storage.
    """
    texts = to_text(files)
    docs = texts.select(
        *[c for c in ("table_rows", *(candidates or ("text",))) if c in texts.columns],
        F.regexp_replace("filename", r"\.[^.]*$", "").alias("doc_id"), F.col("filename").alias("file_name"),
        "category", F.col("length").alias("size"), F.col("modificationTime").alias("arrived"),
        # A later upload of the same name is a job of its own.
        F.concat_ws("@", "path", F.unix_micros("modificationTime")).alias("job_id"),
    )
    return (
        docs.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, out, pipelines, model, candidates))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def job_table(spark, out: str) -> DataFrame:
    return ing.job_states(spark.read.parquet(f"{out}/job_events").drop("batch_id", "first_step"))


def first_uploads_stream(uploads: DataFrame, event_time: str, keep_for: str) -> DataFrame:
    """Drop repeated (name, size, last modified) within a time span, so state stays bounded."""
    return uploads.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(
        list(ing.UPLOAD_KEY)
    )


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is available to a parquet folder, then return."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _answer_batch(batch: DataFrame, batch_id: int, out: str, graph: Callable[[], tuple], options: dict) -> None:
    staged = f"{out}/questions/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(staged)
    fixed = batch.sparkSession.read.parquet(staged)
    nodes, edges, corpus = graph()
    found = ret.contexts(fixed, nodes, edges, corpus, **options)
    ret.replies(fixed, found).join(found.drop("intent"), "qid").write.mode("overwrite").parquet(
        f"{out}/answers/batch_id={batch_id}"
    )


def answer_stream(questions: DataFrame, nodes: DataFrame, edges: DataFrame, corpus: DataFrame, out: str,
                  **options) -> StreamingQuery:
    """Contexts for ``questions(qid, text, vector)`` as they arrive, from a graph that does not change.

    Ranking is not defined on a stream, so each micro-batch is answered on its own;
    a repeated batch rewrites its own folder.
    """
    return _answers(questions, out, lambda df, n: _answer_batch(df, n, out, lambda: (nodes, edges, corpus), options))


ATTEMPTS = 5


def answer_stored(questions: DataFrame, store: str, out: str, model: ve.TextModel | None = None, **options) -> StreamingQuery:
    """As ``answer_stream``, from the tables that ``ingest_batch`` keeps under ``store``.

    With ``model`` the corpus is what the vector table holds of the nodes' texts.

    Every micro-batch lists the tables anew, so it sees what was stored before it. Where an
    ingestion replaces a folder under a running micro-batch, the batch is answered again from
    the tables as they are then, ``ATTEMPTS`` times at most; its folder is rewritten.
    """
    spark = questions.sparkSession

    def graph() -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes = writers.read_nodes(spark, f"{store}/nodes")
        corpus = writers.table_corpus(nodes) if model is None else ve.vector_corpus(writers.table_nodes(nodes), f"{store}/vectors", model)
        return nodes, writers.read_edges(spark, f"{store}/edges"), corpus

    def answer(batch: DataFrame, batch_id: int) -> None:
        for left in reversed(range(ATTEMPTS)):
            try:
                return _answer_batch(batch, batch_id, out, graph, {"index": f"{store}/names", **options})
            except PySparkException as error:
                if not left or "FILE_NOT_EXIST" not in str(error):
                    raise

    return _answers(questions, out, answer)


def _answers(questions: DataFrame, out: str, answer: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
