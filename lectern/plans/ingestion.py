"""Upload jobs: routing by category, job states, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curriculum as cu
from ..functions import sections as sc
from ..functions import text as tx
from ..operators import regulations as rg
from ..operators import vectors as ve
from ..session import stage
from ..sources.readers import CATEGORIES

# Categories with a pipeline, states of a job and of a list item.
PIPELINE_CATEGORIES = CATEGORIES[:2]
JOB_STATES = ("queued", "processing", "completed", "failed")
ITEM_STATES = ("ready", "uploading", "queued", "processing", "success", "stored", "error")
BUSY_STATES = ("uploading", "queued", "processing")
ELIGIBLE_STATES = ("ready", "error")

# Documents and their course rows (if any) to submitted nodes and edges.
Pipeline = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def _regulation_graph(docs: DataFrame, course_rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    flat = rg.flatten_trees(rg.parse_regulations(docs))
    cited = rg.citation_edges(flat).select(
        "source", "type", "target", F.create_map().cast("map<string,string>").alias("props"),
        F.col("doc_id").cast("string").alias("doc_id"), F.array(F.lit(0).cast("bigint")).alias("seq"),
    )
    return rg.tree_nodes(flat), rg.tree_edges(flat).unionByName(cited)


# Per category: documents to submitted nodes and edges. Replace or extend freely.
PIPELINES: Mapping[str, Pipeline] = {
    "chuyen_nganh_dao_tao": lambda docs, rows=None: cu.curriculum_graph(docs.select("doc_id", "text"), rows),
    "quy_che_hoc_vu": _regulation_graph,
}


def has_pipeline(category: Column, pipelines: Mapping[str, Pipeline] = PIPELINES) -> Column:
    return category.isin(*pipelines)


ERRORS = "doc_id string, error string"
_PROPS = "map<string,string>"
_RESULT = (
    f"doc_id string, nodes array<struct<label:string,id:string,text:string,props:{_PROPS}>>, "
    f"edges array<struct<source:string,type:string,target:string,props:{_PROPS}>>, error string"
)


def guarded(process: Callable[[dict], tuple[list[dict], list[dict]]]) -> Pipeline:
    """A pipeline from a Python function of one document; a document it raises on does not stop the others.

    ``process`` gets the document's columns as a dict and returns its nodes
    ``(label, id[, text, props])`` and edges ``(source, type, target[, props])`` as dicts. The
    pipeline returns a third frame ``(doc_id, error)`` of the documents that failed; they have
    no nodes and edges. Results are written once, so each document is processed once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One document a step: what is done so far is not held with what comes.
            for document in batch.to_pylist():
                row = {"doc_id": str(document["doc_id"]), "nodes": [], "edges": [], "error": None}
                try:
                    nodes, edges = process(document)
                    row["nodes"] = [_whole(n, "label", "id", "text") for n in nodes]
                    row["edges"] = [_whole(e, "source", "type", "target") for e in edges]
                except Exception as error:  # noqa: BLE001 - a document's own failure is its result
                    row.update(nodes=[], edges=[], error=f"{type(error).__name__}: {error}")
                yield pa.RecordBatch.from_pylist([row], schema=_arrow_result())

    def pipeline(docs: DataFrame, course_rows: DataFrame | None = None):
        done = stage(docs.mapInArrow(run, _RESULT), "processed")
        props = lambda: F.coalesce("r.props", F.create_map().cast(_PROPS)).alias("props")

        def rows(kind: str, *fields: str) -> DataFrame:
            each = done.select("doc_id", F.posexplode(kind).alias("at", "r"))
            seq = F.array(F.col("at").cast("bigint")).alias("seq")
            return each.select(*[f"r.{f}" for f in fields], props(), "doc_id", seq)

        failed = done.where("error is not null").select("doc_id", "error")
        return rows("nodes", "label", "id", "text"), rows("edges", "source", "type", "target"), failed

    return pipeline


def _whole(item: dict, *fields: str) -> dict:
    props = {str(k): None if v is None else str(v) for k, v in (item.get("props") or {}).items()}
    return {**{f: item.get(f) for f in fields}, "props": list(props.items())}


def _arrow_result() -> pa.Schema:
    of = lambda *names: pa.list_(pa.struct([*[(n, pa.string()) for n in names], ("props", pa.map_(pa.string(), pa.string()))]))
    return pa.schema([
        ("doc_id", pa.string()), ("nodes", of("label", "id", "text")), ("edges", of("source", "type", "target")), ("error", pa.string()),
    ])


def run_pipelines(docs: DataFrame, pipelines: Mapping[str, Pipeline] = PIPELINES) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, file_name, category, text[, table_rows])`` to the nodes and edges of all pipelines.

    ``table_rows`` are the rows of a document's course tables, each an array of cells.
    """
    return run_guarded(docs, pipelines)[:2]


def run_guarded(docs: DataFrame, pipelines: Mapping[str, Pipeline] = PIPELINES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``run_pipelines``, and the documents ``(doc_id, error)`` that guarded pipelines failed on."""
    def course_rows(part: DataFrame) -> DataFrame | None:
        if "table_rows" not in docs.columns:
            return None
        return part.select("doc_id", F.posexplode("table_rows").alias("row_no", "cells")).withColumn(
            "row_no", F.col("row_no").cast("bigint")
        )

    parts = {c: docs.where(F.col("category") == c) for c in pipelines}
    graphs = [p(parts[c], course_rows(parts[c])) for c, p in pipelines.items()]
    nodes, edges = graphs[0][:2]
    for more_nodes, more_edges, *_ in graphs[1:]:
        nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
    failed = docs.sparkSession.createDataFrame([], ERRORS)
    for _, _, *errors in graphs:
        failed = reduce(DataFrame.unionByName, errors, failed)
    return nodes, edges, failed


def section_counts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, section_count)``: numbered sections of a programme, articles of a regulation."""
    programme = docs.where(F.col("category") == PIPELINE_CATEGORIES[0]).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.size(sc.sections(tx.refine(F.col("text")))).cast("bigint").alias("section_count")
    )
    articles = nodes.where("label = 'Dieu'").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("section_count"))
    return programme.unionByName(articles)


# Why a document of a category with a pipeline left nothing in the graph.
NO_NODES = (
    "ETL khong tao ra node nao. Can kiem tra cau truc tieu de/section cua PDF va bo tu khoa phan loai."
)


def replaced_roots(nodes: DataFrame) -> DataFrame:
    """Roots of the trees that submitted nodes replace when they are stored again."""
    return nodes.where(F.col("label") == rg.ROOT_LABEL).select("id").distinct()


def with_vectors(nodes: DataFrame, load_model, dims: int) -> DataFrame:
    """Submitted nodes with the vector of their text; a blank text has none."""
    keys = ("label", "id", "doc_id", "seq")
    vectors = ve.embed(nodes.dropDuplicates(list(keys)), load_model, dims, keys=keys)
    return nodes.join(vectors.withColumnRenamed("vector", "embedding"), list(keys), "left")


def failure(docs: DataFrame) -> Column:
    """Why a document cannot be processed; null if it can."""
    return F.when(
        tx.strip(F.coalesce("text", F.lit(""))) == "", F.lit("Khong trich xuat duoc noi dung text tu PDF.")
    )


def job_states(events: DataFrame) -> DataFrame:
    """Current row of each job: the latest event, with the times of its steps."""
    fields = [c for c in events.columns if c not in ("job_id", "event_seq")]
    at = lambda *states: F.min(F.when(F.col("status").isin(*states), F.col("at")))
    return events.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), "event_seq").alias("now"),
        at("queued").alias("created_at"),
        at("processing").alias("started_at"),
        at("completed", "failed").alias("completed_at"),
    ).select("job_id", *[f"now.{f}" for f in fields if f != "at"], "created_at", "started_at", "completed_at")


def arrival_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("created_at", "job_id")


def look_up_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """``wanted(job_id)`` with the job's state; unknown ids stay and say so."""
    found = jobs.select("job_id", "status").withColumn("known", F.lit(True))
    return wanted.join(found, "job_id", "left").select(
        "job_id", F.coalesce("status", F.lit("Job not found")).alias("status"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )


def display_state(status: Column, ingestion_applied: Column) -> Column:
    return (
        F.when((status == "completed") & (ingestion_applied == F.lit(False)), F.lit("stored"))
        .when(status == "completed", F.lit("success"))
        .when(status == "failed", F.lit("error"))
        .otherwise(status)
    )


def display_message(status: Column, nodes: Column, edges: Column, error: Column) -> Column:
    counted = F.concat(
        F.lit("Xong: "), nodes.cast("string"), F.lit(" nodes, "), edges.cast("string"), F.lit(" edges.")
    )
    return (
        F.when(status == "success", F.coalesce(counted, F.lit("Upload hoàn tất.")))
        .when(status == "stored", F.lit("Đã lưu file, chưa có pipeline ingestion cho thể loại này."))
        .when(status == "error", F.coalesce(error, F.lit("Ingestion thất bại.")))
    )


def status_summary(items: DataFrame, states: tuple[str, ...] = ITEM_STATES) -> DataFrame:
    """Items per state, zero for states that do not occur."""
    listed = items.sparkSession.createDataFrame([(s,) for s in states], "status string")
    return (
        items.groupBy("status").agg(F.count("*").alias("items"))
        .join(listed, "status", "right")
        .select("status", F.coalesce("items", F.lit(0)).alias("items"))
    )


def is_busy(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.bool_or(F.col("status").isin(*BUSY_STATES)).alias("busy"))


def eligible(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin(*ELIGIBLE_STATES))


# What makes two uploads the same, in batches and streams alike.
UPLOAD_KEY = ("name", "size", "last_modified")


def first_uploads(uploads: DataFrame, order: str) -> DataFrame:
    """The first upload of each (name, size, last modified)."""
    rest = [c for c in uploads.columns if c not in UPLOAD_KEY]
    return uploads.groupBy(*UPLOAD_KEY).agg(F.min_by(F.struct(*rest), order).alias("u")).select(*UPLOAD_KEY, "u.*")
