"""Uploads and ingestion jobs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import ingestion as ing
from ..session import work_folder
from ..sources.readers import CATEGORIES, rejection
from ..streaming import ingest as st
from ..streaming import jobs as sj
from .derive import LINES_SQL, lines_of, programme_text, regulation_text, stream, table


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _items(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", _pick(ing.ITEM_STATES, F.col("o_orderkey")).alias("status")
    )


def status_summary(spark, d):
    return ing.status_summary(_items(spark, d))


def busy(spark, d):
    return ing.is_busy(_items(spark, d), "o_custkey").select("o_custkey", F.col("busy").cast("int").alias("busy"))


def eligible(spark, d):
    return ing.eligible(_items(spark, d)).select("o_orderkey", "status")


def display(spark, d):
    key = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select(
        "o_orderkey", _pick(ing.JOB_STATES, key).alias("status"),
        F.when(key % 3 == 0, F.lit(False)).when(key % 3 == 1, F.lit(True)).alias("applied"),
        F.when(key % 5 > 0, key).alias("nodes"), F.when(key % 7 == 0, F.lit("hỏng")).alias("error"),
    )
    shown = jobs.withColumn("shown", ing.display_state(F.col("status"), F.col("applied")))
    return shown.select(
        "o_orderkey", "shown",
        ing.display_message(F.col("shown"), F.col("nodes"), F.col("o_orderkey"), F.col("error")).alias("message"),
    )


_STATE_OF = {"signup": "queued", "click": "processing", "purchase": "completed", "error": "failed", "view": "processing"}


def _events(spark, d, source=table):
    kind = F.col("event_type")
    status = F
    for name, state in _STATE_OF.items():
        status = status.when(kind == name, F.lit(state))
    return source(spark, d, "events").select(
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("event_seq"),
        status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("size"),
    )


def job_states(spark, d):
    second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ing.arrival_order(ing.job_states(_events(spark, d))).select(
        "job_id", "status", "size", second("created_at"), second("started_at"), second("completed_at")
    )


def job_lookup(spark, d):
    wanted = table(spark, d, "customer").select(F.concat(F.lit("job"), F.col("c_custkey").cast("string")).alias("job_id"))
    return ing.look_up_jobs(wanted, ing.job_states(_events(spark, d))).select(
        "job_id", "status", F.col("known").cast("int").alias("known")
    )


def rejections(spark, d):
    key = F.col("o_orderkey")
    name = F.when(key % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), key.cast("string"), _pick((".pdf", ".PDF", ".docx", ".Pdf"), key)))
    category = _pick((*CATEGORIES, "khac"), key)
    size = F.floor(F.col("o_totalprice") * 150).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", rejection(name, category, size).alias("reason"))


def routing(spark, d):
    category = _pick((*CATEGORIES, "khac"), F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy(category.alias("category")).agg(F.count("*").alias("files")).select(
        "category", "files", ing.has_pipeline(F.col("category")).cast("int").alias("has_pipeline")
    )


def _uploads(events):
    return events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name"), F.floor("value").cast("bigint").alias("size"),
        F.date_format("ts", "yyyy-MM").alias("last_modified"), F.col("event_id"), F.col("ts").cast("timestamp").alias("at"),
    )


def first_uploads(spark, d):
    return ing.first_uploads(_uploads(table(spark, d, "events")), "event_id").select(
        F.concat_ws("-", *ing.UPLOAD_KEY).alias("key"), "event_id"
    )


def streamed_first_uploads(spark, d):
    """A repeat has the month of its first upload, so the state of 32 days finds all."""
    out = work_folder(spark, "upload-stream")
    kept = st.first_uploads_stream(_uploads(stream(spark, d, "events")), "at", "32 days")
    st.write_available(kept, f"{out}/kept", f"{out}/checkpoint")
    kept = spark.read.parquet(f"{out}/kept")
    return kept.groupBy("name").agg(F.count("*").alias("uploads"))


def streamed_ingest(spark, d):
    """Documents arrive as a stream and are routed to the pipelines; the jobs come back."""
    out = work_folder(spark, "ingest-stream")
    docs = lines_of(stream(spark, d, "documents"))
    category = _pick(CATEGORIES, F.col("doc_id"))
    text = F.when(category == CATEGORIES[0], programme_text()).when(category == CATEGORIES[1], regulation_text()).otherwise(
        F.array_join("ls", "\n")
    )
    files = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".txt").otherwise(".pdf")).alias("file_name"),
        category.alias("category"), F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 10 == 3, F.lit(" ")).otherwise(text).alias("text"),
        F.current_timestamp().alias("arrived"),
    )
    query = (
        files.writeStream.foreachBatch(lambda df, n: st.ingest_batch(df, n, out))
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return st.job_table(spark, out).select(
        "job_id", "status", "category", "error",
        F.col("ingestion_applied").cast("string").alias("applied"),
        F.when(F.col("nodes") > 0, "some").otherwise("none").alias("nodes"),
    )


def lines_as_nodes(document):
    """A processor for the query below: a node for each of the first word of every line; some documents raise."""
    if int(document["doc_id"]) % 7 == 0:
        raise ValueError("no structure in " + document["doc_id"])
    words = [line.split(" ")[0] for line in document["text"].split("\n") if line]
    ids = [f"{document['doc_id']}_{w}" for w in dict.fromkeys(words)]
    return [{"label": "Word", "id": i} for i in ids], [{"source": a, "type": "NEXT", "target": b} for a, b in zip(ids, ids[1:])]


def guarded_ingest(spark, d):
    """Jobs of documents with two candidate texts, through a processor that raises on some of them."""
    out = work_folder(spark, "guarded")
    key = F.col("doc_id")
    letters = F.array_join("ls", "\n")
    batch = lines_of(table(spark, d, "documents")).select(
        key.cast("string").alias("doc_id"), F.concat(F.lit("f"), key.cast("string"), F.lit(".pdf")).alias("file_name"),
        F.lit(CATEGORIES[2]).alias("category"), F.col("n_chars").alias("size"), F.current_timestamp().alias("arrived"),
        F.when(key % 2 == 0, letters).otherwise(F.lit(" ")).alias("markdown"),
        F.when(key % 9 > 0, letters).alias("layer"),
    )
    st.ingest_batch(batch, 0, out, {CATEGORIES[2]: ing.guarded(lines_as_nodes)}, candidates=("markdown", "layer"))
    return st.job_table(spark, out).select("job_id", "status", "error", "nodes", "edges", "extraction_source", "extracted_text_length")


def tracked_jobs(spark, d):
    """Job events as a stream: states kept by job, and jobs that have been running for 6 hours fail."""
    out = work_folder(spark, "tracked-jobs")
    events = _events(spark, d, stream)
    sj.start_tracking(events, out, "1 hour", lost_after=6 * 3600, keep_for=86400).awaitTermination()
    second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sj.tracked_jobs(spark, out).select(
        "job_id", "status", "error", "size", second("created_at"), second("started_at"), second("completed_at")
    )


QUERIES = {
    "stream_tracked_jobs": tracked_jobs,
    "jobs_guarded_ingest": guarded_ingest,
    "jobs_status_summary": status_summary,
    "jobs_busy": busy,
    "jobs_eligible": eligible,
    "jobs_display": display,
    "jobs_states": job_states,
    "jobs_lookup": job_lookup,
    "uploads_rejected": rejections,
    "uploads_routed": routing,
    "uploads_first": first_uploads,
    "stream_first_uploads": streamed_first_uploads,
    "stream_ingest_jobs": streamed_ingest,
}

_ITEMS = """
with items as (select o_orderkey, o_custkey,
  list_extract(['ready', 'uploading', 'queued', 'processing', 'success', 'stored', 'error'], o_orderkey % 7 + 1) as status from orders)
"""
_EVENTS = """
with ev as (select 'job' || user_id as job_id, event_id, ts, value, case event_type when 'signup' then 'queued'
  when 'purchase' then 'completed' when 'error' then 'failed' else 'processing' end as status from events),
states as (select job_id, arg_max(status, event_id) as status, arg_max(value, event_id) as size,
  strftime(min(ts) filter (status = 'queued'), '%Y-%m-%d %H:%M:%S') as created_at,
  strftime(min(ts) filter (status = 'processing'), '%Y-%m-%d %H:%M:%S') as started_at,
  strftime(min(ts) filter (status in ('completed', 'failed')), '%Y-%m-%d %H:%M:%S') as completed_at
  from ev group by job_id)
"""
_CATS = "['chuyen_nganh_dao_tao', 'quy_che_hoc_vu', 'huong_dan_thu_tuc', 'thong_bao_ke_hoach', 'khac']"
SQL = {
    "jobs_status_summary": _ITEMS + """
select s.status, count(i.status) as items from (select unnest(['ready', 'uploading', 'queued', 'processing', 'success', 'stored', 'error']) as status) s
left join items i on i.status = s.status group by s.status
""",
    "jobs_busy": _ITEMS + """
select o_custkey, cast(bool_or(status in ('uploading', 'queued', 'processing')) as int) as busy from items group by o_custkey
""",
    "jobs_eligible": _ITEMS + "select o_orderkey, status from items where status in ('ready', 'error')",
    "jobs_display": """
with j as (select o_orderkey, list_extract(['queued', 'processing', 'completed', 'failed'], o_orderkey % 4 + 1) as status,
  o_orderkey % 3 = 0 as stored_only from orders),
s as (select *, case when status = 'completed' then case when stored_only then 'stored' else 'success' end
  when status = 'failed' then 'error' else status end as shown from j)
select o_orderkey, shown, case shown
  when 'success' then case when o_orderkey % 5 > 0 then 'Xong: ' || o_orderkey || ' nodes, ' || o_orderkey || ' edges.' else 'Upload hoàn tất.' end
  when 'stored' then 'Đã lưu file, chưa có pipeline ingestion cho thể loại này.'
  when 'error' then case when o_orderkey % 7 = 0 then 'hỏng' else 'Ingestion thất bại.' end end as message from s
""",
    "jobs_guarded_ingest": f"""
with {LINES_SQL},
texts as (select doc_id, array_to_string(ls, chr(10)) as t, doc_id % 2 = 0 as first_one, doc_id % 9 > 0 as second_one from docs),
picked as (select doc_id, case when first_one and t <> '' then 'markdown' when second_one and t <> '' then 'layer' end as source, t from texts),
words as (select doc_id, count(distinct string_split(line, ' ')[1]) as n from lines group by doc_id)
select doc_id || '' as job_id, case when source is null or doc_id % 7 = 0 then 'failed' else 'completed' end as status,
  case when source is null then 'Khong trich xuat duoc noi dung text tu PDF.'
       when doc_id % 7 = 0 then 'ValueError: no structure in ' || doc_id end as error,
  case when source is not null and doc_id % 7 <> 0 then n end as nodes, case when source is not null and doc_id % 7 <> 0 then n - 1 end as edges,
  case when doc_id % 7 <> 0 then source end as extraction_source,
  case when source is not null and doc_id % 7 <> 0 then length(t) end as extracted_text_length
from picked left join words using (doc_id)
""",
    "jobs_states": _EVENTS + "select * from states",
    "stream_tracked_jobs": _EVENTS + """,
last as (select job_id, arg_max(status, event_id) = 'processing'
    and epoch_ms(arg_max(ts, event_id)) + 21600000 < (select epoch_ms(max(ts)) from ev) - 3600000 as lost,
  arg_max(ts, event_id) + interval 6 hour as over from ev group by job_id)
select job_id, case when lost then 'failed' else status end as status,
  case when lost then 'No result within the time limit.' end as error, size, created_at, started_at,
  case when lost then least(completed_at, strftime(over, '%Y-%m-%d %H:%M:%S')) else completed_at end as completed_at
from states join last using (job_id)
""",
    "jobs_lookup": _EVENTS + """
select 'job' || c_custkey as job_id, coalesce(s.status, 'Job not found') as status, case when s.job_id is null then 0 else 1 end as known
from customer left join states s on s.job_id = 'job' || c_custkey
""",
    "uploads_rejected": """
select o_orderkey, case when o_orderkey % 13 = 0 then 'File name is missing' when o_orderkey % 5 = 4 then 'Invalid category'
  when o_orderkey % 4 = 2 then 'Only PDF files are allowed' when floor(o_totalprice * 150) > 52428800 then 'File exceeds 50MB limit' end as reason
from orders
""",
    "uploads_routed": f"""
select list_extract({_CATS}, o_orderkey % 5 + 1) as category, count(*) as files, case when o_orderkey % 5 < 2 then 1 else 0 end as has_pipeline
from orders group by 1, 3
""",
    "uploads_first": """
select 'f' || user_id || '-' || cast(floor(value) as bigint) || '-' || strftime(ts, '%Y-%m') as key, min(event_id) as event_id from events group by 1
""",
    "stream_first_uploads": """
select 'f' || user_id as name, count(distinct (cast(floor(value) as bigint), strftime(ts, '%Y-%m'))) as uploads from events group by 1
""",
    "stream_ingest_jobs": """
with lines_left as (select doc_id, trim(regexp_replace(text, '[^\\p{L}]', '', 'g')) <> '' as any_text from documents),
s as (select doc_id, list_extract(['chuyen_nganh_dao_tao', 'quy_che_hoc_vu', 'huong_dan_thu_tuc', 'thong_bao_ke_hoach'], doc_id % 4 + 1) as category,
  case when doc_id % 9 = 0 then 'Only PDF files are allowed'
       when doc_id % 10 = 3 or (doc_id % 4 > 0 and not any_text) then 'Khong trich xuat duoc noi dung text tu PDF.' end as error from lines_left)
select doc_id || '' as job_id, case when error is null then 'completed' else 'failed' end as status, category, error,
  case when error is null then case when doc_id % 4 < 2 then 'true' else 'false' end end as applied,
  case when error is null and doc_id % 4 < 2 then 'some' else 'none' end as nodes
from s
""",
}
