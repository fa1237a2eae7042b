import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.plans import ingestion as ing
from lectern.session import work_folder
from lectern.sources import readers, writers
from lectern.streaming import ingest as st

REGULATION = "Chương I\nĐiều 1. Một\n1. Xem Điều 2\nĐiều 2. Hai"
PROGRAMME = "1. Thông tin chung\nNgành: Toán (Maths) Mã ngành: 7\nĐơn vị quản lý: Khoa Toán"


@pytest.fixture
def landing(tmp_path):
    files = {
        "quy_che_hoc_vu/quydinh.pdf": REGULATION, "chuyen_nganh_dao_tao/toan.PDF": PROGRAMME,
        "huong_dan_thu_tuc/huongdan.pdf": "chỉ lưu", "quy_che_hoc_vu/rong.pdf": "  ", "quy_che_hoc_vu/note.txt": "x",
        "la/khac.pdf": "x",
    }
    for name, text in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path / "in")


def decode(files):
    return files.withColumn("text", F.decode("content", "UTF-8"))


def test_landed_files(spark, landing):
    got = {(r.filename, r.category) for r in readers.landed_files(spark, landing).select("filename", "category").collect()}
    assert got == {
        ("quydinh.pdf", "quy_che_hoc_vu"), ("toan.PDF", "chuyen_nganh_dao_tao"), ("huongdan.pdf", "huong_dan_thu_tuc"),
        ("rong.pdf", "quy_che_hoc_vu"), ("khac.pdf", "la"),
    }


def test_ingest_stream(spark, landing):
    out = work_folder(spark, "ingest")
    for _ in range(2):  # the second run finds nothing new
        st.start_ingest(readers.landed_files(spark, landing, streaming=True, per_trigger=3), decode, out).awaitTermination()
    jobs = {r.filename.split(".")[0]: r for r in st.job_table(spark, out).collect()}
    assert {j: r.status for j, r in jobs.items()} == {
        "quydinh": "completed", "toan": "completed", "huongdan": "completed", "rong": "failed", "khac": "failed",
    }
    assert jobs["khac"].error == "Invalid category"
    assert (jobs["quydinh"].nodes, jobs["quydinh"].edges) == (5, 5)
    assert jobs["quydinh"].extracted_text_length == len(REGULATION) and jobs["quydinh"].extracted_preview
    assert jobs["quydinh"].job_id.split("@")[0].endswith("quydinh.pdf")
    assert jobs["huongdan"].ingestion_applied is False and jobs["huongdan"].nodes is None
    assert all(r.created_at and r.started_at and r.completed_at for r in jobs.values())
    # at most three files per micro-batch
    assert spark.read.parquet(f"{out}/staged").select("batch_id").distinct().count() == 2
    edges = {(r.source, r.type, r.target) for r in writers.read_edges(spark, f"{out}/edges").collect()}
    assert ("quydinh_ChươngI_Dieu1_Khoan1", "tham_chieu", "quydinh_ChươngI_Dieu2") in edges
    assert ("7_0_STD", "THUOC_VE", "7") in edges
    # the stream stores what one batch over the same files stores
    docs = decode(readers.landed_files(spark, landing)).select(
        F.regexp_replace("filename", r"\.[^.]*$", "").alias("doc_id"), F.col("filename").alias("file_name"), "category", "text"
    ).where("category <> 'la' and trim(text) <> ''")
    nodes, _ = ing.run_pipelines(docs)
    batch = work_folder(spark, "batch")
    writers.upsert_nodes(nodes, batch)
    rows = lambda p: {(r.label, r.id, tuple(sorted(r.props.items()))) for r in writers.read_nodes(spark, p).collect()}
    assert rows(batch) == rows(f"{out}/nodes")


def test_a_repeated_batch_changes_nothing(spark):
    out = work_folder(spark, "repeat")
    batch = spark.createDataFrame(
        [("quydinh", "quydinh.pdf", "quy_che_hoc_vu", 10, REGULATION, dt.datetime(2024, 1, 1))],
        "doc_id string, file_name string, category string, size bigint, text string, arrived timestamp",
    )
    seen = []
    for _ in range(2):
        st.ingest_batch(batch, 0, out)
        seen.append((writers.read_nodes(spark, f"{out}/nodes").count(), writers.read_edges(spark, f"{out}/edges").count(), st.job_table(spark, out).count()))
    assert seen[0] == seen[1] == (5, 5, 1)


def test_a_shorter_upload_replaces_the_document(spark):
    out = work_folder(spark, "shorter")
    schema = "doc_id string, file_name string, category string, size bigint, text string, arrived timestamp, job_id string"

    def send(batch_id, *docs):
        rows = [(d, d + ".pdf", "quy_che_hoc_vu", 10, text, dt.datetime(2024, 1, 1 + batch_id), f"{d}-{batch_id}") for d, text in docs]
        st.ingest_batch(spark.createDataFrame(rows, schema), batch_id, out)
        ids = {r.id for r in writers.read_nodes(spark, f"{out}/nodes").collect()}
        edges = {(r.source, r.type, r.target) for r in writers.read_edges(spark, f"{out}/edges").collect()}
        return ids, edges

    first, first_edges = send(0, ("quydinh", REGULATION), ("khac", REGULATION))
    shorter = REGULATION[: REGULATION.index("Điều 2")]
    second, second_edges = send(1, ("quydinh", shorter))
    assert {i for i in first if i.startswith("khac")} <= second
    assert second < first and "quydinh_ChươngI_Dieu2" in first - second
    assert all(a in second and b in second for a, _, b in second_edges) and second_edges < first_edges
    send(2, ("quydinh", " \n\t "))
    jobs = {r.job_id: (r.status, r.error) for r in st.job_table(spark, out).collect()}
    assert jobs["quydinh-1"][0] == "completed" and jobs["quydinh-2"][0] == "failed"
    events = spark.read.parquet(f"{out}/job_events")
    assert events.groupBy("job_id", "event_seq").count().where("count > 1").count() == 0
    third, _ = send(3, ("quydinh", REGULATION))
    assert third == first


def test_courses_and_vectors_are_stored_and_answer(spark):
    from lectern.plans import retrieval as ret
    from lectern.queries.vectors import LETTERS, letter_model

    out = work_folder(spark, "courses")
    text = PROGRAMME + "\n2. Khung chương trình đào tạo\nbảng"
    table = [["Khối kiến thức X"] * 10, ["1", "CT101", "Giải tích", "3", "3", "", "30", "", "", ""],
             ["2", "CT102", "Đại số", "4", "3", "", "30", "", "CT101", ""]]
    batch = spark.createDataFrame(
        [("toan", "toan.pdf", "chuyen_nganh_dao_tao", 10, text, dt.datetime(2024, 1, 1), table)],
        "doc_id string, file_name string, category string, size bigint, text string, arrived timestamp, table_rows array<array<string>>",
    )
    st.ingest_batch(batch, 0, out, model=(letter_model, len(LETTERS)))
    nodes, edges = writers.read_nodes(spark, f"{out}/nodes"), writers.read_edges(spark, f"{out}/edges")
    corpus = writers.table_corpus(nodes)
    assert {len(r.vector) for r in corpus.collect()} == {len(LETTERS)}
    near = corpus.where("id = 'CT101'").first()
    questions = spark.createDataFrame(
        [("q1", "Tín chỉ CT102", None), ("q2", "Cho tôi biết thông tin này", near.vector)], "qid string, text string, vector array<float>")
    got = {r.qid: r for r in ret.contexts(questions, nodes, edges, corpus, threshold=0.99, match_codes=True).collect()}
    assert "4 tín chỉ" in got["q1"].graph_text
    assert got["q2"].vector_text.split("\n")[0] == near.text


def test_upload_stream_equals_batch(spark, tmp_path):
    rows = [("a.pdf", 1, "m", i, dt.datetime(2024, 1, 1, i)) for i in range(3)] + [("a.pdf", 2, "m", 9, dt.datetime(2024, 1, 2))]
    schema = "name string, size bigint, last_modified string, n int, at timestamp"
    folder = str(tmp_path / "uploads")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(folder)
    out = work_folder(spark, "uploads")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    st.write_available(st.first_uploads_stream(stream, "at", "30 days"), f"{out}/kept", f"{out}/checkpoint")
    key = lambda df: {(r.name, r.size, r.last_modified) for r in df.collect()}
    batch = ing.first_uploads(spark.read.schema(schema).parquet(folder), "n")
    kept = spark.read.parquet(f"{out}/kept")
    assert kept.count() == batch.count() == 2 and key(kept) == key(batch)
    assert {r.n for r in batch.collect()} == {0, 9}


def test_rejections(spark):
    rows = [("", "quy_che_hoc_vu", 1), ("a.pdf", "x", 1), ("a.doc", "quy_che_hoc_vu", 1), ("a.PDF", "quy_che_hoc_vu", 52428801), ("a.PDF", "quy_che_hoc_vu", 52428800)]
    df = spark.createDataFrame(rows, "n string, c string, s bigint")
    got = [r[0] for r in df.select(readers.rejection(F.col("n"), F.col("c"), F.col("s"))).collect()]
    assert got == ["File name is missing", "Invalid category", "Only PDF files are allowed", "File exceeds 50MB limit", None]


def test_job_states_and_lookup(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([
        ("a", 0, "queued", at(1), None), ("a", 1, "processing", at(2), None), ("a", 2, "failed", at(3), "hỏng"), ("b", 0, "queued", at(0), None),
    ], "job_id string, event_seq bigint, status string, at timestamp, error string")
    jobs = ing.job_states(events)
    assert [(r.job_id, r.status, r.error) for r in ing.arrival_order(jobs).collect()] == [("b", "queued", None), ("a", "failed", "hỏng")]
    wanted = spark.createDataFrame([("a",), ("z",)], "job_id string")
    assert {tuple(r) for r in ing.look_up_jobs(wanted, jobs).collect()} == {("a", "failed", True), ("z", "Job not found", False)}


def test_summary_lists_absent_states(spark):
    items = spark.createDataFrame([("ready",), ("ready",), ("error",)], "status string")
    got = {r.status: r["items"] for r in ing.status_summary(items).collect()}
    assert got == {"ready": 2, "error": 1, "uploading": 0, "queued": 0, "processing": 0, "success": 0, "stored": 0}
    assert ing.eligible(items).count() == 3 and ing.is_busy(items).first().busy is False


def test_regulation_json_round_trip(spark, tmp_path):
    import json

    file = tmp_path / "quyche.json"
    file.write_text(json.dumps({"quyet_dinh_ban_hanh": {"can_cu": [], "cac_dieu": []}, "quy_dinh_chi_tiet": [
        {"chuong": "Chương I", "ten": "Chương I", "cac_dieu": [{"id": "Điều 1", "tieu_de": "Một", "full_path": "", "noi_dung": "", "cac_khoan": []}]},
    ]}, ensure_ascii=False, indent=2), encoding="utf-8")
    from lectern.operators import regulations as rg

    flat = rg.flatten_trees(readers.regulation_json(spark, str(file)))
    assert [r.id for r in flat.orderBy("seq").collect()] == ["vanban", "vanban_ChươngI", "vanban_ChươngI_Dieu1"]


def test_text_and_chat_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("x\ny", encoding="utf-8")
    assert tuple(readers.text_documents(spark, str(tmp_path / "t")).first()) == ("a", "a.md", "x\ny")
    (tmp_path / "c.json").write_text('{"id": "1", "messages": [{"role": "user", "parts": [{"type": "text", "text": "hi"}]}]}\n')
    assert readers.chat_requests(spark, str(tmp_path / "c.json")).first().messages[0].parts[0].text == "hi"


UPLOADS = "doc_id string, file_name string, category string, size bigint, arrived timestamp"


def test_a_processor_that_raises_fails_its_own_document_only(spark):
    def process(document):
        if document["doc_id"] == "bad":
            raise KeyError("no heading")
        words = document["text"].split()
        nodes = [{"label": "Word", "id": w, "text": w, "props": {"n": i}} for i, w in enumerate(words)]
        return nodes, [{"source": a, "type": "BEFORE", "target": b} for a, b in zip(words, words[1:])]

    out = work_folder(spark, "guarded")
    pipelines = {"huong_dan_thu_tuc": ing.guarded(process), **ing.PIPELINES}
    rows = [(d, d + ".pdf", c, 10, dt.datetime(2024, 1, 1), t) for d, c, t in (
        ("good", "huong_dan_thu_tuc", "a b c"), ("bad", "huong_dan_thu_tuc", "x y"), ("quydinh", "quy_che_hoc_vu", REGULATION),
        ("blank", "huong_dan_thu_tuc", None))]
    st.ingest_batch(spark.createDataFrame(rows, UPLOADS + ", text string"), 0, out, pipelines)
    jobs = {r.job_id: r for r in st.job_table(spark, out).collect()}
    assert {j: (r.status, r.nodes, r.edges) for j, r in jobs.items()} == {
        "good": ("completed", 3, 2), "bad": ("failed", None, None), "quydinh": ("completed", 5, 5), "blank": ("failed", None, None)}
    assert jobs["bad"].error == "KeyError: 'no heading'"
    stored = {r.id: r.props for r in writers.read_nodes(spark, f"{out}/nodes").where("label = 'Word'").collect()}
    assert stored == {w: {"n": str(i), "text": w} for i, w in enumerate("abc")}


def test_text_source_and_sections_are_recorded_and_questions_see_later_uploads(spark, tmp_path):
    out = work_folder(spark, "cascade")
    names = ("markdown", "layer", "ocr")
    text = PROGRAMME + "\n2. Khung chương trình đào tạo\nbảng"

    def send(batch_id, *docs):
        rows = [(d, d + ".pdf", c, 10, dt.datetime(2024, 1, 1), *texts, cells) for d, c, texts, cells in docs]
        schema = UPLOADS + ", markdown string, layer string, ocr string, table_rows array<array<string>>"
        st.ingest_batch(spark.createDataFrame(rows, schema), batch_id, out, candidates=names)

    course = lambda code, name, credits: [["Khối kiến thức X"] * 10, ["1", code, name, credits, "3", "", "30", "", "", ""]]
    send(0, ("toan", "chuyen_nganh_dao_tao", (" ", text, "other"), course("CT101", "Tín chỉ Giải tích", "3")),
         ("quydinh", "quy_che_hoc_vu", (None, "", REGULATION), None), ("trong", "quy_che_hoc_vu", (None, " ", ""), None))
    jobs = {r.job_id: r for r in st.job_table(spark, out).collect()}
    assert {j: (r.status, r.extraction_source, r.section_count) for j, r in jobs.items()} == {
        "toan": ("completed", "layer", 2), "quydinh": ("completed", "ocr", 2), "trong": ("failed", None, None)}
    assert jobs["toan"].extracted_text_length == len(text)

    folder = str(tmp_path / "asked")

    def ask(qid, question):
        spark.createDataFrame([(qid, question)], "qid string, text string").coalesce(1).write.mode("append").parquet(folder)
        asked = spark.readStream.schema("qid string, text string").parquet(folder).withColumn("vector", F.lit(None).cast("array<float>"))
        st.answer_stored(asked, out, f"{out}/asked").awaitTermination()
        return {r.qid: r.context for r in spark.read.parquet(f"{out}/asked/answers").collect()}

    assert ask("q1", "tín chỉ giải tích") == {"q1": "[GRAPH]\nMôn Tín chỉ Giải tích có 3 tín chỉ"}
    assert ask("q2", "tín chỉ đại số")["q2"] is None
    send(1, ("ly", "chuyen_nganh_dao_tao", (text.replace("Toán", "Lý").replace("7", "8"), None, None), course("CT102", "Tín chỉ Đại số", "4")))
    got = ask("q3", "tín chỉ đại số")
    assert got["q3"] == "[GRAPH]\nMôn Tín chỉ Đại số có 4 tín chỉ" and got["q2"] is None and "q1" in got
