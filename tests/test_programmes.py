import pytest
from pyspark.sql import functions as F

from lectern.functions import fields as fd
from lectern.operators import graph as gr
from lectern.plans import curriculum as cu

DOCUMENT = """**CHƯƠNG TRÌNH ĐÀO TẠO TRÌNH ĐỘ THẠC SĨ** (Ban hành theo Quyết định số 12/QĐ-T ngày 5 tháng 9 năm 2024
của Giám đốc về việc mở ngành)

1. Mục tiêu sớm
trước thông tin

2. Thông tin chung
Ngành: **Hóa học** (Chemistry) Mã ngành: **8440112**
Tổng cộng: 60 Thời gian đào tạo: 2,0 năm
Danh hiệu: Thạc sĩ
Hình thức đào tạo: Chính quy
Phương thức tổ chức đào tạo: kết hợp và trực tuyến
Đơn vị quản lý: Bộ môn Hóa - Khoa Tự nhiên

3. Mục tiêu đào tạo
### Mục tiêu chung
Đào tạo
người giỏi.
### Mục tiêu cụ thể
a. Biết một,
hai (PEO1); b) Biết ba. (PEO 2)

4. Chuẩn đầu ra
4.1 Kiến thức
4.1.1 Nền
a. Hiểu (PLO1);
b. Dài dòng
xuống dòng (PLO2)
4.2 Kỹ năng
- Làm
câu thường

5. Vị trí việc làm
- Giáo viên
trung học
+ Nghiên cứu

6. Tham khảo
- Luật Giáo dục 2019
- Thông tư số 8/TT ngày 1 tháng 2 năm 2021 của Bộ A ban hành quy chế
- Sách X (https://a.b/c d.pdf).
- Trang https://e.f/g h.
- Không có gì;

7. Khung chương trình
"""


@pytest.fixture(scope="module")
def graph(spark):
    docs = spark.createDataFrame([("d1", DOCUMENT)], "doc_id string, text string")
    rows = [
        ["T T", "Mã số"] + [""] * 8,
        ["Khối kiến thức A"] * 10,
        ["1", "HH 101", "Môn một (*)", "1+1+1", "3", "", "30", "", "≥ 90 TC, HH100", "HH102, XY999A"],
    ]
    table = spark.createDataFrame([("d1", i, r) for i, r in enumerate(rows)], "doc_id string, row_no bigint, cells array<string>")
    nodes, edges = cu.curriculum_graph(docs, table)
    return [r.asDict() for r in nodes.collect()], {(r.source, r.type, r.target) for r in edges.collect()}


def find(graph, label):
    return [n for n in graph[0] if n["label"] == label]


def test_programme_fields(graph):
    (p,) = find(graph, "ChuongTrinhDaoTao")
    assert p["id"] == "8440112_50_STD"
    assert p["props"]["tong_tin_chi"] == "60" and p["props"]["thoi_gian_dao_tao"] == "2.0"
    assert find(graph, "Nganh")[0]["text"] == "Hóa học (Chemistry)"
    assert find(graph, "BoMon")[0]["id"] == "HOA"
    assert find(graph, "LoaiVanBang")[0]["id"] == "MASTER"
    assert {n["id"] for n in find(graph, "PhuongThucDaoTao")} == {"KET_HOP", "DAO_TAO_TRUC_TUYEN"}
    assert ("KET_HOP", "CO_QUY_DINH", "quychehocvu") in graph[1]


def test_decision_sees_the_final_programme(graph):
    (level,) = find(graph, "TrinhDo")
    assert level["id"] == "THAC_SI"
    decision = next(n for n in find(graph, "VanBanPhapLy") if n["id"] == "12_QD_T")
    assert decision["props"]["ngay_ban_hanh"] == "05/09/2024"
    assert decision["props"]["co_quan_ban_hanh"] == "Giám đốc"
    assert decision["props"]["ten"] == "Về việc mở ngành)"
    assert ("8440112_50_STD", "DUOC_BAN_HANH_THEO", "12_QD_T") in graph[1]


def test_sections_before_the_general_one_do_not_know_the_programme(graph):
    goals = {n["id"]: n["props"]["noi_dung"] for n in find(graph, "MucTieuDaoTao")}
    assert goals["UNKNOWN_chung"] == "trước thông tin"
    assert goals["8440112_50_STD_chung"] == "Đào tạo người giỏi."
    assert goals["8440112_50_STD_PEO1"] == "Biết một, hai"
    assert goals["8440112_50_STD_PEO2"] == "Biết ba"


def test_outcomes_read_codes_on_the_item_line_only(graph):
    got = {n["id"]: (n["props"]["noi_dung"], n["props"]["nhom"], n["props"]["loai"]) for n in find(graph, "ChuanDauRa")}
    assert got == {
        "8440112_50_STD_PLO1": ("Hiểu", "Nền", "Kiến thức"),
        "8440112_50_STD_CDR_01": ("Dài dòng", "Nền", "Kiến thức"),
        "8440112_50_STD_CDR_02": ("Làm", "Chung", "Kỹ năng"),
    }


def test_outcomes_can_join_wrapped_lines(one):
    content = "4.1 K\na. Một\nhai (PLO3)\n- ba"
    got = one(fd.outcomes(F.col("a"), join_continuations=True), a=content)
    assert {(o["code"], o["noi_dung"]) for o in got} == {("PLO3", "Một hai"), ("CDR_01", "ba")}


def test_bullets_and_references(graph):
    assert [n["props"]["noi_dung"] for n in find(graph, "ViTriViecLam")] == ["Giáo viên trung học", "Nghiên cứu"]
    refs = {n["id"]: n["props"] for n in find(graph, "ChuanThamKhao")}
    assert refs["8440112_50_STD_ctk_1"]["link"] == "https://a.b/cd.pdf"
    assert refs["8440112_50_STD_ctk_1"]["noi_dung"] == "Sách X"
    assert refs["8440112_50_STD_ctk_2"]["link"] == "https://e.f/gh"
    assert refs["8440112_50_STD_ctk_3"] == {"noi_dung": "Không có gì", "link": "", "noi_dung_goc": "Không có gì;"}
    legal = {n["id"]: n["props"] for n in find(graph, "VanBanPhapLy")}
    assert legal["8_TT"]["ten"] == "Ban hành quy chế" and legal["8_TT"]["loai"] == "Thông Tư"
    assert legal["UNKNOWN"]["co_quan_ban_hanh"] == "Không xác định"


def test_courses_join_the_programme(graph):
    (course,) = find(graph, "HocPhan")
    assert course["props"]["ten_hp"] == "Môn một" and course["props"]["bat_buoc"] == "true"
    assert course["text"].endswith("số tiết lý thuyết là 30, số tiết thực hành là 0.")
    assert {e for e in graph[1] if e[0] == "HH101"} == {
        ("HH101", "YEU_CAU_TIEN_QUYET", "HH100"), ("HH101", "CO_THE_SONG_HANH", "HH102"),
        ("HH101", "CO_THE_SONG_HANH", "XY999A"),
    }
    assert ("8440112_50_STD", "CO_KHOI_KIEN_THUC", "8440112_50_STD_KHOI_KIEN_THUC_A") in graph[1]


def test_metrics_count_submitted_rows(spark):
    docs = spark.createDataFrame([("d1", DOCUMENT, "pypdf")], "doc_id string, text string, extraction_source string")
    sections = cu.sections_with_context(cu.refine(docs))
    records = cu.section_records(sections)
    nodes, edges = cu.record_nodes(records), cu.record_edges(records)
    stored = gr.resolve_endpoints(edges, nodes)
    row = cu.ingestion_metrics(docs, nodes, edges, sections, stored).first()
    assert row["extraction_source"] == "pypdf" and row["section_count"] == 8
    assert row["nodes"] == nodes.count() and row["edges"] == edges.count()
    # two regulations are not loaded, so two edges do not find both ends
    assert row["stored_edges"] == row["edges"] - 2


def test_date_digits_are_the_second_choice(one):
    words = fd.date_in_words(F.col("b"))
    assert one(fd.decision_date(words, F.col("a")), a="ngày 3/4/2020", b="") == "03/04/2020"
    assert one(fd.decision_date(words, F.col("a")), a="3-4-2020", b="ngày 1 tháng 12 năm 2021") == "01/12/2021"
    assert one(fd.decision_date(words, F.col("a")), a="", b="") == "01/01/1900"


def test_programme_metrics_parse_once(spark):
    """The same figures as from the rows, from one pass over the texts."""
    texts = ["", "không có mục nào", "1. Thông tin chung\nMã ngành: 1\n2. Mục tiêu đào tạo\nabc\n3. Chuẩn đầu ra\n- x\n- y\n4. Việc làm\n- z",
             "1. Tài liệu tham khảo\n- Thông tư số 1/TT ban hành a\n- b\n2. Thông tin chung\nĐơn vị quản lý: Khoa A\nPhương thức tổ chức đào tạo: trực tuyến"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, extraction_source string")
    sections = cu.sections_with_context(cu.refine(docs))
    records = cu.section_records(sections)
    want = cu.ingestion_metrics(docs, cu.record_nodes(records), cu.record_edges(records), sections)
    got = cu.programme_metrics(docs)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert max(r.edges for r in want.collect()) > 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_texts_and_course_rows_are_read_once(spark):
    """Nodes and edges come from written sections and rows; neither cuts the text or cleans cells again."""
    docs = spark.createDataFrame([("d1", DOCUMENT)], "doc_id string, text string")
    table = spark.createDataFrame([("d1", 1, ["a"] * 10)], "doc_id string, row_no bigint, cells array<string>")
    for frame in cu.curriculum_graph(docs, table):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "Phần|Chương|Mục" not in plan


@pytest.mark.parametrize("body", [
    "a. mot (hai) (PEO1)", " 12) x (PEOx) y ;., (PEO 23) b  (PEO4)", "zz. (PEO1) (PEO2) c) , (PEO3)", "ế. a b,,(PEO1)　",
    "a. " + "ế " * 40 + ",;. , (PEO 7) thừa a b c", "(PEO1) abc. x (PEO2)",
])
def test_parts_of_an_objective(one, body):
    """Title and code by their places in a match, as a pattern over the match reads them."""
    import re
    text = re.sub(r"\s+", " ", body + "\ncuối")
    want = [(code.replace(" ", ""), re.sub(r"[,;.]+\Z", "", title.strip()).strip())
            for title, code in re.findall(r"(?: |^)[a-z0-9]{1,2}[.)]? (.*?)\((PEO ?[0-9]+)\)", text)]
    found = one(fd.objectives(F.concat(F.lit("### cụ thể\n"), F.col("c"))), c=body + "\ncuối")
    assert [(o["key"], o["noi_dung"]) for o in found] == want
