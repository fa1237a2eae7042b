import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import regulation as rf
from lectern.operators import regulations as rg

TEXT = """Điều 1. Ban hành kèm theo Quyết định này "Quy chế X"
Chương I
QUY ĐỊNH CHUNG
17
Điều 1. Phạm vi
tiếp theo tên
1. Khoản một
nối dài
a) Xem Điều 2 Khoản 1 Điểm A
tiếp
đ) điểm đ
2. Khoản hai
Đieu 2. Đối tượng
5.5 không phải khoản
thân bài
1. theo điểm a khoản 1 Điều 1
Điều 9 xem thêm
CHƯƠNG II
CHƯƠNG III
Điều 3) không
Chương IV
1. không có điều nào mở
Điều 4 Y Xem Điều 77
Điều 1. Lặp lại theo điểm đ khoản 1 Điều 1
1. một lần nữa
"""


@pytest.fixture(scope="module")
def trees(spark):
    docs = spark.createDataFrame([(1, "quy.che.pdf", TEXT)], "doc_id bigint, file_name string, text string")
    return rg.parse_regulations(docs)


def test_tree(trees):
    reg = json.loads(trees.select(F.to_json("reg")).first()[0])
    assert [a["tieu_de"] for a in reg["quyet_dinh_ban_hanh"]["cac_dieu"]] == ['Ban hành kèm theo Quyết định này "Quy chế X"']
    assert [c["ten"] for c in reg["quy_dinh_chi_tiet"]] == ["Chương I: QUY ĐỊNH CHUNG", "CHƯƠNG II: CHƯƠNG III", "Chương IV"]
    one, two = reg["quy_dinh_chi_tiet"][0]["cac_dieu"]
    assert one["tieu_de"] == "Phạm vi tiếp theo tên" and one["full_path"] == "Chương I > Điều 1"
    assert [k["noi_dung"] for k in one["cac_khoan"]] == ["Khoản một nối dài", "Khoản hai"]
    assert [(d["ky_hieu"], d["noi_dung"]) for d in one["cac_khoan"][0]["cac_diem"]] == [
        ("a", "Xem Điều 2 Khoản 1 Điểm A tiếp"), ("đ", "điểm đ")]
    assert two["id"] == "Điều 2" and two["noi_dung"] == " 5.5 không phải khoản thân bài"
    assert two["cac_khoan"][0]["noi_dung"] == "theo điểm a khoản 1 Điều 1 Điều 9 xem thêm"
    # a line that says "xem" is no article, and nothing is open to take it in
    assert [a["id"] for a in reg["quy_dinh_chi_tiet"][2]["cac_dieu"]] == ["Điều 1"]


def test_figures(trees):
    row = rg.metrics(trees).first()
    flat = rg.flatten_trees(trees)
    assert row["nodes"] == flat.count() == 13 and row["edges"] == 12 and row["section_count"] == 4
    assert row["extracted_preview"].startswith("Điều 1 Ban hành kèm theo")
    assert trees.select(rf.document_title(F.col("reg"))).first()[0] == "Quy chế X"
    assert trees.select(rf.document_id(F.col("reg"))).first()[0] == "quy.che"


def test_citations_fall_back_and_keep_the_last_number(trees):
    flat = rg.flatten_trees(trees)
    edges = {(r.source, r.target) for r in rg.citation_edges(flat).collect()}
    again = "quy.che_ChươngIV_Dieu1"
    first = "quy.che_ChươngI_Dieu1"
    assert edges == {
        # the point is named by a capital letter, so the clause is the target
        (f"{first}_Khoan1_Diema", "quy.che_ChươngI_Dieu2_Khoan1"),
        # a lower-case point is found
        ("quy.che_ChươngI_Dieu2_Khoan1", f"{first}_Khoan1_Diema"),
    }
    # đ is no citable letter; article 4 and 77 do not exist
    assert not any(target == again for _, target in edges)


def test_unresolved_are_listed(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "Chương I\nĐiều 1. Một\n1. Xem Điều 7 Khoản 2\n2. Xem Điều 1")], "doc_id bigint, file_name string, text string")
    flat = rg.flatten_trees(rg.parse_regulations(docs))
    rows = [tuple(r) for r in rg.citation_edges(flat, keep_unresolved=True).orderBy("source").collect()]
    # lines with "Xem" inside a clause are clauses all the same
    assert rows == [
        (1, "a_ChươngI_Dieu1_Khoan1", "7", "2", None, None),
        (1, "a_ChươngI_Dieu1_Khoan2", "1", None, None, "a_ChươngI_Dieu1"),
    ]


LINES = {
    "chapter": "Chương II", "caps": "CHỮ HOA", "caps_chapter": "CHƯƠNG V", "article": "Điều 5. tên bài",
    "clause": "1. khoản", "point": "b) điểm", "plain": "lời văn", "stop": "7.7 số", "d": "đoạn văn",
}


def walk(kinds):
    """The rules one line after the other: (chapter, article, clause, point, text) owners."""
    chapters, decision, open_article, open_clause = [], [], None, None
    i, n = 0, len(kinds)
    while i < n:
        kind, text = kinds[i], LINES[kinds[i]]
        if kind in ("chapter", "caps_chapter"):
            title = text
            if i + 1 < n and kinds[i + 1] in ("caps", "caps_chapter"):
                title, i = f"{text}: {LINES[kinds[i + 1]]}", i + 1
            chapters.append((title, []))
            open_article = open_clause = None
        elif kind == "article":
            words = ["tên bài"]
            while i + 1 < n and kinds[i + 1] in ("caps", "plain"):
                words.append(LINES[kinds[i + 1]])
                i += 1
            open_article, open_clause = [" ".join(words), "", []], None
            (chapters[-1][1] if chapters else decision).append(open_article)
        elif kind == "clause" and open_article is not None:
            open_clause = ["khoản", []]
            open_article[2].append(open_clause)
        elif kind == "point" and open_clause is not None:
            open_clause[1].append("điểm")
        elif open_article is not None:
            if open_clause is None:
                open_article[1] += " " + text
            elif open_clause[1]:
                open_clause[1][-1] += " " + text
            else:
                open_clause[0] += " " + text
        i += 1
    return decision, [list(c) for c in chapters]


def test_tree_matches_a_walk_on_random_texts(spark):
    rng = random.Random(11)
    names = list(LINES)
    docs = [[rng.choice(names) for _ in range(30)] for _ in range(120)]
    df = spark.createDataFrame(
        [(i, "f.pdf", "\n".join(LINES[k] for k in kinds)) for i, kinds in enumerate(docs)],
        "doc_id bigint, file_name string, text string",
    )
    for row in rg.parse_regulations(df).select("doc_id", F.to_json("reg").alias("j")).collect():
        reg = json.loads(row["j"])
        shape = lambda articles: [
            [a["tieu_de"], a["noi_dung"], [[k["noi_dung"], [d["noi_dung"] for d in k["cac_diem"]]] for k in a["cac_khoan"]]]
            for a in articles
        ]
        got = shape(reg["quyet_dinh_ban_hanh"]["cac_dieu"]), [[c["ten"], shape(c["cac_dieu"])] for c in reg["quy_dinh_chi_tiet"]]
        want = walk(docs[row["doc_id"]])
        assert got == (want[0], want[1]), docs[row["doc_id"]]


def test_texts_are_parsed_once_for_citations(spark):
    docs = spark.createDataFrame([(1, "q.pdf", "Chương I\nA\nĐiều 1. x\n1. Xem Điều 2\nĐiều 2. y")], "doc_id long, file_name string, text string")
    edges = rg.citation_edges(rg.flatten_trees(rg.parse_regulations(docs)))
    assert "regexp_replace" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 1
