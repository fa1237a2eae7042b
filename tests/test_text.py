import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import sections as sc
from lectern.functions import text as tx

A = F.col


@pytest.mark.parametrize("raw, want", [
    ("3922/QĐ-ĐHCT", "3922_QD_DHCT"),
    (unicodedata.normalize("NFD", "Mạng máy tính và TT"), "MANG_MAY_TINH_VA_TT"),
    ("--đ Ự--", "D_U"),
    ("", ""),
])
def test_slug_id(one, raw, want):
    assert one(tx.slug_id(A("a")), a=raw) == want


def test_match_key_folds_case_accents_and_space(one):
    assert one(tx.match_key(A("a")), a=" Chuẩn  ĐẦU\tra ") == "chuan dau ra"


@pytest.mark.parametrize("raw, want", [
    ("**1.** Mở đầu", "## 1 Mở đầu"),
    ("2.3 Tên mục", "### 2.3 Tên mục"),
    ("1.2.3.4.5.6.7 Sâu", "###### 1.2.3.4.5.6.7 Sâu"),
    ("IV. Kết luận", "## IV Kết luận"),
    ("Phần 3.1 Nội dung", "## 3.1 Nội dung"),
    ("1. Đây là một câu văn dài hơn ba mươi ký tự.", "1. Đây là một câu văn dài hơn ba mươi ký tự."),
    ("1. Ngắn.", "## 1 Ngắn."),
    ("1. " + "x" * 101, "1. " + "x" * 101),
    ("  thường  ", "thường"),
    ("1.", "1."),
])
def test_heading_lines(one, raw, want):
    assert one(tx.upgrade_headings(A("a")), a=raw) == want
    assert one(tx.refine(A("a")), a=raw) == want.replace("**", "")


def test_emphasis_is_removed_within_lines_only(one):
    raw = "***a*** **b** __c__ *d* _e_ http://x/a_b_c\n*open\nclose*"
    want = "a b c d e http://x/abc\n*open\nclose*"
    assert one(tx.remove_emphasis(A("a")), a=raw) == want
    assert one(tx.refine(A("a")), a=raw) == want


def test_numbers_fall_back(one):
    assert one(tx.safe_int(A("a")), a=" 12\n") == 12
    assert one(tx.safe_int(A("a"), 7), a="1+1+1") == 7
    assert one(tx.safe_float(A("a")), a="4,5") == 4.5
    assert one(tx.safe_float(A("a")), a="x") == 0.0


@pytest.mark.parametrize("n, want", [
    ("0", "0 Bytes"), ("1023", "1023 Bytes"), ("1024", "1 KB"), ("1536", "1.5 KB"), ("1048576", "1 MB"),
    ("52428800", "50 MB"), ("1099511627776", "1 TB"),
])
def test_format_bytes(one, n, want):
    assert one(tx.format_bytes(A("a").cast("bigint")), a=n) == want


def test_stored_file_name_is_repeatable(one):
    name = tx.stored_file_name(A("a"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    first = one(name, a="dir/Quy.che.PDF")
    assert first == one(name, a="dir/Quy.che.PDF")
    assert first.startswith("Quy.che_20240102_030405_") and first.endswith(".pdf")


def test_lookalike_letters(one):
    assert one(tx.fix_lookalikes(A("a")), a=" Chương IШ І ХⅤ ") == "Chương III I XV"


def test_first_nonblank_keeps_the_order(spark):
    rows = spark.createDataFrame([(" ", None, "c"), (None, "b", "c"), (None, "", " ")], "x string, y string, z string")
    text, name = tx.first_nonblank([("x", A("x")), ("y", A("y")), ("z", A("z"))])
    assert [tuple(r) for r in rows.select(text, name).collect()] == [("c", "z"), ("b", "y"), (None, None)]


def test_sections_fold_under_numbered_headings(one):
    md = "đầu\n# Trường\nx\n## II La Mã\ny\n## 1 Một\na\n### 1.1 Con\nb\n## 2 Hai"
    got = one(sc.sections(A("a")), a=md)
    assert got == ["đầu", "# Trường\nx", "## II La Mã\ny", "## 1 Một\na\n\n### 1.1 Con\nb", "## 2 Hai"]
    assert one(sc.sections(A("a")), a="## 1 Một\na") == ["## 1 Một\na"]
    assert one(sc.sections(A("a")), a=" \n") == []


@pytest.mark.parametrize("header, want", [
    ("## 2 MỤC TIÊU đào tạo", "MUC_TIEU"), ("## 3 chuan dau ra (PLOs)", "CHUAN_DAU_RA"),
    ("## 4 Vị trí việc làm", "VI_TRI_VIEC_LAM"), ("## 9 Phụ lục", "UNKNOWN"),
])
def test_concepts(one, header, want):
    assert one(sc.concept_of(A("a")), a=header) == want


def test_fenced_block_and_json_object(one):
    raw = "x ```cypher\nMATCH (a)\n``` y {\"k\": {\"z\": 1}} end"
    assert one(tx.fenced_block(A("a"), "cypher"), a=raw) == "MATCH (a)"
    assert one(tx.json_object(A("a")), a=raw) == '{"k": {"z": 1}}'
    assert one(tx.fenced_block(A("a"), "sql"), a=raw) is None


@pytest.mark.parametrize("inside", ["", "x", "ế", "a b", "😀", "x" * 40, "ế" * 20, "a　" * 30 + "z", "​"])
def test_strip_at_long_ends(spark, inside):
    """Ends that are cut by bytes, also where the cut falls inside a character."""
    rows = [(w * n + inside + w * m,) for w in (" ", "\n", "\xa0", " ", "　", "　\n") for n in (0, 1, 40) for m in (0, 1, 9, 10, 11, 31, 32, 33, 90)]
    df = spark.createDataFrame(rows, "t string")
    for text, got, end in df.select("t", tx.strip(F.col("t")), tx.strip_end(F.col("t"), " \n")).collect():
        assert got == text.strip() and end == text.rstrip(" \n")


def test_collapse_of_uneven_runs(one):
    for text in ("a b", "a  b", " a", "a\t b ", "\n", "a　b", "a 　\x1c b  c d", "", "   "):
        assert one(tx.collapse(F.col("c")), c=text) == "".join(" " if k else g for k, g in _runs(text))


def _runs(text):
    import itertools
    return [(k, "".join(g)) for k, g in itertools.groupby(text, str.isspace)]
