"""Inputs of the domain operators, derived from the driver tables row by row.

The driver texts are prose, so documents of the expected shapes are written from
them inside Spark: each document row gives one programme, one course table and
one regulation. No grouping is involved; a long text gives a long document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, one file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their non-blank lines, reduced to letters and single spaces."""
    return lines_of(spread(table(spark, sf_dir, "documents"), "doc_id"))


def lines_of(documents: DataFrame) -> DataFrame:
    letters = F.regexp_replace("text", r"[^\p{L}\n ]", "")
    lines = F.transform(
        F.split(letters, "\n"), lambda x: F.trim(F.regexp_replace(x, "  +", " "))
    )
    return documents.select(
        "doc_id", "lang", "source", "n_chars", F.filter(lines, lambda x: x != "").alias("ls")
    )


# The same lines in SQL, for the oracles.
LINES_SQL = r"""
raw_lines as (
  select doc_id, lang, source, n_chars,
         string_split(regexp_replace(text, '[^\p{L}\n ]', '', 'g'), chr(10)) as all_lines
  from documents
),
docs as (
  select doc_id, lang, source, n_chars,
         list_filter(list_transform(all_lines, lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))),
                     lambda x: x <> '') as ls
  from raw_lines
),
lines as (
  select doc_id, lang, source, n_chars, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from docs
)
"""


def _every(step: int, at: int) -> Column:
    return F.filter("ls", lambda x, i: i % step == at)


DEGREE_NAMES = ("Cử nhân", "Kỹ sư", "Thạc sĩ", "Tiến sĩ", "Khác")


def programme_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: Markdown of one study programme per document row."""
    return document_lines(spark, sf_dir).select("doc_id", programme_text().alias("text"))


def programme_text() -> Column:
    """Markdown of one study programme from the columns of ``document_lines``."""
    jobs, study, outs, refs = (_every(4, at) for at in range(4))
    first = F.coalesce(F.get("ls", F.lit(0)), F.lit("khong"))
    degree = F.element_at(F.array(*[F.lit(n) for n in DEGREE_NAMES]), (F.col("doc_id") % 5 + 1).cast("int"))
    year = F.col("doc_id") % 40 + 1980

    def outcome(x: Column, j: Column) -> Column:
        return F.when(j % 3 == 0, _lit("a. ", x, " (PLO", j + 1, ")")).otherwise(_lit("- ", x))

    marked = F.transform(outs, lambda x, j: F.struct(j.alias("j"), outcome(x, j).alias("t")))
    half = lambda at: F.transform(F.filter(marked, lambda m: m["j"] % 2 == at), lambda m: m["t"])

    def reference(x: Column, r: Column) -> Column:
        return (
            F.when(r % 3 == 0, _lit("- Thông tư số ", F.col("doc_id"), "-", r, "/TT ngày 3 tháng 4 năm 2021 của Bộ ",
                                    F.col("lang"), " ban hành ", x))
            .when(r % 3 == 1, _lit("- ", x, " (https://ex.org/", F.col("doc_id"), "/", r, ")."))
            .otherwise(_lit("- ", x))
        )

    bullet = lambda items: F.transform(items, lambda x: _lit("- ", x))
    one = lambda *parts: F.array(_lit(*parts))
    unit = F.when(F.col("doc_id") % 2 == 0, F.lit("Khoa ")).otherwise(F.lit("Bộ môn "))
    quality = F.when(F.col("doc_id") % 3 == 0, F.lit("Chương trình chất lượng cao")).otherwise(F.lit(""))
    return F.array_join(
        F.concat(
            one("# **CHƯƠNG TRÌNH ĐÀO TẠO TRÌNH ĐỘ ĐẠI HỌC** (Ban hành theo Quyết định số ", F.col("doc_id"),
                "/QĐ-", F.upper("source"), " ngày 5 tháng 8 năm ", year, " của Hiệu trưởng ban hành bản ",
                F.col("lang"), ")"),
            one(""),
            one("**1. Thông tin chung**"),
            one("Ngành: **Nganh ", F.col("source"), "** (Major ", F.col("lang"), ") Mã ngành: **",
                F.col("doc_id") + 7000000, "**"),
            one("Số lượng tín chỉ: ", F.col("n_chars") % 80 + 100,
                " tín chỉ Thời gian đào tạo: 4,5 năm Loại văn bằng: ", degree),
            one("Hình thức đào tạo: Chính quy, Vừa làm vừa học và Từ xa"),
            one("Phương thức tổ chức đào tạo: trực tiếp và trực tuyến"),
            one("Đơn vị quản lý: ", unit, F.col("source"), ", Truong"),
            F.array(quality),
            one("2. Mục tiêu đào tạo"),
            one("2.1 Mục tiêu chung"),
            F.array(first),
            one("2.2 Mục tiêu cụ thể"),
            F.transform("ls", lambda x, i: _lit(F.when(i % 2 == 0, F.lit("a. ")).otherwise(F.lit("b ")), x,
                                                ", (PEO", i + 1, ");")),
            one("3. Chuẩn đầu ra"),
            one("3.1 Kiến thức"), one("3.1.1 Đại cương"), half(0), one("3.2 Kỹ năng"), half(1),
            one("4. Vị trí việc làm"), bullet(jobs),
            one("5. Khả năng học tập"), bullet(study),
            one("6. Tài liệu tham khảo"), F.transform(refs, reference),
            one("7. Khung chương trình đào tạo"),
        ),
        "\n",
    )


def course_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, row_no, cells)``: each line of a document becomes a course-table row."""
    d = document_lines(spark, sf_dir)
    blank = F.lit("")

    def cells(x: Column, i: Column) -> Column:
        kind = i % 8
        code = _lit("CT", F.lpad(((F.col("doc_id") * 7 + i) % 1000).cast("string"), 3, "0"))
        pre = _lit("CT", F.lpad((i % 1000).cast("string"), 3, "0"), ", ≥ 90 TC")
        block = _lit("Khối kiến thức ", F.floor(i / 8) % 3)
        total = _lit("Cộng: ", i + 10, " TC (Bắt buộc ", i, " TC; Tự chọn: 10 TC)")
        ten = lambda *c: F.array(*c)
        course = lambda comp, elec, hp=code: ten(
            i.cast("string"), hp, _lit(x, " (*)"), F.lit("3"), F.lit(comp), F.lit(elec), F.lit("30"), blank, pre,
            F.lit("TN01"),
        )
        return (
            F.when(i == 0, ten(F.lit("T T"), F.lit("Mã số"), F.lit("Tên học phần"), *[blank] * 7))
            .when(kind == 0, ten(F.lit("T T"), F.lit("Mã số"), x, *[blank] * 7))
            .when(kind == 1, ten(*[block] * 10))
            .when(kind == 2, course("3", ""))
            .when(kind == 3, course("AV", "10 A"))
            .when(kind == 4, course("", ""))
            .when(kind == 5, course("", "6 B"))
            .when(kind == 6, course("2", "", F.concat(code, F.lit(" CS"), F.lit("200E"))))
            .otherwise(ten(total, *[blank] * 9))
        )

    return d.select("doc_id", F.posexplode(F.transform("ls", cells)).alias("row_no", "cells")).select(
        "doc_id", F.col("row_no").cast("bigint").alias("row_no"), "cells"
    )


ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
PERIOD = 16


def regulation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, file_name, text)``: each line of a document becomes a line of a regulation."""
    return document_lines(spark, sf_dir).select(
        "doc_id", _lit("qd", F.col("doc_id"), ".pdf").alias("file_name"), regulation_text().alias("text")
    )


def regulation_text() -> Column:
    roman = F.array(*[F.lit(r) for r in ROMAN])

    def line(x0: Column, i: Column) -> Column:
        x = F.replace(x0, F.lit("ß"), F.lit("ss"))
        n = F.floor(i / 4) + 1
        options = [
            _lit("Chương ", F.element_at(roman, (F.floor(i / PERIOD) % 10 + 1).cast("int"))),
            F.upper(x),
            _lit("Điều ", n, ". ", x),
            _lit("tiếp ", x),
            _lit("1. ", x),
            x,
            _lit("a) ", x),
            _lit("nối ", x),
            i.cast("string"),
            _lit("b) Xem Điều ", F.floor(i / 8) + 1, " Khoản 1 Điểm a ", x),
            _lit("2. theo điểm A khoản 1 Điều ", i % 7 + 1, " ", x),
            _lit("Đieu ", n, " ", x),
            x,
            _lit("5.5 Xem Điều ", i % 5 + 1, " Khoản 9 ", x),
            _lit("Điều 3 xem ", x),
            _lit("đ) ", x),
        ]
        chain = F
        for at, text in enumerate(options):
            chain = chain.when(i % PERIOD == at, text)
        return chain

    return F.array_join(F.transform("ls", line), "\n")


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the trade tables: parts as courses, customers, suppliers, nations."""
    part, customer, supplier, nation, lineitem = (
        table(spark, sf_dir, n) for n in ("part", "customer", "supplier", "nation", "lineitem")
    )
    string = lambda c: F.col(c).cast("string")

    def node(df: DataFrame, label: str, mark: str, key: str, **props: Column) -> DataFrame:
        entries = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))])
        return df.select(
            F.lit(label).alias("label"), _lit(mark, F.col(key)).alias("id"),
            F.lit(None).cast("string").alias("text"), entries.alias("props"),
            F.lit("").alias("doc_id"), F.col(key).cast("bigint").alias("seq"),
        )

    nodes = [
        node(part, "HocPhan", "P", "p_partkey",
             ten_hp=F.concat_ws(" ", "p_name", "p_brand", string("p_partkey")),
             ma_hp=_lit("CT", F.col("p_partkey")), so_tin_chi=F.col("p_size")),
        node(customer, "ChuongTrinhDaoTao", "C", "c_custkey", ten=F.col("c_name"),
             khoa=F.col("c_custkey") % 50, tong_tin_chi=F.floor("c_acctbal")),
        node(supplier, "KhoiKienThuc", "S", "s_suppkey", ten=F.col("s_name"), ten_khoi=F.col("s_name")),
        node(nation, "Nganh", "N", "n_nationkey", ten_nganh_vi=F.col("n_name")),
    ]

    def edge(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
        return df.select(source.alias("source"), F.lit(kind).alias("type"), target.alias("target"))

    edges = [
        edge(customer, "THUOC_VE", _lit("C", F.col("c_custkey")), _lit("N", F.col("c_nationkey"))),
        edge(supplier, "THUOC_VE", _lit("S", F.col("s_suppkey")), _lit("N", F.col("s_nationkey"))),
        edge(lineitem.select("l_partkey", "l_suppkey").distinct(), "YEU_CAU_TIEN_QUYET",
             _lit("P", F.col("l_partkey")), _lit("P", F.col("l_suppkey"))),
    ]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(nodes), union(edges)


NODES_SQL = """
nodes as (
  select 'HocPhan' as label, 'P' || p_partkey as id, p_name || ' ' || p_brand || ' ' || p_partkey as ten_hp,
         p_size as so_tin_chi, null as ten from part
  union all select 'ChuongTrinhDaoTao', 'C' || c_custkey, null, null, c_name from customer
  union all select 'KhoiKienThuc', 'S' || s_suppkey, null, null, s_name from supplier
  union all select 'Nganh', 'N' || n_nationkey, null, null, null from nation
)
"""
EDGES_SQL = """
edges as (
  select 'C' || c_custkey as source, 'THUOC_VE' as type, 'N' || c_nationkey as target from customer
  union all select 'S' || s_suppkey, 'THUOC_VE', 'N' || s_nationkey from supplier
  union all select distinct 'P' || l_partkey, 'YEU_CAU_TIEN_QUYET', 'P' || l_suppkey from lineitem
)
"""
