"""Programme documents: sections, fields and graph rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sections as sc
from ..operators import graph as gr
from ..plans import curriculum as cu
from .courses import TABLE_SQL
from .derive import LINES_SQL, course_rows, document_lines, programme_documents


def _sections(spark, d):
    return cu.sections_with_context(cu.refine(programme_documents(spark, d)))


def _records(spark, d, *types, join_continuations=False):
    """Nodes made by the sections of some types."""
    return cu.section_records(_sections(spark, d), join_continuations, types)


def _flat(records, *keys):
    return records.select("doc_id", "label", "id", "text", *[F.col("props")[k].alias(k) for k in keys])


def section_list(spark, d):
    return _sections(spark, d).where(F.col("type") != cu.DECISION).select(
        "doc_id", "section_no", "type", "header", F.length("content").alias("chars")
    )


def section_context(spark, d):
    """Sections before the general one see no programme; the decision sees the last."""
    docs = programme_documents(spark, d)
    # The objectives move in front of the general information.
    moved = docs.withColumn("text", F.concat(
        F.lit("1. Mục tiêu đào tạo\nđầu\n"), F.replace("text", F.lit("2. Mục tiêu đào tạo\n"), F.lit("2. Phần khác\n"))
    ))
    return cu.sections_with_context(cu.refine(moved)).select(
        "doc_id", "section_no", "type", "program_id", "ten_nganh", "loai_hinh"
    )


def prose_sections(spark, d):
    """Folding on the driver's own prose: capital openings stand in for headings."""
    docs = document_lines(spark, d)
    text = F.array_join("ls", "\n")
    folded = sc.sections(text, r"(?md)^(?=[A-C])", r"(?md)^(?=A)")
    return docs.select("doc_id", F.posexplode(folded).alias("section_no", "s")).select(
        "doc_id", "section_no", F.length("s").alias("chars"), F.md5("s").alias("digest")
    )


def general_nodes(spark, d):
    return _flat(
        _records(spark, d, "THONG_TIN_CHUNG").where("label in ('ChuongTrinhDaoTao', 'Nganh')"),
        "ma_chuong_trinh", "khoa", "loai_hinh", "ngon_ngu", "tong_tin_chi", "thoi_gian_dao_tao",
        "ten_nganh_vi", "ten_nganh_en",
    )


def general_lists(spark, d):
    return _flat(
        _records(spark, d, "THONG_TIN_CHUNG").where("label not in ('ChuongTrinhDaoTao', 'Nganh')"),
        "ten_khoa", "ten_bomon", "loai_van_bang", "ten_hinh_thuc", "ten_phuong_thuc",
    )


def objectives(spark, d):
    return _flat(_records(spark, d, "MUC_TIEU"), "loai", "noi_dung")


def outcomes(spark, d):
    return _flat(_records(spark, d, "CHUAN_DAU_RA"), "noi_dung", "nhom", "loai")


def opportunities(spark, d):
    return _flat(_records(spark, d, "VI_TRI_VIEC_LAM", "KHA_NANG_HOC_TAP"), "loai", "noi_dung")


def legal_references(spark, d):
    return _flat(
        _records(spark, d, "THAM_KHAO").where("label = 'VanBanPhapLy'"),
        "so", "ten", "loai", "ngay_ban_hanh", "co_quan_ban_hanh", "noi_dung_goc",
    )


def other_references(spark, d):
    return _flat(
        _records(spark, d, "THAM_KHAO").where("label = 'ChuanThamKhao'"), "noi_dung", "link", "noi_dung_goc"
    )


def decisions(spark, d):
    return _flat(
        _records(spark, d, cu.DECISION),
        "so", "ten", "loai", "ngay_ban_hanh", "co_quan_ban_hanh", "ten_trinh_do",
    )


def edge_counts(spark, d):
    records = cu.section_records(_sections(spark, d))
    return cu.record_edges(records).groupBy("type").agg(
        F.count("*").alias("edges"), F.count_distinct("source", "target").alias("pairs")
    )


def graph_labels(spark, d):
    """The whole plan: documents and tables to merged nodes, counted by label."""
    nodes, _ = cu.curriculum_graph(programme_documents(spark, d), course_rows(spark, d))
    merged = gr.upsert_nodes(gr.unify_nodes(nodes))
    return merged.groupBy("label").agg(F.count("*").alias("nodes"))


def metrics(spark, d):
    docs = programme_documents(spark, d).withColumn("extraction_source", F.lit("pymupdf4llm"))
    return cu.programme_metrics(docs).select(
        "doc_id", "nodes", "edges", "section_count", "extracted_text_length", "extraction_source"
    )


QUERIES = {
    "programme_sections": section_list,
    "programme_section_context": section_context,
    "prose_section_fold": prose_sections,
    "programme_general_nodes": general_nodes,
    "programme_general_lists": general_lists,
    "programme_objectives": objectives,
    "programme_outcomes": outcomes,
    "programme_opportunities": opportunities,
    "programme_legal_references": legal_references,
    "programme_other_references": other_references,
    "programme_decisions": decisions,
    "programme_edge_counts": edge_counts,
    "programme_graph_labels": graph_labels,
    "programme_metrics": metrics,
}

_BASE = f"""
with {LINES_SQL},
p as (
  select *, doc_id + 7000000 as code, doc_id % 40 + 6 as cohort, (doc_id % 3 = 0) as clc,
         'Nganh ' || source || ' (Major ' || lang || ')' as nganh,
         case when doc_id % 3 = 0 then 'Chất lượng cao' else 'Đại trà' end as hinh,
         (doc_id + 7000000) || '_' || (doc_id % 40 + 6) || '_' || case when doc_id % 3 = 0 then 'CLC' else 'STD' end as program_id,
         list_extract(['Cử nhân', 'Kỹ sư', 'Thạc sĩ', 'Tiến sĩ', 'Khác'], doc_id % 5 + 1) as degree
  from docs
),
items as (
  select p.doc_id, p.program_id, p.nganh, p.hinh, p.lang, l.line, l.i % 4 as kind,
         row_number() over (partition by p.doc_id, l.i % 4 order by l.i) - 1 as j
  from p join lines l on l.doc_id = p.doc_id
),
out_items as (
  select *, case when j % 3 = 0 then 'PLO' || (j + 1) end as own_code,
         case when j % 2 = 0 then 'Đại cương' else 'Chung' end as nhom,
         case when j % 2 = 0 then 'Kiến thức' else 'Kỹ năng' end as loai
  from items where kind = 2
),
numbered as (
  select *, (sum(case when own_code is null then 1 else 0 end) over (partition by doc_id order by j % 2, j)) || '' as n
  from out_items
),
-- At least two digits; lpad would cut the third.
coded as (select *, coalesce(own_code, 'CDR_' || case when length(n) < 2 then '0' else '' end || n) as code from numbered),
refs as (
  select *, case when j % 3 = 0 then 'Thông tư số ' || doc_id || '-' || j || '/TT ngày 3 tháng 4 năm 2021 của Bộ ' || lang
                      || ' ban hành ' || line
                 when j % 3 = 1 then line || ' (https://ex.org/' || doc_id || '/' || j || ').'
                 else line end as ref
  from items where kind = 3
)
"""
_NO_ITEMS = """
  select doc_id, program_id, nganh, hinh, '' as line, {kind} as kind, 0 as j from p
  where not exists (select 1 from items x where x.doc_id = p.doc_id and x.kind = {kind})
"""
# A list without items is one empty item.
_OPPORTUNITIES = f"""
, opp as (
  select doc_id, program_id, nganh, hinh, line, kind, j from items where kind in (0, 1)
  union all {_NO_ITEMS.format(kind=0)} union all {_NO_ITEMS.format(kind=1)}
),
refs_all as (
  select doc_id, program_id, nganh, hinh, j, ref from refs
  union all select doc_id, program_id, nganh, hinh, 0, '' from p
  where not exists (select 1 from items x where x.doc_id = p.doc_id and x.kind = 3)
)
"""
_LEGAL = " j % 3 = 0 and ref <> '' "
_LIST_ROWS = """
, forms as (select *, unnest(['Chính quy', 'Vừa làm vừa học', 'Từ xa']) as f,
                   unnest(['CHINH_QUY', 'VUA_LAM_VUA_HOC', 'TU_XA']) as fid from p),
methods as (select *, unnest(['trực tiếp', 'trực tuyến']) as m,
                   unnest(['DAO_TAO_TRUC_TIEP', 'DAO_TAO_TRUC_TUYEN']) as mid from p)
"""
_SECTION_HEADERS = """
, secs as (
  select doc_id, lang, source, cohort,
    unnest(range(8)) as section_no,
    unnest(['UNKNOWN', 'THONG_TIN_CHUNG', 'MUC_TIEU', 'CHUAN_DAU_RA', 'VI_TRI_VIEC_LAM', 'KHA_NANG_HOC_TAP',
            'THAM_KHAO', 'KHUNG_CHUONG_TRINH']) as type,
    unnest(['# CHƯƠNG TRÌNH ĐÀO TẠO TRÌNH ĐỘ ĐẠI HỌC (Ban hành theo Quyết định số ' || doc_id || '/QĐ-' || upper(source)
              || ' ngày 5 tháng 8 năm ' || (cohort + 1974) || ' của Hiệu trưởng ban hành bản ' || lang || ')',
            '## 1 Thông tin chung', '## 2 Mục tiêu đào tạo', '## 3 Chuẩn đầu ra', '## 4 Vị trí việc làm',
            '## 5 Khả năng học tập', '## 6 Tài liệu tham khảo', '## 7 Khung chương trình đào tạo']) as header
  from p
)
"""
_TEXT_LENGTH = """
, peo as (
  select doc_id, string_agg((case when i % 2 = 0 then 'a. ' else 'b ' end) || line || ', (PEO' || (i + 1) || ');', chr(10) order by i) as t
  from lines group by doc_id
)
"""
_ALL_EDGES = _BASE + _OPPORTUNITIES + _LIST_ROWS + """
, submitted as (
  select doc_id, code || '' as source, 'THUOC_VE' as type,
         case when strlen(source) > 0 then upper(source) end as target from p
  union all select doc_id, program_id, 'THUOC_VE', code || '' from p
  union all select doc_id, program_id, 'CO_LOAI_VAN_BANG',
         list_extract(['BACHELOR', 'ENGINEER', 'MASTER', 'DOCTOR', 'OTHER'], doc_id % 5 + 1) from p
  union all select doc_id, program_id, 'DAO_TAO_THEO_HINH_THUC', fid from forms
  union all select doc_id, program_id, 'DAO_TAO_THEO_PHUONG_THUC', mid from methods
  union all select doc_id, mid, 'CO_QUY_DINH',
         case when mid = 'DAO_TAO_TRUC_TUYEN' then 'quydinhdaotaotructuyen' else 'quychehocvu' end from methods
  union all select doc_id, program_id, 'CO_MUC_TIEU_DAO_TAO', program_id || '_chung' from p
  union all select l.doc_id, program_id, 'CO_MUC_TIEU_DAO_TAO', program_id || '_PEO' || (l.i + 1)
         from lines l join p on p.doc_id = l.doc_id
  union all select doc_id, program_id, 'DAT_CHUAN_DAU_RA', program_id || '_' || code from coded
  union all select doc_id, program_id, case when kind = 0 then 'CO_CO_HOI_VIEC_LAM' else 'TAO_NEN_TANG' end,
         program_id || case when kind = 0 then '_vtvl_' else '_knht_' end || (j + 1) from opp
  union all select doc_id, program_id, 'TUAN_THU', doc_id || '_' || j || '_TT' from refs_all where """ + _LEGAL + """
  union all select doc_id, program_id, 'THAM_CHIEU', program_id || '_ctk_' || j from refs_all where not (""" + _LEGAL + """)
  union all select doc_id, program_id, 'DUOC_BAN_HANH_THEO', doc_id || '_QD_' || upper(source) from p
  union all select doc_id, program_id, 'DAO_TAO_TRINH_DO', 'DAI_HOC' from p
)
"""
SQL = {
    "programme_section_context": _BASE + """
, secs as (
  select *, unnest(range(9)) as section_no,
    unnest(['MUC_TIEU', 'UNKNOWN', 'THONG_TIN_CHUNG', 'UNKNOWN', 'CHUAN_DAU_RA', 'VI_TRI_VIEC_LAM', 'KHA_NANG_HOC_TAP',
            'THAM_KHAO', 'KHUNG_CHUONG_TRINH']) as type
  from p
)
select doc_id, case when section_no = 0 then 0 else section_no - 1 end as section_no, type,
       case when section_no <= 2 then 'UNKNOWN' else program_id end as program_id,
       case when section_no <= 2 then 'UNKNOWN' else nganh end as ten_nganh,
       case when section_no <= 2 then 'UNKNOWN' else hinh end as loai_hinh
from secs where section_no <> 1
union all select doc_id, 8, 'QUYET_DINH', program_id, nganh, hinh from p
""",
    "prose_section_fold": f"""
with {LINES_SQL},
starts as (select *, substr(line, 1, 1) in ('A', 'B', 'C') as part_start, substr(line, 1, 1) = 'A' as sec_start from lines),
part_no as (
  select *, sum(case when part_start then 1 else 0 end) over w as p, sum(case when sec_start then 1 else 0 end) over w as s
  from starts window w as (partition by doc_id order by i)
),
parts as (select doc_id, s, p, string_agg(line, chr(10) order by i) as t from part_no group by doc_id, s, p),
folded as (
  select doc_id, s, case when s = 0 then p else 0 end as p, string_agg(t, chr(10) || chr(10) order by p) as t
  from parts group by doc_id, s, case when s = 0 then parts.p else 0 end
)
select doc_id, row_number() over (partition by doc_id order by s, p) - 1 as section_no, length(t) as chars, md5(t) as digest
from folded
""",
    "programme_sections": _BASE + _OPPORTUNITIES + _SECTION_HEADERS + """
, chars as (
  select s.doc_id, s.section_no, s.type, s.header, case s.section_no
    when 0 then 0
    when 7 then 0
    when 1 then length('Ngành: Nganh ' || p.source || ' (Major ' || p.lang || ') Mã ngành: ' || p.code || chr(10)
      || 'Số lượng tín chỉ: ' || (p.n_chars % 80 + 100) || ' tín chỉ Thời gian đào tạo: 4,5 năm Loại văn bằng: ' || p.degree || chr(10)
      || 'Hình thức đào tạo: Chính quy, Vừa làm vừa học và Từ xa' || chr(10)
      || 'Phương thức tổ chức đào tạo: trực tiếp và trực tuyến' || chr(10)
      || 'Đơn vị quản lý: ' || case when p.doc_id % 2 = 0 then 'Khoa ' else 'Bộ môn ' end || p.source || ', Truong'
      || case when p.clc then chr(10) || 'Chương trình chất lượng cao' else '' end)
    when 2 then length('### 2.1 Mục tiêu chung' || chr(10) || coalesce(p.ls[1], 'khong') || chr(10) || chr(10) || '### 2.2 Mục tiêu cụ thể')
      + coalesce((select sum(length(case when l.i % 2 = 0 then 'a. ' else 'b ' end || l.line || ', (PEO' || (l.i + 1) || ');') + 1)
                  from lines l where l.doc_id = s.doc_id), 0)
    when 3 then length('### 3.1 Kiến thức' || chr(10) || chr(10) || '#### 3.1.1 Đại cương' || chr(10) || chr(10) || '### 3.2 Kỹ năng')
      + coalesce((select sum(length(case when o.j % 3 = 0 then 'a. ' || o.line || ' (PLO' || (o.j + 1) || ')' else '- ' || o.line end) + 1)
                  from out_items o where o.doc_id = s.doc_id), 0)
    when 4 then coalesce((select sum(length('- ' || x.line) + 1) - 1 from items x where x.doc_id = s.doc_id and x.kind = 0), 0)
    when 5 then coalesce((select sum(length('- ' || x.line) + 1) - 1 from items x where x.doc_id = s.doc_id and x.kind = 1), 0)
    when 6 then coalesce((select sum(length('- ' || r.ref) + 1) - 1 from refs r where r.doc_id = s.doc_id), 0)
  end as chars
  from secs s join p on p.doc_id = s.doc_id
)
select doc_id, section_no, type, header, cast(chars as bigint) as chars from chars
""",
    "programme_general_nodes": _BASE + """
select doc_id || '' as doc_id, 'Nganh' as label, code || '' as id, nganh as text, null as ma_chuong_trinh, null as khoa,
       null as loai_hinh, null as ngon_ngu, null as tong_tin_chi, null as thoi_gian_dao_tao,
       'Nganh ' || source as ten_nganh_vi, 'Major ' || lang as ten_nganh_en from p
union all
select doc_id || '', 'ChuongTrinhDaoTao', program_id,
       'Chương trình đào tạo ngành ' || nganh || ' khóa ' || cohort || ', loại hình ' || hinh || '. Tổng số tín chỉ yêu cầu: '
       || (n_chars % 80 + 100) || '. Thời gian đào tạo: 4.5 năm. Ngôn ngữ giảng dạy: '
       || case when clc then 'Tiếng Anh' else 'Tiếng Việt' end || '.',
       program_id, cohort || '', hinh, case when clc then 'Tiếng Anh' else 'Tiếng Việt' end, (n_chars % 80 + 100) || '', '4.5',
       null, null from p
""",
    "programme_general_lists": _BASE + _LIST_ROWS + """
select doc_id || '' as doc_id, case when doc_id % 2 = 0 then 'Khoa' else 'BoMon' end as label, upper(source) as id,
       'Ngành ' || nganh || ' thuộc ' || case when doc_id % 2 = 0 then 'Khoa: ' || source else 'Bộ môn: ' || source || ', Truong' end as text,
       case when doc_id % 2 = 0 then source end as ten_khoa, case when doc_id % 2 = 1 then source || ', Truong' end as ten_bomon,
       null as loai_van_bang, null as ten_hinh_thuc, null as ten_phuong_thuc
from p where doc_id % 2 = 0
union all
select doc_id || '', 'BoMon', upper(source) || '_TRUONG', 'Ngành ' || nganh || ' thuộc Bộ môn: ' || source || ', Truong',
       null, source || ', Truong', null, null, null from p where doc_id % 2 = 1
union all
select doc_id || '', 'LoaiVanBang', list_extract(['BACHELOR', 'ENGINEER', 'MASTER', 'DOCTOR', 'OTHER'], doc_id % 5 + 1),
       'Loại văn bằng - Ngành ' || nganh || ' (' || hinh || '): ' || degree, null, null, degree, null, null from p
union all
select doc_id || '', 'HinhThucDaoTao', fid, 'Hình thức đào tạo - Ngành ' || nganh || ': ' || f, null, null, null, f, null from forms
union all
select doc_id || '', 'PhuongThucDaoTao', mid, 'Phương thức đào tạo - Ngành ' || nganh || ' (' || hinh || '): ' || m,
       null, null, null, null, m from methods
""",
    # The first line stands alone on its line: one that opens with a Roman number and reads like a
    # title (at most 100 characters after the number) becomes a second-level heading.
    "programme_objectives": _BASE + """
, opening as (
  select *, regexp_extract(coalesce(ls[1], 'khong'), '^(?:Phần|Chương|Mục)? *([IVX]+) +(.+)$', ['number', 'title']) as h from p
),
general as (
  select *, case when h.title <> '' and length(h.title) <= 100 then '## ' || h.number || ' ' || h.title
                 else coalesce(ls[1], 'khong') end as noi_dung from opening
)
select doc_id || '' as doc_id, 'MucTieuDaoTao' as label, program_id || '_chung' as id,
       'Mục tiêu đào tạo chung - Ngành ' || nganh || ' (' || hinh || '): ' || noi_dung as text,
       'Chung' as loai, noi_dung from general
union all
select p.doc_id || '', 'MucTieuDaoTao', program_id || '_PEO' || (l.i + 1),
       'Mục tiêu đào tạo cụ thể - Ngành ' || nganh || ' (' || hinh || '): ' || l.line, 'CuThe', l.line
from p join lines l on l.doc_id = p.doc_id
""",
    "programme_outcomes": _BASE + """
select doc_id || '' as doc_id, 'ChuanDauRa' as label, program_id || '_' || code as id,
       'Chuẩn đầu ra - Ngành ' || nganh || ' (' || hinh || '): ' || line as text, line as noi_dung, nhom, loai from coded
""",
    "programme_opportunities": _BASE + _OPPORTUNITIES + """
select doc_id || '' as doc_id, case when kind = 0 then 'ViTriViecLam' else 'KhaNangHocTap' end as label,
       program_id || case when kind = 0 then '_vtvl_' else '_knht_' end || (j + 1) as id,
       case when kind = 0 then 'Vị trí việc làm' else 'Khả năng học tập' end || ' - Ngành ' || nganh || ' (' || hinh || '): ' || line as text,
       case when kind = 0 then 'CuThe' end as loai, line as noi_dung
from opp
""",
    "programme_legal_references": _BASE + """
select doc_id || '' as doc_id, 'VanBanPhapLy' as label, doc_id || '_' || j || '_TT' as id,
       'Căn cứ văn bản pháp lý - Ngành ' || nganh || ' (' || hinh || '): ' || ref as text,
       doc_id || '-' || j || '/TT' as so, 'Ban hành ' || line as ten, 'Thông Tư' as loai, '03/04/2021' as ngay_ban_hanh,
       'Bộ ' || lang as co_quan_ban_hanh, ref as noi_dung_goc
from refs where j % 3 = 0
""",
    "programme_other_references": _BASE + _OPPORTUNITIES + """
, plain as (
  select *, row_number() over (partition by doc_id order by j) as n,
         case when j % 3 = 1 then 'https://ex.org/' || doc_id || '/' || j else '' end as link,
         case when j % 3 = 1 then regexp_extract(ref, '^(.*) \\(https', 1) else ref end as noi_dung
  from refs_all where not (j % 3 = 0 and ref <> '')
)
select doc_id || '' as doc_id, 'ChuanThamKhao' as label, program_id || '_ctk_' || n as id,
       'Chuẩn tham khảo - Ngành ' || nganh || ' (' || hinh || '): ' || noi_dung as text, noi_dung, link,
       case when j % 3 = 1 then noi_dung || ' ' || link || '.' else ref end as noi_dung_goc
from plain
""",
    "programme_decisions": _BASE + """
select doc_id || '' as doc_id, 'VanBanPhapLy' as label, doc_id || '_QD_' || upper(source) as id,
       'Chương trình đào tạo ngành ' || nganh || ' được ban hành theo CHƯƠNG TRÌNH ĐÀO TẠO TRÌNH ĐỘ ĐẠI HỌC (Ban hành theo Quyết định số '
       || doc_id || '/QĐ-' || upper(source) || ' ngày 5 tháng 8 năm ' || (cohort + 1974) || ' của Hiệu trưởng ban hành bản ' || lang || ')' as text,
       doc_id || '/QĐ-' || upper(source) as so, 'Ban hành bản ' || lang || ')' as ten, 'Quyết định' as loai,
       '05/08/' || (cohort + 1974) as ngay_ban_hanh, 'Hiệu trưởng' as co_quan_ban_hanh, null as ten_trinh_do from p
union all
select doc_id || '', 'TrinhDo', 'DAI_HOC', 'Trình độ đào tạo - Ngành ' || nganh || ': ĐẠI HỌC', null, null, null, null, null, 'ĐẠI HỌC' from p
""",
    "programme_edge_counts": _ALL_EDGES + """
select type, count(*) as edges, count(distinct (source, target)) as pairs from (
  select doc_id, type, source,
         case when type = 'THUOC_VE' and source not like '%\\_%' escape '\\' and doc_id % 2 = 1 then target || '_TRUONG' else target end as target
  from submitted
) group by type
""",
    "programme_graph_labels": _BASE + _OPPORTUNITIES + "," + TABLE_SQL + """
, merged as (
  select 'Nganh' as label, code || '' as id from p
  union select 'ChuongTrinhDaoTao', program_id from p
  union select 'Khoa', source from p where doc_id % 2 = 0
  union select 'BoMon', source from p where doc_id % 2 = 1
  union select 'LoaiVanBang', degree from p
  union select 'HinhThucDaoTao', unnest(['1', '2', '3'])
  union select 'PhuongThucDaoTao', unnest(['1', '2'])
  union select 'TrinhDo', '1'
  union select 'MucTieuDaoTao', program_id || '_chung' from p
  union select 'MucTieuDaoTao', doc_id || '_PEO' || i from lines
  union select 'ChuanDauRa', program_id || '_' || code from coded
  union select case when kind = 0 then 'ViTriViecLam' else 'KhaNangHocTap' end, program_id || '_' || j from opp
  union select 'VanBanPhapLy', doc_id || '_' || j || '_TT' from refs_all where""" + _LEGAL + """
  union select 'VanBanPhapLy', doc_id || '_QD_' || upper(source) from p
  union select 'ChuanThamKhao', program_id || '_ctk_' || j from refs_all where not (""" + _LEGAL + """)
  union select 'KhoiKienThuc', block_id from ids where kind = 1
  union select 'YeuCauTuChon', req_id from ids where elec is not null
  union select 'NhomHocPhanTuChon', sub_id from ids where kind = 3
  union select 'HocPhan', hp from ids where row_kind = 'course'
)
select label, count(*) as nodes from merged group by label
""",
    "programme_metrics": _ALL_EDGES + """
, node_rows as (
  select doc_id, 4 + 3 + 2 + 2 + 1
    + (select count(*) from lines l where l.doc_id = p.doc_id)
    + (select count(*) from coded c where c.doc_id = p.doc_id)
    + (select count(*) from opp o where o.doc_id = p.doc_id)
    + (select count(*) from refs_all r where r.doc_id = p.doc_id) as nodes
  from p
),
text_chars as (
  select doc_id, sum(length(t) + 1) as chars from (
    select p.doc_id, case when l.i % 2 = 0 then 'a. ' else 'b ' end || l.line || ', (PEO' || (l.i + 1) || ');' as t
      from p join lines l on l.doc_id = p.doc_id
    union all select doc_id, case when j % 3 = 0 then 'a. ' || line || ' (PLO' || (j + 1) || ')' else '- ' || line end from out_items
    union all select doc_id, '- ' || line from items where kind in (0, 1)
    union all select doc_id, '- ' || ref from refs
  ) group by doc_id
)
select p.doc_id || '' as doc_id, cast(n.nodes as bigint) as nodes,
       (select count(*) from submitted s where s.doc_id = p.doc_id) as edges, cast(8 as bigint) as section_count,
       cast(coalesce(c.chars, 0) + length(
         '# **CHƯƠNG TRÌNH ĐÀO TẠO TRÌNH ĐỘ ĐẠI HỌC** (Ban hành theo Quyết định số ' || p.doc_id || '/QĐ-' || upper(p.source)
         || ' ngày 5 tháng 8 năm ' || (p.cohort + 1974) || ' của Hiệu trưởng ban hành bản ' || p.lang || ')' || chr(10) || chr(10)
         || '**1. Thông tin chung**' || chr(10)
         || 'Ngành: **Nganh ' || p.source || '** (Major ' || p.lang || ') Mã ngành: **' || p.code || '**' || chr(10)
         || 'Số lượng tín chỉ: ' || (p.n_chars % 80 + 100) || ' tín chỉ Thời gian đào tạo: 4,5 năm Loại văn bằng: ' || p.degree || chr(10)
         || 'Hình thức đào tạo: Chính quy, Vừa làm vừa học và Từ xa' || chr(10)
         || 'Phương thức tổ chức đào tạo: trực tiếp và trực tuyến' || chr(10)
         || 'Đơn vị quản lý: ' || case when p.doc_id % 2 = 0 then 'Khoa ' else 'Bộ môn ' end || p.source || ', Truong' || chr(10)
         || case when p.clc then 'Chương trình chất lượng cao' else '' end || chr(10)
         || '2. Mục tiêu đào tạo' || chr(10) || '2.1 Mục tiêu chung' || chr(10) || coalesce(p.ls[1], 'khong') || chr(10)
         || '2.2 Mục tiêu cụ thể' || chr(10) || '3. Chuẩn đầu ra' || chr(10) || '3.1 Kiến thức' || chr(10) || '3.1.1 Đại cương' || chr(10)
         || '3.2 Kỹ năng' || chr(10) || '4. Vị trí việc làm' || chr(10) || '5. Khả năng học tập' || chr(10)
         || '6. Tài liệu tham khảo' || chr(10) || '7. Khung chương trình đào tạo') as bigint) as extracted_text_length,
       'pymupdf4llm' as extraction_source
from p join node_rows n on n.doc_id = p.doc_id left join text_chars c on c.doc_id = p.doc_id
""",
}
