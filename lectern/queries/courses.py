"""Course tables and state carried along ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import courses as co
from ..operators.scan import carry_with_reset, running
from .derive import LINES_SQL, course_rows, table


def _table(spark, d):
    rows = course_rows(spark, d)
    states = co.course_states(co.clean_rows(rows))
    doc = F.col("doc_id").cast("string")
    programmes = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("P"), doc).alias("program_id"),
        F.concat(F.lit("Nganh "), F.col("source")).alias("ten_nganh"), F.lit("Đại trà").alias("loai_hinh"),
    )
    return co.with_ids(states, programmes)


def cleaned_rows(spark, d):
    return co.clean_rows(course_rows(spark, d)).select(
        "doc_id", "row_no", F.array_join("cells", "|").alias("cells")
    )


def hierarchy(spark, d):
    return co.course_states(co.clean_rows(course_rows(spark, d))).select(
        "doc_id", "row_no", "kind", "block", "requirement", "subgroup", "subgroup_under"
    )


def block_totals(spark, d):
    return co.block_totals(co.course_states(co.clean_rows(course_rows(spark, d))))


def nodes(spark, d):
    p = F.col("props")
    return co.course_nodes(_table(spark, d)).select(
        "doc_id", "row_no", "label", "id", "text", p["ten_hp"].alias("ten_hp"), p["bat_buoc"].alias("bat_buoc"),
        p["tong_tin_chi"].alias("tong_tin_chi"), p["noi_dung_yeu_cau"].alias("noi_dung_yeu_cau"),
        *[p[c].alias(c) for c in ("ten_nhom", "so_tiet_thuc_hanh", "ma_hp", "so_tin_chi", "so_tiet_ly_thuyet",
                                  "tin_chi_bat_buoc", "tin_chi_tu_chon", "mo_ta", "ten_khoi")],
    )


def many_codes(spark, d):
    """Seventy codes in one cell and one of them again in the next row: all come out, the later wins."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    codes = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.concat(
        F.lit("AA"), F.lpad(i.cast("string"), 3, "0"))), ", ")
    row = lambda no, code, word: F.array(
        F.lit(no), code, F.concat("source", F.lit(word)), *[F.lit(x) for x in ("3", "3", "", "30", "", "", "")]
    )
    cells = F.array(row("1", codes, " một"), row("2", F.lit("AA064"), " hai"))
    rows = docs.select("doc_id", F.posexplode(cells).alias("row_no", "cells")).withColumn("row_no", F.col("row_no").cast("bigint") + 1)
    programmes = docs.select("doc_id", F.lit("P").alias("program_id"), F.lit("N").alias("ten_nganh"), F.lit("L").alias("loai_hinh"))
    nodes = co.course_nodes(co.with_ids(co.course_states(co.clean_rows(rows)), programmes)).where("label = 'HocPhan'")
    # The merge sorts its rows, so they hold the one property and not all.
    named = nodes.select("doc_id", "id", F.struct("row_no", "place", "item").alias("at"), F.col("props")["ten_hp"].alias("ten_hp"))
    return named.groupBy("doc_id", "id").agg(F.count("*").alias("rows"), F.max_by("ten_hp", "at").alias("ten_hp"))


def edges(spark, d):
    return co.course_edges(_table(spark, d)).select("doc_id", "row_no", "source", "type", "target")


def carried_state(spark, d):
    """Per user: a signup opens, a purchase sets, an error resets."""
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    kind = F.col("event_type")
    return running(
        ev, ["user_id"], "event_id",
        sums={"signups": (kind == "signup").cast("bigint")},
        lasts={"_state": carry_with_reset(F.col("value"), kind == "purchase", kind == "error")},
    ).select("user_id", "event_id", "signups", F.col("_state.value").alias("last_purchase"))


QUERIES = {
    "course_rows_cleaned": cleaned_rows,
    "course_hierarchy": hierarchy,
    "course_block_totals": block_totals,
    "course_nodes": nodes,
    "course_edges": edges,
    "course_many_codes": many_codes,
    "carried_state": carried_state,
}

# Continues a WITH list that has the document lines.
TABLE_SQL = """
r as (
  select doc_id, source, i, line, i % 8 as kind,
    case when i % 8 = 1 then 'Khối kiến thức ' || ((i // 8) % 3) end as block_name,
    case i % 8 when 3 then '10 A' when 5 then '6 B' end as elec,
    case when i % 8 in (1, 2, 6, 7) then 1 else 0 end as resets,
    'CT' || lpad(((doc_id * 7 + i) % 1000) || '', 3, '0') || case when i % 8 = 6 then 'CS' else '' end as hp,
    'CT' || lpad((i % 1000) || '', 3, '0') as pre
  from lines where i > 0 and i % 8 <> 0
),
runs as (select *, sum(resets) over (partition by doc_id order by i) as run,
                last_value(block_name ignore nulls) over (partition by doc_id order by i) as block from r),
st as (
  select *,
    case when kind not in (1, 7) then 'course' when kind = 1 then 'block' else 'total' end as row_kind,
    last_value(elec ignore nulls) over (partition by doc_id, run order by i) as requirement,
    last_value(case when kind = 3 then 'AV' end ignore nulls) over (partition by doc_id, run order by i) as subgroup
  from runs
),
ids as (
  select *, 'P' || doc_id as program_id, 'P' || doc_id || '_KHOI_KIEN_THUC_' || right(block, 1) as block_id,
    'P' || doc_id || '_KHOI_KIEN_THUC_' || right(block, 1) || '_REQ_' || replace(requirement, ' ', '_') as req_id,
    'P' || doc_id || '_KHOI_KIEN_THUC_' || right(block, 1) || '_REQ_10_A_SUB_' || subgroup as sub_id,
    'Nganh ' || source || ' (Đại trà)' as major
  from st
),
totals as (
  select doc_id, block, max(i) as i from st where kind = 7 group by doc_id, block
)
"""
_ROWS = f"with {LINES_SQL}, {TABLE_SQL}"
SQL = {
    "course_rows_cleaned": _ROWS + """
select doc_id, i as row_no, case kind
  when 1 then 'BLOCK_HEADER:' || block_name || '|||||||||'
  when 7 then 'Cộng: ' || (i + 10) || ' TC (Bắt buộc ' || i || ' TC; Tự chọn: 10 TC)' || '|||||||||'
  else i || '|' || case when kind = 6 then left(hp, 5) || ' CS200E' else hp end || '|' || line || ' (*)|3|'
    || case kind when 2 then '3' when 3 then 'AV' when 6 then '2' else '' end || '|' || coalesce(elec, '')
    || '|30||' || pre || ', ≥ 90 TC|TN01' end as cells
from r
""",
    "course_hierarchy": _ROWS + """
select doc_id, i as row_no, row_kind as kind, block, requirement, subgroup,
       case when subgroup is not null then '10 A' end as subgroup_under from st
""",
    "course_block_totals": _ROWS + """
select doc_id, block, i + 10 as tong_tin_chi, i as tin_chi_bat_buoc, 10 as tin_chi_tu_chon from totals
""",
    "course_nodes": _ROWS + """
, first_of as (
  select doc_id, 'KhoiKienThuc' as label, block_id as id, min(i) as row_no, any_value(block) as name, any_value(block_id) as block_id,
         any_value(major) as major from ids where kind = 1 group by doc_id, block_id
  union all select doc_id, 'YeuCauTuChon', req_id, min(i), any_value(requirement), any_value(block_id), any_value(major)
    from ids where elec is not null group by doc_id, req_id
  union all select doc_id, 'NhomHocPhanTuChon', sub_id, min(i), any_value(subgroup), any_value(block_id), any_value(major)
    from ids where kind = 3 group by doc_id, sub_id
)
select f.doc_id, f.row_no, label, id,
  case label
    when 'KhoiKienThuc' then case when t.i is null then '' else name || ' - Ngành ' || major || ' có số tín chỉ bắt buộc: ' || t.i
      || ', số tín chỉ tự chọn: 10, tổng cộng: ' || (t.i + 10) || ' tín chỉ.' end
    when 'YeuCauTuChon' then 'Số tín chỉ yêu cầu tự chọn trong khối ' || block_id || ' - Ngành ' || major || ': ' || name
    else 'Nhóm học phần tự chọn - Ngành ' || major || ': ' || name end as text,
  null as ten_hp, null as bat_buoc,
  case when label = 'KhoiKienThuc' then coalesce(t.i + 10, 0) || '' end as tong_tin_chi,
  case when label = 'YeuCauTuChon' then name end as noi_dung_yeu_cau,
  case when label = 'NhomHocPhanTuChon' then name end as ten_nhom, null as so_tiet_thuc_hanh,
  null as ma_hp, null as so_tin_chi, null as so_tiet_ly_thuyet,
  case when label = 'KhoiKienThuc' then coalesce(t.i, 0) || '' end as tin_chi_bat_buoc,
  case when label = 'KhoiKienThuc' then case when t.i is null then '0' else '10' end end as tin_chi_tu_chon,
  case when label = 'YeuCauTuChon' then 'Yêu cầu tự chọn trong khối ' || block_id end as mo_ta,
  case when label = 'KhoiKienThuc' then name end as ten_khoi
from first_of f left join totals t on t.doc_id = f.doc_id and t.block = f.name and f.label = 'KhoiKienThuc'
union all
select doc_id, i, 'HocPhan', hp,
  'Học phần ' || hp || ' - ' || line || ' có số tín chỉ là 3, số tiết lý thuyết là 30, số tiết thực hành là 0.',
  line, case when requirement is null then 'true' else 'false' end, null, null, null, '0',
  hp, '3', '30', null, null, null, null
from ids where row_kind = 'course'
""",
    "course_many_codes": """
select doc_id, 'AA' || lpad(n || '', 3, '0') as id, case when n = 64 then 2 else 1 end as rows,
  source || case when n = 64 then ' hai' else ' một' end as ten_hp
from documents, range(1, 71) codes(n)
""",
    "course_edges": _ROWS + """
select doc_id, min(i) as row_no, program_id as source, 'CO_KHOI_KIEN_THUC' as type, block_id as target
  from ids where kind = 1 group by doc_id, program_id, block_id
union all select doc_id, min(i), block_id, 'CO_YEU_CAU_TU_CHON', req_id from ids where elec is not null group by doc_id, block_id, req_id
union all select doc_id, min(i), req_id, 'CO_NHOM_THANH_PHAN', sub_id from ids where kind = 3 group by doc_id, req_id, sub_id
union all select doc_id, i, coalesce(sub_id, req_id, block_id), 'GOM_HOC_PHAN', hp from ids where row_kind = 'course'
union all select doc_id, i, hp, 'YEU_CAU_TIEN_QUYET', pre from ids where row_kind = 'course'
""",
    "carried_state": """
with r as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id) as run from events)
select user_id, event_id,
       sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) as signups,
       last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id, run order by event_id) as last_purchase
from r
""",
}
