"""Regulations: clause trees, figures, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regulation as rf
from ..operators import graph as gr
from ..operators import regulations as rg
from .derive import LINES_SQL, ROMAN, regulation_documents


def _trees(spark, d):
    return rg.parse_regulations(regulation_documents(spark, d))


def _flat(spark, d):
    return rg.flatten_trees(_trees(spark, d))


def tree_rows(spark, d):
    safe = lambda k: F.get(F.filter("props", lambda p: p["key"] == k), F.lit(0))["value"]
    return _flat(spark, d).select(
        "doc_id", "label", "id", "parent", "relation", "key",
        safe("ten").alias("ten"), safe("tieu_de").alias("tieu_de"), safe("noi_dung").alias("noi_dung"),
        F.array_join("texts", "|").alias("texts"),
    )


def figures(spark, d):
    return rg.metrics(_trees(spark, d)).select(
        "doc_id", "nodes", "edges", "section_count", "extracted_text_length",
        F.md5("extracted_preview").alias("preview_digest"),
    )


def full_texts(spark, d):
    text = _trees(spark, d).select("doc_id", rf.full_text(F.col("reg")).alias("t"))
    return text.select("doc_id", F.md5("t").alias("digest"))


def citation_edges(spark, d):
    return rg.citation_edges(_flat(spark, d)).select("doc_id", "source", "target")


def unresolved(spark, d):
    return rg.citation_edges(_flat(spark, d), keep_unresolved=True).where("target is null").select(
        "doc_id", "source", "dieu", "khoan", "diem"
    )


def merged_labels(spark, d):
    """Tree nodes after the merge, by label: repeated numbers become one node."""
    nodes = rg.tree_nodes(_flat(spark, d))
    return gr.upsert_nodes(nodes).groupBy("label").agg(F.count("*").alias("nodes"))


QUERIES = {
    "regulation_tree": tree_rows,
    "regulation_figures": figures,
    "regulation_full_texts": full_texts,
    "regulation_citation_edges": citation_edges,
    "regulation_unresolved_citations": unresolved,
    "regulation_merged_labels": merged_labels,
}

_ROMAN = "[" + ", ".join(f"'{r}'" for r in ROMAN) + "]"
_STATES = f"""
with {LINES_SQL},
raw as (
  select doc_id, i, replace(line, 'ß', 'ss') as x, i // 4 + 1 as n from lines
),
texts as (
  select doc_id, i, trim(case i % 16
    when 0 then 'Chương ' || list_extract({_ROMAN}, cast((i // 16) % 10 + 1 as int))
    when 1 then upper(x)
    when 2 then 'Điều ' || n || '. ' || x
    when 3 then 'tiếp ' || x
    when 4 then '1. ' || x
    when 5 then x
    when 6 then 'a) ' || x
    when 7 then 'nối ' || x
    when 8 then i || ''
    when 9 then 'b) Xem Điều ' || (i // 8 + 1) || ' Khoản 1 Điểm a ' || x
    when 10 then '2. theo điểm A khoản 1 Điều ' || (i % 7 + 1) || ' ' || x
    when 11 then 'Đieu ' || n || ' ' || x
    when 12 then x
    when 13 then '5.5 Xem Điều ' || (i % 5 + 1) || ' Khoản 9 ' || x
    when 14 then 'Điều 3 xem ' || x
    else 'đ) ' || x end) as t
  from raw
),
kept as (
  select *, regexp_matches(t, '^(?i:ch[uư]ơng\\s+[ivxlcdm]+)') as is_ch,
    regexp_matches(t, '^(?i:[đd][iìíỉĩịeêềếểễệu]{{2,4}}\\s+[0-9]+)') and not contains(lower(t), 'xem') as is_art,
    regexp_matches(t, '^[0-9]+\\.\\s+') as is_clause, regexp_matches(t, '^[a-zđ]\\)\\s+') as is_point,
    regexp_matches(t, '^(?i:[0-9]+\\.|[a-zđ]\\)|[đd]|ch[uư]ơng)') as is_stop
  from texts where not regexp_matches(t, '^[0-9]{{1,3}}$')
),
s1 as (
  select *, coalesce(lag(is_ch) over w, false) and upper(t) = t and lower(t) <> t and not contains(t, 'ĐIỀU') as eaten,
    sum(case when is_ch or is_art then 1 else 0 end) over w as run, lead(t) over w as next_t
  from kept window w as (partition by doc_id order by i)
),
s2 as (
  select *, bool_or(is_art) over (partition by doc_id, run) as open,
    sum(case when is_stop and not is_art then 1 else 0 end) over (partition by doc_id, run order by i) as st
  from s1 where not eaten
),
s3 as (select *, sum(case when open and is_clause then 1 else 0 end) over (partition by doc_id, run order by i) as kr from s2),
s4 as (
  select *, sum(case when kr > 0 and is_point then 1 else 0 end) over (partition by doc_id, run, kr order by i) as pr,
    last_value(case when is_ch then t end ignore nulls) over (partition by doc_id order by i) as chuong
  from s3
),
named as (
  select *, 'qd' || doc_id as vb, 'qd' || doc_id || '_' || replace(chuong, ' ', '') as cid,
    first_value(regexp_extract(t, '^(?i:[đd][iìíỉĩịeêềếểễệu]{{2,4}})\\s+([0-9]+)', 1)) over (partition by doc_id, run order by i) as so,
    first_value(case when kr > 0 then regexp_extract(t, '^([0-9]+)\\.', 1) end) over (partition by doc_id, run, kr order by i) as kso,
    first_value(case when pr > 0 then left(t, 1) end) over (partition by doc_id, run, kr, pr order by i) as ky
  from s4
),
flat as (
  select doc_id, -1 as i, 'VanBan' as label, 'qd' || doc_id as id, null as parent, null as relation, null as key,
         'Văn bản quy chế' as ten, null as tieu_de, null as noi_dung, '' as body from docs
  union all
  select doc_id, i, 'Chuong', cid, vb, 'co_chuong', null,
    t || case when next_t is not null and upper(next_t) = next_t and lower(next_t) <> next_t and not contains(next_t, 'ĐIỀU')
         then ': ' || next_t else '' end, null, null, '' from named where is_ch
  union all
  select doc_id, min(i), 'Dieu', any_value(cid) || '_Dieu' || any_value(so), any_value(cid), 'co_dieu', any_value(so), null,
    trim(string_agg(case when is_art then regexp_extract(t, '^(?i:[đd][iìíỉĩịeêềếểễệu]{{2,4}}\\s+[0-9]+)\\.?\\s*(.*)', 1) else t end, ' ' order by i)
      filter (st = 0)), null,
    coalesce(' ' || string_agg(t, ' ' order by i) filter (st > 0 and kr = 0), '')
  from named where open group by doc_id, run
  union all
  select doc_id, min(i), 'Khoan', any_value(cid) || '_Dieu' || any_value(so) || '_Khoan' || any_value(kso),
    any_value(cid) || '_Dieu' || any_value(so), 'co_khoan', any_value(so) || '|' || any_value(kso), null, null,
    regexp_extract(string_agg(t, ' ' order by i) filter (pr = 0), '^[0-9]+\\.\\s+(.*)', 1), ''
  from named where open and kr > 0 group by doc_id, run, kr
  union all
  select doc_id, min(i), 'Diem', any_value(cid) || '_Dieu' || any_value(so) || '_Khoan' || any_value(kso) || '_Diem' || any_value(ky),
    any_value(cid) || '_Dieu' || any_value(so) || '_Khoan' || any_value(kso), 'co_diem',
    any_value(so) || '|' || any_value(kso) || '|' || any_value(ky), null, null,
    regexp_extract(string_agg(t, ' ' order by i), '^[a-zđ]\\)\\s+(.*)', 1), ''
  from named where open and kr > 0 and pr > 0 group by doc_id, run, kr, pr
),
searched as (
  select *, case label when 'Dieu' then [tieu_de, body] when 'Khoan' then [noi_dung] when 'Diem' then [noi_dung] else [] end as texts_list
  from flat
)
"""
_CITED = _STATES + """
, pieces as (select doc_id, key as source_key, unnest(texts_list) as t from searched),
hits as (
  select doc_id, source_key, unnest(regexp_extract_all(t, '(?i:Xem\\s+Điều)\\s+(\\d+)(?:\\s+(?i:Khoản)\\s+(\\d+))?(?:\\s+(?i:Điểm)\\s+([a-zA-Z]))?', 1)) as dieu,
    unnest(regexp_extract_all(t, '(?i:Xem\\s+Điều)\\s+(\\d+)(?:\\s+(?i:Khoản)\\s+(\\d+))?(?:\\s+(?i:Điểm)\\s+([a-zA-Z]))?', 2)) as khoan,
    unnest(regexp_extract_all(t, '(?i:Xem\\s+Điều)\\s+(\\d+)(?:\\s+(?i:Khoản)\\s+(\\d+))?(?:\\s+(?i:Điểm)\\s+([a-zA-Z]))?', 3)) as diem
  from pieces
  union all
  select doc_id, source_key, unnest(regexp_extract_all(t, '(?i)điểm\\s+([a-z])\\s+khoản\\s+(\\d+)\\s+Điều\\s+(\\d+)', 3)),
    unnest(regexp_extract_all(t, '(?i)điểm\\s+([a-z])\\s+khoản\\s+(\\d+)\\s+Điều\\s+(\\d+)', 2)),
    unnest(regexp_extract_all(t, '(?i)điểm\\s+([a-z])\\s+khoản\\s+(\\d+)\\s+Điều\\s+(\\d+)', 1))
  from pieces
),
cited as (select distinct doc_id, source_key, dieu, nullif(khoan, '') as khoan, nullif(diem, '') as diem from hits),
idx as (select doc_id, key, arg_max(id, i) as id from flat where key is not null group by doc_id, key),
resolved as (
  select c.*, s.id as source, coalesce(p.id, k.id, a.id) as target
  from cited c join idx s on s.doc_id = c.doc_id and s.key = c.source_key
  left join idx p on p.doc_id = c.doc_id and p.key = c.dieu || '|' || c.khoan || '|' || c.diem
  left join idx k on k.doc_id = c.doc_id and k.key = c.dieu || '|' || c.khoan
  left join idx a on a.doc_id = c.doc_id and a.key = c.dieu
)
"""
_PIECES = _STATES + """
, pieces as (
  select doc_id, i, 0 as k, replace(split_part(ten, ':', 1), ':', '') as piece from flat where label = 'Chuong'
  union all select doc_id, i, 1, ten from flat where label = 'Chuong'
  union all select doc_id, i, 0, 'Điều ' || key from flat where label = 'Dieu'
  union all select doc_id, i, 1, tieu_de from flat where label = 'Dieu'
  union all select doc_id, i, 2, trim(body) from flat where label = 'Dieu'
  union all select doc_id, i, 0, noi_dung from flat where label in ('Khoan', 'Diem')
),
whole as (
  select d.doc_id, coalesce(string_agg(piece, ' ' order by i, k) filter (piece <> ''), '') as t
  from docs d left join pieces p on p.doc_id = d.doc_id group by d.doc_id
)
"""
SQL = {
    "regulation_tree": _STATES + """
select doc_id, label, id, parent, relation, key, case when label in ('VanBan', 'Chuong') then ten end as ten, tieu_de, noi_dung,
  array_to_string(texts_list, '|') as texts from searched
""",
    "regulation_figures": _PIECES + """
select w.doc_id, (select count(*) from flat f where f.doc_id = w.doc_id) as nodes,
  (select count(*) from flat f where f.doc_id = w.doc_id) - 1 as edges,
  (select count(*) from flat f where f.doc_id = w.doc_id and label = 'Dieu') as section_count,
  length(w.t) as extracted_text_length, md5(left(w.t, 12000)) as preview_digest
from whole w
""",
    "regulation_full_texts": _PIECES + "select doc_id, md5(t) as digest from whole",
    "regulation_citation_edges": _CITED + "select distinct doc_id, source, target from resolved where target is not null",
    "regulation_unresolved_citations": _CITED + "select doc_id, source, dieu, khoan, diem from resolved where target is null",
    "regulation_merged_labels": _STATES + "select label, count(distinct id) as nodes from flat group by label",
}
