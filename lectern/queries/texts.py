"""Text functions on whole driver texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fd
from ..functions import regulation as rf
from ..functions import sections as sc
from ..functions import text as tx
from ..plans import curriculum as cu
from ..session import spread
from .derive import document_lines, table


def _docs(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


def slug_ids(spark, d):
    text = F.concat_ws("/", "source", F.lit("Đợt"), "text")
    return _docs(spark, d).select("doc_id", F.md5(tx.slug_id(text)).alias("digest"))


def match_keys(spark, d):
    text = F.concat(F.lit("  Điều ĐẶC  biệt "), F.col("text"), F.lit("\n"))
    return _docs(spark, d).select("doc_id", F.md5(tx.match_key(text)).alias("digest"))


def emphasis(spark, d):
    """Frequent words are put in bold, italic or both before the marks are removed."""
    text = F.col("text")
    for word, mark in ((" the ", "**"), (" la ", "_"), (" der ", "***"), (" of ", "__"), (" de ", "*")):
        text = F.replace(text, F.lit(word), F.lit(f" {mark}{word.strip()}{mark} "))
    return _docs(spark, d).select("doc_id", F.md5(tx.remove_emphasis(text)).alias("digest"))


HEADINGS = ("1. ", "2.3 ", "Phần II ", "**4.** ", "", "3.4.5.6.7.8 ", "IV) ", "Mục 2: ")


def headings(spark, d):
    """Lines are cut at full stops, so that some are short enough for titles."""
    numbers = F.array(*[F.lit(h) for h in HEADINGS])
    lines = F.transform(
        F.split("text", r"[.\n]"),
        lambda x, i: F.concat(F.element_at(numbers, (i % len(HEADINGS) + 1).cast("int")), F.trim(x), F.lit(" ")),
    )
    upgraded = tx.upgrade_headings(F.array_join(lines, "\n"))
    return _docs(spark, d).select("doc_id", F.posexplode(F.split(upgraded, "\n")).alias("line_no", "line"))


HEADER_WORDS = (
    "Mục tiêu", "OBJECTIVES", "chuan dau ra", "PLO", "Cơ hội nghề nghiệp", "Sau Đại học", "Khung chương trình",
    "Tham khảo", "TỔNG QUAN", "Khác",
)


def header_concepts(spark, d):
    words = F.array(*[F.lit(w) for w in HEADER_WORDS])
    headers = F.transform(
        "ls", lambda x, i: F.concat(F.lit("## "), F.element_at(words, (i % len(HEADER_WORDS) + 1).cast("int")), F.lit(" "), x)
    )
    rows = document_lines(spark, d).select("doc_id", F.posexplode(headers).alias("line_no", "header"))
    return rows.select("doc_id", "line_no", sc.concept_of(F.col("header")).alias("concept"))


def lookalikes(spark, d):
    lines = document_lines(spark, d).select(
        "doc_id", F.posexplode(F.transform("ls", lambda x: F.concat(F.lit(" Chương IШ І ХⅤ "), x))).alias("line_no", "x")
    )
    return lines.select("doc_id", "line_no", tx.fix_lookalikes(F.col("x")).alias("line"))


def page_lines(spark, d):
    """Blank lines and page numbers go; the rest is counted."""
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\n12\n \n1234\n")), F.lit("\n999"))
    return _docs(spark, d).select("doc_id", F.size(rf.clean_lines(text)).alias("lines"))


def joined_pages(spark, d):
    pages = F.split(F.replace("text", F.lit("\n"), F.lit("\f \f\n")), "\f")
    text = tx.join_pages(pages)
    return _docs(spark, d).select(
        "doc_id", F.length(text).alias("chars"), F.md5(text).alias("digest"), F.md5(tx.preview(text)).alias("preview")
    )


def candidate_sources(spark, d):
    c = lambda n: F.when(F.col("doc_id") % n == 0, F.lit(" \n ")).when(F.col("doc_id") % n != 1, F.concat(F.lit(f"{n} "), "text"))
    candidates = _docs(spark, d).select(
        "doc_id", c(2).alias("pymupdf4llm"), c(3).alias("pymupdf"), c(4).alias("pypdf"), c(5).alias("ocr_tesseract")
    )
    good, failed = cu.pick_text(candidates, ("pymupdf4llm", "pymupdf", "pypdf", "ocr_tesseract"))
    return good.select("doc_id", F.md5("text").alias("digest"), "extraction_source").unionByName(
        failed.select("doc_id", F.lit(None).cast("string").alias("digest"), F.lit("none").alias("extraction_source"))
    )


def course_codes(spark, d):
    cell = F.concat(
        F.upper("p_name"), F.lit(" CT"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("H, "),
        F.lit("ABCD"), F.lpad((F.col("p_size") * 37 % 1000).cast("string"), 3, "0"), F.lit("; TN10 ≥ 90 TC"),
    )
    return table(spark, d, "part").select("p_partkey", F.posexplode(fd.course_codes(cell)).alias("at", "code"))


def page_links(spark, d):
    """References made of page addresses: in brackets, bare, or none."""
    k = F.col("page_id") % 3
    ref = F.when(k == 0, F.concat(F.lit("Work "), F.col("page_id").cast("string"), F.lit(" ("), F.col("url"), F.lit(" ).")))\
        .when(k == 1, F.concat(F.lit("Work: "), F.col("url"), F.lit(" extra.")))\
        .otherwise(F.concat(F.lit("Work no link "), F.col("page_id").cast("string"), F.lit(";")))
    return table(spark, d, "pages").select("page_id", fd.plain_reference(ref).alias("r")).select("page_id", "r.*")


def byte_sizes(spark, d):
    size = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 7 - 2)).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", tx.format_bytes(size).alias("size"))


def safe_numbers(spark, d):
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit("\n")))\
        .when(k == 1, F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(",")))\
        .when(k == 2, F.lit("1+1+1")).otherwise(F.lit(""))
    li = table(spark, d, "lineitem")
    return li.groupBy(raw.alias("raw")).agg(F.count("*").alias("rows")).select(
        F.md5("raw").alias("raw"), "rows", tx.safe_int(F.col("raw")).alias("whole"), tx.safe_float(F.col("raw")).alias("number")
    )


def stored_names(spark, d):
    name = F.concat(F.lit("dir/Quy.che "), F.col("o_orderkey").cast("string"), F.lit(".PDF"))
    return table(spark, d, "orders").select("o_orderkey", tx.stored_file_name(name, F.col("o_orderdate")).alias("stored"))


def fenced_blocks(spark, d):
    reply = F.concat(F.lit("Đây:\n```cypher\nMATCH "), F.col("text"), F.lit("\n```\n{\"entity\": \""), F.col("role"), F.lit("\"} hết"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(tx.fenced_block(reply, "cypher")).alias("query"),
        F.get_json_object(tx.json_object(F.regexp_replace(reply, r"(?s)^.*```", "")), "$.entity").alias("entity"),
    )


def markdown_tables(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"(?m)^(\S+ \S+)$", "| $1 |")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", tx.has_markdown_table(text).cast("int").alias("has_table"))


QUERIES = {
    "text_slug_ids": slug_ids,
    "text_match_keys": match_keys,
    "text_emphasis": emphasis,
    "text_headings": headings,
    "text_header_concepts": header_concepts,
    "text_lookalikes": lookalikes,
    "text_page_lines": page_lines,
    "text_joined_pages": joined_pages,
    "text_candidate_sources": candidate_sources,
    "text_course_codes": course_codes,
    "text_page_links": page_links,
    "text_byte_sizes": byte_sizes,
    "text_safe_numbers": safe_numbers,
    "text_stored_names": stored_names,
    "text_fenced_blocks": fenced_blocks,
    "text_markdown_tables": markdown_tables,
}

_BOLD = "text"
for _word, _mark in ((" the ", "**"), (" la ", "_"), (" der ", "***"), (" of ", "__"), (" de ", "*")):
    _BOLD = f"replace({_BOLD}, '{_word}', ' {_mark}{_word.strip()}{_mark} ')"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_H = "[" + ", ".join(f"'{h}'" for h in HEADINGS) + "]"
_HW = "[" + ", ".join(f"'{h}'" for h in HEADER_WORDS) + "]"
_CONCEPTS = {
    "Mục tiêu": "MUC_TIEU", "OBJECTIVES": "MUC_TIEU", "chuan dau ra": "CHUAN_DAU_RA", "PLO": "CHUAN_DAU_RA",
    "Cơ hội nghề nghiệp": "VI_TRI_VIEC_LAM", "Sau Đại học": "KHA_NANG_HOC_TAP", "Khung chương trình": "KHUNG_CHUONG_TRINH",
    "Tham khảo": "THAM_KHAO", "TỔNG QUAN": "THONG_TIN_CHUNG", "Khác": "UNKNOWN",
}
_NUM = r"^[*_]*(?:Phần|Chương|Mục)?\s*([IVX]+|[0-9]+(?:\.[0-9]+)*)[.:)]*[*_]*\s+(.*)"
from .derive import LINES_SQL as _LINES  # noqa: E402

SQL = {
    "text_slug_ids": """
select doc_id, md5(upper(trim(regexp_replace(replace(replace(strip_accents(source || '/Đợt/' || text), 'Đ', 'D'), 'đ', 'd'),
  '[^A-Za-z0-9]+', '_', 'g'), '_'))) as digest from documents
""",
    "text_match_keys": f"""
select doc_id, md5(trim(regexp_replace(replace(strip_accents(lower('  Điều ĐẶC  biệt ' || text || chr(10))), 'đ', 'd'),
  '{_WHITE}', ' ', 'g'))) as digest from documents
""",
    "text_emphasis": f"""
with b as (select doc_id, {_BOLD} as t from documents),
c as (select doc_id, regexp_replace(t, '\\*\\*\\*(.+?)\\*\\*\\*', '\\1', 'g') as t from b),
e as (select doc_id, regexp_replace(t, '\\*\\*(.+?)\\*\\*|__(.+?)__', '\\1\\2', 'g') as t from c)
select doc_id, md5(regexp_replace(t, '\\*(.+?)\\*|_(.+?)_', '\\1\\2', 'g')) as digest from e
""",
    "text_headings": f"""
with cut as (select doc_id, string_split_regex(text, '[.\\n]') as ls from documents),
l as (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) - 1 as line_no from cut),
m as (select doc_id, line_no, trim(list_extract({_H}, line_no % {len(HEADINGS)} + 1) || trim(x) || ' ') as t from l),
g as (
  select *, regexp_matches(t, '{_NUM}') as fits, regexp_extract(t, '{_NUM}', 1) as num,
    trim(regexp_replace(regexp_extract(t, '{_NUM}', 2), '^[*_]+|[*_]+$', '', 'g')) as title from m
)
select doc_id, line_no, case
  when fits and title <> '' and length(title) <= 100 and not (length(title) > 30 and right(title, 1) in ('.', ';', ':'))
  then repeat('#', case when regexp_full_match(num, '[IVX]+') or contains(t, 'Phần') then 2
       else least(len(string_split(num, '.')) + 1, 6) end) || ' ' || num || ' ' || title
  else t end as line
from g
""",
    "text_header_concepts": f"""
with {_LINES},
keyed as (select doc_id, i, list_extract({_HW}, i % {len(HEADER_WORDS)} + 1) as w,
          replace(strip_accents(lower(line)), 'đ', 'd') as folded from lines)
select doc_id, i as line_no, case
  when regexp_matches(folded, 'muc tieu|objectives|goal') or w in ('Mục tiêu', 'OBJECTIVES') then 'MUC_TIEU'
  when regexp_matches(folded, 'chuan dau ra|learning outcomes|plo|cdr|chuan dr') or w in ('chuan dau ra', 'PLO') then 'CHUAN_DAU_RA'
  else case w {' '.join(f"when '{w}' then '{c}'" for w, c in _CONCEPTS.items())} end end as concept
from keyed
""",
    "text_lookalikes": f"""
with {_LINES}
select doc_id, i as line_no, 'Chương III I XV ' || line as line from lines
""",
    "text_page_lines": """
with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents),
n as (select doc_id, count(*) as cuts, sum(case when not regexp_matches(trim(x, chr(32) || chr(9) || chr(12) || chr(13) || chr(160)), '^([0-9]{1,3})?$') then 1 else 0 end) as kept
      from l group by doc_id)
select doc_id, kept + (cuts - 1) as lines from n
""",
    "text_joined_pages": """
with t as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '') as p
  from documents),
j as (select doc_id, coalesce(array_to_string(p, chr(10) || chr(10)), '') as t from t)
select doc_id, length(t) as chars, md5(t) as digest, md5(trim(replace(left(t, 12000), chr(10), ' '))) as preview from j
""",
    "text_candidate_sources": """
with c as (
  select doc_id, text,
    case when doc_id % 2 = 0 then null when doc_id % 2 <> 1 then '2 ' || text end as a,
    case when doc_id % 3 = 2 then '3 ' || text end as b,
    case when doc_id % 4 > 1 then '4 ' || text end as c,
    case when doc_id % 5 > 1 then '5 ' || text end as e
  from documents)
select doc_id, md5(coalesce(a, b, c, e)) as digest, case when a is not null then 'pymupdf4llm' when b is not null then 'pymupdf'
  when c is not null then 'pypdf' when e is not null then 'ocr_tesseract' else 'none' end as extraction_source from c
""",
    "text_course_codes": """
with c as (select p_partkey, regexp_extract_all(upper(p_name) || ' CT' || lpad((p_partkey % 1000) || '', 3, '0') || 'H, ABCD'
    || lpad((p_size * 37 % 1000) || '', 3, '0') || '; TN10 ≥ 90 TC', '[A-Z]{2,3}[0-9]{3}[A-Z]*') as codes from part)
select p_partkey, generate_subscripts(codes, 1) - 1 as at, unnest(codes) as code from c
""",
    "text_page_links": """
select page_id,
  case page_id % 3 when 0 then 'Work ' || page_id when 1 then 'Work' else 'Work no link ' || page_id end as noi_dung,
  case page_id % 3 when 0 then trim(url, '.,;?') when 1 then trim(url || 'extra.', ').,;?') else '' end as link,
  case page_id % 3 when 0 then 'Work ' || page_id || ' ' || url || '.' when 1 then 'Work: ' || url || 'extra.'
    else 'Work no link ' || page_id || ';' end as noi_dung_goc
from pages
""",
    "text_byte_sizes": """
with s as (select o_orderkey, cast(floor(o_totalprice * pow(10.0, o_orderkey % 7 - 2)) as bigint) as n from orders)
select o_orderkey, case when n = 0 then '0 Bytes' when n < 1024 then n || ' Bytes'
  else regexp_replace(round(n / pow(1024.0, case when n < 1048576 then 1 when n < 1073741824 then 2 when n < 1099511627776 then 3 else 4 end), 2) || '', '\\.0$', '')
    || case when n < 1048576 then ' KB' when n < 1073741824 then ' MB' when n < 1099511627776 then ' GB' else ' TB' end end as size
from s
""",
    "text_safe_numbers": """
with r as (select case l_linenumber % 4 when 0 then ' ' || cast(l_quantity as int) || chr(10) when 1 then replace(l_discount || '', '.', ',')
  when 2 then '1+1+1' else '' end as raw from lineitem),
g as (select raw, count(*) as rows, trim(raw, chr(32) || chr(10)) as t from r group by raw)
select md5(raw) as raw, rows, coalesce(case when regexp_full_match(t, '[0-9]+') then cast(t as int) end, 0) as whole,
  coalesce(try_cast(replace(t, ',', '.') as double), 0.0) as number from g
""",
    "text_stored_names": """
select o_orderkey, 'Quy.che ' || o_orderkey || strftime(o_orderdate, '_%Y%m%d_%H%M%S_')
  || left(sha256('dir/Quy.che ' || o_orderkey || '.PDF|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')), 8) || '.pdf' as stored
from orders
""",
    "text_fenced_blocks": """
select conv_id, turn, md5(trim('MATCH ' || text, chr(32) || chr(10))) as query, role as entity from conversations
""",
    "text_markdown_tables": """
select doc_id, case when regexp_matches(case when doc_id % 2 = 0 then regexp_replace(text, '(?m)^(\\S+ \\S+)$', '| \\1 |', 'g') else text end,
  '(?m)^\\s*\\|.+\\|\\s*$') then 1 else 0 end as has_table from documents
""",
}
