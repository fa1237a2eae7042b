"""The clause tree of a legal text, cut inside one row.

Chapters, articles, clauses and points nest, and each opening line is known by
its look. Cutting the text at chapter lines, each chapter at article lines, and
so on downwards gives the tree in one narrow pass over the document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# The looks of opening lines. The second one covers misread accents.
CHAPTER_LINE = r"ch[uư]ơng[^\S\n]+[ivxlcdm]+[^\n]*"
ARTICLE_WORD = r"[đd][iìíỉĩịeêềếểễệu]{2,4}"
ARTICLE_LABEL = "Điều"
TITLE_END = r"(?iumd)\n(?=[0-9]+\.|[a-zđ]\)|[đd]|ch[uư]ơng)"
CLAUSE_START = r"(?md)^(?=[0-9]+\.[^\S\n]+)"
POINT_START = r"(?md)^(?=[a-zđ]\)[^\S\n]+)"

_UPPER_LINE = (
    r"(?-i:(?=[^\n]*\p{IsUppercase})(?![^\n]*[\p{IsLowercase}\p{Lt}])(?![^\n]*ĐIỀU)[^\n]+)"
)
# A chapter line takes in the line after it when that one is upper case.
CHAPTER_OPENING = rf"(?iumd)^({CHAPTER_LINE})(?:\n({_UPPER_LINE}))?"
# A line that only mentions an article ("xem", closing bracket) opens nothing.
ARTICLE_OPENING = (
    rf"{ARTICLE_WORD}[^\S\n]+[0-9]++\.?+[^\S\n]*+(?!\))"
)
ARTICLE_START = rf"(?iumd)^(?={ARTICLE_OPENING})(?![^\n]*xem)"
ARTICLE_HEAD = rf"(?iud)^({ARTICLE_WORD}\s+[0-9]+)\.?\s*(.*)"
CHAPTER_MARK, TITLE_MARK = "\u0001", "\u0002"


def clean_lines(text: Column) -> Column:
    """Lines without blank ones and page numbers, look-alike letters repaired."""
    lines = F.transform(
        F.filter(F.split(text, "\n"), lambda x: tx.strip(x) != ""), tx.fix_lookalikes
    )
    return F.filter(lines, lambda x: ~x.rlike(r"\A[0-9]{1,3}\z"))


def _head_and_rest(block: Column, boundary: str) -> tuple[Column, Column]:
    pieces = F.split(block, boundary, 2)
    return F.element_at(pieces, 1), F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit(""))


def _blocks(text: Column, start: str) -> tuple[Column, Column]:
    """Text before the first opening line, and the blocks that follow."""
    blocks = F.split(text, start)
    opened = lambda b: b.rlike(start.replace("^", r"\A", 1))
    lead = F.filter(F.slice(blocks, 1, 1), lambda b: ~opened(b))
    return F.array_join(lead, ""), F.filter(blocks, opened)


def _flat(text: Column) -> Column:
    return F.replace(F.rtrim(text, F.lit("\n")), F.lit("\n"), F.lit(" "))


def _point(block: Column) -> Column:
    line = _flat(block)
    head = r"(?d)^([a-zđ])\)\s+(.*)"
    return F.struct(
        F.regexp_extract(line, head, 1).alias("ky_hieu"),
        F.regexp_extract(line, head, 2).alias("noi_dung"),
    )


def _clause(block: Column) -> Column:
    body, points = _blocks(block, POINT_START)
    line = _flat(body)
    head = r"(?d)^([0-9]+)\.\s+(.*)"
    return F.struct(
        F.regexp_extract(line, head, 1).alias("so"),
        F.regexp_extract(line, head, 2).alias("noi_dung"),
        F.transform(points, _point).alias("cac_diem"),
    )


def _article(block: Column, chapter: Column | None) -> Column:
    opening, rest = _head_and_rest(F.rtrim(block, F.lit("\n")), TITLE_END)
    title_line = _flat(opening)
    number = F.regexp_replace(
        F.regexp_extract(title_line, ARTICLE_HEAD, 1), rf"(?iu)^{ARTICLE_WORD}", ARTICLE_LABEL
    )
    body, clauses = _blocks(rest, CLAUSE_START)
    flat_body = _flat(body)
    path = number if chapter is None else F.concat(chapter, F.lit(" > "), number)
    return F.struct(
        number.alias("id"),
        tx.strip(F.regexp_extract(title_line, ARTICLE_HEAD, 2)).alias("tieu_de"),
        path.alias("full_path"),
        F.when(flat_body != "", F.concat(F.lit(" "), flat_body)).otherwise(F.lit("")).alias("noi_dung"),
        F.transform(clauses, _clause).alias("cac_khoan"),
    )


def _articles(text: Column, chapter: Column | None) -> Column:
    _, blocks = _blocks(text, ARTICLE_START)
    return F.transform(blocks, lambda b: _article(b, chapter))


def _chapter(block: Column) -> Column:
    head, body = _head_and_rest(block, "\n")
    line = F.substring_index(head, TITLE_MARK, 1)
    title = F.substring_index(head, TITLE_MARK, -1)
    return F.struct(
        line.alias("chuong"),
        F.when(title != "", F.concat(line, F.lit(": "), title)).otherwise(line).alias("ten"),
        _articles(body, line).alias("cac_dieu"),
    )


def marked_text(lines: Column) -> Column:
    """Lines joined, each chapter opening put on a marked line of its own."""
    return F.regexp_replace(
        F.array_join(lines, "\n"), CHAPTER_OPENING, f"{CHAPTER_MARK}$1{TITLE_MARK}$2"
    )


def tree(marked: Column, file_name: Column) -> Column:
    """The nested regulation struct from a ``marked_text`` column."""
    chunks = F.split(marked, CHAPTER_MARK)
    chapters = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
    return F.struct(
        F.struct(file_name.alias("ten_file")).alias("metadata"),
        F.struct(
            F.array().cast("array<string>").alias("can_cu"),
            _articles(F.element_at(chunks, 1), None).alias("cac_dieu"),
        ).alias("quyet_dinh_ban_hanh"),
        F.transform(chapters, _chapter).alias("quy_dinh_chi_tiet"),
    )


# --- figures about one tree ---------------------------------------------------


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0), lambda acc, x: acc + value(x))


def _clause_nodes(clause: Column) -> Column:
    return F.size(clause["cac_diem"]) + 1


def _article_nodes(article: Column) -> Column:
    return _sum(article["cac_khoan"], _clause_nodes) + 1


def node_count(doc: Column) -> Column:
    """Document, chapters, articles, clauses and points; the decision part is not counted."""
    return _sum(
        doc["quy_dinh_chi_tiet"], lambda c: _sum(c["cac_dieu"], _article_nodes) + 1
    ) + 1


def edge_count(doc: Column) -> Column:
    """Tree edges only; cross-references are not counted."""
    return node_count(doc) - 1


def section_count(doc: Column) -> Column:
    return F.size(doc["quyet_dinh_ban_hanh"]["cac_dieu"]) + _sum(
        doc["quy_dinh_chi_tiet"], lambda c: F.size(c["cac_dieu"])
    )


def full_text(doc: Column) -> Column:
    """All texts in tree order, stripped, one space between them."""
    point_texts = lambda k: F.transform(k["cac_diem"], lambda d: d["noi_dung"])
    clause_texts = lambda k: F.concat(F.array(k["noi_dung"]), point_texts(k))

    def article_texts(a: Column) -> Column:
        return F.concat(
            F.array(a["id"], a["tieu_de"], a["noi_dung"]),
            F.flatten(F.transform(a["cac_khoan"], clause_texts)),
        )

    def chapter_texts(c: Column) -> Column:
        return F.concat(
            F.array(c["chuong"], c["ten"]), F.flatten(F.transform(c["cac_dieu"], article_texts))
        )

    texts = F.concat(
        F.flatten(F.transform(doc["quyet_dinh_ban_hanh"]["cac_dieu"], article_texts)),
        F.flatten(F.transform(doc["quy_dinh_chi_tiet"], chapter_texts)),
    )
    return F.array_join(F.filter(F.transform(texts, tx.strip), lambda t: t != ""), " ")


def document_id(doc: Column) -> Column:
    """File name without its last suffix; a fixed word where it is missing."""
    name = F.coalesce(doc["metadata"]["ten_file"], F.lit("vanban"))
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def document_title(doc: Column) -> Column:
    """Quoted title in the first decision article, else that article's title."""
    title = F.get(doc["quyet_dinh_ban_hanh"]["cac_dieu"], F.lit(0))["tieu_de"]
    quoted = tx.first_match(title, r'(?Ud)Ban hành kèm theo Quyết định này\s+"?(.+?)"?$')
    return F.coalesce(quoted, title, F.lit("Văn bản quy chế"))


# --- cross-references ---------------------------------------------------------

# How a text cites an article, its clause and its point.
CITES_DOWNWARD = r"(?iuU)Xem\s+Điều\s+(\d+)(?:\s+Khoản\s+(\d+))?(?:\s+Điểm\s+([a-z]))?"
CITES_UPWARD = r"(?iuU)điểm\s+([a-z])\s+khoản\s+(\d+)\s+Điều\s+(\d+)"


def citations(text: Column) -> Column:
    """``array<struct<dieu,khoan,diem>>``; a part that is not named is null."""
    pick = lambda pattern, g: tx.all_matches(text, pattern, g)

    def found(pattern: str, article: int, clause: int, point: int) -> Column:
        zipped = F.arrays_zip(
            pick(pattern, article).alias("a"), pick(pattern, clause).alias("c"), pick(pattern, point).alias("p")
        )
        return F.transform(zipped, lambda m: F.struct(
            m["a"].alias("dieu"), tx.nullify(m["c"]).alias("khoan"), tx.nullify(m["p"]).alias("diem")
        ))

    return F.concat(found(CITES_DOWNWARD, 1, 2, 3), found(CITES_UPWARD, 3, 2, 1))
