"""Sections of a Markdown document, found inside one row.

A document is one value of one row, so cutting it up needs no shuffle: its
sections are an array, and what a section must know about earlier ones is read
from that array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Section concepts and the words that name them, first match wins.
CONCEPTS = (
    ("MUC_TIEU", ("mục tiêu", "objectives", "goal")),
    ("CHUAN_DAU_RA", ("chuẩn đầu ra", "learning outcomes", "plo", "cdr", "chuẩn đr",
                      "kiến thức kỹ năng thái độ")),
    ("VI_TRI_VIEC_LAM", ("vị trí việc làm", "cơ hội nghề nghiệp", "nghề nghiệp", "việc làm",
                         "công việc", "vị trí làm việc")),
    ("KHA_NANG_HOC_TAP", ("khả năng học tập", "nâng cao trình độ", "học tập suốt đời", "sau đại học")),
    ("KHUNG_CHUONG_TRINH", ("khung chương trình", "danh sách học phần", "kế hoạch đào tạo")),
    ("THAM_KHAO", ("tài liệu tham khảo", "tham khảo", "tham chiếu", "căn cứ pháp lý")),
    ("THONG_TIN_CHUNG", ("thông tin chung", "tổng quan")),
)
UNCLASSIFIED = "UNKNOWN"

PART_START = r"(?md)^(?=#+[^\S\n])"
SECTION_START = r"(?md)^(?=##[^\S\n]+[0-9])"


def concept_of(header: Column, concepts=CONCEPTS) -> Column:
    """Concept whose keyword the header contains, accents and case aside."""
    import unicodedata

    def key(word: str) -> str:
        marks_off = "".join(
            c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn"
        )
        return " ".join(marks_off.replace("đ", "d").split())

    def classify(folded: Column) -> Column:
        chain = F
        for concept, words in concepts:
            chain = chain.when(folded.rlike("|".join(key(w) for w in words)), F.lit(concept))
        return chain.otherwise(F.lit(UNCLASSIFIED))

    return tx.let(tx.match_key(header), classify)


def parts(text: Column, start: str = PART_START) -> Column:
    """Pieces that begin at a heading line, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(text, start), tx.strip), lambda p: p != "")


def sections(text: Column, part_start: str = PART_START, section_start: str = SECTION_START) -> Column:
    """``array<string>``: a numbered second-level heading opens a section and takes
    in the pieces that follow; pieces before the first one stay separate."""
    def of_blocks(blocks: Column) -> Column:
        opening = blocks[0]
        opens = opening.rlike(section_start.replace("(?md)", r"(?d)"))
        lead = F.when(opens, F.array(tx.strip(opening))).otherwise(parts(opening, part_start))
        rest = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))
        return F.concat(lead, F.transform(rest, tx.strip))

    return tx.let(F.split(F.array_join(parts(text, part_start), "\n\n"), section_start), of_blocks)


def header_of(section: Column) -> Column:
    return tx.strip(F.substring_index(section, "\n", 1))


def content_of(section: Column) -> Column:
    """Everything after the first line, stripped."""
    first = F.substring_index(section, "\n", 1)
    return tx.strip(tx.bytes_of(section, F.octet_length(first) + 1, F.octet_length(section)))
