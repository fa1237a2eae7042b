"""Fields of a programme document, read with patterns from one text column.

Every function takes and returns columns (or arrays of structs), so it works on
table columns and on lambda variables of higher-order functions alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

UNKNOWN = "Unknown"


def _or(c: Column, default: str) -> Column:
    return F.coalesce(tx.nullify(c), F.lit(default))


def _labelled(content: Column, pattern: str, group: int, default: str = UNKNOWN) -> Column:
    return _or(tx.strip(F.regexp_extract(content, pattern, group)), default)


def _pad2(c: Column) -> Column:
    return F.when(F.length(c) >= 2, c).otherwise(F.lpad(c, 2, "0"))


def _capital_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


# --- issuing decision and legal references ---------------------------------

# Kinds of legal documents and the words that open their titles.
DECISION_KIND = r"(?iu)(Quyết định|Thông tư|Nghị quyết|Luật|Nghị định|Chỉ thị|Thông báo)"
REFERENCE_KIND = r"(?iu)^(Quyết định|Thông tư|Nghị định|Luật|Hiến pháp|Chỉ thị|Nghị quyết)"
AGENCY_AND_TITLE = (
    r"(?iuUd)của\s+(.+?)\s+((?:về|ban hành|phê duyệt|quy định|thông qua)[\s\S]*)"
)
DATE_IN_WORDS = rf"(?iuU)ngày[{tx.S}]+([0-9]+)[{tx.S}]+tháng[{tx.S}]+([0-9]+)[{tx.S}]+năm[{tx.S}]+([0-9]+)"
DATE_IN_DIGITS = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
EDUCATION_LEVEL = r"(?iuU)TRÌNH\s+ĐỘ\s+([A-ZÀ-Ỹ\s]+?)(?=\s*\(|\s*\z)"
LEGAL_WORDS = "thông tư|quyết định|luật|nghị định|nghị quyết"


def _dmy(found: Column, pattern: str) -> Column:
    """``d/m/y`` from a text that matches, null from an empty one."""
    day, month, year = (F.regexp_extract(found, pattern, g) for g in (1, 2, 3))
    return F.when(found != "", F.concat_ws("/", tx.let(day, _pad2), tx.let(month, _pad2), year))


def date_in_words(c: Column) -> Column:
    """``d/m/y`` of the first date written in words, null if there is none."""
    # Search the whole text once; the parts are read from the short match.
    return tx.let(F.regexp_extract(c, DATE_IN_WORDS, 0), lambda found: _dmy(found, DATE_IN_WORDS))


def decision_date(words_date: Column, text: Column) -> Column:
    """Date in words from the whole document, else in digits from the decision."""
    digits = tx.let(F.regexp_extract(text, DATE_IN_DIGITS, 0), lambda found: _dmy(found, DATE_IN_DIGITS))
    return F.coalesce(words_date, digits, F.lit("01/01/1900"))


def decision(section_text: Column, words_date: Column) -> dict[str, Column]:
    """Fields of the issuing decision: the first section without its heading marks."""
    text = section_text
    number = F.regexp_extract(text, r"(?U)[sS]ố\s*[:.\-]?\s*([\w\d\-/.]+)", 1)
    title = tx.strip(F.regexp_extract(text, AGENCY_AND_TITLE, 2))
    agency = F.regexp_extract(text, AGENCY_AND_TITLE, 1)
    other_agency = F.regexp_extract(text, r"(?iuU)của\s+([^)_]+)", 1)
    return {
        "id": tx.let(number, lambda n: F.when(n != "", tx.slug_id(n)).otherwise(F.lit("UNKNOWN"))),
        "so": number,
        "ten": tx.let(title, _capital_first),
        "loai": F.regexp_extract(text, DECISION_KIND, 1),
        "ngay_ban_hanh": decision_date(words_date, text),
        "co_quan_ban_hanh": tx.strip(F.coalesce(tx.nullify(agency), other_agency)),
        "noi_dung_goc": text,
        "trinh_do": _labelled(text, EDUCATION_LEVEL, 1),
    }


def is_legal(ref: Column) -> Column:
    return F.lower(ref).rlike(LEGAL_WORDS)


def legal_reference(ref: Column) -> dict[str, Column]:
    """Fields of one cited legal document."""
    number = _or(F.regexp_extract(ref, r"(?iuU)số \s*([^\s)]+)", 1), UNKNOWN)
    title = tx.strip(F.regexp_extract(ref, AGENCY_AND_TITLE, 2))
    agency = tx.strip(F.regexp_extract(ref, AGENCY_AND_TITLE, 1))
    other_agency = tx.strip(F.regexp_extract(ref, r"(?iuUd)của\s+(.+)", 1))
    # Day and month have at most two digits here, the year has four.
    date = tx.let(
        F.regexp_extract(ref, rf"(?iuU)ngày[{tx.S}]+[0-9]{{1,2}}[{tx.S}]+tháng[{tx.S}]+[0-9]{{1,2}}[{tx.S}]+năm[{tx.S}]+[0-9]{{4}}", 0),
        lambda found: F.coalesce(_dmy(found, DATE_IN_WORDS), F.lit("")),
    )
    return {
        "id": tx.slug_id(number),
        "so": number,
        "ten": tx.let(title, lambda t: F.when(t != "", _capital_first(t)).otherwise(ref)),
        "loai": _or(F.initcap(F.regexp_extract(ref, REFERENCE_KIND, 1)), "Văn bản"),
        "ngay_ban_hanh": date,
        "co_quan_ban_hanh": F.coalesce(
            tx.nullify(agency), tx.nullify(other_agency), F.lit("Không xác định")
        ),
        "noi_dung_goc": ref,
    }


def plain_reference(ref: Column) -> Column:
    """``struct<noi_dung,link,noi_dung_goc>`` of a cited work that is no legal document."""
    in_parens = rf"(?U)\([{tx.S}]*(https?://[^)]+)[{tx.S}]*\)"
    bare = rf"(?Us)https?://[^{tx.S}].*"

    def parts(cut: Column, url: Column, marks: str) -> Column:
        return F.struct(
            tx.strip_chars(tx.collapse(F.replace(ref, cut, F.lit(""))), " :.,;").alias("noi_dung"),
            tx.strip_chars(url, marks).alias("link"),
            F.replace(ref, cut, url).alias("noi_dung_goc"),
        )

    def compact(url: Column) -> Column:
        return F.regexp_replace(url, tx.WHITE_RUN, "")

    without = F.struct(
        tx.strip_chars(tx.collapse(ref), " :.,;").alias("noi_dung"), F.lit("").alias("link"),
        ref.alias("noi_dung_goc"),
    )
    in_brackets = tx.let(
        F.regexp_extract(ref, in_parens, 0),
        lambda cut: tx.let(compact(F.regexp_extract(cut, in_parens, 1)), lambda url: parts(cut, url, ".,;?")),
    )
    at_end = tx.let(
        F.regexp_extract(ref, bare, 0), lambda cut: tx.let(compact(cut), lambda url: parts(cut, url, ").,;?"))
    )
    # Most works have no link; a plain search decides that without any pattern.
    return F.when(~F.contains(ref, F.lit("http")), without).when(ref.rlike(in_parens), in_brackets).when(
        ref.rlike(bare), at_end
    ).otherwise(without)


# --- general information ----------------------------------------------------


def cohort_year(full_text: Column) -> Column:
    """The first year named in the document, as text; empty if there is none."""
    return F.regexp_extract(full_text, rf"(?iuU)năm[{tx.S}]+([0-9]{{4}})", 1)


def is_high_quality(full_text: Column) -> Column:
    return full_text.rlike("[cC][hH][ấẤ][tT] [lL][ưƯ][ợỢ][nN][gG] [cC][aA][oO]")


FIRST_COHORT_YEAR = 1974


def programme(content: Column, year: Column, high_quality: Column) -> Column:
    """Struct of major, unit and programme fields of the general-information section."""
    pair = r"(?Ud)^(.+?)" + rf"[{tx.S}]*" + r"\((.+)\)"
    ws = rf"[{tx.S}]"

    def read(plain: Column) -> Column:
        return F.struct(
            _labelled(plain, rf"(?iuU)Mã ngành:{ws}*([0-9]+)", 1).alias("major"),
            _labelled(plain, rf"(?iuU)(?:Ngành|Ngành học):{ws}*([^(]+?{ws}*\([^)]+\))", 1).alias("named"),
            _labelled(content, rf"(?iuUd)Đơn vị quản lý:{ws}*(.+)", 1).alias("unit"),
            (tx.safe_int(year, FIRST_COHORT_YEAR) - FIRST_COHORT_YEAR).alias("cohort"),
        )

    def split(r: Column) -> Column:
        paired = r["named"].rlike(pair)
        vi = F.when(paired, tx.strip(F.regexp_extract(r["named"], pair, 1))).otherwise(r["named"])
        en = F.when(paired, tx.strip(F.regexp_extract(r["named"], pair, 2))).otherwise(F.lit(UNKNOWN))
        department = tx.strip(F.regexp_extract(r["unit"], rf"(?iuU)Bộ môn{ws}+([^-\n]+)", 1))
        faculty = tx.strip(F.regexp_extract(r["unit"], rf"(?iuU)Khoa{ws}+([^,\n-]+)", 1))
        return F.struct(
            r["major"].alias("major"), r["cohort"].alias("cohort"), vi.alias("vi"), en.alias("en"),
            department.alias("department"), faculty.alias("faculty"),
        )

    def fields(x: Column) -> Column:
        kind = F.when(high_quality, F.lit("CLC")).otherwise(F.lit("STD"))
        has_department = x["department"] != ""
        values = {
            "ma_nganh": x["major"],
            "ten_nganh_vi": x["vi"],
            "ten_nganh_en": x["en"],
            "ten_nganh": F.concat(x["vi"], F.lit(" ("), x["en"], F.lit(")")),
            "don_vi_nhan": F.when(has_department, F.lit("BoMon")).otherwise(F.lit("Khoa")),
            "don_vi": F.when(has_department, x["department"]).otherwise(_or(x["faculty"], UNKNOWN)),
            "khoa": x["cohort"],
            "loai_hinh": F.when(high_quality, F.lit("Chất lượng cao")).otherwise(F.lit("Đại trà")),
            "ngon_ngu": F.when(high_quality, F.lit("Tiếng Anh")).otherwise(F.lit("Tiếng Việt")),
            "program_id": F.concat_ws("_", x["major"], x["cohort"].cast("string"), kind),
            "tin_chi": _labelled(content, rf"(?iuU)(?:Số lượng tín chỉ|Tổng cộng)[:-]{ws}*([0-9]+)", 1, "0"),
            "thoi_gian": F.replace(
                _labelled(content, rf"(?iuU)Thời gian đào tạo:{ws}*([0-9.,]+)", 1, "0"), F.lit(","), F.lit(".")
            ),
            "van_bang": _labelled(content, rf"(?iuUd)(?:Loại văn bằng|Danh hiệu):{ws}*(.+)", 1),
            "hinh_thuc": _labelled(content, rf"(?iuUd)Hình thức đào tạo:{ws}*(.+)", 1),
            "phuong_thuc": _labelled(content, rf"(?iuUd)Phương thức tổ chức đào tạo:{ws}*(.+)", 1),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    plain = F.array_join(F.transform(F.split(content, "\n"), tx.plain_line), "\n")
    return tx.let(tx.let(tx.let(plain, read), split), fields)


# Degree words, in order of preference, and their ids.
DEGREES = (("cử nhân", "BACHELOR"), ("kỹ sư", "ENGINEER"), ("thạc sĩ", "MASTER"), ("tiến sĩ", "DOCTOR"))


def degree_id(degree: Column) -> Column:
    def choose(lowered: Column) -> Column:
        chain = F
        for word, name in DEGREES:
            chain = chain.when(lowered.contains(word), F.lit(name))
        return chain.otherwise(F.lit("OTHER"))

    return tx.let(F.lower(degree), choose)


def split_list(c: Column) -> Column:
    """Items between commas or the word for "and"; none for an unknown field."""
    items = F.filter(F.transform(F.split(c, r"(?U),|\bvà\b"), tx.strip), lambda x: x != "")
    return F.when(c == UNKNOWN, F.array().cast("array<string>")).otherwise(items)


ONLINE_ID = "DAO_TAO_TRUC_TUYEN"
DIRECT_ID = "DAO_TAO_TRUC_TIEP"


def method_id(method: Column) -> Column:
    lowered = F.lower(method)
    return (
        F.when(lowered.contains("trực tuyến"), F.lit(ONLINE_ID))
        .when(lowered.contains("trực tiếp"), F.lit(DIRECT_ID))
        .otherwise(tx.slug_id(method))
    )


def method_regulation(method: Column) -> Column:
    """The regulation (by file stem) that governs a delivery method."""
    return F.when(method == ONLINE_ID, F.lit("quydinhdaotaotructuyen")).otherwise(F.lit("quychehocvu"))


# --- lists inside a section ----------------------------------------------------


def bullets(content: Column) -> Column:
    """Items opened by a dash or plus at a line start; a blank text is one item."""
    return F.transform(
        F.split(content, r"\n-|\n\+"),
        lambda x: tx.collapse(tx.one_line(tx.strip(F.regexp_replace(x, rf"(?U)\A[+-][{tx.S}]*", "")))),
    )


# White space is collapsed before, so it is one plain space here.
PEO = r"(?: |^)[a-z0-9]{1,2}[.)]? (.*?)\((PEO ?[0-9]+)\)"


def _first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def _after_first_line(c: Column) -> Column:
    return F.when(
        F.contains(c, F.lit("\n")), tx.bytes_of(c, F.octet_length(_first_line(c)) + 2, F.octet_length(c))
    ).otherwise(F.lit(""))


def objectives(content: Column) -> Column:
    """``array<struct<key,loai,heading,noi_dung>>`` of general and specific objectives."""
    blocks = F.filter(
        F.split(content, r"(?md)^(?=###[^\S\n])"), lambda b: b.rlike(r"\A###[^\S\n]")
    )

    def general(body: Column, heading: str) -> Column:
        return F.struct(
            F.lit("chung").alias("key"),
            F.lit("Chung").alias("loai"),
            F.lit(heading).alias("heading"),
            body.alias("noi_dung"),
        )

    def specific(body: Column) -> Column:
        # One search over the text. A match is a mark, a space, the title and the code in its last
        # brackets, so its parts are told by their places.
        found = tx.all_matches(tx.collapse(body), PEO, 0)

        def objective(m: Column) -> Column:
            code, at = F.substring_index(m, "(", -1), F.locate(" ", m, 2)
            title = tx.bytes_of(m, at + 1, F.octet_length(m) - at - F.octet_length(code) - 1)
            return F.struct(
                F.translate(code, " )", "").alias("key"),
                F.lit("CuThe").alias("loai"),
                F.lit("Mục tiêu đào tạo cụ thể").alias("heading"),
                tx.strip(tx.strip_end(tx.strip(title), ",;.")).alias("noi_dung"),
            )

        return F.transform(found, objective)

    def of_block(block: Column) -> Column:
        body = _after_first_line(block)
        return F.when(
            F.lower(_first_line(block)).contains("chung"),
            F.array(general(tx.strip(tx.collapse(body)), "Mục tiêu đào tạo chung")),
        ).otherwise(specific(body))

    def of_blocks(found: Column) -> Column:
        whole = F.array(general(tx.one_line(tx.strip(content)), "Mục tiêu đào tạo"))
        undivided = (F.size(found) == 0) | ((F.size(found) == 1) & ~F.contains(content, F.lit("\n")))
        return F.when(undivided, whole).otherwise(F.flatten(F.transform(found, of_block)))

    return tx.let(blocks, of_blocks)


OUTCOME_L2 = rf"(?U)^(?:####[{tx.S}]+)?[0-9]+\.[0-9]+\.[0-9]+\.?[{tx.S}]+(.*)"
OUTCOME_L1 = rf"(?U)^(?:###[{tx.S}]+)?[0-9]+\.[0-9]+[{tx.S}]+(.*)"
OUTCOME_ITEM = rf"(?U)^(?:[a-z]\.|-|\+|\*)[{tx.S}]+(.*)"
OUTCOME_LINE = "|".join((OUTCOME_ITEM, OUTCOME_L2, OUTCOME_L1))
OUTCOME_CODE = r"(?i)\(((?:PLO|CDR|PO)[0-9]+)\)"
DEFAULT_GROUP = "Chung"


def outcomes(content: Column, join_continuations: bool = False) -> Column:
    """``array<struct<code,noi_dung,nhom,loai,ord>>`` of the learning outcomes.

    The text is cut at first-level, then at second-level headings, so each item
    knows its headings by position. Items without a code are numbered among
    themselves. ``join_continuations`` first joins wrapped lines to their item.
    """
    lines = F.filter(F.transform(F.split(content, "\n"), tx.strip), lambda x: x != "")
    if join_continuations:
        joined = F.regexp_replace(
            F.array_join(lines, "\n"),
            rf"(?U)\n(?!(?:#+[{tx.S}]|[0-9]+\.[0-9]+[.{tx.S}]|[a-z]\.[{tx.S}]|[-+*][{tx.S}]))",
            " ",
        )
        lines = F.split(joined, "\n")
    kept = F.filter(lines, lambda x: x.rlike(OUTCOME_LINE))
    l1_start = r"(?Umd)^(?=(?:###[^\S\n]+)?[0-9]+\.[0-9]+[^\S\n])"
    l2_start = r"(?Umd)^(?=(?:####[^\S\n]+)?[0-9]+\.[0-9]+\.[0-9]+\.?[^\S\n])"

    def heading(block: Column, pattern: str) -> Column:
        return tx.let(_first_line(block), lambda line: F.when(
            line.rlike(pattern), tx.strip_chars(F.regexp_extract(line, pattern, 1), "#* ")
        ).otherwise(F.lit(DEFAULT_GROUP)))

    def items(category: Column, block: Column) -> Column:
        return tx.let(heading(block, OUTCOME_L2), lambda group: F.transform(
            F.filter(F.split(block, "\n"), lambda x: x.rlike(OUTCOME_ITEM)),
            lambda x: F.struct(
                tx.strip(F.regexp_extract(x, OUTCOME_ITEM, 1)).alias("body"),
                group.alias("nhom"),
                category.alias("loai"),
            ),
        ))

    def of_category(block: Column) -> Column:
        return tx.let(heading(block, OUTCOME_L1), lambda category: F.flatten(
            F.transform(F.split(block, l2_start), lambda b: items(category, b))
        ))

    found = F.flatten(F.transform(F.split(F.array_join(kept, "\n"), l1_start), of_category))
    placed = F.transform(found, lambda x, i: F.struct(
        x["body"].alias("body"), x["nhom"].alias("nhom"), x["loai"].alias("loai"), i.alias("ord"),
        F.regexp_extract(x["body"], OUTCOME_CODE, 0).alias("mark"),
    ))

    def coded(x: Column) -> Column:
        code = F.regexp_replace(F.upper(x["mark"]), r"[()]", "")
        return F.struct(
            code.alias("code"),
            tx.strip_chars(F.replace(x["body"], x["mark"], F.lit("")), " ;.,").alias("noi_dung"),
            x["nhom"].alias("nhom"), x["loai"].alias("loai"), x["ord"].alias("ord"),
        )

    def numbered(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.struct(
            F.concat(F.lit("CDR_"), _pad2(n)).alias("code"),
            x["body"].alias("noi_dung"),
            x["nhom"].alias("nhom"), x["loai"].alias("loai"), x["ord"].alias("ord"),
        )

    return tx.let(placed, lambda all_items: F.concat(
        F.transform(F.filter(all_items, lambda x: x["mark"] != ""), coded),
        F.transform(F.filter(all_items, lambda x: x["mark"] == ""), numbered),
    ))


# --- course table cells --------------------------------------------------------

COURSE_CODE = r"[A-Z]{2,3}[0-9]{3}[A-Z]*"
TOTAL_ALL = r"(?iud)Cộng.*?([0-9]+)\s*TC"
TOTAL_COMPULSORY = r"(?iud)Bắt buộc.*?([0-9]+)\s*TC"
TOTAL_ELECTIVE = r"(?iud)Tự chọn.*?([0-9]+)\s*TC"


def course_codes(cell: Column) -> Column:
    return tx.all_matches(cell, COURSE_CODE)


def course_name(cell: Column) -> Column:
    return tx.strip(F.replace(cell, F.lit("(*)"), F.lit("")))


def credit_total(row_text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(row_text, pattern, 1).try_cast("int"), F.lit(0))


def is_digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")
