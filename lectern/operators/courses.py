"""Course tables: rows of ten text cells become blocks, electives and courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as fd
from ..functions import text as tx
from .scan import CHUNK_ROWS

# Cell texts that identify header, block and total rows.
HEADER_CELLS = ("Mã số", "Tên học phần")
BLOCK_WORDS = "Khối kiến thức"
BLOCK_MARK = "BLOCK_HEADER:"
TOTAL_WORD = "Cộng"

COLUMNS = (
    "marker", "code", "name", "credits", "compulsory", "elective",
    "theory", "practice", "prerequisites", "corequisites",
)


def clean_rows(rows: DataFrame) -> DataFrame:
    """Clean extracted cells, drop header rows, mark block rows.

    ``rows(doc_id, row_no, cells)`` counts a document's rows from 0. Row 0 only
    names the columns, whether it looks like a header or not.
    """
    cells = F.transform("cells", lambda c: tx.strip(tx.one_line(F.coalesce(c, F.lit("")))))

    def is_header(row: Column) -> Column:
        found = F.lit(False)
        for word in HEADER_CELLS:
            found = found | F.array_contains(row, word)
        return found

    def with_mark(row: Column) -> Column:
        filled = F.array_distinct(F.filter(row, lambda c: c != ""))
        block = F.contains(F.get(row, F.lit(0)), F.lit(BLOCK_WORDS)) & (F.size(filled) == 1)
        marked = F.transform(
            row, lambda c, i: F.when(i == 0, F.concat(F.lit(BLOCK_MARK), c)).otherwise(F.lit(""))
        )
        return F.when(block, marked).otherwise(row)

    # A filter on cleaned cells would clean them again, once for each word it looks for.
    kept = F.transform(F.filter(F.array(cells), lambda row: ~is_header(row)), with_mark)
    body = rows.where("row_no > 0")
    return body.select(*[F.explode(kept).alias(c) if c == "cells" else c for c in body.columns])


def positional(rows: DataFrame) -> DataFrame:
    """Name the ten cells; keep the joined text of the row for its totals."""
    cell = lambda i: tx.strip(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    named = [cell(i).alias(n) for i, n in enumerate(COLUMNS)]
    named[1] = F.replace(cell(1), F.lit(" "), F.lit("")).alias("code")
    row_text = F.array_join(F.filter("cells", lambda c: c != ""), " ").alias("row_text")
    return rows.select("doc_id", "row_no", *named, row_text)


def course_states(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Attach the current block, elective requirement and subgroup to each row.

    A block row, a total row or a plain number in the compulsory cell ends the
    requirement and the subgroup; on such a row a new requirement may start. A
    subgroup needs a requirement and remembers the one it was opened under.

    Like ``running``, this works on chunks of a table and one summary row per
    chunk. Rows before the first event of a chunk do not know the requirement
    that reaches them, so a label there is kept as a candidate: it counts only if
    the summary says that a requirement is open at the start of the chunk.
    """
    named = positional(rows)
    is_block = F.contains("marker", F.lit(BLOCK_MARK))
    is_total = ~is_block & F.startswith("marker", F.lit(TOTAL_WORD))
    course_row = F.col("kind") == "course"
    digits = fd.is_digits(F.col("compulsory"))
    named = named.withColumn("kind", F.when(is_block, "block").when(is_total, "total").otherwise("course"))

    no_text = F.lit(None).cast("string")
    resets = ~course_row | digits
    requirement = F.when(
        course_row & (F.col("elective") != ""), F.struct(F.col("elective").alias("value"))
    ).when(resets, F.struct(no_text.alias("value")))
    label = F.when(course_row & (F.col("compulsory") != "") & ~digits, F.col("compulsory"))
    block = F.when(F.col("kind") == "block", tx.strip(F.replace("marker", F.lit(BLOCK_MARK), F.lit(""))))

    part = ["doc_id", "_chunk"]
    ordered = Window.partitionBy(*part).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(ordered)
    inside = named.select(
        "*", F.floor(F.col("row_no") / chunk_rows).alias("_chunk"), requirement.alias("_event"), label.alias("_label"),
        block.alias("_name"), resets.alias("_resets"),
    ).select("*", latest("_name").alias("_block"), latest("_event").alias("_req"))
    known = F.when(
        F.col("_label").isNotNull() & F.col("_req.value").isNotNull(),
        F.struct(F.col("_label").alias("value"), F.col("_req.value").alias("under")),
    ).when(F.col("_resets"), F.struct(no_text.alias("value"), no_text.alias("under")))
    candidate = F.when(F.col("_req").isNull(), F.col("_label"))
    inside = inside.select("*", latest(known).alias("_sub"), latest(candidate).alias("_maybe"))

    # One row per chunk: its last states; then what reaches each chunk from before.
    ends = inside.groupBy(*part).agg(
        F.max_by(F.struct("_block", "_req", "_sub", "_maybe"), "row_no").alias("e")
    ).select(*part, "e.*")
    before = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    reaching = lambda c: F.last(c, ignorenulls=True).over(before)
    ends = ends.select("*", reaching("_block").alias("_block0"), reaching("_req").alias("_req0"))
    promoted = lambda maybe: F.when(
        maybe.isNotNull() & F.col("_req0.value").isNotNull(),
        F.struct(maybe.alias("value"), F.col("_req0.value").alias("under")),
    )
    carried = ends.select(
        *part, "_block0", "_req0", F.coalesce("_sub", promoted(F.col("_maybe"))).alias("_end")
    ).select(*part, "_block0", "_req0", reaching("_end").alias("_sub0"))

    joined = inside.join(carried, part, "left")
    current = F.coalesce("_req", "_req0")["value"]
    subgroup = F.coalesce(F.col("_sub"), promoted(F.col("_maybe")), F.col("_sub0"))
    return joined.select(
        *named.columns,
        F.coalesce("_block", "_block0").alias("block"),
        current.alias("requirement"),
        subgroup["value"].alias("subgroup"),
        subgroup["under"].alias("subgroup_under"),
        (F.col("_label").isNotNull() & current.isNotNull()).alias("opens_subgroup"),
    )


def block_id(program_id: Column) -> Column:
    return F.when(
        F.col("block").isNotNull(),
        tx.slug_id(F.concat_ws("_", program_id, F.col("block"))),
    )


def _requirement_id(block: Column, requirement: Column) -> Column:
    # Without a block the prefix is the word None.
    return F.when(
        requirement.isNotNull(),
        tx.slug_id(F.concat(F.coalesce(block, F.lit("None")), F.lit("_REQ_"), requirement)),
    )


def with_ids(states: DataFrame, programmes: DataFrame) -> DataFrame:
    """Join ``programmes(doc_id, program_id, ten_nganh, loai_hinh)`` and build ids."""
    joined = states.join(programmes, "doc_id")
    joined = joined.withColumn("block_id", block_id(F.col("program_id")))
    joined = joined.withColumn("req_id", _requirement_id(F.col("block_id"), F.col("requirement")))
    sub_req = _requirement_id(F.col("block_id"), F.col("subgroup_under"))
    return joined.withColumn(
        "sub_id",
        F.when(
            F.col("subgroup").isNotNull(),
            tx.slug_id(F.concat(sub_req, F.lit("_SUB_"), F.col("subgroup"))),
        ),
    ).withColumn("container_id", F.when(
        F.col("block_id").isNotNull(), F.coalesce("sub_id", "req_id", "block_id")
    ))


def block_totals(states: DataFrame, *keys: str) -> DataFrame:
    """Credits of each block from its last total row; a missing number is 0."""
    text = F.col("row_text")
    totals = F.struct(
        fd.credit_total(text, fd.TOTAL_ALL).alias("tong_tin_chi"),
        fd.credit_total(text, fd.TOTAL_COMPULSORY).alias("tin_chi_bat_buoc"),
        fd.credit_total(text, fd.TOTAL_ELECTIVE).alias("tin_chi_tu_chon"),
    )
    keys = keys or ("doc_id", "block")
    return (
        states.where((F.col("kind") == "total") & F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(totals, F.col("row_no")).alias("t"))
        .select(*keys, "t.*")
    )


# Which item of which row a record comes from.
SLOT = "struct<row_no:bigint,item:bigint>"


def _slot(item: Column) -> Column:
    return F.struct(F.col("row_no").cast("bigint").alias("row_no"), item.cast("bigint").alias("item"))


def course_nodes(table: DataFrame) -> DataFrame:
    """Block, requirement, subgroup and course nodes of a table from ``with_ids``.

    Each row yields its records in one pass. Nodes made from a heading or label
    keep their first occurrence in a table, blocks take the last totals, courses
    are all kept as submitted.
    """
    major = F.concat(F.col("ten_nganh"), F.lit(" ("), F.col("loai_hinh"), F.lit(")"))
    block_word = F.coalesce("block_id", F.lit("None"))
    no_slot = F.lit(None).cast(SLOT)
    no_totals = F.lit(None).cast("struct<tong:int,bat_buoc:int,tu_chon:int>")
    no_entries = F.array().cast("array<struct<key:string,value:string>>")

    def entries(**values: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()
        ])

    def record(label: str, node_id: Column, text: Column, props: Column, slot=no_slot, totals=no_totals,
               opens=F.lit(True)) -> Column:
        return F.struct(
            F.lit(label).alias("label"), node_id.alias("id"), slot.alias("slot"),
            text.alias("text"), props.alias("props"), totals.alias("totals"), opens.alias("opens"),
        )

    row_text = F.col("row_text")
    totals = F.struct(
        fd.credit_total(row_text, fd.TOTAL_ALL).alias("tong"),
        fd.credit_total(row_text, fd.TOTAL_COMPULSORY).alias("bat_buoc"),
        fd.credit_total(row_text, fd.TOTAL_ELECTIVE).alias("tu_chon"),
    )
    block_text = F.concat(F.col("block"), F.lit(" - Ngành "), major)
    block = record("KhoiKienThuc", F.col("block_id"), block_text, entries(ten_khoi=F.col("block")))
    total = record("KhoiKienThuc", F.col("block_id"), F.lit(""), no_entries, totals=totals, opens=F.lit(False))
    requirement = record(
        "YeuCauTuChon", F.col("req_id"),
        F.concat(F.lit("Số tín chỉ yêu cầu tự chọn trong khối "), block_word, F.lit(" - Ngành "), major,
                 F.lit(": "), F.col("requirement")),
        entries(noi_dung_yeu_cau=F.col("requirement"),
                mo_ta=F.concat(F.lit("Yêu cầu tự chọn trong khối "), block_word)),
    )
    subgroup = record(
        "NhomHocPhanTuChon", F.col("sub_id"),
        F.concat(F.lit("Nhóm học phần tự chọn - Ngành "), major, F.lit(": "), F.col("subgroup")),
        entries(ten_nhom=F.col("subgroup")),
    )
    name = fd.course_name(F.col("name"))
    hours = lambda c: F.coalesce(tx.nullify(F.col(c)), F.lit("0"))

    def course(hp: Column, i: Column) -> Column:
        return record(
            "HocPhan", tx.slug_id(hp),
            F.concat(
                F.lit("Học phần "), hp, F.lit(" - "), name, F.lit(" có số tín chỉ là "),
                F.col("credits"), F.lit(", số tiết lý thuyết là "), hours("theory"),
                F.lit(", số tiết thực hành là "), hours("practice"), F.lit("."),
            ),
            entries(ma_hp=hp, ten_hp=name, so_tin_chi=F.col("credits"), so_tiet_ly_thuyet=hours("theory"),
                    so_tiet_thuc_hanh=hours("practice"), bat_buoc=F.col("req_id").isNull()),
            slot=_slot(i),
        )

    is_course = F.col("kind") == "course"
    found = F.when(F.col("kind") == "block", F.array(block)).when(
        F.col("kind") == "total", F.array(total)
    ).otherwise(F.concat(
        F.array_compact(F.array(
            F.when(is_course & (F.col("elective") != ""), requirement), F.when(F.col("opens_subgroup"), subgroup)
        )),
        F.transform(fd.course_codes(F.col("code")), course),
    ))
    # A row can become many nodes: rows are dealt out before, or few tasks would sort all of them.
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.repartition(tasks, "doc_id", "row_no")
    rows = dealt.select("doc_id", "row_no", F.explode(found).alias("r")).select("doc_id", "row_no", "r.*").where(
        "id is not null"
    )
    # The slot keeps courses apart; all other nodes meet without one.
    first = F.min_by(F.struct("text", "props", "row_no"), F.when(F.col("opens"), F.col("row_no")))
    last_totals = F.max_by("totals", F.when(F.col("totals").isNotNull(), F.col("row_no")))
    nodes = rows.groupBy("doc_id", "label", "id", "slot").agg(first.alias("n"), last_totals.alias("t")).where(
        "n is not null"
    )
    number = lambda f: F.coalesce(F.col("t")[f], F.lit(0)).cast("string")
    is_block = F.col("label") == "KhoiKienThuc"
    block_sentence = F.when(F.col("t").isNull(), F.lit("")).otherwise(F.concat(
        F.col("n.text"), F.lit(" có số tín chỉ bắt buộc: "), number("bat_buoc"),
        F.lit(", số tín chỉ tự chọn: "), number("tu_chon"), F.lit(", tổng cộng: "), number("tong"),
        F.lit(" tín chỉ."),
    ))
    credits = entries(
        tong_tin_chi=number("tong"), tin_chi_bat_buoc=number("bat_buoc"), tin_chi_tu_chon=number("tu_chon")
    )
    return nodes.select(
        "label", "id", F.when(is_block, block_sentence).otherwise(F.col("n.text")).alias("text"),
        F.map_from_entries(
            F.when(is_block, F.concat(F.col("n.props"), credits)).otherwise(F.col("n.props"))
        ).alias("props"),
        "doc_id", F.col("n.row_no").alias("row_no"),
        F.when(is_block, 0).when(F.col("slot").isNull(), 1).otherwise(2).alias("place"),
        F.coalesce("slot.item", F.lit(0)).alias("item"),
    )


def course_edges(table: DataFrame) -> DataFrame:
    """Edges of a table from ``with_ids``; those without both ends are left out."""
    edge = lambda s, t, d: F.struct(
        s.alias("source"), F.lit(t).alias("type"), d.alias("target")
    )
    opens_requirement = (F.col("kind") == "course") & (F.col("elective") != "")
    structure = F.array_compact(F.array(
        F.when(F.col("kind") == "block", edge(F.col("program_id"), "CO_KHOI_KIEN_THUC", F.col("block_id"))),
        F.when(opens_requirement, edge(F.col("block_id"), "CO_YEU_CAU_TU_CHON", F.col("req_id"))),
        F.when(F.col("opens_subgroup"), edge(F.col("req_id"), "CO_NHOM_THANH_PHAN", F.col("sub_id"))),
    ))
    codes = F.when(F.col("kind") == "course", fd.course_codes(F.col("code"))).otherwise(
        F.array().cast("array<string>")
    )

    def of_course(hp: Column) -> Column:
        hp_id = tx.slug_id(hp)
        link = lambda rel: lambda c: edge(hp_id, rel, tx.slug_id(c))
        return F.concat(
            F.array(edge(F.col("container_id"), "GOM_HOC_PHAN", hp_id)),
            F.transform(fd.course_codes(F.col("prerequisites")), link("YEU_CAU_TIEN_QUYET")),
            F.transform(fd.course_codes(F.col("corequisites")), link("CO_THE_SONG_HANH")),
        )

    # A block, requirement or subgroup is linked once per table, a course each time.
    linked = F.concat(
        F.transform(structure, lambda e: F.struct(e.alias("e"), F.lit(None).cast(SLOT).alias("slot"))),
        F.transform(
            F.flatten(F.transform(codes, of_course)),
            lambda e, i: F.struct(e.alias("e"), _slot(i).alias("slot")),
        ),
    )
    return (
        table.select("doc_id", "row_no", F.posexplode(linked).alias("place", "l"))
        .select("doc_id", "l.e.source", "l.e.type", "l.e.target", "l.slot", "row_no", "place")
        .where("source <> '' and target <> ''")
        .groupBy("doc_id", "source", "type", "target", "slot")
        .agg(F.min(F.struct("row_no", "place")).alias("at"))
        .select("doc_id", "source", "type", "target", "at.row_no", "at.place")
    )
