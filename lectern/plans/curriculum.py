"""Programme documents to graph rows.

A document stays one row until its sections are known, so cutting, classifying
and giving context to sections needs no shuffle. Each section then yields an
array of records, a node with its edges, in one narrow step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as fd
from ..functions import sections as sc
from ..functions import text as tx
from ..operators import courses as co
from ..session import stage

DECISION = "QUYET_DINH"
CONTEXT_FIELDS = ("program_id", "ten_nganh", "loai_hinh")
NOT_SEEN = "UNKNOWN"

EDGE_TYPE = "struct<source:string,type:string,target:string>"
RECORD_TYPE = (
    "array<struct<label:string,id:string,text:string,props:map<string,string>,"
    f"edges:array<{EDGE_TYPE}>>>"
)


def refine(docs: DataFrame) -> DataFrame:
    """Markdown with headings upgraded and emphasis removed."""
    return docs.withColumn("text", tx.refine(F.col("text")))


def pick_text(candidates: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """First non-blank candidate column per document, and the documents without one."""
    text, source = tx.first_nonblank([(name, F.col(name)) for name in order])
    picked = candidates.withColumn("text", text).withColumn("extraction_source", source).drop(*order)
    return picked.where("text is not null"), picked.where("text is null").drop("text")


def sections_with_context(refined: DataFrame) -> DataFrame:
    """One row per section with the programme it belongs to.

    The general section sets the context for the sections after it; those before
    it, and all sections of a document without one, see ``UNKNOWN``. The issuing
    decision is the first section once more, at the end, so it sees the last word.
    """
    docs = refined.select(
        "doc_id",
        sc.sections(F.col("text")).alias("parts"),
        fd.cohort_year(F.col("text")).alias("year"),
        fd.is_high_quality(F.col("text")).alias("high_quality"),
        fd.date_in_words(F.col("text")).alias("words_date"),
    )
    typed = docs.withColumn(
        "parts",
        F.transform("parts", lambda p, i: tx.let(sc.header_of(p), lambda header: F.struct(
            i.alias("no"), header.alias("header"), sc.content_of(p).alias("content"),
            sc.concept_of(header).alias("type"), p.alias("whole"),
        ))),
    )

    def general(p: Column) -> Column:
        parsed = fd.programme(p["content"], F.col("year"), F.col("high_quality"))
        return F.struct(p["no"].alias("no"), parsed.alias("is"))

    known = typed.withColumn(
        "known", F.transform(F.filter("parts", lambda p: p["type"] == "THONG_TIN_CHUNG"), general)
    )
    # The decision comes last and carries the whole first section.
    decision = F.transform(
        F.slice("parts", 1, 1),
        lambda p: p.withField("type", F.lit(DECISION)).withField("no", F.size("parts")),
    )
    listed = F.concat(
        F.transform("parts", lambda p: p.withField("whole", F.lit(None).cast("string"))), decision
    )
    last = lambda keep: F.try_element_at(F.filter("known", keep), F.lit(-1))
    placed = F.transform(
        listed,
        lambda p: F.struct(
            p.alias("s"),
            last(lambda k: k["no"] < p["no"]).alias("before"),
            last(lambda k: k["no"] == p["no"]).alias("own"),
        ),
    )
    rows = known.select("doc_id", "words_date", F.explode(placed).alias("x"))
    context = [F.coalesce(F.col("x.before.is")[f], F.lit(NOT_SEEN)).alias(f) for f in CONTEXT_FIELDS]
    return rows.select(
        "doc_id", "words_date", F.col("x.s.no").alias("section_no"), "x.s.type", "x.s.header",
        "x.s.content", "x.s.whole", F.col("x.own.is").alias("own"), *context,
    )


def _props(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _edge(source: Column, relation: str, target: Column) -> Column:
    return F.struct(source.alias("source"), F.lit(relation).alias("type"), target.alias("target"))


def _record(label, node_id: Column, text: Column, props: Column, *edges: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(
        label.alias("label"), node_id.alias("id"), text.alias("text"), props.alias("props"),
        (F.array(*edges) if edges else F.array().cast(f"array<{EDGE_TYPE}>")).alias("edges"),
    )


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])




def _general_records() -> Column:
    g = F.col("own")
    program, name, kind = g["program_id"], g["ten_nganh"], g["loai_hinh"]
    unit_id = tx.slug_id(g["don_vi"])
    unit_word = F.when(g["don_vi_nhan"] == "BoMon", F.lit("Bộ môn")).otherwise(F.lit("Khoa"))
    unit_props = F.when(
        g["don_vi_nhan"] == "BoMon", _props(ten_bomon=g["don_vi"])
    ).otherwise(_props(ten_khoa=g["don_vi"]))
    degree = fd.degree_id(g["van_bang"])
    fixed = F.array(
        _record("Nganh", g["ma_nganh"], name,
                _props(ten_nganh_vi=g["ten_nganh_vi"], ten_nganh_en=g["ten_nganh_en"])),
        _record(g["don_vi_nhan"], unit_id,
                _say("Ngành ", name, " thuộc ", unit_word, ": ", g["don_vi"]), unit_props,
                _edge(g["ma_nganh"], "THUOC_VE", unit_id)),
        _record("ChuongTrinhDaoTao", program,
                _say("Chương trình đào tạo ngành ", name, " khóa ", g["khoa"].cast("string"),
                     ", loại hình ", kind, ". Tổng số tín chỉ yêu cầu: ", g["tin_chi"],
                     ". Thời gian đào tạo: ", g["thoi_gian"], " năm. Ngôn ngữ giảng dạy: ",
                     g["ngon_ngu"], "."),
                _props(ma_chuong_trinh=program, khoa=g["khoa"], loai_hinh=kind, ngon_ngu=g["ngon_ngu"],
                       tong_tin_chi=tx.safe_int(g["tin_chi"]), thoi_gian_dao_tao=tx.safe_float(g["thoi_gian"])),
                _edge(program, "THUOC_VE", g["ma_nganh"])),
        _record("LoaiVanBang", degree,
                _say("Loại văn bằng - Ngành ", name, " (", kind, "): ", g["van_bang"]),
                _props(loai_van_bang=g["van_bang"]),
                _edge(program, "CO_LOAI_VAN_BANG", degree)),
    )
    forms = F.transform(fd.split_list(g["hinh_thuc"]), lambda f: _record(
        "HinhThucDaoTao", tx.slug_id(f), _say("Hình thức đào tạo - Ngành ", name, ": ", f),
        _props(ten_hinh_thuc=f), _edge(program, "DAO_TAO_THEO_HINH_THUC", tx.slug_id(f)),
    ))
    methods = F.transform(fd.split_list(g["phuong_thuc"]), lambda m: _record(
        "PhuongThucDaoTao", fd.method_id(m),
        _say("Phương thức đào tạo - Ngành ", name, " (", kind, "): ", m),
        _props(ten_phuong_thuc=m),
        _edge(program, "DAO_TAO_THEO_PHUONG_THUC", fd.method_id(m)),
        _edge(fd.method_id(m), "CO_QUY_DINH", fd.method_regulation(fd.method_id(m))),
    ))
    return F.concat(fixed, forms, methods)


def _titled(words: str) -> list:
    return [words, " - Ngành ", F.col("ten_nganh"), " (", F.col("loai_hinh"), "): "]


def _objective_records() -> Column:
    program = F.col("program_id")
    return F.transform(fd.objectives(F.col("content")), lambda o: _record(
        "MucTieuDaoTao", F.concat_ws("_", program, o["key"]),
        _say(o["heading"], *_titled("")[1:], o["noi_dung"]),
        _props(loai=o["loai"], noi_dung=o["noi_dung"]),
        _edge(program, "CO_MUC_TIEU_DAO_TAO", F.concat_ws("_", program, o["key"])),
    ))


def _bullet_records(label: str, mark: str, words: str, relation: str, extra: dict) -> Column:
    program = F.col("program_id")

    def record(item: Column, i: Column) -> Column:
        node_id = F.concat(program, F.lit(f"_{mark}_"), (i + 1).cast("string"))
        return _record(
            label, node_id, _say(*_titled(words), item),
            _props(**{k: F.lit(v) for k, v in extra.items()}, noi_dung=item),
            _edge(program, relation, node_id),
        )

    return F.transform(fd.bullets(F.col("content")), record)


def _reference_records() -> Column:
    program = F.col("program_id")
    refs = fd.bullets(F.col("content"))

    def legal(ref: Column) -> Column:
        f = fd.legal_reference(ref)
        return tx.let(f.pop("id"), lambda node_id: _record(
            "VanBanPhapLy", node_id, _say(*_titled("Căn cứ văn bản pháp lý"), ref), _props(**f),
            _edge(program, "TUAN_THU", node_id),
        ))

    def plain(ref: Column, i: Column) -> Column:
        node_id = F.concat(program, F.lit("_ctk_"), (i + 1).cast("string"))
        return tx.let(fd.plain_reference(ref), lambda f: _record(
            "ChuanThamKhao", node_id, _say(*_titled("Chuẩn tham khảo"), f["noi_dung"]),
            _props(noi_dung=f["noi_dung"], link=f["link"], noi_dung_goc=f["noi_dung_goc"]),
            _edge(program, "THAM_CHIEU", node_id),
        ))

    marked = F.transform(refs, lambda r: F.struct(r.alias("ref"), fd.is_legal(r).alias("legal")))
    return tx.let(marked, lambda all_refs: F.concat(
        F.transform(F.filter(all_refs, lambda r: r["legal"]), lambda r: legal(r["ref"])),
        F.transform(F.filter(all_refs, lambda r: ~r["legal"]), lambda r, i: plain(r["ref"], i)),
    ))


def _outcome_records(join_continuations: bool) -> Column:
    program = F.col("program_id")

    def record(o: Column) -> Column:
        return tx.let(tx.slug_id(F.concat_ws("_", program, o["code"])), lambda node_id: _record(
            "ChuanDauRa", node_id, _say(*_titled("Chuẩn đầu ra"), o["noi_dung"]),
            _props(noi_dung=o["noi_dung"], nhom=o["nhom"], loai=o["loai"]),
            _edge(program, "DAT_CHUAN_DAU_RA", node_id),
        ))

    return F.transform(fd.outcomes(F.col("content"), join_continuations), record)


def _decision_records() -> Column:
    program, name = F.col("program_id"), F.col("ten_nganh")

    def records(f: Column) -> Column:
        kept = ("so", "ten", "loai", "ngay_ban_hanh", "co_quan_ban_hanh", "noi_dung_goc")
        level_id = tx.slug_id(f["trinh_do"])
        return F.array(
            _record("VanBanPhapLy", f["id"],
                    _say("Chương trình đào tạo ngành ", name, " được ban hành theo ", f["noi_dung_goc"]),
                    _props(**{k: f[k] for k in kept}), _edge(program, "DUOC_BAN_HANH_THEO", f["id"])),
            _record("TrinhDo", level_id, _say("Trình độ đào tạo - Ngành ", name, ": ", f["trinh_do"]),
                    _props(ten_trinh_do=f["trinh_do"]), _edge(program, "DAO_TAO_TRINH_DO", level_id)),
        )

    def fields(text: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in fd.decision(text, F.col("words_date")).items()])

    return tx.let(tx.let(tx.drop_heading_marks(F.col("whole")), fields), records)


RECORDS = {
    "THONG_TIN_CHUNG": _general_records,
    "MUC_TIEU": _objective_records,
    "VI_TRI_VIEC_LAM": lambda: _bullet_records(
        "ViTriViecLam", "vtvl", "Vị trí việc làm", "CO_CO_HOI_VIEC_LAM", {"loai": "CuThe"}
    ),
    "KHA_NANG_HOC_TAP": lambda: _bullet_records("KhaNangHocTap", "knht", "Khả năng học tập", "TAO_NEN_TANG", {}),
    "THAM_KHAO": _reference_records,
    "CHUAN_DAU_RA": lambda: _outcome_records(False),
    DECISION: _decision_records,
}


def _records_of_type(join_continuations: bool, types: tuple[str, ...]) -> Column:
    """The records of a section, by its type; null for other types."""
    by_type = {t: RECORDS[t] for t in types}
    if join_continuations and "CHUAN_DAU_RA" in by_type:
        by_type["CHUAN_DAU_RA"] = lambda: _outcome_records(True)
    chain = F
    for name, records in by_type.items():
        chain = chain.when(F.col("type") == name, records().cast(RECORD_TYPE))
    return chain


def section_records(sections: DataFrame, join_continuations: bool = False,
                    types: tuple[str, ...] = tuple(RECORDS)) -> DataFrame:
    """``(doc_id, seq, label, id, text, props, edges)`` of the sections of some types.

    Course tables come from their own rows. ``join_continuations`` joins wrapped
    lines of learning outcomes before reading them.
    """
    # The array goes straight into the generator. As a column of its own it would
    # be computed again by the size filter that the optimizer puts under explode.
    rows = sections.where(F.col("type").isin(*types))
    records = _records_of_type(join_continuations, types)
    return rows.select("doc_id", "section_no", F.posexplode(records).alias("place", "r")).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.array(F.col("section_no").cast("bigint"), F.col("place").cast("bigint")).alias("seq"),
        "r.*",
    )


def record_nodes(records: DataFrame) -> DataFrame:
    return records.select("label", "id", "text", "props", "doc_id", "seq")


def record_edges(records: DataFrame) -> DataFrame:
    """Edges of the records; one with an empty end is left out."""
    return (
        records.select("doc_id", "seq", F.explode("edges").alias("e"))
        .select("e.source", "e.type", "e.target", F.create_map().cast("map<string,string>").alias("props"),
                "doc_id", "seq")
        .where("source <> '' and target <> ''")
    )


def table_context(sections: DataFrame) -> DataFrame:
    """Programmes whose course-table section is present: one row per context."""
    return sections.where("type = 'KHUNG_CHUONG_TRINH'").select("doc_id", *CONTEXT_FIELDS).distinct()


def curriculum_graph(docs: DataFrame, course_rows: DataFrame | None = None,
                     join_continuations: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` and ``course_rows(doc_id, row_no, cells)`` to nodes and edges.

    The rows are as submitted: duplicates are left for the upsert to merge. Sections and
    cleaned course rows are written once: nodes, edges and the course table read them, and no
    text is parsed again.
    """
    sections = stage(sections_with_context(refine(docs)), "sections")
    records = section_records(sections, join_continuations)
    nodes, edges = record_nodes(records), record_edges(records)
    if course_rows is not None:
        states = co.course_states(stage(co.clean_rows(course_rows), "course-rows"))
        table = co.with_ids(states, table_context(sections))
        # Course rows rank before all sections of their document, in the order of the table.
        order = lambda *names: F.array(
            F.lit(-1).cast("bigint"), *[F.col(c).cast("bigint") for c in names]
        ).alias("seq")
        doc = F.col("doc_id").cast("string").alias("doc_id")
        nodes = nodes.unionByName(co.course_nodes(table).select(
            "label", "id", "text", "props", doc, order("row_no", "place", "item")
        ))
        edges = edges.unionByName(co.course_edges(table).select(
            "source", "type", "target", F.create_map().cast("map<string,string>").alias("props"), doc,
            order("row_no", "place"),
        ))
    return nodes, edges


def _document_base(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "extraction_source",
        F.length("text").alias("extracted_text_length"), tx.preview(F.col("text")).alias("extracted_preview"),
    )


def programme_metrics(docs: DataFrame, join_continuations: bool = False) -> DataFrame:
    """``ingestion_metrics`` of programme documents, whose records nobody else needs.

    Records are counted where they are made, so each text is parsed once.
    """
    sections = sections_with_context(refine(docs))
    complete = lambda e: (e["source"] != "") & (e["target"] != "")
    edges = lambda r: F.size(F.filter(r["edges"], complete))
    made = F.coalesce(_records_of_type(join_continuations, tuple(RECORDS)), F.array().cast(RECORD_TYPE))
    counted = tx.let(made, lambda records: F.struct(
        F.size(records).alias("nodes"),
        F.aggregate(F.transform(records, edges), F.lit(0), lambda n, m: n + m).alias("edges"),
    ))
    counts = sections.select(F.col("doc_id").cast("string").alias("doc_id"), "type", counted.alias("n")).groupBy("doc_id").agg(
        F.sum("n.nodes").alias("nodes"), F.sum("n.edges").alias("edges"),
        F.count_if(F.col("type") != DECISION).alias("section_count"),
    )
    return _document_base(docs).join(counts, "doc_id", "left").fillna(0, ["nodes", "edges", "section_count"])


def ingestion_metrics(docs: DataFrame, nodes: DataFrame, edges: DataFrame, sections: DataFrame,
                      stored_edges: DataFrame | None = None) -> DataFrame:
    """Per document: rows submitted, sections, text length and preview.

    ``docs(doc_id, text, extraction_source)``. Counts are of submitted rows; give
    ``stored_edges`` to see how many edges found both ends.
    """
    per_doc = lambda df, name: df.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(
        F.count("*").alias(name)
    )
    base = _document_base(docs)
    counts = [
        per_doc(nodes, "nodes"), per_doc(edges, "edges"),
        per_doc(sections.where(F.col("type") != DECISION), "section_count"),
    ]
    if stored_edges is not None:
        counts.append(per_doc(stored_edges, "stored_edges"))
    for c in counts:
        base = base.join(c, "doc_id", "left")
    filled = {c.columns[1]: 0 for c in counts}
    return base.fillna(filled)
