"""Regulations: texts to trees, trees to graph rows, citations to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regulation as rg
from ..session import stage
from .graph import entries_map


def parse_regulations(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, file_name, text)`` to ``(doc_id, reg)``; no shuffle."""
    marked = docs.select("doc_id", "file_name", rg.marked_text(rg.clean_lines(F.col("text"))).alias("marked"))
    return marked.select("doc_id", rg.tree(F.col("marked"), F.col("file_name")).alias("reg"))


def metrics(trees: DataFrame) -> DataFrame:
    reg = F.col("reg")
    text = trees.select("doc_id", "reg", rg.full_text(reg).alias("full_text"))
    return text.select(
        "doc_id",
        rg.node_count(reg).alias("nodes"),
        rg.edge_count(reg).alias("edges"),
        rg.section_count(reg).alias("section_count"),
        F.length("full_text").alias("extracted_text_length"),
        F.left("full_text", F.lit(12000)).alias("extracted_preview"),
    )


def _entry(**values: Column) -> Column:
    """Properties as an array of key and value, so rows stay comparable."""
    return F.array(*[
        F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()
    ])


ROOT_LABEL = "VanBan"


def _item(label, node_id, parent, relation, key, props, texts) -> Column:
    return F.struct(
        F.lit(label).alias("label"), node_id.alias("id"), parent.alias("parent"),
        F.lit(relation).alias("relation"), key.alias("key"), props.alias("props"),
        texts.alias("texts"),
    )


def flatten_trees(trees: DataFrame) -> DataFrame:
    """One row per document, chapter, article, clause and point, in reading order.

    ``key`` is the citation address inside the document (article, clause and
    point numbers joined by a bar); ``texts`` are searched for citations.
    """
    reg = F.col("reg")
    no_texts = F.array().cast("array<string>")
    doc_node = F.col("vb_id")

    def point_items(clause_id, clause_key):
        return lambda d: _item(
            "Diem", F.concat(clause_id, F.lit("_Diem"), d["ky_hieu"]), clause_id, "co_diem",
            F.concat_ws("|", clause_key, d["ky_hieu"]),
            _entry(ky_hieu=d["ky_hieu"], noi_dung=d["noi_dung"]), F.array(d["noi_dung"]),
        )

    def clause_items(article_id, article_key):
        def items(k):
            clause_id = F.concat(article_id, F.lit("_Khoan"), k["so"])
            clause_key = F.concat_ws("|", article_key, k["so"])
            own = _item(
                "Khoan", clause_id, article_id, "co_khoan", clause_key,
                _entry(so=k["so"], noi_dung=k["noi_dung"]), F.array(k["noi_dung"]),
            )
            return F.concat(F.array(own), F.transform(k["cac_diem"], point_items(clause_id, clause_key)))
        return items

    def article_items(chapter_id):
        def items(a):
            number = F.btrim(F.replace(a["id"], F.lit(rg.ARTICLE_LABEL), F.lit("")))
            article_id = F.concat(chapter_id, F.lit("_Dieu"), number)
            own = _item(
                "Dieu", article_id, chapter_id, "co_dieu", number,
                _entry(so=number, tieu_de=a["tieu_de"]), F.array(a["tieu_de"], a["noi_dung"]),
            )
            below = F.flatten(F.transform(a["cac_khoan"], clause_items(article_id, number)))
            return F.concat(F.array(own), below)
        return items

    def chapter_items(c):
        chapter_id = F.concat(doc_node, F.lit("_"), F.replace(c["chuong"], F.lit(" "), F.lit("")))
        own = _item("Chuong", chapter_id, doc_node, "co_chuong", F.lit(None).cast("string"),
                    _entry(ten=c["ten"]), no_texts)
        return F.concat(F.array(own), F.flatten(F.transform(c["cac_dieu"], article_items(chapter_id))))

    root = _item(
        ROOT_LABEL, doc_node, F.lit(None).cast("string"), None, F.lit(None).cast("string"),
        _entry(ten=F.col("ten"), nguon=F.col("nguon")), no_texts,
    )
    named = trees.select(
        "doc_id", reg["quy_dinh_chi_tiet"].alias("chapters"), rg.document_id(reg).alias("vb_id"),
        rg.document_title(reg).alias("ten"), reg["metadata"]["ten_file"].alias("nguon"),
    )
    items = F.concat(F.array(root), F.flatten(F.transform("chapters", chapter_items)))
    return named.select("doc_id", F.posexplode(items).alias("seq", "i")).select(
        "doc_id", F.array(F.col("seq").cast("bigint")).alias("seq"), "i.*"
    )


def tree_nodes(flat: DataFrame) -> DataFrame:
    return flat.select(
        "label", "id", F.lit(None).cast("string").alias("text"), entries_map("props").alias("props"),
        F.col("doc_id").cast("string").alias("doc_id"), "seq",
    )


def tree_edges(flat: DataFrame) -> DataFrame:
    return flat.where("parent is not null").select(
        F.col("parent").alias("source"), F.col("relation").alias("type"), F.col("id").alias("target"),
        F.create_map().cast("map<string,string>").alias("props"),
        F.col("doc_id").cast("string").alias("doc_id"), "seq",
    )


def addresses(flat: DataFrame) -> DataFrame:
    """The small part of the tree that citations need: ids by address, and who cites what."""
    return flat.where("key is not null").select(
        "doc_id", "key", "id", "seq", F.flatten(F.transform("texts", rg.citations)).alias("cites")
    )


def citation_index(addressed: DataFrame) -> DataFrame:
    """Address to node id; a number used twice in a document keeps its last node."""
    return addressed.groupBy("doc_id", "key").agg(F.max_by("id", "seq").alias("id"))


def citation_targets(addressed: DataFrame) -> DataFrame:
    """Distinct citations with the addresses to try, narrow to wide."""
    cited = addressed.select("doc_id", F.col("key").alias("source_key"), F.explode("cites").alias("c")).distinct()
    dieu, khoan, diem = F.col("c.dieu"), F.col("c.khoan"), F.col("c.diem")
    # An address needs all its parts; concat gives null if one is missing.
    tries = F.array(
        F.concat(dieu, F.lit("|"), khoan, F.lit("|"), diem),
        F.concat(dieu, F.lit("|"), khoan),
        dieu,
    )
    return cited.select("doc_id", "source_key", "c", F.posexplode(tries).alias("rank", "key")).where(
        "key is not null"
    )


def citation_edges(flat: DataFrame, keep_unresolved: bool = False) -> DataFrame:
    """``tham_chieu`` edges: the point if it exists, else the clause, else the article.

    Citations are made distinct, then looked up by
    (document, address), so no task gathers a whole document. The addresses are written when
    this is called, so the texts are parsed once for citing and cited nodes.
    ``keep_unresolved`` returns a null target for citations that lead nowhere.
    """
    addressed = stage(addresses(flat), "addresses")
    index = citation_index(addressed)
    sources = index.withColumnRenamed("key", "source_key").withColumnRenamed("id", "source")
    hits = (
        citation_targets(addressed)
        .join(index, ["doc_id", "key"], "left")
        .groupBy("doc_id", "source_key", "c")
        .agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.col("rank"))).alias("target"))
    )
    resolved = hits if keep_unresolved else hits.where("target is not null")
    edges = resolved.join(sources, ["doc_id", "source_key"])
    if keep_unresolved:
        return edges.select("doc_id", "source", "c.dieu", "c.khoan", "c.diem", "target")
    return edges.select("source", F.lit("tham_chieu").alias("type"), "target", "doc_id").distinct()
