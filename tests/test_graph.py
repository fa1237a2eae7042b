import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern import model
from lectern.operators import contains
from lectern.operators import graph as gr
from lectern.operators.contains import contains_join
from lectern.queries import graph as queries
from lectern.session import stage_by, work_folder
from lectern.sources import readers, writers

FOLDER = "/root/testdata/sf0.001"


def nodes_of(spark, rows):
    return spark.createDataFrame([(*r[:-1], [r[-1]]) for r in rows], model.NODES)


def edges_of(spark, rows):
    return spark.createDataFrame([(*r[:-1], [r[-1]]) for r in rows], model.EDGES)


def test_upsert_is_property_wise_and_last_wins(spark):
    rows = [
        ("A", "1", "old", {"x": "1", "y": "1"}, "d", 1),
        ("A", "1", None, {"x": "2"}, "d", 2),
        ("B", "1", None, {}, "d", 3),
        (None, "9", None, {"z": "0"}, "d", 4),
        ("A", "", None, {"x": "9"}, "d", 5),
    ]
    for shuffled in (rows, rows[::-1]):
        got = {(r.label, r.id): r.props for r in gr.upsert_nodes(gr.unify_nodes(nodes_of(spark, shuffled))).collect()}
        assert got == {("A", "1"): {"x": "2", "y": "1", "text": "old"}, ("B", "1"): {}, ("Entity", "9"): {"z": "0"}}


def test_edges_merge_and_need_both_ends(spark):
    nodes = nodes_of(spark, [("A", "1", None, {}, "d", 1), ("B", "1", None, {}, "d", 2), ("A", "2", None, {}, "d", 3)])
    edges = edges_of(spark, [
        ("1", "T", "2", {"p": "1"}, "d", 1), ("1", "T", "2", {"q": "1"}, "d", 2), ("1", None, "2", {}, "d", 3),
        ("1", "T", "7", {}, "d", 4), ("", "T", "2", {}, "d", 5),
    ])
    merged = gr.upsert_edges(edges)
    assert {(r.source, r.type, r.target): r.props for r in merged.collect()} == {
        ("1", "T", "2"): {"p": "1", "q": "1"}, ("1", "RELATED_TO", "2"): {}, ("1", "T", "7"): {},
    }
    resolved = gr.resolve_endpoints(merged.where("type = 'T'"), nodes)
    # an id under two labels fans out
    assert {(r.source_label, r.target) for r in resolved.collect()} == {("A", "2"), ("B", "2")}
    (lost,) = gr.dangling_edges(gr.distinct_edges(edges), nodes).collect()
    assert (lost.target, lost.source_missing, lost.target_missing) == ("7", False, True)


def test_duplicate_ids_and_new_only(spark):
    nodes = nodes_of(spark, [("A", "1", None, {}, "d", 1), ("A", "1", None, {}, "d", 2), ("B", "1", None, {}, "d", 3)])
    assert [tuple(r) for r in gr.duplicate_ids(nodes).collect()] == [("A", "1", 2)]
    fresh = gr.new_only(nodes, nodes.where("label = 'B'"))
    assert [(r.label, r.id) for r in fresh.collect()] == [("A", "1")]


def test_subtree_removal_keeps_parents_without_children(spark):
    nodes = nodes_of(spark, [(l, i, None, {}, "d", 1) for l, i in (("VanBan", "v"), ("Chuong", "c"), ("Chuong", "e"), ("Dieu", "d"), ("VanBan", "w"), ("Dieu", "x"))])
    edges = edges_of(spark, [
        ("v", "co_chuong", "c", {}, "d", 1), ("v", "co_chuong", "e", {}, "d", 2), ("c", "co_dieu", "d", {}, "d", 3),
        ("x", "tham_chieu", "d", {}, "d", 4), ("x", "tham_chieu", "w", {}, "d", 5),
    ])
    left, links = gr.remove_subtree(nodes, edges, spark.createDataFrame([("v",)], "id string"))
    assert {r.id for r in left.collect()} == {"w", "x"}
    assert {(r.source, r.target) for r in links.collect()} == {("x", "w")}


def test_tables_merge_idempotently(spark):
    path = work_folder(spark, "graph")
    first = nodes_of(spark, [("A", "1", "t", {"x": "1"}, "d", 1), ("B", "2", None, {"y": "1"}, "d", 2)])
    later = nodes_of(spark, [("A", "1", None, {"z": "3"}, "e", 1)])
    edges = edges_of(spark, [("1", "T", "2", {}, "d", 1), ("1", "T", "404", {}, "d", 2)])
    for _ in range(2):
        writers.upsert_nodes(first, f"{path}/nodes")
        writers.upsert_nodes(later, f"{path}/nodes")
        writers.upsert_edges(edges, f"{path}/edges", writers.read_nodes(spark, f"{path}/nodes"))
        stored = {(r.label, r.id): r.props for r in writers.read_nodes(spark, f"{path}/nodes").collect()}
        assert stored == {("A", "1"): {"x": "1", "z": "3", "text": "t"}, ("B", "2"): {"y": "1"}}
        assert [(r.source, r.target) for r in writers.read_edges(spark, f"{path}/edges").collect()] == [("1", "2")]
    writers.clear(spark, f"{path}/nodes", writers.NODE_TABLE)
    assert writers.read_nodes(spark, f"{path}/nodes").count() == 0


def test_label_filter_prunes_folders(spark):
    path = work_folder(spark, "pruned")
    writers.upsert_nodes(nodes_of(spark, [("A", "1", None, {}, "d", 1), ("B", "2", None, {}, "d", 2)]), path)
    plan = writers.read_nodes(spark, path).where("label = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan


def test_contains_join_equals_the_full_comparison(spark):
    texts = ["Toán rời rạc", "an", "", "zzz", "CẤU trúc", "a", "nin", "rời rạc 1"]
    names = [(1, "toán rời rạc 1"), (2, "Cấu trúc dữ liệu"), (3, "An ninh"), (4, ""), (5, "an")]
    needles = spark.createDataFrame([(t,) for t in texts + texts], "needle string")
    got = {(r.needle, r.id) for r in contains_join(needles, spark.createDataFrame(names, "id int, name string")).collect()}
    assert got == {(t, i) for t in texts for i, n in names if t.lower() in n.lower()}


def test_catalogue(spark, tmp_path):
    file = tmp_path / "edges.csv"
    file.write_text('Nguồn,Quan hệ,Đích,Ý nghĩa\n(:A),[:T],(:B),"một, hai"\n', encoding="utf-8")
    catalogue = readers.edge_catalogue(spark, str(file))
    assert [tuple(r) for r in catalogue.collect()] == [("A", "T", "B", "một, hai")]
    found = spark.createDataFrame([("A", "T", "B"), ("B", "T", "A")], "source_label string, type string, target_label string")
    assert [r.source_label for r in gr.catalogue_violations(found, catalogue).collect()] == ["B"]


def test_triples_name_both_ends(spark):
    nodes = nodes_of(spark, [("A", "1", None, {"ten": "một"}, "d", 1), ("A", "2", None, {}, "d", 2)])
    edges = edges_of(spark, [("1", "T", "2", {}, "d", 1)])
    (row,) = gr.triples(nodes, edges, default="?").collect()
    assert (row.source_name, row.target_name) == ("một", "?")


def test_embedding_is_folded_into_properties(spark):
    nodes = nodes_of(spark, [("A", "1", "t", {}, "d", 1)]).withColumn("embedding", F.array(F.lit(0.5)))
    assert gr.unify_nodes(nodes).first().props == {"text": "t", "embedding": "[0.5]"}


@pytest.mark.parametrize("n", [2])
def test_json_and_markdown_sinks(spark, n):
    path = work_folder(spark, "files")
    docs = spark.createDataFrame([("a", "xin chào\ndòng hai"), ("b", "đ")], "doc_id string, text string")
    writers.write_json(docs, f"{path}/json")
    assert spark.read.json(f"{path}/json").count() == n
    writers.write_markdown(docs, f"{path}/md")
    writers.write_markdown(docs, None)
    assert {r.value for r in spark.read.text(f"{path}/md").collect()} == {"xin chào", "dòng hai", "đ"}


def test_replacing_documents_leaves_the_others(spark):
    path = work_folder(spark, "documents")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, id string")
    writers.replace_documents(rows(("a", "1"), ("a", "2"), ("b", "3")), path)
    for _ in range(2):
        writers.replace_documents(rows(("a", "9")), path)
        assert {tuple(r) for r in spark.read.parquet(path).select("doc_id", "id").collect()} == {("a", "9"), ("b", "3")}


# --- the stored name index ------------------------------------------------------------


def test_stored_index_equals_the_full_comparison(spark):
    from lectern.operators import contains as co

    path = work_folder(spark, "names")
    texts = ["Toán rời rạc", "an", "", "zzz", "CẤU trúc", "a", "nin", "rời rạc 1", None]
    names = [(1, "toán rời rạc 1"), (2, "Cấu trúc dữ liệu"), (3, "An ninh"), (4, ""), (5, "an"), (6, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string")
    needles = spark.createDataFrame([(t,) for t in texts + texts], "needle string")
    want = lambda rows: {(t, i) for t in texts for i, n in rows if t is not None and n is not None and t.lower() in n.lower()}
    got = lambda rows: sorted((r.needle, r.id) for r in co.look_up_names(needles, frame(rows), path).collect())
    co.append_names(frame(names), path, "0")
    assert got(names) == sorted(want(names))
    # Renamed and new ids are appended; what the old names were is checked away.
    later = [(1, "Đại số"), (7, "Toán rời rạc 1 nâng cao"), (2, "Cấu trúc dữ liệu")]
    for _ in range(2):
        co.append_names(frame(later), path, "1")
        now = [n for n in names if n[0] not in (1, 2)] + later
        assert got(now) == sorted(want(now))
    assert co.look_up_names(needles.limit(0), frame(names), path).count() == 0
    assert co.look_up_names(needles, frame(names), work_folder(spark, "no-index")).where("length(needle) >= 3").count() == 0


def test_lookup_reads_only_the_folders_of_its_grams(spark):
    from lectern.operators import contains as co

    names = spark.range(400).selectExpr("cast(id as int) id", "concat(md5(cast(id as string)), ' môn') name")
    path = co.new_index(spark, names)
    one = spark.createDataFrame([("zzq",)], "needle string")
    plan = co.look_up_names(one, names, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan or "PartitionFilters: [isnotnull(bucket" in plan


# --- tables by folders ------------------------------------------------------------------


def document(doc, chapters=2, articles=3):
    """Nodes and edges of a regulation whose ids begin with its own."""
    nodes, edges = [("VanBan", doc, None, {"ten": doc}, doc, 0)], []
    for c in range(chapters):
        chapter = f"{doc}_C{c}"
        nodes.append(("Chuong", chapter, None, {"ten": f"C{c}"}, doc, len(nodes)))
        edges.append((doc, "co_chuong", chapter, {}, doc, len(edges)))
        for a in range(articles):
            article = f"{chapter}_D{a}"
            nodes.append(("Dieu", article, f"text {a}", {"so": str(a)}, doc, len(nodes)))
            edges.append((chapter, "co_dieu", article, {}, doc, len(edges)))
            if a:
                edges.append((article, "tham_chieu", f"{chapter}_D{a - 1}", {}, doc, len(edges)))
    edges.append((doc, "tham_chieu", "nowhere", {}, doc, len(edges)))
    return nodes, edges


def test_a_new_document_rewrites_few_folders(spark):
    import glob

    path = work_folder(spark, "folders")
    base = path.removeprefix("file:")
    many = [document(f"doc{i}") for i in range(150)]
    nodes = nodes_of(spark, [n for d in many for n in d[0]])
    edges = edges_of(spark, [e for d in many for e in d[1]])
    writers.upsert_nodes(nodes, f"{path}/nodes")
    writers.upsert_edges(edges, f"{path}/edges", nodes_path=f"{path}/nodes")
    kept = {(r.source, r.type, r.target) for r in writers.read_edges(spark, f"{path}/edges").collect()}
    assert kept == {(e[0], e[1], e[2]) for d in many for e in d[1] if e[2] != "nowhere"}
    files = lambda: {t: {f.rsplit("/", 1)[0]: f for f in glob.glob(f"{base}/{t}/*/*/*.parquet")} for t in ("nodes", "edges")}
    before = files()
    more = document("new", 3, 9)
    writers.upsert_nodes(nodes_of(spark, more[0]), f"{path}/nodes")
    writers.upsert_edges(edges_of(spark, more[1]), f"{path}/edges", nodes_path=f"{path}/nodes")
    after = files()
    for table, bound in (("nodes", 3), ("edges", 3)):
        changed = [f for f in after[table] if before[table].get(f) != after[table][f]]
        assert 0 < len(changed) <= bound and len(changed) < 0.05 * len(after[table])
    got = {(r.label, r.id): r.props for r in writers.read_nodes(spark, f"{path}/nodes").collect()}
    assert len(got) == 150 * 9 + len(more[0]) and got["Dieu", "new_C2_D8"] == {"so": "8", "text": "text 8"}
    # A lookup by ids reads their folders only, however many documents there are.
    one = spark.createDataFrame([("new",), ("new_C1",)], "id string")
    some = writers.read_nodes(spark, f"{path}/nodes", one)
    assert some.where("id = 'new_C1_D0'").count() == 1
    assert some.selectExpr("_metadata.file_path p").distinct().count() <= 3


def test_replaced_ids_lose_edges_from_other_folders(spark):
    path = work_folder(spark, "routes")
    ids = ["a", "b", "c", "d_1", "e_2"]
    writers.upsert_nodes(nodes_of(spark, [("A", i, None, {}, "d", 1) for i in ids]), f"{path}/nodes")
    pairs = [(x, y) for x in ids for y in ids if x != y]
    writers.upsert_edges(edges_of(spark, [(x, "T", y, {}, "d", 1) for x, y in pairs]), f"{path}/edges", nodes_path=f"{path}/nodes")
    gone = spark.createDataFrame([("d_1",)], "id string")
    more = edges_of(spark, [("a", "U", "b", {}, "d", 1)])
    writers.upsert_edges(more, f"{path}/edges", replaced=gone, nodes_path=f"{path}/nodes")
    got = {(r.source, r.type, r.target) for r in writers.read_edges(spark, f"{path}/edges").collect()}
    assert got == {(x, "T", y) for x, y in pairs if "d_1" not in (x, y)} | {("a", "U", "b")}


def test_descendants_at_any_depth(spark):
    relations = ("co_chuong", "co_dieu", "co_khoan", "co_diem")
    chain = [(f"n{i}", relations[i % 4], f"n{i + 1}", {}, "d", i) for i in range(7)]
    ring = [("n7", "co_dieu", "n3", {}, "d", 9), ("n2", "tham_chieu", "x", {}, "d", 10), ("y", "co_dieu", "z", {}, "d", 11)]
    edges = edges_of(spark, chain + ring)
    roots = spark.createDataFrame([("n0",), ("n0",), (None,)], "id string")
    assert sorted(r.id for r in gr.descendants(roots, edges).collect()) == [f"n{i}" for i in range(8)]
    assert gr.descendants(roots.limit(0), edges).count() == 0
    four = edges_of(spark, chain[:4])
    assert {r.id for r in gr.descendants(roots, four).collect()} == {r.id for r in gr.subtree(roots.where("id is not null"), four).collect()}


def _shuffled_rows(spark):
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("stored", [False, True])
def test_lookup_shuffles_no_pairs_of_texts_and_hits(spark, stored):
    """Every text's rarest run is in many names: hits times texts are ten times the postings."""
    draw = random.Random(5)
    names = [(i, "".join(draw.choice("xy") for _ in range(9))) for i in range(300)]
    texts = ["".join(t) for t in itertools.product("XY", repeat=8)]
    want = {(t, i) for t in texts for i, n in names if t.lower() in n}
    frame = spark.createDataFrame(names, "id int, name string")
    needles = spark.createDataFrame([(t,) for t in texts], "needle string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = contains.new_index(spark, frame) if stored else None
        before = _shuffled_rows(spark)
        found = contains.look_up_names(needles, frame, index) if stored else contains.contains_join(needles, frame)
        assert {(r.needle, r.id) for r in found.collect()} == want
        # Runs of three letters from two: eight of a name and a text at most.
        assert _shuffled_rows(spark) - before < 6 * 8 * (len(names) + len(texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_rounds_below_a_root_do_not_shuffle_the_links(spark):
    rows = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").count()
    links = rows("nation") + rows("customer") + rows("orders") + 3 * rows("lineitem")
    want = set(_below_r1())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled_rows(spark)
        found = [r.id for r in queries.deep_subtree(spark, FOLDER).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        # Once to be stored; the rounds shuffle the ids found, a fifth of all.
        assert _shuffled_rows(spark) - before < 2.5 * links
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _below_r1():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return [r[0] for r in con.execute(queries.SQL["graph_deep_subtree"]).fetchall()]


def test_stored_by_a_key_is_joined_where_it_lies(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "cast(id as string) as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = stage_by(rows, "held", "k")
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, rows.collect()))
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("held_")]
        before = _shuffled_rows(spark)
        assert held.join(spark.range(3).withColumnRenamed("id", "k"), "k").count() == 429
        assert _shuffled_rows(spark) - before < 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
