"""Graph queries: expansion, upserts, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..plans import retrieval as ret
from ..session import stage, stage_by, work_folder
from ..sources import writers
from ..sources.readers import parse_catalogue
from .derive import EDGES_SQL, NODES_SQL, table, trade_graph


def _entities(spark, d):
    return table(spark, d, "part").select(F.upper(F.concat_ws(" ", "p_name", "p_brand")).alias("entity"))


def prerequisite_answers(spark, d):
    nodes, edges = trade_graph(spark, d)
    courses = ret.courses_of(nodes)
    matches = ret.matching_courses(_entities(spark, d), courses)
    return ret.prerequisite_answers(matches, courses, edges)


def credit_answers(spark, d):
    nodes, _ = trade_graph(spark, d)
    return ret.credit_answers(ret.matching_courses(_entities(spark, d), ret.courses_of(nodes)))


def course_name_or_code(spark, d):
    nodes, _ = trade_graph(spark, d)
    asked = table(spark, d, "part").select(F.concat(F.lit("ct"), F.col("p_partkey").cast("string")).alias("entity"))
    return ret.matching_courses(asked, ret.courses_of(nodes), match_codes=True).select("entity", "id", "name")


def programme_credits(spark, d):
    nodes, edges = trade_graph(spark, d)
    return ret.programme_credits(nodes, edges, "NATION_1", 7)


def elective_requirements(spark, d):
    nodes, edges = trade_graph(spark, d)
    needs = nodes.where("label = 'Nganh'").withColumn("label", F.lit("YeuCauTuChon")).withColumn(
        "props", F.create_map(F.lit("noi_dung_yeu_cau"), F.col("props")["ten_nganh_vi"], F.lit("mo_ta"), F.col("id"))
    )
    links = edges.withColumn("type", F.lit("CO_YEU_CAU_TU_CHON"))
    return ret.elective_requirements(nodes.unionByName(needs), links, "supplier#0000")


def multi_label_expand(spark, d):
    nodes, edges = trade_graph(spark, d)
    return ret.members(nodes, edges, ("ChuongTrinhDaoTao", "KhoiKienThuc"), "THUOC_VE", ("Nganh", "Khoa"))


def first_triples(spark, d):
    nodes, edges = trade_graph(spark, d)
    return gr.triples(nodes, edges, default="(no name)").orderBy("source", "type", "target").limit(5)


def all_triples(spark, d):
    nodes, edges = trade_graph(spark, d)
    return gr.triples(nodes, edges, default="(no name)")


def edge_upsert(spark, d):
    li = table(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    props = F.map_filter(
        F.create_map(
            F.lit("quantity"), F.col("l_quantity").cast("bigint").cast("string"),
            F.lit("flag"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")),
        ),
        lambda k, v: v.isNotNull(),
    )
    edges = li.select(
        F.concat(F.lit("O"), text("l_orderkey")).alias("source"), F.lit("GOM_HOC_PHAN").alias("type"),
        F.concat(F.lit("P"), text("l_partkey")).alias("target"), props.alias("props"),
        "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag",
    )
    version = ("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    merged = gr.upsert_edges(edges, version)
    parts = table(spark, d, "part").where("p_size > 10").select(
        F.concat(F.lit("P"), text("p_partkey")).alias("id"), F.lit("HocPhan").alias("label")
    )
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("O"), text("o_orderkey")).alias("id"), F.lit("Order").alias("label")
    )
    return gr.resolve_endpoints(merged, parts.unionByName(orders)).select(
        "source", "target", "source_label", "target_label",
        F.col("props")["quantity"].alias("quantity"), F.col("props")["flag"].alias("flag"),
    )


def node_upsert(spark, d):
    ev = table(spark, d, "events")
    props = F.map_filter(
        F.create_map(
            F.lit("value"), F.col("value").cast("string"),
            F.lit("k"), F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")),
        ),
        lambda k, v: v.isNotNull(),
    )
    nodes = ev.select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"),
        F.when(F.col("user_id") % 17 == 0, "").otherwise(F.col("user_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("text"),
        props.alias("props"), F.lit("").alias("doc_id"), F.col("event_id").alias("seq"),
    )
    merged = gr.upsert_nodes(gr.unify_nodes(nodes))
    p = F.col("props")
    return merged.select("label", "id", p["value"].alias("value"), p["k"].alias("k"), p["text"].alias("text"))


def dangling_edges(spark, d):
    orders = table(spark, d, "orders")
    edges = orders.select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("source"), F.lit("DAT_BOI").alias("type"),
        F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
        ).alias("target"),
    )
    nodes = orders.where("o_orderstatus <> 'P'").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id")
    ).unionByName(table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id")
    ))
    return gr.dangling_edges(gr.distinct_edges(edges), nodes).select(
        "source", "target", F.col("source_missing").cast("int").alias("source_missing"),
        F.col("target_missing").cast("int").alias("target_missing"),
    )


def catalogue_violations(spark, d):
    nodes, edges = trade_graph(spark, d)
    allowed = spark.createDataFrame(
        [("(:ChuongTrinhDaoTao)", "[:THUOC_VE]", "(:Nganh)", "programme to major"),
         ("(:HocPhan)", "[:CO_THE_SONG_HANH]", "(:HocPhan)", "taken together")],
        "source string, relation string, target string, meaning string",
    )
    found = gr.catalogue_violations(gr.resolve_endpoints(edges, nodes), parse_catalogue(allowed))
    return found.groupBy("source_label", "type", "target_label").agg(F.count("*").alias("edges"))


def duplicate_ids(spark, d):
    li = table(spark, d, "lineitem")
    return gr.duplicate_ids(li.select(
        F.col("l_linenumber").cast("string").alias("label"), F.col("l_orderkey").cast("string").alias("id")
    ))


def _tree(spark, d):
    """Region, nation, customer and order as the levels of a document tree."""
    text = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    region, nation, customer, orders = (table(spark, d, n) for n in ("region", "nation", "customer", "orders"))
    nodes = [
        region.select(F.lit("VanBan").alias("label"), text("R", "r_regionkey").alias("id")),
        nation.select(F.lit("Chuong").alias("label"), text("N", "n_nationkey").alias("id")),
        customer.select(F.lit("Dieu").alias("label"), text("C", "c_custkey").alias("id")),
        orders.select(F.lit("Khoan").alias("label"), text("O", "o_orderkey").alias("id")),
    ]
    edge = lambda df, s, t, e: df.select(s.alias("source"), F.lit(t).alias("type"), e.alias("target"))
    edges = [
        edge(nation, text("R", "n_regionkey"), "co_chuong", text("N", "n_nationkey")),
        edge(customer, text("N", "c_nationkey"), "co_dieu", text("C", "c_custkey")),
        edge(orders, text("C", "o_custkey"), "co_khoan", text("O", "o_orderkey")),
        # references between orders, some of them into the removed tree
        edge(orders, text("O", "o_orderkey"), "tham_chieu", F.concat(F.lit("O"), F.floor(F.col("o_orderkey") / 2).cast("string"))),
    ]
    n, e = nodes[0], edges[0]
    for more in nodes[1:]:
        n = n.unionByName(more)
    for more in edges[1:]:
        e = e.unionByName(more)
    return n, e


def subtree_removal(spark, d):
    nodes, edges = _tree(spark, d)
    roots = spark.createDataFrame([("R1",)], "id string")
    kept_nodes, kept_edges = gr.remove_subtree(nodes, edges, roots)
    count = lambda df, c, kind: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("kept")).withColumn(
        "kind", F.lit(kind)
    )
    return count(kept_nodes, "label", "node").unionByName(count(kept_edges, "type", "edge"))


def skip_existing(spark, d):
    li = table(spark, d, "lineitem").select(
        F.lit("HocPhan").alias("label"), F.col("l_partkey").cast("string").alias("id")
    )
    known = table(spark, d, "part").where("p_size < 25").select(
        F.lit("HocPhan").alias("label"), F.col("p_partkey").cast("string").alias("id")
    )
    return gr.new_only(li, known)


def answers_as_json(spark, d):
    nodes, edges = trade_graph(spark, d)
    rows = ret.programme_credits(nodes, edges, "NATION_", 3).select("source", "target", "tong_tin_chi")
    return ret.rows_as_json(rows, "source")


def stored_in_batches(spark, d):
    """Documents as small regulations, stored in three batches; every fifth is then replaced by a shorter one.

    A document cites the next one; a citation is kept if its end is there when it is stored.
    """
    path = work_folder(spark, "batches")
    docs = stage(table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") % 4).alias("articles")), "documents")
    name = lambda key: F.concat(F.lit("doc"), key.cast("string"))
    key, none = F.col("doc_id"), F.lit(None).cast("string")
    seq = lambda n: F.array(n.cast("bigint")).alias("seq")
    text_of = lambda **p: F.create_map(*[x for k, v in p.items() for x in (F.lit(k), v.cast("string"))]).alias("props")

    def parts(rows):
        article = rows.where("articles > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("articles"))).alias("k"))
        part = F.concat(name(key), F.lit("_Dieu"), F.col("k").cast("string"))
        heads = rows.select(F.lit("VanBan").alias("label"), name(key).alias("id"), none.alias("text"),
                            text_of(ten=F.col("source"), so=F.col("articles")), name(key).alias("doc_id"), seq(F.lit(0)))
        items = article.select(F.lit("Dieu").alias("label"), part.alias("id"), none.alias("text"), text_of(so=F.col("k")),
                               name(key).alias("doc_id"), seq(F.col("k")))
        edge = lambda df, kind, target: df.select(
            name(key).alias("source"), F.lit(kind).alias("type"), target.alias("target"), F.create_map().cast("map<string,string>").alias("props"),
            name(key).alias("doc_id"), seq(F.lit(0)))
        return heads.unionByName(items), edge(article, "co_dieu", part).unionByName(edge(rows, "tham_chieu", name(key + 1)))

    def send(rows, replaced=None):
        nodes, edges = (stage(x, "submitted") for x in parts(rows))
        gone = None
        if replaced is not None:
            gone = gr.descendants(replaced, lambda ids: writers.read_edges(spark, f"{path}/edges", ids))
        writers.upsert_nodes(nodes, f"{path}/nodes", gone)
        writers.upsert_edges(edges, f"{path}/edges", replaced=gone, nodes_path=f"{path}/nodes")

    for batch in range(3):
        send(docs.where(key % 3 == batch))
    again = docs.where(key % 5 == 0).withColumns({"source": F.lit("new"), "articles": F.lit(0).cast("bigint")})
    send(again, again.select(name(key).alias("id")))
    nodes = writers.read_nodes(spark, f"{path}/nodes").select(
        "label", "id", none.alias("target"), F.col("props")["ten"].alias("ten"), F.col("props")["so"].alias("so"))
    return nodes.unionByName(writers.read_edges(spark, f"{path}/edges").select(
        F.col("type").alias("label"), F.col("source").alias("id"), "target", none.alias("ten"), none.alias("so")))


def deep_subtree(spark, d):
    """All ids below one region, six levels down; the levels' relations are in no order.

    The links are stored by their source, so that no round shuffles them; equal links may repeat.
    """
    nation, customer, orders, lineitem = (table(spark, d, n) for n in ("nation", "customer", "orders", "lineitem"))
    at = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    edge = lambda df, kind, source, target: df.select(source.alias("source"), F.lit(kind).alias("type"), target.alias("target"))
    line = F.concat(at("L", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string"))
    links = [
        edge(nation, "co_dieu", at("R", "n_regionkey"), at("N", "n_nationkey")),
        edge(customer, "co_diem", at("N", "c_nationkey"), at("C", "c_custkey")),
        edge(orders, "co_chuong", at("C", "o_custkey"), at("O", "o_orderkey")),
        edge(lineitem, "co_dieu", at("O", "l_orderkey"), line), edge(lineitem, "co_khoan", line, at("P", "l_partkey")),
        edge(lineitem, "tham_chieu", line, at("S", "l_suppkey")),
    ]
    edges = stage_by(reduce(DataFrame.unionByName, links), "links", "source")
    return gr.descendants(spark.createDataFrame([("R1",)], "id string"), edges)


QUERIES = {
    "graph_stored_in_batches": stored_in_batches,
    "graph_deep_subtree": deep_subtree,
    "graph_prerequisite_answers": prerequisite_answers,
    "graph_credit_answers": credit_answers,
    "graph_course_name_or_code": course_name_or_code,
    "graph_programme_credits": programme_credits,
    "graph_elective_requirements": elective_requirements,
    "graph_multi_label_expand": multi_label_expand,
    "graph_first_triples": first_triples,
    "graph_all_triples": all_triples,
    "graph_edge_upsert": edge_upsert,
    "graph_node_upsert": node_upsert,
    "graph_dangling_edges": dangling_edges,
    "graph_catalogue_violations": catalogue_violations,
    "graph_duplicate_ids": duplicate_ids,
    "graph_subtree_removal": subtree_removal,
    "graph_skip_existing": skip_existing,
    "graph_rows_as_json": answers_as_json,
}

_MATCHES = f"""
with {NODES_SQL}, {EDGES_SQL},
entities as (select distinct upper(p_name || ' ' || p_brand) as entity from part),
matches as (
  select entity, id, ten_hp as name, so_tin_chi from entities
  join nodes on label = 'HocPhan' and contains(lower(ten_hp), lower(entity))
)
"""
_TREE_GONE = """
with gone as (
  select 'R1' as id
  union select 'N' || n_nationkey from nation where n_regionkey = 1
  union select 'C' || c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1
  union select 'O' || o_orderkey from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey where n_regionkey = 1
),
tree_nodes as (
  select 'VanBan' as label, 'R' || r_regionkey as id from region
  union all select 'Chuong', 'N' || n_nationkey from nation
  union all select 'Dieu', 'C' || c_custkey from customer
  union all select 'Khoan', 'O' || o_orderkey from orders
),
tree_edges as (
  select 'R' || n_regionkey as source, 'co_chuong' as type, 'N' || n_nationkey as target from nation
  union all select 'N' || c_nationkey, 'co_dieu', 'C' || c_custkey from customer
  union all select 'C' || o_custkey, 'co_khoan', 'O' || o_orderkey from orders
  union all select 'O' || o_orderkey, 'tham_chieu', 'O' || (o_orderkey // 2) from orders
)
"""
SQL = {
    "graph_prerequisite_answers": _MATCHES + """,
having_pre as (select * from matches where id in (select source from edges where type = 'YEU_CAU_TIEN_QUYET')),
chosen as (select entity, arg_min(name, id) as name from having_pre group by entity)
select h.entity, 'Môn ' || h.name || ' cần học trước: ' || string_agg(n.ten_hp, ', ' order by n.ten_hp) as graph_text
from having_pre h join chosen c on h.entity = c.entity and h.name = c.name
join edges e on e.source = h.id and e.type = 'YEU_CAU_TIEN_QUYET' left join nodes n on n.id = e.target
group by h.entity, h.name
""",
    "graph_credit_answers": _MATCHES + """
select entity, 'Môn ' || arg_min(name, id) || ' có ' || arg_min(so_tin_chi, id) || ' tín chỉ' as graph_text
from matches group by entity
""",
    "graph_course_name_or_code": """
select 'ct' || p_partkey as entity, 'P' || p_partkey as id, p_name || ' ' || p_brand || ' ' || p_partkey as name
from part
""",
    "graph_programme_credits": """
select 'C' || c_custkey as source, 'N' || n_nationkey as target, cast(floor(c_acctbal) as bigint) || '' as tong_tin_chi
from customer join nation on c_nationkey = n_nationkey
where contains(n_name, 'NATION_1') and c_custkey % 50 = 7
""",
    "graph_elective_requirements": """
select 'S' || s_suppkey as source, 'N' || n_nationkey as target, n_name as noi_dung_yeu_cau, 'N' || n_nationkey as mo_ta
from supplier join nation on s_nationkey = n_nationkey where contains(lower(s_name), 'supplier#0000')
""",
    "graph_multi_label_expand": f"""
with {NODES_SQL}, {EDGES_SQL}
select e.source, e.target, s.label as source_label, t.label as target_label
from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target
where e.type = 'THUOC_VE' and s.label in ('ChuongTrinhDaoTao', 'KhoiKienThuc') and t.label in ('Nganh', 'Khoa')
""",
    "graph_first_triples": f"""
with {NODES_SQL}, {EDGES_SQL}
select e.source, e.type, e.target, s.label as source_label, coalesce(s.ten, '(no name)') as source_name,
       t.label as target_label, coalesce(t.ten, '(no name)') as target_name
from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target
order by e.source, e.type, e.target limit 5
""",
    "graph_all_triples": f"""
with {NODES_SQL}, {EDGES_SQL}
select e.source, e.type, e.target, s.label as source_label, coalesce(s.ten, '(no name)') as source_name,
       t.label as target_label, coalesce(t.ten, '(no name)') as target_name
from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target
""",
    "graph_edge_upsert": """
with ranked as (
  select *, row_number() over (partition by l_orderkey, l_partkey
      order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_quantity desc, l_returnflag desc) as rn,
    row_number() over (partition by l_orderkey, l_partkey, l_linestatus = 'F'
      order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_quantity desc, l_returnflag desc) as rf
  from lineitem
)
select 'O' || l_orderkey as source, 'P' || l_partkey as target, 'Order' as source_label, 'HocPhan' as target_label,
       max(case when rn = 1 then cast(l_quantity as bigint) || '' end) as quantity,
       max(case when rf = 1 and l_linestatus = 'F' then l_returnflag end) as flag
from ranked join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
where p_size > 10 group by l_orderkey, l_partkey
""",
    "graph_node_upsert": """
select case when event_type = 'error' then 'Entity' else event_type end as label, user_id || '' as id,
       arg_max(value, event_id) || '' as value,
       arg_max(json_extract_string(props, '$.k'), event_id) filter (event_id % 3 = 0) as k,
       arg_max('event ' || event_id, event_id) filter (event_id % 5 = 0) as text
from events where user_id % 17 <> 0 group by 1, 2
""",
    "graph_dangling_edges": """
with kept_orders as (select o_orderkey from orders where o_orderstatus <> 'P'),
kept_customers as (select c_custkey from customer where c_mktsegment <> 'BUILDING'),
marked as (
  select 'O' || o.o_orderkey as source, 'C' || o.o_custkey as target,
         case when exists (select 1 from kept_orders k where k.o_orderkey = o.o_orderkey) then 0 else 1 end as source_missing,
         case when exists (select 1 from kept_customers k where k.c_custkey = o.o_custkey) then 0 else 1 end as target_missing
  from orders o where o.o_orderkey % 50 <> 0
)
select distinct * from marked where source_missing = 1 or target_missing = 1
""",
    "graph_catalogue_violations": f"""
with {NODES_SQL}, {EDGES_SQL}
select s.label as source_label, e.type, t.label as target_label, count(*) as edges
from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target
where not (s.label = 'ChuongTrinhDaoTao' and e.type = 'THUOC_VE' and t.label = 'Nganh')
group by 1, 2, 3
""",
    "graph_duplicate_ids": """
select l_linenumber || '' as label, l_orderkey || '' as id, count(*) as copies
from lineitem group by 1, 2 having count(*) > 1
""",
    "graph_stored_in_batches": """
with d as (select doc_id, source, n_chars % 4 as articles from documents),
k as (select doc_id, unnest(range(1, articles + 1)) as k from d where doc_id % 5 <> 0),
cites as (select a.doc_id, b.doc_id as next from d a join d b on b.doc_id = a.doc_id + 1
          where a.doc_id % 5 = 0 or (a.doc_id % 3 = 2 and b.doc_id % 5 <> 0))
select 'VanBan' as label, 'doc' || doc_id as id, null as target, case when doc_id % 5 = 0 then 'new' else source end as ten,
       case when doc_id % 5 = 0 then '0' else articles || '' end as so from d
union all select 'Dieu', 'doc' || doc_id || '_Dieu' || k, null, null, k || '' from k
union all select 'co_dieu', 'doc' || doc_id, 'doc' || doc_id || '_Dieu' || k, null, null from k
union all select 'tham_chieu', 'doc' || doc_id, 'doc' || next, null, null from cites
""",
    "graph_deep_subtree": """
with o as (select o_orderkey, c_custkey, n_nationkey from nation join customer on c_nationkey = n_nationkey
           left join orders on o_custkey = c_custkey where n_regionkey = 1),
l as (select o_orderkey, l_linenumber, l_partkey from o join lineitem on l_orderkey = o_orderkey)
select 'R1' as id union select 'N' || n_nationkey from nation where n_regionkey = 1 union select 'C' || c_custkey from o
union select 'O' || o_orderkey from o where o_orderkey is not null union select 'L' || o_orderkey || '-' || l_linenumber from l
union select 'P' || l_partkey from l
""",
    "graph_subtree_removal": _TREE_GONE + """
select 'node' as kind, label as name, count(*) as kept from tree_nodes
where id not in (select id from gone) group by label
union all
select 'edge', type, count(*) from tree_edges
where source not in (select id from gone) and target not in (select id from gone) group by type
""",
    "graph_skip_existing": """
select distinct 'HocPhan' as label, l_partkey || '' as id from lineitem
where l_partkey not in (select p_partkey from part where p_size < 25)
""",
    "graph_rows_as_json": """
select 'C' || c_custkey as source, '[{"target":"N' || c_nationkey || '","tong_tin_chi":"' || cast(floor(c_acctbal) as bigint) || '"}]' as json
from customer where c_custkey % 50 = 3
""",
}
