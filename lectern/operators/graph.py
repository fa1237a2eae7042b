"""Property-graph operators on ``nodes`` and ``edges`` DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

DEFAULT_LABEL = "Entity"
DEFAULT_RELATION = "RELATED_TO"


def entries_map(entries: Column | str) -> Column:
    return F.map_from_entries(entries)


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def unify_nodes(objects: DataFrame) -> DataFrame:
    """Fold text (and a vector, if any) into the properties; fill in the label.

    Takes ``(label, id, text, props, doc_id, seq[, embedding])``. Rows without an
    id are dropped.
    """
    extra = {"text": F.col("text")}
    if "embedding" in objects.columns:
        extra["embedding"] = F.to_json("embedding")
    folded = F.map_filter(
        F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()
    )
    own = F.map_filter(F.coalesce("props", _empty_map()), lambda k, v: ~k.isin(*extra))
    return objects.where("id <> ''").select(
        F.coalesce(F.nullif("label", F.lit("")), F.lit(DEFAULT_LABEL)).alias("label"),
        "id", F.map_concat(own, folded).alias("props"), "doc_id", "seq",
    )


def _merge(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Property-wise last-wins merge; keys that are absent later survive.

    Both steps combine before they shuffle, so many versions of one node or edge
    shrink to one value per property on each side.
    """
    values = rows.select(
        *keys, F.struct(*version).alias("_v"), F.explode_outer("props").alias("key", "value")
    )
    latest = values.groupBy(*keys, "key").agg(F.max_by("value", "_v").alias("value"))
    pair = F.when(F.col("key").isNotNull(), F.struct("key", "value"))
    return latest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(pair)).alias("props"))


def upsert_nodes(nodes: DataFrame, version: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """Current state of each (label, id) from all its versions."""
    return _merge(nodes.where("id <> ''"), ["label", "id"], list(version))


def upsert_edges(edges: DataFrame, version: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """Current state of each (source, type, target); parallel edges become one."""
    named = edges.where("source <> '' and target <> ''").withColumn(
        "type", F.coalesce("type", F.lit(DEFAULT_RELATION))
    )
    return _merge(named, ["source", "type", "target"], list(version))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("source <> '' and target <> ''").select("source", "type", "target").distinct()


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inner-join both ends by id alone, so an id under two labels fans out.

    Edges with an end that does not exist are gone; ``dangling_edges`` lists them.
    """
    ids = nodes.select("id", "label").distinct()
    start = ids.select(F.col("id").alias("source"), F.col("label").alias("source_label"))
    end = ids.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    return edges.join(start, "source").join(end, "target")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one missing end, and which end it is."""
    ids = nodes.select("id").distinct()
    start = ids.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
    end = ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    return (
        edges.join(start, "source", "left").join(end, "target", "left")
        .where("_s is null or _t is null")
        .select(*edges.columns,
                F.col("_s").isNull().alias("source_missing"),
                F.col("_t").isNull().alias("target_missing"))
    )


def catalogue_violations(triples: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Resolved edges whose (source label, type, target label) is not catalogued."""
    keys = ["source_label", "type", "target_label"]
    return triples.join(catalogue.select(*keys).distinct(), keys, "left_anti")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Quality check behind a uniqueness constraint: must come back empty."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("copies")).where("copies > 1")


def expand(starts: DataFrame, edges: DataFrame, relation: str, ends: DataFrame) -> DataFrame:
    """One typed hop: ``starts(source, ...)`` to ``ends(target, ...)``, inner."""
    hop = edges.where(F.col("type") == relation).select("source", "target")
    return starts.join(hop, "source").join(ends, "target")


def optional_expand(starts: DataFrame, edges: DataFrame, relation: str, parent: str, child: str) -> DataFrame:
    """One typed hop that keeps a parent without children (child is null)."""
    hop = edges.where(F.col("type") == relation).select(
        F.col("source").alias(parent), F.col("target").alias(child)
    )
    return starts.join(hop, parent, "left")


TREE_RELATIONS = ("co_chuong", "co_dieu", "co_khoan", "co_diem")


def subtree(roots: DataFrame, edges: DataFrame, relations: tuple[str, ...] = TREE_RELATIONS) -> DataFrame:
    """Ids of ``roots(id)`` and of everything below along the relations, in order."""
    levels = [f"_l{i}" for i in range(len(relations) + 1)]
    chain = roots.select(F.col("id").alias(levels[0])).distinct()
    for relation, parent, child in zip(relations, levels, levels[1:]):
        chain = optional_expand(chain, edges, relation, parent, child)
    return chain.select(F.explode(F.array(*levels)).alias("id")).where("id is not null").distinct()


def descendants(roots: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame],
                relations: tuple[str, ...] = TREE_RELATIONS) -> DataFrame:
    """Ids of ``roots(id)`` and of everything below along the relations, at any depth and in any order.

    Each round follows the ids found last and ends in a written table; ids found before are
    left out, so rings end. ``edges`` may be a function from the ids to follow to the edges
    that can start there, so that a stored table is read by folders. Where rounds are large,
    store the edges by their source (``session.stage_by``): no round shuffles them then.
    """
    found = last = stage(roots.select("id").where("id is not null").distinct(), "found")
    while last.limit(1).count():
        here = edges(last) if callable(edges) else edges
        below = here.where(F.col("type").isin(*relations)).select(F.col("source").alias("id"), "target").join(last, "id", "left_semi")
        last = stage(below.select(F.col("target").alias("id")).distinct().join(found, "id", "left_anti"), "found")
        found = found.unionByName(last)
    return found


def remove_subtree(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detach-delete: the subtree's nodes and every edge that touches one."""
    gone = subtree(roots, edges)
    kept_nodes = nodes.join(gone, "id", "left_anti")
    kept_edges = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(
        gone.withColumnRenamed("id", "target"), "target", "left_anti"
    )
    return kept_nodes, kept_edges


def new_only(incoming: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("label", "id")) -> DataFrame:
    """Rows whose key does not exist yet, one per key."""
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))


def attach_vectors(nodes: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("doc_id", "id")) -> DataFrame:
    """Give each node its vector by key; nodes without one keep a null."""
    return nodes.join(vectors, list(keys), "left")


def triples(nodes: DataFrame, edges: DataFrame, name_key: str = "ten", default: str = "N/A") -> DataFrame:
    """Every edge with the names of both ends; a default stands for a missing name."""
    name = F.coalesce(F.col("props")[name_key], F.lit(default))
    start = nodes.select(F.col("id").alias("source"), F.col("label").alias("source_label"), name.alias("source_name"))
    end = nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label"), name.alias("target_name"))
    return edges.select("source", "type", "target").join(start, "source").join(end, "target")
