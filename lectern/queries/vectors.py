"""Vector search and embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import vectors as ve
from ..session import work_folder
from .derive import table

LETTERS = "etaoinsh"


def letter_model():
    """A stand-in for a language model: shares of eight letters in a text."""
    def model(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) / len(t) for c in LETTERS] for t in texts])

    return model


def _sides(spark, d):
    e = table(spark, d, "embeddings")
    return (
        e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
    )


def top_above_threshold(spark, d):
    queries, corpus = _sides(spark, d)
    found = ve.top_matches(queries, corpus, k=3, min_cosine=ve.cosine_floor(0.62), skip_self=True)
    return found.where("rank <= 2").select("qid", "id", F.round(ve.unit_score(F.col("score")), 6).alias("score"), "rank")


def best_match(spark, d):
    queries, corpus = _sides(spark, d)
    return ve.top_matches(queries, corpus, k=3).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def labelled_texts(spark, d):
    queries, corpus = _sides(spark, d)
    found = ve.top_matches(queries, corpus, k=3, min_cosine=ve.cosine_floor(0.6), skip_self=True)
    texts = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"),
    )
    return ve.nearest_texts(found, texts, limit=2, with_label=True)


def embedded_documents(spark, d):
    """Blank texts get no vector, and no vector moves to another row."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("label"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("  \n ")).otherwise(F.col("text")).alias("text"),
    )
    vectors = ve.embed(docs, letter_model, len(LETTERS), keys=("doc_id",), batch_rows=64)
    joined = gr.attach_vectors(docs.select("doc_id", "label"), vectors, ("doc_id",))
    return joined.select(
        "doc_id", "label", F.coalesce(F.size("vector"), F.lit(0)).alias("dims"),
        *[F.round(F.get("vector", F.lit(i)).cast("double"), 5).alias(f"v{i}") for i in range(len(LETTERS))],
    )


def same_label_similarity(spark, d):
    """Cosine of single pairs: each vector and the next one."""
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select(
        "vec_id", F.round(ve.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine")
    )


LETTER_MODEL = ve.TextModel("letters", letter_model, len(LETTERS))


def stored_by_text(spark, d):
    """Documents in two batches that share texts: each text is embedded once, every document has its vector."""
    path = work_folder(spark, "text-vectors")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    ve.embed_missing(docs.where("id % 2 = 0"), path, LETTER_MODEL, "0", batch_rows=64)
    ve.embed_missing(docs, path, LETTER_MODEL, "1", batch_rows=64)
    stored = ve.stored_vectors(spark, path, LETTER_MODEL).groupBy("text_hash").agg(F.count("*").alias("times"))
    found = ve.vector_corpus(docs, path, LETTER_MODEL).withColumn("text_hash", ve.text_hash(F.col("text"))).join(stored, "text_hash")
    return found.select("id", "times", *[F.round(F.get("vector", F.lit(i)).cast("double"), 5).alias(f"v{i}") for i in range(len(LETTERS))])


QUERIES = {
    "vector_stored_by_text": stored_by_text,
    "vector_top_above_threshold": top_above_threshold,
    "vector_best_match": best_match,
    "vector_labelled_texts": labelled_texts,
    "vector_embedded_documents": embedded_documents,
    "vector_pair_similarity": same_label_similarity,
}

_PAIRS = """
with pairs as (
  select q.vec_id as qid, c.vec_id as id, c.label,
         round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 9) as cos
  from embeddings q, embeddings c
)
"""
SQL = {
    "vector_top_above_threshold": _PAIRS + """
select qid, id, round((cos + 1) / 2, 6) as score, rank from (
  select *, row_number() over (partition by qid order by cos desc, id) as rank from pairs where qid <> id and cos > 2 * 0.62 - 1
) where rank <= 2
""",
    "vector_best_match": _PAIRS + """
select qid, id, round(cos, 6) as score, rank from (
  select *, row_number() over (partition by qid order by cos desc, id) as rank from pairs
) where rank <= 3
""",
    "vector_labelled_texts": _PAIRS + """
select qid, string_agg('[L' || label || ']: vector ' || id, chr(10) order by rank) as vector_text from (
  select *, row_number() over (partition by qid order by cos desc, id) as rank from pairs where qid <> id and cos > 2 * 0.6 - 1
) where rank <= 2 group by qid
""",
    "vector_embedded_documents": """
with t as (select doc_id, source as label, case when doc_id % 10 <> 0 then
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) end as x from documents)
select doc_id, label, case when x is null or x = '' then 0 else 8 end as dims,
  round(cast(cast((length(x) - length(replace(x, 'e', ''))) / length(x) as float) as double), 5) as v0,
  round(cast(cast((length(x) - length(replace(x, 't', ''))) / length(x) as float) as double), 5) as v1,
  round(cast(cast((length(x) - length(replace(x, 'a', ''))) / length(x) as float) as double), 5) as v2,
  round(cast(cast((length(x) - length(replace(x, 'o', ''))) / length(x) as float) as double), 5) as v3,
  round(cast(cast((length(x) - length(replace(x, 'i', ''))) / length(x) as float) as double), 5) as v4,
  round(cast(cast((length(x) - length(replace(x, 'n', ''))) / length(x) as float) as double), 5) as v5,
  round(cast(cast((length(x) - length(replace(x, 's', ''))) / length(x) as float) as double), 5) as v6,
  round(cast(cast((length(x) - length(replace(x, 'h', ''))) / length(x) as float) as double), 5) as v7
from t
""",
    "vector_stored_by_text": """
with t as (select doc_id as id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as x from documents where doc_id % 10 <> 0)
select id, 1 as times,
  round(cast(cast((length(x) - length(replace(x, 'e', ''))) / length(x) as float) as double), 5) as v0,
  round(cast(cast((length(x) - length(replace(x, 't', ''))) / length(x) as float) as double), 5) as v1,
  round(cast(cast((length(x) - length(replace(x, 'a', ''))) / length(x) as float) as double), 5) as v2,
  round(cast(cast((length(x) - length(replace(x, 'o', ''))) / length(x) as float) as double), 5) as v3,
  round(cast(cast((length(x) - length(replace(x, 'i', ''))) / length(x) as float) as double), 5) as v4,
  round(cast(cast((length(x) - length(replace(x, 'n', ''))) / length(x) as float) as double), 5) as v5,
  round(cast(cast((length(x) - length(replace(x, 's', ''))) / length(x) as float) as double), 5) as v6,
  round(cast(cast((length(x) - length(replace(x, 'h', ''))) / length(x) as float) as double), 5) as v7
from t where x <> ''
""",
    "vector_pair_similarity": """
select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""",
}
