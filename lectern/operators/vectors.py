"""Exact nearest vectors by cosine, in tiles.

The corpus is cut into chunks (``CHUNK_BYTES`` each at most, so a chunk fits into a task) and
the queries into groups. A tile is one chunk and one group: the queries of the group stream
past the chunk in slices. A query is sent once per chunk and a corpus row once per group; from
the measured sizes the grid is taken that gives every task a tile and sends the fewest bytes.
Scores are matrix products inside tasks, and each tile sends on at most k rows per query,
so the final ranking shuffles little. One way serves one question and millions; nothing
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import spread, stored

# Queries and corpus rows of one product.
QUERY_SLICE = 256
CORPUS_SLICE = 2_048
# Bytes of a chunk's matrix in a task.
CHUNK_BYTES = 32 << 20
# About what a row takes in a shuffle beside its vector.
ROW_BYTES = 32
# Products of equal vectors may differ in the last bits; this many decimals tie.
TIE_DECIMALS = 9


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, for single pairs."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    rows = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if len(flat) % rows:
        raise ValueError("vectors of several dimensions")
    m = flat.reshape(rows, -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Which cells of each row are its k largest; of equal ones the first columns count."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > cut, scores == cut
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _best(q_ids, q_mat, c_ids, c_mat, k, floor, own) -> dict[str, list]:
    """At most k rows per query of this chunk, ties broken by the smaller id.

    Corpus ids ascend, and what is kept stays in their order, so ties need no look at ids.
    ``own`` has the places of the ids that a query of the same id leaves out.
    """
    if q_mat.shape[1] != c_mat.shape[1]:
        raise ValueError(f"vectors of {q_mat.shape[1]} and {c_mat.shape[1]} dimensions")
    n = len(q_ids)
    score, at = np.full((n, k), -np.inf), np.full((n, k), -1)
    mine = np.array([own.get(q, -1) for q in q_ids.tolist()]) if own else np.full(n, -1)
    for start in range(0, len(c_ids), CORPUS_SLICE):
        fresh = np.round(q_mat @ c_mat[start:start + CORPUS_SLICE].T, TIE_DECIMALS)
        fresh[fresh <= floor] = -np.inf
        inside = np.flatnonzero((mine >= start) & (mine < start + CORPUS_SLICE))
        fresh[inside, mine[inside] - start] = -np.inf
        both = np.concatenate([score, fresh], axis=1)
        places = np.concatenate([at, np.broadcast_to(np.arange(start, start + fresh.shape[1]), fresh.shape)], axis=1)
        kept = _top(both, k)
        score, at = both[kept].reshape(n, k), places[kept].reshape(n, k)
    row, column = np.nonzero(score > -np.inf)
    return {"qid": q_ids[row].tolist(), "id": c_ids[at[row, column]].tolist(), "score": score[row, column].tolist()}


def _ids(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=object)
    return column.to_numpy(zero_copy_only=False)


def _out_schema(queries: DataFrame, corpus: DataFrame) -> tuple[T.StructType, pa.Schema]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    q, c = queries.schema["qid"].dataType, corpus.schema["id"].dataType
    spark = T.StructType([
        T.StructField("qid", q), T.StructField("id", c), T.StructField("score", T.DoubleType())
    ])
    arrow = pa.schema([
        ("qid", kinds[q.simpleString()]), ("id", kinds[c.simpleString()]), ("score", pa.float64())
    ])
    return spark, arrow


def _grid(queries: DataFrame, corpus: DataFrame, tasks: int, k: int, corpus_chunks: int | None) -> tuple[int, int]:
    """Chunks of the corpus and groups of queries that give every task a tile and send the fewest bytes.

    The corpus is sent once per group; queries, and at most k found rows of each, once per chunk.
    A chunk has at most ``CHUNK_BYTES`` (as doubles, twice the mean to allow for uneven parts).
    """
    if corpus_chunks:
        return corpus_chunks, max(1, -(-tasks // corpus_chunks))
    rows, dims = corpus.agg(F.count("vector"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    asked = queries.agg(F.count("vector")).first()[0]
    size = rows * dims * 8
    least = max(1, -(-2 * size // CHUNK_BYTES)) if size > CHUNK_BYTES else 1
    width = dims * 4 + ROW_BYTES
    grids = [(max(least, -(-tasks // groups)), groups) for groups in range(1, tasks + 1)]
    return min(grids, key=lambda g: rows * width * g[1] + asked * (width + k * ROW_BYTES) * g[0])


def top_matches(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    min_cosine: float | None = None,
    skip_self: bool = False,
    corpus_chunks: int | None = None,
) -> DataFrame:
    """``queries(qid, vector)`` and ``corpus(id, vector)`` to ``(qid, id, score, rank)``.

    ``score`` is the raw cosine; only scores strictly above ``min_cosine`` count,
    cut before ranking. ``skip_self`` leaves out the pair of equal ids. Rows with a null
    vector take no part; all others must have one number of dimensions. The corpus is dealt
    into ``corpus_chunks`` parts; if None, both sides are measured when this is called and a
    part has at most ``CHUNK_BYTES``.
    """
    floor = -np.inf if min_cosine is None else float(min_cosine)
    schema, arrow = _out_schema(queries, corpus)
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, groups = _grid(queries, corpus, tasks, k, corpus_chunks)
    qid, cid = queries.schema["qid"].dataType, corpus.schema["id"].dataType
    kind = "array<float>" if all(
        df.schema["vector"].dataType.simpleString() == "array<float>" for df in (queries, corpus)) else "array<double>"
    vector = F.col("vector").cast(kind).alias("vector")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = corpus.where("vector is not null").select(
        part("id", chunks).alias("c"), every(groups).alias("g"), F.lit(0).alias("side"),
        F.lit(None).cast(qid).alias("qid"), "id", vector,
    )
    asked = queries.where("vector is not null").select(
        every(chunks).alias("c"), part("qid", groups).alias("g"), F.lit(1).alias("side"),
        "qid", F.lit(None).cast(cid).alias("id"), vector,
    )
    tiles = held.unionByName(asked).select((F.col("c") * groups + F.col("g")).alias("chunk"), "side", "qid", "id", "vector")
    dealt = tiles.repartitionById(chunks * groups, "chunk").sortWithinPartitions("chunk", "side", "id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, parts, own = None, [], [], {}
        for batch in batches:
            number, side = batch["chunk"].to_numpy(), batch["side"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (side[1:] != side[:-1])))
            for start, end in zip(cuts, np.append(cuts[1:], len(number))):
                rows = batch.slice(start, end - start)
                if number[start] != chunk:
                    chunk, ids, parts, own = number[start], [], [], {}
                if side[start] == 0:
                    ids.append(_ids(rows["id"]))
                    parts.append(_matrix(rows["vector"]))
                    continue
                if not parts:
                    continue
                if len(parts) > 1:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                if skip_self and not own:
                    own = {c: i for i, c in enumerate(ids[0].tolist())}
                for at in range(0, rows.num_rows, QUERY_SLICE):
                    some = rows.slice(at, QUERY_SLICE)
                    found = _best(_ids(some["qid"]), _matrix(some["vector"]), ids[0], parts[0], k, floor, own)
                    yield pa.RecordBatch.from_pydict(found, schema=arrow)

    ranking = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    found = dealt.mapInArrow(score, schema)
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def unit_score(cos: Column) -> Column:
    """Cosine from 0 to 1, the scale of the score thresholds."""
    return (cos + 1.0) / 2.0


def cosine_floor(threshold: float) -> float:
    """The raw cosine behind a threshold on the 0-to-1 scale."""
    return 2.0 * threshold - 1.0


def nearest_texts(
    matches: DataFrame, texts: DataFrame, limit: int = 2, with_label: bool = False
) -> DataFrame:
    """The best texts per query, joined by newlines, best first.

    ``texts(id, text[, label])``. At most ``limit`` rows per query are gathered.
    """
    line = F.concat(F.lit("["), F.col("label"), F.lit("]: "), F.col("text")) if with_label else F.col("text")
    return (
        matches.where(F.col("rank") <= limit).join(texts, "id")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("found"))
        .select("qid", F.array_join(F.transform("found", lambda f: f["line"]), "\n").alias("vector_text"))
    )


def embed(texts: DataFrame, load_model, dims: int, keys: tuple[str, ...] = ("id",), batch_rows: int | None = None) -> DataFrame:
    """Vectors for non-blank texts: ``(keys..., text)`` to ``(keys..., vector)``.

    ``load_model()`` runs once per task and returns a function from a list of
    texts to a matrix of ``dims`` columns. Blank texts get no row, and vectors
    carry their key, so they cannot shift against their rows.
    """
    filled = texts.select(*keys, tx.strip(F.col("text")).alias("text")).where("text <> ''")
    kinds = [T.StructField(k, texts.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, T.StructField("vector", T.ArrayType(T.FloatType()))])
    arrow_vector = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows or max(batch.num_rows, 1)):
                part = batch.slice(start, batch_rows or batch.num_rows)
                matrix = np.asarray(model(part["text"].to_pylist()), dtype=np.float32).reshape(part.num_rows, dims)
                offsets = pa.array(np.arange(0, (part.num_rows + 1) * dims, dims), pa.int32())
                vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()), type=arrow_vector)
                yield pa.RecordBatch.from_arrays([*[part[k] for k in keys], vectors], names=[*keys, "vector"])

    return filled.mapInArrow(run, schema)


# --- stored vectors -----------------------------------------------------------------


@dataclass(frozen=True)
class TextModel:
    """A model by name: ``load()`` runs once per task and gives a function from texts to a matrix of ``dims`` columns."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dims: int


VECTOR_TABLE = "text_hash string, vector array<float>, model string, batch string"


def text_hash(text: Column) -> Column:
    """The key of a text in the vector table; leading and trailing white space does not count."""
    return F.sha2(tx.strip(text).cast("binary"), 256)


def stored_vectors(spark: SparkSession, path: str, model: TextModel) -> DataFrame:
    """``(text_hash, vector)`` of all texts this model has embedded."""
    return stored(spark, path, VECTOR_TABLE).where(F.col("model") == model.name).select("text_hash", "vector")


def embed_missing(texts: DataFrame, path: str, model: TextModel, batch: str, batch_rows: int | None = None) -> None:
    """Embed the texts of ``texts(text)`` that the table at ``path`` does not hold, each once.

    Texts are dealt evenly over the tasks and go to the model in order of their length, so
    that a batch holds texts of like length. Blank and null texts have no vector. A repeated
    ``batch`` adds nothing.
    """
    spark = texts.sparkSession
    keyed = texts.where(tx.strip(F.col("text")) != "").select(text_hash(F.col("text")).alias("text_hash"), tx.strip(F.col("text")).alias("text"))
    fresh = keyed.groupBy("text_hash").agg(F.min("text").alias("text")).join(
        stored_vectors(spark, path, model).select("text_hash"), "text_hash", "left_anti")
    ordered = spread(fresh, "text_hash").sortWithinPartitions(F.length("text"))
    made = embed(ordered, model.load, model.dims, keys=("text_hash",), batch_rows=batch_rows)
    made.withColumns({"model": F.lit(model.name), "batch": F.lit(batch)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("model", "batch").parquet(path)


def vector_corpus(nodes: DataFrame, path: str, model: TextModel) -> DataFrame:
    """``(id, text, vector)`` of ``nodes(id, text)`` whose text is in the vector table."""
    known = stored_vectors(nodes.sparkSession, path, model)
    return nodes.select("id", "text", text_hash(F.col("text")).alias("text_hash")).join(known, "text_hash").select("id", "text", "vector")
