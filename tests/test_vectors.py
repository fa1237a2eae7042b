import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import graph as gr
from lectern.operators import vectors as ve


def brute(queries, corpus, k, floor, skip_self):
    norm = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1)
    out = set()
    for q, qv in queries:
        scored = [(-round(float(norm(qv) @ norm(cv)), 9), c) for c, cv in corpus if not (skip_self and c == q)]
        scored = sorted(s for s in scored if floor is None or -s[0] > floor)
        out |= {(q, c, rank) for rank, (_, c) in enumerate(scored[:k], 1)}
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 6)).round(3)
    # a third of the corpus is one vector, so ties are many
    vectors[40:] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(3)


@pytest.mark.parametrize("chunks", [1, 7, None])
@pytest.mark.parametrize("k, floor, skip_self", [(3, None, False), (5, 0.3, True)])
def test_top_matches_equal_brute_force(data, chunks, k, floor, skip_self, monkeypatch):
    monkeypatch.setattr(ve, "CORPUS_SLICE", 9)
    rows, corpus = data
    queries = corpus.withColumnRenamed("id", "qid")
    got = ve.top_matches(queries, corpus, k, floor, skip_self, corpus_chunks=chunks)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == brute(rows, rows, k, floor, skip_self)


def test_string_ids_and_no_queries(spark, data):
    _, corpus = data
    named = corpus.withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string")))
    got = ve.top_matches(corpus.where("id = 0").withColumnRenamed("id", "qid"), named, 2).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == ["v0", "v40"]
    assert ve.top_matches(corpus.where("id < 0").withColumnRenamed("id", "qid"), corpus, 2).count() == 0


def test_nearest_texts(spark):
    found = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "qid int, id int, rank int")
    texts = spark.createDataFrame([(7, "bảy", "A"), (8, "tám", "B"), (9, "chín", "C")], "id int, text string, label string")
    assert ve.nearest_texts(found, texts).first().vector_text == "bảy\ntám"
    assert ve.nearest_texts(found, texts, 1, with_label=True).first().vector_text == "[A]: bảy"


def test_threshold_scale():
    assert ve.cosine_floor(0.8) == pytest.approx(0.6)


def test_embedding_skips_blanks_and_loads_once_per_task(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([("d", "a", " x "), ("d", "b", " \n"), ("d", "c", None), ("d", "e", "yyy")], "doc_id string, id string, text string")
    vectors = ve.embed(rows, load, 2, keys=("doc_id", "id"), batch_rows=2)
    joined = gr.attach_vectors(rows, vectors)
    assert {r.id: r.vector for r in joined.collect()} == {"a": [1.0, 1.0], "b": None, "c": None, "e": [3.0, 1.0]}


def test_null_vectors_take_no_part(spark, data):
    rows, corpus = data
    gaps = corpus.unionByName(spark.createDataFrame([(900, None), (901, None)], corpus.schema))
    got = ve.top_matches(gaps.withColumnRenamed("id", "qid"), gaps, 3)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == brute(rows, rows, 3, None, False)


def test_thousands_of_queries_take_the_same_way(spark, data):
    rows, corpus = data
    many = spark.range(5000).join(corpus.withColumnRenamed("id", "c"), F.col("id") % 60 == F.col("c")).select(F.col("id").alias("qid"), "vector")
    got = ve.top_matches(many, corpus, 2, corpus_chunks=3)
    best = {q: {(c, rank)for p, c, rank in brute([rows[q]], rows, 2, None, False)} for q in range(60)}
    found = {}
    for r in got.collect():
        found.setdefault(r.qid, set()).add((r.id, r["rank"]))
    assert len(found) == 5000 and all(found[q] == best[q % 60] for q in found)


def test_stored_texts_are_embedded_once(spark, tmp_path):
    from lectern.session import work_folder

    calls = str(tmp_path / "calls")

    def load():
        def run(texts):
            with open(calls, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return np.array([[len(t), 1.0] for t in texts])
        return run

    seen = lambda: sorted(open(calls).read().split("\n")[:-1])
    model, path = ve.TextModel("lengths/1", load, 2), work_folder(spark, "vectors")
    rows = lambda *ts: spark.createDataFrame([(str(i), t) for i, t in enumerate(ts)], "id string, text string").repartition(3)
    first = rows("a", "bb", " a ", "a", None, " ", "ccc")
    for _ in range(2):  # a repeated batch calls the model for nothing
        ve.embed_missing(first, path, model, "0")
        assert seen() == ["a", "bb", "ccc"]
    ve.embed_missing(rows("bb", "dddd", "a"), path, model, "1")
    assert seen() == ["a", "bb", "ccc", "dddd"]
    got = {r.id: (r.text, r.vector) for r in ve.vector_corpus(first, path, model).collect()}
    assert got == {"0": ("a", [1.0, 1.0]), "1": ("bb", [2.0, 1.0]), "2": (" a ", [1.0, 1.0]), "3": ("a", [1.0, 1.0]), "6": ("ccc", [3.0, 1.0])}
    # Another model starts anew and leaves the first one's vectors.
    ve.embed_missing(rows("a"), path, ve.TextModel("other", load, 2), "0")
    assert len(seen()) == 5 and ve.stored_vectors(spark, path, model).count() == 4


@pytest.mark.parametrize("bound", [300, 1 << 30])
def test_chunks_follow_the_bytes_of_the_corpus(data, bound, monkeypatch):
    monkeypatch.setattr(ve, "CHUNK_BYTES", bound)
    rows, corpus = data
    got = ve.top_matches(corpus.where("id < 9").withColumnRenamed("id", "qid"), corpus.where("id < 30"), 3)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == brute(rows[:9], rows[:30], 3, None, False)


def test_no_corpus(data):
    _, corpus = data
    assert ve.top_matches(corpus.withColumnRenamed("id", "qid"), corpus.limit(0), 3).count() == 0


def test_few_bytes_are_sent(data, monkeypatch):
    """Neither side goes to every task: a corpus row is sent once per group, a query once per chunk."""
    _, corpus = data
    queries = corpus.withColumnRenamed("id", "qid")
    chunks, groups = ve._grid(queries, corpus, 48, 3, None)
    assert chunks * groups >= 48 and 3 <= chunks <= 16 and 3 <= groups <= 16
    assert ve._grid(queries.limit(1), corpus, 48, 3, None)[1] <= 2
    rows, dims = corpus.count(), len(corpus.first()["vector"])
    monkeypatch.setattr(ve, "CHUNK_BYTES", rows * dims)
    assert ve._grid(queries, corpus, 4, 3, None)[0] == 16
