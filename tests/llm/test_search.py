"""Token counts, whitening and ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import ranked, tokencount, whitening

DOCS = "doc_id long, text string, n_bytes string, length string, number long, slots string, salt long, score string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", "clash", -1, "clash", -1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- token counts -------------------------------------------------------------------


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def hard_texts():
    rng = random.Random(11)
    parts = ["tea", " ", "  ", "\n", "\t", "don't", "É", "naïve", "中文字", "▁", "▁▁a", "123", "4.5", "<s>", "</s>", "<unk>", "<0x0A>", "👩‍🚀", "​",
             "http://a.b/c?d=1", "}}", "(x)", "a" * 300, "\x00", "ﬁ", "é", ",", ";;", "Hello", "hello", "def f(x):\n    return x"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400)]
    return [None, "", " ", "\n", "▁", "a", " a", "a ", *made, "word " * 30_000, "x" * 50_000, made[0], made[0]]


@pytest.mark.parametrize("entries", [0, 4, 1 << 16])
def test_token_counts_equal_whole_encoding(spark, model_path, monkeypatch, entries):
    from sentencepiece import SentencePieceProcessor

    texts = hard_texts()
    plain = SentencePieceProcessor(model_file=model_path)
    got = {r.doc_id: r for r in tokencount.count_tokens(docs_of(spark, texts), model_path, entries=entries).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(plain.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), t


def test_small_summaries_and_caches_change_nothing(model_path, monkeypatch):
    import pyarrow as pa

    rules = tokencount.cut_rules(model_path)
    assert rules is not None
    model = tokencount.Model(model_path, rules)
    for text in hard_texts()[1:]:
        total = 0
        for _, _, data, starts, ends, rows, _ in model.cut(pa.array([text, None])):
            assert (rows == 0).all()
            total += int(model.lengths(tokencount._texts(data, starts, ends)).sum()) if len(starts) else 0
        assert total == len(model.processor.encode(text)), text


def test_table_finds_its_keys_only():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 62, 3000).astype(np.uint64))
    # Many keys of one slot.
    keys = np.unique(np.append(keys, (np.arange(1, 40) << 40).astype(np.uint64)))
    table = tokencount.Table(keys, np.arange(len(keys)))
    assert (table(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 62, 3000).astype(np.uint64), keys)
    assert (table(np.append(other, np.uint64(0))) == -1).all()
    assert (tokencount.Table(keys[:0], np.zeros(0))(keys) == -1).all()


def test_no_documents_to_count(spark, model_path):
    none = spark.createDataFrame([], DOCS)
    assert tokencount.count_tokens(none, model_path).count() == 0
    assert [tuple(r) for r in tokencount.count_tokens(docs_of(spark, [None], [None]), model_path).collect()] == [(None, 0, 0, False)]


# --- whitening ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, block string, n string"


def plain_whitening(vectors, k):
    """Whole vectors' numbers, n, exact deviations, eigenvalues and whitened values by numpy and Python integers."""
    rows = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors.items()
            if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, rows.values())))
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(dims)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in rows.items()}
    whitened = {i: (np.array(v, float) - np.array([s / n for s in sums])) @ basis[:, :k] for i, v in rows.items()}
    return n, deviation, values, whitened


@pytest.mark.parametrize("block_bytes", [480, 1 << 20])
def test_whitening_equals_numpy(spark, block_bytes):
    rng = np.random.default_rng(1)
    made = (rng.normal(size=(150, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + 1).astype(np.float32)
    vectors = {i: [float(c) for c in v] for i, v in enumerate(made)}
    vectors.update({200: None, 201: [1.0, None, 0.0, 0.0, 0.0, 0.0], 202: [math.nan] * 6, 203: [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 204: [-0.0] * 6})
    vectors.update({300 + i: vectors[7] for i in range(80)})
    rows = spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in vectors.items()], VECTORS).repartition(5)
    got = whitening.whiten(rows, block_bytes=block_bytes).collect()
    n, deviation, values, projected = plain_whitening(vectors, 4)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in deviation for c in range(1, 5))
    sign = {}
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        want = projected[r.vec_id][r.component - 1] / math.sqrt(values[r.component - 1])
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    rows = lambda vs: spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(vs)], VECTORS)
    assert whitening.whiten(rows([])).count() == 0
    assert whitening.whiten(rows([None, [math.nan]])).count() == 0
    same = whitening.whiten(rows([[0.5, 0.25]] * 3)).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(c, 1, 0, None, None, None) for c in (1, 2)}
    line = sorted(whitening.whiten(rows([[0.0, 0.0, 0.0], [1.0, 1.0, 0.0]])).collect())
    assert [(r.component, r.n, r.deviation) for r in line] == [(c, 2, 131072) for _ in range(2) for c in (1, 2, 3)]
    assert [abs(r.whitened) if r.whitened is not None else None for r in line] == [pytest.approx(1), None, None] * 2
    assert [r.explained for r in line][:3] == [pytest.approx(1), pytest.approx(0, abs=1e-12), pytest.approx(0, abs=1e-12)]
    with pytest.raises(ValueError):
        whitening.whiten(rows([[1.0], [1.0, 2.0]]))


def test_whitening_of_huge_entries(spark):
    big = 3.0e38
    rows = spark.createDataFrame([(1, [big, 0.0], None, None, None), (None, [-big, 1.0], None, None, None), (3, [2.0**30, 0.5], None, None, None)], VECTORS)
    got = whitening.whiten(rows).collect()
    assert len(got) == 6 and {r.deviation for r in got} == {None}


# --- ranked search ------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_ranking(texts, ids, items, k):
    docs = [(i, Counter(terms_of(t))) for i, t in zip(ids, texts)]
    held = [c for _, c in docs if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = {}
    for item, text in items:
        found = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms if c else 0
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item] = [(rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("segment, k", [(60, 3), (1 << 20, 10)])
def test_ranking_equals_all_scores(spark, segment, k):
    rng = random.Random(segment)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 80))) for _ in range(300)]
    texts += [None, "", "--", "É tea, TEA! x_y", "w1 " * 20_000, texts[3], texts[3], texts[3]]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(30, texts[3]), (31, None), (32, "nowhere"), (33, "tea é Tea"), (34, ""), (None, "w1 w1 w2")]
    ids = [*range(len(texts) - 1), None]
    rng.shuffle(ids)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = plain_ranking(texts, ids, items, k)
    for block_bytes in (1 << 20, 200):
        got = ranked.rank_documents(docs_of(spark, texts, ids), bench, k, block_bytes=block_bytes, segment_postings=segment)
        rows = {}
        for r in got.collect():
            rows.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
        assert {i: sorted(v) for i, v in rows.items()} == {i: v for i, v in want.items() if v}


def test_search_stops_before_the_end_of_lists():
    """A document that stands first in both lists ends the search early; ties at the bound do not."""
    n = 4000
    doc = np.arange(n)
    slots = np.concatenate([[0, 1] for _ in range(n)])
    value = np.repeat(np.append(1000, np.arange(n - 1, 0, -1) % 7 + 1), 2)
    segment = ranked.Segment(doc, np.zeros(n, bool), slots, np.full(n, 2), value, 2)
    top = ranked.Best(1, 1)
    assert segment.search(0, np.array([0, 1]), np.array([1, 1]), top) < 50
    assert (top.doc[0, 0], top.score[0, 0]) == (0, 2000)
    equal = ranked.Segment(doc[::-1], np.zeros(n, bool), slots, np.full(n, 2), np.full(2 * n, 5), 2)
    top = ranked.Best(1, 2)
    assert equal.search(0, np.array([0, 1]), np.array([1, 1]), top) == n
    assert top.doc[0].tolist() == [0, 1]


def test_nothing_to_rank(spark):
    bench = spark.createDataFrame([(1, "tea")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert ranked.rank_documents(none, bench).count() == 0
    assert ranked.rank_documents(docs_of(spark, ["tea", None]), bench.limit(0)).count() == 0
    assert ranked.rank_documents(docs_of(spark, [None, "--"]), bench).count() == 0
    got = ranked.rank_documents(docs_of(spark, ["tea"] * 3), spark.createDataFrame([(1, "tea"), (1, "tea x")], "item_id long, text string"))
    # A term of every document weighs a little, so all three are ranked, for both rows of the item.
    assert sorted((r["rank"], r.doc_id) for r in got.collect()) == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 2), (3, 2)]
