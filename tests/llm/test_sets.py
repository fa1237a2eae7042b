"""Near duplicates, repeated strings, tokens, mixing, shards and pages against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import graph, kit, maintext, mixing, neardup, sharding, suffixdup, tokens

DOCS = "doc_id long, text string, source string, rid long, key string, size long, row string, k1 long"


def docs_of(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, sources[i] if sources else None, -1, "clash", -1, "clash", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sets_of(texts):
    found = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        found.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return found


def plain_components(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def copies():
    """A chain of drifting copies, a large group around one text, small edits, edge cases."""
    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = "new%d" % rng.randrange(10**6)
        texts.append(" ".join(t))
    drift = list(base)
    for _ in range(25):
        drift[rng.randrange(len(drift))] = "d%d" % rng.randrange(10**6)
        texts.append(" ".join(drift))
    for _ in range(30):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))))
    texts += [" ".join(base).upper(), None, "", " \n", "one two", "One\ttwo", "one two three", texts[3], "x " * 20_000, "x " * 10_000]
    return texts


def test_components_equal_all_pairs(spark, copies):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, copies)).collect()}
    sets = sets_of(copies)
    want = plain_components(sets)
    assert len(got) == len(copies)
    for i, root in enumerate(want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root, root == i)
    kept = neardup.deduplicate(docs_of(spark, copies))
    assert kept.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in enumerate(want) if root == i)


def plain_roots(sets, percent):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def test_threshold_is_a_parameter(spark, copies):
    words = ["p%d" % i for i in range(104)]
    near = [*words[:50], "other", *words[51:]]
    texts = [*copies, " ".join(words[:60]), " ".join(words[:50] + ["x", "y"] + words[52:60]), " ".join(words), " ".join(near)]
    sets = sets_of(texts)
    assert neardup.needed(85) == 23 and neardup.needed(80) == 19 and neardup.needed(100) == 47
    seen = []
    for percent in (80, 90):
        want = plain_roots(sets, percent)
        seen.append(sum(root == i for i, root in enumerate(want)))
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), percent=percent).collect()}
        assert [got[i] for i in range(len(texts))] == want
        kept = neardup.deduplicate(docs_of(spark, texts), percent=percent)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, root in enumerate(want) if root == i]
    assert seen[0] < len(set(plain_roots(sets, 85))) < seen[1]
    for percent in (0, 101):
        with pytest.raises(ValueError):
            neardup.needed(percent)


def test_repeated_and_null_ids_keep_one_row(spark):
    texts = ["a b c d e f", "A b c d e f", "a b c d e f", None, "a b c d e f"]
    docs = docs_of(spark, texts, ids=[None, 4, 4, None, 9])
    rows = neardup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles} == {(None, 4, False), (4, 4, True), (9, 4, False)}
    assert sum(r.first_row for r in rows) == 2
    assert sorted(str(r.doc_id) for r in neardup.deduplicate(docs).collect()) == ["4", "None"]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == root(x) for a, b in links if a != b for x in (a, b))


def plain_removal(raws, length=400):
    times = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("shard_bytes", [suffixdup.SHARD_BYTES, 3000])
def test_removal_equals_plain_count(spark, shard_bytes):
    rng = random.Random(6)

    def prose(n):
        return "".join(rng.choices("abcdé \n", k=n))

    passage, other = prose(700), prose(390)
    texts = [prose(300) + passage + prose(rng.randrange(400)) for _ in range(12)]
    texts += [passage[i * 20 : i * 20 + 450] + prose(100) for i in range(8)]
    texts += [prose(200) + other + prose(200), other, other + "x", prose(3000) + passage[:500], "ab" * 900, None, "", "short"]
    texts += [texts[0], texts[0], passage * 3]
    got = {r.doc_id: r for r in suffixdup.remove_repeats(docs_of(spark, texts), shard_bytes).collect()}
    for i, want in enumerate(plain_removal([(t or "").encode() for t in texts])):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
    assert suffixdup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_removal_returns_what_is_left(spark):
    rng = random.Random(8)
    passages = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 12))) for _ in range(n)) for n in (52, 90, 140)]
    texts = ["".join(rng.choices("abcdé \n", k=rng.randrange(300, 900))) for _ in range(30)]
    for i in range(18):
        texts[i] = texts[i][:150] + passages[i % 3] + texts[i][150:]
    texts += [None, "", "short", texts[0], texts[25], "éè" * 500 + "é", "x" + "è" * 900]
    raws = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffixdup.remove_repeats(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, (raw, want) in enumerate(zip(raws, plain_removal(raws))):
        spans = [(s.start, s.end) for s in got[i].spans]
        ends = [0, *(x for s in spans for x in s), len(raw)]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
        assert (bytes(got[i].kept) == left) if spans else got[i].kept is None, i
        assert want == (len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()), i
    for passage in (p.encode() for p in passages if len(p.encode()) >= 400):
        assert sum(passage in raw for raw in raws) > 5 and not any(passage in (raws[i] if r.kept is None else bytes(r.kept)) for i, r in got.items())


def test_shard_search_equals_count():
    rng = np.random.default_rng(3)
    length = 40
    for _ in range(80):
        base = rng.integers(97, 100, 300).astype(np.uint8)
        texts = []
        for _ in range(rng.integers(1, 8)):
            b = base.copy()
            b[rng.integers(0, 300, rng.integers(0, 4))] = 65
            i, r = int(rng.integers(0, 200)), int(rng.integers(1, 60))
            texts.append(b[i : i + r + length - 1].tobytes())
        runs = np.array([len(x) - length + 1 for x in texts])
        order, kind, twice, _, begins = suffixdup.repeated_starts(texts, runs, length)
        at = {int(g) + j: x[j : j + length] for x, r, g in zip(texts, runs, begins) for j in range(r)}
        times = Counter(at.values())
        assert {int(p) for p in order[twice[kind]]} == {p for p, x in at.items() if times[x] > 1}


def test_blocks_round_trip_and_ranges():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        for high in (1, 2, 300, 49_408, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[::37] = high
            image = tokens.pack(ids)
            assert (tokens.unpack(image) == ids).all()
            for a, b in ((0, 5), (100, 200), (3, n), (n, n)):
                assert (tokens.unpack(image, a, b) == ids[a:b]).all()


def test_tokens_equal_whole_encoding(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(3)
    pieces = ["It's", "don''t", "'there's*", "X'*y", "**'ll", "a-b_c", "<|endoftext|>", "A<|endoftext|>b'S", "<|ENDOFTEXT|>", "<|x|>",
              "ΑΣ", "é", "é", "İ", "　", "x1", "12.5", "\n", "\t ", "ﬁ", "tea,", "#a#", "ß", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [None, "", " ", "tea " * 60_000]
    ids = [*range(len(texts) - 2), None, 5]
    docs = docs_of(spark, texts, ids)
    want = sorted((i is not None, i or 0, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in zip(ids, texts))
    for by_word in (True, False):
        folder = f"{tmp_path}/{by_word}"
        tokens.write_tokens(docs, folder, path, by_word, parts=4)
        got = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert keys == sorted(keys)
        found = Counter((*k, r.n_tokens, r.ids_crc32) for k, r in zip(keys, got))
        assert found == Counter((a, b, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, b, x in want)
    tokens.write_tokens(spark.createDataFrame([], DOCS), f"{tmp_path}/none", path, True)
    assert tokens.read_tokens(spark, f"{tmp_path}/none").count() == 0


def encode_all(encoder, texts):
    ids, lengths = encoder(*kit.column_bytes(pa.array(texts)))
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_tokens_of_letters_with_combining_characters():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    marks = [*map(chr, range(0x300, 0x370)), "\u0323\u0331", "\u1dc4\u0331", "\u20d7", "\u0338="]
    texts = [f"{letter}{mark}{letter}, {letter}{letter}{mark}" for letter in map(chr, range(65, 91)) for mark in marks]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode_all(tokens.Encoder(path, True), texts) == want


def test_pieces_are_encoded_once_a_worker(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(400):x}tea" for _ in range(50)) for _ in range(40)]
    want = encode_all(tokens.worker_encoder(path, True), texts)
    later = tokens.worker_encoder(path, True)
    with monkeypatch.context() as patch:
        patch.setattr(later, "_encode", lambda fresh: pytest.fail(f"{len(fresh)} pieces were encoded again"))
        assert encode_all(later, texts) == want
    for limit in ("REMEMBERED", "REMEMBERED_CHARS"):
        with monkeypatch.context() as patch:
            patch.setattr(tokens, limit, 100)
            small = tokens.Encoder(path, True)
            assert [x for t in texts for x in encode_all(small, [t])] == want
            assert len(small.slots) < 200


def test_targets_stop_at_caps():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 20.0, "b": 295 / 3, None: 590 / 3}
    assert mixing.targets({"a": 0, "b": 4}) == {"a": 0.0, "b": 6.0}
    assert mixing.targets({}) == {}


def flow_cost(flow, tokens_):
    total = 0
    for out, size in zip(flow, tokens_):
        words, copy = sum(out.values()), 1
        while words > 0:
            total += copy * min(words, size)
            words, copy = words - size, copy + 1
    return total


def every_flow(tokens_, members, quotas):
    """Least cost of every reachable filling of the quotas, pattern by pattern."""
    reached = {(0,) * len(quotas): 0}
    for size, own in zip(tokens_, members):
        after = {}
        for parts in itertools.product(*[range(2 * size + 1 if s in own else 1) for s in range(len(quotas))]):
            if sum(parts) > 2 * size:
                continue
            cost = flow_cost([dict(enumerate(parts))], [size])
            for filled, before in reached.items():
                total = tuple(map(sum, zip(filled, parts)))
                if all(t <= q for t, q in zip(total, quotas)):
                    after[total] = min(after.get(total, before + cost), before + cost)
        reached = after
    return reached


def test_flow_fills_quotas_at_least_cost():
    rng = random.Random(7)
    for _ in range(60):
        tokens_ = [rng.randrange(1, 5) for _ in range(3)]
        members = [sorted(rng.sample(range(3), rng.randrange(1, 4))) for _ in range(3)]
        quotas = [rng.randrange(0, 7) for _ in range(3)]
        flow = mixing.route(tokens_, members, quotas)
        got = tuple(sum(f.get(s, 0) for f in flow) for s in range(3))
        reached = every_flow(tokens_, members, quotas)
        most = max(map(sum, reached))
        assert sum(got) == most and all(g <= q for g, q in zip(got, quotas))
        assert flow_cost(flow, tokens_) == min(c for k, c in reached.items() if sum(k) == most)


def test_mix_takes_targets_and_repeats(spark):
    rng = random.Random(11)
    texts = ["w " * rng.randrange(1, 60) for _ in range(200)] + [None, "", "w " * 5000, "w w", "w w"]
    sources = [rng.choice(["b", "a", "ü", None]) for _ in texts]
    ids = [*range(len(texts) - 2), None, None]
    docs = docs_of(spark, texts, ids, sources)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(texts) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    taken, want = Counter(), mixing.targets(dict(sizes))
    for r in rows:
        taken[r.source] += r.taken
        assert (r.source_size, r.target) == (sizes[r.source], want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None).values()) <= 2
    assert mixing.mix_report(spark.createDataFrame([], DOCS)).count() == 0


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)], "doc_id long, text string, both array<string>")
    rows, sizes, want = mixing.mix(docs, F.col("both"), mixing.words_in(F.col("text")), quota_of=lambda s: {"a": 600.0, "b": 400.0}, keep=["doc_id"])
    taken = Counter()
    for r in rows.collect():
        taken[tuple(r.sources)] += r.taken
    assert sizes == {"a": 1000, "b": 500} and taken == {("a",): 500, ("a", "b"): 500}


def test_shards_fit_and_split_only_oversized(spark):
    rng = random.Random(12)
    texts = ["é" * rng.randrange(0, 200) for _ in range(300)] + ["x" * 5000, None, ""] + ["same"] * 400
    ids = [*range(303)] + [77] * 200 + [None] * 200
    limit = 1500
    rows = sharding.shard_report(docs_of(spark, texts, ids), limit).collect()
    assert len(rows) == len(texts)
    size, number = Counter(), Counter()
    for r in rows:
        size[r.shard] += r.bytes
        number[r.shard] += 1
        assert r.depth == len(r.shard)
    for r in rows:
        assert r.shard_bytes == size[r.shard]
        assert r.oversized == (size[r.shard] > limit) and (not r.oversized or number[r.shard] == 1)
    names = sorted(size)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:
        around = sum(v for k, v in size.items() if k.startswith(s[:-1]))
        assert not s or around > limit
    assert sharding.shard_report(spark.createDataFrame([], DOCS)).count() == 0


def test_write_shards(spark, tmp_path):
    texts = [f"text {i} " * 20 for i in range(60)]
    sharding.write_shards(docs_of(spark, texts), f"{tmp_path}/out", 2000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in back.collect()) == list(range(60))


ARTICLE = "<p>Long text, with commas, and sense. More of it; and so on, for a while.</p>"
PAGES = [
    (f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
     f"<article><h1>Head &amp; tail</h1>{ARTICLE}<p>Two<br>lines \n here<p>open <b>bold</b><div class='share'>Share</div>"
     "<section class=comments><p>Nice, very nice, I say.</p></section></article><footer>&copy; x</footer></body></html>",
     "Head & tail\n\nLong text, with commas, and sense. More of it; and so on, for a while.\n\nTwo lines here\n\nopen bold"),
    (f"<body><div id=side class=sidebar><p>Other, links.</p></div><div><h2>H</h2>{ARTICLE}{ARTICLE}</div><form>Mail<input></form></body>",
     "H\n\n" + "\n\n".join(["Long text, with commas, and sense. More of it; and so on, for a while."] * 2)),
    (None, ""), ("", ""), ("just text &lt;b&gt;", "just text <b>"), ("<nav>only menu</nav>", ""), ("<article><p>cut of", "cut of"),
    ("<article><p title='a>b'>q</p><!-- no --> a < b</article>", "q\n\na < b"),
    ("<article>" + "<p>word</p>" * 20_000 + "</article>", "\n\n".join(["word"] * 20_000)),
]


def test_main_text_of_pages(spark):
    rows = [(i, "u", page, "clash") for i, (page, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in maintext.extract(pages).collect()}
    assert len(got) == len(PAGES) + 1
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LINE = "Long text, with commas, and sense. More of it; and so on, for quite a while, until the line ends."
PARA = f"<p>{LINE}</p>"
CARDS = "".join(f"<article><h3>Card {i}</h3><p>Buy it now.</p></article>" for i in range(8))


@pytest.mark.parametrize("page, want", [
    (f"<body><div class=top>{CARDS}</div><div class=story><h1>T</h1>{PARA * 6}</div></body>", ["T", *[LINE] * 6]),
    (f"<body><main><h1>T</h1><div>{PARA * 6}</div><div>{CARDS}</div></main></body>", ["T", *[LINE] * 6]),
    (f"<body><div>Site</div><div><h1>T</h1><div>{PARA * 5}</div></div><div>Print</div></body>", ["T", *[LINE] * 5]),
    (f"<body><div>Site</div><div><h1>T</h1><div>{PARA * 6}</div><h2>U</h2><div>{PARA * 2}</div></div><div>Print</div></body>",
     ["T", *[LINE] * 6, "U", LINE, LINE]),
    (f"<body><div>Site</div><div><div>{PARA * 6}</div><div><section>{PARA * 2}</section></div></div></body>", [LINE] * 8),
])
def test_main_text_is_chosen_by_scores(page, want):
    assert maintext.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("page, want", [
    (f"<body class='single no-sidebar'><div><h1>T</h1>{PARA * 3}</div></body>", ["T", *[LINE] * 3]),
    (f"<html class=search><body class='search sidebar'><div><h1>T</h1>{PARA * 3}</div></body>", ["T", *[LINE] * 3]),
    (f"<body><div class='has-comments'><h1>T</h1>{PARA}<div class=comments><p>Nice, very.</p></div></div></body>", ["T", LINE]),
    (f"<body><div>Site</div><div class='widget-content'><h1>T</h1>{PARA * 3}</div></body>", ["T", *[LINE] * 3]),
    (f"<body><div class=social-wrap><div class='widget-content'><div>{PARA * 3}</div></div></div></body>", [LINE] * 3),
    (f"<body><form id=aspnetForm><nav>a</nav><div><h1>T</h1>{PARA * 3}<div class=search><input>Find</div></div></form></body>", ["T", *[LINE] * 3]),
    (f"<html><head><title>x</title><meta charset=utf-8><body><div><h1>T</h1>{PARA}</div></body>", ["T", LINE]),
    (f"<html><head><title>x</title><div><h1>T</h1>{PARA}</div>", ["T", LINE]),
    # What does announce something other stays out.
    (f"<body><div><h1>T</h1>{PARA * 2}</div><div class=comments>{PARA * 20}</div></body>", ["T", LINE, LINE]),
    (f"<body><div class=ad>{PARA}</div><article><h1>T</h1><p>Short.</p></article></body>", ["T", "Short."]),
    (f"<body><div><h1>T</h1>{PARA * 3}</div><form><p>Please fill in, all fields.</p><label>Name</label></form></body>", ["T", *[LINE] * 3]),
    ("<div class=menu>only menu</div>", [""]),
])
def test_names_of_wrappers_do_not_drop_the_page(page, want):
    assert maintext.main_text(page).split("\n\n") == want


def test_pipeline_stages_take_effect(spark, copies, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    texts = copies + ["Benchmark words that nobody else would ever write in one row of text here " + str(i) for i in range(3)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t"]), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, texts[-1][:70])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        at = step(spark, at, folder)
        seen.append((at.columns, [r.doc_id for r in at.collect()]))
    assert all(c == docs.columns for c, _ in seen[:-1])
    known = {i for i, t in enumerate(texts) if t and re.search("[A-Za-z]", t)}
    assert set(seen[0][1]) == known
    roots = plain_components(sets_of([t if i in known else None for i, t in enumerate(texts)]))
    assert sorted(seen[1][1]) == sorted(i for i in known if roots[i] == i)
    assert set(seen[1][1]) - set(seen[2][1]) == {i for i in seen[1][1] if texts[i].startswith("Benchmark")}
    assert sorted(seen[3][1]) == sorted(seen[4][1])
    assert corpus_pipeline.run(spark, folder).count() == len(seen[4][1])


def test_deduplication_keeps_every_column_name(spark, copies):
    rows = [(i, t, -i, "x", "y", "z") for i, t in enumerate(copies[:12] + [copies[0], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k1 long, k1 string, kkkkkk1 string, root string")
    got = neardup.deduplicate(docs)
    assert got.columns == docs.columns
    assert all(r["__k1"] == -r.doc_id and (r.k1, r.kkkkkk1, r.root) == ("x", "y", "z") for r in got.collect())


def test_members_far_from_the_centre_join_their_group_before_probes(spark):
    # A group around one text that is not in the table: members are close to some others, not to all.
    rng = random.Random(21)
    base = ["g%d" % i for i in range(300)]
    texts = []
    for _ in range(150):
        t = list(base)
        at = rng.randrange(0, 270)
        t[at : at + rng.randrange(6, 22)] = ["e%d" % rng.randrange(10**6) for _ in range(12)]
        texts.append(" ".join(t))
    want = plain_components(sets_of(texts))
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # Rounds only pair members outside a list's largest component with one member of it for each list.
    posts = spark.createDataFrame([(i, 0 if i < 60 else i, k) for i in range(100) for k in (7, 8)] + [(200 + i, 200 + i, 9) for i in range(3)],
                                  "rid long, root long, key long")
    for turn in (1, 2):
        pairs = [(r.a, r.b) for r in neardup._further_stars(posts, turn).collect()]
        assert len(set(pairs)) == len(pairs) and {a for a, _ in pairs} == set(range(60, 100))
        assert all(b < 60 for _, b in pairs) and len({b for _, b in pairs}) <= 2
