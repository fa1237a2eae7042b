"""Quality, decontamination, language and licences against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import decontaminate, kit, language, licences, quality

DOCS = "doc_id long, text string, lang string, source string, letters string, size long, rid long"
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else None, None, "clash", -1, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["tea", "Über", "ça", "x1", "A", "b#", "día,", "longer-word", "e"]
    made = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(40)]
    made += ["\n".join(rng.choices(["a b c", "", " ", "one two", "Ünder"], k=12)) for _ in range(20)]
    made += [None, "", " \n\t", "a", "a b\na b\n", "w " * 9000, made[3], made[3]]
    return made


def plain_quality(text):
    text = text or ""
    words, seen, lines = SPACED.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            lines += line in seen
            seen.add(line)

    def covered(n, later):
        grams, out, before = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)], set(), set()
        times = Counter(grams)
        for i, g in enumerate(grams):
            if (g in before) if later else times[g] > 1:
                out.update(range(i, i + n))
            before.add(g)
        return out

    chars = sum(map(len, words))
    repeats = len(covered(8, False))
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    dup_line = 0
    seen = set()
    for line in text.split("\n"):
        if line in seen:
            dup_line += sum(map(len, SPACED.findall(line)))
        seen.add(line)
    kept = not failed and 100 * dup_line <= 20 * chars and all(
        100 * sum(len(words[i]) for i in covered(n, True)) <= limit * chars for n, limit in quality.NGRAM_LIMITS.items())
    return (len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), lines, repeats, failed, kept)


def test_quality_equals_plain_count(spark, texts):
    got = {r.doc_id: r for r in quality.quality_report(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == plain_quality(text), text


def test_contamination_equals_plain_search(spark, texts):
    rng = random.Random(9)
    items = [" ".join(rng.choices(["tea", "ça", "a", "x1", "e", "q"], k=k)) for k in (3, 10, 11, 25, 1)] + [None, "", "--", "x1 a"]
    hidden = [f"Start {lower(items[2]).upper()} end", f"no {items[3][:-2]}z", "x1. A!", items[3] + " " + items[3]]
    texts = [*texts, *hidden]
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), bench).collect()}
    small = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), bench, block_bytes=120).collect()}
    windows = {}
    for i, t in enumerate(items):
        w = ALNUM.findall(lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    for i, t in enumerate(texts):
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        for r in (got[i], small[i]):
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit))
    kept = decontaminate.keep_clean(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if not got[i].contaminated)


def test_items_without_id_and_large_items(spark):
    rng = random.Random(21)
    large = " ".join("w%d" % rng.randrange(10**6) for _ in range(200))
    words = large.split()
    bench = spark.createDataFrame([(None, "secret words of nobody"), (7, large)], "item_id long, text string")
    texts = ["has secret words of nobody in it", "clean", *[" ".join(words[i : i + 10]) for i in range(191)], " ".join(words[:9])]
    kept = decontaminate.keep_clean(docs_of(spark, texts), bench, block_bytes=300)
    assert sorted(r.text for r in kept.collect()) == sorted(["clean", texts[-1]])
    rows = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts), bench, block_bytes=300).collect()}
    assert sum(r.n_hit == 10 and r.item_ids == ["7"] for r in rows.values()) == 191
    # By the contract a word in any occurrence of a window is hit, whether the item has an id or not.
    assert (rows[0].n_hit, rows[0].item_ids, rows[0].contaminated) == (4, [], True) and not rows[len(texts) - 1].contaminated


def test_no_items_and_no_documents(spark, texts):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(docs_of(spark, texts), bench).where("contaminated or n_hit > 0").count()
    full = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert decontaminate.contamination(none, full).count() == 0
    assert decontaminate.keep_clean(none, full).count() == 0
    assert quality.quality_report(none).count() == 0
    assert licences.scan(none).count() == 0
    assert language.language_report(none).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contamination(none, full, block_bytes=2)


def made_language(rng, alphabet, n):
    return " ".join("".join(rng.choices(alphabet, k=rng.randrange(2, 8))) for _ in range(n))


def test_language_of_held_out_and_mixed_texts(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "üöäxyzw"}
    texts, langs = [], []
    for i in range(240):
        lang = rng.choice(sorted(alphabets))
        texts.append(made_language(rng, alphabets[lang], rng.randrange(3, 80)))
        langs.append(lang)
    half = made_language(rng, alphabets["aa"], 200) + " " + made_language(rng, alphabets["cc"], 60)
    texts += [None, "", "12 34 !", half, "a", "ü", texts[0], "m" * 300_000]
    langs += [None, "aa", None, None, None, None, langs[0], None]
    got = {r.doc_id: r for r in language.language_report(docs_of(spark, texts, langs)).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if i < 240:
            assert r.lang_pred == langs[i] and r.languages == [langs[i]]
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3
    mixed = got[243]
    share = dict(zip(mixed.languages, mixed.proportions))
    assert mixed.lang_pred == "aa" and set(share) == {"aa", "cc"} and 0.65 < share["aa"] < 0.9
    model = language.learn(docs_of(spark, texts, langs), sample_per_language=10)
    kept = language.keep_identified(docs_of(spark, texts, langs), model)
    assert kept.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert {240, 241, 242}.isdisjoint(r.doc_id for r in kept.collect())


def test_balanced_mixtures_are_whole_and_kept(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst", "ff": "uvwx", "gg": "yzäö", "hh": "ßüéè"}
    langs = [lang for lang in alphabets for _ in range(30)]
    texts = [made_language(rng, alphabets[lang], 60) for lang in langs]
    model = language.learn(docs_of(spark, texts, langs))
    sets = [("aa", "bb", "cc"), ("aa", "bb", "cc", "dd"), tuple(alphabets), ("hh",)]
    mixed = [" ".join(made_language(rng, alphabets[x], 400) for x in s) for s in sets]
    got = {r.doc_id: r for r in language.identify(docs_of(spark, mixed), model).collect()}
    for i, s in enumerate(sets):
        assert tuple(sorted(got[i].languages)) == s and abs(sum(got[i].proportions) - 1) < 1e-6
        assert all(abs(p - 1 / len(s)) < 0.1 for p in got[i].proportions)
    kept = language.keep_identified(docs_of(spark, [*mixed, "12 34", None]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]


def test_language_of_copies_is_learned(spark):
    rng = random.Random(12)
    texts = [made_language(rng, "abcdefg", 20) for _ in range(12)]
    rest = [made_language(rng, "mnopqrs", 20) for _ in range(12)]
    for t in texts:
        # One text, many times: its hash alone must not decide whether the language is learned.
        rows = docs_of(spark, [t] * 400 + rest, ["aa"] * 400 + ["bb"] * 12)
        model = language.learn(rows, sample_per_language=2)
        assert model["prior"].round(6).tolist() == [round(400 / 412, 6), round(12 / 412, 6)]
        assert (model["table"].max(axis=1) > model["table"].min(axis=1)).all()


def test_nothing_learned(spark):
    got = language.language_report(docs_of(spark, ["some text", None])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_licence_spans_and_edits(spark):
    names = {t[1]: t[2] for t in licences.TEMPLATES}
    mit, apache = names["mit-text"], names["apache-notice"]
    edited = mit.replace("free of charge", "gratis, freely").replace("publish, ", "")
    texts = [
        f"Prose é before.\n{apache}\nafter {names['gpl3-notice']}", edited + "\n" + mit, None, "", "MIT License", apache.upper(),
        "word " * 30_000 + apache, names["cc-by-nc"], "Licensed under the terms that follow below.", names["cc-by-nc"],
    ]
    got = {}
    for r in licences.scan(docs_of(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == [0, 1, 5, 6, 7, 9]
    first = {r.template: texts[0][r.start_char : r.end_char] for r in got[0]}
    assert first == {"apache-notice": apache[:-1], "gpl3-notice": names["gpl3-notice"][:-1]}
    low, high = sorted(r.coverage for r in got[1])
    assert 0.95 < low < 1.0 == high
    assert [r.template for r in got[7]] == ["cc-by-nc"]
    assert texts[6][got[6][0].start_char : got[6][0].end_char] == apache[:-1]


def test_banded_alignment_equals_full_table():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))], np.uint64)
        best = [[0] * (len(b) + 1)]
        for i in range(1, len(a) + 1):
            row = [best[-1][0] + licences.GAP]
            for j in range(1, len(b) + 1):
                step = licences.MATCH if a[i - 1] == b[j - 1] else licences.MISMATCH
                row.append(max(best[-1][j - 1] + step, best[-1][j] + licences.GAP, row[-1] + licences.GAP))
            best.append(row)
        matched, begin, end = licences.align(a, b, 0, 30)
        assert 0 <= matched <= min(len(a), len(b)) and begin <= end
        if max(best[-1]) == licences.MATCH * len(a):
            assert matched == len(a)


def test_word_hashes_do_not_depend_on_place():
    import numpy as np
    import pyarrow as pa

    column = pa.array(["tea é tea", None, "", "xx tea", "é"])
    data, offsets = kit.column_bytes(column)
    starts, ends, rows = kit.word_spans(data, offsets, kit.WHITE_SPACE)
    hashes = kit.span_hashes(kit.prefix_hashes(data), starts, ends)
    assert rows.tolist() == [0, 0, 0, 3, 3, 4]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[5] and len(np.unique(hashes)) == 3


def test_items_without_id_hit_words_in_the_report(spark):
    bench = spark.createDataFrame([(None, "secret words of nobody"), (None, "secret words"), (7, "of nobody")], "item_id long, text string")
    texts = ["has secret words of nobody in it", "secret words", "clean"]
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate.contamination(docs_of(spark, texts), bench).collect()}
    assert got == {0: (4, 1, ["7"], True), 1: (2, 0, [], True), 2: (0, 0, [], False)}
