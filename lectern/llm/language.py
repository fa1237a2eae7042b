"""Language identification as inference of a mixture of languages.

Training counts byte n-grams of a bounded, documented sample of labelled documents.
A document is a mixture: its n-grams are drawn from languages in unknown proportions.
Sets grow from the language that fits best alone, by the language that helps most, with
proportions from expectation-maximisation; growth ends when two languages in turn do not
raise the penalised likelihood. Then members are dropped while that raises it. Neither
the languages tried nor the size of a set are bounded.

The score is that of the main language: its posterior for one language, its proportion
in a mixture. A filter asks for the certainty of the set instead: the posterior for one
language, in a mixture the odds of the set against the best smaller one tried.

The model is a table of ``SLOTS`` log-likelihoods per language; with at most
``max_languages`` languages its size is bounded, so it is broadcast.

A null text, or one without a letter, is ``und`` with score 0, and so is every text
when nothing could be learned. A text too short for an n-gram takes the most frequent
language. Equal likelihoods are decided by the order of language names. Repeated
rows get equal answers; columns of ``docs`` other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

SLOTS = 1 << 16
GRAM = 3
SAMPLE_PER_LANGUAGE = 3000
MAX_LANGUAGES = 1000
ROUNDS = 8
# A further language must raise the log-likelihood by this much per log of the n-grams.
PENALTY = 6.0
# Languages in turn that may fail to raise the likelihood before a set stops growing.
PATIENCE = 2
# Least certainty of the set of a document that a filter keeps.
MIN_SCORE = 0.5
UNKNOWN = "und"
LETTER = "\\p{L}"


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Row and slot of every n-gram, of lower-cased texts with a space at both ends."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    text = np.full(len(data) + 2 * n, 32, np.uint8)
    text[np.arange(len(data)) + 2 * rows + 1] = table[data]
    starts = offsets[:-1] + 2 * np.arange(n)
    wide = text.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(text) >= GRAM else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)[: len(code)]
    last = np.append(starts[1:], len(text))
    inside = np.arange(len(code)) + GRAM <= last[row]
    # Runs of separators say nothing.
    inside &= ~((text[: len(code)] == 32) & (text[1 : len(code) + 1] == 32))
    inside &= ~((text[1 : len(code) + 1] == 32) & (text[2 : len(code) + 2] == 32))
    slot = (code * np.uint32(2654435761)) >> np.uint32(16)
    return row[inside], slot[inside].astype(np.int64)


def learn(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> dict:
    """Fit the model on docs(text, lang): at most ``sample_per_language`` distinct texts a language.

    The sample is chosen by the 64-bit hash of the text, which also tells texts apart, so
    reruns agree. The prior counts all rows.
    """
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").withColumn("mark", F.xxhash64("text"))
    sizes = docs.groupBy("lang", "mark").count().groupBy("lang").agg(
        F.sum("count").alias("count"), F.count("*").alias("texts")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted(r["lang"] for r in sizes)
    number, texts = {r["lang"]: r["count"] for r in sizes}, {r["lang"]: r["texts"] for r in sizes}
    if not names:
        return {"names": [], "prior": np.zeros(0), "table": np.zeros((0, SLOTS), np.float32)}
    # Twice the wanted share comes through the filter; the rank cuts it to the bound.
    shares = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, 2.0 * sample_per_language / texts[k]))])
    sample = docs.where(
        F.pmod(F.col("mark"), F.lit(1 << 20)) < F.lit(1 << 20) * shares[F.col("lang")]
    ).dropDuplicates(["lang", "mark"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= sample_per_language)
    sample = kit.spread(sample, "lang", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(names)}
        counts = np.zeros((len(names), SLOTS), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, data, offsets in kit.pieces(batch.column(0)):
                row, slot = _grams(data, offsets)
                counts += np.bincount(lang[a:b][row] * SLOTS + slot, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["at", "n"])

    found = kit.map_arrow(sample.select("text", "lang"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(len(names) * SLOTS, 0.1)
    table[found["at"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    table = table.reshape(len(names), SLOTS)
    prior = np.array([number[x] for x in names], float)
    return {
        "names": names, "prior": prior / prior.sum(),
        "table": np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _fitted(table: np.ndarray, members: np.ndarray, entry: np.ndarray, slot: np.ndarray, count: np.ndarray, first: np.ndarray):
    """Proportions of each row's mixture of its members, its log-likelihood, and that of every n-gram."""
    logs = table[members[entry], slot[:, None]].astype(float)
    # Relative chances within each n-gram keep the numbers in range.
    peak = logs.max(axis=1)
    chance = np.exp(logs - peak[:, None])
    total = np.maximum(np.add.reduceat(count, first), 1e-12)
    share = np.full(members.shape, 1.0 / members.shape[1])
    for _ in range(ROUNDS):
        weight = chance * share[entry]
        weight *= (count / np.maximum(weight.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(weight, first, axis=0) / total[:, None]
    fit = np.log(np.maximum((chance * share[entry]).sum(axis=1), 1e-300)) + peak
    return share, np.add.reduceat(count * fit, first), fit


def _of_rows(chosen: np.ndarray, entry: np.ndarray, *columns: np.ndarray):
    """The entries of the chosen rows, renumbered, their columns, and where each row begins."""
    keep = chosen[entry]
    entry = (np.cumsum(chosen) - 1)[entry[keep]]
    return entry, *(c[keep] for c in columns), np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))


def _helper(table: np.ndarray, members: np.ndarray, slot: np.ndarray, count: np.ndarray, first: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """The language that raises each row's likelihood most when it joins in equal part."""
    size = members.shape[1]
    best, most = np.zeros(len(first), np.int64), np.full(len(first), -np.inf)
    for i in range(len(table)):
        gain = np.add.reduceat(count * np.log(size + np.exp(np.minimum(table[i, slot] - fit, 600))), first)
        better = (gain > most) & ~(members == i).any(axis=1)
        best[better], most[better] = i, gain[better]
    return best


def infer(data: np.ndarray, offsets: np.ndarray, model: dict):
    """For each row: proportions over the model's languages, the score of the first, the certainty of the set."""
    n, names, table, prior = len(offsets) - 1, model["names"], model["table"], model["prior"]
    shares = np.zeros((n, len(names)))
    score = np.zeros(n)
    top = int(np.argmax(prior))
    shares[:, top], score[:] = 1.0, prior[top]
    row, slot = _grams(data, offsets)
    if not len(row):
        return shares, score, score
    key, count = np.unique(row * SLOTS + slot, return_counts=True)
    row, slot, count = key >> 16, key & (SLOTS - 1), count.astype(float)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    known, entry = row[first], np.cumsum(np.append(False, row[1:] != row[:-1]))
    alone = np.stack([np.add.reduceat(count * table[i, slot], first) for i in range(len(names))], axis=1)
    cost = PENALTY * np.log(np.add.reduceat(count, first) + 1)
    lead = alone.argmax(axis=1)
    best = alone.max(axis=1) - cost
    less, size = np.full(len(first), -np.inf), np.ones(len(first), np.int64)  # best of smaller sets; languages in the set
    chosen = np.zeros((len(first), len(names)))
    chosen[np.arange(len(first)), lead] = 1.0
    at, failed, members, part = np.arange(len(first)), np.zeros(len(first), np.int64), lead[:, None], (entry, slot, count, first)
    fit = table[lead[entry], slot].astype(float)
    while len(at) and members.shape[1] < len(names):
        members = np.column_stack([members, _helper(table, members, *part[1:], fit)])
        share, total, fit = _fitted(table, members, *part)
        total -= members.shape[1] * cost[at]
        better = total > best[at]
        up = at[better]
        less[up], best[up], size[up], chosen[up] = best[up], total[better], members.shape[1], 0.0
        chosen[up[:, None], members[better]] = share[better]
        failed = np.where(better, 0, failed + 1)
        going = failed < PATIENCE
        *part, fit, start = _of_rows(going, part[0], *part[1:3], fit)
        part, at, failed, members = (*part, start), at[going], failed[going], members[going]
    for k in range(int(size.max()), 2, -1):
        rows = size == k
        if not rows.any():
            continue
        at = np.flatnonzero(rows)
        order = np.argsort(-chosen[at], axis=1, kind="stable")[:, : k - 1]
        share, total, _ = _fitted(table, order, *_of_rows(rows, entry, slot, count))
        total -= (k - 1) * cost[at]
        better = total >= best[at]
        up = at[better]
        best[up], size[up], chosen[up] = total[better], k - 1, 0.0
        chosen[up[:, None], order[better]] = share[better]
        less[at[~better]] = np.maximum(less[at[~better]], total[~better])
    sure = np.exp(alone - alone.max(axis=1, keepdims=True))
    sure = 1.0 / sure.sum(axis=1)
    shares[known] = chosen
    single, certain = size == 1, score.copy()
    score[known] = np.where(single, sure, chosen.max(axis=1))
    certain[known] = np.where(single, sure, 1.0 / (1.0 + np.exp(np.clip(less - best, -600, 600))))
    return shares, np.clip(score, 0.0, 1.0), np.clip(certain, 0.0, 1.0)


def identify(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and the languages of the chosen set with their proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("proportions", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, pred, score, _, names, shares in _answers(batch.column(1), batch.column(2), shared.value):
                used = shares > 0
                at = np.nonzero(used)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score),
                    kit.list_column(names[at[1]], used.sum(axis=1), pa.string()),
                    kit.list_column(shares[at], used.sum(axis=1), pa.float64()),
                ], names=schema.names)

    text = docs[text_column]
    return kit.map_arrow(docs.select(docs[id_column].alias("doc_id"), text.alias("text"), _has_letter(text)), run, schema)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False)).alias("__letters")


def _answers(texts: pa.Array, letters: pa.Array, model: dict):
    """Row range, predictions, scores, certainties, language names and proportions (0 if unknown) of a column."""
    names = np.array([*model["names"], UNKNOWN], dtype=object)
    has_letter = np.array(letters.to_pylist(), bool)
    for a, b, data, offsets in kit.pieces(texts):
        shares = np.zeros((b - a, len(names)))
        score, certain, known = np.zeros(b - a), np.zeros(b - a), has_letter[a:b] & (len(names) > 1)
        if len(names) > 1:
            found, main, whole = infer(data, offsets, model)
            shares[known, :-1], score[known], certain[known] = found[known], main[known], whole[known]
        yield a, b, np.where(known, names[shares.argmax(axis=1)], UNKNOWN), score, certain, names, shares


def keep_identified(docs: DataFrame, model: dict, min_score: float = MIN_SCORE, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language or set of languages has at least the certainty ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [(pred != UNKNOWN) & (certain >= min_score)
                    for _, _, pred, _, certain, _, _ in _answers(batch.column(at), batch.column(len(batch.schema) - 1), shared.value)]
            if good:
                kept = batch.filter(pa.array(np.concatenate(good)))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))

    return kit.map_arrow(docs.select("*", _has_letter(docs[text_column])), run, docs.schema)


def held_out(id_column: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def language_report(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from the other folds of docs(doc_id, text, lang) and predict all documents."""
    fold = F.coalesce(held_out(docs["doc_id"]), F.lit(False))
    model = learn(docs.where(~fold), sample_per_language)
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "proportions")
