"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark, in every text, the characters that
lie in an n-gram or a line seen before. All work is inside a row: no shuffle.

Rows: a null or empty text has no words, fails the base rule and is not kept.
Repeated rows are judged alike. Texts of any length are measured whole; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kit

# Largest share (percent) of characters in repeated n-grams, by n.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_N, REPEAT_LIMIT = 8, 30

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _schema(id_type: T.DataType) -> T.StructType:
    fields = [T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in _BASE]
    fields += [T.StructField("dup_line_chars", T.LongType())]
    fields += [T.StructField(f"dup_chars_{n}", T.LongType()) for n in NGRAM_LIMITS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return T.StructType(fields)


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of all lines between line feeds."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    rows = np.searchsorted(offsets, starts, "right") - 1
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    return starts, np.minimum(next_break, offsets[rows + 1]), rows


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the rows of one run of texts."""
    n = len(offsets) - 1
    out = {}
    starts, ends, rows = kit.word_spans(data, offsets, kit.WHITE_SPACE)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    out["n_words"] = kit.row_counts(rows, n)
    out["word_chars"] = np.bincount(rows, chars, n).astype(np.int64)
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marks[data], out=symbols[1:])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    sums = kit.prefix_hashes(data)
    row_salt = kit.mix(np.arange(1, n + 1, dtype=np.uint64))
    l_start, l_end, l_row = _lines(data, offsets)
    filled = np.searchsorted(starts, l_start) < np.searchsorted(starts, l_end)
    l_start, l_end, l_row = l_start[filled], l_end[filled], l_row[filled]
    _, later = kit.repeated(kit.span_hashes(sums, l_start, l_end) ^ row_salt[l_row])
    out["n_dup_lines"] = kit.row_counts(l_row[later], n)
    word_chars = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=word_chars[1:])
    in_line = word_chars[np.searchsorted(starts, l_end)] - word_chars[np.searchsorted(starts, l_start)]
    out["dup_line_chars"] = np.bincount(l_row[later], in_line[later], n).astype(np.int64)

    words = kit.span_hashes(sums, starts, ends)
    at = np.arange(max(0, len(words)))
    for size in sorted(NGRAM_LIMITS):
        grams, whole = kit.shingles(words, rows, size)
        # Only where the shorter n-gram is repeated can the longer one be.
        at = at[at < len(grams)]
        at = at[whole[at]]
        twice, later = kit.repeated(grams[at] ^ row_salt[rows[at]])
        out[f"dup_chars_{size}"] = np.bincount(rows, chars * _covered(at[later], size, len(words)), n).astype(np.int64)
        at = at[twice]
        if size == REPEAT_N:
            out["n_repeat_words"] = kit.row_counts(rows[_covered(at, size, len(words))], n)
    return out


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_LIMIT * m["n_words"])
    worst = 100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for n, limit in NGRAM_LIMITS.items():
        worst |= 100 * m[f"dup_chars_{n}"] > limit * m["word_chars"]
    return failed, ~failed & ~worst


def quality_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its measures, the base rule and the verdict."""
    schema = _schema(docs.schema[id_column].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(1)):
                m = measures(data, offsets)
                m["base_failed"], m["kept"] = verdict(m)
                columns = [batch.column(0).slice(a, b - a)] + [pa.array(m[f.name]) for f in schema.fields[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kit.map_arrow(docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")), run, schema)
