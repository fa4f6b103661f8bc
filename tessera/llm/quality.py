"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_row
from .hashing import covered, ngram_hashes, prefix, repeats, spans_hash, word_spans

#: Largest share of a text's word characters inside n-grams of that many words that occurred earlier in the text.
NGRAM_LIMITS = {5: 0.30, 6: 0.30, 7: 0.30, 8: 0.30, 9: 0.30, 10: 0.30}
#: Largest share of word characters in lines that occurred earlier in the text, and of such lines. All limits leave
#: a short clean text with one repeated licence line alone.
LINE_CHARS_LIMIT, LINES_LIMIT = 0.30, 0.50
MIN_WORDS, REPEAT_WORDS_PERCENT = 50, 50
_SYMBOLS = b"#*$%&|<>"
_NOT_FIRST = np.zeros(256, np.int64)
_NOT_FIRST[0x80:0xC0] = 1  # bytes that continue a code point

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)


def measure(b: bytes) -> list[int]:
    """The MEASURES of one text. Characters are code points and only those of words count."""
    data = np.frombuffer(b, np.uint8)
    start, end = word_spans(data)
    n = len(start)
    if not n:
        return [0, 0, sum(b.count(bytes([c])) for c in _SYMBOLS), 0, 0, 0, 0, *(0 for _ in NGRAM_LIMITS)]
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(1 - _NOT_FIRST[data], out=letters[1:])
    chars = letters[end] - letters[start]
    p = prefix(data)
    words = spans_hash(p, start, end)
    symbols = len(b) - len(b.translate(None, _SYMBOLS))

    breaks = np.flatnonzero(data == 10)
    line_start, line_end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    first = np.searchsorted(start, line_start)
    last = np.searchsorted(start, line_end)
    full = last > first
    _, later = repeats(spans_hash(p, line_start[full], line_end[full]))
    total = np.concatenate(([0], np.cumsum(chars)))
    line_chars = int((total[last[full]] - total[first[full]])[later].sum())

    again, _ = repeats(ngram_hashes(words, 3))
    repeat_words = int(covered(again, 3, n).sum())
    grams = []
    for size in NGRAM_LIMITS:
        if not again.any():  # no repeated n-gram without a repeated shorter one
            grams.append(0)
            continue
        _, before = repeats(ngram_hashes(words, size))
        grams.append(int(chars[covered(before, size, n)].sum()))
        if not before.any():
            again = before
    return [n, int(chars.sum()), symbols, int(later.sum()), repeat_words, int(full.sum()), line_chars, *grams]


def _measures(rows: list[bytes]) -> dict[str, pa.Array]:
    out = np.array([measure(b) for b in rows], np.int64).reshape(len(rows), -1)
    return {x.split(" ")[0]: pa.array(np.ascontiguousarray(out[:, i])) for i, x in enumerate(MEASURES.split(", "))}


def verdicts(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept to the MEASURES: plain column expressions."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_WORDS_PERCENT * F.col("n_words"))
    share = lambda c, limit: F.col(c) > limit * F.col("word_chars")
    bad = share("dup_line_chars", LINE_CHARS_LIMIT) | (F.col("n_dup_lines") > LINES_LIMIT * F.col("n_lines"))
    for n, limit in NGRAM_LIMITS.items():
        bad = bad | share(f"dup_{n}gram_chars", limit)
    return measured.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~bad)


def quality_report(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per row of docs: keys, MEASURES, base_failed, kept.

    Words are runs of characters other than space and \\t..\\r. A null text has no words and fails; so do
    empty ones. Repeated rows each get their row; other columns are ignored, whatever their names.
    Each text is measured on its own, whole, in one pass over the table without a shuffle.
    """
    return verdicts(per_row(docs, list(keys), text, MEASURES, _measures))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    columns = docs.columns
    names = [x.split(" ")[0] for x in MEASURES.split(", ")]
    own = fresh(docs, *[f"c{i}" for i in range(len(columns))])
    held = docs.toDF(*own)
    report = quality_report(held, tuple(own), own[columns.index(text)])
    return report.filter("kept").drop(*names, "base_failed", "kept").toDF(*columns)
