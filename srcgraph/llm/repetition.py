"""Repetition coverage: how much of a text stands in n-grams and lines that came before.

Rolling hashes of the word windows of several lengths are compared within each document, all
documents of a slice at once in numpy. Each length's coverage is the share of word characters in
windows that repeat an earlier window; for lines it is the share of lines, and of their
characters, that repeat an earlier line. A text whose coverage passes a limit is rejected; a few
characters and one line are free, which matters to short texts alone.

A window of n words repeats only if both its windows of n - 1 words do, so only the shortest
windows are all sorted; the longer ones are looked for among what is left.

Defined results: a null or empty text has no words and fails; repeated rows are judged alike;
64-bit hashes stand for words, windows and lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_batches
from .words import Words, mix, windows

#: Limits on the share of word characters within repeated n-grams, as published rules for web pages have them.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Limits on the share of repeated lines, and of characters in them.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
#: What any text may repeat beyond these shares: one line of boilerplate should not reject a short text. Characters, lines.
FREE_CHARS, FREE_LINES = 60, 1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_share": pa.float64(), "dup_line_char_share": pa.float64(), "max_ngram_share": pa.float64()}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, max_ngram_share double"


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: is it found twice or more, and did it come before?"""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words the n-word windows at `at` cover."""
    step = np.zeros(words + 1, np.int32)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, limits: dict[int, float] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """The columns for all documents of a slice."""
    w = Words(data, offsets)
    docs, n_docs, n_words = w.documents(), len(offsets) - 1, len(w.starts)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    out = {"n_words": w.counts.astype(np.int64), "word_chars": total(w.inside & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data])}

    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    ends = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(ends, offsets[line_doc + 1])
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    _, later = _repeats(w.hashes(starts, ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    chars = points[ends] - points[starts]
    per_doc = lambda weight, doc: np.bincount(doc, weight, minlength=n_docs)
    out["n_dup_lines"] = per_doc(later, line_doc).astype(np.int64)
    lines, line_chars, dup_chars = np.bincount(line_doc, minlength=n_docs), per_doc(chars, line_doc), per_doc(later * chars, line_doc)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(1, lines)
    out["dup_line_char_share"] = dup_chars / np.maximum(1, line_chars)
    bad_lines = (out["n_dup_lines"] > LINE_LIMIT * lines + FREE_LINES) | (dup_chars > LINE_CHAR_LIMIT * line_chars + FREE_CHARS)

    words = w.hashes(w.starts, w.ends)
    size = points[w.ends] - points[w.starts]
    salt = mix(docs.astype(np.uint64) + np.uint64(1))
    left = w.first[1:][docs] - np.arange(n_words)  # words from here to the document's end
    at = np.flatnonzero(left >= 3)
    twice, _ = _repeats(windows(words, 3)[at] ^ salt[at])
    at = at[twice]
    out["n_repeat_words"] = per_doc(_covered(at, 3, n_words), docs).astype(np.int64)
    worst, bad, n = np.zeros(n_docs), np.zeros(n_docs, bool), 3
    for length in sorted(limits):
        while n < length:  # a repeated window of n + 1 words begins where two repeated ones of n words do
            n += 1
            at = at[np.isin(at + 1, at, assume_unique=True) & (left[at] >= n)] if len(at) else at
        keys = np.zeros(len(at), np.uint64)
        for k in range(length):
            keys = mix(keys + words[at + k])
        twice, later = _repeats(keys ^ salt[at])
        covered = per_doc(_covered(at[later], length, n_words) * size, docs)
        worst, bad = np.maximum(worst, covered / np.maximum(1, out["word_chars"])), bad | (covered > limits[length] * out["word_chars"] + FREE_CHARS)
        at = at[twice]
    out["max_ngram_share"] = worst
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~(out["base_failed"] | bad | bad_lines)
    return out


def score_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, then the measures and the verdict. One pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in sliced(batch.column(batch.num_columns - 1)):
                made = measure(data, offsets)
                head = [c.slice(start, end - start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(head + [pa.array(made[c], t) for c, t in COLUMNS.items()], names=batch.schema.names[:-1] + list(COLUMNS))

    carried = [F.col(id_col).alias("_c0"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(keep, 1))]
    rows = text_batches(docs).select(*carried, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", " + SCHEMA
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("_c0").alias(id_col), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(keep, 1)), *COLUMNS)
