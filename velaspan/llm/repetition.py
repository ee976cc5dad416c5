"""Repetition coverage of texts: duplicated lines and word n-grams, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm import kernels as K
from velaspan.llm.workspace import documents, raw

#: Greatest share of word characters inside word n-grams that occur again, by n. Gopher's limits
#: (arXiv:2112.11446, table A1) count a repeat only; here its first place counts too, so they are doubled.
GRAM_LIMITS = {5: 0.30, 7: 0.26, 10: 0.20}
#: Greatest share of line characters in lines equal to an earlier one (same source).
LINE_CHARS_LIMIT = 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have a value that another entry of the same row has too."""
    if not len(keys):
        return np.zeros(0, bool)
    own = K.mix(keys + K.mix(row.astype(np.uint64) + K.U(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(words: K.Words, hashes: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a window of k words that its row has twice or more."""
    ok = np.flatnonzero(K.within(words, k))
    hit = ok[repeated(K.windows(hashes, k)[ok], words.row[ok])] if len(ok) else ok
    edge = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, np.minimum(hit + k, len(words.row)), -1)
    return np.cumsum(edge[:-1]) > 0


def measures(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of :func:`quality` for the rows of one slice."""
    words = K.Words(data, offsets)
    rows = len(offsets) - 1
    hashes = words.hashes()
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    chars = points[words.end] - points[words.start]
    out = {"n_words": words.count.astype(np.int64), "word_chars": _sums(chars, words.first), "n_symbols": _sums(_SYMBOL[data], offsets)}

    # lines: cut at \n and at row ends; the i-th begin belongs to the i-th end
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, begins)
    begins, ends = begins[has], ends[has]
    row = np.searchsorted(offsets, begins, side="right") - 1
    key = K.ranges(data, begins, ends)
    order = np.lexsort((begins, key, row))
    later = np.zeros(len(order), bool)
    if len(order):
        a, b = order[1:], order[:-1]
        later[a] = (key[a] == key[b]) & (row[a] == row[b])
    out["n_dup_lines"] = np.bincount(row[later], minlength=rows).astype(np.int64)
    length = points[ends] - points[begins]
    out["line_chars"] = np.bincount(row, weights=length, minlength=rows)
    out["dup_line_chars"] = np.bincount(row[later], weights=length[later], minlength=rows)
    out["n_repeat_words"] = _sums(hit := covered(words, hashes, 5), words.first)
    for k in grams:
        out[f"chars_{k}"] = _sums((hit if k == 5 else covered(words, hashes, k)) * chars, words.first)
    return out


def quality(docs: DataFrame, gram_limits: dict[int, float] | None = None, line_chars_limit: float = LINE_CHARS_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, coverage shares and verdict.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words in 5-word
    windows found twice or more), base_failed, kept, then the shares that the
    method judges: share_<n> for each n-gram length, share_line_chars. A document without words (null, empty) has counts of 0,
    shares of 0 and fails. Rows are independent: no shuffle; repeated ids stay
    repeated rows; other columns are ignored.
    """
    limits = GRAM_LIMITS if gram_limits is None else gram_limits
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"share_{k}" for k in limits), "share_line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in K.slices(batch.column(1)):
                m = measures(data, offsets, tuple(limits))
                failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                shares = {f"share_{k}": m[f"chars_{k}"] / np.maximum(m["word_chars"], 1) for k in limits}
                shares["share_line_chars"] = m["dup_line_chars"] / np.maximum(m["line_chars"], 1)
                bad = failed | (shares["share_line_chars"] > line_chars_limit)
                for k, most in limits.items():
                    bad = bad | (shares[f"share_{k}"] > most)
                cols = m | shares | {"base_failed": failed, "kept": ~bad}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(cols[c]) for c in names[1:])], names=names)

    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in names[8:])
    return docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body")).mapInArrow(run, kind)


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage over the whole of ``documents``."""
    return quality(documents(spark, sf_dir))

