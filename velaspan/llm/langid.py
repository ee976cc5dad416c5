"""Language identification of mixed documents: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm import kernels as K
from velaspan.llm.workspace import documents, raw

#: n-grams are counted in 2**BITS hashed cells; a model has one probability a cell and language,
#: so its size is bounded by the number of languages alone (1 MB each).
BITS = 18
#: Byte n-gram lengths.
GRAMS = (2, 3, 4)
#: EM rounds at most, and the step below which it stops.
ROUNDS, STEP = 30, 1e-3
#: Nats that another language in a document's set must gain, for each such language and root of the n-gram count.
#: Half a logarithm of that count (BIC) is too little: n-grams overlap, so what a text gains by chance grows with its length.
PENALTY = 2.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTERLESS = [b for b in range(128) if not chr(b).isalpha()]
_FOLD[_LETTERLESS] = 32


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every n-gram with a letter: A-Z folded, other ASCII taken as one space each, runs of them as one."""
    rows = len(offsets) - 1
    own = np.repeat(np.arange(rows), np.diff(offsets))
    folded = np.full(len(data) + 2 * rows, 32, np.uint8)  # a space at either end: the shortest text has n-grams
    folded[np.arange(len(data)) + 2 * own + 1] = _FOLD[data]
    row = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    keep = np.ones(len(folded), bool)
    if len(folded):
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (row[1:] != row[:-1])
    text, row = folded[keep].astype(np.uint64), row[keep]
    out_row, out_cell = [], []
    for n in GRAMS:
        size = len(text) - n + 1
        if size <= 0:
            continue
        key = np.zeros(size, np.uint64)
        for i in range(n):
            key = key << K.U(8) | text[i : i + size]
        ok = row[:size] == row[n - 1 :]
        if n == 2:
            ok &= (text[:size] != 32) | (text[1:] != 32)
        out_row.append(row[:size][ok])
        out_cell.append((K.mix(key[ok] + K.U(n << 40)) >> K.U(64 - BITS)).astype(np.int64))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_cell)


def letters(column: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script."""
    return pc.fill_null(pc.match_substring_regex(column.cast(pa.string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, last, data, offsets in K.slices(batch.column(1)):
            names, own = np.unique(np.array(langs[first:last], dtype=object).astype(str), return_inverse=True)
            row, cell = cells(data, offsets)
            flat = np.bincount(own[row] << BITS | cell, minlength=len(names) << BITS).reshape(len(names), -1)
            for name, n in zip(names.tolist(), flat, strict=True):
                total[name] = total.get(name, 0) + n
    for name, n in total.items():
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit), pa.array(n[hit].astype(np.int64))], names=["lang", "cell", "n"])


def trained(docs: DataFrame, lang: str | Column = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: cell x language) from all rows with a language.

    Counts are summed in each task before they are shuffled. What reaches the
    driver is at most 2**BITS cells a language, whatever the input's size, in
    packed arrays; the model takes 1 MB a language.
    """
    base = docs.select((F.col(lang) if isinstance(lang, str) else lang).alias("lang"), raw(text_col).alias("body")).where("lang is not null")
    counts = base.mapInArrow(_counted, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang", F.shiftright("cell", 13).alias("block")).agg(F.collect_list(F.col("cell").cast("int")).alias("cells"), F.collect_list("n").alias("ns"))
    table = packed.toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    out = np.full((1 << BITS, len(names)), 0.5, np.float32)
    for lang_, cells_, ns in zip(table["lang"], table["cells"], table["ns"], strict=True):
        out[cells_.values.to_numpy(), names.index(lang_.as_py())] += ns.values.to_numpy()
    for j in range(len(names)):
        out[:, j] = np.log(out[:, j].astype(np.float64) / out[:, j].sum(dtype=np.float64))
    return names, out


def mixture(likelihood: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """A document's language shares, from n-gram log likelihoods (n-gram x language) and counts.

    EM from equal shares; then languages with the least shares leave as long
    as the likelihood without them, EM run again, loses no more than the
    penalty for one more language: half of them at once, and fewer where that
    fails, so that a hundred languages take a few fits.
    """
    n, langs = likelihood.shape
    dense = np.exp(likelihood - likelihood.max(axis=1, keepdims=True)).astype(np.float64)
    fine = penalty * np.sqrt(weight.sum())

    def fit(live: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        p = dense[:, live]
        for _ in range(ROUNDS):
            joint = p @ share
            new = share * (p.T @ (weight / np.maximum(joint, 1e-300))) / weight.sum()
            moved = np.abs(new - share).max()
            share = new / new.sum()
            if moved < STEP:
                break
        return share, float(weight @ np.log(np.maximum(p @ share, 1e-300)))

    live = np.arange(langs)
    share, fits = fit(live, np.full(langs, 1.0 / langs))
    leave = max(1, langs // 2)
    while len(live) > 1:
        leave = min(leave, max(1, len(live) // 2))
        rest = np.sort(np.argsort(share, kind="stable")[leave:])
        start = np.maximum(share[rest], 1e-6)
        less, lower = fit(live[rest], start / start.sum())
        if fits - lower <= fine:
            live, share, fits = live[rest], less, lower
        elif leave == 1:
            break
        else:
            leave //= 2
    out = np.zeros(langs)
    out[live] = share
    return out


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = (), penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, lang_pred, score, langs, shares): the languages of each whole text.

    ``langs`` is the set that penalised likelihood selects, greatest share
    first, ``shares`` their proportions, ``lang_pred`` and ``score`` the first
    of them; equal shares go to the lesser name. A text that is null, or has no
    letter, or nothing to learn from, is ``und`` with score 0. The model is
    broadcast; its size depends on the number of languages only. Rows are
    independent; repeated ids stay repeated rows; only columns named in
    ``keep`` are carried along.
    """
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            good = letters(batch.column(0))
            found: list[tuple[list[str], list[float]]] = []
            for first, last, data, offsets in K.slices(batch.column(0)):
                row, cell = cells(data, offsets)
                key, count = np.unique(row << BITS | cell, return_counts=True)
                row, cell = key >> BITS, key & (1 << BITS) - 1
                ends = np.searchsorted(row, np.arange(last - first + 1))
                for r in range(last - first):
                    a, b = ends[r], ends[r + 1]
                    if not good[first + r] or a == b or not names:
                        found.append(([], []))
                        continue
                    share = mixture(table[cell[a:b]], count[a:b].astype(np.float64), penalty)
                    order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
                    found.append(([names[i] for i in order], [min(1.0, float(share[i])) for i in order]))
            cols = [pa.array([x[0] if x else "und" for x, _ in found], pa.string()), pa.array([s[0] if s else 0.0 for _, s in found], pa.float64()), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], "lang_pred", "score", "langs", "shares"])

    base = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *(F.col(c) for c in keep))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    return base.mapInArrow(run, f"{kind}, lang_pred string, score double, langs array<string>, shares array<double>")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole of ``documents``, learnt from four fifths of them."""
    docs = documents(spark, sf_dir)
    model = trained(docs.where(~held_out()))
    return identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs", "shares")
