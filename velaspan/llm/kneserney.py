"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, learnt from trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from velaspan.llm import kernels as K
from velaspan.llm.workspace import discard, documents, raw, stored

#: Bytes of the longest n-gram; n-grams of up to 7 bytes fit a 64-bit key with their length.
ORDER = 5
#: Bytes of text whose distinct n-grams are gathered, and whose scores are looked up, together.
CHUNK = 16_000_000
#: Scored n-grams up to this number are broadcast (about 100 bytes each, as Spark does it) to join the chunks that hold them; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
#: Share of trusted held-out documents of a language whose perplexity is at most the threshold, and slack on it.
QUANTILE, SLACK = 0.99, 1.10
#: Steps of a nat in which perplexities are counted for the quantiles.
STEPS = 1_000
#: Nats that any text may have beyond its threshold: the first bytes have little context, which only weighs on short texts.
ALLOWANCE = 12.0
#: A language's threshold is its own quantile and, with the weight of so many documents, that of all languages.
ENOUGH = 10
#: Trusted labels up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Texts are padded in front with this byte, which no model ever predicts.
PAD = 1


def _padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with order - 1 pads before each row, positions of the rows' own bytes, their rows)."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    at = np.arange(len(data)) + (row + 1) * (order - 1)
    out = np.full(len(data) + rows * (order - 1), PAD, np.uint8)
    out[at] = data
    return out, at, row


def _keys(padded: np.ndarray, at: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """Keys of the n bytes that end ``back`` bytes before each position: the bytes, and the length above them."""
    key = np.full(len(at), n << 56, np.uint64)
    for i in range(n):
        key |= padded[at - back - i].astype(np.uint64) << K.U(8 * i)
    return key


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    out, where = np.unique(keys, return_inverse=True)
    return out, np.bincount(where, weights=counts).astype(np.int64)


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column(0)):
                padded, at, _ = _padded(data, offsets, order)
                parts.append(np.unique(_keys(padded, at, order), return_counts=True))
                size += len(parts[-1][0])
                if size > 3_000_000:
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
                    if size > 1_500_000:
                        yield _rows(*parts[0])
                        parts, size = [], 0
        if parts:
            yield _rows(*_merge(parts))

    def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    return run


def _tail(n: int) -> Column:
    """Key of an n-gram's last n - 1 bytes."""
    return F.expr(f"(key & {(1 << 8 * (n - 1)) - 1}L) | {(n - 1) << 56}L")


def _context(n: int) -> Column:
    """Key of an n-gram's first n - 1 bytes."""
    return F.expr(f"shiftright(key & {(1 << 8 * n) - 1}L, 8) | {(n - 1) << 56}L")


def trained(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of the texts in column ``body``: (key, logp, bow), natural logarithms.

    The longest n-grams have their counts, shorter ones the number of bytes
    seen before them (continuation counts). Each order has three discounts from
    its counts of counts. Probabilities are interpolated with the next shorter
    order; ``bow`` is the weight of that order after this n-gram (null: never
    a context). Counts are summed in each task, then in the shuffle; the joins
    of an n-gram with its context and with its tail are equi-joins on keys.
    """
    counts = {order: stored(texts.select("body").mapInArrow(_counted(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")}
    for n in range(order - 1, 0, -1):
        counts[n] = stored(counts[n + 1].groupBy(_tail(n + 1).alias("key")).agg(F.count("*").alias("n")), "counts")
    lower = None
    model = []
    bows = []
    for n in range(1, order + 1):
        few = {r["n"]: r["c"] for r in counts[n].where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        n1, n2, n3, n4 = (few.get(i, 0) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        discount = [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        own = counts[n].withColumn("ctx", _context(n))
        own = own.withColumn("mass", F.col("n") - F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2]))
        totals = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("mass").alias("held"))
        rows = own.join(totals, "ctx")
        gamma = (F.col("total") - F.col("held")) / F.col("total")
        share = F.col("mass") / F.col("total")
        if n == 1:
            p = rows.select("key", (share + gamma / 256).alias("p"))
        else:
            p = rows.select("key", _tail(n).alias("tail"), share.alias("s"), gamma.alias("g")).join(lower.select(F.col("key").alias("tail"), F.col("p").alias("q")), "tail").select("key", (F.col("s") + F.col("g") * F.col("q")).alias("p"))
        lower = stored(p, "probabilities")
        model.append(lower)
        bows.append(totals.select(F.col("ctx").alias("key"), F.log(gamma).alias("bow")))
    every, weights = model[0], bows[0]
    for m, b in zip(model[1:], bows[1:], strict=True):
        every, weights = every.union(m), weights.union(b)
    out = stored(every.join(weights, "key", "full_outer").select("key", F.log("p").alias("logp"), "bow"), "model")
    discard(*counts.values(), *model)
    return out


class Table:
    """Values by 64-bit key: sorted by hash, found by the hash's upper bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = K.mix(keys)
        order = np.argsort(hashed)
        self.hash, self.value = hashed[order], values[order].astype(np.float32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = K.U(64 - bits)
        self.start = np.searchsorted(self.hash, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.longest = int(np.diff(np.append(self.start, len(keys))).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN where a key is missing."""
        out = np.full(len(keys), np.nan, np.float32)
        if not len(self.hash):
            return out
        hashed = K.mix(keys)
        spot = self.start[(hashed >> self.shift).astype(np.int64)].astype(np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.longest):
            inside = spot < len(self.hash)
            todo, spot, hashed = todo[inside], spot[inside], hashed[inside]
            here = self.hash[spot]
            hit = here == hashed
            out[todo[hit]] = self.value[spot[hit]]
            more = here < hashed
            todo, spot, hashed = todo[more], spot[more] + 1, hashed[more]
            if not len(todo):
                break
        return out


#: Log probability, beyond all backing off, of a byte that no trusted text holds.
UNSEEN = float(np.log(1 / 256))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, parts) of consecutive rows with ``size`` bytes of text or little more.

    The number follows from the partition and its rows alone, however they
    come in batches, so two passes over one scan agree on it.
    """
    first = TaskContext.get().partitionId() << 32
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64)
        upto, at = np.cumsum(lengths) + held, 0
        while at < len(batch):
            end = int(np.searchsorted(upto, size)) + 1
            if end > len(batch):
                break
            yield first, [*parts, batch.slice(at, end - at)]
            first, parts, held, at = first + 1, [], 0, end
            upto = upto - upto[end - 1]
            upto[:end] = -1
        if at < len(batch):
            parts.append(batch.slice(at))
            held = int(upto[-1])
    if parts:
        yield first, parts


def _grams(order: int, size: int):
    """The distinct n-grams of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in _chunks(batches, size):
            found: list[np.ndarray] = []
            for part in parts:
                for _, _, data, offsets in K.slices(part.column(0)):
                    padded, at, _ = _padded(data, offsets, order)
                    found.append(np.unique(_keys(padded, at, order)))
                    if len(found) > 16:
                        found = [np.unique(np.concatenate(found))]
            keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            for at in range(0, len(keys), 500_000):
                own = keys[at : at + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk, np.int64)), pa.array(own.view(np.int64))], names=["chunk", "key"])

    return run


def _packs(size: int):
    """Each chunk's rows as one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in _chunks(batches, size):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in parts:
                    stream.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "pack"])
            K.give_back()

    return run


def _summed(order: int):
    """The rows of a chunk with the sums of their n-grams' log probabilities."""

    def run(packs: pa.Table, known: pa.Table) -> pa.Table:
        table = Table(known["key"].to_numpy().view(np.uint64), known["logp"].to_numpy())
        rows = []
        for pack in packs["pack"].combine_chunks():
            for batch in pa.ipc.open_stream(pack.as_buffer()):
                sums = [np.zeros(0)]
                for a, b, data, offsets in K.slices(batch.column(0)):
                    padded, at, row = _padded(data, offsets, order)
                    logp = table.find(_keys(padded, at, order))
                    if np.isnan(logp).any():
                        raise ValueError("an n-gram of a chunk has no score: its rows were not those that were read before")
                    sums.append(np.bincount(row, weights=logp, minlength=b - a))
                rows.append(pa.RecordBatch.from_arrays([pc.binary_length(batch.column(0)).cast(pa.int64()), *batch.columns[1:], pa.array(np.concatenate(sums))], names=["n_bytes", *batch.schema.names[1:], "total"]))
        K.give_back()
        return pa.Table.from_batches(rows)

    return run


def _known(keys: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(key, logp) of each of the longest n-grams in ``keys``, by equi-joins with the model.

    One join settles what the model holds. The rest is joined once more by all
    shorter n-grams and contexts that it may back off to.
    """
    first = stored(keys.join(model.select("key", "logp"), "key", "left"), "first-scores")
    suffix = lambda n: F.expr(f"(key & {(1 << 8 * n) - 1}L) | {n << 56}L")
    before = lambda n: F.expr(f"shiftright(key & {(1 << 8 * n) - 1}L, 8) | {(n - 1) << 56}L")
    asked = [F.struct(F.lit(n).alias("n"), F.lit(False).alias("context"), suffix(n).alias("at")) for n in range(1, order)]
    asked += [F.struct(F.lit(n).alias("n"), F.lit(True).alias("context"), before(n).alias("at")) for n in range(2, order + 1)]
    rest = first.where("logp is null").select("key", F.explode(F.array(*asked)).alias("q")).select("key", "q.*")
    found = rest.join(model.select(F.col("key").alias("at"), "logp", "bow"), "at", "left")
    one = lambda n, context, value: F.max(F.when((F.col("n") == n) & (F.col("context") == context), F.col(value)))
    found = found.groupBy("key").agg(*[one(n, False, "logp").alias(f"p{n}") for n in range(1, order)], *[one(n, True, "bow").alias(f"b{n}") for n in range(2, order + 1)])
    logp = F.coalesce("p1", F.lit(UNSEEN)) if order > 1 else F.lit(UNSEEN)
    for n in range(2, order):
        logp = F.coalesce(F.col(f"p{n}"), F.coalesce(f"b{n}", F.lit(0.0)) + logp)
    logp = F.coalesce(f"b{order}", F.lit(0.0)) + logp if order > 1 else logp
    return first.where("logp is not null").union(found.select("key", logp.alias("logp")))


def scored(docs: DataFrame, model: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``total``, the log probability of its column ``body`` (binary, first in order), and ``n_bytes`` in its place.

    A byte's log probability follows from the n-gram that ends there. Chunks of
    text give their distinct n-grams; those of the whole table are scored once
    by joins with the model, and go back to the chunks that hold them. So the
    model is neither collected nor broadcast, each n-gram is sent once for each
    chunk, and texts are moved once. ``docs`` must be a scan, or a projection
    of one: it is read twice and must come in the same rows and partitions;
    otherwise this fails rather than give a wrong sum.
    """
    grams = stored(docs.select("body").mapInArrow(_grams(order, chunk), "chunk long, key long"), "grams")
    known = stored(_known(grams.select("key").distinct(), model, order).select("key", F.col("logp").cast("float").alias("logp")), "scores")
    side = F.broadcast(known) if known.count() <= BROADCAST_GRAMS else known
    scores = grams.join(side, "key").select("chunk", "key", "logp")
    packs = docs.mapInArrow(_packs(chunk), "chunk long, pack binary")
    kind = StructType([StructField("n_bytes", LongType()), *docs.schema.fields[1:], StructField("total", DoubleType())])
    out = stored(packs.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInArrow(_summed(order), kind), "totals")
    discard(grams, known)
    return out


def quality(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, allowance: float = ALLOWANCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, trusted, kept): one row per row of ``docs``.

    ``trusted`` holds the ids (``doc_id``) of texts to learn from. Four fifths
    of them train the model; the rest give each language its threshold: the
    perplexity per byte that ``quantile`` of them do not exceed, times
    ``slack``. A language's quantile is drawn towards that of all languages
    with the weight of ENOUGH documents; one without held-out texts, and null,
    have the latter. A document is kept if its surprise, in nats, is at most
    that of the threshold at its length plus ``allowance``. A null or empty
    text has no perplexity and is not kept; without trusted texts there is no
    threshold and every other text is kept. Repeated ids stay repeated rows
    (trusted ids count once); other columns are ignored.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().withColumn("trusted", F.lit(True))
    few = ids.count() <= BROADCAST_LABELS
    base = docs.select(raw(text_col).alias("body"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    base = base.join(F.broadcast(ids) if few else ids, base["doc_id"] == ids["_id"], "left").select("body", "doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    if not few:
        base = stored(base, "labelled")  # scored() reads it twice
    held = F.col("trusted") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    model = trained(base.where(F.col("trusted") & ~held), order)
    found = scored(base, model, order).withColumn("nats", F.when(F.col("n_bytes") > 0, -F.col("total") / F.col("n_bytes")))
    discard(model, base)
    # counts of values in steps of 1/STEPS nat: however many documents, what meets in one task is bounded
    tested = found.where(held & F.col("nats").isNotNull()).groupBy("lang", F.ceil(F.col("nats") * STEPS).alias("at")).agg(F.count("*").alias("n"))
    cut = F.percentile("at", F.lit(quantile), F.col("n"))
    common = tested.agg(cut.alias("at")).first()["at"]
    limit = F.lit(None).cast("double")
    if common is not None:
        own = tested.where("lang is not null").groupBy("lang").agg(cut.alias("at"), F.sum("n").alias("n"))
        drawn = own.select(F.col("lang").alias("_lang"), ((F.col("n") * F.col("at") + ENOUGH * common) / (F.col("n") + ENOUGH)).alias("_at"))
        found = found.join(F.broadcast(drawn), F.col("lang") == F.col("_lang"), "left")  # a row a language
        limit = F.exp(F.coalesce("_at", F.lit(common)) / STEPS) * slack
    out = found.withColumn("perplexity", F.exp("nats")).withColumn("threshold", limit)
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "trusted", (F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("nats") * F.col("n_bytes") <= F.log("threshold") * F.col("n_bytes") + allowance))).alias("kept"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by a model of those that ``labels`` call good."""
    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels").where("quality = 1"))
