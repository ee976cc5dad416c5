"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm import kernels as K
from velaspan.llm.components import components
from velaspan.llm.workspace import discard, documents, raw, stored

#: Shingles of one block of a bucket; a pair of blocks is compared in one task.
BLOCK_SHINGLES = 1_000_000
#: Up to so many document ids (about 90 bytes each as Spark broadcasts them) are sent to every task to pick out texts; more are joined by a shuffle.
BROADCAST_IDS = 300_000


def _features(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in K.slices(batch.column(1)):
                at, items = K.shingle_sets(K.Words(data, offsets), k)
                n = np.diff(at)
                sig = K.superminhash(at, items, bands * rows).reshape(-1, bands, rows)
                key = np.zeros(sig.shape[:2], np.uint64)
                for j in range(rows):
                    key = K.mix(key * K.U(0x9E3779B97F4A7C15) + sig[:, :, j])
                digest = np.zeros((len(n), 2), np.uint64)
                owner = np.repeat(np.arange(len(n)), n)
                for j in range(2):
                    np.add.at(digest[:, j], owner, K.mix(items + K.U(j + 11)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n.astype(np.int64)),
                        pa.array(digest[:, 0].view(np.int64)),
                        pa.array(digest[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "d0", "d1", "keys"],
                )

    return run


def _verified(k: int, percent: int):
    """Check pairs of whole texts: 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sets = []
            for c in (2, 3):
                own = []
                for _, _, data, offsets in K.slices(batch.column(c)):
                    at, items = K.shingle_sets(K.Words(data, offsets), k)
                    own += [items[at[i] : at[i + 1]] for i in range(len(at) - 1)]
                sets.append(own)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def _block(k: int, percent: int):
    """Links between different components among the members of one bucket (or of two of its blocks).

    An inverted index of the members' shingles gives one member's overlap with
    all others at once; members that are joined already are not looked at
    again. Only the links that join something are returned, so a group of n
    members gives fewer than n rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        K.give_back()  # what the last group took
        group = group.drop_duplicates("doc_id").sort_values("doc_id")
        ids, comps = group["doc_id"].to_numpy(), group["component"].to_numpy()
        sets = []
        for _, _, data, offsets in K.slices(pa.array(group["body"], pa.binary())):
            at, items = K.shingle_sets(K.Words(data, offsets), k)
            sets += [items[at[i] : at[i + 1]] for i in range(len(at) - 1)]
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        _, label = np.unique(comps, return_inverse=True)
        out: list[tuple[int, int]] = []
        for i in np.argsort(-np.bincount(label)[label], kind="stable")[::-1]:  # small components first
            if (label == label[i]).all():
                continue
            lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
            n = hi - lo
            spots = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[spots], minlength=len(ids))
            for j in np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (label != label[i])):
                if label[j] != label[i]:
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by word-shingle overlap.

    A document's set holds the distinct k-word shingles of its text, A-Z folded
    (fewer words: the whole sequence; null or wordless: empty and alone). Two
    documents are linked when ``100 * |A and B| >= percent * |A or B|``; groups
    are the connected components, named by their least id.

    1. One pass over the texts makes set sizes, set digests and SuperMinHash
       band keys. Documents with equal sets become one class, by a
       pre-aggregated minimum; only class representatives go on.
    2. In each band bucket every member is checked against the bucket's least
       member (a star, never all pairs), on full sets.
    3. Buckets that still hold several components have the rest of their
       members compared exactly, in blocks of bounded size; equal buckets of
       several bands are compared once. Buckets that are settled stop here.
    4. Union-find over all verified links.

    At the default bands a link at 80 % misses every band with a probability
    of 5e-5, one at 85 % with 4e-7; nothing else loses a link. Sets are equal
    if their sizes and two 64-bit digests are. Repeated ids give repeated rows;
    if their texts differ, the id has the links of each, and each row the
    group of its own text. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body"))
    found = stored(base.mapInArrow(_features(k, bands, rows), "doc_id long, n_shingles long, d0 long, d1 long, keys array<long>"), "features")
    sized = found.where("n_shingles > 0")
    classes = sized.groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"))
    member = classes.select("rep", "n_shingles", F.posexplode("keys").alias("band", "key"))
    pivots = member.groupBy("band", "key").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    member = stored(member.join(pivots, ["band", "key"]), "buckets")

    needed = member.select(F.col("rep").alias("doc_id")).distinct()
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = stored(base.join(needed, "doc_id", "left_semi"), "shortlist")

    def check(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("body").alias("x")), "a")
        right = left.join(texts.select(F.col("doc_id").alias("b"), F.col("body").alias("y")), "b")
        return right.select("a", "b", "x", "y").mapInArrow(_verified(k, percent), "a long, b long")

    star = stored(check(member.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()), "links")
    grouped = stored(components(star), "components")
    placed = member.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = placed.where("rep <> pivot")
    busy = rest.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum("n_shingles").alias("weight"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("lo <> hi")
    once = busy.groupBy("m", "weight", "who").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    cells = (
        rest.join(once, ["band", "key"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("rep").alias("doc_id"), "component", "band", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    late = stored(cells.join(texts, "doc_id").groupBy("band", "key", "p", "q").applyInPandas(_block(k, percent), "a long, b long"), "links")
    final = components(star.union(late))
    discard(member, texts, star, grouped, late)  # what follows reads the features and the last components
    final = final.select(F.col("node").alias("rep"), "component")
    by_doc = sized.select("doc_id", "n_shingles", "d0", "d1").join(classes.select("n_shingles", "d0", "d1", "rep"), ["n_shingles", "d0", "d1"])
    out = by_doc.join(final, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.expr("component_id <=> doc_id"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles at 85 of 100 over the whole of ``documents``."""
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85)
