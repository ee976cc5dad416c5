"""Corpus preparation: language ID, near-dedup, substring dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet in the shared folder and reads it back for the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm import langid, neardup, packing, secrets, substrings
from velaspan.llm.workspace import discard, documents, hidden, small_batches, stored

#: Words of a passage that is removed when it repeats.
WINDOW = 50
#: Share of a text that one language must have.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which one language has LEAST_SHARE or more, and write it into ``lang``.

    Learns from four fifths of the rows that name a language. A document
    without letters, or null, or whose languages are mixed beyond that share,
    is rejected; where no row names a language, so is every document.
    """
    small_batches(spark)
    model = langid.trained(docs.where(~langid.held_out()))
    own, names, of = hidden(docs, "doc_id", "text", "lang")
    rest = [c for c in names if c != of["doc_id"]]
    got = langid.identified(own, model, keep=tuple(rest), id_col=of["doc_id"], text_col=of["text"]).where(F.col("score") >= LEAST_SHARE)
    now = {of["doc_id"]: "doc_id", of["lang"]: "lang_pred"}
    return got.select(*[F.col(now.get(c, c)).alias(c) for c in names]).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (five-word shingles, similarity 0.8): the one with the least id, null last.

    Groups are of rows, not of ids, so repeated rows and rows without an id are
    copies like any others. Rows are numbered once, in a stored table.
    """
    small_batches(spark)
    own, names, of = hidden(docs, "doc_id", "text")
    rows = stored(own.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows, id_col="_row", text_col=of["text"]).select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col(of["doc_id"]).alias("_id"), F.xxhash64(of["text"]).alias("_hash"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "_row"))
    kept = stored(groups.join(ids, "_row").groupBy("component_id").agg(first.alias("first")).select("first._row"), "kept")
    side = F.broadcast(kept) if kept.count() <= neardup.BROADCAST_IDS else kept
    return rows.join(side, "_row", "left_semi").select(*names).toDF(*docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` again, after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of WINDOW or more words that stand anywhere else out of the texts; texts left without words go."""
    small_batches(spark)
    got = substrings.removed(docs, WINDOW)
    own, names, _ = hidden(got)
    return _counted(own.where(f"{names[-2]} > 0 or {names[-1]} = 0").select(*names[:-2]).toDF(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark."""
    return _counted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, in sequences of at most 4096."""
    import public_tokenizers

    small_batches(spark)
    own = docs.withColumn("_loss_share", packing.loss_share())
    return packing.packed(own, public_tokenizers.path("word_bpe_49k.json"), segments=packing.SEGMENTS, loss=packing.LOSS, slack=packing.SLACK, loss_share="_loss_share")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: No SQL can express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole of ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
