"""Dataset export with provenance: inputs, gold, adapters, exclusions and manifest; and reuse of stored answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velaspan.functions import text as T
from velaspan.operators.evaluation import SENDERS
from velaspan.operators.matching import MASKING_TYPES, TYPES
from velaspan.sources.tables import write_json_lines

# The types of the NER view, and the states of records.
NER_TYPES = ("PERSON", "LOCATION")
VALID = "valido"
STATES = ("valido", "da_verificare", "errore_api")


@dataclass
class Export:
    """Tables of an export, all lazy."""

    inputs: DataFrame
    detections: DataFrame
    adapter: DataFrame
    ner: DataFrame
    provenance: DataFrame
    excluded: DataFrame
    manifest: DataFrame

    def write(self, path: str) -> None:
        """One new folder a table; none may exist."""
        for name in ("inputs", "detections", "adapter", "ner", "provenance", "excluded", "manifest"):
            write_json_lines(getattr(self, name), f"{path.rstrip('/')}/{name}")


def qualified(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with ``key``, the source's hash and the record's id. ``records``: source_path, id; ``sources``: path, sha256."""
    return records.join(sources.select(F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256")), "source_path").withColumn("key", F.concat_ws(":", "source_sha256", "id"))


def source_problems(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(what, problem): sources with the same bytes, and ids that a source has twice."""
    same = sources.groupBy("sha256").count().where("count > 1").select(F.col("sha256").alias("what"), F.lit("repeated source").alias("problem"))
    return same.union(records.groupBy("key").count().where("count > 1").select(F.col("key").alias("what"), F.lit("repeated id").alias("problem")))


def record_error(types: Sequence[str] = TYPES) -> Column:
    """Why a record can't be exported, or null; over state, messages (sender, text) and detections (field, start, end, text, type, sources)."""
    good_message = lambda m: m["sender"].isin(*SENDERS) & (F.trim(F.coalesce(m["text"], F.lit(""))) != "")

    def good(d):
        i = T.message_index(d["field"])
        text = F.get("messages", i)["text"]
        fits = (d["start"] >= 0) & (d["start"] < d["end"]) & (d["end"] <= F.length(text)) & (T.slice_of(text, d["start"], d["end"]) == d["text"])
        return F.coalesce(i.isNotNull() & (i < F.size("messages")) & fits & d["type"].isin(*types) & (F.size(d["sources"]) > 0), F.lit(False))

    return (
        F.when(~F.coalesce(F.col("state") == VALID, F.lit(False)), "state")
        .when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "no messages")
        .when(~F.forall("messages", lambda m: F.coalesce(good_message(m), F.lit(False))), "message")
        .when(F.col("detections").isNull(), "no detections")
        .when(~F.forall("detections", good), "detection")
    )


def exported(records: DataFrame, version: str = "detection-5.0", nested: DataFrame | None = None) -> Export:
    """Split records into model inputs, gold and the older flat view; those with an error go to ``excluded``.

    ``records``: key, id, source_sha256, state, messages, detections.
    ``nested`` (key, and the columns of a detection) are LOCATION views of
    addresses; the flat view leaves them out.
    """
    judged = records.withColumn("reason", record_error())
    good, bad = judged.where("reason is null"), judged.where("reason is not null")
    trace = ["key", "id", "source_sha256", "state"]
    inputs = good.select(F.col("key").alias("id"), F.transform("messages", lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("testo"))).alias("conversazione"))
    one = good.select("key", F.inline("detections"))
    every = one.withColumn("nested", F.lit(False))
    if nested is not None:
        every = every.unionByName(nested.join(good.select("key"), "key", "left_semi").withColumn("nested", F.lit(True)), allowMissingColumns=True)
    flat = F.struct(F.col("field").alias("campo"), "start", "end", F.col("type").alias("tipo"), F.col("text").alias("testo"))

    def lists(rows: DataFrame, item, name: str) -> DataFrame:
        order = F.struct("field", "start", "end", "type")
        got = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("v")))).alias("_l"))
        full = good.select("key").join(got, "key", "left")
        values = F.transform("_l", lambda x: x["v"])
        kind = full.select(values.alias("v")).schema["v"].dataType.simpleString()
        return full.select(F.col("key").alias("id"), F.coalesce(values, F.from_json(F.lit("[]"), kind)).alias(name))

    detection = F.struct(*[c for c in every.columns if c not in ("key", "nested")])
    roles = every.join(good.select("key", "messages"), "key").select(F.get("messages", T.message_index(F.col("field")))["sender"].alias("role"))
    totals = judged.agg(F.count("*").alias("records"), F.count_if(F.col("reason").isNull()).alias("exported"), F.count_if(F.col("reason").isNotNull()).alias("excluded"))
    by_type = every.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"))
    by_role = roles.groupBy("role").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
    negative = good.join(every.select("key").distinct(), "key", "left_anti").agg(F.count("*").alias("negative"))
    manifest = totals.join(by_type).join(by_role).join(negative).withColumn("version", F.lit(version))  # one row each
    return Export(
        inputs,
        lists(every, detection, "detections"),
        lists(every.where("not nested"), flat, "annotazioni"),
        lists(every.where(F.col("type").isin(*NER_TYPES)), flat, "annotazioni"),
        good.select(*trace),
        bad.select(*trace, "reason"),
        manifest,
    )


@dataclass
class MaskingExport:
    """Tables of an export in the older masking format, all lazy."""

    inputs: DataFrame
    gold: DataFrame
    provenance: DataFrame
    excluded: DataFrame
    manifest: DataFrame

    def write(self, path: str) -> None:
        """One new folder a table; none may exist."""
        for name in ("inputs", "gold", "provenance", "excluded", "manifest"):
            write_json_lines(getattr(self, name), f"{path.rstrip('/')}/{name}")


#: Fields of a masking annotation that lie outside the dialogue and are left out, counted.
OUTSIDE = r"^(metadati\.descrizione|trattamento_atteso\..*)$"


def masking_error() -> Column:
    """Why a record of the older format can't be exported, or null; over state, error, messages and spans."""
    good_message = lambda m: m["sender"].isin(*SENDERS) & (F.trim(F.coalesce(m["text"], F.lit(""))) != "")
    inside = F.filter("spans", lambda s: T.message_index(s["field"]).isNotNull())

    def good(s):
        i = T.message_index(s["field"])
        text = F.get("messages", i)["text"]
        return F.coalesce((i < F.size("messages")) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (T.slice_of(text, s["start"], s["end"]) == s["text"]) & s["type"].isin(*MASKING_TYPES), F.lit(False))

    # sorted by field and start, a span overlaps if it begins before the one before it ends
    ordered = F.array_sort(F.transform(inside, lambda s: F.struct(s["field"].alias("field"), s["start"].alias("start"), s["end"].alias("end"))))
    meets = lambda o: F.exists(F.sequence(F.lit(1), F.greatest(F.size(o), F.lit(1))), lambda i: (i < F.size(o)) & (F.get(o, i)["field"] == F.get(o, i - 1)["field"]) & (F.get(o, i)["start"] < F.get(o, i - 1)["end"]))
    return (
        F.when(~F.coalesce(F.col("state") == VALID, F.lit(False)), F.coalesce("error", F.lit("state")))
        .when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "no messages")
        .when(~F.forall("messages", lambda m: F.coalesce(good_message(m), F.lit(False))), "message")
        .when(F.col("spans").isNull() | F.exists("spans", lambda s: T.message_index(s["field"]).isNull() & ~F.coalesce(s["field"].rlike(OUTSIDE), F.lit(False))), "field")
        .when(~F.forall(inside, good), "span")
        .when(F.exists(F.array(ordered), meets), "overlap")
    )


def masking_exported(records: DataFrame, notes: DataFrame | None = None, version: str = "1.0") -> MaskingExport:
    """Split records of the older format into inputs and gold, with provenance and review notes.

    ``records``: key, id, source_sha256, state, error, messages and spans (field,
    start, end, type, text, ...). ``notes``: sha256, id, note. Spans outside the
    dialogue are left out and counted.
    """
    if notes is None:
        notes = records.sparkSession.createDataFrame([], "sha256 string, id string, note string")
    judged = reviewed(records.withColumn("reason", masking_error()), notes)
    good, bad = judged.where("reason is null"), judged.where("reason is not null")
    trace = ["key", "id", "source_sha256", "state", "review", "notes"]
    own = F.filter("spans", lambda s: T.message_index(s["field"]).isNotNull())
    gold = good.select(F.col("key").alias("id"), own.alias("annotazioni"))
    types = gold.select(F.explode(F.transform("annotazioni", lambda s: s["type"])).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    categories = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("categories"))
    totals = judged.agg(
        F.count("*").alias("records"), F.count_if(F.col("reason").isNull()).alias("exported"), F.count_if(F.col("reason").isNotNull()).alias("excluded"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.size("spans") - F.size(own))), F.lit(0)).alias("left_out"), F.count_if(F.col("reason").isNull() & (F.col("review") == "segnalato")).alias("flagged"),
    )
    inputs = good.select(F.col("key").alias("id"), F.transform("messages", lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("testo"))).alias("conversazione"))
    return MaskingExport(inputs, gold, good.select(*trace), bad.select(*trace, "reason"), totals.join(categories).withColumn("version", F.lit(version)))  # one row each


def reviewed(records: DataFrame, notes: DataFrame) -> DataFrame:
    """Records with review notes of their source: notes has sha256, id, note."""
    own = notes.groupBy(F.col("sha256").alias("source_sha256"), "id").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    got = records.join(own, ["source_sha256", "id"], "left")
    return got.withColumn("review", F.when(F.col("notes").isNull(), "non_revisionato").otherwise("segnalato"))


def stray_notes(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Notes whose source is not exported."""
    return notes.join(sources.select("sha256"), "sha256", "left_anti")


def latest(answers: DataFrame, key: Sequence[str], order: str, usable: str | None = None) -> DataFrame:
    """The last row of each key; a usable one goes before a later one that is not."""
    first = [F.desc(usable)] if usable else []
    w = Window.partitionBy(*key).orderBy(*first, F.desc(order))
    return answers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reusable(prompts: DataFrame, answers: DataFrame, same: Sequence[str], retry_failed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers to reuse, prompts to run, problems).

    An answer fits if its id and all columns of ``same`` (compared as JSON) are
    those of the prompt. Failed or empty fitting answers are problems, unless
    failed ones are retried; so are several different ones for a prompt.
    """
    digest = lambda: F.sha2(F.to_json(F.struct(*same)).cast("binary"), 256)
    fits = answers.withColumn("_d", digest()).join(prompts.select("id", digest().alias("_p")), "id").where("_d = _p").drop("_d", "_p")
    if retry_failed:
        fits = fits.where("state <> 'errore_api'")
    bad = F.when((F.col("state") == "errore_api") | F.coalesce(F.col("answer"), F.lit("")).eqNullSafe(""), "uncertain").when(~F.col("state").isin("valido", "da_verificare"), "unknown state")
    several = fits.groupBy("id").agg(F.count_distinct(F.struct("state", "answer")).alias("n")).where("n > 1").select("id", F.lit("several answers").alias("problem"))
    problems = fits.select("id", bad.alias("problem")).where("problem is not null").union(several).distinct()
    reused = fits.dropDuplicates(["id"])
    return reused, prompts.join(reused.select("id"), "id", "left_anti"), problems


def run_summary(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: prompts, answers, and answers in each state."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return prompts.agg(F.count("*").alias("prompts")).join(answers.agg(F.count("*").alias("answers"), *states))


def selected(prompts: DataFrame, only: str | None = None, head: int | None = None) -> DataFrame:
    """One prompt by its id, or the first ones in the order of ids."""
    if only is not None:
        prompts = prompts.where(F.col("id") == only)
    return prompts if head is None else prompts.orderBy("id").limit(head)


def combined(reused: DataFrame, previous: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers of a run with ``origin``: reused, previous or new; ids that more than one of them has)."""
    every = None
    for origin, rows in (("reused", reused), ("previous", previous), ("new", new)):
        one = rows.withColumn("origin", F.lit(origin))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return every, every.groupBy("id").count().where("count > 1").select("id")


def run_problems(prompts: DataFrame, answers: DataFrame, same: Sequence[str], deployment: str, provider: str) -> DataFrame:
    """(id, problem) of stored answers that don't belong to the run which the prompts describe; none may be counted then.

    Each answer's id must be a prompt's, and come once; columns of ``same`` must
    equal the prompt's, deployment and provider the run's; states must be known.
    """
    other = F.lit(False)
    for c in same:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    got = answers.join(prompts.select("id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in same]), "id", "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown").when(other, "other prompt").when(~F.col("deployment").eqNullSafe(F.lit(deployment)) | ~F.col("provider").eqNullSafe(F.lit(provider)), "other run").when(~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), "state")
    )
    twice = answers.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    return got.select("id", reason.alias("problem")).where("problem is not null").distinct().union(twice)


def uniform(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many different values of the columns there are, and whether there is just one."""
    return records.agg(F.count_distinct(F.to_json(F.struct(*columns))).alias("variants")).withColumn("uniform", F.col("variants") == 1)
