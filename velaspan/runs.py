"""Whole runs: regex predictions, comparison of models, reports, and checks before a run goes on."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.functions import text as T
from velaspan.operators import addresses as A
from velaspan.operators import evaluation as E
from velaspan.operators import export as X
from velaspan.operators import matching as M
from velaspan.operators import native as N
from velaspan.operators import resampling as R
from velaspan.operators import spans as S
from velaspan.sources.tables import file_hashes, json_lines, with_origin


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Messages (id, idx, sender, text) of JSON-lines conversations."""
    rows = json_lines(spark, path, "id string, conversazione array<struct<sender:string,testo:string>>")
    return rows.select("id", F.posexplode_outer("conversazione").alias("idx", "m")).select("id", "idx", F.col("m.sender").alias("sender"), F.col("m.testo").alias("text"))


def flat_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans (id, idx, start, end, type, text) of JSON-lines annotations."""
    rows = json_lines(spark, path, "id string, annotazioni array<struct<campo:string,start:int,end:int,tipo:string,testo:string>>")
    one = rows.select("id", F.explode("annotazioni").alias("a"))
    return one.select("id", T.message_index(F.col("a.campo")).alias("idx"), "a.start", "a.end", F.col("a.tipo").alias("type"), F.col("a.testo").alias("text"))


def gold_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of JSON-lines gold: id, detection_id, field, start, end, text, type, sources, components."""
    source = "struct<detector:string,parent_detection_id:string,component:string>"
    metadata = "struct<reference_id:string,address_variant:string,address_components:map<string,struct<start:int,end:int,text:string>>>"
    rows = json_lines(spark, path, f"id string, detections array<struct<detection_id:string,field:string,start:int,end:int,text:string,type:string,sources:array<{source}>,metadata:{metadata}>>")
    one = rows.select("id", F.inline("detections"))
    return one.withColumn("components", F.col("metadata.address_components")).drop("metadata")


def gold_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of JSON-lines annotations, also of those without spans."""
    return json_lines(spark, path, "id string").select("id")


def prediction_states(spark: SparkSession, path: str) -> DataFrame:
    """(id, state, error) of JSON-lines predictions."""
    return json_lines(spark, path, "id string, stato string, errore string").select("id", F.col("stato").alias("state"), F.col("errore").alias("error"))


@dataclass
class Predictions:
    """Detections (overlaps kept), flat spans, and the state of each conversation."""

    detections: DataFrame
    spans: DataFrame
    outcomes: DataFrame


def predict_regex(messages: DataFrame, rules: Sequence[M.Rule], types: Sequence[str] = M.MASKING_TYPES) -> Predictions:
    """Rules over conversations; one with a bad sender or a missing text fails as a whole and has no spans."""
    bad = messages.groupBy("id").agg(F.bool_or(~F.coalesce(F.col("sender").isin(*E.SENDERS), F.lit(False)) | F.col("text").isNull()).alias("bad"))
    outcomes = bad.select("id", F.when(F.col("bad"), E.FAILED).otherwise(E.OK).alias("state"), F.when(F.col("bad"), "invalid message").alias("error"))
    good = messages.join(bad.where("not bad").select("id"), "id", "left_semi").select("id", "idx", "text")
    order = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)]), F.col("rule"))
    rows = M.detected(good, list(rules))
    source = F.struct(F.lit("regex").alias("detector"), "rule", "priority")
    raw = rows.select("id", T.field_of(F.col("idx")).alias("field"), "start", "end", F.col("value").alias("text"), "type", F.array(source).alias("sources"), order.alias("ord"))
    return Predictions(S.merged(raw), M.resolved(good, list(rules), types=tuple(types)), outcomes)


def predict_model(messages: DataFrame, model: N.Model, load: Callable[[], Callable[[str], list[dict]]], types: Sequence[str] | None = None) -> Predictions:
    """An injected model over conversations, normalised by its configuration."""
    found = N.inferred(messages, load)
    rows = N.judged(found.where("error is null"), messages, model)
    outcomes = N.prediction_states(messages, found, rows)
    usable = outcomes.where(f"state = '{E.OK}'").select("id")
    kept = rows.join(usable, "id", "left_semi")
    return Predictions(S.merged(N.detections(kept, model)), N.normalised(kept, messages, model, types), outcomes)


@dataclass
class Comparison:
    """Reports by model; ``failed`` says why a model has none; ``seconds`` is how long each took, failed or not."""

    reports: dict[str, dict] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def report(evaluation: E.Evaluation) -> dict:
    """An evaluation as plain values. Only aggregates and the lists of errors and failures are collected."""
    one = lambda df: df.first().asDict() if df is not None else None
    by = lambda df, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
    return {
        "span_esatti_micro": one(evaluation.micro),
        "per_tipo": by(evaluation.by_type, "type"),
        "per_ruolo": by(evaluation.by_role, "sender"),
        "focus": one(evaluation.focus),
        "caratteri": one(evaluation.characters),
        "conversazioni": one(evaluation.conversations),
        "fallimenti_tecnici": [r.asDict() for r in evaluation.failures.collect()],
    }


def compare_models(messages: DataFrame, gold: DataFrame, models: Mapping[str, tuple[N.Model, Callable]], types: Sequence[str], focus: Sequence[str] = ()) -> Comparison:
    """Each model over the same conversations and gold. A model that fails does not stop the next one."""
    out = Comparison()
    for name, (model, load) in models.items():
        began = time.perf_counter()
        try:
            p = predict_model(messages, model, load, types)
            out.reports[name] = report(E.evaluate(messages, gold, p.spans, p.outcomes, types, focus))
        except Exception as error:  # noqa: BLE001  a model's failure is its own
            out.failed[name] = f"{type(error).__name__}: {error}"[:500]
        out.seconds[name] = time.perf_counter() - began
    return out


def evaluate_files(spark: SparkSession, inputs: str, gold: str, predictions: str, types: Sequence[str], focus: Sequence[str] = ()) -> dict:
    """The report of one model's predictions, from files; invalid ones raise ValueError."""
    got = E.evaluate(conversations(spark, inputs), flat_spans(spark, gold), flat_spans(spark, predictions), prediction_states(spark, predictions), types, focus, gold_ids(spark, gold))
    return report(got)


def addresses_files(spark: SparkSession, inputs: str, gold: str, predictions: str) -> dict:
    """The address report of one model's predictions, from files."""
    messages, detections, states = conversations(spark, inputs), gold_detections(spark, gold), prediction_states(spark, predictions)
    E.require(E.id_problems(messages, gold_ids(spark, gold), states), messages)
    found = flat_spans(spark, predictions).where("type = 'LOCATION'")
    if not found.where("start is null or end is null or start >= end").isEmpty():
        raise ValueError("invalid predicted span")
    got = A.evaluate_addresses(A.gold_addresses(detections), found.select("id", T.field_of(F.col("idx")).alias("field"), "start", "end"), states, check=True)
    rows = lambda df, *keys: [r.asDict(True) for r in df.orderBy(*keys).collect()]
    return {"full_address": got.totals.first().asDict(), "components": rows(got.components, "name"), "outcomes": {r["outcome"]: r["n"] for r in got.outcomes.collect()}, "technical_failures": rows(got.failures, "id"), "details": rows(got.details.select("id", "address_id", "field", "text", "coverage", "complete", "outcome", "results", "residual_text"), "id", "address_id")}


def bootstrap_files(spark: SparkSession, inputs: str, gold: str, addresses: str, predictions: Mapping[str, str], replicates: int, seed: int, confidence: float) -> dict:
    """Paired bootstrap of several models' predictions over the same conversations; every one of them must be usable."""
    if replicates < 2:
        raise ValueError("two replicates at least")
    messages, expected, parts = conversations(spark, inputs), flat_spans(spark, gold), A.gold_addresses(gold_detections(spark, addresses))
    E.require(E.id_problems(messages, gold_ids(spark, addresses), prediction_states(spark, next(iter(predictions.values())))), messages)
    ids = messages.select("id").distinct()
    outcomes = conversations_ = covered = None
    for model, path in predictions.items():
        states, found = prediction_states(spark, path), flat_spans(spark, path)
        E.require(E.problems(messages, expected, gold_ids(spark, gold), found, states, M.TYPES), messages)
        if not ids.join(states.where(f"state = '{E.OK}'"), "id", "left_anti").isEmpty():
            raise ValueError(f"{model}: every conversation needs a usable prediction")
        name = F.lit(model).alias("model")
        one = E.compared(expected, found).select(name, "id", "type", "outcome")
        places = found.where("type = 'LOCATION'").select("id", T.field_of(F.col("idx")).alias("field"), "start", "end")
        own = A.measured(parts, places).select(name, "id", "expected", "covered", "complete")
        outcomes, conversations_, covered = (b if a is None else a.union(b) for a, b in ((outcomes, one), (conversations_, ids.select(name, "id")), (covered, own)))
    counters = R.units(conversations_, outcomes, covered).persist()
    try:
        values, points = R.replicated(counters, replicates, seed), R.point_estimates(counters)
        summary, differences = R.summary(values, points, ["model", "metric"], confidence), R.differences(values, points, list(predictions), confidence)
        return {"replicates": replicates, "seed": seed, "confidence": confidence, "models": [r.asDict() for r in summary.orderBy("model", "metric").collect()], "paired_differences": [r.asDict() for r in differences.orderBy("first", "second", "metric").collect()], "markdown": R.markdown(summary)}
    finally:
        counters.unpersist()


def records_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Generated records of several JSON-lines sources: key, id, source_sha256, state, error, messages, detections, spans."""
    source = "struct<detector:string,parent_detection_id:string,component:string>"
    detection = f"struct<field:string,start:int,end:int,text:string,type:string,sources:array<{source}>>"
    span = "struct<campo:string,start:int,end:int,tipo:string,id_entita:string,id_forma:string,testo:string,sostituzione:string>"
    chat = f"struct<conversazione:array<struct<sender:string,testo:string>>,trattamento_atteso:struct<mascherare:array<{span}>>>"
    rows = with_origin(json_lines(spark, list(paths), f"id string, stato string, errore string, chat {chat}, detection_attesa array<{detection}>"))
    hashes = file_hashes(spark, list(paths))
    out = X.qualified(rows, hashes)
    if bad := [f"{r['what']}: {r['problem']}" for r in X.source_problems(out, hashes).limit(5).collect()]:
        raise ValueError("; ".join(bad))
    spans = F.transform("chat.trattamento_atteso.mascherare", lambda s: F.struct(s["campo"].alias("field"), s["start"].alias("start"), s["end"].alias("end"), s["tipo"].alias("type"), s["id_entita"].alias("entity_id"), s["id_forma"].alias("form"), s["testo"].alias("text"), s["sostituzione"].alias("substitute")))
    messages = F.transform("chat.conversazione", lambda m: F.struct(m["sender"].alias("sender"), m["testo"].alias("text")))
    return out.select("key", "id", "source_sha256", F.col("stato").alias("state"), F.col("errore").alias("error"), messages.alias("messages"), F.col("detection_attesa").alias("detections"), spans.alias("spans"))


def stale_prompts(prompts: DataFrame, total: int, seed: int, version: str, hashes: Mapping[str, str]) -> list[str]:
    """Why a prompt corpus does not fit its configuration: number, ids, seed, version, and hashes of its sources."""
    row = prompts.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.collect_set("seed").alias("seeds"), F.collect_set("version").alias("versions"), F.count_distinct(F.to_json("hashes")).alias("maps"), F.first("hashes").alias("hashes")).first()
    checks = {"number": row["n"] == total, "ids": row["ids"] == row["n"], "seed": row["seeds"] == [seed], "version": row["versions"] == [version], "uniform": row["maps"] == 1, "sources": row["hashes"] == dict(hashes)}
    return [k for k, ok in checks.items() if not ok]


def resume_differences(plan: Mapping, expected: Mapping) -> list[str]:
    """Fields in which a stored plan differs from what would run now; a slash at the end of an endpoint does not count."""
    same = lambda k, v: v.rstrip("/") if k == "endpoint" and isinstance(v, str) else v
    return [k for k, v in expected.items() if same(k, plan.get(k)) != same(k, v)]


def endpoint(provider: str, explicit: str | None = None, default: str | None = None) -> str:
    """The base URL of a provider: what is given, or its own path on the default resource."""
    from urllib.parse import urlsplit, urlunsplit

    if explicit:
        return explicit.rstrip("/") + "/"
    if not default:
        raise ValueError("an endpoint is needed")
    if provider == "openai":
        return default.rstrip("/") + "/"
    base = urlsplit(default)
    if not base.hostname:
        raise ValueError("the default endpoint is no URL")
    return urlunsplit((base.scheme, base.netloc, f"/{provider}/", "", ""))
