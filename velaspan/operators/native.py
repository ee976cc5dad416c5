"""From a model's native entities to spans and detections of the common format.

``native``: (id, idx, ord, label, start, end, score) with ``ord`` the order in
the model's answer. Checks come in a fixed order: unknown labels and bad bounds
are errors; then content bounds; empty content counts as ignored before a
label without a target does; last the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velaspan.functions import text as T
from velaspan.operators.matching import TYPES, by_score, greedy
from velaspan.operators.spans import adjacent_merged

EMPTY = ":span_vuoto"


@dataclass(frozen=True)
class Model:
    """How a model's labels map to types (None: ignored), its threshold, and what it merges."""

    name: str
    labels: Mapping[str, str | None]
    threshold: float = 0.0
    merge_types: Sequence[str] = ()
    merge_native: Sequence[tuple[str, str]] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        import re

        if not re.fullmatch(r"[a-z0-9_]+", self.name) or not self.labels:
            raise ValueError("a model needs a plain name and labels")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie between 0 and 1")
        if any(t is not None and t not in TYPES for t in self.labels.values()) or any(x not in self.labels for p in self.merge_native for x in p):
            raise ValueError("labels map to unknown types, or pairs name unknown labels")


def models_from(config: Mapping) -> list[Model]:
    """Models of an experiment configuration; names must be unique."""
    out = [Model(m["nome"], m["etichette"], m["soglia"], tuple(m["unisci_adiacenti"]), tuple(map(tuple, m.get("unisci_sequenze_native", ())))) for m in config["modelli"]]
    if not out or len({m.name for m in out}) != len(out):
        raise ValueError("no models, or a repeated name")
    return out


def zero_shot(results: DataFrame, column: str = "entities") -> DataFrame:
    """Flatten map<label, array<struct<start,end,confidence>>> to native rows; a missing confidence is 1."""
    rest = [c for c in results.columns if c != column]
    # numbered over all labels: the order of the model's answer decides between equals
    every = F.flatten(F.transform(F.map_entries(column), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("label"), x.alias("e")))))
    one = results.select(*rest, F.posexplode_outer(every).alias("ord", "_x")).where("_x is not null")
    return one.select(*rest, F.col("_x.label").alias("label"), "ord", F.col("_x.e.start").alias("start"), F.col("_x.e.end").alias("end"), F.coalesce(F.col("_x.e.confidence").cast("double"), F.lit(1.0)).alias("score"))


def judged(native: DataFrame, messages: DataFrame, model: Model) -> DataFrame:
    """Native rows with ``type``, content bounds and text, and ``fate``: error, ignored, below or kept; and ``ignored_as``.

    Entities are gathered by message, so that each text is joined once.
    """
    table = F.create_map(*[F.lit(x) for k, v in model.labels.items() for x in (k, v or "")])
    own = native.groupBy("id", "idx").agg(F.collect_list(F.struct("ord", "label", "start", "end", "score")).alias("_l"))
    got = own.join(messages.select("id", "idx", F.col("text").alias("_m")), ["id", "idx"], "left")

    def one(x: Column) -> Column:
        bounds = (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("_m"))
        finite = x["score"].isNotNull() & ~F.isnan(x["score"]) & (F.abs(x["score"]) < float("inf"))
        fine = F.coalesce(F.map_contains_key(table, x["label"]) & bounds & finite, F.lit(False))
        lo, hi = T.trimmed(F.col("_m"), x["start"], x["end"])
        kind = F.nullif(F.try_element_at(table, x["label"]), F.lit(""))
        fate = F.when(~fine, "error").when((lo >= hi) | kind.isNull(), "ignored").when(x["score"] < model.threshold, "below").otherwise("kept")
        named = F.when(fine & (lo >= hi), F.concat(x["label"], F.lit(EMPTY))).when(fine & kind.isNull(), x["label"])
        return F.struct(
            x["ord"].alias("ord"), x["label"].alias("label"), F.when(fine, lo).alias("start"), F.when(fine, hi).alias("end"), x["score"].alias("score"),
            kind.alias("type"), fate.alias("fate"), named.alias("ignored_as"), F.when(fine, T.slice_of(F.col("_m"), lo, hi)).alias("text"),
        )

    return got.select("id", "idx", F.explode(F.transform("_l", one)).alias("r")).select("id", "idx", "r.*")


def ignored_labels(rows: DataFrame) -> DataFrame:
    """(label, n): how often entities were left out, by label."""
    return rows.where("fate = 'ignored'").groupBy(F.col("ignored_as").alias("label")).agg(F.count("*").alias("n"))


def detections(rows: DataFrame, model: Model) -> DataFrame:
    """All kept entities as detections, overlaps included, with their source."""
    source = F.struct(F.lit("ner").alias("detector"), F.lit(model.name).alias("name"), F.col("label").alias("native_type"), "score")
    return rows.where("fate = 'kept'").select("id", T.field_of(F.col("idx")).alias("field"), "start", "end", "text", "type", F.array(source).alias("sources"), "ord")


def normalised(rows: DataFrame, messages: DataFrame, model: Model, types: Sequence[str] | None = None) -> DataFrame:
    """Overlap-free spans of each message, by score, with neighbours merged as the model asks."""
    packed = F.struct("start", "end", "type", "score", F.col("label").alias("native"), "ord")
    chosen = rows.where("fate = 'kept'").groupBy("id", "idx").agg(F.collect_list(packed).alias("s")).select("id", "idx", F.explode(greedy(F.col("s"), by_score)).alias("s")).select("id", "idx", "s.*")
    out = adjacent_merged(chosen, messages, model.merge_types, model.merge_native)
    return out.where(F.col("type").isin(*types)) if types else out


def inferred(messages: DataFrame, load: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Native rows of an injected model, and ``error`` rows where it fails on a message.

    ``load`` runs once in each task and returns a function from a text to
    entities (label or entity_group, start, end, score). Blank texts are not
    sent to it. A failure marks its conversation, not the run.
    """
    kind = "id string, idx int, ord int, label string, start int, end int, score double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = load()
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples():
                if not (r.text or "").strip():
                    continue
                try:
                    found = infer(r.text)
                    rows += [(r.id, r.idx, i, e.get("entity_group", e.get("label")), int(e["start"]), int(e["end"]), float(e["score"]), None) for i, e in enumerate(found)]
                except Exception as error:  # noqa: BLE001  the model is foreign code
                    rows.append((r.id, r.idx, 0, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["id", "idx", "ord", "label", "start", "end", "score", "error"]).astype({"idx": "Int32", "ord": "Int32", "start": "Int32", "end": "Int32", "score": "Float64"})

    return messages.select("id", "idx", "text").mapInPandas(run, kind)


def prediction_states(messages: DataFrame, native: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, state, error): a conversation fails as a whole if inference or any entity of it does."""
    broken = native.where("error is not null").select("id", "error").union(rows.where("fate = 'error'").select("id", F.concat(F.lit("invalid entity: "), F.coalesce("label", F.lit("null"))).alias("error")))
    first: Column = F.min("error").alias("error")
    bad = broken.groupBy("id").agg(first)
    return messages.select("id").distinct().join(bad, "id", "left").select("id", F.when(F.col("error").isNull(), "ok").otherwise("errore").alias("state"), "error")
