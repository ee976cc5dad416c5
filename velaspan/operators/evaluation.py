"""Exact-match evaluation of span predictions, character coverage, and threshold sweeps.

Tables: ``messages`` (id, idx, sender, text); ``gold`` and ``pred`` (id, idx,
start, end, type); ``outcomes`` (id, state, error) with one row for each
conversation that a prediction exists for. A failed or missing prediction is
not a negative: it leaves every denominator and is listed apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velaspan.operators.spans import invalid_spans

SPAN = ("id", "idx", "start", "end", "type")
# The senders and prediction states of the format.
SENDERS = ("Utente", "Agente")
OK, FAILED = "ok", "errore"


def with_scores(df: DataFrame, zero: bool = False) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; undefined ones are null, or 0 with ``zero``."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    wrap = (lambda c: F.coalesce(c, F.lit(0.0))) if zero else (lambda c: c)
    return df.withColumns({"precision": wrap(F.try_divide(tp, tp + fp)), "recall": wrap(F.try_divide(tp, tp + fn)), "f1": wrap(F.try_divide(2 * tp, 2 * tp + fp + fn))})


def compared(gold: DataFrame, pred: DataFrame, keys: Sequence[str] = SPAN) -> DataFrame:
    """Distinct spans of both sides with ``outcome``: tp, fp or fn. One aggregation by the span's key, with partial sums before the shuffle."""
    both = gold.select(*keys, F.lit(True).alias("_g"), F.lit(False).alias("_p")).union(pred.select(*keys, F.lit(False), F.lit(True)))
    outcome = F.when(F.bool_and("_g"), "fn").when(F.bool_and("_p"), "fp").otherwise("tp")
    return both.groupBy(*keys).agg(outcome.alias("outcome"))


def counted(outcomes: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn of compared spans, by columns or over all."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]
    return outcomes.groupBy(*by).agg(*n)


def always(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row for each of ``values``, with counts of 0 where ``df`` has none."""
    frame = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    return frame.join(df, column, "left").na.fill(0)


def id_problems(messages: DataFrame, gold_ids: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, problem): ids that are empty, repeated, or not the same in inputs, gold and predictions."""
    inputs = messages.select("id").distinct()
    bad = inputs.where("id is null or id = ''").select("id", F.lit("empty id").alias("problem"))
    twice = outcomes.groupBy("id").count().where("count > 1").select("id", F.lit("repeated prediction").alias("problem"))
    return (
        bad.union(twice)
        .union(gold_ids.groupBy("id").count().where("count > 1").select("id", F.lit("repeated gold").alias("problem")))
        .union(inputs.join(gold_ids, "id", "left_anti").select("id", F.lit("no gold").alias("problem")))
        .union(gold_ids.join(inputs, "id", "left_anti").select("id", F.lit("gold without input").alias("problem")))
        .union(outcomes.join(inputs, "id", "left_anti").select("id", F.lit("prediction without input").alias("problem")))
    )


def technical_failures(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, state, error) of conversations without a usable prediction; state is 'mancante' where there is none."""
    got = messages.select("id").distinct().join(outcomes.select("id", "state", "error"), "id", "left")
    return got.where(f"state is null or state = '{FAILED}'").select("id", F.coalesce("state", F.lit("mancante")).alias("state"), "error")


class Evaluation:
    """Everything that the evaluation of one model reports, over conversations whose prediction is usable. Each report is planned when it is asked for."""

    def __init__(self, messages: DataFrame, gold: DataFrame, pred: DataFrame, outcomes: DataFrame, types: Sequence[str], focus: Sequence[str]):
        self._messages, self._gold, self._pred, self._outcomes, self._types, self._focus = messages, gold, pred, outcomes, types, focus

    @cached_property
    def _usable(self) -> DataFrame:
        return self._outcomes.where(f"state = '{OK}'").select("id").distinct()

    @cached_property
    def spans(self) -> DataFrame:
        """Compared spans with ``outcome``."""
        return compared(self._gold, self._pred).join(self._usable, "id", "left_semi").select(*SPAN, "outcome")

    @cached_property
    def micro(self) -> DataFrame:
        return with_scores(counted(self.spans))

    @cached_property
    def by_type(self) -> DataFrame:
        return with_scores(always(counted(self.spans, "type"), "type", sorted(self._types)))

    @cached_property
    def by_role(self) -> DataFrame:
        senders = self._messages.join(self._usable, "id", "left_semi").select("id", "idx", "sender")
        rows = counted(self.spans, "id", "idx").join(senders, ["id", "idx"]).groupBy("sender").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        return with_scores(always(rows, "sender", SENDERS))

    @cached_property
    def focus(self) -> DataFrame | None:
        return with_scores(counted(self.spans.where(F.col("type").isin(*self._focus)))) if self._focus else None

    @cached_property
    def _characters(self) -> DataFrame:
        return conversation_characters(self._messages.join(self._usable, "id", "left_semi"), self.spans)

    @cached_property
    def characters(self) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("expected", "covered", "uncovered", "overmasked", "other")]
        return self._characters.agg(*sums).withColumn("coverage", F.try_divide("covered", "expected"))

    @cached_property
    def conversations(self) -> DataFrame:
        return flags(self._characters)

    @cached_property
    def errors(self) -> DataFrame:
        return error_list(self.spans)

    @cached_property
    def failures(self) -> DataFrame:
        return technical_failures(self._messages, self._outcomes)


def conversation_characters(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """By conversation: expected, covered, uncovered, overmasked and other characters; types do not matter.

    ``outcomes`` are compared spans. Each side is free of overlaps within a
    message, so lengths add up; what both sides cover is their sum less the
    union, which one pass along a message's sorted spans gives. No position is
    ever expanded and no pair of spans is made.
    """
    size = messages.groupBy("id").agg(F.sum(F.length("text")).alias("total"))
    long = lambda *kinds: F.coalesce(F.sum(F.when(F.col("outcome").isin(*kinds), F.col("end") - F.col("start"))), F.lit(0))
    own = outcomes.groupBy("id", "idx").agg(long("tp", "fn").alias("expected"), long("tp", "fp").alias("predicted"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    union = F.aggregate(
        "_s",
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("total")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"].cast("long")).alias("upto"), (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("total")),
        lambda acc: acc["total"],
    )
    sums = own.withColumn("covered", F.col("expected") + F.col("predicted") - union).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("expected", "predicted", "covered")])
    out = size.join(sums, "id", "left").na.fill(0)
    return out.select("id", "expected", "covered", (F.col("expected") - F.col("covered")).alias("uncovered"), (F.col("predicted") - F.col("covered")).alias("overmasked"), (F.col("total") - F.col("expected")).alias("other"), "predicted")


def flags(characters: DataFrame) -> DataFrame:
    """One row: conversations evaluated, with omitted characters, with expected data, negative, negative with predictions."""
    return characters.agg(
        F.count("*").alias("evaluated"),
        F.count_if(F.col("uncovered") > 0).alias("with_omissions"),
        F.count_if(F.col("expected") > 0).alias("with_expected"),
        F.count_if(F.col("expected") == 0).alias("negative"),
        F.count_if((F.col("expected") == 0) & (F.col("predicted") > 0)).alias("negative_with_fp"),
    )


def error_list(outcomes: DataFrame) -> DataFrame:
    """(id, fp, fn): sorted spans of each conversation that has a wrong one."""
    wrong = outcomes.where("outcome <> 'tp'")
    span = F.struct("idx", "start", "end", "type")
    pick = lambda o: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, span))).alias(o)
    return wrong.groupBy("id").agg(pick("fp"), pick("fn"))


def problems(messages: DataFrame, gold: DataFrame, gold_ids: DataFrame, pred: DataFrame, outcomes: DataFrame, types: Sequence[str]) -> DataFrame:
    """(id, problem): all that makes an evaluation invalid. None of it is a matter of scores, so none may be left out silently.

    Ids that do not fit; inputs that repeat, have no messages, or one with a bad
    sender or without text; states that are neither ok nor errore; failures
    without a reason or with spans; and spans of either side that are invalid.
    """
    bad = lambda df, why: df.select("id", F.lit(why).alias("problem"))
    twice = messages.where("idx is not null").groupBy("id", "idx").count().where("count > 1").select("id").distinct()
    message = messages.where(F.col("idx").isNotNull() & (~F.coalesce(F.col("sender").isin(*SENDERS), F.lit(False)) | F.col("text").isNull())).select("id").distinct()
    failed = outcomes.where(f"state = '{FAILED}'")
    out = id_problems(messages, gold_ids, outcomes)
    out = out.union(bad(twice, "repeated input")).union(bad(messages.where("idx is null").select("id").distinct(), "no messages")).union(bad(message, "message"))
    out = out.union(bad(outcomes.where(f"state is null or state not in ('{OK}', '{FAILED}')"), "state"))
    out = out.union(bad(failed.where("trim(coalesce(error, '')) = ''"), "failure without a reason")).union(bad(pred.join(failed, "id", "left_semi").select("id").distinct(), "failure with spans"))
    usable = pred.join(outcomes.where(f"state = '{OK}'"), "id", "left_semi")
    for side, spans in (("gold", gold), ("prediction", usable)):
        out = out.union(invalid_spans(spans, messages, types).select("id", F.concat(F.lit(f"{side}: "), "reason").alias("problem")).distinct())
    return out


def require(problems_: DataFrame, messages: DataFrame) -> None:
    """Raise ValueError if there are no inputs, or if there is any problem; the first ten are named."""
    if messages.isEmpty():
        raise ValueError("no inputs")
    if found := [f"{r['id']}: {r['problem']}" for r in problems_.orderBy("id", "problem").limit(10).collect()]:
        raise ValueError("invalid evaluation: " + "; ".join(found))


def evaluate(messages: DataFrame, gold: DataFrame, pred: DataFrame, outcomes: DataFrame, types: Sequence[str], focus: Sequence[str] = (), gold_ids: DataFrame | None = None) -> Evaluation:
    """The reports of one model.

    With ``gold_ids`` (id of each conversation that gold exists for), inputs are
    checked first and any of :func:`problems` raises ValueError; without, the
    caller has checked them and nothing runs here.
    """
    if not types or set(focus) - set(types):
        raise ValueError("types must not be empty, and must hold the focus types")
    if gold_ids is not None:
        require(problems(messages, gold, gold_ids, pred, outcomes, types), messages)
    return Evaluation(messages, gold, pred, outcomes, types, focus)


def threshold_sweep(gold: DataFrame, scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, scores): spans at or above each threshold.

    ``scored`` has ``score``. A span's outcome does not depend on the
    threshold, so one join is enough: a span counts for all thresholds up to
    its score, and gold spans below it are missed.
    """
    keyed = scored.groupBy(*SPAN).agg(F.max("score").alias("score"))
    g = gold.select(*SPAN).distinct().withColumn("_g", F.lit(True))
    both = g.join(keyed, list(SPAN), "full_outer").select(F.coalesce("_g", F.lit(False)).alias("gold"), "score")
    sums: list[Column] = []
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.col("score") >= t, F.lit(False))
        sums += [F.count_if(F.col("gold") & hit).alias(f"tp{i}"), F.count_if(~F.col("gold") & hit).alias(f"fp{i}"), F.count_if(F.col("gold") & ~hit).alias(f"fn{i}")]
    wide = both.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{o}{i}").alias(o) for o in ("tp", "fp", "fn")]) for i, t in enumerate(thresholds)]))
    return with_scores(wide.select(rows.alias("r")).select("r.*"))


def frequent_false_positives(outcomes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The k most frequent texts of false positives, ties by text; ``texts`` has the span key and ``value``."""
    fp = outcomes.where("outcome = 'fp'").join(texts, list(SPAN))
    return fp.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
