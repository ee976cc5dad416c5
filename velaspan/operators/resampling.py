"""Paired cluster bootstrap over conversations.

Counters are summed once for each (model, conversation). A replicate is a
multiset of conversations, the same for all models, so differences between
models are paired. Replicates are independent: each task draws some of them in
blocks and multiplies their weights with the counters, so neither spans nor
draws are ever shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Scopes and metrics of the report, and those that are compared between models.
SCOPES = ("micro", "PERSON", "LOCATION")
METRICS = tuple(f"{s}.{m}" for s in SCOPES for m in ("precision", "recall", "f1")) + ("address.complete_rate", "address.character_coverage")
COMPARED = ("micro.f1", "PERSON.f1", "LOCATION.f1", "address.complete_rate", "address.character_coverage")
COUNTERS = tuple(f"{s}_{o}" for s in SCOPES for o in ("tp", "fp", "fn")) + ("a_total", "a_complete", "a_expected", "a_covered")


def units(conversations: DataFrame, outcomes: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """One row of counters for each (model, id), zeros included.

    ``conversations``: model, id. ``outcomes``: model, id, type, outcome of
    compared spans. ``addresses``: model, id, expected, covered, complete.
    """
    cols = [F.count_if((F.col("outcome") == o) & (F.lit(s == "micro") | (F.col("type") == s))).alias(f"{s}_{o}") for s in SCOPES for o in ("tp", "fp", "fn")]
    out = conversations.join(outcomes.groupBy("model", "id").agg(*cols), ["model", "id"], "left")
    if addresses is not None:
        sums = addresses.groupBy("model", "id").agg(F.count("*").alias("a_total"), F.count_if("complete").alias("a_complete"), F.sum("expected").alias("a_expected"), F.sum("covered").alias("a_covered"))
        out = out.join(sums, ["model", "id"], "left")
    else:
        out = out.withColumns({c: F.lit(0) for c in COUNTERS[9:]})
    return out.na.fill(0)


#: Different rows of counters (of all models) up to which a replicate draws exactly as many conversations with
#: replacement: every task has these rows (104 bytes each and model) and the row's number of each conversation
#: (four bytes at most). Beyond, each conversation counts a Poisson number of times, where its counters are.
EXACT = 200_000
#: Conversations up to which every task has those numbers.
DRAWN = 50_000_000
#: Weights that a task holds at a time.
BLOCK = 4_000_000
#: Draws that are made at a time: their arrays fit a core's cache.
DRAWS = 65_536
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mixed32(x: np.ndarray) -> np.ndarray:
    """A finaliser of 32 bits, whose products fit the integers of any SQL engine."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def drawn(reps: np.ndarray, codes: np.ndarray, classes: int, seed: int) -> np.ndarray:
    """How often each replicate draws each class (replicate x class) in n draws with replacement from n conversations, of the classes ``codes``.

    The position of a draw is mixed32(mixed32(seed + replicate) + draw) modulo n.
    """
    n, block = len(codes), max(DRAWS, classes)
    size = min(block, n)
    order, h, t, pos, own = np.arange(size, dtype=np.uint32), np.empty(size, np.uint32), np.empty(size, np.uint32), np.empty(size, np.intp), np.empty(size, codes.dtype)
    out = np.zeros((len(reps), classes), np.int64)
    for row, key in enumerate(mixed32((reps.astype(np.int64) + seed).astype(np.uint32))):
        for at in range(0, n, block):
            m = min(block, n - at)
            x, y = h[:m], t[:m]
            np.add(order[:m], np.uint32((int(key) + at) & 0xFFFFFFFF), out=x)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # mixed32, in place
                np.bitwise_xor(x, np.right_shift(x, np.uint32(shift), out=y), out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.bitwise_xor(x, np.right_shift(x, np.uint32(16), out=y), out=x)
            # the remainder by a division, which numpy does for several numbers at once
            np.subtract(x, np.multiply(np.floor_divide(x, np.uint32(n), out=y), np.uint32(n), out=y), out=x)
            pos[:m] = x
            out[row] += np.bincount(np.take(codes, pos[:m], out=own[:m], mode="clip"), minlength=classes)
    return out


def _poisson(keys: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Poisson weights of mean 1 (replicate x conversation), by inversion of mixed hashes."""
    share = (mixed(keys[:, None] + positions) >> _U(11)).astype(np.float64) / 2.0**53
    below = np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.maximum(np.arange(20), 1)))
    return np.searchsorted(below, share, side="right").astype(np.float64)


def _sums(models: list[str], reps: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(sums.reshape(-1, len(COUNTERS)), columns=list(COUNTERS))
    out.insert(0, "rep", np.repeat(reps, len(models)))
    out.insert(0, "model", models * len(reps))
    return out


_KIND = "model string, rep long, " + ", ".join(f"{c} double" for c in COUNTERS)


def _joint(counters: DataFrame, models: list[str]) -> DataFrame:
    """(id, counts): the counters of all models in one array for each conversation, null where a model lacks it. Rows of one model and id are equal."""
    mine = [F.col("model") == m for m in models]
    # a persisted table keeps all its shuffle partitions, each of which would write a file for every other one
    few = counters.coalesce(4 * counters.sparkSession.sparkContext.defaultParallelism)
    own = few.groupBy("id").agg(
        *[F.count_if(of).alias(f"_n{i}") for i, of in enumerate(mine)],
        *[F.max(F.when(of, F.col(c).cast("long"))).alias(f"_{i}_{c}") for i, of in enumerate(mine) for c in COUNTERS],
    )
    k = F.greatest("_n0", *[f"_n{i}" for i in range(len(models))])  # more than 1 for a repeated id
    whole = reduce(lambda a, b: a & b, [F.col(f"_n{i}") == k for i in range(len(models))])
    counts = F.when(whole, F.array(*[f"_{i}_{c}" for i in range(len(models)) for c in COUNTERS]))
    return own.select("id", F.explode(F.array_repeat(counts, k.cast("int"))).alias("counts"))


def _exact(spark: SparkSession, counters: DataFrame, models: list[str], n: int, replicates: int, seed: int, exact: int) -> DataFrame | None:
    """Sums of exact draws, or None where too many conversations differ in their counters."""
    joint = _joint(counters, models)
    rows = [r["counts"] for r in joint.select("counts").distinct().limit(exact + 1).collect()] if n <= DRAWN else []
    if not 0 < len(rows) <= exact:
        return None
    if None in rows:
        raise ValueError("models must have the same conversations")
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(rows)), "code int, counts array<bigint>"))
    codes = joint.join(numbers, "counts").orderBy("id").select("code").toArrow()["code"].to_numpy()
    kind = np.uint16 if len(rows) <= 2**16 else np.uint32
    shared = spark.sparkContext.broadcast((codes.astype(kind), np.array(rows, np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = shared.value
        step = max(1, BLOCK // len(sums))
        for batch in batches:
            for at in range(0, len(batch), step):
                reps = batch["id"].to_numpy()[at : at + step]
                yield _sums(models, reps, drawn(reps, own, len(sums), seed).astype(np.float64) @ sums)

    return spark.range(0, replicates, 1, max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, _KIND)


def _approximate(spark: SparkSession, counters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The Poisson bootstrap: sums of each task's conversations, then of tasks. A conversation's weights are the same for all models."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        keys = mixed(np.arange(replicates, dtype=np.uint64) + _U(seed))
        for batch in batches:
            for model, own in batch.groupby("model"):
                sums = total.setdefault(model, np.zeros((replicates, len(COUNTERS))))
                step = max(1, BLOCK // replicates)
                for at in range(0, len(own), step):
                    part = own.iloc[at : at + step]
                    sums += _poisson(keys, part["key"].to_numpy().view(np.uint64)) @ part[list(COUNTERS)].to_numpy(np.float64)
        for model, sums in total.items():
            yield _sums([model], np.arange(replicates), sums)

    rows = counters.select("model", F.xxhash64("id").alias("key"), *COUNTERS)
    return rows.mapInPandas(run, _KIND).groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def replicated(counters: DataFrame, replicates: int, seed: int, exact: int | None = None) -> DataFrame:
    """(model, rep, metric, value) of every replicate, over the conversations of :func:`units`."""
    spark = counters.sparkSession
    sizes = {r["model"]: r["n"] for r in counters.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no conversations")
    if len(set(sizes.values())) > 1:
        raise ValueError("models must have the same conversations")
    sums = _exact(spark, counters, sorted(sizes), next(iter(sizes.values())), replicates, seed, EXACT if exact is None else exact)
    return long_metrics(_approximate(spark, counters, replicates, seed) if sums is None else sums, "model", "rep")


def sequential(counters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The same with the sequential generator of Python's ``random`` over ids in their order, drawn on the driver: n times replicates numbers."""
    spark, generator = counters.sparkSession, random.Random(seed)
    table = counters.select("model", "id", *COUNTERS).toPandas().sort_values("id", kind="stable")
    models = sorted(table["model"].unique())
    every = np.concatenate([table[table["model"] == m][list(COUNTERS)].to_numpy(np.float64) for m in models], axis=1)
    items = range(len(every))
    sums = np.array([np.bincount(generator.choices(items, k=len(every)), minlength=len(every)) @ every for _ in range(replicates)])
    return long_metrics(spark.createDataFrame(_sums(models, np.arange(replicates), sums), _KIND), "model", "rep")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def long_metrics(sums: DataFrame, *by: str) -> DataFrame:
    """Rows (by..., metric, value) from one row of summed counters; an undefined metric is null."""
    values = []
    for s in SCOPES:
        tp, fp, fn = (F.col(f"{s}_{o}") for o in ("tp", "fp", "fn"))
        values += [_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)]
    values += [_ratio(F.col("a_complete"), F.col("a_total")), _ratio(F.col("a_covered"), F.col("a_expected"))]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in zip(METRICS, values, strict=True)]))
    return sums.select(*by, rows.alias("m")).select(*by, "m.metric", "m.value")


def point_estimates(counters: DataFrame) -> DataFrame:
    return long_metrics(counters.groupBy("model").agg(*[F.sum(c).alias(c) for c in COUNTERS]), "model").withColumnRenamed("value", "estimate")


def summary(values: DataFrame, estimates: DataFrame, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Mean, bias, sample variance, standard error and interpolated percentile interval; nulls do not count."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    alpha = (1 - confidence) / 2
    got = values.where("value is not null").groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
        F.percentile("value", F.lit(alpha)).alias("ci_lower"),
        F.percentile("value", F.lit(1 - alpha)).alias("ci_upper"),
        F.count("value").alias("replicates_valid"),
    )
    out = got.join(estimates, list(by))
    return out.select(*by, "estimate", "mean", (F.col("mean") - F.col("estimate")).alias("bias"), "variance", F.sqrt("variance").alias("standard_error"), "ci_lower", "ci_upper", F.lit(confidence).alias("confidence"), "replicates_valid")


def differences(values: DataFrame, estimates: DataFrame, models: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Summary of first - second for each pair of models in order, on the compared metrics, replicate by replicate."""
    pairs = [(i, k) for i in range(len(models)) for k in range(i + 1, len(models))]

    def paired(df: DataFrame, keys: list[str], value: str) -> DataFrame:
        # the models of a replicate side by side by an aggregation: a join of values with themselves would draw all of them twice
        own = df.where(F.col("metric").isin(*COMPARED)).groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col(value))).alias(f"_{i}") for i, m in enumerate(models)])
        both = F.array(*[F.struct(F.lit(models[i]).alias("first"), F.lit(models[k]).alias("second"), (F.col(f"_{i}") - F.col(f"_{k}")).alias(value)) for i, k in pairs]).cast(f"array<struct<first:string,second:string,{value}:double>>")
        return own.select(*keys, F.explode(both).alias("_p")).select("_p.first", "_p.second", *keys, f"_p.{value}")

    return summary(paired(values, ["metric", "rep"], "value"), paired(estimates, ["metric"], "estimate"), ["first", "second", "metric"], confidence)


def index_interval(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """The plainer interval: sorted values at int(.025 n) and int(.975 n) - 1, counted from 0."""
    known = values.where("value is not null")
    sizes = known.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = known.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("value")) - 1).join(sizes, list(by))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("value")))
    return ranked.groupBy(*by).agg(at(F.floor(0.025 * F.col("_n"))).alias("lo"), at(F.floor(0.975 * F.col("_n")) - 1).alias("hi"))


def markdown(report: DataFrame) -> str:
    """A Markdown table of a summary: one line a model, one column a compared metric, three decimals."""
    rows: dict[str, dict[str, str]] = {}
    for r in report.where(F.col("metric").isin(*COMPARED)).select("model", "metric", F.format_string("%.3f [%.3f, %.3f]", "estimate", "ci_lower", "ci_upper").alias("cell")).collect():
        rows.setdefault(r["model"], {})[r["metric"]] = r["cell"]
    head = "| model | " + " | ".join(COMPARED) + " |\n|" + "---|" * (len(COMPARED) + 1)
    return "\n".join([head, *("| " + " | ".join([m, *(cells.get(c, "–") for c in COMPARED)]) + " |" for m, cells in sorted(rows.items()))])
