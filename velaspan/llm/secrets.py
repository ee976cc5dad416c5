"""Secret scans with DataFrame functions only: fixed patterns, and Markov models of random and ordinary strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm.workspace import documents, hidden

# The base patterns, their order and least lengths.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Runs that the Markov models judge, if they hold a letter; numbers are not told from keys by their transitions.
CANDIDATE = "[A-Za-z0-9_+/=-]{16,}"
#: Least log-likelihood ratio, in nats, and least ratio per character, of a secret.
THRESHOLD, PER_CHARACTER = 12.0, 0.35
#: Labelled samples of each class that :func:`samples` makes.
SAMPLES = 4_000
#: Rows of the table, about, whose words ordinary identifiers are made of, and words taken from them.
WORD_ROWS, WORDS = 1_000, 512


def common_words(docs: DataFrame, text_col: str = "text", rows: int = WORD_ROWS, n: int = WORDS) -> list[str]:
    """The n most frequent words of 4 to 12 letters a-z in a sample of about ``rows`` rows, by hash: the same on every call."""
    plain = [c for c, kind in docs.dtypes if kind in ("string", "bigint", "int")]
    share = rows / max(docs.count(), rows)
    some = docs.where(F.xxhash64(*[F.col(c) for c in plain]) <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)))
    words = some.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\b[a-z]{4,12}\b"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in words.orderBy(F.desc("n"), "w").limit(n).collect()]


def samples(spark: SparkSession, words: list[str], n: int = SAMPLES) -> DataFrame:
    """(text, random): labelled strings, ``n`` of each class, the same on every call.

    Random ones are hexadecimal, base64 and base-36 digits of hashes; ordinary
    ones join two to four words in the usual styles, some with a number.
    Without words there are no ordinary ones.
    """
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    number = lambda at, mod: F.conv(F.substring(digest("n"), at, 6), 16, 10).cast("long") % mod
    b64 = F.substring(F.base64(F.unhex(digest("b"))), 1, 40)
    b36 = F.concat(*[F.conv(F.substring(digest("c"), 1 + 12 * i, 12), 16, 36) for i in range(3)])
    rand = spark.range(n).select(
        F.expr("id % 5").alias("kind"), digest("a").alias("hex"), b64.alias("b64"), b36.alias("b36")
    ).select(F.when(F.col("kind") < 2, F.col("hex")).when(F.col("kind") < 4, F.col("b64")).otherwise(F.col("b36")).alias("text"), F.lit(True).alias("random"))
    if not words:
        return rand
    parts = F.split(F.lit(" ".join(words)), " ")
    a, b, c, d = (F.element_at(parts, (number(at, len(words)) + 1).cast("int")) for at in (1, 7, 13, 19))
    style = number(25, 6)
    tail = F.when(number(31, 4) == 0, number(37, 100).cast("string")).otherwise(F.lit(""))
    plain = spark.range(n).select(
        F.concat(
            F.when(style == 0, F.concat_ws("_", a, b, c))
            .when(style == 1, F.concat(a, F.initcap(b), F.initcap(c)))
            .when(style == 2, F.upper(F.concat_ws("_", a, b)))
            .when(style == 3, F.concat_ws("-", a, b, c))
            .when(style == 4, F.concat(a, b, c, d))
            .otherwise(F.concat_ws("/", a, b, c)),
            tail,
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    return rand.union(plain)


def ratios(labelled: DataFrame) -> list[float]:
    """log P(random) - log P(ordinary) of each transition of two ASCII characters, at 96 * (first - 32) + second - 32.

    Transition counts with a half added, by class; both models together have
    at most 2 * 96 ** 2 counts, whatever the samples' number.
    """
    pairs = labelled.where("length(text) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> 96 * (ascii(substring(text, i, 1)) - 32) + ascii(substring(text, i + 1, 1)) - 32)")).alias("pair"))
    table = pairs.where("pair between 0 and 9215").groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")).collect()
    counts = [[0.5] * 9216, [0.5] * 9216]
    for row in table:
        counts[0][row["pair"]] += row["r"]
        counts[1][row["pair"]] += row["o"]
    out = []
    for first in range(96):
        own = [c[96 * first : 96 * first + 96] for c in counts]
        totals = [sum(c) for c in own]
        out += [math.log(r / totals[0]) - math.log(o / totals[1]) for r, o in zip(*own, strict=True)]
    return out


def _spans(text: str, pattern: str, kind: int, test: str, whole: bool = False) -> Column:
    """Struct(start, kind, end[, run]) of the pattern's matches in turn; offsets in code points.

    ``test`` is SQL over m (the match) and v (its last group, or the match).
    Offsets come from the lengths of the matches and of the pieces between them.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    group = 2 if kind == 0 else 0
    every = f"regexp_extract_all({text}, '{quoted}', 0)"
    values = f"regexp_extract_all({text}, '{quoted}', {group})"
    extra, run = (",run:string", ", 'run', x.`0`") if whole else ("", "")
    return F.expr(
        f"aggregate(arrays_zip({every}, {values}, split({text}, '{quoted}', -1)),"
        f" named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,kind:int,end:int{extra}>>)),"
        " (acc, x) -> named_struct('at', acc.at + length(x.`2`) + coalesce(length(x.`0`), 0),"
        f" 'out', if(x.`0` IS NOT NULL AND {test.replace('x.m', 'x.`0`').replace('x.v', 'x.`1`')}, array_append(acc.out, named_struct('start', acc.at + length(x.`2`), 'kind', {kind}, 'end', acc.at + length(x.`2`) + length(x.`0`){run})), acc.out)),"
        " acc -> acc.out)"
    )


def _text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), cast(s.start AS string), cast(s.end AS string))), ',')"


def scanned(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, per_character: float = PER_CHARACTER, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of (start, kind, end) by start, then kind.

    ``_base`` has the fixed patterns' matches, leftmost first and without
    overlap within a kind. ``_spans`` adds runs of identifier characters that
    hold a letter, lie in no base span, and look random to the models:
    log-likelihood ratio at ``threshold`` or more, and at ``per_character`` for
    each transition. ``labelled`` (text, random) are the samples to learn from,
    by default those of :func:`samples` with the table's own words. Null text
    is empty. Every step on texts is a projection of the row: no shuffle, no
    Python, and linear in the length of a run.
    """
    spark = docs.sparkSession
    table = ratios(samples(spark, common_words(docs, text_col)) if labelled is None else labelled)
    model = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    none = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int>>)")
    no_runs = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,run:string>>)")
    t, low = F.col("_t"), F.lower("_t")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    out = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns(
        {
            "_a0": F.when(named, _spans("_t", ASSIGN, 0, f"length(x.v) >= {LEAST['assign']}")).otherwise(none),
            "_a1": F.when(t.contains("AKIA"), _spans("_t", ACCESS, 1, f"length(x.m) >= {LEAST['access']}")).otherwise(none),
            # runs are maximal, so the least length can stand in the pattern itself
            "_a2": F.when(t.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"), _spans("_t", HEX.replace("+", f"{{{LEAST['hex']},}}"), 2, "true")).otherwise(none),
            "_c": F.when(t.rlike(CANDIDATE), _spans("_t", CANDIDATE, 3, "x.m rlike '[A-Za-z]'", whole=True)).otherwise(no_runs),
        }
    )
    out = out.withColumn("_base", F.array_sort(F.concat("_a0", "_a1", "_a2")))
    fresh = F.filter("_c", lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))

    def likely(s: Column) -> Column:
        codes = F.transform(F.split(s["run"], ""), lambda c: F.ascii(c) - 32)  # once; steps along it are by index
        steps = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(model, 96 * F.get(c, i - 1) + F.get(c, i)))
        return F.exists(F.array(codes), lambda c: steps(c) >= F.greatest(F.lit(float(threshold)), per_character * (F.size(c) - 1)))

    found = F.transform(F.filter(fresh, likely), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = out.withColumn("_spans", F.when(F.size("_c") == 0, F.col("_base")).otherwise(F.array_sort(F.concat("_base", found))))
    return out.drop("_a0", "_a1", "_a2", "_c", "_t")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov): one row per document.

    Spans are written kind:start:end in code points, end exclusive, by start,
    then in the order of KINDS, joined by commas; a document without any has
    empty strings and counts of 0. Null text is empty; repeated ids stay
    repeated rows; other columns are ignored.
    """
    got = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), text_col="text", **options)
    count = lambda i: F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_text("_base")).cast("binary"), 256).alias("base_sha256"), F.expr(_text("_spans")).alias("spans"), count(3).alias("n_markov"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, overlapping spans by one; null stays null."""
    own, names, of = hidden(docs, text_col)
    text = F.col(of[text_col])
    got = scanned(own, text_col=of[text_col], **options)
    new = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return got.withColumn(of[text_col], F.when(F.size("_spans") == 0, text).otherwise(new)).select(*names).toDF(*docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return secrets(documents(spark, sf_dir))
