"""Span algebra: overlaps, merging with provenance, adjacent merging, coverage, slots and literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velaspan.functions import text as T

MESSAGE = ("id", "idx")


def overlap_violations(spans: DataFrame, keys: Sequence[str] = MESSAGE) -> DataFrame:
    """Spans that begin before an earlier span of their message ends (earlier by start, then end)."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("prev_end", F.max("end").over(before)).where("prev_end > start")


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = MESSAGE) -> DataFrame:
    """Pairs of spans of one message that share a character: columns of ``a``, then those of ``b`` with ``b_`` before them."""
    right = b.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    return a.join(right, list(keys)).where("start < b_end and end > b_start")


def sliced(spans: DataFrame, messages: DataFrame) -> DataFrame:
    """Spans with ``slice``, the text they cover, and ``n_chars`` of their message (both null without one).

    Spans are gathered by message first, so that each text is joined once and
    not copied for every span.
    """
    rest = [c for c in spans.columns if c not in MESSAGE]
    own = spans.groupBy(*MESSAGE).agg(F.collect_list(F.struct(*rest)).alias("_l"))
    got = own.join(messages.select(*MESSAGE, F.col("text").alias("_m")), list(MESSAGE), "left")
    cut = F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in rest], T.slice_of(F.col("_m"), x["start"], x["end"]).alias("slice")))
    return got.select(*MESSAGE, F.length("_m").alias("n_chars"), F.explode(cut).alias("_s")).select(*MESSAGE, "_s.*", "n_chars")


def invalid_spans(spans: DataFrame, messages: DataFrame, types: Sequence[str]) -> DataFrame:
    """(id, idx, start, end, type, reason) for every span that breaks a rule; valid spans give no row."""
    joined = sliced(spans, messages)
    before = Window.partitionBy("id", "idx").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reason = (
        F.when(F.col("idx").isNull() | F.col("type").isNull() | ~F.col("type").isin(*types), "field or type")
        .when(F.col("n_chars").isNull() | F.col("start").isNull() | F.col("end").isNull(), "position")
        .when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_chars"))), "bounds")
    )
    if "text" in spans.columns:
        reason = reason.when(F.col("text").isNotNull() & (F.col("text") != F.col("slice")), "text")
    reason = reason.when(F.coalesce(F.max("end").over(before) > F.col("start"), F.lit(False)), "overlap")
    return joined.withColumn("reason", reason).where("reason is not null").select("id", "idx", "start", "end", "type", "reason")


def invalid_detections(detections: DataFrame, messages: DataFrame, types: Sequence[str]) -> DataFrame:
    """(id, field, start, end, type, reason) of detections that don't fit their texts; overlaps are no fault.

    ``detections``: id, field, start, end, text, type, sources.
    """
    rows = detections.select("id", T.message_index(F.col("field")).alias("idx"), *[c for c in ("field", "start", "end", "text", "type", "sources") if c in detections.columns])
    got = sliced(rows, messages)
    named = F.exists("sources", lambda s: F.coalesce(s["detector"], F.lit("")) == "")
    reason = (
        F.when(F.col("idx").isNull() | F.col("n_chars").isNull(), "field")
        .when(~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_chars")) & (F.col("slice") == F.col("text")), F.lit(False)), "offsets or text")
        .when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "type")
        .when(F.col("sources").isNull() | (F.size("sources") < 1) | named, "source")
    )
    return got.withColumn("reason", reason).where("reason is not null").select("id", "field", "start", "end", "type", "reason")


def merged(detections: DataFrame, with_record_id: bool = True) -> DataFrame:
    """One row for each (id, field, start, end, type): sources united in order of arrival, metadata of the first.

    ``detections`` has ``ord`` for the order of arrival and ``sources``, an
    array of structs. Overlapping or differently typed spans stay apart.
    """
    key = ["id", "field", "start", "end", "type"]
    fields = ["text"] + (["metadata"] if "metadata" in detections.columns else [])
    grouped = detections.groupBy(*key).agg(
        *[F.min_by(c, "ord").alias(c) for c in fields],
        F.array_sort(F.collect_list(F.struct("ord", "sources"))).alias("_all"),
    )
    every = F.flatten(F.transform("_all", lambda x: x["sources"]))
    out = grouped.withColumn("sources", F.array_distinct(every)).drop("_all")
    return out.withColumn("detection_id", T.detection_id(F.col("id") if with_record_id else None, F.col("field"), F.col("start"), F.col("end"), F.col("type")))


def _wide(text: Column) -> Column:
    """A text as four bytes for each code point, of which a slice costs its own length and not that of all before it."""
    return F.encode(text, "UTF-32")


def _wide_slice(wide: Column, start: Column, end: Column) -> Column:
    """Text of code points [start, end) of :func:`_wide`. A zero-width mark at the start would be lost as a byte order mark, so a space stands before it meanwhile."""
    part = F.substring(wide, 4 * start + 1, 4 * (end - start))
    return F.substring(F.decode(F.concat(F.lit(bytes((0, 0, 0, 32))), part), "UTF-32"), F.lit(2), end - start)


def adjacent_merged(spans: DataFrame, messages: DataFrame, types: Sequence[str] = (), native_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Neighbouring spans of one type joined over a gap of white space and commas.

    ``spans`` are overlap-free, with id, idx, start, end, type, score and
    native. Neighbours join if their type is in ``types`` or their native
    labels are a pair of ``native_pairs``. The score is the least. Whether a
    span joins depends on the one before it alone. Each message's spans are
    gathered, its text is joined once, and runs are cut within the row.
    """
    own = spans.groupBy(*MESSAGE).agg(F.collect_list(F.struct("start", "end", "type", "score", "native")).alias("_s"))
    got = own.join(messages.select(*MESSAGE, F.col("text").alias("_m")), list(MESSAGE))
    return got.select(*MESSAGE, F.explode(adjacent_runs(F.col("_s"), F.col("_m"), types, native_pairs)).alias("m")).select(*MESSAGE, "m.*")


def adjacent_runs(spans: Column, text: Column, types: Sequence[str] = (), native_pairs: Sequence[tuple[str, str]] = ()) -> Column:
    """:func:`adjacent_merged` within a row: an array of (start, end, type, score, text) from an array of spans and their text, in time that grows with their lengths."""

    def joins(p: Column, x: Column, wide: Column) -> Column:
        allowed = F.lit(False)
        if types:
            allowed = allowed | x["type"].isin(*types)
        for a, b in native_pairs:
            allowed = allowed | ((p["native"] == a) & (x["native"] == b))
        gap = _wide_slice(wide, p["end"], x["start"])
        return F.when(allowed & (p["type"] == x["type"]), F.coalesce(gap.rlike("^(?U)[\\s,]*$"), F.lit(False))).otherwise(False)

    def one(g: Column, wide: Column) -> Column:
        first, last = F.get(g, F.lit(0)), F.element_at(g, -1)
        return F.struct(first["start"].alias("start"), last["end"].alias("end"), first["type"].alias("type"), F.array_min(F.transform(g, lambda x: x["score"])).alias("score"), _wide_slice(wide, first["start"], last["end"]).alias("text"))

    # variables of lambda functions (transform over an array of one) are computed once for a row
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def runs(s: Column, wide: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when(~joins(F.get(s, i - 1), x, wide), i)), lambda i: i.isNotNull())
        cut = lambda h: F.transform(h, lambda a, k: one_of(F.slice(s, a + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - a)))
        one_of = lambda g: let(g, lambda own: one(own, wide))
        return let(heads, cut)

    return let(F.struct(F.array_sort(spans).alias("s"), _wide(text).alias("w")), lambda v: runs(v["s"], v["w"]))


def substituted(text: str, entities: str) -> Column:
    """Struct(text, spans, error): slots of the column ``text`` replaced by their entities' values.

    ``entities``: array of structs with slot, value, type, entity_id. Every
    slot must be known, values must not be empty or hold slot braces, no braces
    may be left over; else ``error`` says what is wrong.
    """
    fold = (
        f"aggregate(arrays_zip(regexp_extract_all({text}, '\\\\{{\\\\{{[^{{}}]+\\\\}}\\\\}}', 0), split({text}, '\\\\{{\\\\{{[^{{}}]+\\\\}}\\\\}}', -1)),"
        " named_struct('text', '', 'spans', cast(array() AS array<struct<start:int,end:int,type:string,entity_id:string,value:string>>), 'error', cast(null AS string)),"
        f" (acc, x) -> transform(array(named_struct('e', filter({entities}, e -> e.slot = x.`0`)[0], 'text', concat(acc.text, x.`1`))), y -> named_struct("
        " 'text', concat(y.text, coalesce(y.e.value, x.`0`, '')),"
        " 'spans', if(x.`0` IS NULL OR y.e IS NULL, acc.spans, array_append(acc.spans, named_struct('start', length(y.text), 'end', length(y.text) + length(y.e.value), 'type', y.e.type, 'entity_id', y.e.entity_id, 'value', y.e.value))),"
        " 'error', coalesce(acc.error, if(x.`0` IS NOT NULL AND y.e IS NULL, concat('unknown slot ', x.`0`), null), if(y.e IS NOT NULL AND (coalesce(y.e.value, '') = '' OR y.e.value LIKE '%{{%' OR y.e.value LIKE '%}}%'), concat('bad value of ', x.`0`), null))))[0],"
        f" acc -> named_struct('text', acc.text, 'spans', acc.spans, 'error', coalesce(acc.error, if(size(array_distinct(transform({entities}, e -> e.slot))) < size({entities}), 'repeated slot', null), if(acc.text LIKE '%{{{{%' OR acc.text LIKE '%}}}}%', 'braces left over', null))))"
    )
    return F.expr(fold.replace("filter(" + entities + ", e -> e.slot = x.`0`)[0]", f"get(filter({entities}, e -> e.slot = x.`0`), 0)"))


def literal_sql(text: str, needle: str) -> str:
    """SQL of :func:`literal_spans`, for use within a lambda function."""
    pieces = f"split({text}, concat('\\\\Q', {needle}, '\\\\E'), -1)"
    return (
        f"if({needle} IS NULL OR {needle} = '' OR NOT contains({text}, {needle}), cast(array() AS array<struct<start:int,end:int>>),"
        f" aggregate(slice({pieces}, 1, size({pieces}) - 1), named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,end:int>>)),"
        f" (acc, p) -> named_struct('at', acc.at + length(p) + length({needle}), 'out', array_append(acc.out, named_struct('start', acc.at + length(p), 'end', acc.at + length(p) + length({needle})))), acc -> acc.out))"
    )


def literal_spans(text: str, needle: str) -> Column:
    """Array of (start, end): places of the column ``needle`` in the column ``text``, leftmost first, without overlap."""
    return F.expr(literal_sql(text, needle))


def replaced(text: str, values: str) -> Column:
    """The column ``text`` with each slot that the map ``values`` (slot -> value) knows replaced; others stay, and values are not looked at again."""
    slot = "'\\\\{\\\\{[^{}]+\\\\}\\\\}'"
    return F.expr(f"aggregate(arrays_zip(regexp_extract_all({text}, {slot}, 0), split({text}, {slot}, -1)), '', (acc, x) -> concat(acc, x.`1`, coalesce(try_element_at({values}, x.`0`), x.`0`, '')))")
