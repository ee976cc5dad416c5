"""Address evaluation: components, alphanumeric coverage, outcomes; and expansion to nested locations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velaspan.functions import text as T
from velaspan.operators.evaluation import FAILED, OK

# Component names, evaluated groups of them, and the ordered outcomes.
COMPONENTS = ("street_type", "street_name", "house_number", "house_extension", "internal", "municipality")
GROUPS = {"street": ("street_type", "street_name"), "house_number": ("house_number", "house_extension"), "internal": ("internal",), "municipality": ("municipality",)}
STREET_VIEW = COMPONENTS[:5]
HOUSE_NUMBER = r"(?iU)(\d+[a-z]?(?:[/-][a-z0-9]+)?(?:\s*(?:bis|ter|quater))?)\s*$"
NESTED = "synthetic_address_component"
_SPAN = "struct<start:int,end:int>"


def significant(text: Column, start: Column) -> Column:
    """Positions of letters and digits of a text that begins at ``start``; spaces and punctuation do not count."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: (i < F.length(text)) & T.word_character(F.substring(text, i + 1, F.lit(1)))), lambda i: i + start)


def positions(spans: Column) -> Column:
    """Distinct positions of an array of (start, end)."""
    return F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["start"] < s["end"]), lambda s: F.sequence(s["start"], s["end"] - 1))))


def structured(components: str = "components") -> Column:
    """Array of (name, start, end) of the evaluated groups, from a map of components; absent groups are left out."""
    parts = []
    for name, members in GROUPS.items():
        own = F.filter(F.array(*[F.try_element_at(F.col(components), F.lit(m)) for m in members]), lambda x: x.isNotNull())
        parts.append(F.when(F.size(own) > 0, F.struct(F.lit(name).alias("name"), F.array_min(F.transform(own, lambda x: x["start"])).alias("start"), F.array_max(F.transform(own, lambda x: x["end"])).alias("end"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def from_children(street: Column, street_start: Column, city_start: Column, city_end: Column) -> Column:
    """The same for an address with a child for street and house number, and one for the municipality; null if it has no number or no street."""
    number = F.regexp_extract(street, HOUSE_NUMBER, 1)
    tail = F.regexp_extract(street, HOUSE_NUMBER, 0)
    at = F.length(street) - F.length(tail)
    name = F.rtrim(F.substring(street, F.lit(1), at), F.lit(" ,"))
    return F.when(
        (number != "") & (name != ""),
        F.array(
            F.struct(F.lit("street").alias("name"), street_start.alias("start"), (street_start + F.length(name)).alias("end")),
            F.struct(F.lit("house_number").alias("name"), (street_start + at).alias("start"), (street_start + at + F.length(number)).alias("end")),
            F.struct(F.lit("municipality").alias("name"), city_start.alias("start"), city_end.alias("end")),
        ),
    )


def measured(addresses: DataFrame, locations: DataFrame) -> DataFrame:
    """Addresses with coverage by predicted locations.

    ``addresses``: id, address_id, field, start, end, text, parts (array of
    name, start, end). ``locations``: id, field, start, end of predicted
    LOCATION spans, overlaps allowed. Adds expected, covered, coverage,
    complete, results (array of name, expected, covered, complete), outcome
    and residual_text. Positions are expanded within one address only.
    """
    by_field = locations.groupBy("id", "field").agg(F.collect_list(F.struct("start", "end")).alias("_loc"))
    got = addresses.join(by_field, ["id", "field"], "left")
    inside = F.filter(F.coalesce("_loc", F.expr(f"cast(array() AS array<{_SPAN}>)")), lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    got = got.withColumn("_pred", positions(F.transform(inside, lambda s: F.struct(F.greatest(s["start"], F.col("start")).alias("start"), F.least(s["end"], F.col("end")).alias("end")))))
    got = got.withColumn("_full", significant(F.col("text"), F.col("start")))

    def result(p: Column) -> Column:
        expected = F.filter("_full", lambda i: (i >= p["start"]) & (i < p["end"]))
        covered = F.size(F.array_intersect(expected, F.col("_pred")))
        return F.struct(p["name"].alias("name"), F.size(expected).alias("expected"), covered.alias("covered"), ((F.size(expected) > 0) & (covered == F.size(expected))).alias("complete"))

    got = got.withColumn("results", F.transform("parts", result))
    missing = F.array_sort(F.array_except("_full", "_pred"))
    got = got.withColumns({"expected": F.size("_full"), "covered": F.size(F.array_intersect("_full", "_pred")), "_missing": missing})
    got = got.withColumns(
        {
            "coverage": F.try_divide("covered", "expected"),
            "complete": F.size("_missing") == 0,
            "residual_text": F.array_join(F.transform("_missing", lambda i: F.substring(F.col("text"), i - F.col("start") + 1, F.lit(1))), ""),
        }
    )
    return got.withColumn("outcome", outcome()).drop("_loc", "_pred", "_full", "_missing")


def outcome() -> Column:
    """The first that fits: complete, house number exposed, municipality exposed, municipality only, uncovered, partial."""
    has = lambda n: F.exists("results", lambda r: r["name"] == n)
    whole = lambda n: F.exists("results", lambda r: (r["name"] == n) & r["complete"])
    others = lambda n: F.forall("results", lambda r: (r["name"] == n) | r["complete"])
    touched = F.exists("results", lambda r: r["covered"] > 0)
    beyond = F.exists("results", lambda r: (r["name"] != "municipality") & (r["covered"] > 0))
    return (
        F.when(F.col("complete"), "complete")
        .when(has("house_number") & ~whole("house_number") & others("house_number"), "house_number_exposed")
        .when(has("municipality") & ~whole("municipality") & others("municipality"), "municipality_exposed")
        .when(whole("municipality") & ~whole("street") & ~beyond, "municipality_only")
        .when(~touched, "uncovered")
        .otherwise("partial_other")
    )


def address_totals(measures: DataFrame) -> DataFrame:
    """One row: addresses, complete ones and their rate, characters covered and exposed."""
    sums = measures.agg(F.count("*").alias("total"), F.count_if("complete").alias("complete"), F.sum("expected").alias("expected"), F.sum("covered").alias("covered"))
    share = F.try_divide("covered", "expected")
    return sums.select("total", "complete", F.try_divide("complete", "total").alias("complete_rate"), share.alias("character_coverage"), (1 - share).alias("residual_exposure"))


def component_totals(measures: DataFrame) -> DataFrame:
    """One row for each of the four groups, also those that no address has."""
    one = measures.select(F.explode("results").alias("r")).select("r.*")
    sums = one.groupBy("name").agg(F.count_if("complete").alias("complete"), F.count("*").alias("total"), F.sum("expected").alias("expected"), F.sum("covered").alias("covered"))
    frame = measures.sparkSession.createDataFrame([(n,) for n in GROUPS], "name string")
    out = frame.join(sums, "name", "left").na.fill(0)
    return out.select("name", "complete", "total", F.try_divide("complete", "total").alias("complete_rate"), F.try_divide("covered", "expected").alias("character_coverage"))


def outcome_histogram(measures: DataFrame) -> DataFrame:
    return measures.groupBy("outcome").agg(F.count("*").alias("n")).orderBy("outcome")


def children(addresses: DataFrame, nested: DataFrame) -> DataFrame:
    """Addresses with the one child of each component name; ``problem`` names what is missing or repeated.

    ``nested``: id, parent_id, component, start, end, text.
    """
    wanted = ("street_civic", "municipality")
    counts = [F.count_if(F.col("component") == w).alias(f"n_{w}") for w in wanted]
    values = [F.max(F.when(F.col("component") == w, F.struct("start", "end", "text"))).alias(w) for w in wanted]
    got = nested.groupBy("id", F.col("parent_id").alias("address_id")).agg(*counts, *values)
    joined = addresses.join(got, ["id", "address_id"], "left")
    problem = F.when(F.coalesce("n_street_civic", F.lit(0)) != 1, "street_civic").when(F.coalesce("n_municipality", F.lit(0)) != 1, "municipality")
    return joined.withColumn("problem", problem).drop("n_street_civic", "n_municipality")


def gold_addresses(detections: DataFrame) -> DataFrame:
    """Addresses with parts and ``problem`` (null: fine): id, address_id, field, start, end, text, parts.

    ``detections``: id, detection_id, field, start, end, text, type, components
    (map, null without) and sources with detector, parent_detection_id and
    component. Components come from an address's own map, or else from its two
    nested views.
    """
    own = detections.where("type = 'ADDRESS'").select("id", F.col("detection_id").alias("address_id"), "field", "start", "end", "text", "components")
    nested = detections.select("id", "start", "end", "text", F.explode("sources").alias("s")).where(F.col("s.detector") == NESTED)
    got = children(own, nested.select("id", F.col("s.parent_detection_id").alias("parent_id"), F.col("s.component").alias("component"), "start", "end", "text"))
    mapped = F.coalesce(F.size("components"), F.lit(0)) > 0
    split = from_children(F.col("street_civic.text"), F.col("street_civic.start"), F.col("municipality.start"), F.col("municipality.end"))
    got = got.withColumn("parts", F.when(mapped, structured()).otherwise(split))
    problem = F.when(mapped, F.when(~F.exists("parts", lambda p: p["name"] == "street"), "street")).otherwise(F.coalesce("problem", F.when(F.col("parts").isNull(), "house number")))
    return got.withColumn("problem", problem).select("id", "address_id", "field", "start", "end", "text", "parts", "problem")


@dataclass
class AddressReport:
    """Results of :func:`evaluate_addresses`, all lazy."""

    totals: DataFrame
    components: DataFrame
    outcomes: DataFrame
    details: DataFrame
    failures: DataFrame


def evaluate_addresses(addresses: DataFrame, locations: DataFrame, outcomes: DataFrame, check: bool = False) -> AddressReport:
    """Coverage of addresses (:func:`gold_addresses`) whose conversation has a usable prediction (id, state, error).

    ``failures`` lists conversations without one, if they have addresses: id,
    number of addresses, reason. With ``check``, an address that can't be taken
    apart, an unknown state, or no address at all raises ValueError.
    """
    states = addresses.join(outcomes.select("id", "state", "error"), "id", "left")
    usable = states.where(f"state = '{OK}'").drop("state", "error")
    if check:
        if bad := addresses.where("problem is not null").limit(5).collect():
            raise ValueError("; ".join(f"{r['address_id']}: {r['problem']}" for r in bad))
        if not outcomes.where(f"state is null or state not in ('{OK}', '{FAILED}')").isEmpty():
            raise ValueError("unknown state of a prediction")
        if usable.isEmpty():
            raise ValueError("no address to evaluate")
    details = measured(usable, locations)
    failed = states.where(f"state is null or state = '{FAILED}'").groupBy("id").agg(F.count("*").alias("addresses"), F.coalesce(F.max("error"), F.lit("missing")).alias("reason"))
    return AddressReport(address_totals(details), component_totals(details), outcome_histogram(details), details, failed)


def invalid_components(addresses: DataFrame) -> DataFrame:
    """Addresses whose component map has unknown names, no street name, or offsets and texts that do not fit the address."""
    e = F.map_entries("components")
    inside = lambda v: (F.col("start") <= v["start"]) & (v["start"] < v["end"]) & (v["end"] <= F.col("end"))
    same = lambda v: F.substring(F.col("text"), v["start"] - F.col("start") + 1, v["end"] - v["start"]) == v["text"]
    ok = F.map_contains_key("components", "street_name") & F.forall(e, lambda x: x["key"].isin(*COMPONENTS) & inside(x["value"]) & same(x["value"]))
    return addresses.where(F.col("components").isNotNull() & ~F.coalesce(ok, F.lit(False)))


def expanded(addresses: DataFrame, known: DataFrame, municipalities: DataFrame | None = None) -> DataFrame:
    """Nested LOCATION views of addresses: (id, field, start, end, text, component, parent_id), without those in ``known``.

    Components give the street view, from the first to the last street part,
    and the municipality. Without them the text is split at its last comma, if
    what follows is a known municipality. ``municipalities`` (name) is a
    catalogue; the planner broadcasts it while it is small. Without a catalogue
    nothing is expanded.
    """
    if municipalities is None:
        empty = "id string, field string, start int, end int, text string, component string, parent_id string, detection_id string"
        return addresses.sparkSession.createDataFrame([], empty)
    own = F.filter(F.array(*[F.try_element_at(F.col("components"), F.lit(m)) for m in STREET_VIEW]), lambda x: x.isNotNull())
    city = F.try_element_at(F.col("components"), F.lit("municipality"))
    view = lambda name, s, e: F.struct(F.lit(name).alias("component"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    lo, hi = F.array_min(F.transform(own, lambda x: x["start"])), F.array_max(F.transform(own, lambda x: x["end"]))
    with_parts = addresses.where("components is not null").select("*", F.explode(F.filter(F.array(view("street_address", lo, hi), F.when(city.isNotNull(), view("municipality", city["start"], city["end"]))), lambda x: x.isNotNull())).alias("v"))
    tail = F.substring_index("text", ",", -1)
    head = F.substring(F.col("text"), F.lit(1), F.length("text") - F.length(tail) - 1)
    split = addresses.where("components is null and contains(text, ',')").withColumns({"_city": _stripped(tail), "_street": _stripped(head)})
    split = split.join(municipalities.select(F.col("name").alias("_city")).distinct(), "_city").where("_street <> ''")
    s0 = F.col("start") + F.expr("locate(_street, text)") - 1
    c0 = F.col("end") - F.expr("locate(reverse(_city), reverse(text)) - 1 + length(_city)")
    without = split.select(*addresses.columns, F.explode(F.array(view("street_civic", s0, s0 + F.length("_street")), view("municipality", c0, c0 + F.length("_city")))).alias("v"))
    both = with_parts.select(*addresses.columns, "v").union(without)
    out = both.select("id", "field", F.col("v.start").alias("start"), F.col("v.end").alias("end"), F.expr("substring(text, v.start - start + 1, v.end - v.start)").alias("text"), F.col("v.component").alias("component"), F.col("address_id").alias("parent_id"))
    out = out.join(known.where("type = 'LOCATION'").select("id", "field", "start", "end"), ["id", "field", "start", "end"], "left_anti")
    return out.dropDuplicates(["id", "field", "start", "end"]).withColumn("detection_id", nested_id())


def nested_id() -> Column:
    """Id of a nested view: its parent's id, component and bounds."""
    q = T.json_string
    return F.concat(F.lit("det_"), F.substring(F.sha2(F.concat(F.lit("["), q(F.col("parent_id")), F.lit(","), q(F.col("component")), F.lit(","), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit("]")).cast("binary"), 256), 1, 16))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def unresolved(addresses: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Addresses without components that the catalogue cannot split."""
    tail = F.substring_index("text", ",", -1)
    head = F.substring(F.col("text"), F.lit(1), F.length("text") - F.length(tail) - 1)
    plain = addresses.where("components is null").withColumns({"_city": _stripped(tail), "_street": F.when(F.contains("text", F.lit(",")), _stripped(head)).otherwise("")})
    known = municipalities.select(F.col("name").alias("_city")).distinct().withColumn("_known", F.lit(True))
    return plain.join(known, "_city", "left").where("_known is null or _street = ''").select(*addresses.columns)
