"""Stratified plans of synthetic conversations, and values for their slots, by hashes of a seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.functions import text as T

# Modes, address variants, street designators, and the value rules' shapes.
MODES = ("con_dati_personali", "senza_dati_personali")
VARIANTS = ("complete_standard", "without_street_type", "without_house_number", "without_municipality", "complex_house_number", "with_internal")
STREET_TYPES = (
    "VIA", "VIALE", "PIAZZA", "CORSO", "LARGO", "VICOLO", "STRADA", "LOCALITA'", "CONTRADA", "PIAZZALE", "TRAVERSA", "VOCABOLO", "VICO", "PREDIO", "FRAZIONE",
    "SALITA", "CIRCONVALLAZIONE", "CASE", "PIAZZETTA", "LUNGOTEVERE", "LUNGOMARE", "CASA", "PODERE", "BORGO", "VILLA", "NUCLEO", "BORGATA", "RAMPA", "SCALINATA", "CLIVO",
)


def draw(seed: Column | str, *salt: Column | str) -> Column:
    """A whole number of 32 bits from a seed and salts; the same on every engine that has SHA-256."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (seed, *salt)]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def pick(values: Column, seed: Column | str, *salt: Column | str) -> Column:
    """One of an array's elements."""
    return F.get(values, (draw(seed, *salt) % F.size(values)).cast("int"))


def digits(n: int, seed: Column | str, *salt: Column | str) -> Column:
    return F.concat(*[(draw(seed, *salt, str(i)) % 10).cast("string") for i in range(n)])


def quotas(total: int, groups: int) -> list[int]:
    """``total`` dealt evenly; the first groups take the rest."""
    base, rest = divmod(total, groups)
    return [base + (i < rest) for i in range(groups)]


def plan_rows(spark: SparkSession, plan: Mapping, scenarios: DataFrame, seed: int) -> DataFrame:
    """One row for each planned conversation: id, batch, scenario, mode, number, seed, entities, address variant.

    ``plan`` has ``totale`` and ``batch``: id, per_scenario_modalita, scenari
    ('all' or ids), modalita, and optionally entita_obbligatorie and
    varianti_indirizzo. ``scenarios``: scenario, entities array<string>, all
    boolean (take all of them). Scenarios without entities have no rows in the
    mode with personal data. Entities are a subset by hash, at least one, with
    the mandatory ones; variants go round by number.
    """
    batches = plan["batch"]
    if len({b["id"] for b in batches}) != len(batches) or any(b["per_scenario_modalita"] < 1 or set(b["modalita"]) - set(MODES) for b in batches):
        raise ValueError("batches need unique ids, positive quotas and known modes")
    kind = "batch string, pos int, quota int, only array<string>, modes array<string>, mandatory array<string>, variants array<string>"
    rows = [(b["id"], i, b["per_scenario_modalita"], None if b["scenari"] == "all" else list(b["scenari"]), list(b["modalita"]), list(b.get("entita_obbligatorie", ())), list(b.get("varianti_indirizzo", ()))) for i, b in enumerate(batches)]
    table = spark.createDataFrame(rows, kind)
    # a product of two catalogues, by an explode of the batches' own scenario lists
    names = F.coalesce("only", F.array(*[F.lit(r["scenario"]) for r in scenarios.select("scenario").distinct().orderBy("scenario").collect()]))
    grid = table.withColumn("scenario", F.explode(names)).join(scenarios, "scenario").withColumn("mode", F.explode("modes"))
    grid = grid.where(~((F.col("mode") == MODES[0]) & (F.size("entities") == 0))).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)))
    grid = grid.withColumn("id", F.concat_ws("-", "batch", "scenario", "mode", F.format_string("%04d", F.col("number") + 1))).withColumn("seed", F.lit(seed) + F.col("pos"))
    ranked = F.array_sort(F.transform("entities", lambda e: F.struct(draw(F.col("seed"), F.col("id"), e).alias("k"), e.alias("e"))))
    some = F.slice(F.transform(ranked, lambda x: x["e"]), 1, (1 + draw(F.col("seed"), F.col("id"), "size") % F.greatest(F.size("entities"), F.lit(1))).cast("int"))
    own = F.array_sort(F.array_union(F.when(F.col("all"), F.col("entities")).otherwise(some), F.col("mandatory")))
    variant = F.when(F.size("variants") > 0, F.get("variants", F.col("number") % F.greatest(F.size("variants"), F.lit(1))))
    return grid.select("id", "batch", "scenario", "mode", "number", "seed", F.when(F.col("mode") == MODES[0], own).otherwise(F.array().cast("array<string>")).alias("entities"), variant.alias("address_variant"))


def plan_problems(rows: DataFrame, total: int) -> DataFrame:
    """One row if a plan does not give ``total`` rows with different ids, else none."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).where(f"rows <> {total} or ids <> rows")


def value_code(kind: str, rules: Mapping, seed: Column | str, *salt: Column | str) -> Column:
    """A value in the format of a rule: user code, case number, password or phone."""
    if kind not in rules or rules[kind].get("stato") == "in_attesa_di_formato":
        raise ValueError(f"no format for {kind}")
    r = rules[kind]
    if kind == "COD_UTENTE":
        forms = F.array(*[F.concat(F.lit(v["prefisso"]), digits(v["cifre"], seed, *salt, "d")) for v in r["varianti"]])
        return pick(forms, seed, *salt, "v")
    if kind == "NUM_PRATICA":
        return F.concat(digits(r["cifre"], seed, *salt, "d"), F.lit(r["separatore"]), pick(F.array(*map(F.lit, r["anni"])), seed, *salt, "y"))
    if kind == "PASSWORD":
        letters = F.array(*[F.lit(c) for c in r["alfabeto"]])
        longest = F.concat(*[pick(letters, seed, *salt, str(i)) for i in range(max(r["lunghezze"]))])
        return F.substring(longest, F.lit(1), pick(F.array(*map(F.lit, r["lunghezze"])), seed, *salt, "n"))
    if kind == "PHONE":
        number = F.concat(F.lit(r["inizio"]), digits(r["cifre"], seed, *salt, "d"))
        sep = pick(F.array(*map(F.lit, r["separatori"])), seed, *salt, "s")
        return F.concat(pick(F.array(*map(F.lit, r["prefissi"])), seed, *salt, "p"), F.substring(number, 1, 3), sep, F.substring(number, 4, 3), sep, F.substring(number, 7, 64))
    raise ValueError(f"no generator for {kind}")


def composed_address(street: Column, municipality: Column, variant: Column, seed: Column | str, *salt: Column | str) -> Column:
    """Struct(value, components map) of an address in a variant: parts with their separators and exact offsets.

    ``street`` is a road name in title case; its first word is the street type
    if it is one of STREET_TYPES.
    """
    head = F.substring_index(street, " ", 1)
    typed = F.upper(head).isin(*STREET_TYPES) & (F.length(street) > F.length(head))
    name = F.when(typed, F.substring(street, F.length(head) + 2, F.length(street))).otherwise(street)
    number = (1 + draw(seed, *salt, "number") % 300).cast("string")
    extension = F.when(variant == "complex_house_number", pick(F.array(*map(F.lit, ("/A", "/B", " bis"))), seed, *salt, "extension"))
    inner = pick(F.array(F.concat(F.lit("interno "), (1 + draw(seed, *salt, "inner") % 20).cast("string")), F.concat(F.lit("scala "), pick(F.array(*map(F.lit, "ABC")), seed, *salt, "stair"))), seed, *salt, "kind")
    part = lambda n, sep, v: F.struct(F.lit(n).alias("name"), F.lit(sep).alias("sep"), v.alias("text"))
    parts = F.array(
        part("street_type", " ", F.when(typed & (variant != "without_street_type"), head)),
        part("street_name", " ", name),
        part("house_number", " ", F.when(variant != "without_house_number", number)),
        part("house_extension", "", F.when(variant != "without_house_number", extension)),
        part("internal", ", ", F.when(variant == "with_internal", inner)),
        part("municipality", ", ", F.when(variant != "without_municipality", municipality)),
    )
    empty = F.expr("cast(array() AS array<struct<key:string,value:struct<start:int,end:int,text:string>>>)")

    def add(acc: Column, p: Column) -> Column:
        before = F.concat(acc["value"], F.when(acc["value"] == "", "").otherwise(p["sep"]))
        entry = F.struct(p["name"].alias("key"), F.struct(F.length(before).alias("start"), (F.length(before) + F.length(p["text"])).alias("end"), p["text"].alias("text")).alias("value"))
        return F.struct(F.concat(before, p["text"]).alias("value"), F.array_append(acc["entries"], entry).alias("entries"))

    return F.aggregate(
        F.filter(parts, lambda p: p["text"].isNotNull()),
        F.struct(F.lit("").alias("value"), empty.alias("entries")),
        add,
        lambda acc: F.struct(acc["value"].alias("value"), F.map_from_entries(acc["entries"]).alias("components")),
    )


def person(names: Column, surnames: Column, seed: Column | str, *salt: Column | str) -> tuple[Column, Column]:
    """(full name, e-mail address at example.org) of a person from two catalogues (arrays)."""
    first, last = T.title_case(pick(names, seed, *salt, "first")), T.title_case(pick(surnames, seed, *salt, "last"))
    return F.concat_ws(" ", first, last), F.concat(T.mail_local(F.concat_ws(".", first, last)), F.lit("@example.org"))


def synthetic_date(start: str, days: int, seed: Column | str, *salt: Column | str) -> Column:
    return F.date_format(F.date_add(F.lit(start).cast("date"), (draw(seed, *salt, "day") % days).cast("int")), "yyyy-MM-dd")


def survey_choice(scenarios: DataFrame, surveys: DataFrame, seed: int) -> DataFrame:
    """Scenarios with one of their allowed surveys: scenario, respondent, codes array<string> against code, name, respondent."""
    one = scenarios.withColumn("code", pick(F.array_sort("codes"), str(seed), F.col("scenario")))
    return one.join(surveys.select("code", F.col("name").alias("survey"), F.col("respondent").alias("survey_respondent")), "code", "left")


def survey_problems(scenarios: DataFrame, surveys: DataFrame) -> DataFrame:
    """(scenario, code, problem): allowed codes that are unknown, or whose respondents differ or are to be verified."""
    one = scenarios.select("scenario", "respondent", F.explode("codes").alias("code"))
    got = one.join(surveys.select("code", F.col("respondent").alias("_r")), "code", "left")
    problem = F.when(F.col("_r").isNull(), "unknown").when((F.col("_r") != F.col("respondent")) | (F.col("_r") == "da_verificare"), "respondent")
    return got.withColumn("problem", problem).where("problem is not null").select("scenario", "code", "problem")


def slot_choices(entities: Sequence[str]) -> list[str]:
    """Slot names of entities: {{name}}."""
    return ["{{" + e + "}}" for e in entities]


def reference_list(entities: Column, survey_code: Column, survey_name: Column, town: Column, year: Column, static: Column) -> Column:
    """What a conversation refers to, each with the policy that is assumed at first: array of (reference_id, reference, type, hypothesis, state).

    ``entities``: array of (entity_id, slot, type), to be masked. Survey and
    context are kept; null ones are left out. ``static``: references of the
    scenario in the result's own form.
    """

    def one(key: Column | str, reference: Column, kind: Column | str, policy: str) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(key).alias("reference_id"), reference.cast("string").alias("reference"), lit(kind).alias("type"), F.lit(policy).alias("hypothesis"), F.lit("APPROVED").alias("state"))

    fixed = F.array(one("codice_indagine", survey_code, "COD_INDAGINE", "KEEP"), one("nome_indagine", survey_name, "INDAGINE", "KEEP"), one("comune_ricerca", town, "LOCATION", "KEEP"), one("periodo_ricerca", year, "DATE", "KEEP"))
    own = F.transform(entities, lambda e: one(e["entity_id"], e["slot"], e["type"], "MASK"))
    return F.concat(own, F.filter(fixed, lambda r: r["reference"].isNotNull()), static)
