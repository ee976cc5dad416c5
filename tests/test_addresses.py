import pytest
from pyspark.sql import functions as F

from velaspan.operators import addresses as A
from velaspan.operators import generation as G

C = "map<string,struct<start:int,end:int,text:string>>"
FIELD = "conversazione.0.testo"


def one(spark, text, parts, locations):
    components = {k: (text.index(v), text.index(v) + len(v), v) for k, v in parts.items()}
    rows = spark.createDataFrame([("a", "x", FIELD, 0, len(text), text, components)], f"id string, address_id string, field string, start int, end int, text string, components {C}")
    found = spark.createDataFrame([("a", FIELD, s, e) for s, e in locations], "id string, field string, start int, end int")
    return A.measured(rows.withColumn("parts", A.structured()), found).first()


TEXT = "Via Roma 96, Milano"
PARTS = {"street_type": "Via", "street_name": "Roma", "house_number": "96", "municipality": "Milano"}


def test_outcomes(spark):
    r = one(spark, TEXT, PARTS, [(0, 11), (13, 19)])
    assert (r["outcome"], r["residual_text"], r["coverage"], r["complete"]) == ("complete", "", 1.0, True)
    r = one(spark, TEXT, PARTS, [(4, 11), (13, 19)])
    assert (r["outcome"], r["residual_text"]) == ("partial_other", "Via") and r["coverage"] > 0.7
    assert one(spark, TEXT, PARTS, [(13, 19)])["outcome"] == "municipality_only"
    r = one(spark, TEXT, PARTS, [(0, 8), (13, 19)])
    assert (r["outcome"], r["residual_text"]) == ("house_number_exposed", "96")
    assert one(spark, TEXT, PARTS, [(0, 12)])["outcome"] == "municipality_exposed"
    assert one(spark, TEXT, PARTS, [])["outcome"] == "uncovered"
    r = one(spark, TEXT, PARTS, [(0, 10), (5, 11), (13, 30)])
    assert r["outcome"] == "complete"


def test_totals_name_every_component(spark):
    text = "Via Roma 96, Milano"
    rows = spark.createDataFrame([("a", "x", FIELD, 0, len(text), text, {"street_name": (4, 8, "Roma")})], f"id string, address_id string, field string, start int, end int, text string, components {C}")
    found = spark.createDataFrame([("a", FIELD, 4, 8)], "id string, field string, start int, end int")
    m = A.measured(rows.withColumn("parts", A.structured()), found)
    got = {r["name"]: (r["complete"], r["total"], r["complete_rate"]) for r in A.component_totals(m).collect()}
    assert got == {"street": (1, 1, 1.0), "house_number": (0, 0, None), "internal": (0, 0, None), "municipality": (0, 0, None)}


def test_children_and_house_numbers(spark):
    rows = spark.createDataFrame([("a", "x", TEXT), ("a", "y", TEXT)], "id string, address_id string, text string")
    nested = spark.createDataFrame([("a", "x", "street_civic", 0, 11, "Via Roma 96"), ("a", "x", "municipality", 13, 19, "Milano"), ("a", "y", "municipality", 13, 19, "Milano")], "id string, parent_id string, component string, start int, end int, text string")
    assert {r["address_id"]: r["problem"] for r in A.children(rows, nested).collect()} == {"x": None, "y": "street_civic"}
    texts = ["Via Roma 96", "Via Roma, 12/A bis ", "Via Roma", "96"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(A.from_children(F.col("t"), F.lit(0), F.lit(50), F.lit(56)).alias("p"))
    got = [r["p"] and [(x["name"], x["start"], x["end"]) for x in r["p"]][:2] for r in df.collect()]
    assert got == [[("street", 0, 8), ("house_number", 9, 11)], [("street", 0, 8), ("house_number", 10, 18)], None, None]


def test_expansion(spark):
    kind = f"id string, address_id string, field string, start int, end int, text string, components {C}"
    parts = {"street_type": (7, 10, "Via"), "street_name": (11, 15, "Roma"), "municipality": (20, 26, "Milano")}
    rows = spark.createDataFrame(
        [("a", "p", FIELD, 7, 26, TEXT, parts), ("b", "q", FIELD, 3, 22, TEXT, None), ("c", "r", FIELD, 0, 8, "Via Roma", None), ("d", "s", FIELD, 0, 14, "Via Roma, Nowh", None)], kind
    )
    towns = spark.createDataFrame([("Milano",)], "name string")
    known = spark.createDataFrame([("b", FIELD, 16, 22, "LOCATION")], "id string, field string, start int, end int, type string")
    got = sorted((r["id"], r["start"], r["end"], r["text"], r["component"]) for r in A.expanded(rows, known, towns).collect())
    assert got == [("a", 7, 15, "Via Roma", "street_address"), ("a", 20, 26, "Milano", "municipality"), ("b", 3, 14, "Via Roma 96", "street_civic")]
    assert {r["id"] for r in A.unresolved(rows, towns).collect()} == {"c", "d"}
    assert A.invalid_components(rows).count() == 0
    bad = spark.createDataFrame([("a", "p", FIELD, 7, 26, TEXT, {"street_name": (11, 15, "Rome")}), ("b", "p", FIELD, 7, 26, TEXT, {"other": (7, 10, "Via")})], kind)
    assert A.invalid_components(bad).count() == 2


def test_composed_addresses_have_exact_offsets(spark):
    rows = [(i, s, v) for i, (s, v) in enumerate((s, v) for s in ("Via Appia Nuova", "Appia", "Piazza Re") for v in G.VARIANTS)]
    df = spark.createDataFrame(rows, "i int, street string, variant string").withColumn("a", G.composed_address(F.col("street"), F.lit("Roma"), F.col("variant"), "1", F.col("i")))
    for r in df.collect():
        a = r["a"]
        assert all(a["value"][c["start"] : c["end"]] == c["text"] for c in a["components"].values()), a
        assert ("municipality" in a["components"]) == (r["variant"] != "without_municipality")
        assert ("house_number" in a["components"]) == (r["variant"] != "without_house_number")
        assert ("street_type" in a["components"]) == (r["street"] != "Appia" and r["variant"] != "without_street_type")
        assert ("internal" in a["components"]) == (r["variant"] == "with_internal")


def test_gold_addresses_take_components_or_children(spark):
    from velaspan.operators import addresses as A

    source = "array<struct<detector:string,parent_detection_id:string,component:string>>"
    kind = f"id string, detection_id string, field string, start int, end int, text string, type string, components map<string,struct<start:int,end:int,text:string>>, sources {source}"
    f, child = "conversazione.0.testo", lambda p, c: [("synthetic_address_component", p, c)]
    slot = [("synthetic_slot", None, None)]
    rows = [
        ("a", "p1", f, 5, 23, "Via Po 5 bis, Roma", "ADDRESS", None, slot), ("a", "c1", f, 5, 17, "Via Po 5 bis", "LOCATION", None, child("p1", "street_civic")), ("a", "c2", f, 19, 23, "Roma", "LOCATION", None, child("p1", "municipality")),
        ("b", "p2", f, 0, 6, "Via Po", "ADDRESS", {"street_type": (0, 3, "Via"), "street_name": (4, 6, "Po")}, slot), ("c", "p3", f, 0, 6, "Via Po", "ADDRESS", None, slot), ("d", "p4", f, 0, 4, "Roma", "ADDRESS", {"municipality": (0, 4, "Roma")}, slot),
        ("e", "p5", f, 0, 12, "Via Po, Roma", "ADDRESS", None, slot), ("e", "c5", f, 0, 6, "Via Po", "LOCATION", None, child("p5", "street_civic")), ("e", "c6", f, 8, 12, "Roma", "LOCATION", None, child("p5", "municipality")),
        ("f", "p6", f, 0, 6, "Via Po", "ADDRESS", {"street_name": (4, 6, "Po")}, slot),
    ]
    got = A.gold_addresses(spark.createDataFrame(rows, kind))
    by = {r["address_id"]: r for r in got.collect()}
    assert [(p["name"], p["start"], p["end"]) for p in by["p1"]["parts"]] == [("street", 5, 11), ("house_number", 12, 17), ("municipality", 19, 23)]
    assert {k: r["problem"] for k, r in by.items()} == {"p1": None, "p2": None, "p3": "street_civic", "p4": "street", "p5": "house number", "p6": None}
    outcomes = spark.createDataFrame([("a", "ok", None), ("b", "errore", "timeout"), ("z", "errore", "x")], "id string, state string, error string")
    locations = spark.createDataFrame([("a", f, 5, 17)], "id string, field string, start int, end int")
    fine = got.where("problem is null")
    r = A.evaluate_addresses(fine, locations, outcomes, check=True)
    assert {(x["id"], x["addresses"], x["reason"]) for x in r.failures.collect()} == {("b", 1, "timeout"), ("f", 1, "missing")}
    t = r.totals.first()
    assert (t["total"], t["complete"]) == (1, 0) and r.outcomes.first()["outcome"] == "municipality_exposed" and r.details.first()["residual_text"] == "Roma"
    for bad in ((got, outcomes), (fine, outcomes.where("id <> 'a'")), (fine, outcomes.replace("ok", "boh", "state"))):
        with pytest.raises(ValueError):
            A.evaluate_addresses(bad[0], locations, bad[1], check=True)
    assert A.expanded(fine, fine.limit(0)).count() == 0
