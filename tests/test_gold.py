from velaspan.operators import gold as G

SLOT = "struct<slot:string,value:string,type:string,entity_id:string,address_variant:string,components:map<string,struct<start:int,end:int,text:string>>>"
KIND = f"id string, messages array<struct<sender:string,text:string>>, description string, slots array<{SLOT}>, references array<struct<reference_id:string,reference:string,type:string>>"
NAME = ("{{N}}", "Ada 🙂", "PERSON", "n", None, None)
ROAD = ("{{R}}", "Via Po 5", "ADDRESS", "r", "without_municipality", {"street_name": (4, 6, "Po"), "house_number": (7, 8, "5")})


def test_slots_and_references_become_detections(spark):
    rows = [("a", [("Utente", "🙂 sono {{N}}, {{R}}"), ("Agente", "IST per {{N}} e IST")], "{{N}} chiede", [NAME, ROAD], [("n", "{{N}}", "PERSON"), ("c", "IST", "COD_INDAGINE")])]
    got = G.expected(spark.createDataFrame(rows, KIND))
    assert [(r["idx"], r["text"]) for r in got.messages.orderBy("idx").collect()] == [(0, "🙂 sono Ada 🙂, Via Po 5"), (1, "IST per Ada 🙂 e IST")]
    assert got.descriptions.first()["description"] == "Ada 🙂 chiede" and got.errors.count() == 0
    found = {(r["field"], r["start"], r["end"]): r for r in got.expected.collect()}
    assert {k[1:]: (r["text"], r["type"], [s["detector"] for s in r["sources"]], r["metadata"]["reference_id"]) for k, r in found.items() if "0" in k[0]} == {
        (7, 12): ("Ada 🙂", "PERSON", ["synthetic_slot"], "n"), (14, 22): ("Via Po 5", "ADDRESS", ["synthetic_slot"], "r"),
    }
    assert {k[1:]: r["sources"][0]["detector"] for k, r in found.items() if "1" in k[0]} == {(0, 3): "synthetic_reference", (8, 13): "synthetic_slot", (16, 19): "synthetic_reference"}
    road = found["conversazione.0.testo", 14, 22]["metadata"]
    assert road["address_variant"] == "without_municipality" and {k: tuple(v) for k, v in road["address_components"].items()} == {"street_name": (18, 20, "Po"), "house_number": (21, 22, "5")}
    assert found["conversazione.0.testo", 7, 12]["metadata"]["address_components"] is None


def test_a_reference_at_a_slot_is_one_detection(spark):
    rows = [("a", [("Utente", "{{N}}")], "", [("{{N}}", "IST", "COD_INDAGINE", "n", None, None)], [("c", "IST", "COD_INDAGINE")]), ("b", [("Utente", "nulla")], None, [], None)]
    (r,) = G.expected(spark.createDataFrame(rows, KIND)).expected.collect()
    assert [s["detector"] for s in r["sources"]] == ["synthetic_slot", "synthetic_reference"] and r["metadata"]["reference_id"] == "n"


def test_chats_that_cannot_be_filled(spark):
    rows = [("a", [("Utente", "{{X}}"), ("Agente", "{{N}}")], "", [NAME], []), ("b", [("Utente", "x }} y")], "", [], []), ("c", [("Utente", "{{N}}")], "", [("{{N}}", "", "PERSON", "n", None, None)], [])]
    got = {r["id"]: r["error"] for r in G.expected(spark.createDataFrame(rows, KIND)).errors.collect()}
    assert got == {"a": "unknown slot {{X}}", "b": "braces left over", "c": "bad value of {{N}}"}


def test_older_formats(spark):
    slot = "struct<slot:string,value:string,type:string,entity_id:string,form:string,substitute:string>"
    kind = f"id string, messages array<struct<sender:string,text:string>>, description string, keep array<string>, reason string, slots array<{slot}>"
    rows = [("a", [("Utente", "sono {{N}}"), ("Agente", "bene")], "di {{N}}", ["tenere", "{{N}}!"], "per {{N}}", [("{{N}}", "Ada", "PERSON", "n", None, "[P]")])]
    chats = spark.createDataFrame(rows, kind)
    got = G.masked(chats)
    assert {(r["field"], r["start"], r["end"], r["text"], r["form"], r["substitute"]) for r in got.expected.collect()} == {
        ("conversazione.0.testo", 5, 8, "Ada", "completa", "[P]"), ("metadati.descrizione", 3, 6, "Ada", "completa", "[P]"), ("trattamento_atteso.conservare.1", 0, 3, "Ada", "completa", "[P]"), ("trattamento_atteso.motivazione", 4, 7, "Ada", "completa", "[P]"),
    }
    assert [(r["idx"], r["sender"], r["text"]) for r in got.messages.orderBy("idx").collect()] == [(0, "Utente", "sono Ada"), (1, "Agente", "bene")]
    plain = G.replaced_only(chats)
    assert plain.messages.where("idx = 0").first()["text"] == "sono Ada" and plain.expected.count() == 0 and plain.descriptions.first()["description"] == "di Ada"
