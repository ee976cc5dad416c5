import re

import pytest
from pyspark.sql import functions as F

from velaspan.operators import generation as G

RULES = {
    "COD_UTENTE": {"varianti": [{"prefisso": "P0", "cifre": 8}, {"prefisso": "QOL", "cifre": 7}, {"prefisso": "", "cifre": 9}]},
    "NUM_PRATICA": {"cifre": 7, "separatore": "/", "anni": ["25", "26"]},
    "PASSWORD": {"lunghezze": [8, 10, 12], "alfabeto": "abcXYZ234!@#"},
    "PHONE": {"prefissi": ["", "+39 "], "inizio": "3", "cifre": 9, "separatori": ["", " ", "."]},
    "COD_UNITA": {"stato": "in_attesa_di_formato"},
}
SHAPES = {"COD_UTENTE": r"P0\d{8}|QOL\d{7}|\d{9}", "NUM_PRATICA": r"\d{7}/(25|26)", "PASSWORD": r"[abcXYZ234!@#]{8}|[abcXYZ234!@#]{10}|[abcXYZ234!@#]{12}", "PHONE": r"(\+39 )?3\d{2}([ .]?)\d{3}\2\d{4}"}


def test_values(spark):
    df = spark.range(200)
    for kind, shape in SHAPES.items():
        got = [r[0] for r in df.select(G.value_code(kind, RULES, "1", F.col("id"))).collect()]
        assert all(re.fullmatch(shape, v) for v in got), kind
        assert len(set(got)) > 150
    for kind in ("COD_UNITA", "X"):
        with pytest.raises(ValueError):
            G.value_code(kind, RULES, "1")


def test_quotas():
    assert G.quotas(10, 3) == [4, 3, 3] and G.quotas(2, 3) == [1, 1, 0]


def test_the_plan_of_three_hundred(spark):
    scenarios = spark.createDataFrame([(f"s{i:02d}", [] if i == 11 else ["persona_1", "indirizzo_1", "email_1"], False) for i in range(12)], "scenario string, entities array<string>, all boolean")
    plan = {"versione": "1", "totale": 300, "batch": [
        {"id": "core", "per_scenario_modalita": 10, "scenari": "all", "modalita": list(G.MODES)},
        {"id": "extra", "per_scenario_modalita": 1, "scenari": [f"s{i:02d}" for i in range(5)], "modalita": list(G.MODES)},
        {"id": "focus", "per_scenario_modalita": 30, "scenari": ["s00", "s01"], "modalita": [G.MODES[0]], "entita_obbligatorie": ["indirizzo_1"], "varianti_indirizzo": list(G.VARIANTS)},
    ]}
    rows = G.plan_rows(spark, plan, scenarios, 5)
    assert G.plan_problems(rows, 300).isEmpty() and not G.plan_problems(rows, 301).isEmpty()
    got = rows.collect()
    focus = [r for r in got if r["batch"] == "focus"]
    assert all("indirizzo_1" in r["entities"] and r["entities"] == sorted(r["entities"]) for r in focus)
    assert {v: sum(r["address_variant"] == v for r in focus) for v in G.VARIANTS} == {v: 10 for v in G.VARIANTS}
    assert all(1 <= len(r["entities"]) <= 3 for r in got if r["mode"] == G.MODES[0]) and all(not r["entities"] for r in got if r["mode"] == G.MODES[1])
    assert {len(r["entities"]) for r in got if r["batch"] == "core" and r["mode"] == G.MODES[0]} == {1, 2, 3}
    with pytest.raises(ValueError):
        G.plan_rows(spark, {**plan, "batch": [plan["batch"][0]] * 2}, scenarios, 5)


def test_people(spark):
    df = spark.range(20)
    name, mail = G.person(F.array(F.lit("d'angelo"), F.lit("josé")), F.array(F.lit("rossi-neri")), "1", F.col("id"))
    got = {tuple(r) for r in df.select(name, mail).collect()}
    assert got == {("D'Angelo Rossi-Neri", "dangelo.rossineri@example.org"), ("José Rossi-Neri", "jose.rossineri@example.org")}
    assert all("2024-01-01" <= r[0] <= "2024-01-30" for r in df.select(G.synthetic_date("2024-01-01", 30, "1", F.col("id"))).collect())


def test_surveys(spark):
    scenarios = spark.createDataFrame([("s", "imprese", ["A", "B"]), ("t", "imprese", ["C", "Z"])], "scenario string, respondent string, codes array<string>")
    surveys = spark.createDataFrame([("A", "a", "imprese"), ("B", "b", "imprese"), ("C", "c", "altro")], "code string, name string, respondent string")
    assert {tuple(r) for r in G.survey_problems(scenarios, surveys).collect()} == {("t", "C", "respondent"), ("t", "Z", "unknown")}
    assert G.survey_choice(scenarios.where("scenario = 's'"), surveys, 1).first()["survey"] in ("a", "b")


def test_references(spark):
    kind = "array<struct<reference_id:string,reference:string,type:string,hypothesis:string,state:string>>"
    rows = [([("n", "{{N}}", "PERSON")], "A1", "Uno", None, 2024, [("x", "lit", "OFFICE", "REVIEW", "DRAFT")]), ([], None, None, "Roma", None, [])]
    df = spark.createDataFrame(rows, f"e array<struct<entity_id:string,slot:string,type:string>>, c string, n string, t string, y int, s {kind}")
    got = [r[0] for r in df.select(G.reference_list(*[F.col(c) for c in "ecntys"])).collect()]
    assert [(x["reference_id"], x["reference"], x["hypothesis"]) for x in got[0]] == [("n", "{{N}}", "MASK"), ("codice_indagine", "A1", "KEEP"), ("nome_indagine", "Uno", "KEEP"), ("periodo_ricerca", "2024", "KEEP"), ("x", "lit", "REVIEW")]
    assert [x["type"] for x in got[1]] == ["LOCATION"]
