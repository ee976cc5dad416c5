import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from velaspan.operators import matching as M

TEXTS = [
    "Scrivi a mario.rossi@example.org oppure a X@y.it!",
    "La password è Segreta9! e basta", "la password non funziona", "pwd: abc123x, pass=Qwerty1",
    "Prot. n. 1589563/25 e ticket #123456", "pratica numero 12", "🙂 codice utente 3331234567 🙂",
    "id utente: 1234567 P012345678 QOL1234567", "chiama +39 333 123 4567 o 333.123.4567", "33312345678901", "", "è à ß ò",
]


def by_python(rules, text):
    return sorted((m.span("valore")[0], m.span("valore")[1], r.type, m["valore"], r.name) for r in rules for m in re.compile(r.pattern, re.I).finditer(text))


def by_spark(spark, rules, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in M.detected(df, rules).collect():
        out[r["id"]].append((r["start"], r["end"], r["type"], r["value"], r["rule"]))
    return [sorted(out[i]) for i in range(len(texts))]


def test_rules_give_what_python_gives(spark):
    rules = M.read_rules()
    assert all(r.native for r in rules)
    assert by_spark(spark, rules, TEXTS) == [by_python(rules, t) for t in TEXTS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aP0123456789@.+ \n🙂è/:", max_size=40), min_size=40, max_size=60))
def test_random_texts(spark, texts):
    rules = M.read_rules()
    assert by_spark(spark, rules, texts) == [by_python(rules, t) for t in texts]


def test_a_value_inside_its_match_goes_another_way(spark):
    rule = M.Rule("quoted", "PERSON", 1, r"<(?P<valore>[a-z]+)>")
    assert not rule.native
    assert by_spark(spark, [rule], ["<ab><c> <D>"]) == [[(1, 3, "PERSON", "ab", "quoted"), (5, 6, "PERSON", "c", "quoted"), (9, 10, "PERSON", "D", "quoted")]]


def test_greedy_keeps_priority_then_length(spark):
    text = "codice utente 3331234567"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rules = M.read_rules()
    assert {r["type"] for r in M.detected(df, rules).collect()} == {"COD_UTENTE", "PHONE"}
    assert [(r["type"], r["value"]) for r in M.resolved(df, rules).collect()] == [("COD_UTENTE", "3331234567")]
    assert M.resolved(df, rules, types=("PHONE",)).count() == 0


@pytest.mark.parametrize("change", [{"nome": "email"}, {"tipo": "X"}, {"priorita": True}, {"pattern": "a(b)"}])
def test_bad_rules(change):
    own = json.loads((M.CONFIGS / "rules.json").read_text(encoding="utf-8"))["regole"]
    bad = {**own[3], "nome": "new", **change}
    with pytest.raises(ValueError):
        M.rules_from({"regole": [*own, bad]})


def test_default_rules_on_the_tables(spark, data):
    """The registered query, which has no SQL, against Python's patterns and the same greedy choice."""
    from velaspan.plans import queries as plans

    rules = M.read_rules()
    got = sorted((r["id"], r["start"], r["end"], r["type"], r["value"], r["rule"]) for r in plans.QUERIES["default_rule_detections"](spark, data).collect())
    want = []
    for d in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        found = [(-r.priority, m.start("valore") - m.end("valore"), m.start("valore"), r.name, m.end("valore"), r.type, m["valore"]) for r in rules for m in re.compile(r.pattern, re.I).finditer(d["text"] or "")]
        kept = []
        for x in sorted(found):
            if not any(x[2] < k[4] and x[4] > k[2] for k in kept):
                kept.append(x)
        want += [(f"doc-{d['doc_id']}", k[2], k[4], k[5], k[6], k[3]) for k in kept]
    assert got == sorted(want) and got
