import pytest

from velaspan.operators import evaluation as E

KIND = "id string, idx int, start int, end int, type string"


def run(spark, texts, gold, pred, states, types=("PERSON", "ADDRESS"), focus=()):
    messages = spark.createDataFrame([(i, k, "Utente" if k % 2 == 0 else "Agente", t) for i, ts in texts.items() for k, t in enumerate(ts)], "id string, idx int, sender string, text string")
    return E.evaluate(messages, spark.createDataFrame(gold, KIND), spark.createDataFrame(pred, KIND), spark.createDataFrame(states, "id string, state string, error string"), types, focus)


def test_partial_and_spurious(spark):
    r = run(spark, {"a": ["È Anna.", "ciao"], "b": ["nulla", "ok ok"]}, [("a", 0, 2, 6, "PERSON")], [("a", 0, 2, 5, "PERSON"), ("b", 1, 0, 4, "ADDRESS")], [("a", "ok", None), ("b", "ok", None)], focus=("PERSON",))
    m = r.micro.first()
    assert (m["tp"], m["fp"], m["fn"], m["precision"], m["recall"], m["f1"]) == (0, 2, 1, 0.0, 0.0, 0.0)
    c = r.characters.first()
    assert (c["expected"], c["covered"], c["overmasked"], c["coverage"]) == (4, 3, 4, 0.75)
    f = r.conversations.first()
    assert (f["evaluated"], f["negative"], f["negative_with_fp"], f["with_omissions"]) == (2, 1, 1, 1)
    assert r.focus.first()["fp"] == 1 and {x["sender"] for x in r.by_role.collect()} == {"Utente", "Agente"}
    assert {x["id"]: (len(x["fp"]), len(x["fn"])) for x in r.errors.collect()} == {"a": (1, 1), "b": (1, 0)}


def test_a_wrong_type_still_covers(spark):
    r = run(spark, {"a": ["È Anna."]}, [("a", 0, 2, 6, "PERSON")], [("a", 0, 2, 6, "ADDRESS")], [("a", "ok", None)])
    assert r.micro.first()["fn"] == 1 and r.characters.first()["coverage"] == 1.0


def test_failures_leave_the_denominators(spark):
    r = run(spark, {"a": ["x"], "b": ["Anna"]}, [("b", 0, 0, 4, "PERSON")], [], [("a", "errore", "boom")])
    assert {(x["id"], x["state"]) for x in r.failures.collect()} == {("a", "errore"), ("b", "mancante")}
    m = r.micro.first()
    assert (m["tp"], m["fp"], m["fn"], m["f1"]) == (0, 0, 0, None)
    assert r.conversations.first()["evaluated"] == 0


def test_zero_division_choice(spark):
    df = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    assert E.with_scores(df, zero=True).first()["f1"] == 0.0 and E.with_scores(df).first()["f1"] is None


def test_focus_must_be_known(spark):
    with pytest.raises(ValueError):
        run(spark, {"a": ["x"]}, [], [], [("a", "ok", None)], focus=("Z",))


def test_sweep(spark):
    gold = spark.createDataFrame([("a", 0, 0, 1, "P"), ("a", 0, 2, 3, "P")], KIND)
    scored = spark.createDataFrame([("a", 0, 0, 1, "P", 0.5), ("a", 0, 4, 5, "P", 0.9)], KIND + ", score double")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in E.threshold_sweep(gold, scored, [0.0, 0.5, 0.6, 0.95]).collect()}
    assert got == {0.0: (1, 1, 1), 0.5: (1, 1, 1), 0.6: (0, 1, 2), 0.95: (0, 0, 2)}


GOOD = {"a": ["Anna qui", "ciao"], "b": ["nulla"]}
WRONG = [
    ({}, [], [], [], ["a", "b"], None, "no inputs"),
    (GOOD, [("a", 0, 0, 4, "PERSON")], [], [("a", "ok", None)], ["a"], None, "b: no gold"),
    (GOOD, [], [("a", 0, 0, 4, "CITY")], [("a", "ok", None)], ["a", "b"], None, "a: prediction: field or type"),
    (GOOD, [], [("a", 0, 0, 40, "PERSON")], [("a", "ok", None)], ["a", "b"], None, "a: prediction: bounds"),
    (GOOD, [("a", 0, 0, 4, "PERSON"), ("a", 0, 2, 6, "PERSON")], [], [("a", "ok", None)], ["a", "b"], None, "a: gold: overlap"),
    (GOOD, [], [], [("a", "boh", None)], ["a", "b"], None, "a: state"),
    (GOOD, [], [], [("a", "errore", " ")], ["a", "b"], None, "a: failure without a reason"),
    (GOOD, [], [("a", 0, 0, 4, "PERSON")], [("a", "errore", "x")], ["a", "b"], None, "a: failure with spans"),
    (GOOD, [], [], [("z", "ok", None)], ["a", "b"], None, "z: prediction without input"),
    (GOOD, [], [], [("a", "ok", None), ("a", "ok", None)], ["a", "b"], None, "a: repeated prediction"),
    (GOOD, [], [], [], ["a", "b"], ("b", 0, "Utente", "again"), "b: repeated input"),
    (GOOD, [], [], [], ["a", "b"], ("a", 2, "Altro", "x"), "a: message"),
    (GOOD, [], [], [], ["a", "b"], ("a", 2, "Utente", None), "a: message"),
    (GOOD, [], [], [], ["a", "b", "c"], ("c", None, None, None), "c: no messages"),
]


@pytest.mark.parametrize("texts, gold, pred, states, ids, extra, said", WRONG)
def test_invalid_evaluations_are_refused(spark, texts, gold, pred, states, ids, extra, said):
    rows = [(i, k, "Utente" if k % 2 == 0 else "Agente", t) for i, ts in texts.items() for k, t in enumerate(ts)] + ([extra] if extra else [])
    messages = spark.createDataFrame(rows, "id string, idx int, sender string, text string")
    frames = spark.createDataFrame(gold, KIND), spark.createDataFrame(pred, KIND), spark.createDataFrame(states, "id string, state string, error string")
    with pytest.raises(ValueError, match=said):
        E.evaluate(messages, *frames, ("PERSON",), gold_ids=spark.createDataFrame([(i,) for i in ids], "id string"))


def test_valid_evaluations_pass(spark):
    messages = spark.createDataFrame([("a", 0, "Utente", "Anna qui"), ("b", 0, "Utente", "x")], "id string, idx int, sender string, text string")
    spans = spark.createDataFrame([("a", 0, 0, 4, "PERSON")], KIND)
    states = spark.createDataFrame([("a", "ok", None), ("b", "errore", "timeout")], "id string, state string, error string")
    r = E.evaluate(messages, spans, spans, states, ("PERSON",), gold_ids=spark.createDataFrame([("a",), ("b",)], "id string"))
    assert r.micro.first()["tp"] == 1 and r.failures.count() == 1
