import pytest

from velaspan.operators import native as N

MODEL = N.Model("m", {"STREET": "LOCATION", "BUILDINGNUM": "LOCATION", "CITY": "LOCATION", "GIVENNAME": "PERSON", "SURNAME": "PERSON", "O": None}, 0.5, (), (("STREET", "BUILDINGNUM"), ("GIVENNAME", "SURNAME")))
KIND = "id string, idx int, ord int, label string, start int, end int, score double"


def judged(spark, text, entities):
    messages = spark.createDataFrame([("a", 0, text)], "id string, idx int, text string")
    rows = spark.createDataFrame([("a", 0, i, *e) for i, e in enumerate(entities)], KIND)
    return messages, rows, N.judged(rows, messages, MODEL)


def test_native_sequences(spark):
    messages, _, rows = judged(spark, "Via Roma 12, Milano", [("STREET", 0, 8, 0.9), ("BUILDINGNUM", 8, 12, 0.8), ("CITY", 12, 19, 0.9)])
    assert sorted((r["start"], r["end"], r["score"]) for r in N.normalised(rows, messages, MODEL).collect()) == [(0, 11, 0.8), (13, 19, 0.9)]
    assert N.detections(rows, MODEL).count() == 3


def test_blank_null_and_threshold(spark):
    messages, _, rows = judged(spark, "ab  cd", [("GIVENNAME", 2, 4, 0.9), ("O", 0, 2, 0.9), ("O", 2, 4, 0.9), ("GIVENNAME", 0, 2, 0.5), ("GIVENNAME", 4, 6, 0.49)])
    assert {(r["label"], r["n"]) for r in N.ignored_labels(rows).collect()} == {("GIVENNAME:span_vuoto", 1), ("O", 1), ("O:span_vuoto", 1)}
    assert [(r["start"], r["end"]) for r in N.normalised(rows, messages, MODEL).collect()] == [(0, 2)]


def test_names_apart_stay_apart(spark):
    messages, _, rows = judged(spark, "Ugo e Neri", [("GIVENNAME", 0, 3, 0.9), ("SURNAME", 6, 10, 0.9)])
    assert N.normalised(rows, messages, MODEL).count() == 2


def test_errors_mark_the_conversation(spark):
    messages, native, rows = judged(spark, "abc", [("WHAT", 0, 1, 0.9), ("CITY", 2, 9, 0.9), ("CITY", 0, 1, float("nan"))])
    assert {r["fate"] for r in rows.collect()} == {"error"}

    def load():
        def infer(text):
            if "boom" in text:
                raise RuntimeError("no")
            return [{"label": "CITY", "start": 0, "end": 1, "score": 1.0}]

        return infer

    texts = spark.createDataFrame([("a", 0, "x"), ("b", 0, "boom"), ("c", 0, "  ")], "id string, idx int, text string")
    found = N.inferred(texts, load)
    good = N.judged(found.where("error is null"), texts, MODEL)
    assert {(r["id"], r["state"]) for r in N.prediction_states(texts, found, good).collect()} == {("a", "ok"), ("b", "errore"), ("c", "ok")}


def test_zero_shot(spark):
    df = spark.createDataFrame([("a", {"CITY": [(0, 3, None), (4, 5, 0.2)]})], "id string, entities map<string,array<struct<start:int,end:int,confidence:double>>>")
    assert sorted((r["label"], r["start"], r["score"]) for r in N.zero_shot(df).collect()) == [("CITY", 0, 1.0), ("CITY", 4, 0.2)]


def test_bad_models():
    for bad in (dict(name="A b"), dict(labels={}), dict(threshold=2), dict(labels={"x": "NOPE"}), dict(merge_native=(("x", "y"),))):
        with pytest.raises(ValueError):
            N.Model(**{"name": "m", "labels": {"a": "PERSON"}, **bad})
