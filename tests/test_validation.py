import json

from pyspark.sql import functions as F

from velaspan.operators import validation as V

M = "array<struct<sender:string,text:string>>"
KIND = f"id string, messages {M}, description string, slots array<struct<slot:string,value:string,type:string,entity_id:string>>, references array<struct<reference_id:string,reference:string,type:string>>, repeat array<string>, exchanges int"
U, A = "Utente", "Agente"
SLOT = [("{{N}}", "Ada", "PERSON", "n")]


def talk(*texts):
    return [(U if i % 2 == 0 else A, t) for i, t in enumerate(texts)]


def test_preparation(spark):
    good = talk("sono {{N}}", "salve {{N}}", "codice XY", "ok", "grazie", "prego")
    rows = [
        ("ok", good, "riassunto", SLOT, [("r", "XY", "DATE")], ["{{N}}"], 3),
        ("claim", good, "pratica in bozza", SLOT, [], [], 4),
        ("first", talk("ciao", "salve {{N}}", "sono {{N}}", "ok", "grazie", "prego"), "x", SLOT, [], ["{{N}}"], 3),
        ("stray", talk("sono {{N}}", "b", "ticket 12345", "ok", "grazie", "prego"), "x", SLOT, [], [], 3),
        ("leak", talk("sono Ada {{N}}", "b", "c", "d", "e", "f"), "x", SLOT, [], [], 3),
        ("slots", talk("a", "b", "c", "d", "e", "f"), "x", SLOT, [], [], 3),
        ("short", talk("sono {{N}}", "b"), "x", SLOT, [], [], 1),
        ("turns", [(A, "a"), (U, "{{N}}"), (U, "c"), (A, "d"), (U, "e"), (A, "f")], "x", SLOT, [], [], 3),
        ("refs", good, "x", SLOT, [("r", "ZZ", "DATE")], [], 3),
        ("blank", [*good[:1], (A, " "), *good[1:]], "x", SLOT, [], [], 3),
    ]
    got = {r["id"]: r for r in V.prepared(spark.createDataFrame(rows, KIND)).collect()}
    assert {k: (r["state"], r["error"]) for k, r in got.items()} == {
        "ok": ("valido", None), "claim": ("da_verificare", None), "first": ("da_verificare", None), "stray": ("da_verificare", None), "leak": ("errore", "value instead of slot"),
        "slots": ("errore", "slots"), "short": ("errore", "exchanges"), "turns": ("errore", "turns"), "refs": ("errore", "references"), "blank": ("valido", None),
    }
    assert got["claim"]["coherence"] == ["in bozza"] and got["claim"]["warning"] and not got["ok"]["warning"]
    assert got["first"]["coverage"] == ["{{N}}: agent first"] and got["stray"]["stray"] == ["12345"] and got["blank"]["repairs"] == 1


def test_fences(spark):
    rows = [('```json\n{"a": "1"}\n```',), (' {"a": "2"} ',), ('```\n{"a": "3"}\n``` more',), ('{"a": ',)]
    got = V.parsed(spark.createDataFrame(rows, "t string"), "t", "a string").collect()
    assert [(r["fenced"], r["chat"] and r["chat"]["a"]) for r in got] == [(True, "1"), (False, "2"), (False, None), (False, None)]


def test_answers(spark):
    a = json.dumps({"stop_reason": "end_turn", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "hi"}, {"type": "text", "text": "!"}]})
    b = json.dumps({"status": "completed", "output": [{"content": [{"type": "output_text", "text": "yo"}]}, {}]})
    df = spark.createDataFrame([(a, b), (json.dumps({"stop_reason": "max"}), json.dumps({"status": "failed"})), (json.dumps({"stop_reason": "end_turn", "content": [{"type": "tool"}]}), json.dumps({"status": "completed", "output": []}))], "a string, b string")
    df = df.select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    (t1, e1), (t2, e2) = V.answer_text("anthropic", "a"), V.answer_text("openai", "b")
    got = [tuple(r) for r in df.select(t1, e1, t2, e2).collect()]
    assert got[0] == ("hi!", None, "yo", None) and [g[1] for g in got[1:]] == ["incomplete", "unexpected content"] and [g[3] for g in got[1:]] == ["incomplete", "empty"]


def test_requests(spark):
    df = spark.createDataFrame([([("system", "a"), ("user", "b"), ("system", "c")],)], "messages array<struct<role:string,content:string>>")
    system, rest = V.request_parts()
    r = df.select(system.alias("s"), rest.alias("r")).first()
    assert r["s"] == "a\n\nc" and [x["content"] for x in r["r"]] == ["b"]


def test_alias(spark):
    df = spark.createDataFrame([([("Utente", None, "a"), ("Agente", "b", None)],)], "messages array<struct<sender:string,testo:string,text:string>>")
    assert [x["text"] for x in df.select(V.renamed().alias("m")).first()["m"]] == ["a", "b"]
