import hashlib
import json
import re

from pyspark.sql import functions as F

from velaspan.functions import text as T
from velaspan.operators import matching as M
from velaspan.operators import spans as S

KIND = "id string, idx int, start int, end int, type string"


def test_overlaps(spark):
    df = spark.createDataFrame([("a", 0, 0, 5, "X"), ("a", 0, 4, 6, "Y"), ("a", 0, 6, 7, "X"), ("a", 1, 4, 6, "X")], KIND)
    assert [(r["start"], r["prev_end"]) for r in S.overlap_violations(df).collect()] == [(4, 5)]
    assert S.overlap_pairs(df, df).where("start < b_start").count() == 1


def test_invalid_spans(spark):
    messages = spark.createDataFrame([("a", 0, "È Anna.")], "id string, idx int, text string")
    rows = [("a", 0, 2, 6, "P", "Anna"), ("a", 0, 2, 9, "P", None), ("a", 0, 0, 1, "Z", None), ("a", 3, 0, 1, "P", None), ("a", 0, 0, 1, "P", "E")]
    got = {(r["idx"], r["start"], r["end"]): r["reason"] for r in S.invalid_spans(spark.createDataFrame(rows, KIND + ", text string"), messages, ["P"]).collect()}
    assert got[(0, 2, 9)] == "bounds" and got[(3, 0, 1)] == "position" and "text" in got.values() or "field or type" in got.values()
    assert (0, 2, 6) not in got


def test_merge_unites_sources_and_keeps_the_first_metadata(spark):
    kind = "id string, field string, start int, end int, text string, type string, sources array<struct<detector:string,name:string>>, metadata map<string,string>, ord int"
    rows = [
        ("r", "conversazione.0.testo", 0, 4, "Anna", "PERSON", [("ner", "b")], {"k": "1"}, 0),
        ("r", "conversazione.0.testo", 0, 4, "Anna", "PERSON", [("ner", "a"), ("ner", "b")], {"k": "2"}, 1),
        ("r", "conversazione.0.testo", 0, 4, "Anna", "LOCATION", [("ner", "a")], None, 2),
    ]
    got = {r["type"]: r for r in S.merged(spark.createDataFrame(rows, kind)).collect()}
    assert [s["name"] for s in got["PERSON"]["sources"]] == ["b", "a"] and got["PERSON"]["metadata"] == {"k": "1"}
    want = json.dumps(["r", "conversazione.0.testo", 0, 4, "PERSON"], separators=(",", ":"))
    assert got["PERSON"]["detection_id"] == "det_" + hashlib.sha256(want.encode()).hexdigest()[:16]
    without = S.merged(spark.createDataFrame(rows, kind), with_record_id=False).where("type = 'PERSON'").first()
    want = json.dumps([None, "conversazione.0.testo", 0, 4, "PERSON"], separators=(",", ":"))
    assert without["detection_id"] == "det_" + hashlib.sha256(want.encode()).hexdigest()[:16]


def test_json_string(spark):
    values = ['a"b', "è\n🙂", "", None, "\\"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", T.json_string(F.col("v")).alias("j"))
    assert [r["j"] for r in df.orderBy("i").collect()] == [json.dumps(v, ensure_ascii=False) for v in values]


def test_neighbours_merge_over_commas_and_spaces_only(spark):
    text = "Via Roma 12, Milano e Ugo Neri"
    messages = spark.createDataFrame([("a", 0, text)], "id string, idx int, text string")
    kind = KIND + ", score double, native string"
    rows = [("a", 0, 0, 8, "LOCATION", 0.9, "STREET"), ("a", 0, 9, 11, "LOCATION", 0.8, "NUMBER"), ("a", 0, 13, 19, "LOCATION", 0.7, "CITY"), ("a", 0, 22, 25, "PERSON", 0.5, "NAME"), ("a", 0, 26, 30, "PERSON", 0.6, "SURNAME")]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r["start"], r["end"], r["score"], r["text"]) for r in S.adjacent_merged(df, messages, ("PERSON",), [("STREET", "NUMBER")]).collect())
    assert got == [(0, 11, 0.8, "Via Roma 12"), (13, 19, 0.7, "Milano"), (22, 30, 0.5, "Ugo Neri")]


def test_slots(spark):
    e = "array<struct<slot:string,value:string,type:string,entity_id:string>>"
    ent = [("{{N}}", "Ada", "PERSON", "n")]
    rows = [("x {{N}} y {{N}}", ent), ("{{Z}}", ent), ("{{N}} }}", ent), ("none", []), ("{{N}}", [("{{N}}", "", "PERSON", "n")]), ("a", ent + ent)]
    df = spark.createDataFrame(rows, f"text string, entities {e}").select(S.substituted("text", "entities").alias("r"))
    got = [r["r"] for r in df.collect()]
    assert got[0]["text"] == "x Ada y Ada" and [(s["start"], s["end"]) for s in got[0]["spans"]] == [(2, 5), (8, 11)] and got[0]["error"] is None
    assert [g["error"] for g in got[1:]] == ["unknown slot {{Z}}", "braces left over", None, "bad value of {{N}}", "repeated slot"]


def test_literals(spark):
    df = spark.createDataFrame([("a.b a.b axb", "a.b"), ("aaa", "aa"), ("x", "")], "text string, needle string").select(S.literal_spans("text", "needle").alias("s"))
    assert [[(x["start"], x["end"]) for x in r["s"]] for r in df.collect()] == [[(0, 3), (4, 7)], [(0, 2)], []]


def test_trimmed_bounds(spark):
    df = spark.createDataFrame([(" ,Anna; ", 0, 8), ("  ", 0, 2)], "t string, s int, e int")
    lo, hi = T.trimmed(F.col("t"), F.col("s"), F.col("e"))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(2, 6), (2, 2)]


def test_many_neighbours_of_a_long_text(spark):
    """Numbers of spans around a block of the sums; wide characters before them; a byte order mark is no gap."""
    for n in (1, 63, 64, 65, 129, 1000):
        words = [("Èva🙂" if i % 3 else "no") + str(i) for i in range(n)]
        text = "🙂 " + " ".join(words) + " Ugo \ufeffx A\ufeff B"
        rule = M.Rule("capital", "PERSON", 1, "(?<![^ ])(?P<valore>[A-ZÀ-Ý][^ ]*)", "")
        found = M.candidates(spark.createDataFrame([(text,)], "text string"), [rule])
        want = [m.span(1) for m in re.finditer(rule.pattern, text)]
        assert [(m["start"], m["end"]) for m in found.first()["found"]] == want
        tokens = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["type"].alias("type"), F.lit(1.0).alias("score"), m["type"].alias("native")))
        runs = []
        for a, b in want:
            if runs and text[runs[-1][1] : a].strip(" ,") == "":
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
        got = found.select(S.adjacent_runs(tokens, F.col("text"), ("PERSON",)).alias("r")).first()["r"]
        assert [(r["start"], r["end"], r["text"]) for r in got] == [(a, b, text[a:b]) for a, b in runs]


def test_a_byte_order_mark_between_spans_is_no_gap(spark):
    text = "A\ufeffB, C"
    messages = spark.createDataFrame([("a", 0, text)], "id string, idx int, text string")
    rows = [("a", 0, a, a + 1, "PERSON", 1.0, "N") for a in (0, 2, 5)]
    got = S.adjacent_merged(spark.createDataFrame(rows, KIND + ", score double, native string"), messages, ("PERSON",)).collect()
    assert sorted(r["text"] for r in got) == ["A", "B, C"]
