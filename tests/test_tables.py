import json

import pytest
from pyspark.sql import functions as F

from velaspan.operators import export as X
from velaspan.operators import matching as M
from velaspan.sources import tables as S
from velaspan.streaming import detect as D


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert {r["id"] for r in S.json_lines(spark, str(p), "id string").collect()} == {"a", "b"}
    p.write_text('{"id": "a"}\n\n{"id": \n')
    assert [(r["line"], r["content"]) for r in S.malformed_lines(spark, str(p)).collect()] == [(3, '{"id": ')]
    with pytest.raises(Exception):
        S.json_lines(spark, str(p), "id string").collect()


def test_catalogues(spark, tmp_path):
    w = lambda n, t: (tmp_path / n).write_text(t, encoding="utf-8") and str(tmp_path / n)
    names = w("names.txt", "﻿Ada\n  Ugo  Maria \nAda\n\nJosé\n")
    assert [r["value"] for r in S.text_list(spark, names).collect()] == ["Ada", "José", "Ugo Maria"]
    towns = w("towns.csv", "﻿Codice Comune (alfanumerico);Comune;Codice catasto\n058091;Roma;H501\n015146;Milano;F205\n")
    streets = w("streets.csv", "CODICE_ISTAT;COMUNE;ODONIMO\n058091;Roma;VIA APPIA\n058091;Roma;VIA  APPIA\n015146;Milano;CORSO COMO\n")
    surveys = w("surveys.csv", 'codice_psn;nome_indagine;tipo_rispondente\nA1;"Uno; due";imprese\nB2;Due;altro\n')
    got = S.catalogue(spark, names, names, towns, streets, surveys)
    stats = got["stats"].first().asDict()
    assert stats["street_rows"] == 3 and stats["streets"] == 2 and stats["duplicates_removed"] == 1 and stats["surveys"] == 2
    assert got["surveys"].first()["name"] == "Uno; due"
    assert {r["name"] for r in S.municipalities(spark, towns).collect()} == {"Roma", "Milano"}
    for bad in ("999999;Roma;X\n", "058091;Rome;X\n", "058091;Roma;\n"):
        with pytest.raises(ValueError):
            S.catalogue(spark, names, names, towns, w("bad.csv", "CODICE_ISTAT;COMUNE;ODONIMO\n" + bad), surveys)
    with pytest.raises(ValueError):
        S.delimited(spark, towns, ["Nope"])
    with pytest.raises(ValueError):
        S.surveys(spark, w("s.csv", "codice_psn;nome_indagine;tipo_rispondente\nA;x;imprese\nA;y;imprese\n"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    out = str(tmp_path / "out")
    S.write_json_lines(df, out)
    with pytest.raises(Exception):
        S.write_json_lines(df, out)
    S.replace_json_lines(df.union(df), out)
    assert spark.read.json(out).count() == 2
    assert [S.append_segment(df, str(tmp_path / "seg")) for _ in range(2)] == [1, 2] and spark.read.json(str(tmp_path / "seg")).count() == 2
    S.write_report({"a": 1}, tmp_path / "r.json")
    with pytest.raises(FileExistsError):
        S.write_report({}, tmp_path / "r.json")
    assert json.loads(S.json_array(df).first()["value"]) == [{"i": 1, "t": "a"}]
    assert len(S.file_hashes(spark, out).first()["sha256"]) == 64


D_KIND = "struct<field:string,start:int,end:int,text:string,type:string,sources:array<struct<detector:string>>>"


def test_export(spark, tmp_path):
    m = [("Utente", "Anna qui"), ("Agente", "ok")]
    det = [("conversazione.0.testo", 0, 4, "Anna", "PERSON", [("s",)]), ("conversazione.1.testo", 0, 2, "ok", "ROLE", [("s",)])]
    rows = [
        ("h:1", "1", "h", "valido", m, det), ("h:2", "2", "h", "errore_api", m, det), ("h:3", "3", "h", "valido", m, []),
        ("h:4", "4", "h", "valido", m, [("conversazione.0.testo", 0, 4, "Anne", "PERSON", [("s",)])]), ("h:5", "5", "h", "valido", [], []), ("h:6", "6", "h", "valido", [("Altro", "x")], []), ("h:7", "7", "h", "valido", m, None),
    ]
    df = spark.createDataFrame(rows, f"key string, id string, source_sha256 string, state string, messages array<struct<sender:string,text:string>>, detections array<{D_KIND}>")
    e = X.exported(df)
    assert {r["id"]: r["reason"] for r in e.excluded.collect()} == {"2": "state", "4": "detection", "5": "no messages", "6": "message", "7": "no detections"}
    man = e.manifest.first()
    assert (man["records"], man["exported"], man["excluded"], man["negative"], man["detections"], man["categories"], man["roles"]) == (7, 2, 5, 1, 2, {"PERSON": 1, "ROLE": 1}, {"Utente": 1, "Agente": 1})
    assert {r["id"]: len(r["annotazioni"]) for r in e.ner.collect()} == {"h:1": 1, "h:3": 0}
    e.write(str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export" / "inputs")).count() == 2


def test_reuse(spark):
    prompts = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "id string, deployment string")
    answers = spark.createDataFrame([("a", "m", "valido", "x"), ("b", "other", "valido", "x"), ("c", "m", "errore_api", None)], "id string, deployment string, state string, answer string")
    reused, todo, problems = X.reusable(prompts, answers, ["deployment"])
    assert {r["id"] for r in todo.collect()} == {"b"} and [(r["id"], r["problem"]) for r in problems.collect()] == [("c", "uncertain")]
    assert {r["id"] for r in X.reusable(prompts, answers, ["deployment"], retry_failed=True)[1].collect()} == {"b", "c"}
    assert X.uniform(prompts, ["deployment"]).first()["uniform"]
    assert X.run_summary(prompts, answers).first().asDict() == {"prompts": 3, "answers": 3, "valido": 2, "da_verificare": 0, "errore_api": 1}


def test_reviews_and_masking(spark):
    records = spark.createDataFrame([("h", "1"), ("h", "2")], "source_sha256 string, id string")
    notes = spark.createDataFrame([("h", "1", "b"), ("h", "1", "a"), ("z", "1", "q")], "sha256 string, id string, note string")
    assert {r["id"]: (r["review"], r["notes"]) for r in X.reviewed(records, notes).collect()} == {"1": ("segnalato", ["a", "b"]), "2": ("non_revisionato", None)}
    assert X.stray_notes(notes, spark.createDataFrame([("h",)], "sha256 string")).count() == 1


def test_stream_detects_each_message_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rules = [M.Rule("mail", "EMAIL", 1, r"(?P<valore>[a-z]+@[a-z.]+)")]
    for i, text in enumerate(("a@b.it e c@d.it", "x@y.it")):
        spark.createDataFrame([(str(i), [("Utente", text)])], D.CONVERSATION).coalesce(1).write.mode("append").json(src)
        D.detect_stream(D.arriving(spark, src), rules, out, ck).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["a@b.it", "c@d.it", "x@y.it"]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:59", "a"), ("2024-01-01 00:01:01", "b"), ("2024-01-01 01:00:00", "z")]
    path = str(tmp_path / "ev")
    spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").write.parquet(path)
    s = spark.readStream.schema("ts timestamp, k string").parquet(path)
    q = D.windowed_counts(s, "ts", "k", "1 minute", "5 minutes").writeStream.format("memory").queryName("wc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("wc").collect()} >= {("a", 2), ("b", 1)}


def test_masking_export(spark):
    span = "struct<field:string,start:int,end:int,type:string,text:string,substitute:string>"
    kind = f"key string, id string, source_sha256 string, state string, error string, messages array<struct<sender:string,text:string>>, spans array<{span}>"
    talk, f = [("Utente", "sono Ada e Bo")], "conversazione.0.testo"
    good = (f, 5, 8, "PERSON", "Ada", "[P]")
    rows = [
        ("h:1", "1", "h", "valido", None, talk, [good, ("metadati.descrizione", 0, 1, "PERSON", "x", "[P]")]), ("h:2", "2", "h", "valido", None, talk, []), ("h:3", "3", "h", "errore", "boom", talk, []), ("h:4", "4", "h", "valido", None, [("X", "a")], []),
        ("h:5", "5", "h", "valido", None, talk, [(f, 5, 8, "PERSON", "Eva", "")]), ("h:6", "6", "h", "valido", None, talk, [good, (f, 7, 9, "PERSON", "a ", "")]), ("h:7", "7", "h", "valido", None, talk, [("altro", 0, 1, "PERSON", "s", "")]),
        ("h:8", "8", "h", "valido", None, talk, [(f, 5, 8, "LOCATION", "Ada", "")]), ("h:9", "9", "h", "valido", None, [], []),
    ]
    notes = spark.createDataFrame([("h", "1", "dubbio")], "sha256 string, id string, note string")
    got = X.masking_exported(spark.createDataFrame(rows, kind), notes)
    assert {r["id"]: [a["text"] for a in r["annotazioni"]] for r in got.gold.collect()} == {"h:1": ["Ada"], "h:2": []}
    assert {r["id"]: r["reason"] for r in got.excluded.collect()} == {"3": "boom", "4": "message", "5": "span", "6": "overlap", "7": "field", "8": "span", "9": "no messages"}
    m = got.manifest.first()
    assert (m["records"], m["exported"], m["excluded"], m["left_out"], m["flagged"], m["categories"]) == (9, 2, 7, 1, 1, {"PERSON": 1})
    assert {r["id"]: (r["review"], r["notes"]) for r in got.provenance.collect()} == {"1": ("segnalato", ["dubbio"]), "2": ("non_revisionato", None)}


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(("{" if i in (7, 4000, 9998) else "{}") + "\n" for i in range(10_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(r["line"] for r in S.malformed_lines(spark, str(path)).collect()) == [8, 4001, 9999]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_review_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sha256": "h", "segnalazioni": [{"id": "1", "osservazione": "dubbio"}, {"id": "2", "osservazione": "x"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"sha256": "k", "segnalazioni": []}))
    paths = [str(tmp_path / n) for n in ("a.json", "b.json")]
    assert sorted(tuple(r) for r in S.reviews(spark, paths).collect()) == [("h", "1", "dubbio"), ("h", "2", "x")]
    with pytest.raises(ValueError):
        S.reviews(spark, [paths[0], paths[0]])
