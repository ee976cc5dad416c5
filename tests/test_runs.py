import json

import pytest

from velaspan import runs
from velaspan.__main__ import main
from velaspan.operators import matching as M
from velaspan.operators import native as N
from velaspan.operators import spans as S
from velaspan.operators import validation as V

CONV = [
    {"id": "a", "conversazione": [{"sender": "Utente", "testo": "scrivi ad anna@x.it"}, {"sender": "Agente", "testo": "ok"}]},
    {"id": "b", "conversazione": [{"sender": "Utente", "testo": "nulla"}]},
    {"id": "c", "conversazione": [{"sender": "Altro", "testo": "u@v.it"}]},
]
RULES = {"versione": "1", "regole": [{"nome": "mail", "tipo": "EMAIL", "priorita": 1, "pattern": "(?P<valore>[a-z]+@[a-z.]+)"}]}


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_regex_run_and_commands(spark, tmp_path, capsys):
    conv = lines(tmp_path / "c.jsonl", CONV)
    got = runs.predict_regex(runs.conversations(spark, conv), M.rules_from(RULES))
    assert {(r["id"], r["state"]) for r in got.outcomes.collect()} == {("a", "ok"), ("b", "ok"), ("c", "errore")}
    assert [(r["id"], r["value"]) for r in got.spans.collect()] == [("a", "anna@x.it")] and got.detections.count() == 1
    (tmp_path / "r.json").write_text(json.dumps(RULES))
    out = str(tmp_path / "out")
    assert main(["detect", "--input", conv, "--rules", str(tmp_path / "r.json"), "--output", out]) == 1
    with pytest.raises(SystemExit) as e:
        main(["detect", "--input", conv, "--rules", str(tmp_path / "r.json"), "--output", out])
    assert e.value.code == 2
    span = {"campo": "conversazione.0.testo", "start": 10, "end": 19, "tipo": "EMAIL", "testo": "anna@x.it"}
    good = lines(tmp_path / "c2.jsonl", CONV[:2])
    gold = lines(tmp_path / "g.jsonl", [{"id": "a", "annotazioni": [span]}, {"id": "b", "annotazioni": []}])
    pred = lines(tmp_path / "p.jsonl", [{"id": "a", "stato": "ok", "annotazioni": [span]}])
    assert main(["evaluate", "--input", good, "--gold", gold, "--predictions", pred, "--output", str(tmp_path / "rep.json")]) == 0
    rep = json.loads((tmp_path / "rep.json").read_text())
    assert rep["span_esatti_micro"]["tp"] == 1 and rep["fallimenti_tecnici"] == [{"id": "b", "state": "mancante", "error": None}] and rep["per_tipo"]["PHONE"]["f1"] is None
    assert main(["to-array", "--input", gold, "--output", str(tmp_path / "arr.json")]) == 0
    assert len(json.loads((tmp_path / "arr.json").read_text())) == 2


def test_models_are_isolated(spark, tmp_path):
    messages = runs.conversations(spark, lines(tmp_path / "c.jsonl", CONV[:2]))
    gold = spark.createDataFrame([("a", 0, 0, 6, "PERSON")], "id string, idx int, start int, end int, type string")
    model = N.Model("m", {"P": "PERSON"})

    def good():
        return lambda text: [{"label": "P", "start": 0, "end": 6, "score": 0.9}] if text.startswith("scrivi") else []

    def broken():
        raise RuntimeError("no weights")

    got = runs.compare_models(messages, gold, {"m": (model, good), "x": (model, broken)}, ["PERSON"], ["PERSON"])
    assert got.reports["m"]["span_esatti_micro"]["f1"] == 1.0 and got.reports["m"]["focus"]["tp"] == 1 and list(got.failed) == ["x"] and set(got.seconds) == {"m", "x"} and min(got.seconds.values()) >= 0


def test_checks_before_a_run(spark):
    prompts = spark.createDataFrame([("a", 1, "v", {"s": "h"}), ("b", 1, "v", {"s": "h"})], "id string, seed int, version string, hashes map<string,string>")
    assert runs.stale_prompts(prompts, 2, 1, "v", {"s": "h"}) == []
    assert runs.stale_prompts(prompts, 3, 2, "v", {"s": "z"}) == ["number", "seed", "sources"]
    assert runs.resume_differences({"endpoint": "http://x/", "n": 1}, {"endpoint": "http://x", "n": 2}) == ["n"]
    assert runs.endpoint("openai", None, "https://h/base") == "https://h/base/" and runs.endpoint("anthropic", None, "https://h/base") == "https://h/anthropic/"
    with pytest.raises(ValueError):
        runs.endpoint("openai")


def test_plain_replacement_and_older_treatments(spark):
    df = spark.createDataFrame([("{{A}} {{B}} {{A}}", {"{{A}}": "{{B}}"}), ("x", {})], "t string, v map<string,string>")
    assert [r[0] for r in df.select(S.replaced("t", "v")).collect()] == ["{{B}} {{B}} {{B}}", "x"]
    s = "array<struct<slot:string,type:string,substitute:string>>"
    one, two = ("{{A}}", "P", "[P]"), ("{{B}}", "P", "[P]")
    rows = [([one], [one], [], "r"), ([one], [two], [], "r"), ([one], [], [], "r"), ([one], [one], [], None)]
    got = spark.createDataFrame(rows, f"slots {s}, masked {s}, keep array<string>, reason string").select(V.treatment_error().alias("e")).collect()
    assert [r["e"] for r in got] == [None, "treatments", "treatments", "explanations"]


def test_report_commands(spark, tmp_path, capsys):
    conv = lines(tmp_path / "c.jsonl", [{"id": "a", "conversazione": [{"sender": "Utente", "testo": "in Via Po 5, Roma da Ada"}]}, {"id": "b", "conversazione": [{"sender": "Utente", "testo": "nulla"}]}])
    f = "conversazione.0.testo"
    span = lambda s, e, k, t: {"campo": f, "start": s, "end": e, "tipo": k, "testo": t}
    parts = {"street_type": {"start": 3, "end": 6, "text": "Via"}, "street_name": {"start": 7, "end": 9, "text": "Po"}, "house_number": {"start": 10, "end": 11, "text": "5"}, "municipality": {"start": 13, "end": 17, "text": "Roma"}}
    address = {"detection_id": "d", "field": f, "start": 3, "end": 17, "text": "Via Po 5, Roma", "type": "ADDRESS", "sources": [{"detector": "x"}], "metadata": {"address_components": parts}}
    where = lines(tmp_path / "d.jsonl", [{"id": "a", "detections": [address]}, {"id": "b", "detections": []}])
    gold = lines(tmp_path / "g.jsonl", [{"id": "a", "annotazioni": [span(13, 17, "LOCATION", "Roma"), span(21, 24, "PERSON", "Ada")]}, {"id": "b", "annotazioni": []}])
    one = lines(tmp_path / "p1.jsonl", [{"id": "a", "stato": "ok", "annotazioni": [span(13, 17, "LOCATION", "Roma")]}, {"id": "b", "stato": "ok", "annotazioni": []}])
    two = lines(tmp_path / "p2.jsonl", [{"id": "a", "stato": "ok", "annotazioni": [span(21, 24, "PERSON", "Ada")]}, {"id": "b", "stato": "ok", "annotazioni": []}])
    out = str(tmp_path / "a.json")
    assert main(["addresses", "--input", conv, "--gold", where, "--predictions", one, "--output", out]) == 0
    got = json.loads((tmp_path / "a.json").read_text())
    assert got["outcomes"] == {"municipality_only": 1} and got["details"][0]["residual_text"] == "ViaPo5" and got["technical_failures"] == []
    assert main(["bootstrap", "--input", conv, "--gold", gold, "--addresses", where, "--model", f"x={one}", "--model", f"y={two}", "--replicates", "20", "--output", str(tmp_path / "b.json")]) == 0
    boot = json.loads((tmp_path / "b.json").read_text())
    point = {(m["model"], m["metric"]): m["estimate"] for m in boot["models"]}
    assert point["x", "LOCATION.f1"] == 1.0 and point["y", "micro.recall"] == 0.5 and point["x", "address.character_coverage"] == 0.4 and {d["first"] for d in boot["paired_differences"]} == {"x"}
    lacking = lines(tmp_path / "p3.jsonl", [{"id": "a", "stato": "errore", "errore": "x"}, {"id": "b", "stato": "ok", "annotazioni": []}])
    with pytest.raises(SystemExit) as e:
        main(["bootstrap", "--input", conv, "--gold", gold, "--addresses", where, "--model", f"x={lacking}", "--output", str(tmp_path / "z.json")])
    assert e.value.code == 2


def test_export_plan_experiment_and_summary_commands(spark, tmp_path, capsys):
    f = "conversazione.0.testo"
    chat = {"conversazione": [{"sender": "Utente", "testo": "sono Ada"}], "trattamento_atteso": {"mascherare": [{"campo": f, "start": 5, "end": 8, "tipo": "PERSON", "id_entita": "n", "id_forma": "completa", "testo": "Ada", "sostituzione": "[P]"}]}}
    found = [{"field": f, "start": 5, "end": 8, "text": "Ada", "type": "PERSON", "sources": [{"detector": "x"}]}]
    source = lines(tmp_path / "r.jsonl", [{"id": "1", "stato": "valido", "chat": chat, "detection_attesa": found}, {"id": "2", "stato": "da_verificare", "errore": "e"}])
    for command, key in (("export", "detections"), ("export-masking", "exported")):
        assert main([command, "--input", source, "--output", str(tmp_path / command)]) == 0
        last = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert (last["records"], last["exported"], last["excluded"], last[key]) == (2, 1, 1, 1)
    twin = lines(tmp_path / "twin.jsonl", [{"id": "1", "stato": "valido"}, {"id": "1", "stato": "valido"}])
    with pytest.raises(SystemExit):
        main(["export", "--input", twin, "--output", str(tmp_path / "no")])
    from test_configs import EXPERIMENT, SCENARIO

    lines(tmp_path / "in.jsonl", [{"id": "a", "conversazione": [{"sender": "Utente", "testo": "Ada"}]}])
    lines(tmp_path / "go.jsonl", [{"id": "a", "annotazioni": [{"campo": f, "start": 0, "end": 3, "tipo": "PERSON", "testo": "Ada"}]}])
    (tmp_path / "e.json").write_text(json.dumps(EXPERIMENT | {"input": "in.jsonl", "attese": "go.jsonl"}))
    assert main(["experiment", "--config", str(tmp_path / "e.json"), "--root", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["models"] == ["m"]
    (tmp_path / "s.json").write_text(json.dumps({"scenari": [SCENARIO]}))
    plan = {"versione": "1", "totale": 4, "batch": [{"id": "b", "per_scenario_modalita": 2, "scenari": "all", "modalita": ["con_dati_personali", "senza_dati_personali"]}]}
    (tmp_path / "pl.json").write_text(json.dumps(plan))
    assert main(["plan", "--plan", str(tmp_path / "pl.json"), "--scenarios", str(tmp_path / "s.json"), "--output", str(tmp_path / "rows")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"b": 4}
    prompts = lines(tmp_path / "pr.jsonl", [{"id": "x", "seed": 1, "versione_prompt": "v"}, {"id": "y", "seed": 1, "versione_prompt": "v"}])
    answer = {"id": "x", "prompt": {"id": "x", "seed": 1, "versione_prompt": "v"}, "deployment": "m", "provider": "openai", "stato": "valido"}
    answers = lines(tmp_path / "an.jsonl", [answer])
    assert main(["summary", "--prompts", prompts, "--answers", answers, "--deployment", "m"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["valido"] == 1
    with pytest.raises(SystemExit):
        main(["summary", "--prompts", prompts, "--answers", lines(tmp_path / "an2.jsonl", [answer, answer]), "--deployment", "m"])
