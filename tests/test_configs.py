import copy
import json

import pytest

from velaspan.sources import configs as C

SCENARIO = {
    "id": "s", "sezione": "a", "situazione": "b", "indicazioni_risposta": "c", "tipo_rispondente": "imprese", "scenario_catalogo": "x", "codici_psn_ammessi": ["IST-1"], "chiave_indagine": None,
    "entita": ["persona_1", "email_1"], "campionamento_entita": "tutte", "ripetere_agente": ["email_1"], "riferimenti_da_conservare": [], "riferimenti_statici": [{"id": "r", "riferimento": "x", "tipo": "OFFICE", "ipotesi_iniziale": "KEEP", "stato": "OPEN"}],
}
FORMATS = {
    "versione": "1", "COD_UTENTE": {"varianti": [{"prefisso": "U", "cifre": 8}]}, "NUM_PRATICA": {"cifre": 6, "separatore": "/", "anni": ["25"]}, "PASSWORD": {"lunghezze": [8], "alfabeto": "ab1"},
    "PHONE": {"cifre": 9, "inizio": "3", "separatori": [""], "prefissi": [""]},
}
EXPERIMENT = {
    "formato": "detection-5.0", "contesto": "messaggio_isolato", "input": "i", "attese": "g", "tipi_valutati": ["PERSON", "LOCATION"], "tipi_focus_ner": ["PERSON"],
    "modelli": [{"nome": "m", "backend": "gliner", "soglia": 0.5, "max_tokens": 64, "repository": "r", "revision": "v", "etichette": {"P": "PERSON", "O": None}, "unisci_adiacenti": ["PERSON"]}],
}


def changed(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_scenarios(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"versione": "1", "scenari": [SCENARIO, SCENARIO | {"id": "t", "campionamento_entita": "sottoinsieme", "ripetere_agente": []}]}))
    rows = {r["scenario"]: r for r in C.scenarios(spark, path).collect()}
    assert rows["s"]["all"] and not rows["t"]["all"] and rows["s"]["entities"] == ["persona_1", "email_1"] and rows["s"]["codes"] == ["IST-1"]
    path.write_text(json.dumps({"scenari": [SCENARIO, SCENARIO]}))
    with pytest.raises(ValueError, match="repeated"):
        C.read_scenarios(path)
    path.write_text(json.dumps({"scenari": []}))
    with pytest.raises(ValueError):
        C.read_scenarios(path)


@pytest.mark.parametrize(
    "field, value",
    [("id", " "), ("sezione", 3), ("tipo_rispondente", "x"), ("scenario_catalogo", None), ("codici_psn_ammessi", [""]), ("chiave_indagine", KeyError), ("chiave_indagine", 1), ("entita", ["x"]), ("entita", ["email_1", "email_1"]),
     ("campionamento_entita", "x"), ("ripetere_agente", ["phone_1"]), ("campionamento_entita", "sottoinsieme"), ("riferimenti_da_conservare", None), ("riferimenti_statici", [{"id": "r"}])],
)
def test_faulty_scenarios(field, value):
    assert C.scenario_faults(SCENARIO) == [] and C.scenario_faults(changed(SCENARIO, [field], value))


@pytest.mark.parametrize(
    "path, value",
    [(["versione"], 1), (["COD_UTENTE", "varianti"], []), (["COD_UTENTE", "varianti", 0, "cifre"], 0), (["NUM_PRATICA", "cifre"], 65), (["NUM_PRATICA", "anni"], ["2025"]), (["NUM_PRATICA", "separatore"], ""), (["PASSWORD", "lunghezze"], []),
     (["PASSWORD", "alfabeto"], ""), (["PHONE", "inizio"], "a"), (["PHONE", "prefissi"], []), (["PHONE"], KeyError)],
)
def test_faulty_formats(tmp_path, path, value):
    at = tmp_path / "f.json"
    at.write_text(json.dumps(FORMATS))
    assert C.read_value_formats(at)["versione"] == "1"
    at.write_text(json.dumps(changed(FORMATS, path, value)))
    with pytest.raises(ValueError):
        C.read_value_formats(at)


@pytest.mark.parametrize(
    "path, value",
    [(["contesto"], "x"), (["tipi_valutati"], ["X"]), (["tipi_focus_ner"], ["EMAIL"]), (["modelli"], []), (["modelli", 0, "backend"], "x"), (["modelli", 0, "max_tokens"], 1), (["modelli", 0, "revision"], ""), (["modelli", 0, "soglia"], 2),
     (["modelli", 0, "etichette"], {"P": "X"}), (["modelli", 0, "unisci_adiacenti"], ["X"]), (["modelli", 0, "nome"], "A b")],
)
def test_faulty_experiments(path, value):
    e = C.Experiment(EXPERIMENT)
    assert e.types == ("PERSON", "LOCATION") and [m.name for m in e.models] == ["m"]
    with pytest.raises(ValueError):
        C.Experiment(changed(EXPERIMENT, path, value))
    assert "PERSON" in C.Experiment({k: v for k, v in EXPERIMENT.items() if not k.startswith("tipi")} | {"formato": ""}).types
