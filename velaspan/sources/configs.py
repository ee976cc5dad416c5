"""Configurations of generation and experiments: read once by the driver, refused as a whole if anything in them is wrong."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from velaspan.operators.matching import MASKING_TYPES, TYPES
from velaspan.operators.native import Model, models_from

# Entities that a scenario may ask for, respondents, policies and their states, and how entities are sampled.
ENTITIES = {"persona_1": "PERSON", "email_1": "EMAIL", "indirizzo_1": "ADDRESS", "cod_utente_1": "COD_UTENTE", "password_1": "PASSWORD", "num_pratica_1": "NUM_PRATICA", "phone_1": "PHONE"}
RESPONDENTS = ("imprese", "famiglie_individui", "altro")
POLICIES, POLICY_STATES = ("KEEP", "MASK", "GENERALIZE", "REVIEW"), ("APPROVED", "PROVISIONAL", "OPEN")
SOME, ALL = "sottoinsieme", "tutte"
STATIC_FIELDS = {"id", "riferimento", "tipo", "ipotesi_iniziale", "stato"}
BACKENDS = ("gliner", "gliner2", "transformers")


def _text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _texts(x) -> bool:
    return isinstance(x, list) and all(isinstance(v, str) and v for v in x)


def _length(x) -> bool:
    return type(x) is int and 1 <= x <= 64


def _read(path: str | Path) -> dict:
    out = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no object")
    return out


def scenario_faults(scenario: Mapping) -> list[str]:
    """What is wrong with one scenario."""
    entities = scenario.get("entita")
    known = _texts(entities) and set(entities) <= set(ENTITIES) and len(set(entities)) == len(entities)
    sampling, repeat, static = scenario.get("campionamento_entita", SOME), scenario.get("ripetere_agente", []), scenario.get("riferimenti_statici", [])
    right = {
        **{f: _text(scenario.get(f)) for f in ("id", "sezione", "situazione", "indicazioni_risposta")},
        "tipo_rispondente": scenario.get("tipo_rispondente") in RESPONDENTS,
        "scenario_catalogo": isinstance(scenario.get("scenario_catalogo"), str),
        "codici_psn_ammessi": _texts(scenario.get("codici_psn_ammessi")),
        "chiave_indagine": "chiave_indagine" in scenario and isinstance(scenario["chiave_indagine"], (str, type(None))),
        "entita": known,
        "campionamento_entita": sampling in (SOME, ALL),
        "ripetere_agente": isinstance(repeat, list) and len(set(repeat)) == len(repeat) and (not repeat or known and set(repeat) <= set(entities) and scenario.get("campionamento_entita") == ALL),
        "riferimenti_da_conservare": isinstance(scenario.get("riferimenti_da_conservare"), list),
        "riferimenti_statici": isinstance(static, list) and all(isinstance(r, dict) and set(r) == STATIC_FIELDS and r["ipotesi_iniziale"] in POLICIES and r["stato"] in POLICY_STATES for r in static),
    }
    return [field for field, ok in right.items() if not ok]


def read_scenarios(path: str | Path) -> list[dict]:
    """Checked scenarios of a catalogue, with different ids."""
    scenarios = _read(path).get("scenari")
    if not isinstance(scenarios, list) or not scenarios:
        raise ValueError("the catalogue has no scenarios")
    seen: set[str] = set()
    for s in scenarios:
        if faults := scenario_faults(s):
            raise ValueError(f"scenario {s.get('id')!r}: {', '.join(faults)}")
        if s["id"] in seen:
            raise ValueError(f"scenario {s['id']!r} is repeated")
        seen.add(s["id"])
    return scenarios


def scenarios(spark: SparkSession, path: str | Path) -> DataFrame:
    """The catalogue as a table: scenario, entities, all, respondent, codes, repeat."""
    rows = [(s["id"], s["entita"], s.get("campionamento_entita") == ALL, s["tipo_rispondente"], s["codici_psn_ammessi"], s.get("ripetere_agente", [])) for s in read_scenarios(path)]
    return spark.createDataFrame(rows, "scenario string, entities array<string>, all boolean, respondent string, codes array<string>, repeat array<string>")


def read_value_formats(path: str | Path) -> dict:
    """Checked formats of generated values."""
    rules = _read(path)
    user, case, password, phone = (rules.get(k, {}) for k in ("COD_UTENTE", "NUM_PRATICA", "PASSWORD", "PHONE"))
    some = lambda x, ok: isinstance(x, list) and bool(x) and all(ok(v) for v in x)
    right = {
        "versione": isinstance(rules.get("versione"), str),
        "COD_UTENTE": some(user.get("varianti"), lambda v: _length(v.get("cifre")) and isinstance(v.get("prefisso"), str)),
        "NUM_PRATICA": _length(case.get("cifre")) and _text(case.get("separatore")) and some(case.get("anni"), lambda y: isinstance(y, str) and len(y) == 2 and y.isascii() and y.isdigit()),
        "PASSWORD": some(password.get("lunghezze"), _length) and isinstance(password.get("alfabeto"), str) and bool(password["alfabeto"]),
        "PHONE": _length(phone.get("cifre")) and isinstance(phone.get("inizio"), str) and phone["inizio"].isdigit() and all(some(phone.get(f), lambda v: isinstance(v, str)) for f in ("separatori", "prefissi")),
    }
    if faults := [k for k, ok in right.items() if not ok]:
        raise ValueError(f"value formats: {', '.join(faults)}")
    return rules


class Experiment:
    """A checked experiment: its models, the types that are allowed, evaluated and in focus, and the paths of inputs and gold."""

    def __init__(self, config: Mapping):
        self.allowed = tuple(TYPES if str(config.get("formato", "")).startswith("detection-5.") else MASKING_TYPES)
        self.types = tuple(config.get("tipi_valutati", self.allowed))
        self.focus = tuple(config.get("tipi_focus_ner", ()))
        if config.get("contesto") != "messaggio_isolato":
            raise ValueError("messages are judged one by one only")
        if not self.types or set(self.types) - set(self.allowed) or set(self.focus) - set(self.types):
            raise ValueError("evaluated types must be allowed, focus types evaluated")
        for m in config["modelli"]:
            if m.get("backend") not in BACKENDS or type(m.get("max_tokens")) is not int or m["max_tokens"] < 2 or not m.get("repository") or not m.get("revision"):
                raise ValueError(f"model {m.get('nome')!r}: backend, token limit, repository or revision")
            if set(m["unisci_adiacenti"]) - set(self.allowed):
                raise ValueError(f"model {m['nome']!r} merges types that are not allowed")
        self.models: list[Model] = models_from(config)
        self.input, self.gold = config["input"], config["attese"]


def read_experiment(path: str | Path) -> Experiment:
    return Experiment(_read(path))
