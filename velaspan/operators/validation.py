"""Checks of generated conversations: parsing, repairs, structure, and signals for review.

``chats``: id, messages array<struct<sender,text>>, description; ``plans`` adds
slots array<struct<slot,value,type,entity_id>>, references
array<struct<reference_id,reference,type>>, repeat array<string> and exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velaspan.functions import text as T

# The states that a summary must not claim by itself, and the words that introduce a case number.
CLAIMS = ("in compilazione", "in bozza", "in sola lettura")
CASE_NUMBER = r"(?iU)\b(?:prot\.?\s*|protocollo\s*|pratica\s*|ticket\s*)(?:(?:numero|num\.?|n\.?|n[°º])\s*)?[:#]?\s*(?<valore>[0-9][A-Za-z0-9/-]*)\b"
FENCE = r"(?s)^```(?:json)?[ \t]*\r?\n(.*?)\r?\n```$"
USER, AGENT = "Utente", "Agente"
MODES = ("con_dati_personali", "senza_dati_personali")


def unfenced(answer: Column) -> tuple[Column, Column]:
    """(content, whether a single code fence was taken off) of a model's answer."""
    own = F.regexp_replace(answer, "(?U)^\\s+|\\s+$", "")
    fenced = own.rlike(FENCE)
    return F.when(fenced, F.regexp_extract(own, FENCE, 1)).otherwise(own), fenced


def parsed(answers: DataFrame, column: str, schema: str) -> DataFrame:
    """``answers`` with ``fenced``, ``chat`` (null if the JSON is malformed) and ``keys`` of its top level."""
    content, fenced = unfenced(F.col(column))
    got = answers.withColumns({"fenced": fenced, "_content": content})
    valid = F.try_parse_json("_content").isNotNull()
    return got.withColumns({"chat": F.when(valid, F.from_json("_content", schema)), "keys": F.when(valid, F.array_sort(F.map_keys(F.from_json("_content", "map<string,string>"))))}).drop("_content")


def repaired(messages: str = "messages") -> Column:
    """Messages without blank ones that stand before a non-blank one of the same sender."""
    m = F.col(messages)
    blank = lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == ""
    follows = lambda x, i: F.coalesce(F.get(m, i + 1)["sender"] == x["sender"], F.lit(False)) & ~F.coalesce(blank(F.get(m, i + 1)), F.lit(True))
    return F.filter(m, lambda x, i: ~(blank(x) & follows(x, i)))


def repair_log(messages: str = "messages") -> Column:
    """What :func:`repaired` takes out: array of (message, what), messages counted from 1."""
    m = F.col(messages)
    blank = lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == ""
    gone = lambda x, i: blank(x) & F.coalesce(F.get(m, i + 1)["sender"] == x["sender"], F.lit(False)) & ~F.coalesce(blank(F.get(m, i + 1)), F.lit(True))
    return F.filter(F.transform(m, lambda x, i: F.when(gone(x, i), F.struct((i + 1).alias("message"), F.lit("blank before the same sender").alias("what")))), lambda x: x.isNotNull())


def schema_error(content: str, fixed: Column, mode: str | None = None, slots: str = "slots", older: bool = False) -> Column:
    """The first way in which a chat's JSON (a text column) is not of its exact shape, or null.

    ``fixed``: map of metadata that must stand there unchanged; the description
    is the one field beside them. The older format has a third part. With
    ``mode`` (a column), slots must be there in the mode with personal data,
    and in that mode only.
    """
    texts = "map<string,string>"
    keys = lambda m: F.array_sort(F.map_keys(m))
    are = lambda found, *names: F.coalesce(found == F.array(*map(F.lit, sorted(names))), F.lit(False))
    top = F.from_json(F.col(content), texts)
    part = lambda name, kind: F.from_json(F.try_element_at(top, F.lit(name)), kind)
    meta = part("metadati", texts)
    kept = F.forall(F.map_entries(fixed), lambda e: F.try_element_at(meta, e["key"]).eqNullSafe(e["value"]))
    wanted = F.array_sort(F.array_append(F.map_keys(fixed), F.lit("descrizione")))
    talk = part("conversazione", f"array<{texts}>")
    out = (
        F.when(~are(keys(top), "metadati", "conversazione", *(["trattamento_atteso"] if older else [])), "parts")
        .when(~F.coalesce(keys(meta) == wanted, F.lit(False)), "metadata")
        .when(~F.coalesce(kept, F.lit(False)), "fixed metadata")
        .when(talk.isNull() | F.exists(talk, lambda m: ~are(keys(m), "sender", "testo")), "messages")
    )
    if older:
        out = out.when(~are(keys(part("trattamento_atteso", texts)), "mascherare", "conservare", "motivazione"), "treatment")
    if mode:
        out = out.when(F.col(mode).isin(*MODES) & ((F.size(slots) > 0) != (F.col(mode) == MODES[0])), "mode")
    return out


def renamed(messages: str = "messages") -> Column:
    """Messages whose ``testo`` is missing take ``text`` for it; result has sender and text."""
    return F.transform(messages, lambda x: F.struct(x["sender"].alias("sender"), F.coalesce(x["testo"], x["text"]).alias("text")))


def dialogue(messages: str = "messages", sender: str | None = None) -> Column:
    own = F.col(messages) if sender is None else F.filter(messages, lambda x: x["sender"] == sender)
    return F.array_join(F.transform(own, lambda x: x["text"]), "\n")


def alternates(messages: str = "messages") -> Column:
    """Whether user and agent take turns from the first message on, none of them blank."""
    turn = F.transform(messages, lambda x, i: (x["sender"] == F.when(i % 2 == 0, USER).otherwise(AGENT)) & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""))
    return F.forall(turn, lambda ok: F.coalesce(ok, F.lit(False)))


def structural_error(min_messages: int = 6, agent_last: bool = True) -> Column:
    """The first structural problem of a chat, or null; over messages, description, slots and references."""
    talk = dialogue()
    every = F.concat_ws("\n", talk, F.coalesce("description", F.lit("")))
    found = T.slots(every)
    planned = F.transform("slots", lambda s: s["slot"])
    return (
        F.when(F.trim(F.coalesce("description", F.lit(""))) == "", "description")
        .when(F.size("messages") < 2, "too short")
        .when(~alternates(), "turns")
        .when((F.size("messages") < min_messages) | (F.lit(agent_last) & (F.element_at("messages", -1)["sender"] != AGENT)), "exchanges")
        .when(F.size(F.array_distinct(planned)) < F.size("slots"), "repeated slots")
        .when((F.size(F.array_except(found, planned)) > 0) | (F.size(F.array_except(planned, found)) > 0) | F.exists(planned, lambda s: ~F.contains(talk, s)), "slots")
        .when(F.exists("slots", lambda s: F.contains(every, s["value"])), "value instead of slot")
        .when(F.exists("references", lambda r: ~F.coalesce(F.contains(talk, r["reference"]), F.lit(False))), "references")
    )


def treatment_error(expected: str = "slots", masked: str = "masked", keep: str = "keep", reason: str = "reason") -> Column:
    """Older format: the planned treatments (slot, type, substitute) must be listed in full, explanations must be there."""
    wanted = F.transform(expected, lambda e: F.struct(e["slot"].alias("slot"), e["type"].alias("type"), e["substitute"].alias("substitute")))
    same = (F.size(masked) == F.size(wanted)) & F.forall(wanted, lambda w: F.exists(masked, lambda m: (m["slot"] == w["slot"]) & (m["type"] == w["type"]) & (m["substitute"] == w["substitute"])))
    return F.when(~F.coalesce(same, F.lit(False)), "treatments").when(F.col(keep).isNull() | F.exists(keep, lambda k: k.isNull()) | F.col(reason).isNull(), "explanations")


def revalidated(chats: DataFrame) -> DataFrame:
    """Stored chats checked again; the earlier verdict stays as ``previous`` (state, error)."""
    before = chats.withColumn("previous", F.struct("state", "error")).drop("state", "error")
    return prepared(before)


def coherence_signals() -> Column:
    """Claims of the description that the user never made."""
    said, summary = F.lower(dialogue(sender=USER)), F.lower("description")
    return F.filter(F.array(*map(F.lit, CLAIMS)), lambda c: F.contains(summary, c) & ~F.contains(said, c))


def coverage_signals(repeat: str = "repeat") -> Column:
    """Slots that agent and user must both use, the user first: those that break it, with how."""

    def first(slot: Column, sender: str) -> Column:
        at = F.transform("messages", lambda x, i: F.when((x["sender"] == sender) & F.contains(x["text"], slot), i))
        return F.array_min(at)

    def one(slot: Column) -> Column:
        u, a = first(slot, USER), first(slot, AGENT)
        return F.when(u.isNull() | a.isNull(), F.concat(slot, F.lit(": missing"))).when(a < u, F.concat(slot, F.lit(": agent first")))

    return F.filter(F.transform(repeat, one), lambda x: x.isNotNull())


def stray_numbers(text: Column) -> Column:
    """Case numbers that stand outside the slots of a text."""
    return F.regexp_extract_all(F.regexp_replace(text, T.SLOT, " SLOT_AUTORIZZATO "), F.lit(CASE_NUMBER), F.lit(1))


def prepared(chats: DataFrame) -> DataFrame:
    """Chats with repairs applied, ``error``, the three kinds of signals, and ``state``: errore, da_verificare or valido."""
    got = chats.withColumns({"_n": F.size("messages"), "repair_log": repair_log()}).withColumn("messages", repaired())
    every = F.concat(F.transform("messages", lambda x: x["text"]), F.array("description"))
    got = got.withColumns(
        {
            "repairs": F.col("_n") - F.size("messages"),
            "error": structural_error(),
            "coherence": coherence_signals(),
            "coverage": coverage_signals(),
            "stray": F.flatten(F.transform(every, stray_numbers)),
            "exchanges_found": F.floor(F.size("messages") / 2).cast("int"),
        }
    ).drop("_n")
    review = (F.size("coherence") > 0) | (F.size("coverage") > 0) | (F.size("stray") > 0)
    return got.withColumn("state", F.when(F.col("error").isNotNull(), "errore").when(review, "da_verificare").otherwise("valido")).withColumn("warning", F.col("exchanges_found") != F.col("exchanges"))


def answer_text(provider: str, response: str = "response") -> tuple[Column, Column]:
    """(text, error) of a stored answer (VARIANT) in one of two provider shapes; incomplete or empty answers are errors."""
    if provider == "anthropic":
        blocks = F.expr(f"variant_get({response}, '$.content', 'array<struct<type:string,text:string>>')")
        done = F.coalesce(F.expr(f"variant_get({response}, '$.stop_reason', 'string')") == "end_turn", F.lit(False))
        strange = F.exists(blocks, lambda b: ~b["type"].isin("text", "thinking", "redacted_thinking"))
        body = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
        error = F.when(~done, "incomplete").when(F.coalesce(strange, F.lit(False)), "unexpected content")
    elif provider == "openai":
        blocks = F.expr(f"flatten(transform(variant_get({response}, '$.output', 'array<struct<content:array<struct<type:string,text:string>>>>'), o -> coalesce(o.content, array())))")
        done = F.coalesce(F.expr(f"variant_get({response}, '$.status', 'string')") == "completed", F.lit(False))
        body = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "output_text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
        error = F.when(~done, "incomplete")
    else:
        raise ValueError(f"unknown provider {provider!r}")
    return body, F.coalesce(error, F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty"))


def provider_of(deployment: Column) -> Column:
    return F.when(F.lower(deployment).startswith("claude-"), "anthropic").otherwise("openai")


def request_parts(messages: str = "messages") -> tuple[Column, Column]:
    """(system text, other messages) of a prompt with role and content, for the API that keeps them apart."""
    pick = lambda role: F.filter(messages, lambda m: (m["role"] == "system") == F.lit(role))
    return F.array_join(F.transform(pick(True), lambda m: m["content"]), "\n\n"), pick(False)
