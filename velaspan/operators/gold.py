"""From a checked chat with slots to its concrete texts and the detections that are expected of it.

``chats``: id, messages array<struct<sender,text>>, description, slots
array<struct<slot,value,type,entity_id,...>> and references
array<struct<reference_id,reference,type>>. A slot of an address may carry
``address_variant`` and ``components``, a map of (start, end, text) within its
value. The two older formats have no references; one of them has ``keep``
array<string> and ``reason``, and slots with ``substitute`` and ``form``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velaspan.functions import text as T
from velaspan.operators import spans as S

# Where expected detections come from, and the fields of a chat beside its messages.
SLOT_SOURCE, REFERENCE_SOURCE = "synthetic_slot", "synthetic_reference"
DESCRIPTION, KEEP, REASON = "metadati.descrizione", "trattamento_atteso.conservare.", "trattamento_atteso.motivazione"
WHOLE_FORM = "completa"
_COMPONENTS = "map<string,struct<start:int,end:int,text:string>>"
_METADATA = f"struct<reference_id:string,address_variant:string,address_components:{_COMPONENTS}>"


@dataclass
class Gold:
    """Concrete messages (id, idx, sender, text), descriptions (id, description), what is expected, and (id, error) of chats that can't be filled."""

    messages: DataFrame
    descriptions: DataFrame
    expected: DataFrame
    errors: DataFrame


def _values_sql() -> str:
    return "map_from_entries(transform(slots, e -> struct(e.slot, e.value)))"


def _filled(fields: DataFrame) -> DataFrame:
    """Rows with a template's ``text`` and its chat's ``slots``: the concrete text, ``spans`` of slots and ``error``."""
    rest = [c for c in fields.columns if c != "text"]
    # not withColumn(): a filter by the text, spans or error would compute all of it again for each of them
    return fields.select(*rest, F.explode_outer(F.array(S.substituted("text", "slots"))).alias("_r")).select(*rest, F.col("_r.text").alias("text"), F.col("_r.spans").alias("spans"), F.col("_r.error").alias("error"))


def _messages(chats: DataFrame, *more: str) -> DataFrame:
    return chats.select("id", "slots", *more, F.posexplode("messages").alias("idx", "m")).select("id", "slots", *more, "idx", F.col("m.sender").alias("sender"), F.col("m.text").alias("text"))


def _errors(filled: DataFrame) -> DataFrame:
    return filled.where("error is not null").groupBy("id").agg(F.min("error").alias("error"))


def expected(chats: DataFrame) -> Gold:
    """Detections of a chat in the present format: slots with their entity's metadata, and literal references that are no slots.

    Components of an address are moved to where its value begins. Slots come
    before references, so a detection that is both has the slot's metadata.
    Everything up to the merge is a projection of a message.
    """
    has = {f.name for f in chats.schema["slots"].dataType.elementType.fields}
    extra = ("e.address_variant", "e.components") if {"address_variant", "components"} <= has else ("cast(null AS string)", f"cast(null AS {_COMPONENTS})")
    filled = _filled(_messages(chats, "references"))
    moved = "map_from_entries(transform(map_entries({c}), c -> struct(c.key, named_struct('start', int(s.start + c.value.start), 'end', int(s.start + c.value.end), 'text', c.value.text))))"
    metadata = (
        f"cast(transform(array(get(filter(slots, e -> e.entity_id = s.entity_id), 0)), e -> if(s.type = 'ADDRESS' AND {extra[1]} IS NOT NULL,"
        f" named_struct('reference_id', s.entity_id, 'address_variant', {extra[0]}, 'address_components', {moved.format(c=extra[1])}),"
        f" named_struct('reference_id', s.entity_id, 'address_variant', null, 'address_components', null)))[0] AS {_METADATA})"
    )
    item = "named_struct('start', {s}.start, 'end', {s}.end, 'text', {text}, 'type', {type}, 'sources', array(named_struct('detector', '{source}')), 'metadata', {metadata}, 'ord', named_struct('a', {a}, 'b', {b}, 'c', {c}))"
    slots = "transform(spans, (s, i) -> " + item.format(s="s", text="s.value", type="s.type", source=SLOT_SOURCE, metadata=metadata, a=0, b="idx", c="i") + ")"
    plain = f"cast(named_struct('reference_id', r.reference_id, 'address_variant', null, 'address_components', null) AS {_METADATA})"
    one = item.format(s="s", text="r.reference", type="r.type", source=REFERENCE_SOURCE, metadata=plain, a=1, b="k", c="idx")
    named = "coalesce(references, array())"
    # each reference's places as detections
    refs = f"flatten(transform({named}, (r, k) -> transform(if(exists(slots, e -> e.entity_id = r.reference_id), cast(array() AS array<struct<start:int,end:int>>), {S.literal_sql('text', 'r.reference')}), s -> {one})))"
    rows = filled.where("error is null").select("id", T.field_of(F.col("idx")).alias("field"), F.inline(F.expr(f"concat({slots}, {refs})")))
    merged = S.merged(rows, with_record_id=False)
    return Gold(filled.select("id", "idx", "sender", "text"), chats.select("id", S.replaced("description", _values_sql()).alias("description")), merged, _errors(filled))


def replaced_only(chats: DataFrame) -> Gold:
    """The format with a channel: values take the place of slots, and nothing is annotated."""
    rows = _messages(chats).withColumn("text", S.replaced("text", _values_sql()))
    none = rows.select("id").limit(0)
    return Gold(rows.select("id", "idx", "sender", "text"), chats.select("id", S.replaced("description", _values_sql()).alias("description")), none, none.withColumn("error", F.lit("")))


def masked(chats: DataFrame) -> Gold:
    """The older masking format: spans of every field, explanations too: id, field, start, end, type, entity_id, form, text, substitute."""
    fields = F.concat(
        F.transform("messages", lambda m, i: F.struct(T.field_of(i).alias("field"), m["text"].alias("text"))),
        F.array(F.struct(F.lit(DESCRIPTION).alias("field"), F.col("description").alias("text"))),
        F.transform("keep", lambda t, i: F.struct(F.concat(F.lit(KEEP), i.cast("string")).alias("field"), t.alias("text"))),
        F.array(F.struct(F.lit(REASON).alias("field"), F.col("reason").alias("text"))),
    )
    filled = _filled(chats.select("id", "slots", "messages", F.explode(fields).alias("f")).select("id", "slots", "messages", "f.field", "f.text"))
    rows = filled.where("error is null").select("id", "field", "slots", F.explode("spans").alias("s"))
    entity = lambda name: F.get(F.filter("slots", lambda e: e["entity_id"] == F.col("s.entity_id")), F.lit(0))[name]
    has = {f.name for f in chats.schema["slots"].dataType.elementType.fields}
    form = F.coalesce(entity("form"), F.lit(WHOLE_FORM)) if "form" in has else F.lit(WHOLE_FORM)
    spans = rows.select("id", "field", "s.start", "s.end", "s.type", "s.entity_id", form.alias("form"), F.col("s.value").alias("text"), entity("substitute").alias("substitute"))
    index = T.message_index(F.col("field"))
    talk = filled.where(index.isNotNull()).select("id", index.alias("idx"), F.get("messages", index)["sender"].alias("sender"), "text")
    return Gold(talk, filled.where(F.col("field") == DESCRIPTION).select("id", F.col("text").alias("description")), spans, _errors(filled))
