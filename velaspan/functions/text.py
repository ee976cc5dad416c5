"""Scalar functions: cleaning, field addresses, span bounds, JSON strings.

Offsets are Unicode code points, half-open, as Spark's string functions count.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The field address of a message's text, and the separators outside a span's content.
FIELD = "conversazione.{}.testo"
FIELD_PATTERN = r"^conversazione\.(\d+)\.testo$"
SEPARATORS = " \t\r\n,;:"
SLOT = r"\{\{[^{}]+\}\}"


def collapse(c: Column) -> Column:
    """White space of any kind to single spaces, none at the ends; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """NFC; Spark has no function for it. For catalogues, not for corpora."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Python's title case, which also starts words after apostrophes and hyphens."""
    return texts.map(lambda t: None if t is None else t.title())


@F.pandas_udf(StringType())
def mail_local(texts: pd.Series) -> pd.Series:
    """The ASCII letters and dots of a name in lower case, accents dropped; 'utente' if none is left."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z.]", "", plain) or "utente"

    return texts.map(one)


def clean(c: Column) -> Column:
    """NFC, then :func:`collapse`."""
    return collapse(nfc(c))


def field_of(idx: Column) -> Column:
    return F.concat(F.lit("conversazione."), idx.cast("string"), F.lit(".testo"))


def message_index(field: Column) -> Column:
    """Message number of a field address; null for any other address."""
    return F.nullif(F.regexp_extract(field, FIELD_PATTERN, 1), F.lit("")).cast("int")


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def trimmed(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of a span's content without the separators at either end; equal if nothing is left."""
    own = slice_of(text, start, end)
    left = F.length(own) - F.length(F.ltrim(own, F.lit(SEPARATORS)))
    right = F.length(own) - F.length(F.rtrim(own, F.lit(SEPARATORS)))
    return F.least(start + left, end), F.greatest(F.least(start + left, end), end - right)


def json_string(c: Column) -> Column:
    """A JSON string literal; non-ASCII characters stay as they are; null is null."""
    body = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(body, F.lit(2), F.length(body) - 2))


def detection_id(record_id: Column | None, field: Column, start: Column, end: Column, kind: Column) -> Column:
    """'det_' and 16 hex digits of SHA-256 over the compact JSON list of a detection's key."""
    first = F.lit("null") if record_id is None else json_string(record_id)
    parts = [F.lit("["), first, F.lit(","), json_string(field), F.lit(","), start.cast("string"), F.lit(","), end.cast("string"), F.lit(","), json_string(kind), F.lit("]")]
    return F.concat(F.lit("det_"), F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16))


def word_character(c: Column) -> Column:
    """Whether a character is a letter or a number."""
    return c.rlike("^[\\p{L}\\p{N}]$")


def slots(text: Column) -> Column:
    """The distinct slots ({{...}}) of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SLOT), F.lit(0)))
