"""Strict reading of JSON message envelopes, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.barrier import hold
from lakewright.vocab import ENVELOPE_KEYS


def looks_like_object(raw: str) -> Column:
    """Whether a text begins and ends as a JSON object does."""
    return F.col(raw).rlike(r"^\s*\{") & F.rtrim(raw, F.lit(" \t\r\n")).endswith("}")


def parsed(df: DataFrame, raw: str, name: str = "envelope") -> DataFrame:
    """Adds the text ``raw`` as a variant where the whole of it is one JSON object; other rows are left out.

    The parser stops after the first value, so the text is read as the only element of an array: anything that
    follows the object then breaks the array, or is a second element. Each text is parsed once.
    """
    one = hold(df.where(looks_like_object(raw)), F.expr(f"try_parse_json(concat('[', `{raw}`, ']'))").alias("_array"))
    one = hold(one, F.expr("try_variant_get(_array, '$[0]', 'variant')").alias(name), F.expr("is_variant_null(coalesce(try_variant_get(_array, '$[1]', 'variant'), parse_json('null')))").alias("_alone"))
    return one.where(F.col(name).isNotNull() & F.col("_alone")).drop("_array", "_alone")


def fields(df: DataFrame, envelope: str = "envelope", name: str = "fields") -> DataFrame:
    """Adds map<string,variant> of the record's fields: those of ``payload``, or the top level without envelope keys.

    Rows with a payload that is no object are left out.
    """
    top = hold(df, F.expr(f"try_variant_get({envelope}, '$', 'map<string,variant>')").alias("_top"))
    flat = F.map_filter("_top", lambda k, _: ~k.isin(*ENVELOPE_KEYS))
    payload = F.expr("try_variant_get(try_element_at(_top, 'payload'), '$', 'map<string,variant>')")
    found = hold(top, F.when(F.map_contains_key("_top", F.lit("payload")), payload).otherwise(flat).alias(name))
    return found.where(F.col(name).isNotNull()).drop("_top")


def text_field(envelope: str, name: str) -> Column:
    """A top-level field as text."""
    return F.expr(f"try_variant_get({envelope}, '$.{name}', 'string')")


def uuid_hex(text: Column) -> Column:
    """The 32 lower-case hex digits of a UUID in any usual notation, NULL if it is none.

    Plain, upper case, in braces, as URN, without hyphens, with white space around.
    """
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"^(?:urn:)?(?:uuid:)?", "")
    inner = F.regexp_replace(bare, r"^\{\s*(.*?)\s*\}$", "$1")
    plain = F.regexp_replace(inner, r"^([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})$", "$1$2$3$4$5")
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)
