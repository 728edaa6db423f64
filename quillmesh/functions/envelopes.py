"""Reading JSON envelopes as variants: typed fields, and a fingerprint of the payload.

A variant keeps a field's JSON type, so a number where a string belongs is told from a string, and a
wrong type from an absent field. A line is parsed once; its fields are then variants of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1


def parsed(raw: Column) -> Column:
    """The envelope as a variant; null unless it is JSON without repeated keys."""
    return F.try_parse_json(raw)


def members(envelope: Column) -> Column:
    """The members of an object by their names; null for what is no object."""
    return F.try_variant_get(envelope, "$", "map<string,variant>")


def named_members(envelope: Column, names: list[str]) -> Column:
    """The members of an object that have one of ``names``, as a struct: they are found in one pass and none is searched for. Null for what is no object."""
    fields = ",".join(f"`{n.replace('`', '``')}`:variant" for n in names)
    return F.try_variant_get(envelope, "$", f"struct<{fields}>")


def kind(field: Column) -> Column:
    """JSON type of a field; null if it is absent or null."""
    return F.nullif(F.schema_of_variant(field), F.lit("VOID"))


def string_value(field: Column, kind: Column) -> Column:
    """A field's value if it is a string."""
    return F.when(kind == "STRING", F.try_variant_get(field, "$", "string"))


def int_value(field: Column, kind: Column) -> Column:
    """A field's value if it is a whole number of 32 bits, written as one."""
    return F.when(kind == "BIGINT", F.try_variant_get(field, "$", "int"))


def strings_value(field: Column, kind: Column) -> Column:
    """A field's distinct values if it is an array of strings; null if it is absent or something else."""
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.array_distinct(F.try_variant_get(field, "$", "array<string>")))


def json_value(field: Column, kind: Column) -> Column:
    """A field of any type as JSON text; null if absent or null."""
    return F.when(kind.isNotNull(), F.to_json(field))


def is_blank(c: str) -> Column:
    """Whether a text is null or has nothing but white space, tabs and line breaks included."""
    return ~F.coalesce(F.col(c).rlike("[^\\s\\p{Z}\\p{Cc}]"), F.lit(False))


#: A token of JSON text: a string, a number, or what stands between them but white space.
_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?|[a-z]+|[{}:,]|\[|\]'
_NUMBER = "^(-?)([0-9]+)(?:[.]([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def exact_number(token: Column) -> Column:
    """A JSON number as sign, digits without zeros at either end, and a power of ten: equal for equal numbers, whatever their length. An exponent beyond 18 digits stays as it is written."""
    part = lambda i: F.regexp_extract(token, _NUMBER, i)
    all_ = F.concat(part(2), part(3))
    left = F.regexp_replace(all_, "^0+", "")
    digits = F.regexp_replace(left, "0+$", "")
    given = F.when(part(4) == "", F.lit(0)).otherwise(F.when(F.length(part(4)) <= 18, F.try_to_number(F.regexp_replace(part(4), "[+]", ""), F.lit("S999999999999999999"))))
    power = given - F.length(part(3)) + F.length(left) - F.length(digits)
    return F.when(digits == "", F.lit("0")).otherwise(F.coalesce(F.concat(part(1), digits, F.lit("e"), power.cast("long").cast("string")), F.lower(token)))


#: Length up to which a text without escapes is read by plain patterns.
_SHORT = 1 << 12


#: Text without digits outside strings, and text whose numbers are whole, have 18 digits at most and don't end in 0; both without escapes.
_WORDS = '^(?:[^"0-9-]++|"[^"]*+")*+$'
_WHOLE = '^(?:[^"0-9-]++|"[^"]*+"|-?[0-9]{0,17}[1-9](?![0-9.eE]))*+$'


def canonical_text(raw: Column, envelope: Column | None = None) -> Column:
    """JSON text with sorted keys and exact numbers; null for text that is no JSON. ``envelope``: its variant, where it is parsed already.

    Every string, keys too, gets an s in front, and every number becomes a string with an n in front, so that no number passes through a double and none equals a string; the variant sorts the keys.
    The variant's own text is marked by a pattern or two where the raw text is short, without escapes, and its numbers are whole and don't end in 0; others are marked token by token and parsed again, which takes several times as long.
    """
    token = lambda t: F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substr(t, F.lit(2)))).when(t.rlike("^[-0-9]"), F.concat(F.lit('"n'), exact_number(t), F.lit('"'))).otherwise(t)
    by_token = F.to_json(F.try_parse_json(F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_TOKEN), 0), token), "")))
    plain = ~raw.contains("\\") & (F.length(raw) <= _SHORT)
    strings = F.regexp_replace(F.to_json(parsed(raw) if envelope is None else envelope), '"([^"]*+)"', '"s$1"')
    numbers = F.regexp_replace(strings, r'\G((?:[^"0-9-]++|"[^"]*+")*+)(-?[0-9]++)', '$1"n$2e0"')
    return F.when(plain & raw.rlike(_WORDS), strings).when(plain & raw.rlike(_WHOLE), numbers).otherwise(by_token)


def fingerprint(raw: Column, well_formed: Column, envelope: Column | None = None) -> Column:
    """Digest of the whole envelope: key order, white space and the way in which a number is written don't count; array order and explicit nulls do."""
    return F.sha2(F.coalesce(F.when(well_formed, canonical_text(raw, envelope)), F.trim(raw), F.lit("")), 256)
