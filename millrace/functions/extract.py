"""Tolerant parsing of model output and strict validation, over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import schema

_TRIM = r"(?s)^\s+|\s+$"


def _object(s: Column) -> Column:
    """The JSON object that the whole of ``s`` is, else null. Wrapped in an array, so that text behind the object is an error."""
    s = F.regexp_replace(s, _TRIM, "")
    v = F.when(s.startswith("{") & s.endswith("}"), F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))))
    one = F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(v, "$[0]", "variant"))


def unfenced(s: Column) -> Column:
    """Inside of a fenced block that is the whole text."""
    m = r"(?s)^\s*```[A-Za-z0-9_-]*\s*\n?(.*?)\s*```\s*$"
    return F.when(s.rlike(m), F.regexp_extract(s, m, 1))


def braced(s: Column) -> Column:
    """From the first brace to the last."""
    m = r"(?s)(\{.*\})"
    return F.when(s.rlike(m), F.regexp_extract(s, m, 1))


def extract_json(raw: Column) -> Column:
    """The object in a model's output as VARIANT: the whole text, a fenced block, or what stands between the outermost braces; never repaired."""
    return F.coalesce(_object(raw), _object(unfenced(raw)), _object(braced(raw)))


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def valid(v: Column) -> Column:
    """Whether an object has exactly the posting's keys with values of their types. Numbers in quotes are not numbers."""
    keys = F.json_object_keys(F.to_json(v))
    ok = (F.size(keys) == len(schema.FIELDS)) & (F.size(F.array_except(F.array(*map(F.lit, schema.FIELDS)), keys)) == 0)
    number = r"^(BIGINT|DECIMAL\(.*|DOUBLE|FLOAT)$"
    for f in schema.FIELDS:
        t = _type(F.try_variant_get(v, f"$.{f}", "variant"))
        null = t == "VOID"
        if f in schema.ENUMS:
            ok &= (t == "STRING") & F.coalesce(F.try_variant_get(v, f"$.{f}", "string").isin(*schema.ENUMS[f]), F.lit(False))
        elif f in schema.SETS:
            ok &= t.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(F.try_variant_get(v, f"$.{f}", "array<string>").isNotNull() & ~F.exists(F.try_variant_get(v, f"$.{f}", "array<string>"), lambda x: x.isNull()), F.lit(False))
        elif f in schema.FLOATS:
            ok &= null | t.rlike(number)
        elif f in schema.INTEGERS:
            ok &= null | t.isin("BIGINT") | t.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
        else:
            ok &= null | (t == "STRING")
    return v.isNotNull() & ok


def posting(v: Column) -> Column:
    """A valid object as the posting's struct; null if it is not valid."""
    fields = [F.try_variant_get(v, f"$.{f}", schema.field_type(f).simpleString()).alias(f) for f in schema.FIELDS]
    return F.when(valid(v), F.struct(*fields))


def outcome(ok: Column, v: Column) -> Column:
    """api_error, parse_failed, schema_invalid or ok."""
    return F.when(~F.coalesce(ok, F.lit(False)), "api_error").when(v.isNull(), "parse_failed").when(~valid(v), "schema_invalid").otherwise("ok")
