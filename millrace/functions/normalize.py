"""Normalisation of field values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import schema

#: White space, with the control characters that Java leaves out.
_SPACE = r"(?U)[\s\x{1c}-\x{1f}\x{85}]+"


def trimmed(c: Column) -> Column:
    """Without white space at both ends; blank becomes null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "^" + _SPACE, ""), _SPACE + "$", ""), F.lit(""))


def norm_str(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, _SPACE, " "))), F.lit(""))


def norm_upper(c: Column) -> Column:
    return F.upper(norm_str(c))


def norm_number(c: Column) -> Column:
    """A double, or null for anything that is not a number."""
    return c.cast("string").try_cast("double")


def norm_skills(c: Column) -> Column:
    """The set of normalised, non-blank elements, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm_str), lambda x: x.isNotNull()))


_RULES = (
    {f: norm_str for f in schema.FIELDS}
    | {f: norm_upper for f in schema.UPPER}
    | {f: norm_number for f in schema.FLOATS + schema.INTEGERS}
    | {"required_skills": norm_skills, "posting_date": trimmed}
)


def norm_field(name: str, c: Column) -> Column:
    """The rule of a field; an unknown name is a KeyError when the plan is built."""
    return _RULES[name](c)


def absent(name: str, c: Column) -> Column:
    """For scoring: normalised first; null, the empty set, and "unknown" in any text are absent."""
    return absent_normalised(name, norm_field(name, c))


def absent_normalised(name: str, v: Column) -> Column:
    """The same for a value that is normalised."""
    if name in schema.SETS:
        return F.size(v) == 0
    if name in schema.FLOATS + schema.INTEGERS:
        return v.isNull()
    return v.isNull() | (F.lower(v) == "unknown")


def null_valued(name: str, c: Column) -> Column:
    """For null rates: an enumeration's "unknown", the empty set, else null, as stored."""
    if name in schema.ENUMS:
        return F.coalesce(c == "unknown", F.lit(True))
    if name in schema.SETS:
        return F.coalesce(F.size(c) == 0, F.lit(True))
    return c.isNull()
