"""The sixteen-field posting, its Spark types and its enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names in order, members of the enumerations, and classes of fields.
ENUMS = {
    "employment_type": ("full_time", "part_time", "contract", "internship", "temporary", "unknown"),
    "seniority": ("intern", "junior", "mid", "senior", "lead", "principal", "unknown"),
    "remote_mode": ("onsite", "hybrid", "remote", "unknown"),
    "salary_period": ("hourly", "daily", "weekly", "monthly", "yearly", "unknown"),
    "education_level": ("none", "high_school", "associate", "bachelor", "master", "doctorate", "unknown"),
}
FIELDS = (
    "title", "company", "employment_type", "seniority", "remote_mode", "location_city", "location_region", "location_country",
    "salary_min", "salary_max", "salary_currency", "salary_period", "years_experience_min", "education_level", "required_skills", "posting_date",
)
SETS = ("required_skills",)
FLOATS = ("salary_min", "salary_max")
INTEGERS = ("years_experience_min",)
UPPER = ("location_country", "salary_currency")
ARMS = ("base_fewshot", "base_fewshot_constrained", "lora_ft", "lora_ft_constrained", "teacher")
SPLITS = ("train", "dev", "eval_pool")


def field_type(name: str) -> T.DataType:
    if name in SETS:
        return T.ArrayType(T.StringType())
    if name in FLOATS:
        return T.DoubleType()
    return T.LongType() if name in INTEGERS else T.StringType()


POSTING = T.StructType([T.StructField(f, field_type(f)) for f in FIELDS])


def json_schema() -> dict:
    """The posting as a Draft 2020-12 JSON Schema: all keys required, no others allowed."""

    def one(name: str) -> dict:
        if name in ENUMS:
            return {"enum": list(ENUMS[name])}
        if name in SETS:
            return {"type": "array", "items": {"type": "string"}}
        kind = "number" if name in FLOATS else "integer" if name in INTEGERS else "string"
        return {"anyOf": [{"type": kind}, {"type": "null"}]}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "JobPosting", "type": "object", "properties": {f: one(f) for f in FIELDS}, "required": list(FIELDS), "additionalProperties": False}
