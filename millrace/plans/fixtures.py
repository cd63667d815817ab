"""Stand-in tables derived from ``documents`` by arithmetic, as expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(by: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({by}) % {len(values)} {cases} END"


def _list(items: list[str], duck: bool) -> str:
    return f"[{', '.join(items)}]" if duck else f"array({', '.join(items)})"


_SKILLS = ("'Python'", "' sql '", "'AWS'", "'python'", "'Spark'", "'Go'")


def posting(duck: bool, d: str = "doc_id", wrong: bool = False) -> dict[str, str]:
    """SQL of each field. ``wrong``: every seventh value of each field is another one."""
    s = f"CAST({d} % 9 AS STRING)"
    skills = f"CASE {d} % 3 WHEN 0 THEN {_list([*_SKILLS[:2]], duck)} WHEN 1 THEN {_list([*_SKILLS[1:4]], duck)} ELSE CAST({_list([], duck)} AS {'VARCHAR[]' if duck else 'ARRAY<STRING>'}) END"
    right = {
        "title": f"CASE WHEN {d} % 11 = 0 THEN NULL ELSE '  Senior   Engineer ' || {s} END",
        "company": f"CASE WHEN {d} % 13 = 0 THEN 'Unknown' WHEN {d} % 5 = 0 THEN NULL ELSE 'Co ' || {s} END",
        "location_city": f"CASE WHEN {d} % 4 = 0 THEN NULL ELSE 'City ' || {s} END",
        "location_region": f"CASE WHEN {d} % 6 = 0 THEN '   ' ELSE 'Region' END",
        "location_country": pick(d, ("us", " DE ", "fr")),
        "salary_min": f"CASE WHEN {d} % 8 = 0 THEN NULL ELSE CAST({d} % 50 * 1000 AS DOUBLE) END",
        "salary_max": f"CASE WHEN {d} % 10 = 0 THEN NULL ELSE CAST({d} % 40 * 1500 AS DOUBLE) END",
        "salary_currency": f"CASE WHEN {d} % 9 = 0 THEN NULL ELSE {pick(d, ('usd', 'EUR', 'gbp'))} END",
        "years_experience_min": f"CASE WHEN {d} % 7 = 0 THEN NULL ELSE CAST({d} % 60 AS BIGINT) END",
        "required_skills": skills,
        "posting_date": f"CASE WHEN {d} % 5 = 0 THEN NULL WHEN {d} % 5 = 1 THEN 'June 2026' ELSE ' 2026-0' || CAST({d} % 9 + 1 AS STRING) || '-15' END",
    } | {f: pick(f"{d} + {i}", m) for i, (f, m) in enumerate(schema.ENUMS.items())}
    if not wrong:
        return {f: right[f] for f in schema.FIELDS}
    other = {f: f"coalesce({right[f]}, 'x') || ' x'" for f in schema.FIELDS if f not in schema.ENUMS} | {f: pick(f"{d} + {i} + 1", m) for i, (f, m) in enumerate(schema.ENUMS.items())}
    other |= {f: f"coalesce({right[f]}, 0) + 1" for f in schema.FLOATS + schema.INTEGERS} | {"required_skills": _list([*_SKILLS[3:]], duck)}
    return {f: f"CASE WHEN ({d} + {i}) % 7 = 0 THEN {other[f]} ELSE {right[f]} END" for i, f in enumerate(schema.FIELDS)}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "n_chars", *[f"{e} AS {f}" for f, e in posting(False).items()])


#: Every tenth prediction is missing, every ninth invalid.
VALID = "doc_id % 9 <> 0"
PRESENT = "doc_id % 10 <> 0"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ", ".join(f"'{f}', {e}" for f, e in posting(False, wrong=True).items())
    return table(spark, sf_dir, "documents").where(PRESENT).selectExpr("doc_id", f"{VALID} AS schema_valid", f"CASE WHEN {VALID} THEN named_struct({fields}) END AS parsed")


def gold_cte() -> str:
    return "gold AS (SELECT doc_id, text, n_chars, " + ", ".join(f"{e} AS {f}" for f, e in posting(True).items()) + " FROM documents)"


def pred_cte() -> str:
    return f"pred AS (SELECT doc_id, {VALID} AS schema_valid, " + ", ".join(f"{e} AS {f}" for f, e in posting(True, wrong=True).items()) + f" FROM documents WHERE {PRESENT})"


_OBJECT = (
    '\'{"title": "T\' || CAST(doc_id AS STRING) || \'", "company": null, "employment_type": "\' || ' + pick("doc_id", ("full_time", "contract", "freelance"))
    + ' || \'", "seniority": "mid", "remote_mode": "remote", "location_city": null, "location_region": null, "location_country": "US", "salary_min": \' || '
    + pick("doc_id", ("120000", "1.5", '"90000"', "null")) + ' || \', "salary_max": null, "salary_currency": "USD", "salary_period": "yearly", "years_experience_min": \' || '
    + pick("doc_id", ("3", "null", "4", "2.5", "7")) + ' || \', "education_level": "none", "required_skills": ["sql"], "posting_date": null\''
)
#: Model output: bare, fenced, in prose, cut off, with a key too many, empty, two objects.
RAW = (
    f"CASE doc_id % 8 WHEN 0 THEN {_OBJECT} || '}}' WHEN 1 THEN '```json' || chr(10) || {_OBJECT} || '}}' || chr(10) || '```' "
    f"WHEN 2 THEN 'Here it is: ' || {_OBJECT} || '}} as asked' WHEN 3 THEN {_OBJECT} WHEN 4 THEN {_OBJECT} || ', \"extra\": 1}}' WHEN 5 THEN '' "
    f"WHEN 6 THEN {_OBJECT} || '}} {{\"b\": 2}}' ELSE '  ' || {_OBJECT} || '}}  ' END"
)
#: An append-only cache: two rows for every third document, the later one decides.
CACHE = f"""
SELECT doc_id, doc_id * 2 AS seq, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {RAW} END AS raw_output, doc_id % 3 <> 0 AS ok,
  CASE WHEN doc_id % 2 = 0 THEN 'gpt-4o-mini' ELSE 'gpt-4o' END AS teacher_model, CASE WHEN doc_id % 17 = 0 THEN 'old' ELSE 'cur' END AS prompt_sha,
  n_chars AS tokens_in, doc_id % 400 AS tokens_out FROM documents WHERE doc_id % 12 <> 0
UNION ALL
SELECT doc_id, doc_id * 2 + 1, {RAW}, true, 'gpt-4o-mini', 'cur', n_chars, doc_id % 300 FROM documents WHERE doc_id % 6 = 3
"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark, sf_dir, CACHE)


def from_documents(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over ``documents`` as it stands."""
    escaped = sql.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {docs}")
    return spark.sql(escaped, docs=table(spark, sf_dir, "documents"))


#: Review log lines: events of users as documents.
LOG = """
SELECT event_id AS seq, CAST(user_id % 200 AS STRING) AS doc_id, CASE event_type WHEN 'view' THEN 'accept' WHEN 'error' THEN 'reject_doc' ELSE 'edit' END AS action,
  CASE event_type WHEN 'click' THEN 'title' WHEN 'signup' THEN 'company' WHEN 'purchase' THEN 'seniority' END AS field,
  CAST(event_id % 7 AS STRING) AS new, CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE {stamp} END AS {at} FROM events
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = LOG.format(stamp="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", at="at").replace("FROM events", "FROM {ev}")
    return spark.sql(sql, ev=table(spark, sf_dir, "events"))


LOG_DUCK = LOG.format(stamp="strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", at='"at"')
