"""Format-preserving pseudonyms for personal data, in built-in functions only.

Found values are replaced by a keyed permutation of their own format, a Feistel network whose round function is SHA-256
of key, round and the other half. A permutation never maps two values to one, and it depends on nothing but the value,
so equal values stay equal across documents and distinct ones distinct. What counts as a value is validated first:

* e-mail addresses: letters and digits of the local part are permuted within their classes, the domain stays; both may be
  of any length (directly behind another value, with no character between, a local part has up to 1,024 characters);
* IPv4 addresses with four octets of 0 to 255: two halves of 16 bits;
* payment card numbers of 13 to 19 digits, with single blanks or hyphens, that pass the Luhn check: all digits but the
  last are permuted, the check digit is worked out anew, so pseudonyms pass the check too; of a run of groups that is
  none, parts of it that are card-shaped, runs being taken in pieces of at most 76 digits;
* telephone numbers with a country code (+1 (555) 555-5555, +49 30 1234567): digits but the code are permuted, separators
  stay; numbers of +1 have ten further digits, others end before another value. Without a code (555-555-5555,
  555.555.5555, 555 555 5555, (555) 555-5555) the area code must be 200 to 999 and is so in the pseudonym;
* US social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999, pseudonyms alike;
* dates YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY, DD/MM/YYYY, DD-MM-YYYY of 1900 to 2099 that exist in the calendar: these
  73,049 days are 17 * 4,297, so the network works on two digits of these radices and each pseudonym is such a date.
  What is no date that way but is one with the month first (12/31/1999) gets another of that kind, by permuting until
  the day is past the 12th.

Anything else stays as it is, dates with one-digit days or months among it. Null text stays null, empty text empty; texts
of any length are handled whole: repeated parts of unbounded length are matched possessively, which needs no stack, and
only from their beginning, which keeps the search linear. An empty table gives an empty one, repeated rows repeated
pseudonyms. Further columns pass through.

The key comes from the session (``KEY_SETTING``) or the environment (``KEY_VARIABLE``). It is a literal of the plan, so
event logs are as secret as the key unless ``spark.redaction.string.regex`` covers it.
"""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
KEY_SETTING, KEY_VARIABLE = "spark.millrace.pseudonym.key", "MILLRACE_PSEUDONYM_KEY"
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL}){_LOCAL}++|\G{_LOCAL}{{1,1024}}+)@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
#: What a further group of a telephone number may not be the beginning of: another value.
_OTHER = rf"{IPV4}|(?<![0-9./-])(?:(?:19|20)[0-9]{{2}}(?:-[0-9]{{2}}-|/[0-9]{{2}}/)[0-9]{{2}}|[0-9]{{2}}(?:-[0-9]{{2}}-|/[0-9]{{2}}/|\.[0-9]{{2}}\.)(?:19|20)[0-9]{{2}})(?![0-9]|[./-][0-9])|{SSN}"
PHONE = rf"(?<![0-9+])\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])|(?<![0-9+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?(?!{_OTHER})[0-9]{{2,4}}){{2,4}}(?![0-9])|" r"(?<![0-9-])(?:\([2-9][0-9]{2}\) ?[0-9]{3}[ .-]|[2-9][0-9]{2}[.-][0-9]{3}[.-]|[2-9][0-9]{2} [0-9]{3} )[0-9]{4}(?![0-9]|-[0-9])"
#: A run of groups of digits; the card numbers in it are found by ``_card``.
CARD = rf"(?<![0-9])[0-9](?:[0-9]|[ -](?!{_OTHER})[0-9]){{12,75}}(?![0-9])"
#: Lengths of the groups that a card number is looked for in if the run as a whole is none.
CARD_GROUPS = "^([0-9]+|4-4-4-4|4-4-4-4-3|4-6-5|4-6-4)$"
KINDS = {"email": EMAIL, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
_NAMED = [(name, rx.replace(r"\1", r"\k<a>").replace("([-/])", "(?<a>[-/])").replace(r"\2", r"\k<b>").replace("([-/.])", "(?<b>[-/.])")) for name, rx in KINDS.items()]
ANY = "|".join(f"(?:{rx})" for _, rx in _NAMED)
#: A text without these holds no value of any kind.
HINT = r"@|[0-9][0-9().+ /-]{5}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _random(key: str, kind: str, i: Column, other: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other).cast("binary"), 256)


def _digits_of(hexed: Column, at: Column | int, n: int = 8) -> Column:
    return F.conv(F.substr(hexed, at if isinstance(at, Column) else F.lit(at), F.lit(n)), 16, 10).cast("bigint")


def _shift(c: Column, by: Column) -> Column:
    """A character moved on within its class."""
    code = F.ascii(c)
    moved = lambda low, n: F.char(F.lit(low) + F.pmod(code - low + by, F.lit(n)))
    return F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)


def permute_text(s: Column, key: str, kind: str) -> Column:
    """Permutes ASCII letters and digits within their classes; other characters stay and take no part."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")

    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        added = _let(
            _random(key, kind, i, F.concat(F.size(a).cast("string"), F.lit(":"), F.array_join(b, ""))),
            lambda h: F.transform(a, lambda c, j: _shift(c, _digits_of(h, F.pmod(j, F.lit(16)) * 4 + 1, 4))),
        )
        return F.struct(b.alias("a"), added.alias("b"))

    def run(cs: Column) -> Column:
        half = F.floor(F.size(cs) / 2).cast("int")
        start = F.struct(F.slice(cs, F.lit(1), half).alias("a"), F.slice(cs, half + 1, F.size(cs)).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda x: F.array_join(F.concat(x["a"], x["b"]), ""))

    return _let(chars, run)


def permute_pair(a: Column, b: Column, ra: int, rb: int, key: str, kind: str) -> Column:
    """Permutes a pair of numbers below ``ra`` and ``rb``: struct(a, b)."""

    def step(acc: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        other = F.when(even, acc["b"]).otherwise(acc["a"]).cast("string")
        more = _digits_of(_random(key, kind, i, other), 1, 12)
        return F.struct(
            F.when(even, F.pmod(acc["a"] + more, F.lit(ra))).otherwise(acc["a"]).cast("bigint").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + more, F.lit(rb))).cast("bigint").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(digit, F.substr(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("s"),
            F.when(digit, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        )

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), put, lambda x: x["s"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows ``payload``."""
    rev = F.filter(F.split(F.reverse(payload), ""), lambda c: c != "")
    doubled = F.transform(rev, lambda c, j: F.when(F.pmod(j, F.lit(2)) == 0, _cross(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def _cross(x: Column) -> Column:
    return F.when(x > 9, x - 9).otherwise(x)


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    return _let(
        _let(o, lambda x: permute_pair(x[0] * 256 + x[1], x[2] * 256 + x[3], 65536, 65536, key, "ipv4")),
        lambda p: F.concat_ws(".", *[(F.floor(h / 256) if hi else F.pmod(h, F.lit(256))).cast("string") for h in (p["a"], p["b"]) for hi in (True, False)]),
    )


def _is_card(digits: Column) -> Column:
    return luhn_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))


def _card(m: Column, key: str) -> Column:
    """The card numbers of a run of groups replaced: from each group on the most groups that 19 digits hold, then card-shaped shorter ones."""

    def new(shape: Column, d: Column) -> Column:
        return _let(permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda p: _refill(shape, F.concat(p, luhn_digit(p))))

    def run(x: Column) -> Column:
        groups, seps = x["groups"], x["seps"]
        n = F.size(groups)

        def option(i: Column, j: Column) -> Column:
            part = F.slice(groups, i + 1, j - i + 1)
            shape = F.array_join(F.transform(part, lambda g, k: F.concat(F.when(k == 0, "").otherwise(F.coalesce(F.get(seps, i + k - 1), F.lit(""))), g)), "")
            return F.struct(j.alias("j"), F.array_join(part, "").alias("d"), shape.alias("shape"), F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-").alias("lengths"))

        def step(acc: Column, i: Column) -> Column:
            fits = F.filter(F.transform(F.sequence(i, F.least(i + 18, n - 1)), lambda j: option(i, j)), lambda o: F.length(o["d"]).between(13, 19))

            def chosen(f: Column) -> Column:
                most = F.try_element_at(f, F.lit(-1))["j"]
                whole = lambda o: (acc["start"] == i) & (o["j"] == most)
                good = F.filter(f, lambda o: (whole(o) | (o["lengths"].rlike(CARD_GROUPS) & o["d"].rlike("^[2-6]"))) & _is_card(o["d"]))
                return _let(F.struct(F.try_element_at(good, F.lit(-1)).alias("o"), most.alias("most")), put)

            def put(c: Column) -> Column:
                o, sep = c["o"], F.when(i == 0, "").otherwise(F.coalesce(F.get(seps, i - 1), F.lit("")))
                after = F.coalesce(o["j"] + 1, i + 1)
                start = F.when(o.isNotNull(), after).when(acc["start"] == i, F.coalesce(c["most"] + 1, i + 1)).otherwise(acc["start"])
                text = F.when(o.isNotNull(), new(o["shape"], o["d"])).otherwise(F.get(groups, i))
                return F.struct(F.concat(acc["out"], sep, text).alias("out"), after.alias("next"), start.alias("start"))

            return F.when(i < acc["next"], acc).otherwise(_let(fits, chosen))

        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(0).alias("start"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: a["out"])

    return _let(F.struct(F.split(m, "[ -]").alias("groups"), F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0)).alias("seps")), run)


def _numbers(m: Column, key: str, kind: str) -> Column:
    return _refill(m, permute_text(_digits(m), key, kind))


def _part(digits: Column, at: int, n: int) -> Column:
    return F.substring(digits, at, n).cast("bigint")


def _padded(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def _ssn(m: Column, key: str) -> Column:
    """Areas and, as one number, groups and serials are counted without those that do not exist."""

    def run(d: Column) -> Column:
        area = _part(d, 1, 3) - F.when(_part(d, 1, 3) > 666, 2).otherwise(1)
        return permute_pair(area, (_part(d, 4, 2) - 1) * 9999 + _part(d, 6, 4) - 1, 898, 99 * 9999, key, "ssn")

    def put(p: Column) -> Column:
        area = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", _padded(area, 3), _padded(F.floor(p["b"] / 9999) + 1, 2), _padded(F.pmod(p["b"], F.lit(9999)) + 1, 4))

    return _let(_let(_digits(m), run), put)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?(.*)$", 1)
    far = F.concat(code, _numbers(F.substr(m, F.length(code) + 1, F.length(m)), key, "phone"))
    pair = _let(_digits(m), lambda d: permute_pair(_part(d, 1, 3) - 200, _part(d, 4, 7), 800, 10**7, key, "phone"))
    near = _let(pair, lambda p: _refill(m, F.concat(_padded(p["a"] + 200, 3), _padded(p["b"], 7))))
    return F.when(m.startswith("+"), far).otherwise(near)


#: Permutations of a date until its day is past the 12th: 60 % are after each, so more are never needed.
WALK = 100


def _date(m: Column, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    iso = m.rlike("^[0-9]{4}")
    sep = F.when(iso, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    nth = lambda y, mm, d: F.datediff(F.try_to_timestamp(F.concat_ws("-", F.substring(m, y, 4), F.substring(m, mm, 2), F.substring(m, d, 2)), F.lit("yyyy-MM-dd")).cast("date"), first)
    found = F.struct(F.when(iso, nth(1, 6, 9)).otherwise(nth(7, 4, 1)).alias("usual"), F.when(~iso, nth(7, 1, 4)).alias("month_first"))

    def other(n: Column) -> Column:
        return _let(permute_pair(F.floor(n / 4297), F.pmod(n, F.lit(4297)), 17, 4297, key, "date"), lambda p: p["a"] * 4297 + p["b"])

    def late(n: Column) -> Column:
        step = lambda acc: _let(other(acc["n"]), lambda p: F.struct(p.alias("n"), (F.dayofmonth(F.date_add(first, p.cast("int"))) > 12).alias("done")))
        start = F.struct(n.cast("bigint").alias("n"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda acc, _: F.when(acc["done"], acc).otherwise(step(acc)), lambda x: x["n"])

    def run(x: Column) -> Column:
        new = F.when(x["usual"].isNotNull(), other(x["usual"])).when(x["month_first"].isNotNull(), late(x["month_first"]))
        return _let(_let(new, lambda n: F.split(F.date_add(first, n.cast("int")).cast("string"), "-")), lambda q: put(x, q))

    def put(x: Column, q: Column) -> Column:
        order = F.when(iso, q).when(x["usual"].isNotNull(), F.reverse(q)).otherwise(F.array(F.get(q, 1), F.get(q, 2), F.get(q, 0)))
        return F.when(q.isNull(), m).otherwise(F.replace(F.array_join(order, "|"), F.lit("|"), sep))

    return _let(found, run)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a value; what does not pass its kind's validation comes back unchanged."""
    kind = lambda rx: m.rlike(f"^(?:{rx})$")
    return (
        F.when(kind(EMAIL), _email(m, key))
        .when(kind(IPV4), _ipv4(m, key))
        .when(kind(DATE), _date(m, key))
        .when(kind(SSN), _ssn(m, key))
        .when(kind(CARD), _card(m, key))
        .when(kind(PHONE), _phone(m, key))
        .otherwise(m)
    )


def key_of(spark: SparkSession) -> str:
    """The configured key. Without one a random key is made for this session, so runs of other sessions give other pseudonyms."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """Replaces the values in the text column; ``found``, if named, becomes the number of values replaced."""
    t = F.col(f"`{text}`")
    matches = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(matches, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))
    names = set(docs.columns)
    tmp = next(c for c in (f"__p{i}" for i in range(len(names) + 1)) if c not in names)
    held = docs.withColumn(tmp, pairs)
    p = F.col(tmp)
    parts = F.split(t, ANY, -1)
    built = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(p, i)["p"], F.lit("")))), "")
    out = held.withColumn(text, F.when(F.size(p) > 0, built).otherwise(t))
    if found:
        out = out.withColumn(found, F.when(t.isNull(), 0).otherwise(F.size(F.filter(p, lambda x: x["m"] != x["p"]))).cast("bigint"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != found], *([F.col(f"`{found}`")] if found else []))
