"""Pseudonyms against a plain Python version of the network, value by value, and on texts that strain a regex engine."""

import datetime
import hashlib
import re

import pytest

from millrace.llm import pseudonyms

FIRST = datetime.date(1900, 1, 1)


def random_hex(key, kind, i, other):
    return hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()


def permute_pair(a, b, ra, rb, key, kind):
    for i in range(1, pseudonyms.ROUNDS + 1):
        if i % 2 == 0:
            a = (a + int(random_hex(key, kind, i, b)[:12], 16)) % ra
        else:
            b = (b + int(random_hex(key, kind, i, a)[:12], 16)) % rb
    return a, b


def permute_text(s, key, kind):
    half = len(s) // 2
    a, b = s[:half], s[half:]
    for i in range(1, pseudonyms.ROUNDS + 1):
        h = random_hex(key, kind, i, f"{len(a)}:{b}")
        new = ""
        for j, c in enumerate(a):
            by = int(h[j % 16 * 4 : j % 16 * 4 + 4], 16)
            for low, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(low) <= ord(c) < ord(low) + n:
                    c = chr(ord(low) + (ord(c) - ord(low) + by) % n)
                    break
            new += c
        a, b = b, new
    return a + b


def refill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def digits(s):
    return re.sub("[^0-9]", "", s)


def date(s, key):
    sep = "-" if "-" in s else "/" if "/" in s else "."
    p = s.split(sep)
    for order in ((0, 1, 2),) if len(p[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            n = (datetime.date(*(int(p[i]) for i in order)) - FIRST).days
        except ValueError:
            continue
        while True:
            a, b = permute_pair(n // 4297, n % 4297, 17, 4297, key, "date")
            n = a * 4297 + b
            day = FIRST + datetime.timedelta(n)
            if order != (2, 0, 1) or day.day > 12:
                break
        parts = day.isoformat().split("-")
        out = [""] * 3
        for k, i in enumerate(order):
            out[i] = parts[k]
        return sep.join(out)
    return s


def ssn(s, key):
    areas = [a for a in range(1, 900) if a != 666]
    d = digits(s)
    a, b = permute_pair(areas.index(int(d[:3])), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 99 * 9999, key, "ssn")
    return f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def phone(s, key):
    if s[0] == "+":
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", s)[0]
        rest = s[len(code) :]
        return code + refill(rest, permute_text(digits(rest), key, "phone"))
    d = digits(s)
    a, b = permute_pair(int(d[:3]) - 200, int(d[3:]), 800, 10**7, key, "phone")
    return refill(s, f"{a + 200:03}{b:07}")


def ipv4(s, key):
    o = [int(x) for x in s.split(".")]
    p = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
    return ".".join(str(x) for h in p for x in divmod(h, 256))


def card(s, key):
    p = permute_text(digits(s)[:-1], key, "card")
    total = sum(int(c) if j % 2 else sum(divmod(int(c) * 2, 10)) for j, c in enumerate(reversed(p)))
    return refill(s, p + str(-total % 10))


def email(s, key):
    local, domain = s.split("@")
    return permute_text(local, key, "email") + "@" + domain


VALUES = [
    *[(email, x) for x in ("bosbt.42@mail8.example.com", "A_b+c%d-9@x-y.org", "q@a.b", "x" * 70 + "Z9@a.b.c", "a.b@c" + ".d" * 300)],
    *[(ipv4, x) for x in ("42.144.35.254", "0.0.0.0", "255.255.255.255", "10.0.0.1")],
    *[(card, x) for x in ("4041-8949-7460-8795", "4111 1111 1111 1111", "4111111111111111", "5500005555555559", "378282246310005")],
    *[(phone, x) for x in ("+1 (555) 123-4567", "+15551234567", "+49 30 1234567", "555-123-4567", "(200) 000-0000", "(212)555.0100", "999.999.9999", "555 123 4567")],
    *[(ssn, x) for x in ("123-45-6789", "001-01-0001", "899-99-9999", "665-12-3456", "667-12-3456")],
    *[(date, x) for x in ("1900-01-01", "2099-12-31", "2024-02-29", "2024/05/01", "31.12.1999", "01/02/2003", "12/31/1999", "02-28-2001", "02.29.2000")],
]
KEPT = ["02/29/2001", "13/13/2000", "000-00-0000", "666-12-3456", "912-34-5678", "123-00-6789", "123-45-0000", "155-123-4567", "055 123 4567", "1/5/2024", "a@b", "@a.b", "300.1.1.1", "4111111111111112"]


@pytest.mark.parametrize("key", ["k", "another|key"])
def test_values_are_those_of_the_plain_version(spark, key):
    texts = [v for _, v in VALUES] + KEPT
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key, found="n").collect()}
    assert [got[i]["text"] for i in range(len(VALUES))] == [f(v, key) for f, v in VALUES]
    assert [got[i]["n"] for i in range(len(VALUES))] == [int(f(v, key) != v) for f, v in VALUES]
    assert [got[i]["text"] for i in range(len(VALUES), len(texts))] == KEPT
    whole = spark.createDataFrame([(1, " ; ".join(texts))], "doc_id long, text string")
    assert pseudonyms.pseudonymise(whole, key).first()["text"] == " ; ".join([f(v, key) for f, v in VALUES] + KEPT)


def test_restricted_domains_are_permuted(spark):
    late = [f"{m:02}/{d:02}/{y}" for y in (1999, 2000) for m in range(1, 13) for d in range(13, 29)]
    areas = [f"{a:03}-01-0001" for a in range(1, 900) if a != 666]
    near = [f"{a}-000-0000" for a in range(200, 1000)]
    for values, valid in ((late, r"(0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/(19|20)\d\d"), (areas, r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"), (near, r"[2-9]\d\d-\d{3}-\d{4}")):
        out = [r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), "k").collect()]
        assert len(set(out)) == len(values) and all(re.fullmatch(valid, x) for x in out)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("a@b" + ".c" * 100_000, 1), ("7" * 1_000_000, 0), ("@" * 1_000_000, 0), ("a." * 500_000, 0), ("a@" * 200_000, 0), ("x" * 100_000 + "@y.com", 1),
        ("+1 " * 100_000, 0), ("1.2.3." * 100_000, 0), ("555-555-5555x" * 10_000, 10_000), ("12-" * 100_000, 0),
    ],
    ids=["labels", "digits", "ats", "dots", "locals", "long local", "codes", "octets", "phones", "hyphens"],
)
def test_texts_that_strain_a_regex(spark, text, n):
    row = pseudonyms.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k", found="n").first()
    assert row["n"] == n and len(row["text"]) == len(text) and (row["text"] == text) == (n == 0)


def test_address_behind_another_value(spark):
    df = spark.createDataFrame([(1, "+1 555-123-4567foo@bar.com"), (2, "foo@bar.com")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(df, "k").collect()}
    assert got[1] == phone("+1 555-123-4567", "k") + got[2]


def test_odd_rows(spark):
    rows = [(None, None, "a"), (1, "", None), (2, " \n", "c"), (3, "mail a.b@c.de", "c"), (3, "mail a.b@c.de", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __p0 string")
    out = pseudonyms.pseudonymise(df, "k", found="n_replaced")
    assert out.columns == ["doc_id", "text", "__p0", "n_replaced"]
    new = f"mail {email('a.b@c.de', 'k')}"
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, None, "a", 0), (1, "", None, 0), (2, " \n", "c", 0), (3, new, "c", 1), (3, new, "c", 1)], key=str)
    assert pseudonyms.pseudonymise(df.limit(0), "k").collect() == []


def test_key_from_configuration(spark, monkeypatch):
    monkeypatch.delenv(pseudonyms.KEY_VARIABLE, raising=False)
    spark.conf.unset(pseudonyms.KEY_SETTING)
    made = pseudonyms.key_of(spark)
    assert len(made) == 64 and pseudonyms.key_of(spark) == made
    spark.conf.set(pseudonyms.KEY_SETTING, "mine")
    assert pseudonyms.key_of(spark) == "mine"
    spark.conf.unset(pseudonyms.KEY_SETTING)
    monkeypatch.setenv(pseudonyms.KEY_VARIABLE, "other")
    assert pseudonyms.key_of(spark) == "other"
