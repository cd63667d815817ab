"""Novel secrets: planted keys are found, names are not, spans are whole; against a plain version."""

import random
import re
import string

import pytest
import zstandard

from millrace.llm import secrets

ALPHABETS = {
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "lower and digits": string.ascii_lowercase + string.digits,
    "hexadecimal": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "digits": string.digits, "letters": string.ascii_letters, "upper": string.ascii_uppercase,
}
FRAMES = (
    "The credential for the {a} {b} is {key} and the {c} {d} stays.", "authorization: bearer {key}", 'private_key_of_{a} => "{key}"', "{a}.{b}({c})  # the signing key\n{d} = '{key}'",
    "access key\n\t{key}\n{a}_{b} = {c}", "passphrase {a} {b} {c} {d} {a} {b} {c} {d} {a} {b} {c} {d} {a} {b} {c} {d} {a} {b} {c} {d} then {key}", "{key} is the encryption key of {a} {b}",
)
WORDS = sorted({w.lower() for w in re.findall("[A-Z]?[a-z]{3,}", secrets.identifiers().decode())})
SYLLABLES = [c + v + e for c in "bcdfghklmnprstvw" for v in "aeiou" for e in ("", "n", "r", "s", "t")]


def framed(rng, word):
    text = rng.choice(FRAMES).format(key=word, **{n: rng.choice(WORDS) for n in "abcd"})
    at = text.index(word)
    return text, at, at + len(word)


def reported(rng, word):
    text, s, e = framed(rng, word)
    return (s, 3, e) in secrets.novel_spans(text, [])


@pytest.mark.parametrize("alphabet", sorted(ALPHABETS))
@pytest.mark.parametrize("length", [16, 24, 40, 64, 128, 256, 500])
def test_recall_of_planted_keys(alphabet, length):
    rng = random.Random(f"{alphabet}{length}")
    found = sum(reported(rng, rng.choice(ALPHABETS[alphabet].replace("+", "").replace("/", "")) + "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(length - 1))) for _ in range(60))
    assert found >= 0.9 * 60


def names(rng, words):
    ws = [rng.choice(words) for _ in range(rng.randint(2, 5))]
    return rng.choice(["_".join(ws), ws[0] + "".join(w.title() for w in ws[1:]), "-".join(ws), "_".join(ws).upper(), "".join(w.title() for w in ws), "/".join(ws)])


def test_names_are_left_alone():
    rng = random.Random(3)
    known = [n for n in (names(rng, WORDS) + rng.choice(["", "", "2", "_v2", "_2024"]) for _ in range(400)) if len(n) >= 16]
    assert sum(reported(rng, n) for n in known) <= 0.05 * len(known)
    made = ["".join(rng.choice(SYLLABLES) for _ in range(8)) for _ in range(200)]
    assert sum(reported(rng, n) for n in made) <= 0.15 * len(made)
    for n in ("x" * 30, "-" * 30, "0" * 20, "2024-01-31T235959Z", "2024_01_31-23_59_59", "your_secret_key_here", "1234567890123456", "abcdefghijklmnopqrstuvwxyz"):
        assert not reported(rng, n), n


def plain(text):
    """All candidates by another way: paragraphs from ``re.split``, the frame of both compressions built here."""
    c = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(secrets.identifiers(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    base = [(s, e) for s, _, e in secrets.base_spans(text)]
    out, at = [], 0
    for part in re.split(r"(\n[ \t\r]*\n)", text):
        if re.search(secrets.SENSITIVE, part):
            for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", part):
                w = m[0].lstrip("/+-_")
                s, e = at + m.end() - len(w), at + m.end()
                if len(w.rstrip("=")) < 16 or part[m.end() : m.end() + 1].isalnum() or re.fullmatch(secrets._DATED, w) or any(x < e and s < y for x, y in base):
                    continue
                around = secrets.FILLER + "\n" + text[max(0, s - 2048) : s] + text[e : e + 2048]
                added = len(c.compress((around + w).encode())) - len(c.compress(around.encode()))
                if added / len(w) >= (0.95 if re.fullmatch(r"[A-Za-z+/_-]*[0-9]{0,4}=*", w) else 0.72):
                    out.append((s, e))
        at += len(part)
    return out


def test_spans_are_those_of_the_plain_version():
    rng = random.Random(9)
    for _ in range(60):
        pieces = []
        for _ in range(rng.randint(1, 8)):
            word = "".join(rng.choice(ALPHABETS["base64"]) for _ in range(rng.randint(10, 40))) if rng.random() < 0.5 else names(rng, WORDS)
            pieces.append(framed(rng, word)[0] if rng.random() < 0.7 else f"{rng.choice(WORDS)} {word} é {rng.choice(WORDS)}")
        text = rng.choice(["\n", "\n\n", "\n \r\n", " "]).join(pieces)
        assert [(s, e) for s, _, e in secrets.novel_spans(text, secrets.base_spans(text))] == plain(text)


def test_one_span_for_a_secret():
    key = "Zx9Kq2Lw8VbN4TyR7PmE"
    cases = {
        f"credential={key}": key, f"my_secret_{key} x": f"my_secret_{key}", f"bearer {key}==": f"{key}==", f"token secret credential private_key {key}": key,
        f"bearer {key}.{key[::-1]}.{key.swapcase()}": f"{key}.{key[::-1]}.{key.swapcase()}", f"credential --{key}": key,
    }
    for text, want in cases.items():
        assert [text[s:e] for s, _, e in secrets.novel_spans(text, secrets.base_spans(text))] == [want], text


def test_context_is_the_paragraph():
    key, far = "Zx9Kq2Lw8VbN4TyR7PmE", "lorem ipsum dolor sit amet, " * 3000
    for text, n in ((f"the credential {far}{key}", 1), (f"{key} {far} credential", 1), (f"the credential\n\n{key}", 0), (f"the credential\n{key}", 1), (f"nothing here {key}", 0)):
        assert len(secrets.novel_spans(text, [])) == n, text[:40]


def test_scan_reports_novel_spans(spark):
    rng = random.Random(1)
    texts = [framed(rng, "".join(rng.choice(ALPHABETS["base62"]) for _ in range(30)))[0] for _ in range(50)]
    rows = [*enumerate(texts), (900, None), (901, ""), (None, "credential"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = secrets.digest(secrets.scan(df.selectExpr("*", "1 as spans", "'x' as kind"))).collect()
    assert len(out) == len(rows) and sum(r["n_novel"] for r in out) >= 48
    for r in out:
        if r["n_novel"]:
            text = texts[r["doc_id"]]
            spans = secrets.base_spans(text)
            assert r["spans"] == secrets.show(sorted(spans + secrets.novel_spans(text, spans)))
    assert [r["spans"] for r in out if r["doc_id"] in (900, 901, None)] == ["", "", ""]
    assert secrets.digest(secrets.scan(df.limit(0))).collect() == []


def test_very_long_texts_are_scanned_whole(spark):
    key = "Zx9Kq2Lw8VbN4TyR7PmE"
    filler = "some words of a long text that tell nothing\n" * 30_000
    text = f"{filler}\n\nthe credential is {key}\n\n{filler}"
    row = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    at = text.index(key)
    assert row["spans"] == f"novel:{at}:{at + len(key)}"
