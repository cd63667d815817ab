"""Secret scan: fixed patterns, and zstandard novelty for what they miss.

The base patterns are searched leftmost and without overlap, each kind by itself; matches that fail their length are
dropped but still consume their text. In each paragraph (up to a blank line, however long) that mentions a sensitive
word, every whole run of at least ``LEAST`` key characters is a candidate. A compressor primed with a dictionary of
identifiers and with the text around the candidate is asked how many bytes the candidate adds; what adds at least as
many as ``NOVELTY`` says is not made of anything known and is reported as kind ``novel``, unless a base span overlaps it. Neighbours joined by a dot, as in signed tokens, are one span. Candidates that look like a name (no digits
but up to four at the end) need ``NAME_NOVELTY``, since names that the dictionary does not hold add more than others.
Dates and times are no candidates. What the surroundings repeat is not novel. The same figure is given for base spans,
so that placeholders can be told from real keys.

The dictionary is built by ``identifiers`` from the names that Python's standard library defines, with their words in
three cases, and sent to all tasks; a dictionary of the deployment's own code may be given instead. Simulated figures,
with the built one: random keys of 16 to 512 characters are reported in 97 % of cases or more in each alphabet with
digits, upper case or both (base64, base32, hexadecimal, digits); of lower-case letters alone few are, since these add
no more than unknown names do, and of thousands of characters only those with five bits a character or more. Names of
two to five known words, with or without a number behind them, are reported in up to 2.5 % of cases, in upper case in 7 to
12 %, made-up words of eight syllables in none.

Null and empty texts have no spans. Texts are scanned whole; rows are independent of each other, so copies, ties and hot
keys make no difference; an empty table gives an empty one and further columns are not read. Offsets are code points,
the end exclusive.
"""

from __future__ import annotations

import builtins
import importlib
import importlib.util
import inspect
import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import runtime

# Patterns, least lengths and the order of kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so this is the pattern [0-9a-f]+ with its least length
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# Words that make a paragraph sensitive.
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|\bpwd\b|secret|token|credential|bearer\s|authorization|(?:api|private|access|auth|signing|encryption|session|ssh)[ _-]?key", re.I | re.A)
#: One of these is in every match of ``SENSITIVE``, lower-cased: a cheap first look at a text.
_ROOTS = ("passw", "passphrase", "pwd", "secret", "token", "credential", "bearer", "authorization", "key")
LEAST = 16
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}(?![A-Za-z0-9])")
_BLANK = re.compile(r"\n[ \t\r]*\n")
_DATED = re.compile(r"(?:19|20)\d\d[-_/]?[01]\d[-_/]?[0-3]\d(?:[T_-]?[0-2]\d[-_]?[0-5]\d[-_]?[0-5]\d)?Z?", re.A)
_NAME = re.compile(r"[A-Za-z+/_-]*[0-9]{0,4}=*", re.A)
#: Characters on either side that prime the compressor.
AROUND = 2048
#: Least bytes a character, by length: a random string's figure falls towards its entropy as the string grows.
NOVELTY, NAME_NOVELTY = ((256, 0.72), (1 << 62, 0.62)), ((128, 0.95), (256, 0.72), (1 << 62, 0.62))

# Modules whose names make the dictionary, and usual placeholders.
MODULES = (
    "argparse asyncio base64 calendar codecs collections configparser contextlib copy csv ctypes datetime decimal difflib email.message enum functools getpass glob gzip hashlib heapq "
    "hmac html.parser http.client http.cookies http.server imaplib inspect io ipaddress itertools json locale logging logging.handlers math mimetypes multiprocessing netrc operator os "
    "pathlib pickle platform pprint queue random re sched secrets select shelve shutil signal smtplib socket socketserver sqlite3 ssl statistics string struct subprocess sys tarfile "
    "tempfile threading time timeit tokenize traceback types typing unittest urllib.parse urllib.request uuid warnings weakref xml.dom.minidom xml.etree.ElementTree zipfile zlib"
).split()
PLACEHOLDERS = (
    "username user host port database url http https www com org net localhost config settings default example placeholder changeme your_token_here your_api_key your_secret_key "
    "xxxxxxxxxxxxxxxx aaaaaaaaaaaaaaaa 0000000000000000 1234567890123456 1234567890abcdef 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ qwertyuiopasdfghjklzxcvbnm "
    "password passwd secret token api_key apikey access_key private_key credential authorization bearer getElementById addEventListener setTimeout toString valueOf hashCode"
)


def identifiers() -> bytes:
    """Names of keywords, modules, functions, classes and attributes of the standard library, and their words in three cases."""
    names: dict[str, None] = dict.fromkeys(keyword.kwlist)
    for module in [builtins, *(importlib.import_module(m) for m in MODULES if importlib.util.find_spec(m))]:
        for n in dir(module):
            names[n.strip("_")] = None
            if inspect.isclass(held := getattr(module, n, None)):
                names |= dict.fromkeys(x.strip("_") for x in dir(held))
    long = [n for n in names if len(n) > 2]
    words = sorted({w.lower() for n in long for w in re.findall("[A-Z]?[a-z]+|[A-Z]{2,}", n) if len(w) > 2})
    return " ".join([*(w.upper() for w in words), *(w.title() for w in words), *long, PLACEHOLDERS]).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place, end)`` of the base matches, sorted."""
    low = text.lower()
    out = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _filler(words: int = 90) -> str:
    """Made-up words, which stand before the surroundings so that a short text's literals are coded like a long one's."""
    syllables = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
    return " ".join("".join(syllables[(7919 * (i + 1) * (k + 3) >> 2) % len(syllables)] for k in range(2 + i % 3)) for i in range(words))


FILLER = _filler()
_compressors: dict[bytes | None, zstandard.ZstdCompressor] = {}


def compressor(dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    """The process's compressor primed with a dictionary, by default that of ``identifiers``."""
    if dictionary not in _compressors:
        primed = zstandard.ZstdCompressionDict(identifiers() if dictionary is None else dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _compressors[dictionary] = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False)
    return _compressors[dictionary]


def novelty(text: str, start: int, end: int, dictionary: bytes | None = None) -> float:
    """Bytes that ``text[start:end]`` adds, per character, to a compressed frame of what surrounds it."""
    c = compressor(dictionary)
    around = f"{FILLER}\n{text[max(0, start - AROUND) : start]}{text[end : end + AROUND]}".encode()
    return (len(c.compress(around + text[start:end].encode())) - len(c.compress(around))) / (end - start)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of key characters in paragraphs with a sensitive word, in order and without overlap."""
    low = text.lower()
    if not any(root in low for root in _ROOTS) or not SENSITIVE.search(text):
        return
    edges = [0, *(m.end() for m in _BLANK.finditer(text)), len(text)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if SENSITIVE.search(text, a, b):
            for m in _CANDIDATE.finditer(text, a, b):
                word = m[0].lstrip("/+-_")
                if len(word) >= LEAST and not _DATED.fullmatch(word):
                    yield m.end() - len(word), m.end()


def is_novel(text: str, start: int, end: int, dictionary: bytes | None = None) -> bool:
    least = NAME_NOVELTY if _NAME.fullmatch(text, start, end) else NOVELTY
    return novelty(text, start, end, dictionary) >= next(x for most, x in least if end - start < most)


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind's place, end)`` of the novel candidates that no base span (sorted) overlaps."""
    out: list[tuple[int, int, int]] = []
    reach, at = 0, 0  # the farthest end of the base spans that begin before the candidate's end
    for s, e in candidates(text):
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach > s:
            continue
        if is_novel(text, s, e, dictionary):
            if out and s == out[-1][2] + 1 and text[s - 1] == ".":
                out[-1] = (out[-1][0], 3, e)
            else:
                out.append((s, 3, e))
    return out


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, novelty>>)`` for every row."""
    runtime.prepare(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(identifiers() if dictionary is None else dictionary)  # about 160 KB
    src = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": novelty(t, s, e, known)} for s, k, e in sorted(base + novel_spans(t, base, known))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    doc_id = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {doc_id}, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``scan``'s result, in built-in functions."""
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("novel").alias("n_novel"),
    )
