"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the bytes of a text marks chunk borders, so a passage that occurs in many documents falls into the
same chunks wherever it stands. The inside of a chunk (from its first to its last space) is encoded once and kept; what
lies around a border, from the last space before it to the first space after it, is the seam, which is re-encoded. A
join is accepted when the re-encoded seam, read with one more word on either side, ends in exactly the ids that the
chunks gave for these words; otherwise the pieces on both sides of a join that disagrees are joined and encoded anew,
until every join of the text agrees with its own re-encoding, the whole text in the end.

With a tokenizer that takes words one by one (``parts_at_spaces`` reads that off its definition), a chunk that is not in
the store is put together from its words, a second level of chunks that are encoded once; with any other tokenizer the
chunk is encoded as it is. Either way the joins of chunks are repaired as above.

The store of encoded chunks belongs to the Python worker, which serves many tasks; it is bounded by ``STORE_BYTES`` and
emptied when full, which costs time and changes no result. ``reuse`` tells how many bytes were found at either level: of
check_s 2 % of the bytes in chunks and 83 % of the rest in words; all workers together could find 10 % in chunks.
Nothing is shuffled, so no key can be hot, and a lost task is just run again. A store for the whole cluster would need
every chunk of every text to be shuffled twice, its bytes to be counted as distinct and its ids to come back, which costs
more than the encoding that it saves unless most of the text is copies.

Null and empty texts have no ids and decode to the empty string. Repeated rows give equal rows. Very long texts are
chunked as any others. Further columns pass through unless their names clash with the new ones, which then win.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import runtime
from millrace.llm.textkernel import mix, powers, raw, slices

#: A border falls where the hash of the last WINDOW bytes has its low MASK_BITS bits clear.
WINDOW, MASK_BITS = 24, 10
STORE_BYTES = 16 << 20
#: Words of new chunks whose ids are kept beside the chunks, in each of two generations.
STORE_WORDS = 120_000
_SPACES = b" \n"
#: Patterns of pre-tokenizers that keep matches only, none of which holds white space, or letters and marks at once.
SPACE_FREE = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def word_tokenizer_path() -> str:
    """Where the public word-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def parts_at_spaces(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) takes words one by one, in lower case: white space is dropped before the model, which sees pieces without it, and no step before looks across it."""
    told = json.loads(tokenizer)
    flat = lambda part, name: (part.get(name) if part["type"] == "Sequence" else [part]) if part else []
    steps, first = flat(told["normalizer"], "normalizers"), flat(told["pre_tokenizer"], "pretokenizers")[:1]
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"], s.get("pattern"), s.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for s in steps)
    kept = [s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and s["pattern"].get("Regex") in SPACE_FREE for s in first]
    lower = bool(steps) and steps[-1]["type"] == "Lowercase"
    return plain and lower and kept == [True] and told["post_processor"] is None and not told["model"].get("dropout")


def borders(data: np.ndarray) -> np.ndarray:
    """Content-defined borders inside a byte string, none of them inside a character."""
    n = len(data)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n + 1 - WINDOW])
    at = np.flatnonzero((rolled & np.uint64((1 << MASK_BITS) - 1)) == 0) + WINDOW
    at = at[at < n]
    return at[(data[at] & 0xC0) != 0x80]


def plan(text: bytes) -> list[tuple[str, bytes]]:
    """A text as chunk, seam, chunk, ..., chunk; a seam runs from the last space before a border to the first after it."""
    data = np.frombuffer(text, np.uint8)
    cuts = borders(data)
    gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
    nth = np.searchsorted(gaps, cuts)
    nth = nth[(nth > 0) & (nth < len(gaps))]
    out: list[tuple[str, bytes]] = []
    at = 0  # all before it is planned
    for left, right in zip(gaps[nth - 1].tolist(), gaps[nth].tolist(), strict=True):
        if left > at:
            out += [("chunk", text[at:left]), ("seam", text[left:right])]
            at = right
    return [*out, ("chunk", text[at:])]


class Codec:
    """Encodes whole texts with one tokenizer of the tokenizers library and keeps what it has encoded."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.texts = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.plain_join = self.tokenizer.decoder is None
        self.by_word = parts_at_spaces(self.tokenizer.to_str())
        self.store: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: Bytes of the chunks of all texts so far, of those that were not in the store, and of what of these had to be encoded.
        self.chunk_bytes, self.new_bytes, self.encoded_bytes = 0, 0, 0

    def _encode(self, pieces: list[bytes], chunks: bool = False) -> list[np.ndarray]:
        """Ids of each piece, from the store where it is there."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.store]
        if chunks:
            self.chunk_bytes += sum(map(len, pieces))
            self.new_bytes += sum(map(len, new))
        if new:
            if self.held > STORE_BYTES:
                kept = {p: self.store[p] for p in pieces if p in self.store}
                self.store, self.held = kept, sum(len(p) + 4 * len(v) + 200 for p, v in kept.items())
            for p, ids in zip(new, self._by_words(new) if chunks and self.by_word else self._fresh(new, chunks), strict=True):
                self.store[p] = ids
                self.held += len(p) + 4 * len(ids) + 200
        return [self.store[p] for p in pieces]

    def _fresh(self, pieces: list[bytes], count: bool = True) -> list[np.ndarray]:
        if count:
            self.encoded_bytes += sum(map(len, pieces))
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _by_words(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of chunks from those of their words, which are encoded once too."""
        if len(self.words) > STORE_WORDS:
            self.words, self.older = {}, self.words
        words = [_words(c) for c in chunks]
        known = self.words
        missing = set().union(*words).difference(known)
        again = missing.intersection(self.older)
        known.update({w: self.older[w] for w in again})
        missing = list(missing - again)
        known.update(zip(missing, (ids.tobytes() for ids in self._fresh(missing)), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, w)), "<u4") for w in words]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts. Pieces of all texts are gathered first, so the tokenizer is called a few times only."""
        plans = [plan(text) for text in texts]
        chunks = iter(self._encode([piece for p in plans for kind, piece in p if kind == "chunk"], chunks=True))
        seams = iter(self._encode([piece for p in plans for kind, piece in p if kind == "seam"]))
        results = [[next(chunks if kind == "chunk" else seams) for kind, _ in p] for p in plans]
        tries = []
        for k, p in enumerate(plans):
            for i in range(1, len(p), 2):
                tries.append((k, i, _last_word(p[i - 1][1]), _first_word(p[i + 1][1])))
        ends = iter(self._encode([w for *_, before, after in tries for w in (before, after)]))
        wide = iter(self._encode([before + plans[k][i][1] + after for k, i, before, after in tries]))
        bad: set[int] = set()
        for k, i, *_ in tries:
            before, after, parts = next(ends), next(ends), results[k]
            joined = np.concatenate([before, parts[i], after])
            if not (np.array_equal(joined, next(wide)) and _ends(parts[i - 1], before) and _starts(parts[i + 1], after)):
                bad.add(k)
        for k in bad:
            results[k] = [self._repair([p for _, p in plans[k]])]
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] for parts in results]

    def _repair(self, pieces: list[bytes]) -> np.ndarray:
        """Joins neighbours that disagree and encodes them anew until every join agrees with its own re-encoding."""
        while len(pieces) > 1:
            ids = self._encode(pieces)
            both = self._encode([a + b for a, b in zip(pieces, pieces[1:], strict=False)])
            wrong = next((i for i in range(len(both)) if not np.array_equal(np.concatenate(ids[i : i + 2]), both[i])), None)
            if wrong is None:
                return np.concatenate(ids)
            pieces = [*pieces[:wrong], pieces[wrong] + pieces[wrong + 1], *pieces[wrong + 2 :]]
        return self._encode(pieces)[0]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.plain_join:
            return " ".join(map(self.texts.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")
_CAPITAL_BEFORE_WIDE = re.compile(rb"[A-Z][\x80-\xff]")


def _words(chunk: bytes) -> list[bytes]:
    """Words in the form in which most are met again: A-Z in lower case, as the tokenizer does later, and a mark behind a letter by itself, as it is a piece of its own.

    What may hold a special token stays as it is, and so does a word in which a capital stands before a character beyond
    ASCII: the tokenizer composes characters before it lower-cases, and some marks compose with a small letter only.
    """
    if b"<|" in chunk:
        return chunk.split()
    if _CAPITAL_BEFORE_WIDE.search(chunk):
        out: list[bytes] = []
        for word in chunk.split():
            out += [word] if _CAPITAL_BEFORE_WIDE.search(word) else _MARK.sub(rb" \1", word.lower()).split()
        return out
    return _MARK.sub(rb" \1", chunk.lower()).split()


def _last_word(piece: bytes) -> bytes:
    body = piece.rstrip(_SPACES)
    at = max(body.rfind(b" "), body.rfind(b"\n"))
    return piece[max(at, 0) :]


def _first_word(piece: bytes) -> bytes:
    body = piece.lstrip(_SPACES)
    skipped = len(piece) - len(body)
    ends = [x for x in (body.find(b" "), body.find(b"\n", 0, 4096)) if x >= 0]
    return piece[: skipped + min(ends)] if ends else piece


def _ends(ids: np.ndarray, tail: np.ndarray) -> bool:
    return len(tail) == 0 or np.array_equal(ids[-len(tail) :], tail)


def _starts(ids: np.ndarray, head: np.ndarray) -> bool:
    return np.array_equal(ids[: len(head)], head)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _coded(batch: pa.RecordBatch, rest: list[str], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    """The batch's last column is the text."""
    c = codec(path)
    data, offsets = raw(batch.column(len(rest)))
    for i, j in slices(offsets):
        texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
        ids = c.encode(texts)
        decoded = [c.decode(x) for x in ids]
        cols = [batch.column(n).slice(i, j - i) for n in range(len(rest))]
        names = list(rest)
        cols += [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
        ]
        names += ["n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(cols, names)


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", full: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, and with ``full`` also ``ids`` and ``decoded``.

    ``keep`` names the columns that pass through (default: all but the text); of these, names of new columns are left out.
    """
    runtime.prepare(docs.sparkSession)
    path = path or word_tokenizer_path()
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        new += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    taken = {f.name for f in new}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in taken and (keep is not None or c != text)]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(runtime.fresh(keep)))
    schema = T.StructType([*src.schema.fields[: len(keep)], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _coded(batch, keep, path, full)

    return src.mapInArrow(run, schema)


def reuse(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``(chunk_bytes, new_bytes, encoded_bytes)``: bytes of the chunks of all texts, of those that a worker did not hold, and of what of these it had to encode. One row."""
    runtime.prepare(docs.sparkSession)
    path = path or word_tokenizer_path()
    names = ["chunk_bytes", "new_bytes", "encoded_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        before = [getattr(c, n) for n in names]
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for i, j in slices(offsets):
                c.encode([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)])
        yield pa.RecordBatch.from_arrays([pa.array([getattr(c, n) - b]) for n, b in zip(names, before, strict=True)], names)

    told = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    return told.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
