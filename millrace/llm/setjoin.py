"""Size-aware heavy-light Jaccard join of documents over their word shingles.

Two documents link when ``den * |A & B| >= num * |A | B|``. The join is exact and splits by set size at a boundary that
``boundary`` chooses by cost from the histogram of small sizes:

* light: for every pair of sizes up to the boundary the least overlap c that makes a link is known, so each set lists
  its subsets of c elements (c is close to the size, so there are few); two sets link if and only if they list one in
  common. Each list of equal subsets becomes a star, no pair is compared.
* heavy: every pair with a larger member shares r elements among the first ``n - ceil(n * num / den) + r`` of each in
  any common order. The order puts elements that many documents hold last: document frequencies of all shingles are
  counted on all rows, and every task has a table that gives the frequency of the most frequent element of each slot of
  hashes (at most ``2 * ORDERED`` slots; any order gives the same links, so this bounds a broadcast and nothing else).
  Inverted lists of these first elements give ties: a long list, or that of a frequent element, is a star; short lists
  give pairs, of which those whose sizes allow a link and that have r lists in common stay. The
  components of the ties are blocks, each set goes to its block once, and there the inverted lists are scanned for
  exact overlaps. In blocks of over ``BLOCK`` sets all sets are first compared with ``PIVOTS`` of them. What is linked
  with the pivots of the largest group (near copies mostly are) is connected and needs no comparison among itself, so
  parts of at most about ``BLOCK`` of the other sets are scanned against parts of all, each pair as a task of its own; if
  the others are most of the block, every pair of parts is.

Lists are merged in buckets of their elements, as many as keep ``BUCKET_SHINGLES`` elements of all sets for each, so a
bucket's table does not grow with the input. Equal sets are one class from the start: lists name classes and not documents, so copies that
lie in different tasks count once on a list. Lists are merged within a task before they are shuffled, and a block returns a
spanning forest of its links rather than the links, so copies are never expanded into pairs. Components come from
``runtime.components``. Shingles are 64-bit hashes of their words.

Documents without words (null, empty or blank text) have the empty set and link with nothing. A text of fewer than k
words has its whole sequence as its only element. Rows that share a key are one document, whose links are theirs
together; a null key gets a null component. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import runtime
from millrace.llm import textkernel as tk

#: Elements of which every task knows that they are frequent: two slots of a byte for each at least, eight if there are few.
ORDERED = 1 << 23
#: What lists keep of an element's hash: less would bring more pairs to compare, and more is bytes to shuffle. Subsets keep all.
KEPT_BITS = np.uint64(0xFFFFFFFFFF000000)
#: Words of 64 bits, at most, of the filter that spares texts outside blocks the shuffle; the join behind it is exact.
FILTER_WORDS = 1 << 18
#: An element is frequent from so many documents on.
FREQUENT = 16
#: A longer list is a star.
SHORT_LIST = 64
#: Sets that one task compares with each other, and sets of a large block that all of it is compared with first.
BLOCK, PIVOTS = 512, 16
#: Shingle hashes that a task holds before it sends what it has.
FLUSH = 2_000_000
#: Shingles of all sets for each bucket in which lists are merged, and the least number of buckets.
BUCKET_SHINGLES, LEAST_BUCKETS = 2_000_000, 32
#: The largest boundary that is considered.
MOST_LIGHT = 24
#: Cost of a posting on an inverted list, with what follows from it, in enumerated subsets.
SCAN_COST = 6.0


class Rule:
    """The link condition as integers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """Least number of common elements that links sets of a and b elements."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> tuple[int, int]:
        return -(-self.num * n // self.den), n * self.den // self.num

    def shared(self, n: int) -> int:
        """r: how many of the first elements a linked pair has in common at least; two if any, since one is often chance."""
        return max(1, n // 12, min(2, self.overlap(n, n)))

    def needed(self, n: np.ndarray) -> np.ndarray:
        """``shared`` of many sizes."""
        return np.maximum(np.maximum(n // 12, 1), np.minimum(2, -(-2 * self.num * n // (self.num + self.den))))

    def prefix(self, n: int) -> int:
        return n - (-(-self.num * n // self.den)) + self.shared(n)


def subset_count(n: int, x: int, rule: Rule) -> int:
    lo, hi = rule.partners(n)
    return sum(comb(n, rule.overlap(n, m)) for m in range(max(lo, 1), min(hi, x) + 1) if rule.overlap(n, m) <= min(n, m))


def boundary(sizes: dict[int, int], rule: Rule) -> int:
    """The size up to which listing subsets costs less than scanning lists. ``sizes``: documents by size, up to a bit over MOST_LIGHT."""

    def cost(x: int) -> float:
        light = sum(c * subset_count(n, x, rule) for n, c in sizes.items() if 0 < n <= x)
        heavy = sum(c * rule.prefix(n) for n, c in sizes.items() if n and rule.partners(n)[1] > x)
        return light + SCAN_COST * heavy

    return min(range(MOST_LIGHT + 1), key=cost)


def subsets(s: np.ndarray, x: int, rule: Rule) -> Iterator[int]:
    """Keys of the subsets that make a link with some set of up to x elements."""
    n = len(s)
    mixed = tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).tolist()
    total = sum(mixed)
    lo, hi = rule.partners(n)
    for m in range(max(lo, 1), min(hi, x) + 1):
        c = rule.overlap(n, m)
        if c > min(n, m):
            continue
        salt = (min(n, m) * 1000 + max(n, m)) * 0x9E3779B97F4A7C15
        for gone in combinations(mixed, n - c):
            yield (total - sum(gone) + salt) & ((1 << 64) - 1)


def _distinct_sets(batches: Iterator[pa.RecordBatch], k: int, table: np.ndarray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Classes and sets of each slice, the first of equal sets of a task only; no null keys, no empty sets."""
    seen: set[bytes] = set()
    for batch in batches:
        data, offsets = tk.raw(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in tk.slices(offsets):
            words = tk.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
            out_ids, out = [], []
            for d, s in zip(ids[i:j], tk.sets(words, k), strict=True):
                if d is None or not len(s):
                    continue
                sig = _sig(s)
                if sig not in seen:
                    seen.add(sig)
                    out_ids.append(_class(sig))
                    out.append(s)
            yield out_ids, out


def _sig(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _class(sig: bytes) -> int:
    """64 bits of a fingerprint, by which lists name a set."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _pack(x: np.ndarray) -> bytes:
    """Sorted integers as compressed differences, byte plane by byte plane."""
    step = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def buckets(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges (fewer than 2**32) of 64-bit hashes each one falls into."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _ranges(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(bucket, from, to)`` of the buckets that sorted bucket numbers name; what it costs depends on these, not on how many buckets there are."""
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    yield from zip(of[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True) if len(of) else ()


def shingle_sets(docs: DataFrame, k: int, table: np.ndarray, key: str, text: str) -> DataFrame:
    """``(doc_id, n, sig, class)``: size and fingerprint of each row's set, and the part of the fingerprint that lists name."""
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(1))
            n, sig = [], []
            for i, j in tk.slices(offsets):
                words = tk.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
                for s in tk.sets(words, k):
                    n.append(len(s))
                    sig.append(_sig(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(map(_class, sig), pa.int64())], ["doc_id", "n", "sig", "class"])

    return src.mapInArrow(run, "doc_id bigint, n bigint, sig binary, class bigint")


def frequent(docs: DataFrame, k: int, table: np.ndarray, key: str, text: str, parts: int) -> np.ndarray:
    """The binary logarithm of the count of the most frequent shingle in each slot, 0 without a frequent one; slots are ranges of hashes, a power of two of them."""
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bits = max(0, (parts - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[edge], np.diff(np.append(edge, len(keys))).clip(max=65535).astype(np.uint16)
            rows = list(_ranges(keys.astype(np.uint64) >> np.uint64(32 - bits)))
            comp = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([_pack(keys[x:y]) for _, x, y in rows], pa.binary()), pa.array([comp.compress(n[x:y].tobytes()) for _, x, y in rows], pa.binary())],
                ["bucket", "keys", "counts"],
            )

        for _, sets in _distinct_sets(batches, k, table):
            held += [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
            total += sum(map(len, sets))
            if total > FLUSH:
                yield from sent()
                held, total = [], 0
        if held:
            yield from sent()

    def merge(t: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(b, np.uint32) for b in t["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint16) for b in t["counts"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n, keys = np.add.reduceat(n, edge), keys[edge]
        big = n >= FREQUENT
        return pa.table({"key": pa.array(keys[big].astype(np.int64)), "n": pa.array(n[big])})

    ws = runtime.Workspace(docs.sparkSession)
    blocks = src.mapInArrow(count, "bucket int, keys binary, counts binary")
    found = ws.keep(blocks.groupBy("bucket").applyInArrow(merge, "key bigint, n bigint"), "frequent")
    classes = found.groupBy(F.floor(F.log2("n")).cast("int").alias("c")).count().collect()  # at most 63 rows
    least, total = 63, 0
    for c, n in sorted(((r["c"], r["count"]) for r in classes), reverse=True):
        if total + n > ORDERED:
            break
        least, total = c, total + n
    bits = min(max(10, (8 * total).bit_length()), (2 * ORDERED - 1).bit_length())
    slot, rank = F.shiftright("key", 32 - bits).cast("int").alias("slot"), F.floor(F.log2("n")).cast("byte").alias("rank")
    kept = found.where(F.floor(F.log2("n")) >= least).select(slot, rank).toPandas()  # at most ORDERED rows of 5 bytes
    ws.drop(found)
    ranks = np.zeros(1 << bits, np.uint8)
    np.maximum.at(ranks, kept["slot"].to_numpy(), kept["rank"].to_numpy().astype(np.uint8))
    return ranks


def prefix(s: np.ndarray, p: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first p elements of a sorted set, rare ones first, and their ranks, 0 for rare ones."""
    rank = ranks[s >> np.uint64(65 - len(ranks).bit_length())]
    if not rank.any():
        return s[:p], rank[:p]
    order = np.argsort(rank, kind="stable")[:p]
    return s[order], rank[order]


def _pairs(ids: np.ndarray, sizes: np.ndarray, less: np.ndarray, first: np.ndarray, length: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (larger, smaller) within lists whose sizes allow a link, and what they need; ``first`` and ``length`` tell the lists' places, ``less`` by how much a set needs less."""
    out = []
    for n in np.unique(length).tolist():
        if n < 2:
            continue
        x, y = np.triu_indices(n, 1)
        starts = first[length == n]
        for i in range(0, len(starts), step := max(1, FLUSH // len(x))):
            at = starts[i : i + step, None] + np.arange(n)
            u, v = at[:, x].ravel(), at[:, y].ravel()
            lo, hi = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
            keep = (rule.den * lo >= rule.num * hi) & (ids[u] != ids[v])
            u, v = u[keep], v[keep]
            fewer = np.maximum(less[u], less[v])
            need = np.where(fewer < 255, np.maximum(1, rule.needed(lo[keep]) - fewer), 1)
            out.append((np.maximum(ids[u], ids[v]), np.minimum(ids[u], ids[v]), need))
    if not out:
        return ids[:0], ids[:0], sizes[:0]
    p, q, need = (np.concatenate(c) for c in zip(*out, strict=True))
    return p, q, need


def _stars(tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, the smallest document on each one's list, and distinct ties (document, smallest) of all lists."""
    order = np.lexsort((ids, tokens))
    tokens, ids = tokens[order], ids[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    low = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    tied = ids != low
    if not tied.any():
        return tokens[first], ids[first], ids[:0], ids[:0]
    pairs = np.unique(np.stack([ids[tied], low[tied]], 1), axis=0)
    return tokens[first], ids[first], pairs[:, 0], pairs[:, 1]


def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes())


def _unplaned(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


PAIR, STAR, SURE = 0, 1, 2


def ties(docs: DataFrame, k: int, table: np.ndarray, key: str, text: str, rule: Rule, x: int, known: np.ndarray, parts: int) -> DataFrame:
    """``(a, b, n, need, sure)``: ties between classes on n common lists, of which a link needs ``need``; a common subset makes them sure."""
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(known)

    def send(kind: int, tokens: list[np.ndarray], ids: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            return
        t, d, size = np.concatenate(tokens), np.concatenate(ids), np.concatenate(sizes)
        rows = []
        if kind == PAIR:
            order = np.argsort(t, kind="stable")
            t, d, size = t[order], d[order], size[order]
        else:  # what meets within the task is tied here, and one document goes on for each list
            t, d, a, b = _stars(t, d)
            size = size[:0]
            if len(a):
                rows.append((parts + int(a[0] % parts), _planes(a), _planes(b), b""))
        rows += [(i, _pack(t[p:q]), _planes(d[p:q]), _planes(size[p:q])) for i, p, q in _ranges(buckets(t, parts))]
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([kind] * len(rows), pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "kind", "x", "y", "z"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = told.value
        held: dict[int, tuple[list, list, list]] = {kind: ([], [], []) for kind in (PAIR, STAR, SURE)}
        total = 0
        for out_ids, sets in _distinct_sets(batches, k, table):
            for d, s in zip(out_ids, sets, strict=True):
                n = len(s)
                new = []
                if n <= x:
                    new.append((SURE, np.fromiter(subsets(s, x, rule), np.uint64)))
                if rule.partners(n)[1] > x:
                    t, rank = prefix(s, rule.prefix(n), ranks)
                    t &= KEPT_BITS
                    new += [(PAIR, t[rank == 0]), (STAR, t[rank > 0])]
                for kind, t in new:
                    if len(t):
                        tokens, ids, sizes = held[kind]
                        # elements that differ only in what is not kept count once, so the set needs as many less
                        less = min(len(t) - len(np.unique(t)), 255) if kind == PAIR else 0
                        tokens.append(t)
                        ids.append(np.full(len(t), d, np.int64))
                        sizes.append(np.full(len(t), min(n, (1 << 24) - 1) << 8 | less, np.uint32))
                        total += len(t)
            if total > FLUSH:
                for kind, h in held.items():
                    yield from send(kind, *h)
                held = {kind: ([], [], []) for kind in held}
                total = 0
        for kind, h in held.items():
            yield from send(kind, *h)

    def merge(t: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]] = []
        ready = t["bucket"][0].as_py() >= parts
        for kind in (PAIR, STAR, SURE):
            part = t.filter(pa.compute.equal(t["kind"], kind))
            if not len(part):
                continue
            ids = np.concatenate([_unplaned(b, np.int64) for b in part["y"].to_pylist()])
            if ready:
                a, b = np.concatenate([_unplaned(b, np.int64) for b in part["x"].to_pylist()]), ids
                out.append((a, b, np.ones(len(a), np.int64), np.ones(len(a), np.int64), kind == SURE))
                continue
            tokens = np.concatenate([_unpack(b, np.uint64) for b in part["x"].to_pylist()])
            if kind == PAIR:
                sizes = np.concatenate([_unplaned(b, np.uint32) for b in part["z"].to_pylist()])
                order = np.lexsort((ids, tokens))
                tokens, ids, sizes = tokens[order], ids[order], sizes[order].astype(np.int64)
                once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])])  # copies from several tasks
                tokens, ids, sizes = tokens[once], ids[once], sizes[once]
                first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                length = np.diff(np.append(first, len(tokens)))
                long = np.repeat(length > SHORT_LIST, length)  # the other kinds are stars whatever their length
                short = length <= SHORT_LIST
                a, b, need = _pairs(ids, sizes >> 8, sizes & 255, first[short], length[short], rule)
                if len(a):
                    order = np.lexsort((b, a))
                    a, b, need = a[order], b[order], need[order]
                    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                    out.append((a[edge], b[edge], np.diff(np.append(edge, len(a))), need[edge], False))
            else:
                long = np.ones(len(tokens), bool)
            if long.any():
                _, _, a, b = _stars(tokens[long], ids[long])
                # a star stands for any number of lists
                out.append((a, b, np.full(len(a), 1 << 20), np.ones(len(a), np.int64), kind == SURE))
        return pa.concat_tables([pa.table({"a": a, "b": b, "n": n.astype(np.int64), "need": need, "sure": np.full(len(a), sure)}) for a, b, n, need, sure in out]) if out else _NO_TIES

    return src.mapInArrow(lists, "bucket int, kind int, x binary, y binary, z binary").groupBy("bucket").applyInArrow(merge, "a bigint, b bigint, n bigint, need bigint, sure boolean")


_NO_TIES = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n", "need")} | {"sure": pa.array([], pa.bool_())})


def forest(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], rule: Rule, across: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, found by scanning the inverted lists; with ``across`` only links between the two parts."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, parts, sets = ids[order], parts[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    start = np.concatenate([[0], np.cumsum(counts)])
    of = np.repeat(np.arange(len(sets)), n)
    lists = of[np.argsort(inverse, kind="stable")]  # ascending within a list
    filled = start[:-1].copy()  # how far each list is read: the sets before this one
    at = np.concatenate([[0], np.cumsum(n)])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i in range(len(sets)):
        mine = inverse[at[i] : at[i + 1]]
        lo, hi = start[mine], filled[mine]
        some = hi > lo
        if some.any():
            lo, length = lo[some], (hi - lo)[some]
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            common = np.bincount(lists[where], minlength=i)
            js = np.flatnonzero((rule.num + rule.den) * common >= rule.num * (n[: len(common)] + n[i]))
            for j in js.tolist():
                if j < i and (not across or parts[j] != parts[i]):
                    p, q = root(i), root(j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((int(ids[i]), int(ids[j])))
        filled[mine] += 1
    return found


def block_links(ws: runtime.Workspace, docs: DataFrame, members: DataFrame, k: int, table: np.ndarray, key: str, text: str, rule: Rule) -> DataFrame:
    """``(a, b)``: forests of the links within blocks. ``members (node, root, m)``: one row for each set, with its block and the block's size."""
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(1))
            for i, j in tk.slices(offsets):
                words = tk.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
                found = [s.tobytes() for s in tk.sets(words, k)]
                cols = [batch.column(c).slice(i, j - i) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.binary())], ["doc_id", "root", "m", "s"])

    def scan(t: pa.Table) -> pa.Table:
        raw = [(d, p, np.frombuffer(s, np.uint64)) for d, p, s in zip(t["doc_id"].to_pylist(), t["side"].to_pylist(), t["s"].to_pylist(), strict=True) if s]
        pairs = forest(np.array([r[0] for r in raw]), np.array([r[1] for r in raw]), [r[2] for r in raw], rule, t["across"][0].as_py()) if len(raw) > 1 else []
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    def scanned(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select("root", *by, "doc_id", "side", "across", "s").groupBy("root", *by).applyInArrow(scan, "a bigint, b bigint")

    def side(n: int, across: bool) -> list[Column]:
        return [F.lit(n).alias("side"), F.lit(across).alias("across")]

    # most texts lie in no block: a filter of bounded size drops nearly all of these before the shuffle
    words = min(FILTER_WORDS, 1 << max(10, (members.count() // 4).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    marks = members.select(bit("node").alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("marks"))
    passed = src.withColumn("at", bit("doc_id")).join(F.broadcast(marks), F.expr("at div 64 = word")).where("shiftrightunsigned(marks, cast(at % 64 as int)) % 2 <> 0").select("doc_id", "text")
    # rows that share a key are all in; each has its own set
    # both sides grow with the input, so neither is broadcast, however small it is
    held = passed.hint("merge").join(members, F.col("doc_id") == F.col("node")).select("doc_id", "text", "root", "m")
    rows = ws.keep(held.mapInArrow(sets, "doc_id bigint, root bigint, m bigint, s binary"), "members")
    small = scanned(rows.where(F.col("m") <= BLOCK).select("*", *side(0, False)))
    large = rows.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return small

    # all sets of a large block against its pivots, in salted groups that each hold the pivots
    chosen = large.groupBy("root").agg(F.array_distinct(F.array(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(i))) for i in range(PIVOTS)])).alias("p"))
    pivots = large.join(chosen.select("root", F.explode("p").alias("doc_id")), ["root", "doc_id"], "left_semi")
    salts = F.ceil(F.col("m") / BLOCK).cast("int")
    met = large.select("*", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), *side(0, True)).unionByName(pivots.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *side(1, True)))
    near = ws.keep(scanned(met, "salt"), "near")

    # what is linked with the pivots of the largest group needs no comparison among itself
    groups = runtime.components(ws, near).withColumnRenamed("root", "label")
    ids = large.select("doc_id", "root", "m").distinct()
    labelled = ws.keep(ids.join(groups, ids.doc_id == groups.node, "left").select("doc_id", "root", "m", F.coalesce("label", "doc_id").alias("label")), "labelled")
    sizes = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n")).alias("others"))
    told = labelled.join(top, "root").select("doc_id", "root", (F.col("label") != F.col("top")).alias("other"), "others")
    each = large.join(told, ["doc_id", "root"]).where("others > 0")
    parts, few = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("others") / BLOCK).cast("int")
    part, rest = F.pmod(F.xxhash64("doc_id"), parts).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), few).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lean = each.where(2 * F.col("others") <= F.col("m"))
    x = lean.select("root", part.alias("i"), upto(few).alias("j"), "doc_id", "s", *side(0, True))
    y = lean.where("other").select("root", upto(parts).alias("i"), rest.alias("j"), "doc_id", "s", *side(1, True))
    full = each.where(2 * F.col("others") > F.col("m")).select("root", part.alias("p"), upto(parts).alias("o"), "doc_id", "s")
    z = full.select("root", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "doc_id", "s", F.col("p").alias("side"), (F.col("p") != F.col("o")).alias("across"))
    return small.unionAll(near).unionAll(scanned(x.unionByName(y), "i", "j")).unionAll(scanned(z, "i", "j"))


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, table: np.ndarray = tk.NON_SPACE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: set size and the smallest key that links lead to."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    ws = runtime.Workspace(spark)
    rule = Rule(num, den)
    sets = ws.keep(shingle_sets(docs, k, table, key, text), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    parts = max(LEAST_BUCKETS, -(-(full.agg(F.sum("n")).first()[0] or 0) // BUCKET_SHINGLES))
    sizes = {r["n"]: r["count"] for r in full.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}  # at most 2 * MOST_LIGHT rows
    x = boundary(sizes, rule)
    known = frequent(docs, k, table, key, text, parts)
    tied = ws.keep(ties(docs, k, table, key, text, rule, x, known, parts), "ties")
    first = ws.keep(full.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("m"), F.first("class").alias("class")), "classes")
    same = ws.keep(full.join(first, "sig").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same")
    counted = tied.where("not sure").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs of classes as pairs of their first documents."""
        x, y = (first.select(F.col("class").alias(f"c{i}"), F.col("rep").alias(f"r{i}")) for i in (1, 2))
        return pairs.join(x, F.col("a") == F.col("c1")).join(y, F.col("b") == F.col("c2")).select(F.col("r1").alias("a"), F.col("r2").alias("b"))

    maybe = named(counted.where("n >= need").select("a", "b"))
    blocks = runtime.components(ws, maybe.unionAll(same))
    reps = first.select("rep").distinct()
    inside = ws.keep(blocks.join(reps, blocks.node == reps.rep, "left_semi"), "inside")
    count = inside.groupBy("root").agg(F.count("*").alias("m")).where("m > 1")
    exact = ws.keep(block_links(ws, docs, ws.keep(inside.join(count, "root").select("node", "root", "m"), "blocks"), k, table, key, text, rule), "links")
    edges = exact.unionAll(named(tied.where("sure").select("a", "b").distinct())).unionAll(same)
    roots = runtime.components(ws, edges)
    ws.drop(tied, first, same, inside, exact)
    out = sets.join(roots, sets.doc_id == roots.node, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


#: The same in DuckDB, for four words and 85 %: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
