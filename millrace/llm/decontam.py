"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long, so their sets are compared at the items' scale. Items are partitioned by set size,
with a factor of ``STEP`` from one partition to the next; for a partition with up to U shingles a document is covered by
windows of 3U shingles, U apart, so a passage of up to 2U shingles lies whole in a window whose similarity to an item
that it contains is bounded from below whatever the document's length. A window and an item with one of ``HASHES``
MinHash values in common are a candidate: at a containment of 0.8 and the least favourable sizes a pair is missed with
a probability below 1e-3, for whole copies below 1e-7 (simulated: at most 7e-6 and 8e-8). Windows are too wide for items
of up to ``EXACT`` shingles; these are looked up by their rarest shingles, so many that a match holds one of them, and
none is missed. Candidates are verified by exact containment, the share of the
item's distinct shingles that are in the document.

Items are a stated query set, taken in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text (an item that
is longer is a block of its own). Blocks go to the driver one at a time; each is broadcast, matched against all documents
in one pass whose result is written, and released, so what is held does not grow with the number of items. Documents are
never shuffled, so hot passages and copies cost what other rows cost.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. An item of fewer than k words
is its whole sequence, contained where that sequence of words occurs. Null, empty and wordless items and documents match
nothing. Repeated rows are reported once for each document row. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import runtime
from millrace.llm import textkernel as tk

HASHES, STEP, LEAST_U = 48, 1.5, 8
#: Items of up to so many shingles are found by the shingles themselves.
EXACT = 16
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 40 << 20
#: Positions whose MinHash values are first reduced together.
GRAIN = 8
_LAST = np.uint64((1 << 64) - 1)


class Mask:
    """A first, rough test of membership by the upper bits of a hash, as large as its members need."""

    def __init__(self, members: np.ndarray) -> None:
        bits = min(18, max(8, int(len(members) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[members >> self.shift] = True

    def maybe(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that may be members."""
        return np.flatnonzero(self.table[values >> self.shift])


class Items:
    """A block of items: shingle sets, MinHash values by partition, and the sequences of items of fewer than k words."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, num: int = 4, den: int = 5) -> None:
        data, offsets = tk.raw(pa.array(texts, pa.string()))
        words = tk.Words(data, offsets, tk.ALNUM)
        lengths = np.diff(words.of)
        sets = list(tk.sets(words, k))
        self.k = k
        self.ids = ids
        self.sets = sets
        self.short: dict[int, dict[int, list[int]]] = {}
        self.seeds = [np.uint64((0x9E3779B97F4A7C15 * (h + 1)) & ((1 << 64) - 1)) for h in range(HASHES)]
        self.factors = [tk.mix(np.array([h + 1], np.uint64))[0] | np.uint64(1) for h in range(HASHES)]
        by_u: dict[int, list[int]] = {}
        few = [i for i, s in enumerate(sets) if lengths[i] >= k and len(s) <= EXACT]
        self.keys, self.keyed = self._keys(few, num, den)
        self.key_mask = Mask(self.keys)
        for i, s in enumerate(sets):
            if 0 < lengths[i] < k:
                seq = words.hashes[words.of[i] : words.of[i + 1]]
                run = int(tk.shingles(seq, len(seq))[0]) if len(seq) > 1 else int(seq[0])
                self.short.setdefault(len(seq), {}).setdefault(run, []).append(i)
            elif len(s) > EXACT:
                u = LEAST_U
                while u < len(s):
                    u = int(np.ceil(u * STEP / GRAIN) * GRAIN)
                by_u.setdefault(u, []).append(i)
        #: for each partition and hash: the sorted values and the items they belong to
        self.parts = {u: [self._sorted(members, h) for h in range(HASHES)] for u, members in by_u.items()}

    def _keys(self, members: list[int], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingles and their items: of each item so many, those in the fewest items first, that a match holds one of them."""
        if not members:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names, times = np.unique(np.concatenate([self.sets[i] for i in members]), return_counts=True)
        keys = []
        for i in members:
            s = self.sets[i]
            least = max(1, -(-num * len(s) // den))
            keys.append(s[np.argsort(times[np.searchsorted(names, s)], kind="stable")[: max(0, len(s) - least + 1)]])
        of = np.repeat(members, [len(x) for x in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        return every[order], of[order]

    def _sorted(self, members: list[int], h: int) -> tuple[np.ndarray, np.ndarray, Mask]:
        v = np.array([((self.sets[i] ^ self.seeds[h]) * self.factors[h]).min() for i in members], np.uint64)
        order = np.argsort(v, kind="stable")
        return v[order], np.array(members)[order], Mask(v)


def _covering(first: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of up to ``width`` grains, ``step`` apart, that cover each text: starts, ends and texts. ``first``: each text's first grain."""
    size = np.diff(first)
    count = np.where(size == 0, 0, np.maximum(1, -(-(size - width) // step) + 1))
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + np.minimum(nth * step, np.maximum(size[text] - width, 0))
    return start, np.minimum(start + width, first[text + 1]), text


def matches(words: tk.Words, items: Items) -> Iterator[tuple[int, int, int]]:
    """``(text, item, common shingles)`` of a slice."""
    k = items.k
    every = tk.shingles(words.hashes, k)
    begin = np.minimum(words.of[:-1], len(every))
    spans = np.stack([begin, np.maximum(begin, words.of[1:] - k + 1)], 1)
    found: dict[int, set[int]] = {}
    if len(items.keys) and len(every):
        at = items.key_mask.maybe(every)
        lo, hi = (np.searchsorted(items.keys, every[at], side) for side in ("left", "right"))
        text = np.searchsorted(words.of, at, "right") - 1
        for j in np.flatnonzero((hi > lo) & (at + k <= words.of[text + 1])).tolist():
            found.setdefault(int(text[j]), set()).update(items.keyed[lo[j] : hi[j]].tolist())
    if items.parts and len(every):
        number = -(-(spans[:, 1] - spans[:, 0]) // GRAIN)
        first = np.concatenate([[0], np.cumsum(number)])
        # grains start anew with each text; shingles over the border of two texts never win a minimum
        at = np.repeat(spans[:, 0], number) + (np.arange(first[-1]) - np.repeat(first[:-1], number)) * GRAIN
        outside = np.ones(len(every) + 1, np.int8)
        for d, where in ((-1, spans[:, 0]), (1, spans[:, 1])):
            np.add.at(edge := np.zeros(len(every) + 1, np.int32), where, d)
            outside = outside + np.cumsum(edge)
        outside = np.flatnonzero(outside[:-1] > 0)
        windows = {}
        levels = 0
        for u in items.parts:
            start, end, text = _covering(first, 3 * u // GRAIN + 1, u // GRAIN)
            level = np.frexp((end - start).astype(np.float64))[1] - 1
            windows[u] = [(lv, pick, start[pick], end[pick] - (1 << lv), text[pick]) for lv in np.unique(level).tolist() for pick in [np.flatnonzero(level == lv)]]
            levels = max(levels, int(level.max(initial=0)))
        for h in range(HASHES if len(at) else 0):
            v = (every ^ items.seeds[h]) * items.factors[h]
            v[outside] = _LAST
            tables = [np.minimum.reduceat(v, at)]
            for lv in range(levels):  # minima of 2 ** (lv + 1) grains
                tables.append(np.minimum(tables[-1][: -(1 << lv)], tables[-1][1 << lv :]) if len(tables[-1]) > 1 << lv else tables[-1][:0])
            for u, parts in items.parts.items():
                values, members, mask = parts[h]
                for lv, _, start, end, text in windows[u]:
                    win = np.minimum(tables[lv][start], tables[lv][end])
                    maybe = mask.maybe(win)
                    if not len(maybe):
                        continue
                    lo = np.searchsorted(values, win[maybe])
                    hit = (lo < len(values)) & (values[np.minimum(lo, len(values) - 1)] == win[maybe])
                    for i, j in zip(maybe[hit].tolist(), lo[hit].tolist(), strict=True):
                        while j < len(values) and values[j] == win[i]:
                            found.setdefault(int(text[i]), set()).add(int(members[j]))
                            j += 1
    for t, members in sorted(found.items()):
        have = np.unique(every[spans[t][0] : spans[t][1]])
        for i in sorted(members):
            s = items.sets[i]
            where = np.minimum(np.searchsorted(have, s), len(have) - 1)
            yield t, i, int((have[where] == s).sum())
    for n, runs in items.short.items():
        h = tk.shingles(words.hashes, n) if n > 1 else words.hashes
        hit = np.flatnonzero(np.isin(h, np.array(list(runs), np.uint64)))
        text = np.searchsorted(words.of, hit, "right") - 1
        inside = hit + n <= words.of[text + 1]
        for t, run in sorted({(int(t), int(h[i])) for t, i in zip(text[inside], hit[inside], strict=True)}):
            for i in runs[run]:
                yield t, i, 1


def containment(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_item, n_common)`` of all pairs with ``den * n_common >= num * n_item``."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    q = items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    src = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ids, item_ids = (x.schema[0].dataType.simpleString() for x in (src, q))
    schema = f"doc_id {ids}, item_id {item_ids}, n_item bigint, n_common bigint"
    item_type = q.limit(0).toArrow().schema.field(0).type
    ws = runtime.Workspace(spark)
    found = []
    for rows in _blocks(q):
        told = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], k, num, den))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            block = told.value
            for batch in batches:
                data, offsets = tk.raw(batch.column(1))
                hits: list[tuple[int, int, int]] = []
                for i, j in tk.slices(offsets):
                    words = tk.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tk.ALNUM)
                    hits += [(i + t, m, c) for t, m, c in matches(words, block) if den * c >= num * len(block.sets[m])]
                cols = [
                    batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([block.ids[h[1]] for h in hits], item_type),
                    pa.array([len(block.sets[h[1]]) for h in hits], pa.int64()),
                    pa.array([h[2] for h in hits], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_item", "n_common"])

        found.append(ws.keep(src.mapInArrow(run, schema), "found"))
        told.destroy()
    return reduce(DataFrame.unionAll, found)


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of the items in blocks, read partition by partition; one empty block if there are none."""
    held, size, some = [], 0, False
    for row in items.toLocalIterator():
        n = len((row["text"] or "").encode())
        if held and (len(held) >= BLOCK_ITEMS or size + n > BLOCK_BYTES):
            yield held
            held, size, some = [], 0, True
        held.append(row)
        size += n
    if held or not some:
        yield held


def clean(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item. Rows with a null key are kept."""
    ws = runtime.Workspace(docs.sparkSession)
    found = containment(docs, items, k, num, den, key, text).where("doc_id is not null")
    gone = runtime.fresh(docs.columns, "__hit")
    hit = ws.keep(found.select(F.col("doc_id").alias(gone)).distinct(), "hits")
    return docs.join(hit, docs[f"`{key}`"] == hit[gone], "left_anti")


#: The same in DuckDB; items have five words or more in the given tables.
ORACLE = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM t),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY 1)
SELECT d.id AS doc_id, i.id AS item_id, n.n::BIGINT AS n_item, count(*)::BIGINT AS n_common
FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.g = i.g JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING 5 * count(*) >= 4 * n.n
"""
