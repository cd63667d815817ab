"""Maximal periodic runs of words by Main-Lorentz divide and conquer.

The words of a text are interned as numbers. The text is halved again and again; a run that crosses a midpoint, with at
least half of its words on one side of it, is found from four Z-functions of the two halves: for a period p they tell how
far the text before and behind the midpoint agrees with itself p words away, which is as far as the run extends. A run
that goes on beyond its segment also crosses the midpoint of a larger one and is found whole there. Equal intervals are
found with multiples of their period too; the smallest is kept, and it is the smallest period there is, since the periods
of an interval of three or more of them all are multiples of the smallest.

Most midpoints have no run. Half of a run of ``least`` words and ``times`` periods repeats at least ``_gram`` words next to
the midpoint, so one vectorised pass for each level compares hashes of that many words with those at the midpoint, and
Z-functions are worked out for the few segments that agree there. The pass may let others through and never misses one.

Each text is read by one task as a whole, in O(n log n) time and O(n) memory; nothing is shuffled, so no key can be hot and
a lost task is just run again.

Null, empty and blank texts have no runs and collapse to the empty text. Repeated rows give equal rows, an empty table an
empty one. Very long texts are read as any others. Further columns pass through unless their names clash with the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import runtime
from millrace.llm.textkernel import mix, raw, slices

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_TIMES = 24, 3
_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_ARROW_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def z_function(s: list[int]) -> list[int]:
    """For each position how many elements from there on equal those from the start on; 0 for the start itself."""
    n = len(s)
    z = [0] * n
    left = right = 0  # the prefix equals s[left:right]
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _gram(least: int, times: int) -> int:
    """Words that repeat next to the midpoint, on the side that holds half of the run or more, whatever the period."""
    return min(_need(p, least, times) for p in range(1, least + 1))


def _need(p, least: int, times: int):  # noqa: ANN001, ANN202
    """How many words of the larger side agree with those p words further."""
    return np.maximum(-(-least // 2) - p, -(-(times * p) // 2) - p)


def _candidates(ids: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``(lo, mid, hi, periods seen to the right, periods seen to the left)`` of the segments that may have a run over their midpoint."""
    n, g = len(ids), _gram(least, times)
    wide = ids.astype(np.uint64) + np.uint64(1)
    grams = np.zeros(n - g + 1, np.uint64)
    for i in range(g):
        grams += wide[i : i + len(grams)] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1) | 1)
    grams = mix(grams)
    cuts = np.array([0, n], np.int64)
    last = len(grams) - 1
    while True:
        lo, hi = cuts[:-1], cuts[1:]
        if (hi - lo).max() < least:
            return
        mid = (lo + hi) // 2
        starts = np.empty(2 * len(lo), np.int64)
        starts[0::2], starts[1::2] = lo, mid
        ends = np.empty_like(starts)
        ends[0::2], ends[1::2] = mid, hi
        pivots = np.empty_like(starts)
        pivots[0::2], pivots[1::2] = np.clip(mid - g, 0, last), np.clip(mid, 0, last)
        hit = np.flatnonzero(np.repeat(grams[pivots], ends - starts)[: len(grams)] == grams)
        half = np.searchsorted(starts, hit, "right") - 1
        # empty halves share their start with the next one, which is the one found
        seg, right = half // 2, half % 2 == 1
        p = np.where(right, hit - mid[seg], mid[seg] - g - hit)
        need = _need(p, least, times)
        here = np.where(right, mid[seg] + need - g, mid[seg] - need)
        there = np.where(right, here + p, here - p)
        fits = (p > 0) & (p * times <= hi[seg] - lo[seg]) & (hi[seg] - lo[seg] >= least)
        fits &= np.where(right, there + g <= hi[seg], there >= lo[seg])
        fits[fits] = grams[here[fits]] == grams[there[fits]]
        seg, right, p = seg[fits], right[fits], p[fits]
        for s in np.unique(seg).tolist():
            mine = seg == s
            yield int(lo[s]), int(mid[s]), int(hi[s]), p[mine & right], p[mine & ~right]
        cuts = np.unique(np.concatenate([cuts, mid]))


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal run of at least ``least`` elements and ``times`` (three or more) smallest periods, by start, then period."""
    if _gram(least, times) < 1:
        raise ValueError("runs need three periods and a few words at least")
    n = len(ids)
    if n < least:
        return []
    found: dict[tuple[int, int], int] = {}
    for lo, mid, hi, to_right, to_left in _candidates(ids, least, times):
        u, v = ids[lo:mid].tolist(), ids[mid:hi].tolist()
        back, both = u[::-1], u + v
        spans = []
        if len(to_right):
            ahead, behind = z_function(v), z_function([*back, -1, *both[::-1]])
            for p in to_right.tolist():
                spans.append((mid - behind[len(u) + 1 + len(v) - p], mid + p + ahead[p], p))
        if len(to_left):
            behind, ahead = z_function(back), z_function([*v, -1, *both])
            for p in to_left.tolist():
                spans.append((mid - p - behind[p], mid + ahead[len(v) + 1 + len(u) - p], p))
        for start, end, p in spans:
            goes_on = (start == lo > 0 and ids[lo - 1] == ids[lo - 1 + p]) or (end == hi < n and ids[hi] == ids[hi - p])
            if end - start >= max(least, times * p) and not goes_on and p < found.get((start, end), n):
                found[start, end] = p
    return sorted((start, end - start, p) for (start, end), p in found.items())


def kept_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _interned(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _read(batch: pa.RecordBatch, rest: list[str], least: int, times: int) -> Iterator[pa.RecordBatch]:
    """The batch's last column is the text."""
    data, offsets = raw(batch.column(len(rest)))
    for i, j in slices(offsets):
        runs, texts = [], []
        for k in range(i, j):
            words = data[offsets[k] : offsets[k + 1]].tobytes().split()  # at space, tab, LF, VT, FF and CR
            got = find_runs(_interned(words), least, times) if len(words) >= least else []
            if got:
                keep = kept_mask(len(words), got)
                words = [w for w, stays in zip(words, keep.tolist(), strict=True) if stays]
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
            texts.append(b" ".join(words).decode())
        cols = [*[batch.column(c).slice(i, j - i) for c in range(len(rest))], pa.array(runs, _ARROW_RUN), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [*rest, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES, keep: list[str] | None = None) -> DataFrame:
    """Adds ``runs``, every maximal run of words (``start, length, period``, by start, then period), and ``collapsed``, the words that are not in a run behind its first period, joined by one space.

    Words are what stands between spaces, tabs and line ends. ``keep`` names the columns that pass through (default: all but the text).
    """
    runtime.prepare(docs.sparkSession)
    if _gram(least, times) < 1:
        raise ValueError("runs need three periods and a few words at least")
    taken = {"runs", "collapsed"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken and (keep is not None or c != text)]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(runtime.fresh(keep)))
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _read(batch, keep, least, times)

    return src.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, the first of equals; null without a run."""
    none = F.lit(None).cast(_RUN.elementType)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
