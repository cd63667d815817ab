"""Repair of conversation structure by the cheapest edits.

A conversation's roles should read ``(s?(ua)+)?``: nothing, or an optional system turn and then user and assistant turns in
pairs. Each row can be kept, given another role or deleted, and empty turns can be inserted; a Viterbi pass over the four
states of that grammar (nothing yet, behind s, behind u, behind a) carries the least (cost, audit string) of each state
from turn to turn. Inserts close a layer: from a state at most two are ever worth it, so what they lead to is worked out
once for each kind of row (``_STEPS``) and a row costs a few comparisons.

No group meets in one task. Rows are sorted by conversation and turn into ranges, so a conversation with a large share of
the rows lies over many ranges; each range gives, for each of its pieces of conversations, the best path from each state to
each state; a fold over pieces, of which there are no more than ranges and which for this carry numbers and no strings,
picks the path; and what was picked goes back to the rows by an equi-join on their place. Paths are compared by cost, then
as strings: of two paths over the same rows that end with a row neither begins with the other, since inserts cost something,
so an order among the at most four best of a piece is enough to compare what they are continued to.

A row's first fault counts: blank (no character but spaces, tabs and line ends), duplicate (role and text as in an earlier
row of the conversation), truncated (the last such character ends no sentence). Blank and duplicate rows must go. Null
conversations are one conversation, null turns come first, null roles and texts are one space. Rows of one turn are in the
order of role and text; repeated rows are duplicates. Very long texts and conversations are read as any others; no rows
give no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import runtime

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: States: nothing yet, behind s, behind u, behind a.
_INITIALS = "sua"
_GOES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: What ends a conversation from each state: the cost and the edits, each a letter and the role it makes.
_CLOSE = [(0, ""), (2 * INSERT, "IuIa"), (INSERT, "Ia"), (0, "")]
_STATES = range(4)
#: Conversations whose rows have one of three conditions: sound, truncated, and to be deleted.
SOUND, TRUNCATED, GONE = 0, 1, 2


def _reach(state: int) -> list[tuple[int, int, str]]:
    """``(state, cost, edits)`` of what inserts lead to."""
    out, seen, at, cost, told = [(state, 0, "")], {state}, state, 0, ""
    while True:
        role = next(r for r in "ua" if at in _GOES[r])
        at, cost, told = _GOES[role][at], cost + INSERT, f"{told}I{role}"
        if at in seen:
            return out
        seen.add(at)
        out.append((at, cost, told))


def _steps(initial: str, condition: int) -> list[list[tuple[int, int, str]]]:
    """For each state behind the row the ways there: (state before, cost, edits); one, the best, for each state before."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = CUT if condition == TRUNCATED else 0
    for b in _STATES:
        for x, cost, told in _reach(b):
            ways = [(x, DELETE, "D-")]
            if condition != GONE:
                ways += [(_GOES[initial][x], KEEP + extra, f"K{initial}")] if x in _GOES.get(initial, {}) else []
                ways += [(_GOES[r][x], REROLE + extra, f"R{r}") for r in "ua" if x in _GOES[r]]
            for c, more, letter in ways:
                best[b, c] = min(best.get((b, c), (1 << 60, "")), (cost + more, told + letter))
    return [[(b, *best[b, c]) for b in _STATES if (b, c) in best] for c in _STATES]


_STEPS = {(i, k): _steps(i, k) for i in (*_INITIALS, "") for k in (SOUND, TRUNCATED, GONE)}


class _Piece:
    """The best paths over consecutive rows of a conversation, from each given state to each state behind the last row."""

    def __init__(self, starts: list[int]) -> None:
        # (cost, rank among the paths of this start) of each state; rank orders the paths as strings
        self.best = {b: {b: (0, 0)} for b in starts}
        self.back: dict[int, list[dict[int, tuple[int, str]]]] = {b: [] for b in starts}
        self.first = self.last = ""
        self.n = self.illegal = 0

    def add(self, initial: str, condition: int) -> None:
        self.illegal += self.n > 0 and self.last + initial not in ("su", "ua", "au")
        self.first = self.first if self.n else initial
        self.last = initial
        self.n += 1
        steps = _STEPS[initial if initial in ROLES else "", condition]
        for start, states in self.best.items():
            won = {}
            for c in _STATES:
                ways = [(states[b][0] + cost, states[b][1], told, b) for b, cost, told in steps[c] if b in states]
                if ways:
                    won[c] = min(ways)
            order = {key: i for i, key in enumerate(sorted((w[1], w[2]) for w in won.values()))}
            self.best[start] = {c: (w[0], order[w[1], w[2]]) for c, w in won.items()}
            self.back[start].append({c: (w[3], w[2]) for c, w in won.items()})

    def paths(self) -> Iterator[tuple[int, int, int, int, str]]:
        """``(start, end, cost, rank, edits)``."""
        for start, states in self.best.items():
            for end, (cost, rank) in states.items():
                told, c = [], end
                for layer in reversed(self.back[start]):
                    c, step = layer[c]
                    told.append(step)
                yield start, end, cost, rank, "".join(reversed(told))


_PIECES = "part long, at long, n long, first string, last string, illegal long, b int, c int, cost long, rank int, edits string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, ``(part, head, at, initial, condition)``, to the best paths of their pieces; ``head`` marks the first row of a conversation in its range."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    part, at, piece = None, 0, None
    done: list[tuple] = []

    def close() -> None:
        if piece is not None:
            done.extend((part, at, piece.n, piece.first, piece.last, piece.illegal, *p) for p in piece.paths())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    held = 0
    for batch in batches:
        for p, head, pos, initial, condition in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if p != part or head:
                close()
                held += piece.n if piece is not None else 0
                # only the first piece of a range can go on from another range
                piece = _Piece(list(_STATES) if p != part else [0])
                part, at = p, pos
            piece.add(initial, condition)
        if held > 20_000:
            yield batch_of(done)
            done.clear()
            held = 0
    close()
    if done:
        yield batch_of(done)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each conversation in order, ``(conv, part, at, n, first, last, illegal, paths)``, to the ways picked: ``(conv, part, b, c, cost, illegal, ends)``."""
    key, pieces = None, []
    out: list[tuple] = []
    schema = None

    def close() -> None:
        states, backs = {0: (0, 0)}, []
        illegal, last = 0, None
        for row in pieces:
            illegal += row["illegal"] + (last is not None and last + row["first"] not in ("su", "ua", "au"))
            last = row["last"]
            ways: dict[int, tuple] = {}
            for w in row["paths"]:
                if w["b"] in states:
                    cost, rank = states[w["b"]]
                    this = (cost + w["cost"], rank, w["rank"], w["b"])
                    ways[w["c"]] = min(ways.get(w["c"], this), this)
            order = {k: i for i, k in enumerate(sorted(w[1:] for w in ways.values()))}
            states = {c: (w[0], order[w[1:]]) for c, w in ways.items()}
            backs.append({c: w[3] for c, w in ways.items()})
        cost, _, c = min((cost + _CLOSE[c][0], rank, c) for c, (cost, rank) in states.items())
        ends = _CLOSE[c][1]
        for row, back in zip(reversed(pieces), reversed(backs), strict=True):
            out.append((key, row["part"], row["at"], row["n"], back[c], c, cost, illegal, ends))
            c, ends = back[c], None

    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if not pieces or row["conv"] != key:
                if pieces:
                    close()
                key, pieces = row["conv"], []
            pieces.append(row)
        if len(out) > 20_000:
            yield _folded(out, schema)
            out.clear()
    if pieces:
        close()
    if out:
        yield _folded(out, schema)


def _folded(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    types = [schema.field("conv").type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = ["conv", "part", "at", "n", "b", "c", "cost", "illegal", "ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class Repair:
    """The repair of the conversations of ``rows``; the tables below are DataFrames over what it has written to the shared folder.

    ``turns``: ``(conv, at, j, edit, role, text)``, the turns that stay or are put in, in the order of (at, j) within a conversation.
    ``summary``: ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row for each conversation.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> None:
        spark = rows.sparkSession
        runtime.prepare(spark)
        ws = runtime.Workspace(spark)
        named = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
        same = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
        end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
        # the id tells equal rows apart, so that any number of them can be dealt to several ranges
        told = named.select("*", same.alias("same"), (F.trim("text", F.lit(BLANKS)) == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("id"))
        order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "id")]
        placed = told.repartitionByRange(*order).sortWithinPartitions(*order).drop("id")
        self._placed = ws.keep(placed.withColumn("at", F.monotonically_increasing_id()), "placed")  # rows of a range are numbered in order
        light = self._placed.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "same", "blank", "cut", "at", F.shiftright("at", 33).alias("part"))
        first = light.where("not blank").groupBy("conv", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
        heads = light.groupBy("conv", "part").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("head"))
        fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
        marked = light.join(first, "at", "left").join(heads, "at", "left")
        #: A row's conversation, turn and fault, and where it stands.
        self.rows = ws.keep(marked.select("conv", "turn", "initial", "at", "part", fault.alias("fault"), F.coalesce("head", F.lit(False)).alias("head")), "rows")

        condition = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(SOUND)
        seen = self.rows.select("part", "head", "at", "initial", condition.alias("condition"))
        pieces = seen.repartition("part").sortWithinPartitions("part", "at").mapInArrow(_pieces, _PIECES)
        self._pieces = ws.keep(pieces, "pieces")
        whose = self.rows.where("head").select("conv", "at")
        best = self._pieces.groupBy("part", "at", "n", "first", "last", "illegal").agg(F.collect_list(F.struct("b", "c", "cost", "rank")).alias("paths"))  # 16 at most
        named = best.join(whose, "at").select("conv", "part", "at", "n", "first", "last", "illegal", "paths")
        kind = self.rows.schema["conv"].dataType.simpleString()
        schema = f"conv {kind}, part long, at long, n long, b int, c int, cost long, illegal long, ends string"
        # a conversation has a row for each range that it lies in
        folded = named.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_fold, schema)
        self._picked = ws.keep(folded.join(self._pieces.select("part", "at", "b", "c", "edits"), ["part", "at", "b", "c"]), "picked")

    @property
    def turns(self) -> DataFrame:
        row = self._picked.select("at", F.posexplode(F.regexp_extract_all("edits", F.lit("((?:I.)*[KRD].)"))).alias("k", "edits"))
        mine = self._placed.select("conv", "at", "role", "text").join(row.select((F.col("at") + F.col("k")).alias("at"), "edits"), "at")
        ends = self._picked.where("ends <> ''").select("conv", (F.col("at") + F.col("n") - 1).alias("at"), F.lit(1_000_000).alias("base"), F.col("ends").alias("edits"), F.lit("").alias("role"), F.lit("").alias("text"))
        every = mine.select("conv", "at", F.lit(0).alias("base"), "edits", "role", "text").unionByName(ends)
        each = every.select("*", F.posexplode(F.regexp_extract_all("edits", F.lit("([KRDI].)"))).alias("j", "e")).where(~F.col("e").startswith("D"))
        letter, to = F.substring("e", 1, 1), F.substring("e", 2, 1)
        full = F.when(letter == "K", F.col("role")).when(to == "u", ROLES["u"]).otherwise(ROLES["a"])
        return each.select("conv", "at", (F.col("base") + F.col("j")).alias("j"), letter.alias("edit"), full.alias("role"), F.when(letter == "I", "").otherwise(F.col("text")).alias("text"))

    @property
    def summary(self) -> DataFrame:
        numbers = self.rows.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
        faults = numbers.groupBy("conv").agg(gaps, *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        said = F.concat("edits", F.coalesce("ends", F.lit("")))
        paths = self._picked.groupBy(F.col("conv").alias("__c")).agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("part", said.alias("e")))).alias("p"))
        audit = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["e"]), ""), "(.).", "$1")
        both = faults.join(paths, F.col("conv").eqNullSafe(F.col("__c")))
        return both.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha, out, kind = None, None, [], None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if sha is None or conv != key:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], ["conv", "sha"])
            out.clear()
    if sha is not None:
        out.append((key, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], ["conv", "sha"])


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, sha)`` of conversations with turns: SHA-256 of the turns as ``role:text`` lines. A conversation's turns stream through one task in order, as such a digest needs; memory does not grow with them."""
    lines = turns.select("conv", "at", "j", "role", "text")
    kind = turns.schema["conv"].dataType.simpleString()
    return lines.repartition("conv").sortWithinPartitions("conv", "at", "j").mapInArrow(_hashed, f"conv {kind}, sha string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults, the cheapest edits and the repaired turns of each conversation."""
    return Repair(rows, conv, turn, role, text)
