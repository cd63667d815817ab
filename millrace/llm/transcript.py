"""Chat formatting: a hidden Markov model over lines recovers the turns of a transcript, which are then rendered.

States are (role, first line of a turn) and (role, further line) for system, user and assistant. A line's evidence is
its speaker marker, if any, and its features: blank, list or code, a question, its length, and whether the line before
is blank or a question. Scores are whole numbers (log-probabilities times ``SCALE``), so sums do not depend on the order
in which they are taken; Viterbi gives a best path, ties to the state listed first. A line in a first state opens a
turn; its marker is taken off. Turns are rendered as ``<|role|>``, the text, ``<|end|>``.

``DEFAULTS`` are assumed tables for lines and transitions. ``learn`` replaces them by counts over a bounded, hashed sample
of at most ``LEARN`` pieces of conversations whose roles are known, the defaults counting as ``PRIOR`` lines of each
state. How often markers are missing or mislead cannot be seen in such a table, so these shares stay assumptions
(``MISSING``, ``MISLEADING``); in a transcript without any marker a missing one tells nothing. Accuracy at sf0.1, whose
lines differ by little but length, with a tenth of the markers taken out and misleading lines put in: 0.999 of the rows
with a marker open a turn of their role; of the lines of rows without one 0.77 get their role (0.54 by markers and
transitions alone), of all lines 0.968. With all markers and no misleading lines all rows are right.

Raw transcripts are built from a table of turns with ``assemble``: the turns of a conversation by number, each behind a
marker of a style that the conversation's id chooses. Rows without a conversation id or a turn number are transcripts of
their own. Conversations are held in pieces of ``SEGMENT`` turn numbers, which the result does not show: for those of
several pieces, ``_carried`` works out the best path over all of them from one matrix of best scores a piece, multiplied
in a tree of ``FAN`` pieces a task, so each piece is decoded with the states before its first and at its last line that
the whole conversation's path has. A row of the result is a conversation; one of over ``PART`` turns has a row for each
so many, since a row cannot hold more than 2 GB.

Null, empty and blank transcripts have no turns. Rows with equal turn numbers are ordered by role and text; repeated rows
are turns of their own. A null text is an empty turn, a null role the user's. Very long texts are read whole. An empty
table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm import runtime

ROLES = ("system", "user", "assistant")
SEGMENT, FAN, PART = 256, 256, 1 << 16
# The words that mark a speaker, by role, and the shapes of markers.
NAMES = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "q", "question", "customer", "me"), "assistant": ("assistant", "ai", "a", "answer", "bot", "gpt", "model")}
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_WORDS = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:\#{{1,4}}\s*|\*\*|\[|<\|?|>\s*)?({_WORDS})(?:\s*\d+)?\s*(?:\*\*\s*:|:\s*\*\*|\]\s*:?|\|?>\s*:?|\s*:|\s+-\s|$)\s*", re.I | re.A)
#: Marker words that are common words of a text too.
WEAK = {"q", "question", "me", "a", "answer", "customer", "model", "instructions"}
#: Marker styles that ``assemble`` writes: system, user, assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "), ("### System:\n", "### Human:\n", "### Assistant:\n"), ("[SYSTEM] ", "[USER] ", "[ASSISTANT] "),
    ("**System:** ", "**User:** ", "**AI:** "), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ("Instructions: ", "Q: ", "A: "),
)

_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
START, GO_ON = 0, 1
STATES = [(r, p) for r in ROLES for p in (START, GO_ON)]
N = len(STATES)
SCALE = 1 << 16
#: The score of what cannot be; real scores stay far above it.
NEVER = -(1 << 60)
#: Shares of turns without a marker by role, and of further lines that look like a marker, of common words and others.
MISSING = {"system": 0.002, "user": 0.1, "assistant": 0.1}
MISLEADING = {True: 0.02, False: 0.0005}
LEARN, PRIOR = 2000, 20
#: Features and the number of their values: blank, list or code, question, length class, question before, blank before.
FEATURES = (2, 2, 2, 5, 2, 2)
_LENGTHS = (40, 100, 200, 400)
_LIST = re.compile(r"\s*(?:[-*•]\s|\d+[.)]\s|```|    \S|\|)")


class Model(NamedTuple):
    """Probabilities: of the first role, of going on with a turn, of the next role, and of each feature's values by state."""

    first: np.ndarray
    stay: np.ndarray
    follow: np.ndarray
    lines: tuple[np.ndarray, ...]


def _yes(*shares: float) -> np.ndarray:
    return np.array([[1 - s, s] for s in shares])


#: By state: system, user, assistant, each first and further lines.
DEFAULTS = Model(
    np.array([0.1, 0.85, 0.05]),
    np.array([0.6, 0.55, 0.75]),
    np.array([[0.02, 0.9, 0.08], [0.01, 0.07, 0.92], [0.01, 0.92, 0.07]]),
    (
        _yes(0.02, 0.1, 0.01, 0.1, 0.01, 0.12), _yes(0.05, 0.2, 0.05, 0.1, 0.08, 0.3), _yes(0.02, 0.02, 0.45, 0.15, 0.05, 0.03),
        np.array([[0.2, 0.25, 0.25, 0.2, 0.1], [0.3, 0.25, 0.2, 0.15, 0.1], [0.4, 0.3, 0.15, 0.1, 0.05], [0.4, 0.3, 0.15, 0.1, 0.05], [0.25, 0.25, 0.25, 0.15, 0.1], [0.25, 0.25, 0.25, 0.15, 0.1]]),
        _yes(0.03, 0.03, 0.1, 0.05, 0.6, 0.03), _yes(0.2, 0.1, 0.4, 0.1, 0.3, 0.12),
    ),
)


def _scores(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(np.log(np.maximum(p, 1e-300)) * SCALE), NEVER).astype(np.int64)


def transitions(model: Model = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the first state and of each next one."""
    first, step = np.zeros(N), np.zeros((N, N))
    for i, (r, _) in enumerate(STATES):
        k = ROLES.index(r)
        for j, (r2, p2) in enumerate(STATES):
            if p2 == START:
                step[i, j] = (1 - model.stay[k]) * model.follow[k][ROLES.index(r2)]
            elif r2 == r:
                step[i, j] = model.stay[k]
        if STATES[i][1] == START:
            first[i] = model.first[k]
    with np.errstate(divide="ignore"):
        return np.log(first), np.log(step)


class Scorer:
    """A model's whole-number scores."""

    def __init__(self, model: Model = DEFAULTS) -> None:
        first, step = transitions(model)
        self.first, self.step = _scores(np.exp(first)), _scores(np.exp(step))
        self.lines = [_scores(t) for t in model.lines]
        self.marks = {}
        for role in (None, *ROLES):
            for weak in (True, False):
                wrong = MISLEADING[weak]
                shares = []
                for r, p in STATES:
                    if p == START:
                        shares.append(MISSING[r] if role is None else 1 - MISSING[r] if role == r else wrong / 4)
                    else:
                        shares.append(1 - wrong if role is None else wrong / len(ROLES))
                self.marks[role, weak] = _scores(np.array(shares))

    def evidence(self, line: str, before: int) -> tuple[int, int, np.ndarray]:
        """Where the text begins behind a marker, the line's class for the next line, and the line's score in each state."""
        m = MARKER.match(line)
        name = m[1].lower() if m else ""
        e = self.marks[_ROLE_OF.get(name), name in WEAK or not m].copy()
        if not m or line[m.end() :]:  # a marker alone on its line says no more
            for table, value in zip(self.lines, observed(line[m.end() :] if m else line, before), strict=True):
                e += table[:, value]
        return (m.end() if m else 0), line_class(line), e

    def read(self, lines: list[str], before: int = 0, marked: bool = True) -> tuple[list[int], np.ndarray]:
        """Of each line: where its text begins and its scores. ``before``: the class of the line before the first. Where nothing is ``marked``, a missing marker tells nothing."""
        at, rows = [], []
        for line in lines:
            a, before, e = self.evidence(line, before)
            at.append(a)
            rows.append(e if marked else e - self.marks[None, True])
        return at, np.stack(rows)


def line_class(line: str) -> int:
    """What the next line sees of this one: 1 a question, 2 blank, 0 else."""
    s = line.strip()
    return 2 if not s else 1 if s.endswith("?") else 0


def observed(body: str, before: int) -> tuple[int, ...]:
    s = body.strip()
    return (int(not s), int(bool(_LIST.match(body))), int(s.endswith("?")), sum(len(s) > x for x in _LENGTHS), int(before == 1), int(before == 2))


def _best(scores: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    reach = scores[:, None] + step
    return reach.argmax(0), reach.max(0)


def viterbi(e: np.ndarray, first: np.ndarray | None = None, step: np.ndarray | None = None, last: int | None = None) -> list[int]:
    """The best path of states for the lines' scores, from ``first`` (scores of the first line's states) to the state ``last`` if given."""
    if first is None or step is None:
        first, step = transitions()
    best = first + e[0]
    back = []
    for row in e[1:]:
        where, reached = _best(best, step)
        back.append(where)
        best = reached + row
    path = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def turns_of(lines: list[str], at: list[int], path: list[int]) -> list[tuple[bool, str, list[str], int]]:
    """Pieces of turns: whether it opens a turn, its role, its lines, and its first line's number."""
    out: list[tuple[bool, str, list[str], int]] = []
    for i, (line, a, state) in enumerate(zip(lines, at, path, strict=True)):
        role, place = STATES[state]
        if place == START:
            out.append((True, role, [line[a:]] if line[a:] or a == 0 else [], i))
        elif not out:
            out.append((False, role, [line], i))
        else:
            out[-1][2].append(line)
    return out


def parse(transcript: str | None, scorer: Scorer | None = None) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn."""
    if not transcript or not transcript.strip():
        return []
    scorer = scorer or Scorer()
    lines = transcript.split("\n")
    at, e = scorer.read(lines, marked=any(map(MARKER.match, lines)))
    return [(r, "\n".join(x).strip("\n")) for _, r, x, _ in turns_of(lines, at, viterbi(e, scorer.first, scorer.step))]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def assemble(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, segment, roles, marked)``: pieces of conversations as raw text, one element of ``marked`` for each row."""
    c = lambda n: F.col(f"`{n}`")
    style = F.pmod(F.xxhash64(c(key).cast("string")), F.lit(len(STYLES)))
    marks = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    which = F.when(F.lower(c(role)) == "system", 0).when(F.lower(c(role)) == "assistant", 2).otherwise(1)
    line = F.concat(F.get(F.get(marks, style.cast("int")), which), F.coalesce(c(text), F.lit("")))
    rows = turns.select(c(key).alias("conv_id"), F.floor(c(turn) / SEGMENT).cast("bigint").alias("segment"), F.struct(c(turn).alias("t"), F.coalesce(c(role), F.lit("user")).alias("r"), line.alias("x")).alias("s"))
    alone = F.col("conv_id").isNull() | F.col("segment").isNull()
    held = rows.where(~alone).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("s")).alias("s"))
    every = held.unionAll(rows.where(alone).select("conv_id", F.lit(None).cast("bigint").alias("segment"), F.array("s").alias("s")))
    return every.select("conv_id", "segment", F.transform("s", lambda s: s["r"]).alias("roles"), F.transform("s", lambda s: s["x"]).alias("marked"))


def learn(pieces: DataFrame, most: int = LEARN) -> Model:
    """Tables from the lines of at most ``most`` pieces of ``assemble``'s result, chosen by a hash of their keys."""
    runtime.prepare(pieces.sparkSession)
    ids = pieces.where("conv_id is not null and segment is not null").select("conv_id", "segment").orderBy(F.xxhash64("conv_id", "segment"), "conv_id", "segment").limit(most)
    chosen = pieces.join(F.broadcast(ids), ["conv_id", "segment"]).select("segment", "roles", "marked")  # at most ``most`` rows of two numbers
    width = max(FEATURES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.zeros((N, len(FEATURES), width), np.int64)
        first, follow, places = np.zeros(3, np.int64), np.zeros((3, 3), np.int64), np.zeros(N, np.int64)
        for batch in batches:
            for segment, roles, marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last, before = None, 0
                for r, x in zip(roles, marked, strict=True):
                    if r.lower() not in ROLES:
                        last = None
                        continue
                    k = ROLES.index(r.lower())
                    if last is not None:
                        follow[last, k] += 1
                    elif segment == 0 and x is marked[0]:
                        first[k] += 1
                    last = k
                    for i, line in enumerate(x.split("\n")):
                        m = MARKER.match(line) if i == 0 else None
                        places[2 * k + min(i, 1)] += 1
                        if not m or line[m.end() :]:
                            for f, value in enumerate(observed(line[m.end() :] if m else line, before)):
                                lines[2 * k + min(i, 1), f, value] += 1
                        before = line_class(line)
        flat = np.concatenate([lines.ravel(), first, follow.ravel(), places])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["slot", "n"])

    got = chosen.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # one row for each cell of the tables at most
    flat = np.zeros(N * len(FEATURES) * width + 12 + N)
    for r in got:
        flat[r["slot"]] = r["n"]
    flat, places = flat[:-N], flat[-N:]
    lines = flat[:-12].reshape(N, len(FEATURES), width)
    share = lambda counts, prior: (counts + PRIOR * prior) / (counts + PRIOR * prior).sum(-1, keepdims=True)
    goes_on = np.stack([places[0::2], places[1::2]], 1)  # first lines and further lines of each role
    stay = share(goes_on, np.stack([1 - DEFAULTS.stay, DEFAULTS.stay], 1))[:, 1]
    tables = tuple(share(lines[:, f, :n], DEFAULTS.lines[f]) for f, n in enumerate(FEATURES))
    return Model(share(flat[-12:-9], DEFAULTS.first), stay, share(flat[-9:].reshape(3, 3), DEFAULTS.follow), tables)


_PIECE = "array<struct<opens:boolean,role:string,text:string,n_rows:bigint,right:bigint>>"
_PIECES = pa.list_(pa.struct([("opens", pa.bool_()), ("role", pa.string()), ("text", pa.string()), ("n_rows", pa.int64()), ("right", pa.int64())]))


def _decoded(scorer: Scorer, roles: list[str], marked: list[str], entry: int = N, before: int = 0, last: int | None = None) -> list[dict]:
    """The pieces of a piece's path, with the rows that begin in each and those whose role it opens a turn of. ``entry``: the state before, N at the beginning."""
    whole = "\n".join(marked)
    if last is None and not whole.strip():  # a blank transcript
        return []
    lines = whole.split("\n")
    at, e = scorer.read(lines, before)
    path = viterbi(e, scorer.first if entry == N else scorer.step[entry], scorer.step, last)
    begins = np.cumsum([0, *(x.count("\n") + 1 for x in marked[:-1])]).tolist()
    found = turns_of(lines, at, path)
    out = [{"opens": o, "role": r, "text": "\n".join(x) if x else None, "n_rows": 0, "right": 0} for o, r, x, _ in found]
    own = np.searchsorted([i for *_, i in found], begins, "right") - 1
    for k, i, role in zip(own.tolist(), begins, roles, strict=True):
        out[k]["n_rows"] += 1
        out[k]["right"] += int(found[k][3] == i and found[k][0] and out[k]["role"] == role.lower())
    return out


def _product(mats: list[np.ndarray], classes: list[int]) -> np.ndarray:
    """Best scores through several pieces in a row: [class of the line before, state before (N: none), last state]."""
    out = mats[0]
    for m, c in zip(mats[1:], classes, strict=False):
        out = np.maximum((out[:, :, :, None] + m[c][None, None, :N, :]).max(2), NEVER)
    return out


def _matrix(scorer: Scorer, marked: list[str]) -> tuple[np.ndarray, int]:
    lines = "\n".join(marked).split("\n")
    start = np.concatenate([scorer.step, scorer.first[None]])
    _, e = scorer.read(lines)
    out = np.stack([start + scorer.evidence(lines[0], c)[2] for c in range(3)])
    for row in e[1:]:
        out = np.maximum((out[:, :, :, None] + scorer.step).max(2) + row, NEVER)
    return np.maximum(out, NEVER), line_class(lines[-1])


def _chained(rows: list[tuple[int, np.ndarray, int]], entry: int, before: int, end: int) -> list[tuple[int, int, int]]:
    """``(entry, class before, last state)`` of each child in a row of children with the given ends."""
    alpha = np.full(N + 1, NEVER, np.int64)
    alpha[entry] = 0
    fronts = []
    for _, m, c in rows:
        fronts.append((alpha, before))
        alpha = np.append(np.maximum((alpha[:, None] + m[before]).max(0), NEVER), NEVER)
        before = c
    out = []
    for (_, m, _), (a, b) in zip(reversed(rows), reversed(fronts), strict=True):
        best = int((a + m[b][:, end]).argmax())
        out.append((best, b, end))
        end = best
    return out[::-1]


#: Added to a piece's number, so that the tree over negative and other turn numbers has one root.
_LEAST = 1 << 55


def _parent(c: Column) -> Column:
    return F.shiftright(c, FAN.bit_length() - 1)


def _carried(ws: runtime.Workspace, pieces: DataFrame, scorer: Scorer) -> DataFrame:
    """``(conv_id, segment, entry, before, last)`` of the pieces of conversations: where the whole conversation's best path enters and leaves them."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    shape = (3, N + 1, N)
    unpack = lambda b: np.frombuffer(b, np.int64).reshape(shape)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_matrix(scorer, m) for m in batch.column(2).to_pylist()]
            node = pa.array([x + _LEAST for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array([m.tobytes() for m, _ in got], pa.binary()), pa.array([c for _, c in got], pa.int32())], ["conv_id", "node", "m", "c"])

    def multiply(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        classes = t["c"].to_pylist()
        m = _product([unpack(b) for b in t["m"].to_pylist()], classes)
        return pa.table({"conv_id": t["conv_id"][:1], "node": t["parent"][:1], "m": pa.array([m.tobytes()], pa.binary()), "c": pa.array([classes[-1]], pa.int32())})

    def descend(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        rows = list(zip(t["node"].to_pylist(), map(unpack, t["m"].to_pylist()), t["c"].to_pylist(), strict=True))
        got = _chained(rows, *(t[n][0].as_py() for n in ("entry", "before", "last")))
        cols = list(zip(*got, strict=True))
        return pa.table({"conv_id": t["conv_id"], "node": t["node"]} | {n: pa.array(c, pa.int32()) for n, c in zip(("entry", "before", "last"), cols, strict=True)})

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [int(unpack(b)[0, N].argmax()) for b in batch.column(2).to_pylist()]
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([N] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "node", "entry", "before", "last"])

    node = f"conv_id {kind}, node bigint, m binary, c int"
    ends = f"conv_id {kind}, node bigint, entry int, before int, last int"
    levels = [ws.keep(pieces.select("conv_id", "segment", "marked").mapInArrow(measure, node), "level")]
    while not levels[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
        up = levels[-1].withColumn("parent", _parent(F.col("node")))
        levels.append(ws.keep(up.groupBy("conv_id", "parent").applyInArrow(multiply, node), "level"))
    told = ws.keep(levels[-1].mapInArrow(top, ends), "ends")
    for level in reversed(levels[:-1]):
        known = told.withColumnRenamed("node", "parent")
        below = level.withColumn("parent", _parent(F.col("node"))).join(known, ["conv_id", "parent"])
        told = ws.keep(below.groupBy("conv_id", "parent").applyInArrow(descend, ends), "ends")
    ws.drop(*levels)
    return told.withColumn("segment", F.col("node") - _LEAST).drop("node")


def recovered(pieces: DataFrame, model: Model = DEFAULTS) -> DataFrame:
    """``(conv_id, part, n_rows, n_roles_right, turns, rendered)`` of the conversations of ``assemble``'s result."""
    runtime.prepare(pieces.sparkSession)
    ws = runtime.Workspace(pieces.sparkSession)
    scorer = Scorer(model)
    kind = pieces.schema["conv_id"].dataType.simpleString()
    pieces = ws.keep(pieces.select("conv_id", "segment", "roles", "marked"), "pieces")
    several = ws.keep(pieces.where("conv_id is not null and segment is not null").groupBy("conv_id").count().where("count > 1").select("conv_id"), "several")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_decoded(scorer, r, m) for r, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in batch.column(1).to_pylist()], pa.int64()), pa.array(got, _PIECES)], ["conv_id", "n_rows", "p"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_decoded(scorer, *x) for x in zip(*cols, strict=True)], _PIECES)], ["conv_id", "segment", "p"])

    total = lambda p, n: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x[n])
    rest = pieces.where("segment is not null").join(several, "conv_id", "left_anti").select("conv_id", "roles", "marked").unionAll(pieces.where("segment is null").select("conv_id", "roles", "marked"))
    whole = rest.mapInArrow(alone, f"conv_id {kind}, n_rows bigint, p {_PIECE}")
    turns = F.transform("p", lambda x: F.struct(x["role"].alias("role"), _stripped(x["text"]).alias("text")))
    out = whole.select("conv_id", F.lit(0).cast("bigint").alias("part"), "n_rows", total("p", "right").alias("n_roles_right"), turns.alias("turns"))
    if not several.isEmpty():
        long = pieces.where("segment is not null").join(several, "conv_id", "left_semi")
        ends = _carried(ws, long, scorer)
        read = long.join(ends, ["conv_id", "segment"]).select("conv_id", "segment", "roles", "marked", "entry", "before", "last")
        cut = ws.keep(read.mapInArrow(within, f"conv_id {kind}, segment bigint, p {_PIECE}"), "cut")
        # turns that earlier pieces open, by blocks of FAN pieces and within them
        opened = cut.select("conv_id", "segment", _parent(F.col("segment")).alias("block"), F.size(F.filter("p", lambda x: x["opens"])).cast("bigint").alias("n"))
        earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = opened.groupBy("conv_id", "block").agg(F.sum("n").alias("n")).withColumn("base", earlier(Window.partitionBy("conv_id").orderBy("block"))).drop("n")
        inside = opened.withColumn("own", earlier(Window.partitionBy("conv_id", "block").orderBy("segment"))).drop("n")
        base = inside.join(blocks, ["conv_id", "block"]).select("conv_id", "segment", (F.col("base") + F.col("own")).alias("base"))
        each = cut.join(base, ["conv_id", "segment"]).select("conv_id", "segment", "base", "p", F.posexplode("p").alias("i", "x"))
        number = F.col("base") + F.size(F.filter(F.slice("p", F.lit(1), F.col("i") + 1), lambda x: x["opens"])) - 1
        held = each.select("conv_id", number.alias("turn"), F.struct("segment", "i", F.col("x.text").alias("text")).alias("s"), "x.role", "x.n_rows", "x.right")
        lines = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "\n")  # null texts are left out
        one = held.groupBy("conv_id", "turn").agg(lines.alias("text"), F.first("role").alias("role"), F.sum("n_rows").alias("n_rows"), F.sum("right").alias("right"))
        parts = one.groupBy("conv_id", F.floor(F.col("turn") / PART).cast("bigint").alias("part")).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("right").alias("n_roles_right"), F.sort_array(F.collect_list(F.struct("turn", "role", _stripped(F.col("text")).alias("text")))).alias("s")
        )
        out = out.unionAll(parts.select("conv_id", "part", "n_rows", "n_roles_right", F.transform("s", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("turns")))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n"))), "")
    return out.withColumn("rendered", rendered)


def _stripped(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit("\n")), F.lit(""))


def formatted(transcripts: DataFrame, column: str = "transcript", keep: list[str] | None = None, model: Model = DEFAULTS) -> DataFrame:
    """Adds ``turns array<struct<role, text>>`` and ``rendered`` to the columns ``keep`` (default: all but the transcript). ``assemble``'s result goes to ``recovered``."""
    if column not in transcripts.columns and "marked" in transcripts.columns:
        return recovered(transcripts, model)
    runtime.prepare(transcripts.sparkSession)
    names = [c for c in (transcripts.columns if keep is None else keep) if c not in ("turns", "rendered") and (keep is not None or c != column)]
    src = transcripts.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{column}`").alias(runtime.fresh(names)))
    schema = transcripts.select(*[F.col(f"`{c}`") for c in names]).schema.add("turns", T.ArrayType(_TURN)).add("rendered", "string")
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                turns = [parse(t, scorer) for t in part.column(len(names)).to_pylist()]
                cols = [*part.columns[: len(names)], pa.array([[{"role": r, "text": x} for r, x in t] for t in turns], kind), pa.array([render(t) for t in turns])]
                yield pa.RecordBatch.from_arrays(cols, [*names, "turns", "rendered"])

    return src.mapInArrow(run, schema)


def digest(done: DataFrame) -> DataFrame:
    """One row for each conversation: rows, turns found, rows that open a turn of their role, and the rendered text with its SHA-256."""
    return done.select("conv_id", "part", "n_rows", F.size("turns").cast("bigint").alias("n_turns"), "n_roles_right", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"), "rendered")
