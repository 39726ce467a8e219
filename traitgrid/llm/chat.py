"""Chat formatting: roles of raw transcripts by a hidden Markov model.

A transcript is lines. Hidden states are (role, first or later line of a turn);
a line is observed as a speaker-marker class and a shape. The model is counted
from labelled transcripts, roles are recovered by Viterbi, and the turns are
rendered in one canonical form.

Which role a marker speaks for is found for each transcript by itself, as names mean nothing
(``Anna:``, ``SPEAKER_00:``): what looks like a marker and recurs, or begins the transcript and is written like one that does, is a
speaker, tied over all of its lines. Of all ways to give the transcript's speakers roles (or none: a
heading inside a text) the likeliest is taken, by the order in which they first speak, who follows whom, the
shapes of the lines they begin, and what the word itself has stood for in labelled transcripts, if it occurs there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import cut, slices
from traitgrid.session import ship_package

ROLES = ["system", "user", "assistant"]
STATES = [(r, first) for r in range(len(ROLES)) for first in (True, False)]
#: Speaker words and the role each one speaks for.
SPEAKERS = {
    "system": 0, "instruction": 0, "instructions": 0, "context": 0, "notice": 0,
    "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "model": 2,
}
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|\[|<\|?|\*\*)?([A-Za-z]{1,20})(?:\]|\|?>|\*\*)?\s*(?::|>>|\]|\|>|$)\s?")
MARKS, SHAPES = 5, 4
#: Turns of a stored part, and lines after which a task looks what is decided.
PART, LOOK = 64, 512


#: What may be a marker: a name of up to three words between brackets or before a colon or the like.
CANDIDATE = re.compile(r"^\s*(#{1,6}\s*|\[|\(|<\|?|\*\*)?([^\W\d_][\w.'-]{0,29}(?: [\w.'-]{1,20}){0,2})(:?\*\*|\]|\)|\|?>)?\s*(:|>>|\]|\|>)?(\s|$)")
#: Speakers of a transcript that are told apart, candidates that are counted, and transcripts the tables are learned from.
SLOTS, COUNTED, LEARN = 6, 64, 5_000
TEXT = len(ROLES)  #: the class of a candidate that is no marker


def shape_of(text: str) -> int:
    return 0 if not text else 1 if text.endswith("?") else 2 if len(text) > 120 else 3


def candidate(line: str) -> tuple[tuple[str, str, str], int] | None:
    """``(opening, name, closing)`` of a line that may begin with a marker, and where its text starts. A word alone, or before a
    bracket only, is none."""
    m = CANDIDATE.match(line)
    if m is None:
        return None
    opening, name, closing, end, _ = (x or "" for x in m.groups())
    opening = opening.strip()
    if not end and not (opening and closing) and not (opening.startswith("#") and m.end() == len(line)):
        return None
    return (opening[:1], " ".join(name.lower().split()), closing + end), m.end()


def observe(line: str, roles: dict | None = None) -> tuple[int, int]:
    """Symbol of a line (marker class × shape) and where its text starts. Marker
    classes: one per role, another candidate, none. Shapes: blank, question, long, other. ``roles`` are those of the transcript's
    speakers (``Markers.roles``); without, known words alone are markers."""
    if roles is not None:
        found = candidate(line)
        role = None if found is None else roles.get(found[0])
        mark, at = (4, 0) if found is None else (3, 0) if role is None else (role, found[1])
        return mark * SHAPES + shape_of(line.strip()), at
    m = MARKER.match(line)
    word = m.group(1).lower() if m else None
    role = SPEAKERS.get(word)
    alone = m is not None and m.group(0).strip() == m.group(1)  # a bare word is no marker
    mark = 4 if m is None or alone else role if role is not None else 3
    return mark * SHAPES + shape_of(line.strip()), m.end() if mark < 3 else 0


class Tables:
    """What labelled transcripts say about markers, as log probabilities with one added to every count: ``word`` (class by name), ``order``
    (class of a speaker by its place among how many, and whether it speaks again), ``shape`` (of a line, by class), ``step`` (class by the class of the marker before; first: none)."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        n = TEXT + 1
        self.shape, self.step = np.ones((n, SHAPES)), np.ones((n + 1, n))
        rest: dict[str, dict[str, np.ndarray]] = {"word": {}, "order": {}}
        for (kind, key, c), k in counts.items():
            if kind in rest:
                rest[kind].setdefault(key, np.full(n, 0.25))[c] += k
            elif kind == "shape":
                self.shape[c, int(key)] += k
            else:
                self.step[int(key), c] += k
        self.shape, self.step = (np.log(x / x.sum(axis=1, keepdims=True)) for x in (self.shape, self.step))
        self.word, self.order = ({w: np.log(x / x.sum()) for w, x in rest[kind].items()} for kind in ("word", "order"))


class Markers:
    """The candidates of one transcript, counted line by line; at most ``COUNTED`` of them, the rarer go."""

    def __init__(self):
        self.seen: dict[tuple, list] = {}  # lines, first place, lines by shape
        self.after: dict[tuple, int] = {}
        self.last, self.place = None, 0

    def add(self, line: str) -> None:
        found = candidate(line)
        if found is None:
            return
        key, at = found
        if key not in self.seen:
            self.seen[key] = [0, self.place, [0] * SHAPES]
            self.place += 1
        x = self.seen[key]
        x[0] += 1
        x[2][shape_of(line[at:].strip())] += 1
        self.after[self.last, key] = self.after.get((self.last, key), 0) + 1
        self.last = key
        if len(self.seen) > 2 * COUNTED:
            kept = sorted(self.seen, key=lambda k: (-self.seen[k][0], self.seen[k][1]))[:COUNTED]
            self.seen = {k: self.seen[k] for k in kept}
            self.after = {p: n for p, n in self.after.items() if p[1] in self.seen and (p[0] is None or p[0] in self.seen)}

    def slots(self) -> list[tuple]:
        """The speakers: candidates that recur, the first one of all, if it is written like one that does, and known words; the most
        frequent, in order of appearance."""
        ways = {(k[0], k[2]) for k, x in self.seen.items() if x[0] > 1}
        some = [k for k, x in self.seen.items() if x[0] > 1 or x[1] == 0 and (k[0], k[2]) in ways or k[1] in SPEAKERS]
        return sorted(sorted(some, key=lambda k: (-self.seen[k][0], self.seen[k][1]))[:SLOTS], key=lambda k: self.seen[k][1])

    def places(self) -> dict[tuple, str]:
        """Each speaker's place: its number, how many speak again, and whether it does."""
        slots = self.slots()
        again = sum(self.seen[k][0] > 1 for k in slots)
        return {k: f"{i}/{min(again, 3)}/{int(self.seen[k][0] > 1)}" for i, k in enumerate(slots)}

    def roles(self, tables: Tables) -> dict[tuple, int]:
        """The likeliest roles of the speakers, all ways compared (ties: the first in order of roles). Candidates that are text are left out."""
        place = self.places()
        slots = list(place)
        if not slots:
            return {}
        m, n = len(slots), TEXT + 1
        own = np.zeros((m, n))
        for i, k in enumerate(slots):
            own[i] = tables.order.get(place[k], 0.0) + tables.word.get(k[1], 0.0) + tables.shape @ np.array(self.seen[k][2]) - _LEVEL @ np.array(self.seen[k][2])
        ways = np.stack(np.unravel_index(np.arange(n**m), (n,) * m), axis=1)
        score = own[np.arange(m), ways].sum(axis=1)
        at = {k: i for i, k in enumerate(slots)}
        for (a, b), c in self.after.items():
            if b in at and (a is None or a in at):
                score += min(c, _ENOUGH) * tables.step[n if a is None else ways[:, at[a]], ways[:, at[b]]]
        best = ways[int(score.argmax())]
        return {k: int(r) for k, r in zip(slots, best, strict=True) if r < TEXT}


_LEVEL = np.log(np.full((TEXT + 1, SHAPES), 1.0 / SHAPES))
#: A pair of speakers is believed after so many of its turns; more add nothing.
_ENOUGH = 50


def labelled_lines(turns: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(state, line) of turns given as (role, text)."""
    return [(STATES.index((role, i == 0)), line) for role, text in turns for i, line in enumerate(text.split("\n"))]


_NONE = object()


class Model:
    """Log probabilities with one added to every count."""

    def __init__(self, steps: dict[tuple[int, int], int], seen: dict[tuple[int, int], int]):
        n, m = len(STATES), MARKS * SHAPES
        a, b = np.ones((n + 1, n)), np.ones((n, m))
        for (i, j), c in steps.items():
            a[i, j] += c
        for (i, j), c in seen.items():
            b[i, j] += c
        # a later line follows its own turn's lines only
        for i in range(n + 1):
            for j, (role, first) in enumerate(STATES):
                if not first and (i == n or STATES[i][0] != role):
                    a[i, j] = 1e-300
        self.step, self.see = np.log(a / a.sum(axis=1, keepdims=True)), np.log(b / b.sum(axis=1, keepdims=True))

    def viterbi(self, symbols: list[int]) -> list[int]:
        """The most probable states; ties go to the earlier state."""
        n = len(STATES)
        score = self.step[n] + self.see[:, symbols[0]]
        back = np.empty((len(symbols), n), dtype=np.int8)
        for t, s in enumerate(symbols[1:], 1):
            ways = score[:, None] + self.step[:n]
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + self.see[:, s]
        out = [int(score.argmax())]
        for t in range(len(symbols) - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return out[::-1]


def conversations_of(batches, columns: list[str]):
    """``(new, row)`` of each turn of ordered batches; ``new`` where another conversation begins (a row without an id is one by itself)."""
    last = _NONE
    for part in batches:
        for x in zip(*(part.column(c).to_pylist() for c in ("conv_id", "own", *columns)), strict=True):
            yield x[:2] != last, x
            last = x[:2]


def learn_tables(turns: DataFrame) -> Tables:
    """Counts of markers over ``ordered`` turns with known roles. What is collected is bounded by the turns given."""
    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("c", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total: dict[tuple[str, str, int], int] = {}

        def note(kind, key, c):
            total[kind, str(key), c] = total.get((kind, str(key), c), 0) + 1
        def close(found, classes):
            for key, place in found.places().items():
                note("order", place, max(range(TEXT + 1), key=lambda c: classes[key][c]))
        now, classes, last = Markers(), {}, TEXT + 1
        for new, (_, _, r, text) in conversations_of(batches, ["r", "marked"]):
            if new:
                close(now, classes)
                now, classes, last = Markers(), {}, TEXT + 1
            if r is None:
                continue
            for i, line in enumerate(text.split("\n")):
                found = candidate(line)
                if found is None:
                    continue
                key, at = found
                c = r if i == 0 else TEXT
                now.add(line)
                classes.setdefault(key, [0] * (TEXT + 1))[c] += 1
                note("word", key[1], c)
                note("shape", shape_of(line[at:].strip()), c)
                note("step", last, c)
                last = c
        close(now, classes)
        if total:
            kinds, keys, classes = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kinds, keys, classes, total.values()), schema.types, strict=True)], schema=schema)

    ship_package(turns.sparkSession)
    rows = (turns.select("conv_id", "own", "r", "marked").mapInArrow(count, "kind string, key string, c int, n long")
            .groupBy("kind", "key", "c").agg(F.sum("n").alias("n")).collect())
    return Tables({(r["kind"], r["key"], r["c"]): r["n"] for r in rows})


#: Roles of a conversation's speakers, as rows hold them.
SPEAKER_LIST = "array<struct<opening:string,name:string,closing:string,role:int>>"


def _as_roles(found: list | None) -> dict | None:
    return None if found is None else {(x["opening"], x["name"], x["closing"]): x["role"] for x in found}


def speakers(turns: DataFrame, tables: Tables) -> DataFrame:
    """``conv_id, own, speakers``: the roles of each conversation's speakers (at most ``SLOTS``), from ``ordered`` turns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, own long, speakers {SPEAKER_LIST}"
    schema = to_arrow_schema(_parse_datatype_string(kinds))

    def run(batches):
        out, now, key = [], None, None

        def row():
            return (*key, [{"opening": k[0], "name": k[1], "closing": k[2], "role": r} for k, r in now.roles(tables).items()])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for new, (conv, own, text) in conversations_of(batches, ["marked"]):
            if new:
                if now is not None:
                    out.append(row())
                    if len(out) >= 10_000:
                        yield batch()
                        out = []
                now, key = Markers(), (conv, own)
            for line in text.split("\n"):
                now.add(line)
        if now is not None:
            out.append(row())
        if out:
            yield batch()

    ship_package(turns.sparkSession)
    return turns.select("conv_id", "own", "marked").mapInArrow(run, kinds)


def learn(turns: DataFrame) -> Model:
    """Counts steps and symbols over ``ordered`` turns (with ``speakers``, if they are found). A turn without a known role teaches
    nothing, nor does the step after it. What is collected is at most states × symbols rows."""
    schema = pa.schema([("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])
    named = "speakers" in turns.columns

    def count(batches):
        total: dict[tuple[int, int, int], int] = {}
        last = None
        for new, x in conversations_of(batches, ["r", "marked", *(["speakers"] if named else [])]):
            r, text = x[2:4]
            roles = _as_roles(x[4]) if named else None
            if new:
                last = len(STATES)
            if r is None:
                last = None
                continue
            for state, line in labelled_lines([(r, text)]):
                for key in (() if last is None else ((0, last, state),)) + ((1, state, observe(line, roles)[0]),):
                    total[key] = total.get(key, 0) + 1
                last = state
        if total:
            kinds, i, j = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kinds, i, j, total.values()), schema.types, strict=True)], schema=schema)

    ship_package(turns.sparkSession)
    rows = (turns.select("conv_id", "own", "r", "marked", *(["speakers"] if named else [])).mapInArrow(count, "kind int, i int, j int, n long")
            .groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect())
    return Model(*({(r["i"], r["j"]): r["n"] for r in rows if r["kind"] == k} for k in (0, 1)))


class Decoder:
    """Viterbi over the lines of one transcript as they come. States are given out once all
    best paths agree on them, so they are those of the whole transcript, while only the
    undecided lines are held."""

    def __init__(self, model: Model, look: int = LOOK, roles: dict | None = None):
        self.model, self.look, self.score, self.roles = model, look, None, roles
        self.back: list[np.ndarray] = []  # of each line held, after the first line of all
        self.held: list[tuple[str, int, int]] = []
        self.next_look, self.text = look, False

    def add(self, line: str) -> Iterator[tuple[int, str, int, int]]:
        """(state, line, symbol, where its text starts) of the lines that this one decides."""
        symbol, at = observe(line, self.roles)
        see, n = self.model.see[:, symbol], len(STATES)
        if self.score is None:
            self.score = self.model.step[n] + see
            self.back.append(np.arange(n))
        else:
            ways = self.score[:, None] + self.model.step[:n]
            self.back.append(ways.argmax(axis=0))
            self.score = ways.max(axis=0) + see
        self.held.append((line, symbol, at))
        self.text = self.text or bool(line.strip())
        if len(self.held) >= self.next_look and self.text:
            ends = np.arange(n)
            for t in range(len(self.held) - 1, 0, -1):
                ends = self.back[t][ends]
                if (ends == ends[0]).all():  # the state of line t - 1, whatever comes
                    yield from self._out(t, int(ends[0]))
                    break
            self.next_look = len(self.held) + self.look

    def _out(self, n: int, end: int) -> Iterator[tuple[int, str, int, int]]:
        states = [end]
        for t in range(n - 1, 0, -1):
            states.append(int(self.back[t][states[-1]]))
        out = [(s, *x) for s, x in zip(reversed(states), self.held[:n], strict=True)]
        self.back, self.held = self.back[n:], self.held[n:]
        yield from out

    def end(self) -> Iterator[tuple[int, str, int, int]]:
        """The lines still held; none of a transcript without text."""
        if self.held and self.text:
            yield from self._out(len(self.held), int(self.score.argmax()))


def _own(state: int, symbol: int, line: str, at: int) -> str:
    """The line without its marker, if that agrees with the role of the turn it begins."""
    role, first = STATES[state]
    return line[at:] if first and symbol // SHAPES == role else line


def find_roles(tables: Tables, transcript: str) -> dict[tuple, int]:
    """Roles of a transcript's speakers."""
    found = Markers()
    for line in transcript.split("\n"):
        found.add(line)
    return found.roles(tables)


def parse(model: Model, transcript: str, roles: dict | None = None) -> list[tuple[int, str]]:
    """Turns (role, text) of a whole transcript, with the ``roles`` of its speakers (see ``observe``); markers that agree with the role
    recovered are taken off, all other text stays. No text: no turn."""
    if not transcript.strip():
        return []
    lines = transcript.split("\n")
    seen = [observe(x, roles) for x in lines]
    turns: list[tuple[int, list[str]]] = []
    for state, (symbol, at), line in zip(model.viterbi([s for s, _ in seen]), seen, lines, strict=True):
        role, first = STATES[state]
        if first or not turns:
            turns.append((role, []))
        turns[-1][1].append(_own(state, symbol, line, at))
    return [(role, "\n".join(x).strip()) for role, x in turns]


def render(turns: list[tuple[int, str]]) -> str:
    """Canonical form: ``<|role|>``, the text, ``<|end|>``; neighbours of one role stay turns of their own."""
    return "".join(f"<|{ROLES[r]}|>\n{text}\n<|end|>\n" for r, text in turns)


class Conversation:
    """One conversation's turns in order, given out as stored parts of ``part`` recovered turns."""

    def __init__(self, key: list, model: Model, part: int, roles: dict | None = None):
        self.key, self.size, self.decoder = key, part, Decoder(model, roles=roles)
        self.part, self.lines, self.truth = 0, 0, 0
        self.turns: list[tuple[int, list[str]]] = []
        # roles by turn position, of the side (true or recovered) that is ahead
        self.true: list[int | None] = []
        self.got: list[int] = []
        self.right = 0

    def _take(self, decided) -> Iterator[list]:
        for state, line, symbol, at in decided:
            role, first = STATES[state]
            if first or (not self.turns and not self.part):
                if len(self.turns) == self.size:
                    yield self._row()
                self.turns.append((role, []))
                self.got.append(role)
            self.turns[-1][1].append(_own(state, symbol, line, at))
            self.lines += 1

    def _row(self) -> list:
        n = min(len(self.true), len(self.got))
        right = self.right + sum(a == b for a, b in zip(self.true[:n], self.got[:n], strict=True))
        self.true, self.got = self.true[n:], self.got[n:]
        out = [*self.key, self.part, self.lines, len(self.turns), right, self.truth, render([(r, "\n".join(x).strip()) for r, x in self.turns])]
        self.part, self.lines, self.truth, self.turns, self.right = self.part + 1, 0, 0, [], 0
        return out

    def add(self, role: int | None, marked: str) -> Iterator[list]:
        self.true.append(role)
        self.truth += role is not None
        for line in marked.split("\n"):
            yield from self._take(self.decoder.add(line))

    def end(self) -> Iterator[list]:
        yield from self._take(self.decoder.end())
        yield self._row()


#: How raw transcripts write their speakers (system, user, assistant) by style; and names, which say nothing of the role.
STYLES = [("System: ", "User: ", "Assistant: "), ("### Instruction:\n", "### Human:\n", "### AI:\n"),
          ("[context] ", "[q] ", "[a] "), ("notice>> ", "customer>> ", "agent>> ")]
NAMES = ["Anna", "Ben", "Carla", "Dmitri", "Eve", "Farid", "Grace", "Hugo", "Ines", "Jonas"]


def written(conversations: DataFrame) -> DataFrame:
    """Turns as raw transcripts have them: ``conv_id, own, turn, r, marked``.

    Speakers are written in a style that goes by a hash of the conversation: one of ``STYLES``, or, half of
    the time, two of ``NAMES`` and ``Note`` in some way of writing. Every
    eighth turn (by hash) has no speaker at all. Rows repeated count once. No turn is left out:
    roles go by ``SPEAKERS``, a turn with another role or none has no speaker and ``r``
    null, a null text is empty, and a turn without a conversation is one by itself (``own`` tells them apart)."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role", F.lit(" \t\r\n\f\v"))).alias("role"), "text")
    c = c.fillna("", ["text"]).distinct()
    words = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    styles = F.array(*[F.array(*[F.lit(x) for x in s]) for s in STYLES])
    h = F.xxhash64("conv_id")
    names = F.array(*[F.lit(x) for x in NAMES])
    one = F.pmod(F.shiftright(h, 8), F.lit(len(NAMES))).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.shiftright(h, 20), F.lit(len(NAMES) - 1)), F.lit(len(NAMES))).cast("int")
    name = F.element_at(F.array(F.lit("Note"), F.element_at(names, one + 1), F.element_at(names, two + 1)), F.col("r") + 1)
    way = F.pmod(F.shiftright(h, 32), F.lit(3))
    by_name = F.when(way == 0, F.concat(name, F.lit(": "))).when(way == 1, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(F.lit("**"), name, F.lit(":** ")))
    by_style = F.element_at(F.element_at(styles, F.pmod(F.shiftright(h, 1), F.lit(len(STYLES))).cast("int") + 1), F.col("r") + 1)
    silent = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(8)) == 0
    c = c.withColumn("r", F.when(F.col("role").isNotNull(), F.try_element_at(words, F.col("role"))))
    marker: Column = F.when(silent | F.col("r").isNull(), F.lit("")).when(F.pmod(h, F.lit(2)) == 0, by_style).otherwise(by_name)
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))
    return c.select("conv_id", own.cast("long").alias("own"), "turn", "r", F.concat(marker, F.col("text")).alias("marked"))


def ordered(turns: DataFrame) -> DataFrame:
    """Each conversation's turns in order, in one task."""
    turns = turns if "own" in turns.columns else turns.withColumn("own", F.lit(0).cast("long"))
    return turns.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "r", "marked")


def parse_turns(turns: DataFrame, model: Model, part: int = PART) -> DataFrame:
    """``ordered`` turns (with ``held_out``, and ``speakers`` if they are found) parsed and rendered, ``conv_id, held_out, part, n_lines, n_turns,
    n_right, n_true, rendered``: conversations are decoded as a whole, rows are parts
    of ``part`` recovered turns (at least one row each), whose renderings in order make up that of the whole."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = (f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, held_out boolean, part long, n_lines long, "
             "n_turns long, n_right long, n_true long, rendered string")
    schema = to_arrow_schema(_parse_datatype_string(kinds))

    named = "speakers" in turns.columns
    columns = ["held_out", "r", "marked", *(["speakers"] if named else [])]

    def rows(batches):
        now = None
        for new, x in conversations_of((p for b in batches for p in slices(iter([b]), "marked")), columns):
            if new:
                if now is not None:
                    yield from now.end()
                now = Conversation([x[0], x[2]], model, part, _as_roles(x[5]) if named else None)
            yield from now.add(*x[3:5])
        if now is not None:
            yield from now.end()

    def run(batches):
        out, size = [], 0
        for row in rows(batches):
            out.append(row)
            size += len(row[-1]) + 64
            if size > 1 << 21:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ship_package(turns.sparkSession)
    return turns.select("conv_id", "own", *columns).mapInArrow(run, kinds)


def trained(conversations: DataFrame, sample: int = LEARN) -> tuple[Tables, Model]:
    """Tables and model, from turns as ``written``: of the ``sample`` conversations of least id hash."""
    ids = conversations.filter("conv_id is not null").select("conv_id").distinct()
    ids = cut(ids.orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample).withColumnRenamed("conv_id", "c"))
    some = cut(ordered(conversations.join(F.broadcast(ids), F.col("conv_id") == F.col("c"), "left_semi")))
    tables = learn_tables(ordered(some))
    return tables, learn(with_speakers(some, tables))


def with_speakers(turns: DataFrame, tables: Tables) -> DataFrame:
    """Ordered turns with the ``speakers`` of their conversation. Both readings are of one shuffle of the turns; the join is
    dealt once more, as Spark may split its partitions, and with them a conversation."""
    dealt = ordered(turns)
    found = speakers(dealt, tables).select(F.col("conv_id").alias("c"), F.col("own").alias("o"), "speakers")
    both = dealt.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("own") == F.col("o"))).drop("c", "o")
    return ordered(both)


def format_conversations(conversations: DataFrame, part: int = PART, sample: int = LEARN) -> DataFrame:
    """Raw transcripts parsed and rendered: ``conv_id, part, held_out, n_lines,
    n_turns, n_right, n_true, rendered``, parts of ``part`` recovered turns each, of every
    conversation and turn (see ``written``). Learned from at most ``sample`` conversations whose crc32 of the id
    leaves something else than 2 modulo 4 (a null id teaches nothing). ``n_right`` counts
    turn positions whose recovered role is the true one (for accuracy), of ``n_true`` turns with a known
    role; both are summed up over a conversation's parts. Ties between turns go by role and text; columns
    beside ``conv_id, turn, role, text`` take no part; a turn of any length is read line by line; no rows give none."""
    fold = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    raw = written(conversations).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    tables, model = trained(raw.filter("not held_out"), sample)
    out = parse_turns(with_speakers(raw, tables), model, part)
    return out.select("conv_id", "part", "held_out", "n_lines", "n_turns", "n_right", "n_true", "rendered")


def log_likelihood(model: Model, states: list[int], symbols: list[int]) -> float:
    """Of one path (tests compare Viterbi with all paths)."""
    last, total = len(STATES), 0.0
    for s, o in zip(states, symbols, strict=True):
        total += model.step[last, s] + model.see[s, o]
        last = s
    return total if not math.isnan(total) else -math.inf
