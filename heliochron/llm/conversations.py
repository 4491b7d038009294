"""Conversations mended at the least cost, decided by one integer minimum over a DAG.

A repair keeps, reroles, deletes or inserts messages so that the roles' initials read ``(s?(ua)+)?``.  A path's
weight is one big integer: its high digits are the cost, below them stands one digit of fixed width for each
letter of the audit, by position, the unused ones at the end zero.  The least integer is then the least cost
and, among equals, the audit least in ASCII; the letters are read off the result, and they alone give the
repaired messages, as a rerole or insert has only one role that fits its place.

First a small integer (cost, then most inserts) tells how many inserts any cheapest repair can have; the
DAG then has a node for each message, number of inserts and role.  With these costs that number is
zero: the inserted message and a neighbour can be taken out instead, at 2 for the neighbour and 2 more
for a lone system message before them, less than 5.

Long conversations are cut into blocks.  A block is a small matrix of least integers from role to role, and blocks
are joined by the same minimum, the later one's digits behind the earlier one's.  In Spark, rows are sorted into
ranges of (conversation, turn, ...).  Conversations that lie inside one range are mended as it is
read; those at its ends may go on in other ranges, so each range's part is a block, and only the matrices meet in one
place.  Their repaired text is then hashed piece by piece in order.

Missing conversation ids are one conversation, missing turns come first, missing roles and texts are one space.
Rows of one turn are ordered by role, then by a hash of the text; equal rows are rows on their own (all but the
first are duplicates).  A role without letters has an initial that fits nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, position, rows_of, stored

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BITS = 3
CODE = {"D": 1, "I": 2, "K": 3, "R": 4}  # in ASCII order, zero is the padding
LETTER = {v: k for k, v in CODE.items()}
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
BLOCK = 2048
PIECE = 1 << 20

GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)


def _steps(fault: int, initial: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a message."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT_OFF if fault == TRUNCATED else 0
    fits = ASSISTANT if state == USER else USER
    yield "R", REROLE + more, fits
    if initial == "s" and state == START:
        yield "K", KEEP + more, SYSTEM
    elif initial == "u" and fits == USER:
        yield "K", KEEP + more, USER
    elif initial == "a" and fits == ASSISTANT:
        yield "K", KEEP + more, ASSISTANT


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def most_inserts(faults: list[int], initials: list[str]) -> int:
    """The most inserts that a cheapest repair has: a minimum over cost, then most inserts, as one integer."""
    base = 4 * len(faults) + 8
    best: dict[int, int] = {START: 0}

    def widen(best):
        for _ in range(2):  # two inserts lead back to the same role at a higher cost
            for state, w in list(best.items()):
                t, v = _inserted(state), w + INSERT * base - 1
                if v < best.get(t, v + 1):
                    best[t] = v
        return best
    best = widen(best)
    for fault, initial in zip(faults, initials):
        new: dict[int, int] = {}
        for state, w in best.items():
            for _, cost, t in _steps(fault, initial, state):
                v = w + cost * base
                if v < new.get(t, v + 1):
                    new[t] = v
        best = widen(new)
    least = min(best[s] for s in (START, ASSISTANT) if s in best)
    return -least % base


def matrix(faults: list[int], initials: list[str], states=(START, SYSTEM, USER, ASSISTANT)) -> dict[tuple[int, int], int]:
    """Least integers {(from, to): weight} over a block without inserts; its letters are as many as its messages."""
    n, out = len(faults), {}
    for first in states:
        best = {first: 0}
        for i, (fault, initial) in enumerate(zip(faults, initials)):
            new: dict[int, int] = {}
            up = BITS * (n - 1 - i)
            for state, w in best.items():
                for letter, cost, t in _steps(fault, initial, state):
                    v = w + (cost << BITS * n) + (CODE[letter] << up)
                    if v < new.get(t, v + 1):
                        new[t] = v
            best = new
        out |= {(first, t): w for t, w in best.items()}
    return out


def joined(a: dict, a_letters: int, b: dict, b_letters: int) -> dict:
    """The matrix of two blocks in a row."""
    out: dict[tuple[int, int], int] = {}
    low = (1 << BITS * b_letters) - 1
    split = {k: ((w >> BITS * b_letters) << BITS * (a_letters + b_letters), w & low) for k, w in b.items()}
    for (s, t), w in a.items():
        moved = w << BITS * b_letters
        for (u, v), (cost, letters) in split.items():
            if t == u and moved + cost + letters < out.get((s, v), moved + cost + letters + 1):
                out[s, v] = moved + cost + letters
    return out


def _read(weight: int, letters: int) -> tuple[int, str]:
    """(cost, audit) of a least integer."""
    text = bin((1 << BITS * letters) | weight & ((1 << BITS * letters) - 1))[3:]
    return weight >> BITS * letters, "".join(LETTER.get(int(text[k:k + BITS], 2), "") for k in range(0, BITS * letters, BITS))


def _with_inserts(faults: list[int], initials: list[str], most: int) -> tuple[int, str]:
    """The DAG with nodes (message, inserts so far, role)."""
    n = len(faults)
    letters = n + most
    best: dict[tuple[int, int], int] = {(0, START): 0}

    def step(to, key, w, cost, letter, at):
        v = w + (cost << BITS * letters) + (CODE[letter] << BITS * (letters - 1 - at))
        if v < to.get(key, v + 1):
            to[key] = v
    for i in range(n + 1):
        for j in range(most):
            for state in range(4):
                if (j, state) in best:
                    step(best, (j + 1, _inserted(state)), best[j, state], INSERT, "I", i + j)
        if i < n:
            new: dict[tuple[int, int], int] = {}
            for (j, state), w in best.items():
                for letter, cost, t in _steps(faults[i], initials[i], state):
                    step(new, (j, t), w, cost, letter, i + j)
            best = new
    return _read(min(w for (_, s), w in best.items() if s in (START, ASSISTANT)), letters)


def audit(faults: list[int], initials: list[str]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equally cheap ones the least in ASCII."""
    most = most_inserts(faults, initials)
    if most:
        return _with_inserts(faults, initials, most)
    whole, n = {(START, START): 0}, 0
    for at in range(0, len(faults), BLOCK):
        some = faults[at:at + BLOCK], initials[at:at + BLOCK]
        whole = joined(whole, n, matrix(*some, states=(START,) if at == 0 else (START, SYSTEM, USER, ASSISTANT)), len(some[0]))
        n += len(some[0])
    return _read(min(whole[START, s] for s in (START, ASSISTANT) if (START, s) in whole), n)


def mended(letters: str, rows, state: int = START) -> Iterator[tuple[str, str] | int]:
    """(role, text) of the repaired messages of rows (role, text); at the end the state, as a number."""
    rows = iter(rows)
    for letter in letters:
        if letter == "I":
            state = _inserted(state)
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            state = _inserted(state)
            role = ROLE[state]
        else:
            state = SYSTEM if role[0] == "s" else USER if role[0] == "u" else ASSISTANT
        yield role, text
    yield state


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that the checksum of ``conv_id:turn`` names; missing values are one space."""
    flat, c = by_position(conversations), lambda name: F.col(position(conversations, name))
    told = lambda col: F.coalesce(col.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", told(c("conv_id")), told(c("turn")))) % 20
    rows = flat.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), told(c("role")).alias("role"),
                       told(c("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
            .drop("copy"))


class _Counts:
    """What is counted over a stretch of one conversation's messages in order; stretches can be added up."""

    names = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")

    def __init__(self, values=None):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        for name, v in zip(self.names, values or ()):
            setattr(self, name, v)

    def values(self) -> list:
        return [getattr(self, name) for name in self.names]

    def message(self, turn: int | None, initial: str, fault: int) -> None:
        one = [1, fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, 0, turn is not None, turn, turn, initial, initial]
        self.add(_Counts(one))

    def add(self, other: _Counts) -> None:
        """Put the next stretch behind this one."""
        if not other.n:
            return
        if self.n:
            self.illegal += self.last_initial + other.first_initial not in LEGAL
        else:
            self.first_initial = other.first_initial
        for name in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.last_initial = other.last_initial
        if other.first_turn is not None:
            if self.last_turn == other.first_turn:
                self.turns -= 1
            if self.first_turn is None:
                self.first_turn = other.first_turn
            self.last_turn = other.last_turn

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns

    def told(self) -> list[int]:
        return [self.gaps(), int(self.blank), int(self.duplicate), int(self.truncated), int(self.illegal)]


def _fault(text: str, again: bool) -> int:
    end = text.rstrip(SPACE)
    return BLANK if not end else DUPLICATE if again else GOOD if end[-1] in ".!?" else TRUNCATED


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
_OPEN = "part int, i long, turn long, role string, text string, digest binary"


def _closed(rows: list[tuple]) -> list:
    """The result of a whole conversation's rows (turn, role, text)."""
    counts, seen, faults, initials = _Counts(), set(), [], []
    for turn, role, text in rows:
        d = _digest(role, text)
        fault = _fault(text, d in seen)
        seen.add(d)
        counts.message(turn, role[:1], fault)
        faults.append(fault), initials.append(role[:1])
    cost, letters = audit(faults, initials)
    sha = hashlib.sha256()
    for k, x in enumerate(mended(letters, ((r, t) for _, r, t in rows))):
        if not isinstance(x, int):
            sha.update(f"{chr(10) * bool(k)}{x[0]}:{x[1]}".encode("utf-8", "surrogatepass"))
    return [*counts.told(), cost, letters, sha.hexdigest()]


def _grouped(rows: Iterator[tuple], key=lambda r: r[0]) -> Iterator[tuple]:
    from itertools import groupby
    return groupby(rows, key)


def _batches(rows: Iterator[list], schema: str, size: int = 2000) -> Iterator:
    """Arrow batches of rows under a Spark schema of plain types."""
    import pyarrow as pa
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(zip(*out) if out else [[]] * len(fields), fields)], [n for n, _ in fields])
    out: list = []
    held = 0
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(out) == size or held > 8 << 20:
            yield made(out)
            out, held = [], 0
    yield made(out)


def _first_pass(batches) -> Iterator:
    """Results of conversations inside this range, and the rows of the first and the last one, marked open."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    none = [None] * 8

    def open_rows(conv, rows):
        for i, (_, turn, role, text) in enumerate(rows):
            yield [conv, *none, part, i, turn, role, text, _digest(role, text)]

    def run():
        held = None  # the conversation before, which is open if it is the last
        for k, (conv, rows) in enumerate(_grouped(rows_of(batches, "conv_id", "turn", "role", "text"))):
            if held is not None:
                yield [held[0], *_closed(held[1]), part, None, None, None, None, None]
                held = None
            if k == 0:
                yield from open_rows(conv, rows)
            else:
                held = conv, [r[1:] for r in rows]
        if held is not None:
            yield from open_rows(held[0], ((None, *r) for r in held[1]))
    yield from _batches(run(), f"{OUT}, {_OPEN}")


def _pack(m: dict) -> str:
    return ";".join(f"{s},{t},{w:x}" for (s, t), w in sorted(m.items()))


def _unpack(text: str) -> dict:
    return {(int(s), int(t)): int(w, 16) for s, t, w in (x.split(",") for x in text.split(";"))}


_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
_BLOCKS = f"conv_id long, part int, block long, {_COUNTS}, matrix string"


def _blocks(batches) -> Iterator:
    """Each range's part of an open conversation as blocks of at most BLOCK messages."""
    def run():
        rows = rows_of(batches, "conv_id", "part", "i", "turn", "role", "text", "again")
        for (conv, part, block), some in _grouped(rows, lambda r: (r[0], r[1], r[2] // BLOCK)):
            counts, faults, initials = _Counts(), [], []
            for _, _, _, turn, role, text, again in some:
                faults.append(_fault(text, again)), initials.append(role[:1])
                counts.message(turn, role[:1], faults[-1])
            yield [conv, part, block, *counts.values(), _pack(matrix(faults, initials))]
    yield from _batches(run(), _BLOCKS)


_DECIDED = "conv_id long, part int, block long, state int, letters string, written boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _decide(batches) -> Iterator:
    """The least integer of every open conversation over its blocks in order, and what it says for each block."""
    def run():
        rows = rows_of(batches, "conv_id", "part", "block", *_Counts.names, "matrix")
        for conv, some in _grouped(rows):
            places, counts, whole, n = [], _Counts(), {(START, START): 0}, 0
            for _, part, block, *values, packed in some:
                places.append((part, block, values[0], packed))
                counts.add(_Counts(values))
                m = _unpack(packed)
                if n == 0:
                    m = {k: w for k, w in m.items() if k[0] == START}
                whole = joined(whole, n, m, values[0])
                n += values[0]
            cost, letters = _read(min(whole[START, s] for s in (START, ASSISTANT) if (START, s) in whole), n)
            state, at, written = START, 0, False
            for part, block, size, packed in places:
                own = letters[at:at + size]
                yield [conv, part, block, state, own, written, *counts.told(), cost]
                written = written or own.strip("D") != ""
                state, at = next(t for (s, t), w in _unpack(packed).items() if s == state and _read(w, size)[1] == own), at + size
    yield from _batches(run(), _DECIDED)


_PIECES = "conv_id long, part int, block long, seq int, piece binary"


def _pieces(batches) -> Iterator:
    """The repaired text of each block, in pieces."""
    def run():
        rows = rows_of(batches, "conv_id", "part", "block", "role", "text", "state", "letters", "written")
        for (conv, part, block), some in _grouped(rows, lambda r: r[:3]):
            first = next(some)
            state, letters, written = first[5:]
            out, held, seq = [], 0, 0

            def messages(first=first, some=some):
                yield first[3:5]
                for r in some:
                    yield r[3:5]
            for x in mended(letters, messages(), state):
                if isinstance(x, int):
                    break
                out.append(f"{chr(10) * written}{x[0]}:{x[1]}".encode("utf-8", "surrogatepass"))
                written = True
                held += len(out[-1])
                if held >= PIECE:
                    yield [conv, part, block, seq, b"".join(out)]
                    out, held, seq = [], 0, seq + 1
            yield [conv, part, block, seq, b"".join(out)]
    yield from _batches(run(), _PIECES, 64)


def _hashed(batches) -> Iterator:
    """sha256 over the pieces of each conversation in order, one piece in memory."""
    def run():
        for conv, some in _grouped(rows_of(batches, "conv_id", "piece", "letters", *_NAMES[1:7])):
            sha, letters, told = hashlib.sha256(), [], None
            for _, piece, own, *told in some:
                sha.update(piece)
                letters.append(own or "")
            yield [conv, *told, "".join(letters), sha.hexdigest()]
    yield from _batches(run(), OUT)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): counts of faults, cost, audit and hash of the repair.

    Conversations that have no row left do not appear; see :func:`repaired_conversations`.
    """
    h = F.xxhash64("text").alias("h")
    order = ["conv_id", "turn", "role", "h"]
    ranged = (conversations.select("conv_id", "turn", "role", "text", h, F.monotonically_increasing_id().alias("salt"))
              .repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt"))
    first = stored(ranged.select("conv_id", "turn", "role", "text").mapInArrow(_first_pass, f"{OUT}, {_OPEN}"), "conversations")
    closed = first.where("i IS NULL").select(*_NAMES)
    rows = first.where("i IS NOT NULL").select("conv_id", "part", "i", "turn", "role", "text", "digest")
    seen = rows.groupBy(F.col("conv_id").alias("c_"), F.col("digest").alias("d_")).agg(F.min(F.struct("part", "i")).alias("at"), F.count("*").alias("k")).where("k > 1")
    marked = (rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("digest") == F.col("d_")), "left")
              .select("conv_id", "part", "i", "turn", "role", "text", F.coalesce(F.col("at") != F.struct("part", "i"), F.lit(False)).alias("again"))
              .withColumn("block", F.floor(F.col("i") / BLOCK)))
    marked = stored(marked, "open-rows")
    again = marked.repartition("conv_id", "part", "block").sortWithinPartitions("conv_id", "part", "i")
    blocks = again.select("conv_id", "part", "i", "turn", "role", "text", "again").mapInArrow(_blocks, _BLOCKS)
    decided = stored(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_decide, _DECIDED), "decided")
    named = decided.select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), F.col("block").alias("b_"), "state", "letters", "written")
    told = (marked.join(named, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_")) & (F.col("block") == F.col("b_")))
            .repartition("conv_id", "part", "block").sortWithinPartitions("conv_id", "part", "i"))
    pieces = told.select("conv_id", "part", "block", "role", "text", "state", "letters", "written").mapInArrow(_pieces, _PIECES)
    facts = decided.select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), F.col("block").alias("b_"), "letters", *_NAMES[1:7])
    joint = (pieces.join(facts, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_")) & (F.col("block") == F.col("b_")))
             .select("conv_id", "part", "block", "seq", "piece", F.when(F.col("seq") == 0, F.col("letters")).alias("letters"), *_NAMES[1:7]))
    opened = joint.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "seq").drop("part", "block", "seq").mapInArrow(_hashed, OUT)
    return closed.unionByName(opened)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row for every conversation of the table: the damaged rows' faults and their cheapest repair.

    A conversation without rows after the damage has zeros, no audit and the hash of an empty text.
    """
    ids = by_position(conversations).select(F.col(position(conversations, "conv_id")).cast("long").alias("conv_id")).distinct()
    found = repair(damaged(conversations)).select(F.col("conv_id").alias("c_"), *_NAMES[1:])
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c_")), "left").drop("c_")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _NAMES[1:7]], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
