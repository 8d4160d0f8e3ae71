"""Repair of conversation structure by a dynamic program whose audits are shared, persistent strings.

Rows are sorted over the whole table by conversation and turn, so that a task holds a stretch of that order and a
conversation of any length lies in several. Stretches are cut into pieces of bounded size. For a conversation that one
piece holds, the cheapest edits are found at once. For others a piece gives the cheapest way from every state to every
state, and how those ways' audits compare; that is all it takes to chain the pieces, however many there are, and to
know for each the state it is entered and left in. Its rows are then repaired as if it stood alone.

An audit is a linked node: its last letter, the node of the rest, ancestors at all powers of two, and a rolling hash.
Of two equally cheap audits the smaller is found by descending to their longest common prefix; what hashes call equal
is verified.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import Scratch

#: Rows and characters of a piece, the last row's text aside.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 22
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by the role that came last: none, system, user, assistant. What an inserted or changed role must be.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = {"su", "ua", "au"}
#: Inserts that a conversation needs at its end.
TAILS = (0, 2, 1, 0)
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
SPACES = " \t\n\x0b\x0c\r"
PRIME, BASE = (1 << 61) - 1, 911382323
Row = tuple[str, str, int]


class Audits:
    """Strings that grow at the end and share what they begin with; a node stands for the string that ends in it."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % PRIME)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal, letter by letter down to a node that they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if depth and self.letter[x] != self.letter[y] and self.same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # a hash collided

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))


Cell = tuple[int, int]


class Program:
    """Cheapest edits of a piece's rows (role, text, fault), from one state to each."""

    def __init__(self, rows: list[Row], entry: int) -> None:
        self.audits = Audits()
        cells: list[Cell | None] = [None] * 4
        cells[entry] = (0, 0)
        for role, _, fault in rows:
            cells = self.step(cells, role[:1], fault)
        self.cells = cells

    def better(self, cell: Cell | None, cost: int, node: int, letter: str) -> Cell:
        """The better of a cell and of an audit with one more letter."""
        if cell is not None and cell[0] < cost:
            return cell
        grown = self.audits.add(node, letter)
        if cell is None or cost < cell[0] or self.audits.less(grown, cell[1]):
            return cost, grown
        return cell

    def step(self, cells: list[Cell | None], initial: str, fault: int) -> list[Cell | None]:
        # inserts in front of the row: two at most, as a third comes back to a state at a cost
        cells = list(cells)
        for _ in range(2):
            for state, cell in enumerate(list(cells)):
                if cell is not None:
                    cells[FOLLOWS[state]] = self.better(cells[FOLLOWS[state]], cell[0] + INSERT, cell[1], "I")
        out: list[Cell | None] = [None] * 4
        stay = TRUNCATED if fault == CUT_OFF else 0
        for state, cell in enumerate(cells):
            if cell is None:
                continue
            cost, node = cell
            out[state] = self.better(out[state], cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            wanted = FOLLOWS[state]
            out[wanted] = self.better(out[wanted], cost + REROLE + stay, node, "R")
            if initial == NAMES[wanted][0]:
                out[wanted] = self.better(out[wanted], cost + stay, node, "K")
            elif initial == "s" and state == START:
                out[SYSTEM] = self.better(out[SYSTEM], cost + stay, node, "K")
        return out

    def finished(self) -> tuple[int, str, int]:
        """Cost, audit and state of the cheapest way that ends as a conversation may, inserts at the end included."""
        best: tuple[int, int, int] | None = None
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node = cell[0] + INSERT * TAILS[state], cell[1]
            for _ in range(TAILS[state]):
                node = self.audits.add(node, "I")
            if best is None or cost < best[0] or (cost == best[0] and self.audits.less(node, best[1])):
                best = cost, node, state
        assert best is not None
        return best[0], self.audits.text(best[1]), best[2]

    def ways(self) -> tuple[list[int | None], list[int]]:
        """Cost to each state, and the place of its audit among those of the four."""
        order: list[int] = []
        for state, cell in enumerate(self.cells):
            if cell is not None:
                place = sum(self.audits.less(self.cells[other][1], cell[1]) for other in order)
                order.insert(place, state)
        return [None if c is None else c[0] for c in self.cells], [order.index(s) if s in order else -1 for s in range(4)]


def replay(rows: list[Row], audit: str, entry: int) -> list[str]:
    """The repaired ``role:text`` lines that an audit leaves."""
    lines, state, rest = [], entry, iter(rows)
    for letter in audit:
        if letter == "I":
            state = FOLLOWS[state]
            lines.append(f"{NAMES[state]}:")
            continue
        role, text, _ = next(rest)
        if letter == "D":
            continue
        if letter == "R":
            state = FOLLOWS[state]
            role = NAMES[state]
        else:
            state = SYSTEM if role[:1] == "s" else FOLLOWS[state]
        lines.append(f"{role}:{text}")
    return lines


def chain(ways: list[tuple[list[int | None], list[int]]]) -> list[tuple[int, int]]:
    """Entry and exit state of each piece on the cheapest way through all of them, from 16 costs and ranks each."""
    # per state: cost, rank of the audit so far, and the states passed before, linked
    cells: dict[int, tuple[int, int]] = {START: (0, 0)}
    steps: list[dict[int, int]] = []
    for costs, ranks in ways:
        best: dict[int, tuple[int, int, int]] = {}
        for state, (cost, rank) in cells.items():
            for out in range(4):
                more = costs[4 * state + out]
                if more is not None and (out not in best or (cost + more, rank) < best[out][:2]):
                    best[out] = cost + more, rank, state
        order = sorted(best, key=lambda out: (best[out][1], ranks[4 * best[out][2] + out]))
        cells = {out: (best[out][0], order.index(out)) for out in best}
        steps.append({out: best[out][2] for out in best})
    state = min(cells, key=lambda s: (cells[s][0] + INSERT * TAILS[s], cells[s][1]))
    path = []
    for step in reversed(steps):
        path.append((step[state], state))
        state = step[state]
    return path[::-1]


def fault_of(role: str, text: str, again: bool) -> int:
    if not VISIBLE.search(text):
        return BLANK
    if again:
        return DUPLICATE
    return FINE if text.rstrip(SPACES)[-1] in ".!?" else CUT_OFF


class Piece:
    """Consecutive rows of one conversation, numbered within the task, and what its neighbours need to know of it."""

    def __init__(self, conv: object, number: int) -> None:
        self.conv, self.number, self.rows = conv, number, []
        self.chars = self.illegal = self.turns = 0
        self.turn: list[int] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None:
            if not self.turn or turn != self.turn[-1]:
                self.turns += 1
            self.turn = [self.turn[0] if self.turn else turn, turn]
        self.rows.append((role, text, fault))
        self.chars += len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.chars >= PIECE_CHARS

    def record(self, task: int, whole: bool) -> dict:
        faults = [f for *_, f in self.rows]
        out = {
            "conv": self.conv, "task": task, "number": self.number, "whole": whole, "n_rows": len(self.rows),
            "first_turn": self.turn[0] if self.turn else None, "last_turn": self.turn[1] if self.turn else None, "turns": self.turns,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF), "illegal": self.illegal,
            "first_role": self.rows[0][0][:1] if self.rows else None, "last_role": self.rows[-1][0][:1] if self.rows else None,
        }
        if whole:
            cost, audit, _ = Program(self.rows, START).finished()
            lines = replay(self.rows, audit, START)
            return out | {"cost": cost, "audit": audit, "repaired": "\n".join(lines) if lines else None}
        ways = [Program(self.rows, entry).ways() for entry in range(4)]
        kept = [{"role": r, "text": t, "fault": f} for r, t, f in self.rows]
        return out | {"costs": [c for costs, _ in ways for c in costs], "ranks": [r for _, ranks in ways for r in ranks], "rows": kept}


ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))
FIELDS: dict[str, tuple[pa.DataType, str]] = {
    "task": (pa.int32(), "int"), "number": (pa.int64(), "bigint"), "whole": (pa.bool_(), "boolean"), "n_rows": (pa.int64(), "bigint"),
    "first_turn": (pa.int64(), "bigint"), "last_turn": (pa.int64(), "bigint"), "turns": (pa.int64(), "bigint"),
    "blank": (pa.int64(), "bigint"), "duplicate": (pa.int64(), "bigint"), "truncated": (pa.int64(), "bigint"), "illegal": (pa.int64(), "bigint"),
    "first_role": (pa.string(), "string"), "last_role": (pa.string(), "string"),
    "cost": (pa.int64(), "bigint"), "audit": (pa.string(), "string"), "repaired": (pa.string(), "string"),
    "costs": (pa.list_(pa.int64()), "array<bigint>"), "ranks": (pa.list_(pa.int32()), "array<int>"),
    "rows": (ROWS, "array<struct<role:string,text:string,fault:int>>"),
}


def cut_pieces(rows: DataFrame, conv_type: str, most_rows: int) -> DataFrame:
    """Sorted rows (conv, turn, role, text, copies, later) to pieces; those of whole conversations are repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kind = TaskContext.get().partitionId(), None
        ready: list[dict] = []
        piece: Piece | None = None
        # the first conversation of a task may have begun in another, the last may go on in one
        alone, before = False, None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r["conv"] for r in ready], kind)]
            columns += [pa.array([r.get(name) for r in ready], t) for name, (t, _) in FIELDS.items()]
            return pa.record_batch(columns, ["conv", *FIELDS])

        for part in batches:
            kind = part.schema.field("conv").type
            for conv, turn, role, text, copies, later in zip(*(c.to_pylist() for c in part.columns)):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        ready.append(piece.record(task, alone))
                    alone, piece, before = piece is not None, Piece(conv, piece.number + 1 if piece else 0), None
                for _ in range(copies):
                    if piece.full(most_rows):
                        ready.append(piece.record(task, False))
                        alone, piece = False, Piece(conv, piece.number + 1)
                    again = later or before == (turn, role, text)
                    piece.add(turn, role, text, fault_of(role, text, again))
                    before = turn, role, text
                if len(ready) >= 256:
                    yield batch()
                    ready = []
        if piece is not None:
            ready.append(piece.record(task, False))
        if ready:
            yield batch()

    schema = ", ".join([f"conv {conv_type}", *(f"{name} {ddl}" for name, (_, ddl) in FIELDS.items())])
    return rows.mapInArrow(run, schema)


def chain_pieces(table: pa.Table) -> pa.Table:
    """(task, number, entry, exit, final) of the pieces of one conversation: 32 numbers of each are held."""
    table = table.sort_by([("task", "ascending"), ("number", "ascending")])
    path = chain(list(zip(table.column("costs").to_pylist(), table.column("ranks").to_pylist())))
    ends = [False] * (len(path) - 1) + [True]
    columns = [table.column("task"), table.column("number"), pa.array([e for e, _ in path], pa.int32()), pa.array([x for _, x in path], pa.int32()), pa.array(ends)]
    return pa.table(columns, ["task", "number", "entry", "exit", "final"])


def repair_parts(pieces: DataFrame) -> DataFrame:
    """cost, audit and repaired of pieces that are entered in ``entry``, left in ``exit`` and, if ``final``, closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(part.num_rows):
                row = part.slice(at, 1)
                item = {name: row.column(name)[0].as_py() for name in ("rows", "entry", "exit", "final")}
                rows = [(r["role"], r["text"], r["fault"]) for r in item["rows"]]
                program = Program(rows, item["entry"])
                cost, node = program.cells[item["exit"]]
                tail = TAILS[item["exit"]] if item["final"] else 0
                audit = program.audits.text(node) + "I" * tail
                lines = replay(rows, audit, item["entry"])
                columns = [row.column(name) for name in ("task", "number")]
                columns += [pa.array([cost + INSERT * tail], pa.int64()), pa.array([audit]), pa.array(["\n".join(lines) if lines else None], pa.string())]
                yield pa.record_batch(columns, ["task", "number", "cost", "audit", "repaired"])

    return pieces.select("task", "number", "rows", "entry", "exit", "final").mapInArrow(run, "task int, number bigint, cost bigint, audit string, repaired string")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` damaged by the crc32 of ``conv:turn`` modulo 20: 0 drops a row (``copies`` is 0), 1 empties its text, 2
    takes ``.!?`` out of it, 3 repeats it (``copies`` is 2), 4 makes its role user. Nulls of any of the four count as one
    space, but stay null in ids and turns. A column ``copies`` is replaced."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    return rows.withColumns({
        "copies": F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1),
        role: F.when(draw == 4, "user").otherwise(part(role)),
        text: F.when(draw == 1, "").when(draw == 2, F.regexp_replace(part(text), "[.!?]", "")).otherwise(part(text)),
    })


def repair_pieces(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repaired conversations in pieces: ``conv``, task and number (their order), whole (one piece holds it all),
    cost, audit and ``repaired`` (lines ``role:text``, null if none), counts of faults, turns and roles at the edges.

    Rows of a conversation are taken by turn, nulls first, rows of one turn by role and text. A null id is an id of its
    own, null roles and texts count as one space. ``copies`` names a column that says how often a row counts; rows that
    count 0 times only name their conversation. Equal rows each count. An empty table gives no rows.
    """
    scratch, conv_type = Scratch(rows.sparkSession), rows.schema[conv].dataType.simpleString()
    one_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    found = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), one_space(role).alias("role"), one_space(text).alias("text"),
        (F.col(copies).cast("int") if copies else F.lit(1)).alias("copies"),
    )
    # rows that don't count bring nothing but their conversation
    found = found.withColumns({name: F.when(F.col("copies") > 0, F.col(name)).otherwise("") for name in ("role", "text")})
    found = found.withColumns({"digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "place": F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))})
    # what occurs at several places is a duplicate behind the first; equal rows of one turn stand side by side
    counted = found.where("copies > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    repeats = counted.agg(F.min("place").alias("earliest"), F.max("place").alias("latest")).where("earliest <> latest").drop("latest")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = found.join(repeats, same, "left").select("conv", "turn", "role", "text", "copies", F.coalesce(F.col("place") > F.col("earliest"), F.lit(False)).alias("later"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_ = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = scratch.write(cut_pieces(sorted_, conv_type, piece_rows))
    parts = pieces.where("not whole")
    # only the narrow columns go to one task by conversation
    path = parts.select("conv", "task", "number", "costs", "ranks").groupBy("conv").applyInArrow(chain_pieces, "task int, number bigint, entry int, exit int, final boolean")
    repaired = scratch.write(repair_parts(parts.join(path, ["task", "number"])))
    done = parts.drop("cost", "audit", "repaired").join(repaired, ["task", "number"])
    names = ["conv", *(name for name in FIELDS if name not in ("costs", "ranks", "rows"))]
    return pieces.where("whole").select(*names).unionByName(done.select(*names)).withColumnRenamed("conv", conv)


SUMMARY = {"gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}


def summarise(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``repair_pieces``: gaps (turns missing between the first and the last), counts of
    faults, adjacent roles that may not follow each other, cost, audit, and the digest of the repaired lines.

    A conversation in several pieces is read piece by piece in order, its digest carried on; nothing of it is held but
    its audit.
    """
    span = F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")
    digest = F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256)
    whole = pieces.where("whole").select(F.col(conv), F.coalesce(span, F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = None, None

        def row(total: dict) -> pa.RecordBatch:
            gaps = total["last"] - total["first"] + 1 - total["turns"] if total["first"] is not None else 0
            values = [gaps, *(total[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(total["audit"]), total["digest"].hexdigest()]
            return pa.record_batch([pa.array([total["conv"]], kind), *(pa.array([v]) for v in values)], [conv, *SUMMARY])

        for part in batches:
            kind = part.schema.field(conv).type
            for p in (part.slice(at, 1).to_pylist()[0] for at in range(part.num_rows)):
                if total is None or p[conv] != total["conv"]:
                    if total is not None:
                        yield row(total)
                    total = {"conv": p[conv], "first": None, "last": None, "turns": 0, "role": None, "audit": [], "digest": hashlib.sha256(), "lines": False}
                    total |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    total[name] += p[name]
                total["audit"].append(p["audit"])
                if p["n_rows"]:
                    total["illegal"] += total["role"] is not None and total["role"] + p["first_role"] not in LEGAL
                    total["role"] = p["last_role"]
                if p["first_turn"] is not None:
                    total["turns"] += p["turns"] - (p["first_turn"] == total["last"])
                    total["first"] = p["first_turn"] if total["first"] is None else total["first"]
                    total["last"] = p["last_turn"]
                if p["repaired"] is not None:
                    total["digest"].update((("\n" if total["lines"] else "") + p["repaired"]).encode())
                    total["lines"] = True
        if total is not None:
            yield row(total)

    schema = ", ".join([f"`{conv}` {pieces.schema[conv].dataType.simpleString()}", *(f"{n} {t}" for n, t in SUMMARY.items())])
    order = [conv, "task", "number"]
    parts = pieces.where("not whole").repartition(conv).sortWithinPartitions(*order)
    return whole.unionByName(parts.mapInArrow(run, schema))
