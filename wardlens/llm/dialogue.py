"""Repair of role sequences: a generalised LR parser over the role grammar whose edits have weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

# A conversation is empty, or pairs of user and assistant turns, perhaps behind one system turn. Terminals are initials.
START = "conversation"
GRAMMAR = (
    (START, ()), (START, ("pairs",)), (START, ("s", "pairs")), ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}  # what a turn may be inserted as or become
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# A conversation of at most so many rows inside one range is solved where it lies; the others are solved by pieces.
WHOLE_ROWS = 4096
_BATCH = 4096


class Stacks:
    """Shared stacks of an LR(0) automaton: a cell is a state over the cell below it, and equal cells are one.

    A cell's number stands for its whole stack. ``shift`` follows every reduction, so an ambiguous grammar gives several
    cells; cells from which nothing can be read and nothing accepted are left out. All cells that can be reached are
    numbered from the start and alike in every worker; the role grammar has a handful, as its recursion is on the left.
    """

    def __init__(self, grammar: tuple = GRAMMAR) -> None:
        self.grammar = grammar
        self.heads = {head for head, _ in grammar}
        self.cells: list[tuple[frozenset, int]] = []
        self.numbers: dict[tuple[frozenset, int], int] = {}
        self.root = self._cell(self._closure({(k, 0) for k, (head, _) in enumerate(grammar) if head == START}), -1)
        self.shift = lru_cache(None)(self._shift)
        self.accepts = lru_cache(None)(self._accepts)
        self.live = [self.root]
        for cell in self.live:
            for symbol in sorted({s for _, body in grammar for s in body} - self.heads):
                self.live += [top for top in self.shift(cell, symbol) if top not in self.live]

    def _closure(self, items: set[tuple[int, int]]) -> frozenset:
        todo = list(items)
        while todo:
            k, dot = todo.pop()
            rest = self.grammar[k][1][dot:]
            if rest and rest[0] in self.heads:
                for more, (head, _) in enumerate(self.grammar):
                    if head == rest[0] and (more, 0) not in items:
                        items.add((more, 0))
                        todo.append((more, 0))
        return frozenset(items)

    def _cell(self, state: frozenset, below: int) -> int:
        if (state, below) not in self.numbers:
            self.numbers[state, below] = len(self.cells)
            self.cells.append((state, below))
        return self.numbers[state, below]

    def _push(self, cell: int, symbol: str) -> int | None:
        moved = {(k, dot + 1) for k, dot in self.cells[cell][0] if self.grammar[k][1][dot : dot + 1] == (symbol,)}
        return self._cell(self._closure(moved), cell) if moved else None

    def _reduced(self, cell: int) -> Iterator[tuple[str, int]]:
        """(head, cell below its symbols) of every production that is complete on top of the stack."""
        for k, dot in sorted(self.cells[cell][0]):
            head, body = self.grammar[k]
            if dot == len(body):
                below = cell
                for _ in body:
                    below = self.cells[below][1]
                yield head, below

    def _accepts(self, cell: int) -> bool:
        return (START, self.root) in self._reduced(cell)

    def _shift(self, cell: int, symbol: str) -> tuple[int, ...]:
        todo, found = [self._push(cell, symbol)], []
        while todo:
            top = todo.pop()
            if top is None or top in found:
                continue
            found.append(top)
            todo += [self._push(below, head) for head, below in self._reduced(top) if head != START]
        return tuple(sorted(
            top for top in found
            if self.accepts(top) or any(self._push(top, s) is not None for _, body in self.grammar for s in body)))


STACKS = Stacks()

# The tops of the stacks after some rows: cell -> (cost, rank). A rank orders the audits of one such table, which are
# never prefixes of each other, as all have read the same rows and none ends with an insertion.
Tops = dict[int, tuple[int, int]]
# How a cell was reached from the rows before: (cell before, letters of the audit, roles they give; - for deleted ones).
Move = tuple[int, str, str]


def _inserted(tops: Tops) -> dict[int, tuple[int, int, str, str, int]]:
    """cell -> (cost, rank, letters, roles, cell before) with any insertions, least (cost, audit) first."""
    reach = {cell: (cost, rank, "", "", cell) for cell, (cost, rank) in tops.items()}
    todo = list(reach)
    while todo:
        cell = todo.pop()
        cost, rank, letters, roles, origin = reach[cell]
        for role in ROLES:
            for top in STACKS.shift(cell, role):
                way = (cost + INSERT, rank, letters + "I", roles + role, origin)
                if top not in reach or way < reach[top]:
                    reach[top] = way
                    todo.append(top)
    return reach


def read(tops: Tops, initial: str, fault: str) -> tuple[Tops, dict[int, Move]]:
    """The tops after one more row, and how each was reached. Equal tops merge by the least (cost, audit)."""
    found: dict[int, tuple[int, int, str, str, int]] = {}

    def offer(top: int, way: tuple[int, int, str, str, int]) -> None:
        if top not in found or way < found[top]:
            found[top] = way

    more = TRUNCATED if fault == "truncated" else 0
    for cell, (cost, rank, letters, roles, origin) in _inserted(tops).items():
        offer(cell, (cost + DELETE, rank, letters + "D", roles + "-", origin))
        if fault in ("blank", "duplicate"):
            continue
        for top in STACKS.shift(cell, initial):
            offer(top, (cost + more, rank, letters + "K", roles + initial, origin))
        for role in ROLES:
            for top in STACKS.shift(cell, role):
                offer(top, (cost + REROLE + more, rank, letters + "R", roles + role, origin))
    order = sorted(found, key=lambda top: found[top][1:3])
    return (
        {top: (found[top][0], rank) for rank, top in enumerate(order)},
        {top: (way[4], way[2], way[3]) for top, way in found.items()})


def finish(tops: Tops) -> tuple[int, str, str]:
    """(cell before, letters, roles) of the insertions that end a conversation at the least (cost, audit)."""
    best = min(way for cell, way in _inserted(tops).items() if STACKS.accepts(cell))
    return best[4], best[2], best[3]


def walk(tops: Tops, rows: list[tuple[str, str]]) -> tuple[Tops, list[dict[int, Move]]]:
    """``read`` over (initial, fault) rows."""
    moves = []
    for initial, fault in rows:
        tops, move = read(tops, initial, fault)
        moves.append(move)
    return tops, moves


def steps(moves: list[dict[int, Move]], cell: int) -> list[tuple[str, str]]:
    """(letters, roles) of every row on the way to ``cell``."""
    taken = []
    for move in reversed(moves):
        cell, letters, roles = move[cell]
        taken.append((letters, roles))
    return taken[::-1]


def _solved(rows: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """(letters, roles) of every row of a whole conversation; those of short ones are remembered."""
    return _remembered(rows) if len(rows) <= 32 else _solve(rows)


def _solve(rows: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    tops, moves = walk({STACKS.root: (0, 0)}, rows)
    cell, letters, roles = finish(tops)
    taken = steps(moves, cell)
    if taken:
        taken[-1] = (taken[-1][0] + letters, taken[-1][1] + roles)
    return taken


_remembered = lru_cache(20_000)(_solve)


def _copies(row: tuple) -> list[tuple[str, str]]:
    """(initial, fault) of a row and its repetitions."""
    role, fault, n = row[2], row[4], row[5]
    again = "blank" if fault == "blank" else "duplicate"
    return [(role[:1], fault)] + [(role[:1], again)] * (n - 1)


def _edits(group: list[tuple], taken: list[tuple[str, str]]) -> Iterator[tuple]:
    """The rows of a group with their letters and roles, those of repetitions joined."""
    at = 0
    for row in group:
        own = taken[at : at + row[5]]
        at += row[5]
        yield (*row, "".join(x for x, _ in own), "".join(x for _, x in own))


_ROW = "c string, turn long, role string, mark binary, fault string, n long"
_LIGHT = pa.schema([("c", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("mark", pa.binary()),
                    ("fault", pa.string()), ("n", pa.int64())])
_EDIT = pa.schema([*_LIGHT, ("letters", pa.string()), ("roles", pa.string())])
_PIECE = pa.schema([*_EDIT, ("part", pa.int32()), ("costs", pa.list_(pa.int64()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch], step: int = _BATCH) -> Iterator[tuple]:
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            part = whole.slice(start, step)
            yield from zip(*[part.column(k).to_pylist() for k in range(part.num_columns)])


class _Table:
    """Costs and ranks of a piece of a conversation from every cell it may begin with."""

    def __init__(self) -> None:
        self.ways: dict[int, Tops] = {cell: {cell: (0, 0)} for cell in STACKS.live}

    def read(self, row: tuple) -> None:
        for initial, fault in _copies(row):
            self.ways = {cell: read(tops, initial, fault)[0] for cell, tops in self.ways.items()}

    def flat(self) -> list[int]:
        return [x for a, tops in self.ways.items() for b, (cost, rank) in tops.items() for x in (a, b, cost, rank)]


def _solve_ranges(batches: Iterator[pa.RecordBatch], whole_rows: int) -> Iterator[pa.RecordBatch]:
    """Solves the conversations that lie whole in one range; of others, gives the rows and a table of costs.

    A range's first and last conversation may go on in its neighbours, and one that outgrows ``whole_rows`` is given on
    as it comes, so memory is bounded by that many rows.
    """
    part = TaskContext.get().partitionId()

    def solved() -> Iterator[tuple]:
        c, group, size, table, first = None, [], 0, None, True

        def opened() -> Iterator[tuple]:
            for held in group:
                table.read(held)
                yield (*held, None, None, part, None)

        for row in _rows(batches):
            if row[0] != c or c is None:
                if table is not None:
                    yield from opened()
                    yield (c, None, None, None, None, None, None, None, part, table.flat())
                elif c is not None:
                    taken = _solved(tuple(x for held in group for x in _copies(held)))
                    yield from ((*edit, part, None) for edit in _edits(group, taken))
                c, group, size, table, first = row[0], [], 0, _Table() if first else None, False
            group.append(row)
            size += row[5]
            if size > whole_rows:
                table = table or _Table()
                yield from opened()
                group, size = [], 0
        if c is not None:
            table = table or _Table()
            yield from opened()
            yield (c, None, None, None, None, None, None, None, part, table.flat())

    yield from _batches(solved(), _PIECE)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, part, begin, end, letters, roles): the cells between which each piece of a conversation is to run.

    ``batches`` hold (c, part, costs) with the pieces of a conversation behind each other in order. The last piece also
    gets the insertions at the conversation's end.
    """
    schema = pa.schema([("c", pa.string()), ("part", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()),
                        ("letters", pa.string()), ("roles", pa.string())])

    def conversation(c: str, pieces: list[tuple[int, dict]]) -> Iterator[tuple]:
        tops, backs = {STACKS.root: (0, 0)}, []
        for _, costs in pieces:
            found: dict[int, tuple[int, int, int, int]] = {}
            for a, (cost, rank) in tops.items():
                for b, (more, inner) in costs[a].items():
                    way = (cost + more, rank, inner, a)
                    if b not in found or way < found[b]:
                        found[b] = way
            order = sorted(found, key=lambda b: found[b][1:3])
            tops = {b: (found[b][0], rank) for rank, b in enumerate(order)}
            backs.append({b: way[3] for b, way in found.items()})
        end, letters, roles = finish(tops)
        out = []
        for (part, _), back in zip(reversed(pieces), reversed(backs)):
            out.append((c, part, back[end], end, letters, roles))
            end, letters, roles = back[end], "", ""
        yield from reversed(out)

    def all_of_them() -> Iterator[tuple]:
        c, pieces = None, []
        for key, part, flat in _rows(batches):
            if key != c and c is not None:
                yield from conversation(c, pieces)
                pieces = []
            c, costs = key, {}
            for a, b, cost, rank in zip(*[iter(flat)] * 4):
                costs.setdefault(a, {})[b] = (cost, rank)
            pieces.append((part, costs))
        if c is not None:
            yield from conversation(c, pieces)

    yield from _batches(all_of_them(), schema)


def _run_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the pieces of long conversations, each of whose rows carries where its piece begins and ends."""

    def all_of_them() -> Iterator[tuple]:
        key, group, plan = None, [], None

        def done() -> Iterator[tuple]:
            begin, end, letters, roles = plan
            _, moves = walk({begin: (0, 0)}, [x for row in group for x in _copies(row)])
            taken = steps(moves, end)
            taken[-1] = (taken[-1][0] + letters, taken[-1][1] + roles)
            yield from _edits(group, taken)

        for row in _rows(batches):
            if (row[0], row[6]) != key:
                if key is not None:
                    yield from done()
                key, group, plan = (row[0], row[6]), [], row[7:]
            group.append(row[:6])
        if key is not None:
            yield from done()

    yield from _batches(all_of_them(), _EDIT)


def _light(turns: DataFrame) -> DataFrame:
    """One row for equal rows (same conversation, turn, role and text), with their number and the first one's fault."""
    solid = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = turns.groupBy("c", "turn", "role", "mark").agg(
        F.count(F.lit(1)).alias("n"), F.max(solid).alias("solid"), F.max(ended).alias("ended"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))  # null turns come first
    first = rows.groupBy("c", "role", "mark").agg(F.min(place).alias("first"))
    fault = (
        F.when(~F.col("solid"), "blank").when(F.col("first") < place, "duplicate").when(~F.col("ended"), "truncated")
        .otherwise(""))
    return rows.join(first, ["c", "role", "mark"]).select("c", "turn", "role", "mark", fault.alias("fault"), "n")


def edits_of(light: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """``light`` rows with the letters of their edits and the roles those give.

    Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation is many ranges. A conversation
    inside one range is solved there. For the others each range gives its least costs between any two stacks, one row a
    range; a conversation's ranges are then chained, and each range is solved between the two stacks it got.
    """
    order = ["c", "turn", "role", "mark"]
    schema = f"{_ROW}, letters string, roles string, part int, costs array<long>"
    solved = stored(
        light.select(*_LIGHT.names).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(partial(_solve_ranges, whole_rows=whole_rows), schema), "ranges")
    tables = solved.filter("costs is not null").select("c", "part", "costs")
    plan = (
        tables.repartition("c").sortWithinPartitions("c", "part")
        .mapInArrow(_chosen, "c string, part int, begin int, end int, letters string, roles string"))
    opened = solved.filter("costs is null and letters is null").select(*_LIGHT.names, "part")
    pieces = (
        opened.join(plan, ["c", "part"]).select(*_LIGHT.names, "part", "begin", "end", "letters", "roles")
        .repartition("c", "part").sortWithinPartitions("c", "part", "turn", "role", "mark")
        .mapInArrow(_run_pieces, f"{_ROW}, letters string, roles string"))
    return solved.filter("letters is not null").select(*_EDIT.names).unionByName(pieces)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("c", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("fault", pa.string()), ("edit", pa.string()),
        ("role", pa.string()), ("text", pa.string())])

    def all_of_them() -> Iterator[tuple]:
        edit = None
        for c, turn, role, _, fault, letters, roles, text in _rows(batches, 256):
            if letters is not None:
                edit = (fault, letters, roles)
                continue
            if edit is None:
                continue  # a repetition of a row that is done
            fault, letters, roles = edit
            edit = None
            for letter, given in zip(letters, roles):
                if letter == "I":
                    yield c, None, None, None, letter, ROLES[given], ""
                    continue
                kept = {"K": role, "R": ROLES.get(given), "D": None}[letter]
                yield c, turn, role, fault, letter, kept, None if letter == "D" else text
                fault = "blank" if fault == "blank" else "duplicate"

    yield from _batches(all_of_them(), schema)


def repaired_turns(turns: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """(c, turn, was, fault, edit, role, text): every row of ``turns`` (conv_id, turn, role, text) and every insertion.

    ``c`` is ``key_of`` the conversation; ``was`` is the role a row had; ``edit`` is K (kept), R (rerole), D (deleted:
    role and text are null) or I (inserted: an empty text, null turn and ``was``). A row's first fault is blank (no
    character beside white space), duplicate (role and text were there before) or truncated (does not end with . ! ?).
    Blank and duplicate rows must be deleted. The edits are those of least (cost, audit) that leave no turn, or pairs of
    user and assistant turns, perhaps behind a kept system turn; only a role's initial counts.

    A conversation's rows lie behind each other in one partition, in order (turn, nulls first, then role, then a hash of
    the text), so that what follows can read it as it comes. Texts are shuffled once; the parse works on their hashes.
    The parse of a long conversation is spread over many tasks (``edits_of``); only this last pass over its rows is
    sequential, in memory of one batch.

    Null roles and texts are one space, a null conv_id is a conversation of its own. Repeated rows are duplicates that
    follow each other. Empty texts are blank; other columns are not read. An empty table gives an empty result.
    """
    one_space = F.lit(" ")
    rows = turns.select(
        key_of(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), one_space).alias("role"),
        F.coalesce(F.col("text").cast("string"), one_space).alias("text")
    ).withColumn("mark", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    nothing = F.lit(None).cast("string")
    edits = edits_of(_light(rows), whole_rows).select("c", "turn", "role", "mark", "fault", "letters", "roles", nothing.alias("text"))
    both = edits.unionByName(rows.select(
        "c", "turn", "role", "mark", nothing.alias("fault"), nothing.alias("letters"), nothing.alias("roles"), "text"))
    return (
        both.repartition("c").sortWithinPartitions("c", "turn", "role", "mark", F.col("letters").isNull())
        .mapInArrow(_merged, "c string, turn long, was string, fault string, edit string, role string, text string"))


def key_of(conv_id: Column) -> Column:
    """A conversation's key: its id as text behind =, or the empty text for null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


_LEGAL = {"su", "ua", "au"}
_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("c", pa.string()), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def all_of_them() -> Iterator[tuple]:
        c = None

        def done() -> tuple:
            gaps = min(last - first + 1 - distinct, 2**63 - 1) if distinct else 0
            return (c, gaps, *[counts[n] for n in names[1:]], "".join(audit), digest.hexdigest())

        for key, turn, was, fault, edit, role, text in _rows(batches, 256):
            if key != c:
                if c is not None:
                    yield done()
                c, counts, audit, digest, before, texts = key, dict.fromkeys(names, 0), [], hashlib.sha256(), None, 0
                first = last = None
                distinct = 0
            audit.append(edit)
            counts["cost"] += _COST[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                if fault:
                    counts[fault] += 1
                if before is not None and before + was[:1] not in _LEGAL:
                    counts["illegal"] += 1
                before = was[:1]
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
            if edit != "D":
                digest.update(("\n" if texts else "").encode() + f"{role}:{text}".encode())
                texts += 1
        if c is not None:
            yield done()

    yield from _batches(all_of_them(), schema)


def summaries(repaired: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Reads the rows of ``repaired_turns`` in the order they lie in, without a shuffle. ``gaps`` are the turns missing
    between the first and the last; ``illegal`` counts neighbours, before the repair, that are not su, ua or au. The
    hash is SHA-256 over the repaired role:text, joined by newlines, which can only be taken in sequence.
    """
    return repaired.mapInArrow(
        _summed, "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string")
