"""Repair of conversation structure by weighted interval parsing.

Role initials of a well-formed conversation match ``(s?(ua)+)?``. The repair grammar has a
nonterminal for each pair of states of that language (what was said last: nothing, s, u, a). In
Chomsky normal form it reads

    [i j] -> [i k] [k j]          two neighbouring spans
    [i j] -> row                  kept, given another role, or deleted
    [i j] -> nothing              inserted turns (the insertion closure of every cell)

A cell of the chart has the cheapest (cost, audit) of each nonterminal over a span of rows; the
audit is the string of edit initials, and equal costs go to the ASCII-least. Equal costs of one
cell never have audits of which one begins with the other (that one would have more, paid insertions), so joining
cells keeps their order and the parts of a span can be parsed apart.

Rows are sorted over all conversations by range, so a conversation with most of the rows spans
many partitions. In each partition the rows of a conversation are parsed in blocks: a whole chart per
block, bottom-up by span length, then neighbouring blocks in pairs. What is left of a conversation, one
cell for each partition that it touches, is joined from its beginning in a last pass, which needs
the cells only of the state the conversation is in.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_type, map_arrow, store

BLOCK = 12                                  # rows of one chart
CACHE = 200_000                             # cells of spans that a task keeps
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, S, U, A = range(4)                    # states: the initial of the last turn
NAMES = {U: "user", A: "assistant"}
#: The turns that may follow in each state.
NEXT = {NONE: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def join(a: Cell, b: Cell, out: Cell | None = None) -> Cell:
    """The binary rules over two neighbouring spans; ``out`` may have derivations already."""
    out = {} if out is None else out
    for (i, k), (cost, audit) in a.items():
        for j in range(4):
            other = b.get((k, j))
            if other is not None:
                new = (cost + other[0], audit + other[1])
                if (i, j) not in out or new < out[i, j]:
                    out[i, j] = new
    return out


def _closure() -> Cell:
    """The cheapest insertions between two states."""
    cell: Cell = {(i, i): (0, "") for i in range(4)}
    step = {(i, j): (INSERT, "I") for i, to in NEXT.items() for j in to.values() if j in NAMES}
    for _ in range(3):
        cell = join(cell, step, dict(cell))
    return cell


INSERTED = _closure()


class Chart:
    """Cells of spans, each worked out once for all rows that look alike. A row is one letter:
    ``d`` if it must go, else its initial (``x``: none of s, u, a), upper case if truncated."""

    def __init__(self):
        self.cells: dict[str, Cell] = {}

    def row(self, kind: str) -> Cell:
        cell: Cell = {(i, i): (DELETE, "D") for i in range(4)}
        if kind != "d":
            more = TRUNCATED if kind.isupper() else 0
            for i, to in NEXT.items():
                for initial, j in to.items():
                    edits = [(KEEP + more, "K")] if initial == kind.lower() else []
                    edits += [(REROLE + more, "R")] if j in NAMES else []
                    for e in edits:
                        cell[i, j] = min(cell.get((i, j), e), e)
        return join(join(INSERTED, cell), INSERTED)

    def parse(self, kinds: str) -> Cell:
        """The cell of a whole span, from all splits of all its spans, shortest first."""
        if kinds not in self.cells:
            if len(self.cells) > CACHE:
                self.cells.clear()
            for n in range(1, len(kinds) + 1):
                for at in range(len(kinds) - n + 1):
                    span = kinds[at:at + n]
                    if span in self.cells:
                        continue
                    if n == 1:
                        self.cells[span] = self.row(span)
                        continue
                    cell: Cell = {}
                    for cut in range(1, n):
                        join(self.cells[span[:cut]], self.cells[span[cut:]], cell)
                    self.cells[span] = cell
        return self.cells[kinds]


class Segment:
    """What one partition knows of a conversation: its cell, and the counts that add up."""

    def __init__(self, conv, at: int):
        self.conv, self.at, self.kinds, self.spans = conv, at, "", []
        self.n = self.illegal = self.blank = self.duplicate = self.truncated = self.turns = 0
        self.first = self.last = self.low = self.high = self.first_turn = self.last_turn = None

    def add(self, kind: str, fault: str | None, initial: str, turn: int | None, chart: Chart) -> None:
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first, self.first_turn = initial, turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last_turn = turn
        self.last = initial
        self.n += 1
        self.kinds += kind
        if len(self.kinds) == BLOCK:
            self.fold(chart)

    def fold(self, chart: Chart) -> None:
        """Blocks join when their spans are equally long, so a row is joined a few times only."""
        if self.kinds:
            self.spans.append((1, chart.parse(self.kinds)))
            self.kinds = ""
        while len(self.spans) > 1 and self.spans[-2][0] == self.spans[-1][0]:
            self.merge()

    def merge(self) -> None:
        (n, a), (m, b) = self.spans[-2:]
        self.spans[-2:] = [(n + m, join(a, b))]

    def row(self, chart: Chart) -> dict:
        self.fold(chart)
        while len(self.spans) > 1:
            self.merge()
        cell = self.spans[0][1]
        return {c: getattr(self, c) for c in _COUNTS} | {
            "costs": [cell[i, j][0] if (i, j) in cell else None for i in range(4) for j in range(4)],
            "audits": [cell[i, j][1] if (i, j) in cell else None for i in range(4) for j in range(4)]}


_COUNTS = ("n", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns", "first_turn", "last_turn")
_CELL = T.StructType(
    [T.StructField(c, T.StringType() if c in ("first", "last") else T.LongType()) for c in _COUNTS]
    + [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))])


def with_faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, mark, blank, open, late``: ``mark`` is a hash of the text,
    ``open`` a text that does not end a sentence, ``late`` a row whose role and text an earlier
    turn has. Of rows that are equal in all of that, the sort that follows finds the first."""
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"mark": F.md5("text"), "blank": last == "", "open": ~F.right(last, F.lit(1)).isin(".", "!", "?")})
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = (rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"))
             .agg(F.min(at).alias("seen"), F.count("*").alias("times")).filter("times > 1").drop("times"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    return (rows.join(again, same, "left").withColumn("late", F.coalesce(at > F.col("seen"), F.lit(False)))
            .drop("c", "r", "m", "seen"))


def parsed(turns: DataFrame) -> DataFrame:
    """The rows in order, ``conv_id, at, role, text, cell``, stored. ``at`` rises over the whole
    table; a row with ``cell`` and without role stands for the rows of its conversation in one partition, the first of which has its ``at``."""
    order = ["conv_id", "turn", "role", "mark"]
    rows = with_faults(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), arrow_type(_CELL)]
    names = ["conv_id", "at", "role", "text", "cell"]

    def run(batches):
        at, chart, seg, before = TaskContext.get().partitionId() << 33, Chart(), None, None
        for b in batches:
            cells = []
            start = at
            cols = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            for conv, turn, role, mark, blank, opened, late in zip(*(cols[c].to_pylist() for c in (
                    "conv_id", "turn", "role", "mark", "blank", "open", "late"))):
                if seg is None or seg.conv != conv:
                    if seg is not None:
                        cells.append((seg.conv, seg.at, seg.row(chart)))
                    seg, before = Segment(conv, at), None
                key = (turn, role, mark)
                fault = "blank" if blank else "duplicate" if late or key == before else "truncated" if opened else None
                initial = role[:1]
                kind = "d" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "x"
                seg.add(kind.upper() if fault == "truncated" else kind, fault, initial, turn, chart)
                before, at = key, at + 1
            yield pa.RecordBatch.from_arrays(
                [cols["conv_id"], pa.array(range(start, at), pa.int64()), cols["role"].cast(pa.string()),
                 cols["text"].cast(pa.string()), pa.nulls(b.num_rows, kinds[4])], names=names)
            yield _batch(cells)
        yield _batch([(seg.conv, seg.at, seg.row(chart))] if seg is not None else [])

    def _batch(cells):
        conv, first, cell = zip(*cells) if cells else ((), (), ())
        void = [None] * len(cells)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((conv, first, void, void, cell), kinds)], names=names)

    return store(map_arrow(rows, run, T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("cell", _CELL)])), "parsed")


def _finish(conv, segments: list[tuple[int, dict]]) -> dict:
    """A conversation's counts and its cheapest repair from the cells of its segments, in order."""
    total = {c: sum(s[c] for _, s in segments) for c in ("illegal", "blank", "duplicate", "truncated", "turns")}
    low = high = None
    best = {NONE: (0, "", None)}                           # state: cost, audit, (before, segment)
    for k, (_, cell) in enumerate(segments):
        if k:
            old = segments[k - 1][1]
            total["illegal"] += old["last"] + cell["first"] not in LEGAL
            total["turns"] -= cell["first_turn"] is not None and cell["first_turn"] == old["last_turn"]
        low = cell["low"] if low is None else low
        high = cell["high"] if cell["high"] is not None else high
        new = {}
        for i, (cost, audit, way) in best.items():
            for j in range(4):
                c = cell["costs"][4 * i + j]
                if c is not None:
                    made = (cost + c, audit + cell["audits"][4 * i + j])
                    if j not in new or made < new[j][:2]:
                        new[j] = (*made, (way, k, i, j))
        best = new
    cost, audit, way = min((best[j] for j in (NONE, A) if j in best), key=lambda x: x[:2])
    path = []
    while way is not None:
        way, *step = way
        path.append(step)
    return {"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - total.pop("turns"), "cost": cost, "audit": audit,
            "path": path[::-1]} | {c: total[c] for c in ("illegal", "blank", "duplicate", "truncated")}


def found(rows: DataFrame) -> DataFrame:
    """Per conversation of ``parsed`` rows: its counts, ``cost``, ``audit`` and ``segments``, the
    audit of each run of rows with the ``at`` of its first row and the states around it."""
    cells = (rows.filter("cell IS NOT NULL").select("conv_id", "at", "cell")
             .repartition("conv_id").sortWithinPartitions("conv_id", "at"))
    schema = T.StructType.fromDDL(
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "segments array<struct<at: long, before: int, after: int, audit: string>>")
    kinds = arrow_type(schema)

    def run(batches):
        conv, held = None, []

        def close():
            got = _finish(conv, held)
            return {c: got[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")} | {
                "segments": [{"at": held[k][0], "before": i, "after": j, "audit": held[k][1]["audits"][4 * i + j]} for k, i, j in got["path"]]}

        for b in batches:
            out = []
            for c, at, cell in zip(*(x.to_pylist() for x in b.columns)):
                if held and c != conv:
                    out.append(close())
                    held = []
                conv = c
                held.append((at, cell))
            yield pa.RecordBatch.from_struct_array(pa.array(out, kinds))
        yield pa.RecordBatch.from_struct_array(pa.array([close()] if held else [], kinds))

    return map_arrow(cells, run, schema)


def spoken(before: int, after: int, audit: str) -> list[tuple[str, int]]:
    """Each edit with the state it leads to."""
    said, out = before, []
    left = len(audit) - audit.count("D")
    # From the beginning, only the state at the end tells whether a system turn came first.
    system = before == NONE and left and after == (S if left == 1 else A if left % 2 else U)
    for edit in audit:
        if edit != "D":
            said = S if said == NONE and system else A if said == U else U
        out.append((edit, said))
    return out


def edits(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row per edit of ``found`` repairs of ``parsed`` rows: ``conv_id, part, nth, edit, role,
    text``. ``part, nth`` give the order; role and text are those after the edit, of a deleted row those it had."""
    segments = repairs.select("conv_id", F.explode("segments").alias("s")).select("conv_id", "s.*")

    def run(batches):
        for b in batches:
            for conv, at, before, after, audit in zip(*(c.to_pylist() for c in b.columns)):
                out, row = [], at
                for nth, (edit, said) in enumerate(spoken(before, after, audit)):
                    out.append((conv, at, nth, edit, None if edit == "I" else row, NAMES[said] if edit in "IR" else None))
                    row += edit != "I"
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, (
                        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                    names=["conv_id", "part", "nth", "edit", "at", "given"])

    made = map_arrow(segments, run, "conv_id long, part long, nth long, edit string, at long, given string")
    texts = rows.filter("cell IS NULL").select("at", "role", "text")
    held = made.filter("edit <> 'I'").join(texts, "at").select(
        "conv_id", "part", "nth", "edit", F.coalesce("given", "role").alias("role"), "text")
    return held.unionByName(made.filter("edit = 'I'").select(
        "conv_id", "part", "nth", "edit", F.col("given").alias("role"), F.lit("").alias("text")))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs of conversations (rows ``conv_id, turn, role, text``) as ``found`` and ``edits``.

    Rows go by turn, unknown turns first; rows of one turn by role, then by a hash of the text, so
    the result does not depend on how rows come. A null role or text is empty. A row's first fault
    counts: blank (only white space), duplicate (role and text of an earlier row, equal rows
    included), truncated (does not end in ``.``, ``!`` or ``?``). Blank rows and duplicates must be
    deleted. Rows without a conversation id are one conversation. Initials are the first character
    of the role as it stands. Other columns are not read; an empty table gives empty results. A
    conversation may have any number of rows: its audit alone is one string.
    """
    rows = parsed(turns)
    repairs = store(found(rows), "repairs")
    return repairs, edits(rows, repairs)
