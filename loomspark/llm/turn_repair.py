"""Repair of conversations: the cheapest edits that give a legal order of roles, by products of min-plus matrices.

Legal are no turns at all, or an optional system turn and then pairs of user and assistant. An automaton of four states reads
that: 0 at the start, 1 after the system turn, 2 after a user, 3 after an assistant; 0 and 3 may end. A turn is kept, gets the role
that is due, or is deleted; empty turns of the role that is due may be inserted anywhere. So a turn is a 4 x 4 matrix whose
entry (i, j) is the best (cost, audit) from state i before it to state j after it, the closure of inserts included; a longer run of
turns is the product of their matrices, with lower cost first and then the ASCII-least audit.

That product is associative: audits of equal cost between the same states over the same turns are never prefixes of one another (a longer
one would have more inserts, hence more cost), so what decides between them stays decided, whatever follows. Rows
are therefore partitioned by ranges of (conversation, turn): every task multiplies the runs it holds, pairwise, and only the first and the
last run of a task can belong to a conversation that goes on elsewhere. Those, at most two a task, are multiplied ``FAN`` at a time up a
tree. Faults are found before, by aggregates over digests of (conversation, role, text); texts move once, to the turns that stay.

Defined cases: null roles and texts count as one space. Null turns come first and have no part in gaps. Turns of equal number go by the
digest of conversation, role and text; repeated rows are adjacent then, and all but the first are duplicates. Null ids are one conversation. Conversations
left without rows report zeros and an empty audit. An audit has a letter a row and insert, so it is as long as its conversation. Columns beyond
the four don't matter, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Costs of an edit, of an insert, and of a truncated turn that isn't deleted.
RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State and role after the next turn, by state.
NEXT, ROLE = (2, 2, 3, 2), {1: "s", 2: "u", 3: "a"}
NAMES = {2: "user", 3: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
#: Pieces multiplied in one group, rows an output batch, longest run whose product is remembered.
FAN, ROWS, SHORT = 16, 2000, 8

Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]


def _better(a: Entry, b: Entry) -> Entry:
    return a if b is None or (a is not None and a <= b) else b


def combine(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for row in x:
        made = []
        for j in range(4):
            both = [(p[0] + q[0], p[1], q[1]) for p, q in ((row[m], y[m][j]) for m in range(4)) if p and q]
            least = min((b[0] for b in both), default=0)
            made.append(min(((c, a + b) for c, a, b in both if c == least), default=None))
        out.append(tuple(made))
    return tuple(out)


def _closure() -> Matrix:
    """Inserts only: from each state any number of turns of the role that is due."""
    out: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at, cost, audit = i, 0, ""
        while out[i][at] is None:
            out[i][at] = (cost, audit)
            at, cost, audit = NEXT[at], cost + INSERT, audit + "I"
    return tuple(map(tuple, out))


INSERTS = _closure()


@lru_cache(None)
def turn(kind: str) -> Matrix:
    """Inserts and one turn. Kinds: ``d`` must go; ``s u a o`` by the role's initial (o: any other), upper-case if truncated.

    ``L`` stands for a kept system turn, to tell the states apart that ``K`` leads to. It never competes with ``K``.
    """
    out: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if kind != "d":
            more, due = TRUNCATED * kind.isupper(), NEXT[i]
            out[i][due] = _better(out[i][due], (REROLE + more, "R"))
            if kind.lower() == ROLE[due]:
                out[i][due] = _better(out[i][due], (RETAIN + more, "K"))
            if i == 0 and kind.lower() == "s":
                out[0][1] = (RETAIN + more, "L")
    return combine(INSERTS, tuple(map(tuple, out)))


@lru_cache(1 << 16)
def _short(kinds: str) -> Matrix:
    return turn(kinds) if len(kinds) == 1 else combine(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def product(kinds: str) -> Matrix:
    """The product over a run of turns, pairwise, level by level."""
    level = [_short(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)]
    while len(level) > 1:
        level = [combine(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(m: Matrix) -> tuple[int, str]:
    """Cost and audit (with ``L``) of a whole conversation."""
    closed = combine(m, INSERTS)[0]
    return min(e for e in (closed[0], closed[3]) if e)


def follow(state: int, letter: str) -> int:
    return state if letter == "D" else 1 if letter == "L" else NEXT[state]


# Spark


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of ``id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends
    away, 3 repeats it, 4 makes it the user's. Nulls but the turn's own are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _facts(role: Column, text: Column) -> list[Column]:
    bare = F.rtrim(text, F.lit(BLANKS))
    return [F.substring(role, 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut")]


#: What a piece (the rows of one conversation in one task) reports; ``alive`` are the rows that an edit may keep.
_PIECE = """rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, cost array<long>, audit array<string>,
parts array<struct<task:int,rows:long>>"""
_ALIVE = "at array<long>, said array<binary>"


def _flat(m: Matrix) -> tuple[list, list]:
    flat = [e for row in m for e in row]
    return [e and e[0] for e in flat], [e and e[1] for e in flat]


def _square(p: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(p["cost"], p["audit"], strict=True)]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Run:
    """The turns of one conversation in one task, as they come."""

    def __init__(self, id_: object):
        self.id, self.kinds, self.at, self.said, self.length = id_, [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn_: int | None, said: bytes, initial: str, blank: bool, cut: bool, fresh: bool, n: int) -> None:
        if self.last is None:
            self.first = initial
        else:
            self.illegal += not _legal(self.last, initial)
        self.last = initial
        self.illegal += n - 1
        if turn_ is not None:
            self.turns += turn_ != self.most
            self.least, self.most = turn_ if self.least is None else self.least, turn_
        if blank or not fresh:
            self.blank, self.duplicate = self.blank + n * blank, self.duplicate + n * (not blank)
            self.kinds.append("d" * n)
        else:
            kind = initial if initial and initial in "sua" else "o"
            self.kinds.append((kind.upper() if cut else kind) + "d" * (n - 1))
            self.truncated, self.duplicate = self.truncated + cut, self.duplicate + n - 1
            self.at.append(self.length)
            self.said.append(said)
        self.length += n

    def piece(self, task: int, edge: bool) -> dict:
        cost, audit = _flat(product("".join(self.kinds)))
        names = "blank duplicate truncated illegal first last least most turns at said id".split()
        return {n: getattr(self, n) for n in names} | {"cost": cost, "audit": audit, "rows": self.length, "parts": [{"task": task, "rows": self.length}], "task": task, "edge": edge}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _scan(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, done = TaskContext.get().partitionId(), None, []
        edge = True
        for b in batches:
            for id_, *row in zip(*(b.column(c).to_pylist() for c in ("id", "turn", "said", "initial", "blank", "cut", "fresh", "n")), strict=True):
                if now is None or id_ != now.id:
                    if now is not None:
                        done.append(now.piece(task, edge))
                        edge = False
                    now = _Run(id_)
                now.add(*row)
            if done:
                yield _batch(done, schema)
                done = []
        if now is not None:
            yield _batch([now.piece(task, True)], schema)

    return run


def _joined(a: dict, b: dict) -> dict:
    """Two neighbouring pieces as one."""
    out = {n: a[n] + b[n] for n in ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "parts")}
    out["illegal"] += not _legal(a["last"], b["first"])
    out["turns"] -= a["most"] is not None and a["most"] == b["least"]
    out["least"], out["most"] = b["least"] if a["least"] is None else a["least"], a["most"] if b["most"] is None else b["most"]
    out["cost"], out["audit"] = _flat(combine(_square(a), _square(b)))
    return out | {"first": a["first"], "last": b["last"], "id": a["id"], "task": a["task"]}


def _merge(schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        level = sorted(t.to_pylist(), key=lambda p: p["task"])
        while len(level) > 1:
            level = [_joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pa.Table.from_pylist(level, schema=schema)

    return run


def _settle(schema: pa.Schema):
    """Cost and audit of whole conversations, and the audit's part for each task, with the state it starts from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.to_pylist():
                cost, audit = best(_square(p))
                state, at, cuts = 0, 0, []
                for k, part in enumerate(p["parts"]):
                    start, before, left = at, state, part["rows"]
                    last = k + 1 == len(p["parts"])
                    while at < len(audit) and (last or left):
                        left -= audit[at] != "I"
                        state, at = follow(state, audit[at]), at + 1
                    cuts.append({"task": part["task"], "state": before, "audit": audit[start:at]})
                gaps = 0 if p["least"] is None else p["most"] - p["least"] + 1 - p["turns"]
                out.append(p | {"gaps": gaps, "total": cost, "edits": audit.replace("L", "K"), "cuts": cuts})
            yield _batch([{n: o[n] for n in schema.names} for o in out], schema)

    return run


def _write(schema: pa.Schema):
    """The turns of repaired conversations: kept ones by their digest, with a new role or none, and inserted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for b in batches:
            for p in b.to_pylist():
                state, row, alive = p["state"], 0, dict(zip(p["at"], p["said"], strict=True))
                for seq, letter in enumerate(p["audit"]):
                    state = follow(state, letter)
                    if letter != "D":
                        new = NAMES.get(state) if letter in "RI" else None
                        out.append({"id": p["id"], "task": p["task"], "seq": seq, "said": None if letter == "I" else alive[row], "new": new})
                    row += letter != "I"
                    if len(out) >= ROWS:
                        yield _batch(out, schema)
                        out = []
        if out:
            yield _batch(out, schema)

    return run


def _arrow(df: DataFrame, schema: str) -> tuple[pa.Schema, str]:
    """An Arrow schema and DDL of ``id`` as in ``df`` and the given fields."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    full = StructType([df.schema["id"], *_parse_datatype_string(schema)])
    for f in full:
        f.nullable = True
    return to_arrow_schema(full), full


def repair(
    rows: DataFrame, ids: DataFrame | None = None, *, ranges: int | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """A report and the repaired turns.

    The report has a row a conversation of ``rows`` (or of ``ids``, where given): id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    The repaired turns are (id, task, seq, role, text), in the order of (task, seq) within an id. Rows are dealt to ``ranges`` tasks, or as
    Spark's settings for shuffles say.
    """
    scratch = Scratch(rows.sparkSession, "turn-repair")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"))
    said = F.concat(F.coalesce(F.col("id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    base = base.withColumn("said", F.unhex(F.sha2(F.when(F.col("id").isNull(), F.concat(F.lit("null"), said)).otherwise(said), 256)))
    narrow = base.select("id", "turn", "said", *_facts(F.col("role"), F.col("text"))).groupBy("id", "turn", "said", "initial", "blank", "cut").agg(F.count("*").alias("n"))
    narrow = scratch.save(narrow, "narrow")
    firsts = narrow.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"].alias("first"))
    ordered = narrow.join(firsts, "said").withColumn("fresh", F.col("turn").eqNullSafe(F.col("first"))).drop("first")
    by = ("id", "turn", "said")
    ordered = (ordered.repartitionByRange(ranges, *by) if ranges else ordered.repartitionByRange(*by)).sortWithinPartitions(*by)

    arrow, full = _arrow(base, f"task int, edge boolean, {_PIECE}, {_ALIVE}")
    pieces = scratch.save(ordered.mapInArrow(_scan(arrow), full), "pieces")
    arrow, full = _arrow(base, f"task int, {_PIECE}")
    edges = pieces.where("edge").select(*full.names)  # at most two a task
    tasks = (edges.agg(F.max("task")).first()[0] or 0) + 1
    width = 1
    while width < tasks:
        width *= FAN
        edges = edges.groupBy("id", F.floor(F.col("task") / width).alias("group")).applyInArrow(_merge(arrow), full)
    whole = pieces.where("not edge").select(*full.names).unionByName(edges)
    arrow, full = _arrow(base, "gaps long, blank long, duplicate long, truncated long, illegal long, total long, edits string, cuts array<struct<task:int,state:int,audit:string>>")
    settled = scratch.save(whole.mapInArrow(_settle(arrow), full), "settled")

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    ids = (base if ids is None else ids.select(F.col(id_col).alias("id"))).select("id").distinct()
    found = settled.select(F.col("id").alias("of"), *counts, F.col("total").alias("cost"), F.col("edits").alias("audit"))
    report = ids.join(found, ids["id"].eqNullSafe(found["of"]), "left").select("id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*counts, "cost"]), F.coalesce("audit", F.lit("")).alias("audit"))

    cut = settled.select(F.col("id").alias("of"), F.explode("cuts").alias("cut")).select("of", F.col("cut.task").alias("by"), "cut.state", "cut.audit")
    alive = pieces.select("id", "task", "at", "said")
    cut = cut.join(alive, cut["of"].eqNullSafe(alive["id"]) & (cut["by"] == alive["task"])).drop("of", "by")
    arrow, full = _arrow(base, "task int, seq long, said binary, new string")
    turns = scratch.save(cut.mapInArrow(_write(arrow), full), "turns")
    kept = turns.where("said is not null").join(base.select("said", "role", "text").dropDuplicates(["said"]), "said")
    kept = kept.select("id", "task", "seq", F.coalesce("new", "role").alias("role"), "text")
    added = turns.where("said is null").select("id", "task", "seq", F.col("new").alias("role"), F.lit("").alias("text"))
    return report, kept.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """(id, sha256): lowercase hex over the ``role:text`` of each conversation, joined by newlines.

    A digest is one chain over its conversation, so one task reads it; in order, batch by batch, without holding it.
    """
    arrow, full = _arrow(repaired, "sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, done = None, None, []
        for b in batches:
            for id_, role, text in zip(*(b.column(c).to_pylist() for c in ("id", "role", "text")), strict=True):
                if chain is None or id_ != now:
                    if chain is not None:
                        done.append({"id": now, "sha256": chain.hexdigest()})
                    now, chain = id_, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, arrow)
                done = []
        if chain is not None:
            yield _batch([{"id": now, "sha256": chain.hexdigest()}], arrow)

    return repaired.repartition("id").sortWithinPartitions("id", "task", "seq").mapInArrow(run, full)
