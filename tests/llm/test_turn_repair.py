"""op12 against every edit script of short conversations, and against a walk turn by turn of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomspark.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string, id string, said int, seq string, task string, audit int, n int"
EXTRA = ("x", 1, "y", "z", 2, 3)
LEGAL = re.compile(r"(s?(ua)+)?")
KINDS = "suaoSUAOd"


def scripts(kinds, inserts):
    """(cost, audit, initials) of every script with at most two inserts in a place."""
    extra = [p for n in range(inserts + 1) for p in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*(["D"] if k == "d" else ["K", "Ru", "Ra", "D"] for k in kinds)):
        for added in itertools.product(extra, repeat=len(kinds) + 1):
            cost, audit, out = 0, "", ""
            for i, more in enumerate(added):
                cost, audit, out = cost + 5 * len(more), audit + "I" * len(more), out + "".join(more)
                if i < len(kinds):
                    e, k = edits[i], kinds[i]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if k.isupper() and e != "D" else 0)
                    audit += e[0]
                    out += k.lower() if e == "K" else e[1:]
            if LEGAL.fullmatch(out):
                yield cost, audit


@pytest.mark.parametrize("n", [1, 2, 3])
def test_every_script(n):
    every = ["".join(k) for k in itertools.product(KINDS, repeat=n)]
    for kinds in every if n < 3 else random.Random(1).sample(every, 12):
        cost, audit = T.best(T.product(kinds))
        assert (cost, audit.replace("L", "K")) == min(scripts(kinds, 2)), kinds


def walk(kinds):
    """The least (cost, audit) turn by turn, without matrices."""
    due = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}

    def inserts(states):
        for _ in range(3):
            for q, (c, a) in list(states.items()):
                z, new = due[q][0], (c + 5, a + "I")
                states[z] = min(states.get(z, new), new)
        return states

    states = {0: (0, "")}
    for k in kinds:
        after = {}
        for q, (c, a) in inserts(states).items():
            moves = [(q, c + 2, "D")]
            if k != "d":
                more = 5 * k.isupper()
                moves.append((due[q][0], c + 1 + more, "R"))
                if k.lower() == due[q][1] or (q == 0 and k.lower() == "s"):
                    moves.append((1 if k.lower() == "s" else due[q][0], c + more, "K"))
            for z, cost, x in moves:
                after[z] = min(after.get(z, (cost, a + x)), (cost, a + x))
        states = after
    return min(v for q, v in inserts(states).items() if q in (0, 3))


def test_products_in_any_grouping():
    rng = random.Random(2)
    for n in (5, 17, 300):
        kinds = "".join(rng.choice(KINDS) for _ in range(n))
        cost, audit = T.best(T.product(kinds))
        assert (cost, audit.replace("L", "K")) == walk(kinds)
        cuts = sorted(rng.sample(range(1, n), 3))
        parts = [T.product(kinds[a:b]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        assert T.best(T.combine(T.combine(parts[0], parts[1]), T.combine(parts[2], parts[3]))) == (cost, audit)


def talks(seed=4):
    rng = random.Random(seed)
    say = lambda: rng.choice(["Yes.", "No?", "Well!  ", "cut short", "", " \t\n", None, "Many words. Said", "été…", "x" * 30 + "."]) if rng.random() < 0.5 else f"Say {rng.randint(0, 10**6)}."
    role = lambda i: rng.choice(["user", "assistant"][i % 2 : i % 2 + 1] * 8 + ["system", "tool", "uber", "", None, "user"])
    rows = [(c, i, "system" if i == 0 and c % 3 == 0 else role(i + (c % 3 == 0)), say()) for c in range(60) for i in range(rng.randint(1, 9))]
    rows += [(777, i, role(i), say()) for i in range(1500)]  # goes through several tasks
    rows += [(778, None, role(i), say()) for i in range(6)] + [(779, i // 3, role(i), say()) for i in range(12)] + [(None, i, role(i), say()) for i in range(5)]
    rows += [(780, 5, "user", "Again?")] * 4 + [(781, 10, "user", "A."), (781, 2, "assistant", "A."), (781, -3, "user", "A.")]
    return [(*r, *EXTRA) for r in rows]


def expected(rows):
    shown = lambda v: " " if v is None else str(v)
    by = {}
    for c, turn, role, text, *_ in rows:
        role, text, k = shown(role), shown(text), zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by.setdefault(c, []).extend([(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1))
    for c, turns in by.items():
        key = lambda t, c=c: hashlib.sha256((("null" if c is None else "") + f"{shown(c)}:{len(t[1])}:{t[1]}{t[2]}").encode()).hexdigest()
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, key(t)))
        seen, kinds = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kind = role[:1] if role[:1] in tuple("sua") else "o"
            kinds.append("b" if not bare else "d" if (role, text) in seen else kind if bare[-1] in ".!?" else kind.upper())
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        known = [t for t, *_ in turns if t is not None]
        cost, audit = walk(["d" if k in "bd" else k for k in kinds]) if turns else (0, "")
        out, at, initials = [], 0, ""
        for x in audit:
            due = "assistant" if initials[-1:] == "u" else "user"
            if x in "KR":
                out.append((turns[at][1] if x == "K" else due, turns[at][2]))
            if x == "I":
                out.append((due, ""))
            at += x != "I"
            initials = "".join(r[:1] for r, _ in out)[-1:]
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in out))
        yield (
            str(c), max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("b"), kinds.count("d"), sum(k.isupper() for k in kinds), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )


@pytest.mark.parametrize("ranges", [None, 3, 40])
def test_repair(spark, ranges):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report, repaired = T.repair(T.damage(df), df, ranges=ranges)
    sums = {str(r["id"]): r["sha256"] for r in T.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted((str(r["id"]), *r[1:], sums.get(str(r["id"]), empty)) for r in report.collect())
    assert got == sorted(expected(rows))
    assert ranges is None or repaired.where("id = 777").select("task").distinct().count() > ranges / 2


def test_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    report, repaired = T.repair(T.damage(none), none)
    assert report.count() == 0 and repaired.count() == 0 and T.digests(repaired).count() == 0
