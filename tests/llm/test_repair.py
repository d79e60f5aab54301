"""Conversation repair against a row-by-row search, and its defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from feedlake.llm import repair
from feedlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of every row from every state."""
    best = {"": (0, "", [])}

    def better(table, end, cost, audit, lines):
        if end not in table or (cost, audit) < table[end][:2]:
            table[end] = (cost, audit, lines)

    def inserts(table):
        for _ in range(3):
            for end, (cost, audit, lines) in list(table.items()):
                to = "a" if end == "u" else "u"
                better(table, to, cost + 5, audit + "I", lines + [("user" if to == "u" else "assistant") + ":"])
        return table

    for role, text, fault in rows:
        inserts(best)
        new = {}
        for end, (cost, audit, lines) in best.items():
            better(new, end, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            first = role[:1]
            if first in ("s", "u", "a") and {"s": end == "", "u": end in ("", "s", "a"), "a": end == "u"}[first]:
                better(new, first, cost + more, audit + "K", lines + [f"{role}:{text}"])
            to = "a" if end == "u" else "u"
            better(new, to, cost + more + 1, audit + "R", lines + [("user" if to == "u" else "assistant") + ":" + text])
        best = new
    inserts(best)
    return min(best[e] for e in ("", "a") if e in best)


def expected(conv_rows):
    """The contract's columns of one conversation's damaged rows, in order."""
    seen, rows, n, illegal, last = set(), [], defaultdict(int), 0, None
    for _, _, role, text in conv_rows:
        shown = text.strip(SPACES)
        fault = ("blank" if not shown else "duplicate" if (role, text) in seen
                 else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
        n[fault] += 1
        rows.append((role, text, fault))
        if last is not None and last[:1] + role[:1] not in ("su", "ua", "au"):
            illegal += 1
        last = role
    turns = [t for _, t, _, _ in conv_rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = cheapest(rows)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {k: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0)) for k, v in out.items()}


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                                "repaired_sha256")) for r in df.collect()}


def test_query_equals_a_search_over_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs = by_conversation(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {k: expected(convs[k]) if k in convs else nothing for k in {r[0] for r in rows}}
    assert found(QUERIES["op13_repair"](spark, SF)) == want


def _random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \n", "Yes.", "same!", "no end", f"text {t}.", f"text {t}", "ünï?\n", None])
            rows.append((c, rng.choice([t, t + 3]) if rng.random() < 0.95 else None, role, text))
    return [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(x[0], x[1]) for x in rows[:i]}]  # no ties here


def _named(spark, rows, tmp=None):
    df = spark.createDataFrame(rows, TURNS)
    out = repair.repair(df).withColumnRenamed("k", "key")
    return {None if r["key"] == "-" else int(r["key"][1:]): tuple(r[c] for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out.collect()}


def test_random_conversations(spark):
    rows = _random_rows(5, 60, 14)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert _named(spark, rows) == {k: expected(v) for k, v in by_conversation(plain).items()}


def test_a_conversation_over_many_segments(spark):
    """One conversation with most rows is split; state is handed on."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["same.", f"t {t}.", f"cut {t}", ""]))
            for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(6)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    rows_frame, chosen = repair.edits(spark.createDataFrame(rows, TURNS))
    held = chosen.filter("k = '=7'").selectExpr("shiftright(pos, 33) AS s").distinct().count()
    assert held > 4
    assert _named(spark, rows) == {k: expected(v) for k, v in by_conversation(rows).items()}


def test_runs_advance_like_single_rows():
    rng = random.Random(1)
    for symbol in range(9):
        v, n = repair.END, rng.randint(1, 70)
        for _ in range(n):
            v = repair.applied(repair.power(symbol, 0), v)
        assert repair.advance(symbol, n, repair.END) == v
    symbols = np.array([rng.choice([1, 1, 2, 8]) for _ in range(200)])
    runs = repair.collapse(symbols)
    assert sum(n for _, n in runs) == 200 and repair.applied(repair.matrix(runs), repair.END)[0] < repair.INF


def test_defined_cases(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, None, None, None), (2, 1, "user", "x" * 200_000 + "."),
            (2, 1, "user", "x" * 200_000 + "."), (2, 2, "assistant", "end")]
    got = _named(spark, rows)
    assert got[None][5:7] == (0, "KK") and got[1][:7] == (0, 1, 0, 0, 0, 2, "D")
    assert got[2][:7] == (0, 0, 1, 1, 1, 6, "DDD")  # three deletions (6) are cheaper than K D K (7)
    clash = spark.createDataFrame(rows, TURNS).selectExpr("*", "'z' AS pos", "1 AS k", "2 AS seg", "3 AS fault", "4 AS letter")
    assert {r["k"]: r["audit"] for r in repair.repair(clash).collect()} == {"-": "KK", "=1": "D", "=2": "DDD"}
    assert repair.repair(clash.limit(0)).count() == 0
    assert found_empty(spark)


def found_empty(spark):
    return repair.repair(repair.damaged(spark.createDataFrame([], TURNS))).count() == 0


def test_repaired_rows_follow_the_audit(spark):
    rows = _random_rows(9, 30, 10)
    df = spark.createDataFrame(rows, TURNS)
    lines = defaultdict(list)
    for r in repair.repaired_turns(df).orderBy("k", "pos", "part").collect():
        lines[r["k"]].append(f"{r['role']}:{r['text']}")
    for r in repair.repair(df).collect():
        assert hashlib.sha256("\n".join(lines[r["k"]]).encode()).hexdigest() == r["repaired_sha256"]
        got = "".join(x[0] for x in lines[r["k"]])
        core = got[1:] if got[:1] == "s" else got
        assert core == "ua" * (len(core) // 2) and (core or not got)


@pytest.mark.parametrize("hit", range(5))
def test_damage(spark, hit):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == hit)
    rows = [(conv, 0, "assistant", "A. b! c?")]
    assert [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect()] == damage(rows)
