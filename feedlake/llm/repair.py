"""Conversation structure repair: the cheapest edits that give a conversation
the role order ``(s?(ua)+)?`` (initials), with an audit of one letter an edit.

Edits: K keep (0), R rerole to user or assistant (1), D delete (2, required
for blank and duplicate rows), I insert a user or assistant row with empty
text (5, anywhere). A truncated row that is not deleted adds 5. Of the
cheapest scripts the one with the ASCII-least audit counts.

Method: run-length DP. A row is a symbol of role class and fault; equal
consecutive symbols collapse to a run, and the costs to go at a run's start
are its min-plus transition, raised to the run's length through cached binary
powers, times those at its end. The choices are then unrolled forward.

Rows are ranged by (conversation, turn, ...), so a conversation of any length
spreads over many segments. Each segment reduces its first and last
conversation to one 4 x 4 matrix and one state map; the driver chains these,
at most two a partition, and the segments unroll with the state handed on.
Only the SHA-256 of a conversation runs through one task, as a stream.

Defined cases: a NULL conversation is a conversation; NULL turns sort first;
NULL role or text reads as one space (no role class, blank). Rows equal in
turn sort by role, then text hash, then text; rows equal in all are
duplicates. Texts of any length are streamed, one batch of at most 64 MB at a
time. Extra columns are ignored, whatever their names. An empty table gives no row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut, null_key, slices

SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

INF = 1 << 40
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ACCEPTED = (0, INF, INF, 0)
#: Symbols: role class (system, user, assistant, other), that plus 4 if truncated, or GONE.
GONE = 8
CHUNK = 10_000
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a reproducible damage of conversations by the
    CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes it a user row. NULLs read as one space there."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# --- the min-plus automaton

def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(m: tuple, v: tuple) -> tuple:
    return tuple(min(INF, *(m[i][j] + v[j] for j in range(4))) for i in range(4))


IDENTITY = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def _inserts() -> tuple:
    once = tuple(tuple(min(IDENTITY[i][j], INSERT_COST if TURN[i] == j else INF) for j in range(4)) for i in range(4))
    return product(once, once)  # two inserts reach every state that more would reach


INSERTS = _inserts()
END = applied(INSERTS, ACCEPTED)


def row_options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, letters ascending."""
    out = [("D", DELETE_COST, state)]
    if symbol != GONE:
        more = TRUNCATED_COST if symbol >= 4 else 0
        if state in KEEP[symbol % 4]:
            out.append(("K", KEEP_COST + more, KEEP[symbol % 4][state]))
        out.append(("R", REROLE_COST + more, TURN[state]))
    return out


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> tuple:
    """The transition of ``2 ** bit`` rows of ``symbol``, inserts before each row included."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    row = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in row_options(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return product(INSERTS, tuple(map(tuple, row)))


def advance(symbol: int, length: int, v: tuple) -> tuple:
    """Costs to go before a run of ``length`` rows, from those after it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            v = applied(power(symbol, bit), v)
    return v


def collapse(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Runs (symbol, length)."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(symbols)) + 1, [len(symbols)]])
    return [(int(symbols[a]), int(b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]


def matrix(runs: list[tuple[int, int]]) -> tuple:
    m = IDENTITY
    for symbol, length in reversed(runs):
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                m = product(power(symbol, bit), m)
    return m


@lru_cache(maxsize=1 << 16)
def _step(symbol: int, after: tuple) -> tuple[tuple, tuple]:
    """Costs to go before a row, and per state (letters, roles put in, role given, next state)."""
    before = applied(power(symbol, 0), after)
    chosen = []
    for state in range(4):
        at, put = state, ""
        while True:
            left = before[at]
            if left >= INF:
                chosen.append(None)
                break
            options = row_options(symbol, at) + [("I", INSERT_COST, None)]
            for letter, cost, to in sorted(options):
                if (before[TURN[at]] if letter == "I" else after[to]) + cost == left:
                    break
            if letter == "I":
                at = TURN[at]
                put += "--ua"[at]
                continue
            chosen.append((put, letter, to if letter != "D" else -1, to))
            break
    return before, tuple(chosen)


def _closing(state: int) -> str:
    """Initials of the rows put in after the last row."""
    put, left = "", END[state]
    while left and left < INF:
        state, left = TURN[state], left - INSERT_COST
        put += "--ua"[state]
    return put


def unroll(runs: list[tuple[int, int]], end: tuple, state: int) -> Iterator[tuple[str, str, int, int]]:
    """Per row (initials put in before, letter, state of the kept role or -1, state
    after), from ``state`` at the start and the costs to go after the last run."""
    ends = [end]
    for symbol, length in reversed(runs):
        ends.append(advance(symbol, length, ends[-1]))
    for i, (symbol, length) in enumerate(runs):
        v = ends[len(runs) - 1 - i]
        inside = []
        for _ in range(length):
            low = min(v)
            v, step = _step(symbol, tuple(min(x - low, INF) if x < INF else INF for x in v))
            inside.append(step)
        for step in reversed(inside):
            found = step[state]
            state = found[3]
            yield found


def exits(runs: list[tuple[int, int]], end: tuple) -> list[int]:
    """Per start state the state after the last row, -1 if the end cannot be reached."""
    start = end
    for symbol, length in reversed(runs):
        start = advance(symbol, length, start)
    out = []
    for state in range(4):
        last = state
        if start[state] >= INF:
            last = -1
        else:
            for found in unroll(runs, end, state):
                last = found[3]
        out.append(last)
    return out


# --- the Spark job

def _classified(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    head = F.substring("role", 1, 1)
    kind = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    fault = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = turns.select(null_key(F.col(conv)).alias("k"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    return rows.select("k", "turn", "role", "text", kind.alias("kind"), fault.alias("fault"),
                       F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("same"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """(k, segment, pos, kind, fault, first of the segment, last of the segment) of each
    conversation of a segment; one conversation's numbers are held at a time."""
    key, seg, parts, first = None, None, [], True

    def whole(last: bool):
        return (key, seg, *(np.concatenate(x) for x in zip(*parts)), first, last)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("k").to_numpy(zero_copy_only=False)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "kind", "fault")]
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts, cuts[1:]):
            if k[a] != key and parts:
                yield whole(False)
                parts, first = [], False
            key, seg = k[a], batch.column("seg")[0].as_py()
            parts.append([c[a:b] for c in cols])
    if parts:
        yield whole(True)


def _symbols(kind: np.ndarray, fault: np.ndarray) -> np.ndarray:
    gone = (fault == BLANK) | (fault == DUPLICATE)
    return np.where(gone, GONE, kind + 4 * (fault == TRUNCATED))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, seg, _, kind, fault, first, last in _segments(batches):
        if first or last:
            m = matrix(collapse(_symbols(kind, fault)))
            yield pa.RecordBatch.from_pydict({"k": [k], "seg": pa.array([seg], pa.int32()), "m": [[x for row in m for x in row]]})


def _state_maps(ends: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, seg, _, kind, fault, first, last in _segments(batches):
            if (k, seg) in ends:
                out = exits(collapse(_symbols(kind, fault)), ends[k, seg])
                yield pa.RecordBatch.from_pydict({"k": [k], "seg": pa.array([seg], pa.int32()), "to": [out]})
    return run


def _edits(ends: dict, starts: dict, finals: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, seg, pos, kind, fault, first, last in _segments(batches):
            at = (k, seg)
            found = unroll(collapse(_symbols(kind, fault)), ends.get(at, END), starts.get(at, START))
            lo = 0
            while some := list(islice(found, CHUNK)):
                n = len(some)
                post = [""] * n
                if lo + n == len(pos) and finals.get(at, True):
                    post[-1] = _closing(some[-1][3])
                yield pa.RecordBatch.from_pydict({
                    "k": [k] * n, "pos": pos[lo:lo + n], "kind": pa.array(kind[lo:lo + n], pa.int32()),
                    "fault": pa.array(fault[lo:lo + n], pa.int32()),
                    "put": [x[0] for x in some], "letter": [x[1] for x in some],
                    "given": pa.array([x[2] for x in some], pa.int32()), "post": post})
                lo += n
    return run


EDITS = "k string, pos bigint, kind int, fault int, put string, letter string, given int, post string"


def edits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, edits): ``rows`` k, pos, role, text with ``pos`` ascending by conversation and
    turn; ``edits`` one row per row of ``rows``: kind, fault, initials put in before
    (``put``), letter, ``given`` (state of the role after the edit, -1 if deleted), initials
    put in after (``post``)."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ranged = _classified(turns, conv, turn, role, text).repartitionByRange(parts, *order)
    rows = cut(ranged.sortWithinPartitions(*order, "text").withColumn("pos", F.monotonically_increasing_id()))
    first = rows.groupBy("k", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    narrow = rows.select("k", "pos", "kind", "fault").join(first, "pos", "left").select("k", "pos", "kind", fault.alias("fault"))
    symbols = cut(narrow.repartitionByRange(parts, "pos").sortWithinPartitions("pos")
                  .withColumn("seg", F.spark_partition_id()))
    # at most two rows a partition reach the driver, whatever the number of rows
    chains: dict[str, list] = {}
    for r in symbols.mapInArrow(_reduced, "k string, seg int, m array<bigint>").collect():
        chains.setdefault(r["k"], []).append((r["seg"], tuple(tuple(r["m"][i:i + 4]) for i in range(0, 16, 4))))
    ends, starts, finals = {}, {}, {}
    chains = {k: sorted(v) for k, v in chains.items() if len(v) > 1}
    for k, chain in chains.items():
        v = END
        for seg, m in reversed(chain):
            ends[k, seg] = v
            v = applied(m, v)
    if chains:
        maps = {(r["k"], r["seg"]): r["to"] for r in symbols.mapInArrow(_state_maps(ends), "k string, seg int, to array<bigint>").collect()}
        for k, chain in chains.items():
            state = START
            for seg, _ in chain:
                starts[k, seg], finals[k, seg] = state, seg == chain[-1][0]
                state = maps[k, seg][state]
    return rows.select("k", "pos", "role", "text"), symbols.mapInArrow(_edits(ends, starts, finals), EDITS)


NAMES = {USER: "user", ASSISTANT: "assistant"}
PUT = {"u": "user", "a": "assistant"}
COSTS = {"K": KEEP_COST, "R": REROLE_COST, "D": DELETE_COST}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None

    def fresh() -> dict:
        return {"n": [0, 0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0, "last": None}

    def line(s: dict, role: str, text: str) -> None:
        if s["lines"]:
            s["sha"].update(b"\n")
        s["sha"].update(f"{role}:{text}".encode())
        s["lines"] += 1

    def result(k: str, s: dict) -> pa.RecordBatch:
        num = {c: pa.array([v], pa.int64()) for c, v in (("blank", s["n"][1]), ("duplicate", s["n"][2]), ("truncated", s["n"][3]),
                                                         ("illegal", s["illegal"]), ("cost", s["cost"]))}
        return pa.RecordBatch.from_pydict({"k": [k], **num, "audit": ["".join(s["audit"])], "repaired_sha256": [s["sha"].hexdigest()]})

    held = None
    for batch in slices(batches):
        for r in batch.to_pylist():
            if r["k"] != key:
                if state:
                    yield result(key, state)
                key, state = r["k"], fresh()
            if r["letter"] is None:
                held = r
                continue
            s = state
            s["n"][r["fault"]] += 1
            if s["last"] is not None and (s["last"], r["kind"]) not in ((0, 1), (1, 2), (2, 1)):
                s["illegal"] += 1
            s["last"] = r["kind"]
            for c in r["put"]:
                line(s, PUT[c], "")
            s["audit"].append("I" * len(r["put"]) + r["letter"] + "I" * len(r["post"]))
            s["cost"] += INSERT_COST * (len(r["put"]) + len(r["post"])) + COSTS[r["letter"]]
            if r["letter"] != "D":
                s["cost"] += TRUNCATED_COST * (r["fault"] == TRUNCATED)
                line(s, held["role"] if r["letter"] == "K" else NAMES[r["given"]], held["text"])
            for c in r["post"]:
                line(s, PUT[c], "")
    if state:
        yield result(key, state)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation ``k`` (its id as ``common.null_key``): gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    rows, chosen = edits(turns, conv, turn, role, text)
    both = rows.unionByName(chosen, allowMissingColumns=True)
    folded = both.repartition("k").sortWithinPartitions("k", "pos", F.col("letter").asc_nulls_first()).mapInArrow(
        _folded, "k string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    at = turns.select(null_key(F.col(conv)).alias("k"), F.col(turn).alias("turn"))
    span = at.groupBy("k").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("d"))
    gaps = span.select("k", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("d"), F.lit(0)).cast("long").alias("gaps"))
    return folded.join(gaps, "k")


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """The repaired rows: k, pos, part (order within ``pos``), role, text."""
    rows, chosen = edits(turns, conv, turn, role, text)
    given = F.when(F.col("letter") == "K", F.col("role")).when(F.col("given") == USER, F.lit("user")).otherwise(F.lit("assistant"))

    def put(c: str, sign: int) -> Column:
        return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x, i: F.struct(
            (F.lit(sign) * (F.lit(10) - i if sign < 0 else i + 1)).cast("int").alias("part"),
            F.when(x == "u", F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("letter") == "D", F.array().cast("array<struct<part:int,role:string,text:string>>")).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), given.alias("role"), F.col("text").alias("text"))))
    return rows.join(chosen.drop("k"), "pos").select(
        "k", "pos", F.explode(F.concat(put("put", -1), own, put("post", 1))).alias("x")).select("k", "pos", "x.*")
