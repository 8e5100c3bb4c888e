"""Repair of damaged conversations: the cheapest edits that give the roles their order.

Edits of a row are Keep (0), Rerole to user or assistant (1) and Delete (2); an Insert (5) adds an empty turn of user or
assistant. Blank rows and repeated ones have to go, a truncated row that stays costs 5 more. The repaired role initials
read ``(s?(ua)+)?``, so a walk over the rows needs four states. From a state each edit leads to one other state, so the
ASCII-least of the cheapest audits is found by taking the least letter that is still on a cheapest path.

The walk is a square-root checkpointed DP, spread over the cluster. Rows are dealt out by ranges of (conversation, turn,
role, digest of the text), so a conversation of any length lies in as many tasks as it needs. Blocks grow by one row each, so that n
rows give about ``sqrt(2 n)`` blocks of at most about ``sqrt(2 n)`` rows without n being known. Every block gives a
four by four matrix of cheapest costs from state to state. One pass from last to first over these matrices yields the
backward costs at the ends of blocks, the only ones that are stored. Each block then works out its own backward costs
again from its end and walks forward once for every state it can be entered in. The last pass streams rows and walks in
order; it holds one batch of rows and the audit itself.

Defined results: a null role or text is one space. Rows of one turn go by role, then by the SHA-256 of
their text (texts are moved only once, to be hashed); null turns come first. A
null conversation id is a conversation of its own. Rows whose role starts with another letter can be reroled or deleted.
Equal rows of one turn are counted, not copied. A conversation without rows has zeros, an empty audit and the hash of
the empty string. Gaps beyond a long are the largest long. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.session import materialize

# The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of the first block of a conversation in a task; each further block is one row longer.
FIRST_BLOCK = 32

BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60
LONGEST = (1 << 63) - 1
# States: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row, by state and the row's role (another letter, s, u, a); -1: not allowed.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: The one role of user and assistant that may come next, by state: after a rerole or an insert.
TURN = np.array([USER, USER, ASSISTANT, USER])
#: What it costs to end in a state: an open question needs an answer, a lone system row both.
END = np.array([0, 2 * INSERT, INSERT, 0])
# Codes of rows: role (0 to 3), plus 4 if the row must go, 8 if it is truncated, 16 if it is blank.
GOES, CUT, BLANK = 4, 8, 16

#: Blocks whose matrix or walks a task keeps, since most conversations are short and alike.
KEPT_BLOCKS = 1 << 14

_ORDER = ["conv", "turn", "role", "mark"]
_BLOCK = "conv {0}, part int, block long, turn long, role string, mark binary, codes binary, runs array<long>, matrix array<long>"

def damaged(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text``: rows damaged by ``crc32(conv:turn) % 20`` (dropped, emptied, cut, repeated, reroled)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))) % 20
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), kind.alias("kind"))
    rows = rows.where("kind <> 0").select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _before(code: int, after: np.ndarray) -> np.ndarray:
    """Cost-to-go before a row, by state, from that after it; further axes of ``after`` are carried along."""
    if code & GOES:
        return after + DELETE
    extra = TRUNCATED if code & CUT else 0
    kept = KEPT[:, code & 3]
    best = np.minimum(after + DELETE, after[TURN] + (REROLE + extra))
    allowed = kept >= 0
    best[allowed] = np.minimum(best[allowed], after[kept[allowed]] + extra)
    # Inserts before the row; a third one only leads back.
    once = np.minimum(best, best[TURN] + INSERT)
    return np.minimum(best, once[TURN] + INSERT)


def _step(code: int, copies: int, after: np.ndarray) -> np.ndarray:
    """The same for ``copies`` equal rows: those behind the first one are repeats, which go."""
    first = _before(code, after + DELETE * (copies - 1)) if copies > 1 else _before(code, after)
    return np.minimum(first, FAR)


@functools.lru_cache(KEPT_BLOCKS)
def block_matrix(codes: bytes, runs: tuple[int, ...]) -> np.ndarray:
    """Cheapest cost through a block from each state (row) to each state (column)."""
    cost = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code, copies in zip(reversed(codes), reversed(runs)):
        cost = _step(code, copies, cost)
    return cost


@functools.lru_cache(KEPT_BLOCKS)
def block_walks(codes: bytes, runs: tuple[int, ...], end: tuple[int, ...]) -> tuple[list[int], list[str]]:
    """State at the end and audit of a block, for every state at its start; ``end``: cost-to-go behind it."""
    costs = [np.array(end)]
    for code, copies in zip(reversed(codes), reversed(runs)):
        costs.append(_step(code, copies, costs[-1]))
    ahead = [c.tolist() for c in reversed(costs)]
    states, audits = [], []
    for state in range(4):
        letters = []
        for i, (code, copies) in enumerate(zip(codes, runs)):
            now, after = ahead[i], ahead[i + 1]
            later = DELETE * (copies - 1)
            extra = TRUNCATED if code & CUT else 0
            while True:
                if code & GOES or now[state] == DELETE + later + after[state]:
                    letters.append("D")
                    break
                if now[state] == INSERT + now[TURN[state]]:
                    letters.append("I")
                    state = int(TURN[state])
                    continue
                kept = int(KEPT[state, code & 3])
                if kept >= 0 and now[state] == extra + later + after[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = int(TURN[state])
                break
            letters.append("D" * (copies - 1))
        states.append(state)
        audits.append("".join(letters))
    return states, audits


def closing(state: int) -> str:
    """Inserts behind the last row."""
    return "I" * (int(END[state]) // INSERT)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without nulls, with the digest of the text that stands for it wherever the text itself is not needed."""
    tidy = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return tidy.withColumn("mark", F.unhex(F.sha2("text", 256)))


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn, without their texts, with their number and code."""
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(left == "", GOES + BLANK).when(~F.substring(left, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    bare = rows.select(*_ORDER, fault.alias("fault"))
    tidy = materialize(bare.groupBy(*_ORDER).agg(F.count("*").alias("copies"), F.first("fault").alias("fault")))
    # A role and text that several turns hold: all but the first turn repeat it.
    order = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    again = tidy.groupBy("conv", "role", "mark").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(F.col("conv").alias("in_conv"), F.col("role").alias("as_role"), F.col("mark").alias("same"), F.col("first.turn").alias("first_turn"))
    met = (tidy["mark"] == again["same"]) & (tidy["role"] == again["as_role"]) & tidy["conv"].eqNullSafe(again["in_conv"])
    joined = tidy.join(again, met, "left")
    repeat = F.col("same").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    initial = F.when(F.length("role") == 0, 0).otherwise(F.instr(F.lit("sua"), F.substring("role", 1, 1)))
    code = initial + F.when(repeat & (F.col("fault") != GOES + BLANK), GOES).otherwise(F.col("fault"))
    return joined.select(*_ORDER, "copies", code.cast("int").alias("code"))


def _blocks(coded: DataFrame) -> DataFrame:
    """One row for each block: its part and number, the key of its first row, codes and copies of its rows, its matrix."""
    kind = coded.schema["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, size, first, codes, runs = 0, FIRST_BLOCK, None, bytearray(), []
        for batch in batches:
            types = [batch.column(c).type for c in _ORDER]
            done = []
            for *key, n, code in zip(*(batch.column(c).to_pylist() for c in (*_ORDER, "copies", "code"))):
                if first is not None and (first[0] != key[0] or len(codes) >= size):
                    done.append((first, block, bytes(codes), runs))
                    size = size + 1 if first[0] == key[0] else FIRST_BLOCK
                    block, first, codes, runs = block + 1, None, bytearray(), []
                first = key if first is None else first
                codes.append(code)
                runs.append(n)
            yield _block_rows(part, done, types)
        if first is not None:
            yield _block_rows(part, [(first, block, bytes(codes), runs)], types)

    return coded.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(cut, _BLOCK.format(kind))


def _block_rows(part: int, blocks: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    keys = {c: pa.array([first[i] for first, _, _, _ in blocks], t) for i, (c, t) in enumerate(zip(_ORDER, types))}
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict(
        {
            "conv": keys["conv"],
            "part": pa.array([part] * len(blocks), pa.int32()),
            "block": pa.array([number for _, number, _, _ in blocks], pa.int64()),
            "turn": keys["turn"],
            "role": keys["role"],
            "mark": keys["mark"],
            "codes": pa.array([codes for _, _, codes, _ in blocks], pa.binary()),
            "runs": pa.array([runs for _, _, _, runs in blocks], longs),
            "matrix": pa.array([block_matrix(codes, tuple(runs)).ravel().tolist() for _, _, codes, runs in blocks], longs),
        }
    )


def _checkpoints(blocks: DataFrame) -> DataFrame:
    """``part, block, ends, start``: cost-to-go by state behind each block, and before it from the first state."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cost = None, END
        for batch in batches:
            ends, starts = [], []
            for conv, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist()):
                if last != (conv,):
                    last, cost = (conv,), END
                ends.append(cost.tolist())
                cost = np.minimum((np.array(matrix).reshape(4, 4) + cost).min(axis=1), FAR)
                starts.append(int(cost[NONE]))
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "block": batch.column("block"), "ends": pa.array(ends, pa.list_(pa.int64())), "start": pa.array(starts, pa.int64())})

    ordered = blocks.select("conv", "part", "block", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    return ordered.mapInArrow(back, "part int, block long, ends array<long>, start long")


def _walked(blocks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Blocks with audit and last state for every first state, and the cost from their start."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walks = [block_walks(c, tuple(r), tuple(e)) for c, r, e in zip(*(batch.column(k).to_pylist() for k in ("codes", "runs", "ends")))]
            same = {k: batch.column(k) for k in same_columns}
            yield pa.RecordBatch.from_pydict(same | {"states": pa.array([w[0] for w in walks], pa.list_(pa.int64())), "audits": pa.array([w[1] for w in walks], pa.list_(pa.string()))})

    met = blocks.drop("matrix").join(checkpoints, ["part", "block"])
    same_columns = [c for c in met.columns if c not in ("part", "block", "ends")]
    met = met.select(*same_columns, "ends")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name != "ends"]
    return met.mapInArrow(walk, ", ".join([*kinds, "states array<long>, audits array<string>"]))


class _Conversation:
    """What the last pass knows of a conversation while its rows go by."""

    def __init__(self, start: int) -> None:
        self.cost, self.state, self.audit = start, NONE, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last_turn = self.last_role = self.last = None
        self.turns, self.hash, self.lines = 0, hashlib.sha256(), 0

    def enter(self, codes: bytes, runs: list[int], states: list[int], audits: list[str]) -> None:
        """A block begins."""
        walk = audits[self.state]
        self.audit.append(walk)
        self.rows, self.walk, self.at = zip(codes, runs), iter(walk), self.state
        self.state = states[self.state]

    def _said(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def _next(self, state: int) -> str:
        return "user" if TURN[state] == USER else "assistant"

    def _insert(self, state: int) -> int:
        self._said(self._next(state), "")
        return int(TURN[state])

    def add(self, turn: int | None, role: str, mark: bytes, text: str) -> None:
        """A row; copies of the row before it were handled with that."""
        if self.last == (turn, role, mark):
            return
        self.last = (turn, role, mark)
        code, copies = next(self.rows)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        first = role[:1]
        if self.last_role is not None:
            self.counts["illegal"] += self.last_role + first not in ("su", "ua", "au")
        self.counts["illegal"] += copies - 1
        self.last_role = first
        if code & BLANK:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies if code & GOES else copies - 1
            self.counts["truncated"] += bool(code & CUT)
        letter = next(self.walk)
        while letter == "I":
            self.at = self._insert(self.at)
            letter = next(self.walk)
        if letter == "K":
            self._said(role, text)
            self.at = int(KEPT[self.at, code & 3])
        elif letter == "R":
            self._said(self._next(self.at), text)
            self.at = int(TURN[self.at])
        for _ in range(copies - 1):
            next(self.walk)

    def row(self) -> dict:
        state, end = self.state, closing(self.state)
        for _ in end:
            state = self._insert(state)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LONGEST)
        return {"gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit) + end, "repaired_sha256": self.hash.hexdigest()}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each ``conv`` of ``conversations``: faults, cheapest cost, audit and hash of the repaired ``rows``."""
    marked = _marked(rows)
    blocks = materialize(_blocks(_coded(marked)))
    kind = blocks.schema["conv"].dataType.simpleString()
    walked = _walked(blocks, _checkpoints(blocks))
    shape = [*_ORDER, "text", "codes", "runs", "start", "states", "audits"]
    none = {"codes": "binary", "runs": "array<long>", "start": "long", "states": "array<long>", "audits": "array<string>"}
    lines = marked.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    # A block goes ahead of its first row, which has the same key and a text.
    stream = lines.select(*shape).union(walked.withColumn("text", F.lit(None).cast("string")).select(*shape))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            values = [state.row() for _, state in done]
            names = [name.split()[0] for name in _RESULT.split(", ")]
            return pa.RecordBatch.from_pydict({"conv": pa.array([c for c, _ in done], conv_type)} | {n: pa.array([v[n] for v in values]) for n in names})

        for batch in batches:
            conv_type, done = batch.column("conv").type, []
            for conv, turn, role, mark, text, codes, runs, start, states, audits in zip(*(batch.column(c).to_pylist() for c in shape)):
                if last != (conv,):
                    if now is not None:
                        done.append((last[0], now))
                    last, now = (conv,), _Conversation(start)
                if text is None:
                    now.enter(codes, runs, states, audits)
                else:
                    now.add(turn, role, mark, text)
            if done:
                yield out(done)
        if now is not None:
            yield out([(last[0], now)])

    ordered = stream.repartition("conv").sortWithinPartitions(*_ORDER, F.col("text").isNotNull())
    found = ordered.mapInArrow(told, f"conv {kind}, {_RESULT}").withColumnRenamed("conv", "in_conv")
    every = conversations.select("conv").distinct()
    whole = every.join(found, every["conv"].eqNullSafe(found["in_conv"]), "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
