"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Rows of a conversation go by turn (nulls first; rows of one turn by role, text and copy). A row's first fault counts: blank
(no `[^\\x20\\x09-\\x0D]`), duplicate (role and text of an earlier row), truncated (its last such character is none of `.!?`). Edits: Keep
costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert an empty user or assistant turn 5; a truncated
row that stays costs 5 more. The initials of the roles must become `(s?(ua)+)?`; of all cheapest edits the audit (their initials) that comes
first in ASCII is taken. From each state (start, after s, u or a) Rerole and Insert lead to one role alone, so the audit tells the whole repair.

Rows are dealt to ranges of conversation and turn and streamed in order, so a conversation of any length is split over tasks.
Whole conversations of one task are bucketed by length and solved there: state costs of all are updated turn by turn, backward, as one NumPy
tensor (turn, conversation, state), kept, and then traced forward, all conversations at once. A conversation that a range or `PIECE`
turns cut becomes pieces: each gives the least costs from each state to each (unit ends as further lanes of the same tensor), one task for
each conversation composes these small matrices from the end, and traces the pieces from all four states, of which one is chosen from the start.
That task holds a byte for each turn and its edit, as does the audit itself; texts stay with their pieces.

Defined cases: a null role or text is one space, and so are null numbers in the name that damage hashes; a null conv_id is a conversation of
its own; a role without a legal initial (empty too) must be reroled or deleted; rows that repeat are duplicates; a conversation without rows after damage
has zeros, an empty audit and the hash of the empty string; an empty table has no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import sized, small_lots, written

#: Turns, and bytes of text, of one piece; turns solved at once.
PIECE, PIECE_BYTES, LOT = 1024, 1 << 20, 1 << 14
#: States: start, after system, after user, after assistant. FORWARD is where Rerole and Insert lead.
START, SYSTEM, USER, ASSISTANT = range(4)
FORWARD = np.array([USER, USER, ASSISTANT, USER])
FAR = 1 << 40
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: Classes of rows: 3 * kind (s, u, a, other) + 0 sound, 1 truncated, 2 must go; PAD stands beyond a conversation's end.
PAD = 12
SAY = np.frombuffer(b"DIKR", np.uint8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of Delete, Keep and Rerole, by class and state."""
    cost, to = np.full((PAD + 1, 3, 4), FAR), np.tile(np.arange(4), (PAD + 1, 3, 1))
    keep = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
    for kind in range(4):
        for what in range(3):
            c = 3 * kind + what
            cost[c, 0] = DELETE
            if what < 2:
                for q, r in keep[kind].items():
                    cost[c, 1, q], to[c, 1, q] = KEEP + 5 * what, r
                cost[c, 2], to[c, 2] = REROLE + 5 * what, FORWARD
    cost[PAD, 0] = 0
    return cost, to


COST, TO = _tables()


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs once turns may be inserted first."""
    for _ in range(2):
        v = np.minimum(v, INSERT + v[:, FORWARD])
    return v


def end_costs(lanes: int) -> np.ndarray:
    """At the end of a conversation start and assistant are legal, the others need insertions."""
    return np.tile(_closed(np.array([[0, FAR, FAR, 0]])), (lanes, 1))


def backward(classes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go before each turn: (turns + 1, lanes, states), for classes (turns, lanes) and the costs (lanes, states) at the end."""
    costs = np.empty((len(classes) + 1, *end.shape), np.int64)
    costs[-1] = end
    lane = np.arange(end.shape[0])[:, None, None]
    for t in range(len(classes) - 1, -1, -1):
        costs[t] = np.minimum(_closed((COST[classes[t]] + costs[t + 1][lane, TO[classes[t]]]).min(axis=1)), FAR)
    return costs


def traced(classes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edits (lanes, 3 * turns + 2; 0 is none) and the state at the end. Of equal costs Delete goes first, then Insert, Keep, Rerole.
    last: the conversation ends here, so what the end lacks is inserted."""
    turns, lanes = classes.shape
    said, lane, state = np.zeros((3 * turns + 2, lanes), np.uint8), np.arange(lanes), state.copy()
    for t in range(turns):
        moving = np.ones(lanes, bool)
        for again in range(3):
            now, cls = costs[t][lane, state], classes[t]
            by = COST[cls, :, state] + costs[t + 1][lane[:, None], TO[cls, :, state]]  # Delete, Keep, Rerole
            inserted = INSERT + costs[t][lane, FORWARD[state]]
            pick = np.where(by[:, 0] == now, 0, np.where(inserted == now, 1, np.where(by[:, 1] == now, 2, 3)))
            pick[cls == PAD] = 0
            insert = moving & (pick == 1)
            done = moving & ~insert
            said[3 * t + again, moving] = SAY[pick[moving]]
            said[3 * t + again, done & (cls == PAD)] = 0
            state = np.where(insert, FORWARD[state], np.where(done, TO[cls, np.choose(pick, [0, 0, 1, 2]), state], state))
            moving = insert
            if not moving.any():
                break
    for again in range(2 if last else 0):
        lacks = (state == SYSTEM) | (state == USER)
        said[3 * turns + again, lacks] = SAY[1]
        state = np.where(lacks, FORWARD[state], state)
    return said.T, state


def solved(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Cost and audit of each conversation's classes; lengths are bucketed by powers of two, so at most half of a tensor is padding."""
    out: list[tuple[int, bytes]] = [(0, b"")] * len(conversations)
    sizes = np.array([len(c) for c in conversations], np.int64)
    bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for b in np.unique(bucket):
        members = np.flatnonzero((bucket == b) & (sizes > 0))
        step = max(1, LOT >> b)
        for at in range(0, len(members), step):
            own = members[at : at + step]
            classes = np.full((sizes[own].max(), len(own)), PAD, np.int64)
            for k, i in enumerate(own.tolist()):
                classes[: sizes[i], k] = conversations[i]
            costs = backward(classes, end_costs(len(own)))
            said, _ = traced(classes, costs, np.zeros(len(own), np.int64), True)
            for k, i in enumerate(own.tolist()):
                out[i] = int(costs[0, k, START]), said[k][said[k] > 0].tobytes()
    return out


def solved_pieces(pieces: list[np.ndarray]) -> tuple[int, list[bytes]]:
    """Cost and audits of one conversation's pieces in order: least-cost matrices from the end, then traces from the start."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    step = max(1, LOT // (4 * max(map(len, pieces))))
    matrices = np.empty((len(pieces), 4, 4), np.int64)  # piece, from, to

    def padded(own: list[np.ndarray], times: int) -> np.ndarray:
        classes = np.full((max(map(len, own)), len(own)), PAD, np.int64)
        for k, p in enumerate(own):
            classes[: len(p), k] = p
        return np.repeat(classes, times, axis=1)

    for at in range(0, len(pieces), step):
        own = pieces[at : at + step]
        costs = backward(padded(own, 4), np.tile(unit, (len(own), 1)))[0]
        matrices[at : at + step] = costs.reshape(len(own), 4, 4).transpose(0, 2, 1)
    ends = np.empty((len(pieces) + 1, 4), np.int64)
    ends[-1] = end_costs(1)[0]
    for k in range(len(pieces) - 1, -1, -1):
        ends[k] = np.minimum((matrices[k] + ends[k + 1]).min(axis=1), FAR)
    audits, state = [], START
    for at in range(0, len(pieces), step):
        own = pieces[at : at + step]
        classes, end = padded(own, 4), np.repeat(ends[at + 1 : at + 1 + len(own)], 4, axis=0)
        said, out = traced(classes, backward(classes, end), np.tile(np.arange(4), len(own)), False)
        for k in range(len(own)):
            row = said[4 * k + state]
            audits.append(row[row > 0].tobytes())
            state = int(out[4 * k + state])
    while state in (SYSTEM, USER):
        audits[-1] += b"I"
        state = int(FORWARD[state])
    return int(ends[0, START]), audits


def repaired_messages(roles: list[str], texts: list[str], audit: bytes, state: int = START) -> tuple[list[str], list[str], int]:
    """Roles and texts after the edits, from a state on, and the state after them."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == ord("D"):
            i += 1
            continue
        kept = edit == ord("K")
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[i][0]] if kept else int(FORWARD[state])
        out_roles.append(roles[i] if kept else {USER: "user", ASSISTANT: "assistant"}[state])
        out_texts.append("" if edit == ord("I") else texts[i])
        i += edit != ord("I")
    return out_roles, out_texts, state


# Damage, order and faults


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy after the damage that crc32 of `conv_id:turn` decides."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    at = F.crc32(name.cast("binary")) % 20
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = F.when(at == 1, "").when(at == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(at == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(at != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(at == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


def as_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of undamaged rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.lit(0).alias("copy"))


def _repeats(rows: DataFrame) -> DataFrame:
    """The rows with `first`: the least turn of an equal row of another turn (null turns are the least), null for most."""
    key = F.md5(F.to_json(F.struct("role", "text"))).alias("said")
    turns = rows.select("conv_id", key, "turn")
    seen = turns.groupBy("conv_id", "said").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("none"))
    seen = seen.filter("low < high or none and high is not null").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.when(~F.col("none"), F.col("low")).alias("first"), F.lit(True).alias("again"))
    both = rows.withColumn("said", key).join(sized(written(seen, "said-again")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    later = F.coalesce("again", F.lit(False)) & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("first") < F.col("turn")))
    return both.select("conv_id", "turn", "role", "text", "copy", later.alias("repeats"))


def _class(role: str, text: str, duplicate: bool) -> tuple[int, int]:
    """The row's class, and its fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    kind = "sua".find(role[0]) if role else -1
    kind = 3 if kind < 0 else kind
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    fault = 1 if not bare else 2 if duplicate else 3 if bare[-1] not in ".!?" else 0
    return 3 * kind + (0, 2, 2, 1)[fault], fault


_STATS = ["n", "blank", "duplicate", "truncated", "illegal", "low", "high", "distinct"]
PIECES = "conv_id long, place long, whole boolean, classes binary, roles array<string>, texts array<string>, first_initial string, last_initial string, first_turn long, last_turn long, " + ", ".join(f"{s} long" for s in _STATS) + ", cost long, audit string"
_TYPES = [
    pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.int64()] * len(_STATS), pa.int64(), pa.string()
]
_NAMES = [x.strip().split(" ")[0] for x in PIECES.split(",")]


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, place: int):
        self.conv, self.place, self.roles, self.texts, self.classes, self.faults, self.turns, self.bytes, self.open = conv, place, [], [], bytearray(), [0] * 4, [], 0, False

    def add(self, turn, role: str, text: str, duplicate: bool) -> None:
        c, fault = _class(role, text, duplicate)
        self.classes.append(c)
        self.faults[fault] += 1
        self.roles.append(role), self.texts.append(text), self.turns.append(turn)
        self.bytes += len(text) + len(role) + 16

    def row(self, cost: int | None, audit: bytes | None, roles: list[str] | None = None, texts: list[str] | None = None) -> tuple:
        initials = [r[:1] for r in self.roles]
        told = [t for t in self.turns if t is not None]
        stats = [len(self.roles), *self.faults[1:], sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])), min(told, default=None), max(told, default=None), len(set(told))]
        whole = cost is not None
        return (self.conv, self.place, whole, None if whole else bytes(self.classes), roles if whole else self.roles, texts if whole else self.texts, initials[0], initials[-1], self.turns[0], self.turns[-1], *stats, cost, audit.decode() if whole else None)


LEGAL = {"su", "ua", "au"}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _streamed(batches: Iterator[pa.RecordBatch], piece_turns: int) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order. The first and the last conversation may go on in other ranges, and long ones are cut: they are sent as pieces."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 32
    whole: list[_Piece] = []
    cut: list[tuple] = []
    now: _Piece | None = None
    first, weight, before = True, 0, None

    def told() -> pa.RecordBatch:
        rows = []
        for piece, (cost, audit) in zip(whole, solved([np.frombuffer(bytes(p.classes), np.uint8) for p in whole]), strict=True):
            roles, texts, _ = repaired_messages(piece.roles, piece.texts, audit)
            rows.append(piece.row(cost, audit, roles, texts))
        whole.clear()
        out = _batch(rows + cut)
        cut.clear()
        return out

    for batch in batches:
        for conv, turn, role, text, copy, repeats in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copy", "repeats")), strict=True):
            fresh = now is None or conv != now.conv
            if fresh or len(now.roles) >= piece_turns or now.bytes >= PIECE_BYTES:
                if now is not None:
                    if fresh and not first and not now.open:
                        whole.append(now)
                    else:
                        now.open = True
                        cut.append(now.row(None, None))
                    weight += now.bytes
                    first = first and not fresh
                    if weight >= PIECE_BYTES:
                        yield told()
                        weight = 0
                place += 1
                later = now is not None and not fresh
                now = _Piece(conv, place)
                now.open = later  # what goes before it was cut off
                before = None if fresh else before
            now.add(turn, role, text, repeats or before == (turn, role, text))
            before = (turn, role, text)
    if now is not None:
        cut.append(now.row(None, None))
    yield told()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of conversation and place; each gets its audit, the first the whole cost, all the state at their beginning."""

    def told(conv, places: list[int], classes: list[bytes]) -> pa.RecordBatch:
        cost, audits = solved_pieces([np.frombuffer(c, np.uint8) for c in classes])
        columns = [pa.array([conv] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array([cost] + [0] * (len(places) - 1), pa.int64()), pa.array([a.decode() for a in audits], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["c", "p", "cost_", "audit_"])

    now, places, classes = None, [], []
    for batch in batches:
        for conv, place, cls in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "classes")), strict=True):
            if places and conv != now:
                yield told(now, places, classes)
                places, classes = [], []
            now = conv
            places.append(place), classes.append(cls)
    if places:
        yield told(now, places, classes)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and their audits, in order: messages after the edits. The state goes from piece to piece."""
    conv, state, any_ = None, START, False
    for batch in batches:
        for row in batch.to_pylist():
            if not any_ or row["conv_id"] != conv:
                conv, state, any_ = row["conv_id"], START, True
            row["roles"], row["texts"], state = repaired_messages(row["roles"], row["texts"], row["audit_"].encode(), state)
            row["cost"], row["audit"], row["classes"] = row["cost_"], row["audit_"], None
            yield _batch([tuple(row[n] for n in _NAMES)])


def repaired(rows: DataFrame, piece_turns: int = PIECE) -> DataFrame:
    """Conversations after repair, as pieces: conv_id, place (pieces of one conversation go in its order), roles and texts (the messages), audit,
    cost (of the whole conversation, at its first piece), whole (one piece is all of it), and the piece's counts before repair.

    rows: conv_id, turn, role, text, copy (`damaged` or `as_rows`).
    """
    small_lots(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    head = lambda c: F.substring(c, 1, 32)
    dealt = _repeats(rows).repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), head("role"), head("text"))
    pieces = written(dealt.sortWithinPartitions(*order).mapInArrow(lambda batches: _streamed(batches, piece_turns), PIECES), "conversation-pieces")
    cut = pieces.filter(~F.col("whole"))
    ends = written(cut.select("conv_id", "place", "classes").repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_composed, "c long, p long, cost_ long, audit_ string"), "audits")
    both = cut.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))).drop("c", "p")
    return pieces.filter("whole").unionByName(both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_edited, PIECES))


def messages(pieces: DataFrame) -> DataFrame:
    """conv_id, place, n_th (within the piece), role and text of every message after repair."""
    each = pieces.select("conv_id", "place", F.posexplode(F.arrays_zip("roles", "texts")).alias("n_th", "m"))
    return each.select("conv_id", "place", "n_th", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, one row out for each conversation; its messages are hashed as they pass."""
    names = [x.strip().split(" ")[0] for x in DIGEST.split(",")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    now = None

    def told(x: dict) -> pa.RecordBatch:
        gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["distinct"]
        values = [x["conv_id"], gaps, x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], "".join(x["audits"]), x["sha"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield told(now)
                now = r | {"audits": [], "sha": hashlib.sha256(), "any": False}
            else:
                for k in ("blank", "duplicate", "truncated", "illegal", "cost", "distinct"):
                    now[k] += r[k]
                now["illegal"] += now["last_initial"] + r["first_initial"] not in LEGAL
                now["distinct"] -= r["first_turn"] is not None and r["first_turn"] == now["last_turn"]
                for k, f in (("low", min), ("high", max)):
                    now[k] = f((x for x in (now[k], r[k]) if x is not None), default=None)
                now["last_initial"], now["last_turn"] = r["last_initial"], r["last_turn"]
            now["audits"].append(r["audit"])
            for role, text in zip(r["roles"], r["texts"], strict=True):
                now["sha"].update((("\n" if now["any"] else "") + f"{role}:{text}").encode())
                now["any"] = True
    if now is not None:
        yield told(now)


def digest(rows: DataFrame, piece_turns: int = PIECE) -> DataFrame:
    """One row for each conv_id of the table: what damage did to it, the cost and audit of its repair, and the repaired text's hash."""
    pieces = written(repaired(damaged(rows), piece_turns), "repaired")
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    whole = pieces.filter("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
    cut = pieces.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_folded, DIGEST)
    all_ = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = all_.join(whole.union(cut), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
