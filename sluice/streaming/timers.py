"""Streams with timers and named states: run deadlines, confirmations that expire, and ledgers that continue.

Deadlines and confirmations are decided in event time: rows wait in state until the watermark has passed them, and are then taken in order of time and
sequence, together with what fell due in between. So the outcome is that of the batch form (`run_outcomes`, `confirmation_outcomes`) whatever the order
and the micro-batches in which rows came, as long as none is later than the watermark allows. State is per run or session and goes when
it ends. The streams need Spark's RocksDB state store: `spark.sql.streaming.stateStore.providerClass` (see `STORE`).

Defined cases: rows with a null key, time or kind, or with another kind, are left out (in streams also those of time 0, where watermarks begin); rows of equal time go by seq (nulls first), then by their other columns.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators import ledger

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Limits of a run in milliseconds by mode, of its steps, and of an unanswered confirmation.
RUN_MS = {"JOURNEY": 240_000, "REHEARSAL": 300_000}
MOST_MS, MOST_STEPS, CONFIRM_MS = 120_000, 40, 300_000

RUN_IN = "run_id string, at_ms long, seq long, kind string, mode string"
RUN_OUT = "run_id string, at_ms long, seq long, kind string, outcome string"
RUN_KINDS = ("START", "STEP", "ASK", "ANSWER", "FINISH")
ASKED_IN = "session_id string, at_ms long, seq long, kind string, request_id string, yes boolean"
ASKED_OUT = "session_id string, at_ms long, request_id string, outcome string, confirmed boolean"
ASKED_KINDS = ("RUN", "REQUEST", "ANSWER")


class Run:
    """One run: its deadline moves by the time that it waited for consent, and stands still while it waits."""

    state = "deadline long, asked long, steps int, ended boolean"
    kinds = RUN_KINDS

    def __init__(self, saved: tuple | None = None) -> None:
        self.deadline, self.asked, self.steps, self.ended = saved or (None, None, 0, False)

    def saved(self) -> tuple:
        return self.deadline, self.asked, self.steps, self.ended

    def due(self) -> int | None:
        """When it expires, if nothing happens before."""
        return None if self.ended or self.deadline is None or self.asked is not None else self.deadline

    def expire(self, key: str) -> list[tuple]:
        self.ended = True
        return [(key, self.deadline, None, "TIMER", "DEADLINE")]

    def take(self, key: str, at: int, seq: int | None, kind: str, mode: str | None) -> list[tuple]:
        told = lambda outcome: [(key, at, seq, kind, outcome)]
        if kind == "START":
            if self.deadline is not None and not self.ended:
                return told("RUNNING")
            self.deadline, self.asked, self.steps, self.ended = at + RUN_MS.get(mode or "", MOST_MS), None, 0, False
            return told("STARTED")
        if self.deadline is None:
            return told("UNKNOWN")
        if self.ended:
            return told("ENDED")
        if kind == "ASK":
            self.asked = at if self.asked is None else self.asked
            return told("WAITING")
        if kind == "ANSWER":
            if self.asked is not None:
                self.deadline, self.asked = self.deadline + at - self.asked, None
            return told("ANSWERED")
        if kind == "FINISH":
            self.ended = True
            return told("FINISHED")
        self.steps += 1
        if self.steps > MOST_STEPS:
            self.ended = True
            return told("STEP_LIMIT")
        return told("RUN")


class Asked:
    """The requests of one session: an answer counts if the session has not begun another run since, and if it comes in time. The first answer counts."""

    state = "generation int, pending string"
    kinds = ASKED_KINDS

    def __init__(self, saved: tuple | None = None) -> None:
        self.generation, pending = saved or (0, "{}")
        self.pending: dict[str, tuple[int, int]] = {k: tuple(v) for k, v in json.loads(pending).items()}
        self.heap = [(expires, request) for request, (_, expires) in self.pending.items()]
        heapq.heapify(self.heap)

    def saved(self) -> tuple:
        return self.generation, json.dumps(self.pending)

    def due(self) -> int | None:
        while self.heap and self.pending.get(self.heap[0][1], (0, -1))[1] != self.heap[0][0]:
            heapq.heappop(self.heap)  # answered
        return self.heap[0][0] if self.heap else None

    def expire(self, key: str) -> list[tuple]:
        expires, request = heapq.heappop(self.heap)
        del self.pending[request]
        return [(key, expires, request, "EXPIRED", False)]

    def take(self, key: str, at: int, seq: int | None, kind: str, request: str | None, yes: bool | None) -> list[tuple]:
        if kind == "RUN":
            self.generation += 1
        elif request is None:
            return []
        elif kind == "REQUEST":
            if request not in self.pending:
                self.pending[request] = (self.generation, at + CONFIRM_MS)
                heapq.heappush(self.heap, (at + CONFIRM_MS, request))
        elif request not in self.pending:
            return [(key, at, request, "UNKNOWN", False)]
        else:
            generation, _ = self.pending.pop(request)
            outcome = "STALE" if generation != self.generation else "CONFIRMED" if yes else "DENIED"
            return [(key, at, request, outcome, outcome == "CONFIRMED")]
        return []


def _ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def folded(machine: Run | Asked, key: str, rows: list[tuple], until: int) -> Iterator[tuple]:
    """What rows (at, seq, kind, ...), in order, and the timers up to a time make of a machine. A timer goes before a row of the same time."""
    for row in rows:
        while (due := machine.due()) is not None and due <= row[0]:
            yield from machine.expire(key)
        yield from machine.take(key, *row)
    while (due := machine.due()) is not None and due <= until:
        yield from machine.expire(key)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class InOrder(StatefulProcessor):
    """Rows wait in `held` until the watermark has passed them; `machine` keeps what they made so far."""

    def __init__(self, machine: type, schema_in: str, schema_out: str) -> None:
        self.machine, self.schema_in, self.names, self.out = machine, schema_in, _names(schema_in), _names(schema_out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(self.schema_in.split(", ")[1:]))
        self.saved = handle.getValueState("machine", self.machine.state)

    def _rows(self, values: Iterator[tuple]) -> Iterator[Row]:
        for v in values:
            yield Row(**dict(zip(self.out, v, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        times = set()
        for row in rows:
            self.held.appendValue(tuple(row[n] for n in self.names[1:]))
            times.add(row["at_ms"])
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ripe = _ordered([r for r in held if r[0] <= now])
        machine = self.machine(tuple(self.saved.get()) if self.saved.exists() else None)
        out = list(folded(machine, key[0], ripe, now))
        if ripe:
            rest = [r for r in held if r[0] > now]
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        self.saved.update(machine.saved())
        if (due := machine.due()) is not None:
            self.handle.registerTimer(due)
        return self._rows(iter(out))

    def close(self) -> None:
        pass


def _typed(events: DataFrame, schema: str, kinds: tuple[str, ...]) -> DataFrame:
    key = _names(schema)[0]
    typed = events.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])
    return typed.filter(F.col(key).isNotNull() & F.col("at_ms").isNotNull() & F.col("kind").isin(*kinds))


def _streamed(events: DataFrame, machine: type, schema_in: str, schema_out: str, late: str) -> DataFrame:
    rows = _typed(events, schema_in, machine.kinds).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return rows.groupBy(_names(schema_in)[0]).transformWithState(InOrder(machine, schema_in, schema_out), schema_out, "Append", "EventTime")


def _batch(events: DataFrame, machine: type, schema_in: str, schema_out: str, until: Column | None) -> DataFrame:
    """Keys are streamed in order through their partition; of each only its machine is held."""
    import pyarrow as pa

    names, out_names = _names(schema_in), _names(schema_out)
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema_out.split(", ")]
    end = F.lit(1 << 62) if until is None else until

    def run(parts):
        key, now, stop = None, None, 0

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], out_names)

        for part in parts:
            rows: list[tuple] = []
            for own, *row, last in zip(*(part.column(n).to_pylist() for n in (*names, "until_")), strict=True):
                if own != key:
                    if now is not None:
                        rows += folded(now, key, [], stop)
                    key, now, stop = own, machine(), last
                if row[0] <= stop:
                    rows += folded(now, own, [tuple(row)], row[0] - 1)
            yield told(rows)
        if now is not None:
            yield told(list(folded(now, key, [], stop)))

    typed = _typed(events, schema_in, machine.kinds).withColumn("until_", end.cast("long"))
    return typed.repartition(names[0]).sortWithinPartitions(*[F.col(n).asc_nulls_first() for n in names]).mapInArrow(run, schema_out)


def run_deadlines(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of runs' events (RUN_IN; kinds START, STEP, ASK, ANSWER, FINISH) as RUN_OUT: each event with its outcome, and a TIMER row at the
    deadline of a run that was not waiting for consent then. A run has RUN_MS by its mode from its START, and the time between ASK and ANSWER besides."""
    return _streamed(events, Run, RUN_IN, RUN_OUT, late)


def run_outcomes(events: DataFrame, until: Column | None = None) -> DataFrame:
    """The same of recorded events, as if the watermark had come to `until` (null: the end of time)."""
    return _batch(events, Run, RUN_IN, RUN_OUT, until)


def confirmations(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of requests and answers (ASKED_IN; kinds RUN, REQUEST, ANSWER) as ASKED_OUT: CONFIRMED or DENIED, STALE if the session began another run
    since the request, EXPIRED after CONFIRM_MS, UNKNOWN for an answer to nothing."""
    return _streamed(events, Asked, ASKED_IN, ASKED_OUT, late)


def confirmation_outcomes(events: DataFrame, until: Column | None = None) -> DataFrame:
    """The same of recorded events."""
    return _batch(events, Asked, ASKED_IN, ASKED_OUT, until)


# Ledgers

LEDGER_IN = "session string, seq long, at long, event string, action string, action_commitment string"
LEDGER_OUT = "session string, index long, at long, event string, action string, action_commitment string, previous string, hash string"


class Chain(StatefulProcessor):
    """The head of each session's ledger (index, hash, last seq) from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "index long, hash string, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        index, last, seq = tuple(self.head.get()) if self.head.exists() else (-1, ledger.ZEROS, None)
        out = []
        for r in sorted(rows, key=lambda r: r["seq"]):
            if seq is not None and r["seq"] <= seq:
                continue  # told before
            index, seq, before = index + 1, r["seq"], last
            last = ledger.block_hash(r["session"], index, r["at"], r["event"], r["action"], r["action_commitment"], before)
            out.append(Row(session=r["session"], index=index, at=r["at"], event=r["event"], action=r["action"], action_commitment=r["action_commitment"], previous=before, hash=last))
        if out:
            self.head.update((index, last, seq))
        return iter(out)

    def close(self) -> None:
        pass


def ledger_blocks(events: DataFrame) -> DataFrame:
    """A stream of ledger events (LEDGER_IN; seq: the order within a session) as blocks that continue each session's chain over micro-batches. Events that are not
    safe metadata (`ledger.is_safe`) or have no session or seq are left out; an event whose seq was told before adds nothing, so neither does a batch that comes again."""
    typed = events.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in LEDGER_IN.split(", "))]).filter(F.col("session").isNotNull() & F.col("seq").isNotNull() & ledger.is_safe())
    return typed.groupBy("session").transformWithState(Chain(), LEDGER_OUT, "Append", "None")
