"""Sessions: the state machine of requests, its fold over ordered events, and the latest state.

Events: session_id, seq, kind (START, STEP, VERIFY), snapshot_id, action_id (planned by START and STEP, verified by
VERIFY), plan (ACT, FINISH, BLOCKED), success. A START opens a session; a STEP counts only in OBSERVE with a new snapshot; a
VERIFY only in EXECUTE for the pending action. Status: 200 accepted, 404 unknown session, 409 conflict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ("state", "snapshot_id", "pending")
NEW = ("NONE", None, None)
OUT = "session_id string, seq long, kind string, status int, state string, pending_action_id string"
MOST_STEPS = 40


def _text(x) -> str | None:
    return None if x is None or x != x else str(x)


def advance(now: tuple, kind: str, snapshot: str | None, action: str | None, plan: str | None, success: bool | None) -> tuple[tuple, int]:
    """The next (state, snapshot, pending action) and the status of one request."""
    state, last, pending = now
    planned = {"FINISH": ("COMPLETE", None), "BLOCKED": ("FAILED", None)}.get(plan, ("EXECUTE", action))
    if kind == "START":
        return ((planned[0], snapshot, planned[1]), 200) if state == "NONE" else (now, 409)
    if state == "NONE":
        return now, 404
    if kind == "STEP":
        return ((planned[0], snapshot, planned[1]), 200) if state == "OBSERVE" and snapshot != last else (now, 409)
    if state != "EXECUTE" or action != pending:
        return now, 409
    return (("OBSERVE" if success else "FAILED"), last, None), 200


def replay(now: tuple, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    rows = []
    for e in events.sort_values("seq", kind="stable").itertuples(index=False):
        now, status = advance(now, e.kind, _text(e.snapshot_id), _text(e.action_id), _text(e.plan), bool(e.success) if e.success == e.success and e.success is not None else None)
        rows.append((e.session_id, int(e.seq), e.kind, status, now[0], now[2]))
    return now, rows


COLUMNS = [x.split()[0] for x in OUT.split(", ")]


def outcomes(events: DataFrame) -> DataFrame:
    """Status and state after each event, sessions streamed in order of seq through their partition, of which only the last
    state is held."""
    names = ("session_id", "seq", "kind", "snapshot_id", "action_id", "plan", "success")

    def run(parts):
        import pyarrow as pa

        session, now = None, NEW
        for part in parts:
            rows = []
            for own, seq, kind, snapshot, action, plan, success in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                if own != session:
                    session, now = own, NEW
                now, status = advance(now, kind, snapshot, action, plan, success)
                rows.append((own, seq, kind, status, now[0], now[2]))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], COLUMNS)

    typed = events.select(*[F.col(n).cast("long" if n == "seq" else "boolean" if n == "success" else "string").alias(n) for n in names])
    return typed.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, OUT)


def streamed(events: DataFrame, most_steps: int = MOST_STEPS, most_ms: int | None = None) -> DataFrame:
    """The same over a stream; the state of each session is kept between triggers. A session beyond `most_steps` accepted steps fails, with a row of
    kind LIMIT (status 429). One without an event for `most_ms` fails with a row of kind TIMEOUT (408), and its state goes; such a stream
    needs a trigger that goes on, as timers ask for another batch each time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], -1, "TIMEOUT", 408, "FAILED", None)], columns=COLUMNS)
            return
        *now, steps = state.get if state.exists else (*NEW, 0)
        now, rows = replay(tuple(now), pd.concat(list(parts)))
        steps += sum(r[2] in ("START", "STEP") and r[3] == 200 for r in rows)
        if steps > most_steps and now[0] in ("OBSERVE", "EXECUTE"):
            now = ("FAILED", now[1], None)
            rows.append((key[0], rows[-1][1], "LIMIT", 429, "FAILED", None))
        state.update((*now, steps))
        if most_ms is not None:
            state.setTimeoutDuration(most_ms)
        yield pd.DataFrame(rows, columns=COLUMNS)

    return events.groupBy("session_id").applyInPandasWithState(run, OUT, "state string, snapshot_id string, pending string, steps long", "append", GroupStateTimeout.NoTimeout if most_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(events: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """The value of each group's last event."""
    return events.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def record(events: DataFrame, path: str) -> None:
    """Append events to a log, a session and its first action in one write."""
    events.write.mode("append").parquet(path)


def recorded(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends each micro-batch of events once, told by its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookup(events: DataFrame, session_id: str) -> DataFrame:
    """The state of one session: session_id, state and pending_action_id after its last event; no row if it is unknown."""
    return outcomes(events.filter(F.col("session_id") == session_id)).groupBy("session_id").agg(F.max_by(F.struct("state", "pending_action_id"), "seq").alias("s")).select("session_id", "s.*")
