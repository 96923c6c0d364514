"""Hash-chained audit logs: append, verify, and recompute the hashes of an edited copy.

A block has session, index, at (epoch ms), event, action, action_commitment, previous and hash; hash is the SHA-256 of the
JSON of the others in this order, nulls kept. The first block's previous is 64 zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
ZEROS = "0" * 64
BODY = ("session", "index", "at", "event", "action", "action_commitment")


def digest(block: dict[str, Column], previous: Column) -> Column:
    names = {"action_commitment": "actionCommitment"}
    body = F.struct(*[block[k].alias(names.get(k, k)) for k in BODY], previous.alias("previous"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def inspect(blocks: DataFrame) -> DataFrame:
    """session, n_blocks, valid, first_bad (place) and its check: INDEX, LINK or HASH."""
    w = Window.partitionBy("session").orderBy("index", "at", "hash")
    place = F.row_number().over(w) - 1
    check = (
        F.when(c("index") != place, "INDEX").when(~c("previous").eqNullSafe(F.coalesce(F.lag("hash").over(w), F.lit(ZEROS))), "LINK")
        .when(~c("hash").eqNullSafe(digest({k: c(k) for k in BODY}, c("previous"))), "HASH")
    )
    rows = blocks.withColumn("place_", place.cast("long")).withColumn("check_", check)
    bad = c("check_").isNotNull()
    return rows.groupBy("session").agg(
        F.count("*").alias("n_blocks"), (F.count_if(bad) == 0).alias("valid"), F.min(F.when(bad, c("place_"))).alias("first_bad"), F.min_by("check_", F.when(bad, c("place_"))).alias("check")
    )


def rehash(blocks: DataFrame, begin: Column | None = None) -> DataFrame:
    """The blocks with previous and hash computed anew, in order, from zeros or the hash `begin`. Each hash needs the one before, so sessions are streamed
    in order through their partition, of which only the last hash is held."""
    import hashlib

    body = F.to_json(F.struct(*[c(k).cast("long" if k in ("index", "at") else "string").alias({"action_commitment": "actionCommitment"}.get(k, k)) for k in BODY]), {"ignoreNullFields": "false"})
    rows = blocks.select(*[c(k).cast("long" if k in ("index", "at") else "string").alias(k) for k in BODY], body.alias("body"), F.coalesce(F.lit(None).cast("string") if begin is None else begin, F.lit(ZEROS)).alias("begin_"))

    def run(parts):
        import pyarrow as pa

        session, last = None, ZEROS
        for part in parts:
            before, hashes = [], []
            for own, text, begins in zip(*(part.column(k).to_pylist() for k in ("session", "body", "begin_")), strict=True):
                if own != session:
                    session, last = own, begins
                before.append(last)
                last = hashlib.sha256(f'{text[:-1]},"previous":"{last}"}}'.encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in BODY], pa.array(before, pa.string()), pa.array(hashes, pa.string())], [*BODY, "previous", "hash"])

    ordered = rows.repartition("session").sortWithinPartitions("session", *BODY[1:])
    return ordered.mapInArrow(run, "session string, index long, at long, event string, action string, action_commitment string, previous string, hash string")


# What a ledger may hold. Task texts, handles, field values and addresses are none of them.
EVENTS = ("RUN_STARTED", "APPROVAL_REQUESTED", "DENIED", "AUTHORIZED", "EXECUTED", "BLOCKED", "STOPPED", "VAULT_CLEARED")
ACTIONS = ("NONE", "CLICK", "TYPE_HANDLE", "SELECT", "SCROLL", "ASK_USER", "FINISH")


def is_safe() -> Column:
    """Whether event and action are of the lists, and the commitment is null or a SHA-256 in lowercase hex."""
    return F.coalesce(c("event").isin(*EVENTS) & c("action").isin(*ACTIONS) & (c("action_commitment").isNull() | c("action_commitment").rlike("^[a-f0-9]{64}\\z")), F.lit(False))


def block_hash(session: str, index: int, at: int, event: str, action: str, commitment: str | None, previous: str) -> str:
    """The hash of one block, as `digest` has it."""
    import hashlib
    import json

    body = {"session": session, "index": index, "at": at, "event": event, "action": action, "actionCommitment": commitment, "previous": previous}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def append(events: DataFrame, heads: DataFrame | None = None, checked: bool = False) -> DataFrame:
    """Blocks of events (session, at, event, action, action_commitment, seq as total order in a session). heads (`ledger_heads`): sessions that
    have them go on after their last block; events up to its seq, if it has one, are left out as told before. checked: an event that is not safe metadata is an error."""
    if checked:
        events = events.withColumn("event", F.when(is_safe(), c("event")).otherwise(F.raise_error(F.lit("UNSAFE_LEDGER_METADATA"))))
    rows = events
    if heads is not None:
        known = heads.select(c("session").alias("s_"), c("index").alias("index_"), c("hash").alias("last_"), c("seq").alias("seq_"))
        rows = events.join(known, c("session") == c("s_"), "left").filter("seq_ is null or seq > seq_")
    begin = F.coalesce(c("index_"), F.lit(-1)) if heads is not None else F.lit(-1)
    index = (F.row_number().over(Window.partitionBy("session").orderBy("seq")) + begin).cast("long")
    return rehash(rows.withColumn("index", index), c("last_") if heads is not None else None)


def ledger_heads(blocks: DataFrame, seq: str | None = None) -> DataFrame:
    """session, index, hash and seq (null without such a column) of each session's last block."""
    last = F.max_by(F.struct("index", "hash", (c(seq) if seq else F.lit(None)).cast("long").alias("seq")), "index").alias("b")
    return blocks.groupBy("session").agg(last).select("session", "b.*")
