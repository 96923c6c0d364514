"""Guards: outbound payloads, endpoints, staleness, grounding of actions, fill gates, finish claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.patterns import BLOCKED_FINISH, EDGE, FORBIDDEN_PROPERTY, OBVIOUS_SECRETS, SECRET_HINTS
from sluice.functions.text import escaped

c = F.col


def has_obvious_secret(text: Column) -> Column:
    """E-mail, tax id, payment address, phone, card shape (no checksum) or credential assignment."""
    found = F.lit(False)
    for hint, p in zip(SECRET_HINTS, OBVIOUS_SECRETS, strict=True):  # the cheap test first, as in the detectors
        found = found | ((text.contains("@") if hint == "@" else text.rlike(hint)) & text.rlike(p))
    return F.coalesce(found, F.lit(False))


def payload_status(payload: Column, human_text: Column, most_bytes: int = 2_500_000) -> Column:
    """413 for a payload that is too large, 422 for one with an obvious secret, else 200."""
    return F.when(F.octet_length(payload) > most_bytes, 413).when(has_obvious_secret(human_text), 422).otherwise(200)


def forbidden_properties(json: Column) -> Column:
    """Forbidden keys of a JSON text, distinct and sorted: at any depth, as they read once unescaped, but for the entries of a privacy_summary (an
    object, or objects in arrays of it); what lies deeper in it is looked at again. A text that is not JSON is searched for strings before a colon.
    Only texts in which the shape of a key, or an escape, occurs are parsed."""
    maybe = F.when(json.rlike(FORBIDDEN_PROPERTY) | json.contains("\\u"), json)
    return F.coalesce(_forbidden_keys()(maybe), F.array().cast("array<string>"))


def forbidden_keys(text: str) -> list[str]:
    """The same of one text."""
    import json
    import re

    bad = re.compile(FORBIDDEN_PROPERTY)
    found: set[str] = set()
    try:
        # Nodes with the key that they stand under; an array's members stand under its own.
        todo = [(json.loads(text), None)]
    except (ValueError, RecursionError):
        strings = (m[0] for m in re.finditer(r'"(?:[^"\\]|\\.)*"(?:\s*:)?', text))
        return sorted({k for k in (s.rstrip(": \t\r\n")[1:-1] for s in strings if s.endswith(":")) if bad.search(k)})
    while todo:
        node, under = todo.pop()
        if isinstance(node, list):
            todo += [(x, under) for x in node]
        elif isinstance(node, dict):
            if under != "privacy_summary":
                found.update(k for k in node if bad.search(k))
            todo += [(v, k) for k, v in node.items()]
    return sorted(found)


def _forbidden_keys():
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else forbidden_keys(t))

    return run


def outbound(payloads: DataFrame, payload: str, human: str, secrets: DataFrame | None = None, key: str = "n", most_bytes: int = 2_500_000) -> DataFrame:
    """The one assertion before anything leaves: status and reason, first failing check first. 413 TOO_LARGE; 422 KNOWN_SECRET (of the
    session's own), SECRET (an obvious shape in human text), FORBIDDEN_KEY; else 200. A null payload counts as empty."""
    rows = payloads.withColumn("known_", F.lit(False))
    if secrets is not None:
        hit = leaks(payloads.select(key, c(payload).alias("payload")), secrets, key).select(key, F.lit(True).alias("hit_")).distinct()
        rows = rows.join(hit, key, "left").withColumn("known_", F.coalesce("hit_", F.lit(False))).drop("hit_")
    forbidden = F.size(forbidden_properties(F.coalesce(payload, F.lit("")))) > 0
    reason = F.when(F.octet_length(payload) > most_bytes, "TOO_LARGE").when(c("known_"), "KNOWN_SECRET").when(has_obvious_secret(c(human)), "SECRET").when(forbidden, "FORBIDDEN_KEY")
    rows = rows.withColumn("reason", reason).drop("known_")
    return rows.withColumn("status", F.when(c("reason").isNull(), 200).when(c("reason") == "TOO_LARGE", 413).otherwise(422))


# Secrets of so many bytes or more are found by grams of q bytes, of which the one of least hash among the first w signs a secret, and the least of
# every w in a row are looked up for a payload. Shorter secrets are looked up whole, as grams of their own length.
SIGNATURES = ((32, 8, 25), (16, 8, 9), (8, 4, 5))
#: Payloads are looked at together up to about so many bytes.
LOOK_BYTES = 1 << 20


def _grams(text: bytes, q: int):
    """Every q bytes in a row as a number, up to q = 8."""
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    n = len(data) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(q if n > 0 else 0):
        out |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


def _spread(grams):
    """A bijection of 64-bit numbers, so that the least is any of them alike."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = grams * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _anchors(data: bytes, ends, owner, q: int, w: int):
    """Grams of payloads laid end to end, and the places of the first minimum of all w in a row of one payload; with w = 1, one place of each gram in it."""
    import numpy as np

    x = _spread(_grams(data, q))
    n = len(x) - w + 1
    if n <= 0:
        return x, np.zeros(0, np.int64)
    whole = np.flatnonzero(np.arange(n) <= (ends - (q + w - 1))[owner[:n]])  # windows that end in their own payload
    if w > 1:
        return x, np.unique((np.lib.stride_tricks.sliding_window_view(x, w).argmin(axis=1) + np.arange(n))[whole])
    at = whole[np.lexsort((x[whole], owner[whole]))]
    first = np.ones(len(at), bool)
    first[1:] = (x[at[1:]] != x[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    return x, at[first]


def _level(size: int) -> tuple[int, int, int]:
    """The class (its number, q, w) of a secret of so many bytes."""
    for k, (least, q, w) in enumerate(SIGNATURES):
        if size >= least:
            return k, q, w
    return len(SIGNATURES) + size, size, 1


def leaks(payloads: DataFrame, secrets: DataFrame, key: str = "payload_id") -> DataFrame:
    """The payload ids and the hash of each known secret found in them (payloads: key, payload; secrets: secret), in one pass over the payloads, whatever the number of secrets.

    Both sides are rows of (class, signature): of the secrets those that differ, with the place of the gram in the secret and the secret's size, of a payload those that
    a secret of a class present could have, with their place in it. What meets tells where a secret of that size would lie, and the bytes there are joined to the secrets:
    secrets that begin alike meet a payload once for each size and place, not once each. Only the numbers of the classes present (eleven at most) reach the driver.
    Null payloads and empty secrets find nothing; repeated secrets count once; rows with equal keys, or none, are told apart by their text.
    """
    known = secrets.select(c("secret").cast("string").alias("secret")).filter(F.length("secret") > 0).distinct()
    rows = payloads.select(key, c("payload").cast("string").alias("payload")).filter("payload is not null").withColumn("text_hash", F.xxhash64("payload"))
    places = possible_places(rows, known, key)
    both = rows.join(places, c(key).eqNullSafe(c("key_")) & (c("text_hash") == c("hash_")))
    found = both.select(key, F.substring(c("payload").cast("binary"), c("begin") + 1, c("size")).alias("bytes")).distinct()
    return found.join(known.select(c("secret").cast("binary").alias("bytes")), "bytes").select(key, F.sha2("bytes", 256).alias("secret_sha256")).distinct()


def possible_places(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key_, hash_, begin and size (bytes) of the places of each payload (key, text_hash, payload) where a secret (known: secret) of that size may lie."""
    import pyarrow as pa

    field = rows.schema[key].dataType.simpleString()

    def sign(parts):
        import numpy as np

        for part in parts:
            told = []
            for t in part.column("secret").to_pylist():
                raw = t.encode()
                level, q, w = _level(len(raw))
                x = _spread(_grams(raw, q))[:w]
                at = int(x.argmin())
                told.append((level, int(x[at].astype(np.int64)), at, len(raw)))
            columns = zip(*told, strict=True) if told else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["level", "signature", "anchor", "size"])

    own = known.mapInArrow(sign, "level int, signature long, anchor int, size int").distinct()
    size = F.octet_length("secret")
    level = F.lit(None).cast("int")
    for k, (least, _, _) in reversed(list(enumerate(SIGNATURES))):
        level = F.when(size >= least, k).otherwise(level)
    present = sorted(r[0] for r in known.select(F.coalesce(level, size + len(SIGNATURES)).alias("k")).distinct().collect())

    def look(parts):
        import numpy as np

        for part in parts:
            raws = [t.encode() for t in part.column("payload").to_pylist()]
            lots = np.cumsum([len(r) for r in raws]) // LOOK_BYTES
            for lot in np.unique(lots):
                mine = np.flatnonzero(lots == lot)
                sizes = np.array([len(raws[i]) for i in mine])
                data, ends, owner = b"".join(raws[i] for i in mine), np.cumsum(sizes), np.repeat(np.arange(len(mine)), sizes)
                for k in present:
                    x, at = _anchors(data, ends, owner, *(SIGNATURES[k][1:] if k < len(SIGNATURES) else (k - len(SIGNATURES), 1)))
                    of = owner[at]
                    n = pa.array(mine[of])
                    own_at = (at - (ends - sizes)[of]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(key).take(n), part.column("text_hash").take(n), pa.array(np.full(len(at), k, np.int32)), pa.array(x[at].view(np.int64)), pa.array(own_at)], [key, "text_hash", "level", "signature", "at"])

    seen = rows.select(key, "text_hash", "payload").mapInArrow(look, f"{key} {field}, text_hash long, level int, signature long, at int")
    return seen.join(own, ["level", "signature"]).select(c(key).alias("key_"), c("text_hash").alias("hash_"), (c("at") - c("anchor")).alias("begin"), "size").filter("begin >= 0").distinct()


def endpoint_allowed(url: Column) -> Column:
    """HTTPS, or the local host."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") | host.isin("127.0.0.1", "localhost"), F.lit(False))


def blocked_finish(reason: Column, summary: Column) -> Column:
    return F.concat_ws("\n", reason, summary).rlike(BLOCKED_FINISH)


_NEGATION = rf"(?i){EDGE}(?:do\s+not|don't|never)\s+(?:click\s+|press\s+)?(?:the\s+)?"


def button_prohibited(task: Column, name: Column) -> Column:
    """Whether a task forbids a button, by its name or by the intent that its name holds."""
    text = F.regexp_replace(F.lower(task), "-", " ")
    label = F.trim(F.lower(name))
    named = F.regexp_like(text, F.concat(F.lit(_NEGATION + '["\'“]?'), escaped(label), F.lit("(?![A-Za-z0-9_])")))
    intent = (
        F.when(label.contains("submit"), text.rlike(_NEGATION + f"submit{EDGE}"))
        .when(label.contains("place order"), text.rlike(_NEGATION + rf"(?:place\s+(?:the\s+)?order|order){EDGE}"))
        .when(label.contains("continue"), text.rlike(_NEGATION + f"continue{EDGE}")).otherwise(F.lit(False))
    )
    return F.coalesce(named | intent, F.lit(False))


def pending_button(elements: DataFrame, tasks: DataFrame) -> DataFrame:
    """snapshot_id and whether an enabled button that the task asks for, and does not forbid, is still there."""
    rows = elements.filter(c("enabled") & (c("role") == "button")).join(tasks.select("snapshot_id", "task"), "snapshot_id")
    name = F.concat_ws(" ", "text", "label")
    click = lambda n: F.concat(F.lit(r'(?:click|press)\s+(?:the\s+)?["\'“]?'), escaped(F.trim(n)), F.lit("(?![A-Za-z0-9_])"))
    named = F.lit(False)
    for part in ("text", "label"):
        target = click(c(part))
        asks = F.regexp_like("task", F.concat(F.lit(f"(?i){EDGE}"), target)) & ~F.regexp_like("task", F.concat(F.lit(rf"(?i){EDGE}(?:do\s+not|don't|never)\s+"), target))
        named = named | ((F.length(F.trim(part)) > 0) & asks)
    intent = F.lit(False)
    for task, negative, button in (("continue", "continue", "continue"), (r"place\s+(?:the\s+)?order", r"(?:place\s+(?:the\s+)?order|order)", r"place\s+order"), ("submit", "submit", "submit")):
        intent = intent | (c("task").rlike(f"(?i){EDGE}{task}{EDGE}") & ~c("task").rlike(_NEGATION + negative + EDGE) & name.rlike(f"(?i){EDGE}{button}{EDGE}"))
    found = rows.groupBy("snapshot_id").agg(F.bool_or(F.coalesce(named | intent, F.lit(False))).alias("pending"))
    return tasks.select("snapshot_id").join(found, "snapshot_id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


#: The action types and the columns each needs.
ACTION_FIELDS = {
    "CLICK": ("element_id",), "TYPE_HANDLE": ("element_id", "handle"), "SELECT": ("element_id", "option"), "SCROLL": ("direction", "amount"), "ASK_USER": ("question",), "FINISH": ("summary",),
}


def action_valid() -> Column:
    """Whether an action row has the columns of its type, well-formed ids, and none of another type's."""
    owned = {f for fields in ACTION_FIELDS.values() for f in fields}
    ok = F.lit(False)
    for kind, fields in ACTION_FIELDS.items():
        one = c("type") == kind
        for f in sorted(owned):
            one = one & (c(f).isNotNull() if f in fields else c(f).isNull())
        ok = ok | one
    element = c("element_id").isNull() | c("element_id").rlike("^el_[A-Za-z0-9_-]+$")
    handle = c("handle").isNull() | c("handle").rlike("^LOCAL_[A-Z0-9_]+$")
    scroll = c("direction").isNull() | (c("direction").isin("UP", "DOWN") & c("amount").between(1, 5000))
    return F.coalesce(ok & c("action_id").rlike("^act_") & c("snapshot_id").rlike("^snap_") & element & handle & scroll, F.lit(False))


def grounding(actions: DataFrame, contexts: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds error: why an action does not stand on its snapshot, null if it does. contexts: snapshot_id of the session's latest
    context; elements of that context."""
    e = elements.select(
        c("snapshot_id").alias("e_snapshot"), c("id").alias("e_id"), c("enabled").alias("e_enabled"), c("value_handle").alias("e_handle"), c("options").alias("e_options"), c("selected_option").alias("e_selected")
    )
    rows = actions.join(contexts.select(c("session_id"), c("snapshot_id").alias("latest")), "session_id", "left").join(e, (c("e_snapshot") == c("snapshot_id")) & (c("e_id") == c("element_id")), "left")
    grounded = c("type").isin("CLICK", "TYPE_HANDLE", "SELECT")
    error = (
        F.when(~c("snapshot_id").eqNullSafe(c("latest")), "STALE_SNAPSHOT")
        .when(grounded & (c("e_id").isNull() | ~c("e_enabled")), "UNAVAILABLE_ELEMENT")
        .when((c("type") == "TYPE_HANDLE") & ~c("handle").eqNullSafe(c("e_handle")), "UNAVAILABLE_HANDLE")
        .when((c("type") == "SELECT") & ~F.coalesce(F.array_contains("e_options", c("option")), F.lit(False)), "UNAVAILABLE_OPTION")
        .when((c("type") == "SELECT") & c("option").eqNullSafe(c("e_selected")), "REPEATED_OPTION")
    )
    return rows.withColumn("error", error).drop("latest", "e_snapshot", "e_id", "e_enabled", "e_handle", "e_options", "e_selected")


def fill_gate() -> Column:
    """Outcome of a private fill, first failing check first; null where the one-use grant may be given. Columns: valid, type,
    is_current, document_id, context_origin, local_origin, action_snapshot, local_snapshot, context_snapshot,
    enabled, visible, value_handle, handle, tag, role, input_type, confirmed, preflight_error, still_current."""
    stale = ~c("is_current") | (F.length("document_id") == 0) | (c("context_origin") != c("local_origin")) | (c("action_snapshot") != c("local_snapshot")) | (c("context_snapshot") != c("action_snapshot"))
    fits = c("tag").isin("input", "textarea") | ((c("role") == "textbox") & (c("input_type") == "text"))
    bound = c("enabled") & c("visible") & c("value_handle").eqNullSafe(c("handle")) & fits
    return (
        F.when(~F.coalesce(c("valid"), F.lit(False)) | (c("type") != "TYPE_HANDLE"), "INVALID_AGENT_ACTION")
        .when(F.coalesce(stale, F.lit(True)), "STALE_SNAPSHOT").when(~F.coalesce(bound, F.lit(False)), "PRIVACY_ASSERTION_FAILED")
        .when(~c("confirmed"), "CONFIRMATION_REQUIRED").when(c("preflight_error").isNotNull(), c("preflight_error")).when(~c("still_current"), "STALE_SNAPSHOT")
    )


def release_scope(*columns: str) -> Column:
    """Hash of what a grant is bound to."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def staleness(actions: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds stale: the action's snapshot, origin or fingerprint is not the latest of its session."""
    now = observations.groupBy("session_id").agg(F.max_by(F.struct("snapshot_id", "origin", "fingerprint"), "step").alias("now_"))
    same = (c("snapshot_id") == c("now_.snapshot_id")) & (c("origin") == c("now_.origin")) & (c("fingerprint") == c("now_.fingerprint"))
    return actions.join(now, "session_id", "left").withColumn("stale", ~F.coalesce(same, F.lit(False))).drop("now_")


def delivery_status() -> Column:
    """PREPARED, DISPATCHED, ACKNOWLEDGED, UNCONFIRMED or LOCAL_ONLY. Columns: used_server, dispatched, acknowledged, failed."""
    return (
        F.when(~c("used_server"), "LOCAL_ONLY").when(c("acknowledged"), "ACKNOWLEDGED").when(c("dispatched") & c("failed"), "UNCONFIRMED").when(c("dispatched"), "DISPATCHED").otherwise("PREPARED")
    )


def strict_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Top-level keys that a closed schema does not know; from_json would pass them over."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in allowed])))
