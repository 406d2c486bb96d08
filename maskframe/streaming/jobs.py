"""Stateful streams: restoration across chunks, rate limits, expiry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskframe.functions.placeholders import OPEN, PLACEHOLDER
from maskframe.streaming.vault import use_store

CHUNKS = "resp_id string, field_key string, seq bigint, text string, fmt string, terminal boolean"
MAX_BUFFER = 1 << 20


def cut(buffer: str, final: bool) -> tuple[str, str]:
    """What can be sent now, and what must wait for the next chunk."""
    m = None if final else OPEN.search(buffer, max(0, len(buffer) - 40))
    return (buffer, "") if m is None else (buffer[: m.start()], buffer[m.start() :])


#: Placeholders that one response may restore.
MAX_RESTORED = 10_000


class _Spent(Exception):
    """A response has restored as much as it may."""


def restore_stream(chunks: DataFrame, grants: DataFrame, budget: int = MAX_RESTORED, max_buffer: int = MAX_BUFFER, idle_ms: int | None = 600_000) -> DataFrame:
    """Text chunks with placeholders put back, also those cut by chunk ends.

    ``grants`` (resp_id, placeholder, value) says what each response may restore, as
    ``vault.authorised`` gives it: no other placeholder is replaced, whatever other responses have.
    ``chunks`` has resp_id, field_key, seq (from 0), text, fmt and terminal. A field's chunks are
    taken in the order of seq; chunks that come early wait for those before, and chunks that come
    again change nothing, before a field's end and after it. JSON fields are held to their end and
    restored string by string. State is a response's fields, what is left of its budget, and its
    grants, which come with the first chunk of each field alone. One error row ends a response: BUFFER_LIMIT, UNMASK_LIMIT, or INCOMPLETE where
    open fields get nothing for ``idle_ms``. Streams that are drained and end take None.
    """
    values = grants.groupBy("resp_id", "placeholder").agg(F.max("value").alias("value")).groupBy("resp_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("known"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["resp_id", "field_key", "seq", "text", "error_code"]
        (fields, known), left = (json.loads(state.get[0]), state.get[1]) if state.exists else (({}, {}), budget)
        if state.hasTimedOut:
            state.remove()
            late = [(key[0], name, f[1], None, "INCOMPLETE") for name, f in fields.items() if f[1] >= 0] if left >= 0 else []
            yield pd.DataFrame(late[:1], columns=columns)
            return
        rows = []
        for batch in batches:
            rows += batch.itertuples(index=False)
        out = []
        if left >= 0:  # else the response has ended in an error
            for r in rows:
                known = dict(r.known) if r.known is not None else known
                held = fields.setdefault(r.field_key, [{}, 0, "", "text"])
                # A field that has ended is due nothing (-1).
                if held[1] >= 0 and int(r.seq) >= held[1]:
                    held[0].setdefault(str(int(r.seq)), [r.text or "", bool(r.terminal)])
                    held[3] = r.fmt

            def replace(text: str) -> str:
                nonlocal left

                def value(m):
                    nonlocal left
                    if m[0] not in known:
                        return m[0]
                    if left <= 0:
                        raise _Spent
                    left -= 1
                    return known[m[0]]

                return PLACEHOLDER.sub(value, text)

            error = at = None
            for name in sorted(fields):
                early, due, buffer, fmt = fields[name]
                if due < 0:
                    continue
                ended = False
                try:
                    while not ended and str(due) in early:
                        text, ended = early.pop(str(due))
                        buffer += text
                        if fmt == "text":
                            ready, buffer = cut(buffer, ended)
                            out.append((key[0], name, due, replace(ready), None))
                        elif ended:
                            out.append((key[0], name, due, _restore_document(buffer, replace), None))
                            buffer = ""
                        due += 1
                except _Spent:
                    error, at = "UNMASK_LIMIT", (name, due)
                    break
                if len(buffer) + sum(len(t) for t, _ in early.values()) > max_buffer:
                    error, at = "BUFFER_LIMIT", (name, due)
                    break
                fields[name] = [early, due, buffer, fmt]
                if ended:
                    fields[name] = [{}, -1, "", fmt]
            out = [r for r in out if r[3]]
            if error:
                out.append((key[0], *at, None, error))
                fields, known, left = {}, {}, -1
        state.update((json.dumps((fields, known)), left))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    # By seq too: chunks that get no grants are dealt like the others, not to one task as nulls would be.
    met = chunks.join(values.withColumn("seq", F.lit(0).cast("long")), ["resp_id", "seq"], "left")
    use_store(chunks.sparkSession)  # the state is on disk, not in the heap
    return met.groupBy("resp_id").applyInPandasWithState(step, "resp_id string, field_key string, seq bigint, text string, error_code string", "fields string, budget bigint", "append", timeout)


def _restore_document(text: str, replace) -> str:
    from maskframe.operators.chat import _replace

    try:
        return json.dumps(_replace(json.loads(text), replace), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return text


def limit_stream(hits: DataFrame, key: str, at: str, limit: int, window_ms: int, expire: bool = True) -> DataFrame:
    """Hits with ``allowed``, as a stream: windows open with the first hit after the last has ended.

    With ``expire``, keys that were idle for a window are forgotten, which needs a running clock:
    leave it off for a stream that is drained and ends.
    """
    schema = f"{key} string, at timestamp, allowed boolean"

    def step(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for t in rows[at]:
            ms = int(t.value // 1_000_000)
            if ends <= ms:
                ends, n = ms + window_ms, 0
            n += 1
            out.append((str(name[0]), t, n <= limit))
        state.update((ends, n))
        if expire:
            state.setTimeoutDuration(max(1, window_ms))
        yield pd.DataFrame(out, columns=[key, "at", "allowed"])

    return hits.groupBy(key).applyInPandasWithState(step, schema, "ends bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def audit_rollup(records: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in windows of event time; an extension beyond the audit log's own reports."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
