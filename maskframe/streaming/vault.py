"""The vault and the rate limiter as running streams: keyed maps in the state store, expiry, eviction.

Each scope keeps its entries, the placeholders by value and the last number of each label as maps in
the state store (RocksDB), so an event reads and writes single keys, however large a scope is. Of
time there are two clocks. Under ``clock="event"`` the stream has a watermark, and timers on whole
``TICK_MS`` sweep what has expired and say so; under ``clock="processing"`` the store itself drops
entries that were not written for their time to live, and the stream never ends by itself. With
``clock="none"`` nothing is swept, which suits streams that are drained. Always, what has expired by
an event's own time is unknown to that event.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from maskframe.functions import placeholders as P

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "tenant_id string, session_id string, seq bigint, at timestamp, op string, type string, label string, value string, placeholder string"
ANSWERS = "tenant_id string, session_id string, seq bigint, op string, placeholder string, value string, state string"
TICK_MS = 60_000


def use_store(spark: SparkSession) -> None:
    """Streams with keyed maps need a state store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


#: Keys of a map that are held at once.
HELD = 50_000


class Held:
    """A map of the state store through a batch of events: a key is read once and written once.

    ``fresh`` says that the map is empty so far, so nothing is read. Past ``HELD`` keys all are written and dropped.
    """

    def __init__(self, state, fresh: bool):
        self.state, self.fresh = state, fresh
        self.known: dict[tuple, tuple | None] = {}
        self.stored: dict[tuple, tuple | None] = {}

    def get(self, key: tuple) -> tuple | None:
        if key not in self.known:
            if len(self.known) >= HELD:
                self.flush()
                self.known, self.stored, self.fresh = {}, {}, False
            found = None if self.fresh else self.state.getValue(key) if self.state.containsKey(key) else None
            self.known[key] = self.stored[key] = None if found is None else tuple(found)
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.get(key)
        self.known[key] = value

    def flush(self) -> None:
        for key, value in self.known.items():
            if value != self.stored[key]:
                if value is None:
                    self.state.removeKey(key)
                else:
                    self.state.updateValue(key, value)
                self.stored[key] = value

    def items(self) -> list[tuple[tuple, tuple]]:
        self.flush()
        return [(tuple(k), tuple(v)) for k, v in self.state.iterator()]


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator:
    """The rows of a key by time and seq, one at a time; they are held as columns."""
    parts = list(rows)
    both = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
    both = both.sort_values(["at", "seq"], kind="stable")
    # As integers of nanoseconds, whatever unit they come in.
    times = both["at"].astype("datetime64[ns]").astype("int64") // 1_000_000
    return zip(times, both.itertuples(index=False), strict=True)


class Vault(StatefulProcessor):
    """The state of one scope."""

    def __init__(self, ttl_ms: int, capacity: int, clock: str):
        self.ttl_ms, self.capacity, self.clock_kind = ttl_ms, capacity, clock

    def init(self, handle) -> None:
        self.handle = handle
        ttl = self.ttl_ms if self.clock_kind == "processing" else None
        self.entries = handle.getMapState("entries", "placeholder string", "type string, composed string, value string, expires bigint, used bigint", ttl)
        self.by_value = handle.getMapState("by_value", "type string, composed string", "placeholder string", ttl)
        self.last = handle.getMapState("last", "family string", "n bigint")
        self.totals = handle.getValueState("totals", "size bigint, clock bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.totals.exists()
        self.size, self.clock = (0, 0) if new else self.totals.get()
        self._hold(new)
        self.oldest: list | None = None
        out, ticks = [], set()
        for now, r in _in_order(rows):
            now, seq = int(now), int(r.seq)
            self.clock += 1
            if r.op == "intern":
                placeholder, state = self._intern(r, now, ticks)
                out.append((seq, r.op, placeholder, r.value, state))
                out += [(seq, "evict", p, None, "EVICTED") for p in self._evict()]
            elif r.op == "resolve":
                value = self._resolve(r.placeholder, now)
                out.append((seq, r.op, r.placeholder, value, "RESOLVED" if value is not None else "UNRESOLVED"))
            else:
                out.append((seq, r.op, r.placeholder, None, "UNKNOWN_OP"))
        self._flush()
        self.totals.update((self.size, self.clock))
        for tick in ticks if self.clock_kind == "event" else ():
            self.handle.registerTimer(tick)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        self.size, self.clock = self.totals.get() if self.totals.exists() else (0, 0)
        self._hold(False)
        gone = [(p[0], e) for p, e in self.held_entries.items() if e[3] <= now]
        for placeholder, entry in gone:
            self._drop(placeholder, entry)
        self._flush()
        self.totals.update((self.size, self.clock))
        yield self._rows(key, [(None, "sweep", p, None, "EXPIRED") for p, _ in sorted(gone, key=lambda g: (g[1][3], g[0]))])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["tenant_id", "session_id", "seq", "op", "placeholder", "value", "state"])
        return made.astype({"seq": "Int64"})

    def _hold(self, fresh: bool) -> None:
        self.held_entries, self.held_values, self.held_last = (Held(m, fresh) for m in (self.entries, self.by_value, self.last))

    def _flush(self) -> None:
        for held in (self.held_entries, self.held_values, self.held_last):
            held.flush()

    def _entry(self, placeholder: str):
        return self.held_entries.get((placeholder,))

    def _put(self, placeholder: str, entry: tuple) -> None:
        self.held_entries.put((placeholder,), entry)
        if self.oldest is not None:
            heapq.heappush(self.oldest, (entry[4], placeholder))

    def _drop(self, placeholder: str, entry: tuple) -> None:
        self.held_entries.put((placeholder,), None)
        self.size -= 1
        named = (entry[0], entry[1])
        if self.held_values.get(named) == (placeholder,):
            self.held_values.put(named, None)

    def _intern(self, r, now: int, ticks: set) -> tuple[str | None, str]:
        if r.value is None or r.type is None:
            return None, "NO_VALUE"
        named = (r.type, unicodedata.normalize("NFC", r.value))
        if (found := self.held_values.get(named)) is not None:
            held = found[0]
            entry = self._entry(held)
            if entry is not None and entry[3] > now:
                self._put(held, (*entry[:4], self.clock))
                return held, "KNOWN"
        wanted = r.placeholder if isinstance(r.placeholder, str) else None
        label, suffix, number = (wanted and P.parts_of(wanted)) or (r.label, "", 0)
        family = (label + suffix,)
        last = (self.held_last.get(family) or (0,))[0]
        placeholder = wanted if number and self._entry(wanted) is None else P.spell(label, max(last, number) + 1 if number else last + 1, suffix)
        if placeholder is None:
            return None, "NO_NUMBER_LEFT"
        self.held_last.put(family, (max(last, P.parts_of(placeholder)[2]),))
        expires = now + self.ttl_ms
        self.size += 1
        self._put(placeholder, (*named, r.value, expires, self.clock))
        self.held_values.put(named, (placeholder,))
        ticks.add(-(-expires // TICK_MS) * TICK_MS)
        return placeholder, "NEW"

    def _resolve(self, placeholder: str, now: int) -> str | None:
        entry = self._entry(placeholder) if placeholder is not None else None
        if entry is None:
            return None
        if entry[3] <= now:
            self._drop(placeholder, entry)
            return None
        self._put(placeholder, (*entry[:4], self.clock))
        return entry[2]

    def _evict(self) -> list[str]:
        """The placeholders used longest ago go while there are more than ``capacity``; a batch of events scans its scope once at most."""
        if self.size <= self.capacity:
            return []
        if self.oldest is None:
            held = [(e[4], p[0]) for p, e in self.held_entries.items()]
            self.size = len(held)  # the store's own expiry is not counted as it happens
            self.oldest = held
            heapq.heapify(self.oldest)
        gone = []
        while self.size > self.capacity and self.oldest:
            used, placeholder = heapq.heappop(self.oldest)
            entry = self._entry(placeholder)
            if entry is not None and entry[4] == used:
                self._drop(placeholder, entry)
                gone.append(placeholder)
        return gone


def vault_stream(events: DataFrame, ttl_ms: int, capacity: int = 100_000, clock: str = "event") -> DataFrame:
    """A stream of vault events (``EVENTS``) and what each was answered (``ANSWERS``).

    ``intern`` gives a value its scope's placeholder: KNOWN while it lives (and used again), else
    NEW: the placeholder asked for where that is free, otherwise the number after the largest that
    its label ever had. ``resolve`` gives a live value back (RESOLVED, and used again) or UNRESOLVED.
    Beyond ``capacity`` entries of a scope, those used longest ago are EVICTED. Under the event clock
    the stream needs a watermark, and what has expired is told as EXPIRED on the next tick. Values
    equal once composed are one. Null values or types get no placeholder (NO_VALUE).
    """
    modes = {"event": "EventTime", "processing": "ProcessingTime", "none": "None"}
    if clock not in modes:
        raise ValueError(f"clock is one of {', '.join(modes)}")
    use_store(events.sparkSession)
    return events.groupBy("tenant_id", "session_id").transformWithStateInPandas(Vault(ttl_ms, capacity, clock), ANSWERS, "Append", modes[clock])


class Windows(StatefulProcessor):
    """The open windows of one share of the keys."""

    def __init__(self, limit: int, window_ms: int, capacity: int, sweep_every: int):
        self.limit, self.window_ms, self.capacity, self.sweep_every = limit, window_ms, capacity, sweep_every

    def init(self, handle) -> None:
        self.windows = handle.getMapState("windows", "key string", "born bigint, ends bigint, n bigint")
        self.totals = handle.getValueState("totals", "size bigint, born bigint, fresh bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.totals.exists()
        size, born, fresh = self.totals.get() if known else (0, 0, 0)
        windows = Held(self.windows, not known)
        heap, out = None, []
        for now, r in _in_order(rows):
            now, name = int(now), (r.key,)
            held = windows.get(name)
            if held is None:
                fresh += 1
                if fresh >= self.sweep_every:
                    fresh = 0
                    for other, window in windows.items():
                        if window[1] <= now:
                            windows.put(other, None)
                            size -= 1
                if size >= self.capacity and heap is None:
                    heap = [(w[0], k[0]) for k, w in windows.items()]
                    heapq.heapify(heap)
                while size >= self.capacity and heap:
                    age, other = heapq.heappop(heap)
                    if (found := windows.get((other,))) is not None and found[0] == age:
                        windows.put((other,), None)
                        size -= 1
                size, born = size + 1, born + 1
                held = (born, now + self.window_ms, 1)
                if heap is not None:
                    heapq.heappush(heap, (born, r.key))
            elif held[1] <= now:
                held = (held[0], now + self.window_ms, 1)
            else:
                held = (held[0], held[1], held[2] + 1)
            windows.put(name, held)
            out.append((r.key, int(r.seq), r.at, held[2] <= self.limit))
            if len(out) >= HELD:
                yield pd.DataFrame(out, columns=["key", "seq", "at", "allowed"])
                out = []
        windows.flush()
        self.totals.update((size, born, fresh))
        yield pd.DataFrame(out, columns=["key", "seq", "at", "allowed"])

    def close(self) -> None:
        pass


def capped_limit_stream(hits: DataFrame, limit: int, window_ms: int, capacity: int = 20_000, shares: int = 64, sweep_every: int = 256) -> DataFrame:
    """Hits (key, seq, at) with ``allowed``: fixed windows that open with a key's first hit, at most ``capacity`` of them.

    Keys are dealt to ``shares``, each with its part of the capacity. A share that has met
    ``sweep_every`` new keys drops windows that have ended; at its capacity a new key drops the
    window of the key that came first.
    """
    use_store(hits.sparkSession)
    rows = hits.select(F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share"), "key", "seq", "at")
    each = max(1, -(-capacity // shares))
    return rows.groupBy("share").transformWithStateInPandas(Windows(limit, window_ms, each, sweep_every), "key string, seq bigint, at timestamp, allowed boolean", "Append", "None")
