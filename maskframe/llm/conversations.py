"""Repair of conversation structure by lazy weighted determinisation.

Role initials of a sound conversation are ``(s?(ua)+)?``. A small nondeterministic automaton of
edits (keep, rerole, delete, insert) has four places: at the start, after s, after u, after a. The
scan goes through a conversation from its last row to its first: the vector of what each place costs
to the end, less its minimum, is a state of the deterministic automaton; its minimum is the weight of
the step. States and steps are made when first met and kept in a table, so the scan of many
conversations side by side is a lookup a row. The trace then runs the other way, from the first row
on, over tight arcs alone (those whose cost is what the vector says), the least letter first; as the
next place follows from place and letter, the audit is the least of all cheapest ones.

Conversations of up to ``LIMIT`` rows and ``LIMIT_BYTES`` are dealt whole and read in streams. A longer
one is cut into chunks by range of its rows; a chunk says for every state at its end which state is at
its start, at what cost, and where each place leads; those maps compose. Equal rows are counted before
they move. Only the hash over the repaired text, which SHA-256 makes serial, reads a long conversation's
pieces in order in one task, a piece at a time. A result row holds its audit, so a conversation can't
pass 2^31 edits.

Null roles and texts count as one blank; a null conv_id is a conversation; null turns come first; rows
of one turn go by role, then text. Roles are told by their first letter, in this case; an empty or other role
can't be kept. Very long texts are held one group of rows at a time. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.llm._common import materialize

#: Rows and bytes of text of a conversation, and of a chunk, that a task holds at once.
LIMIT, LIMIT_BYTES = 16_384, 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: Places, and which initial leads from a place to which.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: A row's symbol: 3 * class of its initial + what must be done with it.
CLASSES = "sua?"
FREE, LOOSE, GONE = range(3)  # kept as it is; kept at the price of its missing end; deleted
LEGAL = {"su", "ua", "au"}
_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
TOTALS = [f.split()[0] for f in _FIELDS.split(", ")]


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): rows with the planted faults; n is how often a row stands, 0 for a dropped one."""
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_id, turn)])
    kind = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    said = F.when(kind <= 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said)
    by = F.when(kind == 4, "user").otherwise(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.when(kind == 0, "").otherwise(by).alias("role"), said.alias("text"), n.alias("n"))


class Repairs:
    """The deterministic automaton, grown as it is used.

    ``step[state, symbol]`` and ``weight[state, symbol]`` go from the state behind a row to the one
    before it; ``go[state, symbol, place]`` and ``arc[...]`` tell, for the state behind the row, where
    the trace goes from a place before it and by which edits (a number in ``arcs``).
    """

    def __init__(self):
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step = np.zeros((0, 12), dtype=np.int32)
        self.weight = np.zeros((0, 12), dtype=np.int64)
        self.go = np.zeros((0, 12, 4), dtype=np.int8)
        self.arc = np.zeros((0, 12, 4), dtype=np.int32)
        self.arcs: list[tuple[str, tuple[str, ...], str | None]] = []
        self._arc_number: dict[tuple, int] = {}
        big = 1 << 30
        self.end, _ = self._state(self._closed([0, big, big, 0]))

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Costs once any number of rows may be put in first."""
        for _ in range(4):
            costs = [min([c, *[INSERT + costs[to] for r, to in NEXT[p].items() if r in ROLES]]) for p, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        low = min(costs)
        vector = tuple(c - low for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.step = np.vstack([self.step, np.full((1, 12), -1, dtype=np.int32)])
            self.weight = np.vstack([self.weight, np.zeros((1, 12), dtype=np.int64)])
            self.go = np.concatenate([self.go, np.zeros((1, 12, 4), dtype=np.int8)])
            self.arc = np.concatenate([self.arc, np.zeros((1, 12, 4), dtype=np.int32)])
        return self.number[vector], low

    def _row(self, symbol: int, place: int) -> list[tuple[str, int, int, str | None]]:
        """What can be done with a row at a place: letter, cost, next place, and the role it gets ('' keeps its own, None deletes)."""
        initial, fault = CLASSES[symbol // 3], symbol % 3
        out = [("D", DELETE, place, None)]
        if fault != GONE:
            extra = TRUNCATED if fault == LOOSE else 0
            if initial in NEXT[place]:
                out.append(("K", KEEP + extra, NEXT[place][initial], ""))
            out += [("R", REROLE + extra, to, ROLES[r]) for r, to in NEXT[place].items() if r in ROLES]
        return out

    def fill(self, state: int, symbol: int) -> None:
        """Makes the step of a row with ``symbol`` before ``state``, and its tight arcs."""
        after = self.vectors[state]
        before = self._closed([min(cost + after[to] for _, cost, to, _ in self._row(symbol, p)) for p in range(4)])
        for place in range(4):
            letters, put, p = "", [], place
            while True:
                arcs = [(letter, to, role) for letter, cost, to, role in self._row(symbol, p) if cost + after[to] == before[p]]
                arcs += [("I", to, ROLES[r]) for r, to in NEXT[p].items() if r in ROLES and INSERT + before[to] == before[p]]
                letter, p, role = min(arcs, key=lambda a: a[0])
                letters += letter
                if letter != "I":
                    break
                put.append(role)
            key = (letters, tuple(put), role)
            if key not in self._arc_number:
                self._arc_number[key] = len(self.arcs)
                self.arcs.append(key)
            self.go[state, symbol, place], self.arc[state, symbol, place] = p, self._arc_number[key]
        to, low = self._state(before)
        self.step[state, symbol], self.weight[state, symbol] = to, low

    def before(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states before rows with ``symbols``; steps that are new are made."""
        got = self.step[states, symbols]
        if (got < 0).any():
            for s, x in {(int(states[i]), int(symbols[i])) for i in np.flatnonzero(got < 0)}:
                self.fill(s, x)
            got = self.step[states, symbols]
        return got

    def all_states(self) -> int:
        """Makes every state that any conversation can reach; returns how many there are."""
        known = 0
        while known < len(self.vectors):
            for x in range(12):
                self.fill(known, x)
            known += 1
        return known

    def finish(self, place: int) -> tuple[str, ...]:
        """Roles put in at the end, from a place."""
        return {START: (), AFTER_S: ("user", "assistant"), AFTER_U: ("assistant",), AFTER_A: ()}[place]

    def scan(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost of each conversation (``size`` symbols from ``first`` on), the arc of each row, and the place at each end."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        state = np.full(len(size), self.end, dtype=np.int32)
        cost = np.zeros(len(size), dtype=np.int64)
        behind = np.zeros(len(symbols), dtype=np.int32)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        for step in range(1, longest + 1):
            k = active[step - 1]
            at = first[:k] + size[:k] - step
            behind[at] = state[:k]
            x = symbols[at]
            got = self.before(state[:k], x)
            cost[:k] += self.weight[state[:k], x]
            state[:k] = got
        cost += np.array([v[START] for v in self.vectors], dtype=np.int64)[state]
        place = np.zeros(len(size), dtype=np.int8)
        arc = np.zeros(len(symbols), dtype=np.int32)
        for step in range(longest):
            k = active[step]
            at = first[:k] + step
            arc[at] = self.arc[behind[at], symbols[at], place[:k]]
            place[:k] = self.go[behind[at], symbols[at], place[:k]]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return cost[back], arc, place[back]


def judge(roles: list[str], texts: list[str], first_seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols, and whether each row is blank, a duplicate, truncated, from whether its role and text are new."""
    ends = [t.rstrip(SPACE)[-1:] for t in texts]
    blank = np.array([e == "" for e in ends], dtype=bool)
    loose = np.array([e not in ".!?" for e in ends], dtype=bool) & ~blank
    duplicate = ~blank & ~first_seen
    truncated = loose & ~duplicate
    letter = np.array([max(0, CLASSES.find(r[:1])) if r[:1] in ("s", "u", "a") else 3 for r in roles], dtype=np.int64)
    fault = np.where(blank | duplicate, GONE, np.where(truncated, LOOSE, FREE))
    return 3 * letter + fault, blank, duplicate, truncated


def _lines(machine: Repairs, arcs: np.ndarray, extra: np.ndarray, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Audit letters and repaired lines of some rows of a conversation; ``extra`` are copies deleted after a row."""
    letters, lines = [], []
    for a, more, role, text in zip(arcs, extra, roles, texts, strict=True):
        edits, put, now = machine.arcs[a]
        letters.append(edits + "D" * int(more))
        lines += [f"{r}:" for r in put]
        if now is not None:
            lines.append(f"{now or role}:{text}")
    return letters, lines


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _gaps(turns: np.ndarray) -> int:
    return int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0


def _repair_whole(machine: Repairs, table: pa.Table) -> pa.RecordBatch:
    """Rows sorted by conversation and turn, every conversation whole."""
    ids = table.column("conv_id").combine_chunks()
    code = pa.compute.fill_null(pa.compute.dictionary_encode(ids).indices, -1).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    group = np.cumsum(np.r_[True, code[1:] != code[:-1]]) - 1 if len(code) else code
    n = table.column("n").to_numpy()
    live = np.flatnonzero(n > 0)
    roles, texts = table.column("role").take(live).to_pylist(), table.column("text").take(live).to_pylist()
    turns = table.column("turn").take(live)
    has_turn = turns.is_valid().to_numpy()
    turns = turns.fill_null(0).to_numpy()
    group, n = group[live], n[live]
    seen: set = set()
    new = np.zeros(len(live), dtype=bool)
    for i, key in enumerate(zip(group.tolist(), roles, texts, strict=True)):
        if key not in seen:
            seen.add(key)
            new[i] = True
    symbols, blank, duplicate, truncated = judge(roles, texts, new)
    many = len(begin)
    first = np.searchsorted(group, np.arange(many))
    size = np.searchsorted(group, np.arange(many), side="right") - first
    cost, arcs, place = machine.scan(symbols, first, size)
    extra = n - 1
    total = {
        "blank": np.bincount(group, np.where(blank, n, 0), many), "duplicate": np.bincount(group, np.where(blank, 0, duplicate * n + ~duplicate * extra), many),
        "truncated": np.bincount(group, truncated, many), "cost": cost + DELETE * np.bincount(group, extra, many),
    }
    initial = np.array([r[:1] for r in roles] or [""])
    bad = np.array([a + b not in LEGAL for a, b in zip(initial[:-1], initial[1:], strict=True)], dtype=bool) & (group[1:] == group[:-1]) if len(live) else np.zeros(0, bool)
    illegal = np.bincount(group, extra, many)
    illegal += np.bincount(group[1:], bad, many) if len(live) > 1 else 0
    gaps, audits, shas = [], [], []
    for g in range(many):
        a, b = first[g], first[g] + size[g]
        gaps.append(_gaps(turns[a:b][has_turn[a:b]]))
        letters, lines = _lines(machine, arcs[a:b], extra[a:b], roles[a:b], texts[a:b])
        rest = machine.finish(int(place[g]))
        audits.append("".join(letters) + "I" * len(rest))
        shas.append(_sha(lines + [f"{r}:" for r in rest]))
    total |= {"gaps": np.array(gaps, dtype=np.int64), "illegal": illegal}
    columns = [ids.take(pa.array(begin)), *[pa.array(np.asarray(total[c]).astype(np.int64)) for c in TOTALS], pa.array(audits, pa.string()), pa.array(shas, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *TOTALS, "audit", "repaired_sha256"])


def _whole_groups(batches, rows: int, size: int):
    """Tables of rows in order that cut no conversation, of about ``rows`` rows or ``size`` bytes."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
        if n >= rows or held_bytes >= size:
            table = pa.Table.from_batches(held)
            ids = table.column("conv_id").combine_chunks()
            code = pa.compute.fill_null(pa.compute.dictionary_encode(ids).indices, -1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(code[1:] != code[:-1])
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                n, held_bytes = table.num_rows - cut, sum(b.nbytes for b in held)
    if n:
        yield pa.Table.from_batches(held)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(rows: DataFrame, limit: int = LIMIT, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Repairs (conv_id, turn, role, text, n) as ``damage`` gives them; one row a conversation.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_FIELDS}, audit string, repaired_sha256 string"
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("n", F.lit(1))).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    big = materialize(sizes.filter((F.col("rows") > limit) | (F.col("bytes") > limit_bytes)).select(F.col("conv_id").alias("big")), "long-conversations")
    any_big = not big.isEmpty()
    short = rows.join(big, F.col("conv_id").eqNullSafe(F.col("big")), "left_anti") if any_big else rows

    def run(batches):
        machine = Repairs()
        for table in _whole_groups(batches, limit, limit_bytes):
            yield _repair_whole(machine, table)

    out = short.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).mapInArrow(run, schema)
    if any_big:
        out = out.unionByName(_repair_long(rows.join(big, F.col("conv_id").eqNullSafe(F.col("big")), "left_semi"), schema, kind, limit, limit_bytes))
    return out


def _repair_long(rows: DataFrame, schema: str, kind: str, limit: int, limit_bytes: int) -> DataFrame:
    """Conversations of any length, by chunks whose maps compose."""
    summary_schema = f"conv_id {kind}, chunk long, blank long, duplicate long, truncated long, illegal long, rows long, first string, last string, turns long, low long, high long, step binary, cost binary, go binary"
    ends_schema = f"conv_id {kind}, chunk long, end int, at int, final boolean, {_FIELDS}"
    piece_schema = f"conv_id {kind}, chunk long, audit string, repaired binary, {_FIELDS}"
    summary_arrow, ends_arrow, piece_arrow = map(_arrow, (summary_schema, ends_schema, piece_schema))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    total = counted.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = 1 + max((total[0] or 0) // limit, (total[1] or 0) // limit_bytes)
    ranged = counted.repartitionByRange(parts, F.col("conv_id").asc_nulls_first(), *_order()).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())

    def number(batches):
        """Numbers chunks within the task, and rows within a chunk."""
        from pyspark import TaskContext

        chunk, last, place, size = (TaskContext.get().partitionId() << 32) - 1, (), 0, 0
        for batch in batches:
            chunks, places = [], []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size += len(text)
                if (conv,) != last or place + 1 >= limit or size > limit_bytes:
                    chunk, last, place, size = chunk + 1, (conv,), -1, len(text)
                place += 1
                chunks.append(chunk)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())], names=[*batch.schema.names, "chunk", "place"])

    pieces = materialize(ranged.mapInArrow(number, f"conv_id {kind}, turn long, role string, text string, n long, chunk long, place int"), "chunks")
    # The first row of each role and text; what comes after is a duplicate, in whatever chunk.
    alive = pieces.filter("n > 0")
    first = alive.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min(F.struct("chunk", "place")).alias("at"))
    new = first.groupBy("at.chunk").agg(F.collect_list("at.place").alias("new"))

    def read(rows: pa.Table, new: pa.Table):
        rows = rows.sort_by("place")
        rows = rows.filter(pa.compute.greater(rows.column("n"), 0))
        known = {p for at in new.column("new").to_pylist() for p in at}
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        fresh = np.array([p in known for p in rows.column("place").to_pylist()], dtype=bool)
        return rows, roles, texts, judge(roles, texts, fresh)

    def summary(left: pa.Table, right: pa.Table) -> pa.Table:
        conv, chunk = left.column("conv_id").slice(0, 1), left.column("chunk").slice(0, 1)
        rows, roles, texts, (symbols, blank, duplicate, truncated) = read(left, right)
        machine = Repairs()
        states = np.arange(machine.all_states(), dtype=np.int32)
        behind = np.zeros((len(symbols) + 1, len(states)), dtype=np.int32)
        behind[-1] = states
        cost = np.zeros(len(states), dtype=np.int64)
        for i in range(len(symbols) - 1, -1, -1):
            cost += machine.weight[behind[i + 1], symbols[i]]
            behind[i] = machine.step[behind[i + 1], symbols[i]]
        place = np.tile(np.arange(4), (len(states), 1))
        for i in range(len(symbols)):
            place = machine.go[behind[i + 1][:, None], symbols[i], place]
        n = rows.column("n").to_numpy()
        extra = n - 1
        cost += DELETE * int(extra.sum())
        illegal = int(extra.sum()) + sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles[:-1], roles[1:], strict=True))
        turns = rows.column("turn").drop_null().to_numpy()
        row = {
            "blank": int(n[blank].sum()), "duplicate": int(n[duplicate].sum() + extra[~blank & ~duplicate].sum()), "truncated": int(truncated.sum()), "illegal": illegal,
            "rows": len(roles), "first": roles[0][:1] if roles else "", "last": roles[-1][:1] if roles else "", "turns": len(np.unique(turns)),
            "low": int(turns.min()) if len(turns) else None, "high": int(turns.max()) if len(turns) else None,
            "step": behind[0].tobytes(), "cost": cost.tobytes(), "go": place.astype(np.int8).tobytes(),
        }
        return pa.Table.from_arrays([conv, chunk, *[pa.array([v]) for v in row.values()]], names=["conv_id", "chunk", *row]).cast(summary_arrow)

    maps = materialize(pieces.groupBy("chunk").cogroup(new.groupBy("chunk")).applyInArrow(summary, summary_schema), "chunk-maps")

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        state, cost, illegal = Repairs().end, 0, sum(r["illegal"] for r in rows)
        for r in reversed(rows):
            r["end"] = state
            cost += int(np.frombuffer(r["cost"], np.int64)[state])
            state = int(np.frombuffer(r["step"], np.int32)[state])
        machine = Repairs()
        machine.all_states()
        cost += machine.vectors[state][START]
        place, last, high, low, turns = START, None, None, None, 0
        for r in rows:
            r["at"] = place
            place = int(np.frombuffer(r["go"], np.int8).reshape(-1, 4)[r["end"], place])
            if r["rows"]:
                illegal += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            if r["turns"]:
                turns += r["turns"] - (high == r["low"])  # a turn may go on in the next chunk
                low, high = r["low"] if low is None else low, r["high"]
        gaps = high - low + 1 - turns if turns else 0
        whole = [gaps, *[sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")], illegal, cost]
        columns = [table.column("conv_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(rows), np.int64))), pa.array([r["chunk"] for r in rows])]
        columns += [pa.array([r["end"] for r in rows], pa.int32()), pa.array([r["at"] for r in rows], pa.int32()), pa.array([i == len(rows) - 1 for i in range(len(rows))])]
        return pa.Table.from_arrays([*columns, *[pa.array([v] * len(rows), pa.int64()) for v in whole]], names=ends_arrow.names)

    # A row of a kilobyte for each chunk of the conversation.
    ends = maps.groupBy("conv_id").applyInArrow(compose, ends_schema)
    told = materialize(ends.drop("conv_id").join(new, "chunk", "left"), "chunk-ends")

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        conv, chunk = left.column("conv_id").slice(0, 1), left.column("chunk").slice(0, 1)
        known = right.select(["new"]).filter(right.column("new").is_valid())
        rows, roles, texts, (symbols, *_) = read(left, known)
        machine = Repairs()
        machine.all_states()
        state, place, final = right.column("end")[0].as_py(), right.column("at")[0].as_py(), right.column("final")[0].as_py()
        behind = np.zeros(len(symbols), dtype=np.int32)
        for i in range(len(symbols) - 1, -1, -1):
            behind[i] = state
            state = machine.step[state, symbols[i]]
        arcs = np.zeros(len(symbols), dtype=np.int32)
        for i in range(len(symbols)):
            arcs[i] = machine.arc[behind[i], symbols[i], place]
            place = int(machine.go[behind[i], symbols[i], place])
        letters, lines = _lines(machine, arcs, rows.column("n").to_numpy() - 1, roles, texts)
        rest = machine.finish(place) if final else ()
        lines += [f"{r}:" for r in rest]
        data = [conv, chunk, pa.array(["".join(letters) + "I" * len(rest)]), pa.array(["\n".join(lines).encode() if lines else None], pa.binary())]
        return pa.Table.from_arrays([*data, *[right.column(c).slice(0, 1) for c in TOTALS]], names=["conv_id", "chunk", "audit", "repaired", *TOTALS]).cast(piece_arrow)

    written = pieces.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(write, piece_schema)

    def join(batches):
        """Puts the pieces of a conversation together, in order, a piece at a time."""
        key, letters, digest, some, last = (), [], None, False, None
        names = ["conv_id", *TOTALS, "audit", "repaired_sha256"]

        def done():
            return pa.RecordBatch.from_arrays([last.column("conv_id"), *[last.column(c) for c in TOTALS], pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                conv = (row.column("conv_id")[0].as_py(),)
                if conv != key:
                    if key:
                        yield done()
                    key, letters, digest, some = conv, [], hashlib.sha256(), False
                last = row
                letters.append(row.column("audit")[0].as_py())
                piece = row.column("repaired")[0].as_py()
                if piece is not None:
                    digest.update((b"\n" if some else b"") + piece)
                    some = True
        if key:
            yield done()

    return written.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(join, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
