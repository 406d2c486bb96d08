"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every byte that a ``length``-byte string covers goes, if that string also starts anywhere else
(same text included). Strings are judged on the input and never cross texts.

Two equal strings hold the same least-hashed ``k``-gram (their anchor) at the same place. Runs
of strings with one anchor are segments, and only segments that share an anchor can share a
string. Blocks of texts send their different segments, as anchor and 128-bit digest, to the owner
of the anchor. A segment met twice is repeated as a whole. Where an anchor has different segments,
each sends its bytes once, and the owner sorts the suffixes that start in them, by anchor and
distance from it: a mergesort that compares two by binary search for their common extension over
prefix polynomial hashes. Neighbours that agree over ``length`` bytes are verified byte by byte;
what the sort puts together is what goes.

An anchor with more different segments than ``hot`` (the edge of a passage that a great many
texts share) would be a group without bound: strings at such anchors are counted one by one by a
128-bit digest, whose owners see one row a block. No row is compared by fewer than 128 bits or
its bytes: with 10^13 segments, as of 400 TB, two different ones share a digest with a chance of
1.5 in 10^13. An owner gets at most ``PER_ANCHOR`` rows of an anchor from a block.

Null and empty texts, and texts shorter than ``length``, keep all bytes. Repeated rows count as
copies of each other. Columns other than the id and the text are not read. A block is the same
when a lost task is run again if ``docs`` is read from files or a checkpoint, as it should be.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm._common import texts_of
from maskframe.llm._tokens import BYTE_VALUE, _U, by_key, dealt, mix, packed_blocks, split_parts, unpack_rows

LENGTH = 200
#: Bytes of an anchor; a power of two.
ANCHOR = 128
BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: Strings looked at together.
SLICE = 1 << 20
#: Different segments of an anchor that are sorted; beyond, strings are counted by digest.
HOT = 2048
#: Different segments of an anchor in one block, beyond which the anchor counts as hot.
PER_ANCHOR = 16
_PLACE_BITS = 24
_Q1, _Q2 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: What becomes of a segment: it is repeated as a whole, its bytes are compared, both, or its strings are counted.
WHOLE, SINGLE, PARTNER, STRINGS = 1, 2, 3, 4

SENT = "part int, kind int, block long, a binary, b binary, n binary"
BACK = "block long, part int, kind int, a binary"


def _powers(q: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, q, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Prefix polynomial hashes of a byte array: any range's hash in constant time."""

    def __init__(self, data: np.ndarray, q: np.uint64 = _Q1):
        inverse = _U(pow(int(q), -1, 1 << 64))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * _powers(q, max(1, len(data)))[: len(data)], out=self.sums[1:])
        self.inverse = _powers(inverse, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def common(prefix: Prefix, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at ``a`` and ``b``, ``limit`` at most, by binary search."""
    length = np.zeros(len(a), dtype=np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        to = length + step
        fits = to <= limit
        to = np.where(fits, to, length)
        length = np.where(fits & (prefix.of(a, a + to) == prefix.of(b, b + to)), to, length)
        step >>= 1
    return length


def less(prefix: Prefix, data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether the suffix at ``a`` comes before that at ``b`` over ``limit`` bytes."""
    out = data[a] < data[b]
    tie = np.flatnonzero(data[a] == data[b])
    x, y = a[tie], b[tie]
    n = common(prefix, x, y, limit)
    same = n >= limit
    n = np.where(same, 0, n)
    out[tie] = np.where(same, or_equal[tie], data[x + n] < data[y + n])
    return out


def sort_suffixes(prefix: Prefix, data: np.ndarray, at: np.ndarray, bucket: np.ndarray, limit: int) -> np.ndarray:
    """An order of the suffixes ``at`` by bucket, then by their first ``limit`` bytes: a bottom-up mergesort of all buckets at once."""
    order = np.argsort(bucket, kind="stable")
    key = bucket[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(key)])
    base, room = np.repeat(begin, size), np.repeat(size, size)
    rank = np.arange(len(key)) - base
    width, widest = 1, int(size.max(initial=0))
    while width < widest:
        live = np.flatnonzero(room > width)
        run = rank[live] // width
        low = (run ^ 1) * width
        high = np.minimum(low + width, room[live])
        low = np.minimum(low, high)
        first, right, me = low.copy(), (run & 1).astype(bool), at[order[live]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = at[order[base[live[open_]] + mid]]
            before = less(prefix, data, other, me[open_], limit, right[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = base[live] + (run >> 1) * (2 * width) + (rank[live] - run * width) + (low - first)
        moved = order.copy()
        moved[to] = order[live]
        order = moved
        width *= 2
    return order


def equal_groups(prefix: Prefix, data: np.ndarray, at: np.ndarray, bucket: np.ndarray, limit: int) -> np.ndarray:
    """A number for each suffix: equal where bucket and first ``limit`` bytes are equal, verified byte by byte."""
    order = sort_suffixes(prefix, data, at, bucket, limit)
    if not len(order):
        return order
    a, b, same_bucket = at[order[:-1]], at[order[1:]], bucket[order[1:]] == bucket[order[:-1]]
    same = np.zeros(len(a), dtype=bool)
    maybe = np.flatnonzero(same_bucket)
    same[maybe] = common(prefix, a[maybe], b[maybe], limit) >= limit
    hit = np.flatnonzero(same)
    for i in range(0, len(hit), 4096):
        part = hit[i : i + 4096]
        span = np.arange(limit)
        if not (data[a[part][:, None] + span] == data[b[part][:, None] + span]).all():
            raw = data.tobytes()  # a hash collision: compare the bytes themselves instead
            seen: dict[tuple[int, bytes], int] = {}
            return np.array([seen.setdefault((int(g), raw[p : p + limit]), len(seen)) for p, g in zip(at, bucket, strict=True)], dtype=np.int64)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(np.r_[0, ~same])
    return group


class Segments:
    """The segments of one slice of a block: ``start`` to ``last`` are their strings' places, ``place`` their anchor's, ``anchor`` its hash."""

    def __init__(self, data: np.ndarray, end: np.ndarray, length: int, k: int):
        """``data``: bytes; ``end``: of the text of each string that starts in the slice."""
        w, n = length - k + 1, len(end)
        h, step, q = BYTE_VALUE[data], 1, _Q2
        while step < k:
            h = h[:-step] * q + h[step:]
            q = _U(int(q) * int(q) & (1 << 64) - 1)
            step *= 2
        h = mix(h)
        ranked = (h & ~_U((1 << _PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        grid = np.r_[ranked, np.full(-len(ranked) % w, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        at = np.flatnonzero(np.arange(n) + length <= end)
        cut = np.flatnonzero((np.diff(place[at]) != 0) | (np.diff(at) != 1))
        self.start = at[np.r_[0, cut + 1]] if len(at) else at
        self.last = at[np.r_[cut, len(at) - 1]] if len(at) else at
        self.place = place[self.start]
        self.anchor = mix(h[self.place])  # the least of many hashes is small: mixed again, it is spread evenly


def digests_of(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of 128 bits of ranges of bytes, as two numbers a row."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), dtype=np.uint64).reshape(-1, 2)


class Block:
    """The segments of some texts, in order of their places, and the different ones that are asked for.

    ``anchors``, ``keys`` and ``n`` are what is asked, sorted by anchor: a row a different segment,
    or for a hot anchor one row with n = 0. ``row`` says which row each segment belongs to.
    """

    def __init__(self, texts: list[bytes], length: int, k: int):
        self.data, self.length = b"".join(texts), length
        array = np.frombuffer(self.data, dtype=np.uint8)
        ends = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))
        none = np.zeros(0, np.int64)
        found = [(none, none, none, none.astype(np.uint64))]
        for begin in range(0, max(0, len(array) - length + 1), SLICE):
            stop = min(begin + SLICE, len(array) - length + 1)
            which = np.searchsorted(ends, np.arange(begin, stop), side="right")
            s = Segments(array[begin : stop + length - 1], ends[which] - begin, length, k)
            found.append((s.start + begin, s.last + begin, s.place + begin, s.anchor))
        self.start, self.last, self.place, self.anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        key = digests_of(self.data, self.start, self.last + length)
        order = np.lexsort((key[:, 1], key[:, 0], self.anchor))
        anchor, key = self.anchor[order], key[order]
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]] if len(order) else np.zeros(0, bool)
        new = new_anchor | np.r_[True, (key[1:] != key[:-1]).any(axis=1)] if len(order) else new_anchor
        group = np.cumsum(new_anchor) - 1
        hot = np.bincount(group, weights=new)[group] > PER_ANCHOR if len(order) else new
        new = np.where(hot, new_anchor, new)
        first = np.flatnonzero(new)
        self.row = np.empty(len(order), np.int64)
        self.row[order] = np.cumsum(new) - 1
        self.anchors, self.keys = anchor[first], np.where(hot[first, None], _U(0), key[first])
        self.n = np.where(hot[first], 0, np.minimum(np.diff(np.r_[first, len(order)]), 2)).astype(np.uint8)
        self.one = order[first]  # a segment of each row

    def strings(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of segments whose strings are counted: all places, the different digests in order, how often each, and the digest of each place."""
        which = np.flatnonzero(kinds[self.row] == STRINGS)
        size = self.last[which] - self.start[which] + 1
        at = np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = digests_of(self.data, at, at + self.length)
        order = np.lexsort((key[:, 1], key[:, 0]))
        new = np.r_[True, (key[order[1:]] != key[order[:-1]]).any(axis=1)] if len(order) else np.zeros(0, bool)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return at, key[order[new]], np.minimum(np.bincount(back), 2).astype(np.uint8), back


def _squeeze(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"), dtype=kind)


def _rows(block: int, kind: int, sorted_keys: np.ndarray, parts: int, cut) -> pa.RecordBatch:
    """One row for each part that some of the sorted keys go to; ``cut(from, to)`` gives its three columns."""
    _, at = split_parts(sorted_keys, parts, ranges=True)
    full = np.flatnonzero(np.diff(at))
    columns = list(zip(*[cut(at[i], at[i + 1]) for i in full], strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array(np.full(len(full), block, np.int64)), *[pa.array(c, pa.binary()) for c in columns]], names=["part", "kind", "block", "a", "b", "n"])


def ask_segments(number: int, block: Block, parts: int) -> pa.RecordBatch:
    return _rows(number, 0, block.anchors, parts, lambda i, j: (_squeeze(block.anchors[i:j]), block.keys[i:j].tobytes(), _squeeze(block.n[i:j])))


def _answers(table: pa.Table, part: int, kind: int, sizes: list[int], values: np.ndarray):
    """What each row of ``table`` is told, where it is told anything."""
    end = np.cumsum(sizes)
    for number, a, b in zip(table.column("block").to_pylist(), end - sizes, end, strict=True):
        if values[a:b].any():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([_squeeze(values[a:b])], pa.binary())], names=["block", "part", "kind", "a"])


def judge_segments(part: int, table: pa.Table, most: int):
    """WHOLE, SINGLE, PARTNER or STRINGS for each row that was asked (0: no string of it is repeated)."""
    asked = [_spread(x, np.uint64) for x in table.column("a").to_pylist()]
    anchor = np.concatenate(asked)
    key = np.frombuffer(b"".join(table.column("b").to_pylist()), dtype=np.uint64).reshape(-1, 2)
    n = np.concatenate([_spread(x, np.uint8) for x in table.column("n").to_pylist()]).astype(np.int64)
    order = np.lexsort((key[:, 1], key[:, 0], anchor))
    anchor, key, n = anchor[order], key[order], n[order]
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new = new_anchor | np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
    first, group = np.flatnonzero(new), np.cumsum(new_anchor) - 1
    total = np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(n)]))
    different = np.bincount(group, weights=new)[group]
    hot = (np.bincount(group, weights=n == 0)[group] > 0) | (different > most)
    kind = np.where(total > 1, np.where((different > 1) & new, PARTNER, WHOLE), np.where(different > 1, SINGLE, 0))
    out = np.empty(len(n), dtype=np.uint8)
    out[order] = np.where(hot, STRINGS, kind)
    return _answers(table, part, 0, [len(x) for x in asked], out)


def send_candidates(number: int, block: Block, kinds: np.ndarray, parts: int):
    """The bytes of segments that are compared, and the digests of strings that are counted."""
    rows = np.flatnonzero((kinds == SINGLE) | (kinds == PARTNER))
    one = block.one[rows]
    start, end = block.start[one], block.last[one] + block.length
    head = np.stack([rows, end - start, block.place[one] - start], axis=1).astype(np.int32)

    def cut(i, j):
        text = b"".join([block.data[a:b] for a, b in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)])
        return _squeeze(block.anchors[rows[i:j]]), _squeeze(np.frombuffer(text, np.uint8)), _squeeze(head[i:j])

    yield _rows(number, 1, block.anchors[rows], parts, cut)
    _, key, n, _ = block.strings(kinds)
    yield _rows(number, 2, key[:, 0], parts, lambda i, j: (key[i:j].tobytes(), b"", _squeeze(n[i:j])))


def judge_candidates(part: int, table: pa.Table, length: int):
    """For compared segments the repeated strings, as (row, first, last); for counted strings whether each is repeated."""
    kind = table.column("kind").to_numpy()
    compared, counted = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 2))
    if compared.num_rows:
        anchor = np.concatenate([_spread(x, np.uint64) for x in compared.column("a").to_pylist()])
        data = np.concatenate([_spread(x, np.uint8) for x in compared.column("b").to_pylist()])
        heads = [_spread(x, np.int32).reshape(-1, 3) for x in compared.column("n").to_pylist()]
        row, size, place = np.concatenate(heads).astype(np.int64).T
        start = np.cumsum(size) - size
        strings = size - length + 1
        owner = np.repeat(np.arange(len(row)), strings)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        bucket = mix(anchor[owner] ^ mix((place[owner] - offset).astype(np.uint64)))
        group = equal_groups(Prefix(data), data, start[owner] + offset, bucket, length)
        hit = np.flatnonzero(np.bincount(group)[group] > 1)
        cut = np.flatnonzero((np.diff(owner[hit]) != 0) | (np.diff(offset[hit]) != 1))
        first, last = (hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]]) if len(hit) else (hit, hit)
        told = np.stack([row[owner[first]], offset[first], offset[last]], axis=1).astype(np.int32)
        bound = np.searchsorted(owner[first], np.r_[0, np.cumsum([len(h) for h in heads])])
        for number, a, b in zip(compared.column("block").to_pylist(), bound[:-1], bound[1:], strict=True):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([_squeeze(told[a:b])], pa.binary())], names=["block", "part", "kind", "a"])
    if counted.num_rows:
        asked = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in counted.column("a").to_pylist()]
        key = np.concatenate(asked)
        n = np.concatenate([_spread(x, np.uint8) for x in counted.column("n").to_pylist()]).astype(np.int64)
        order = np.lexsort((key[:, 1], key[:, 0]))
        first = np.flatnonzero(np.r_[True, (key[order[1:]] != key[order[:-1]]).any(axis=1)])
        out = np.empty(len(n), dtype=np.uint8)
        out[order] = np.repeat(np.add.reduceat(n[order], first) > 1, np.diff(np.r_[first, len(n)]))
        yield from _answers(counted, part, 2, [len(x) for x in asked], out)


def _told(answers: pa.Table, kind: int, sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Answers of a kind in the order in which the sorted keys were asked."""
    out = np.zeros(len(sorted_keys), dtype=np.uint8)
    _, at = split_parts(sorted_keys, parts, ranges=True)
    for part, what, a in zip(answers.column("part").to_pylist(), answers.column("kind").to_pylist(), answers.column("a").to_pylist(), strict=True):
        if what == kind:
            out[at[part] : at[part + 1]] = _spread(a, np.uint8)
    return out


def covered(block: Block, answers: pa.Table, parts: int) -> np.ndarray:
    """Which bytes of a block go."""
    kinds = _told(answers, 0, block.anchors, parts)
    steps = np.zeros(len(block.data) + 1, dtype=np.int32)

    def cover(first, last):
        np.add.at(steps, first, 1)
        np.add.at(steps, last + block.length, -1)

    whole = np.isin(kinds[block.row], (WHOLE, PARTNER))
    cover(block.start[whole], block.last[whole])
    for what, a in zip(answers.column("kind").to_pylist(), answers.column("a").to_pylist(), strict=True):
        if what == 1:  # a segment that is not repeated as a whole stands in one place
            row, first, last = _spread(a, np.int32).reshape(-1, 3).astype(np.int64).T
            begin = block.start[block.one[row]]
            cover(begin + first, begin + last)
    at, key, _, back = block.strings(kinds)
    hit = at[_told(answers, 2, key[:, 0], parts)[back] > 0]
    cover(hit, hit)
    return np.cumsum(steps[:-1]) > 0


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR, kept: bool = False, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """One row a text: the id, n_bytes, n_removed, n_spans, kept_sha256, and with ``kept`` the bytes that stay (kept_text, binary)."""
    source = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    texts, total = packed_blocks(source, "__text", block_bytes)
    parts = max(1, -(-total // PART_BYTES))
    id_type = dict(docs.dtypes)[doc_id]
    none = pa.table({"part": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in "abn"}})

    def read(data: bytes) -> tuple[pa.Table, list[bytes]]:
        table = unpack_rows(data)
        return table, texts_of(table.column("__text"))

    def ask(batches):
        for batch in batches:
            for number, data in zip(batch.column("__block").to_pylist(), batch.column("__rows"), strict=True):
                yield ask_segments(number, Block(read(data.as_py())[1], length, k), parts)

    def judge(rule, *more):
        def run(batches):
            for part, table in by_key(batches, "part"):
                yield from rule(part, table, *more)

        return run

    def candidates(left, right):
        if not left.num_rows or not right.num_rows:
            return none
        number, block = left.column("__block")[0].as_py(), Block(read(left.column("__rows")[0].as_py())[1], length, k)
        return pa.Table.from_batches(list(send_candidates(number, block, _told(right, 0, block.anchors, parts), parts)))

    def finish(left, right):
        table, got = read(left.column("__rows")[0].as_py())
        gone = covered(Block(got, length, k), right, parts) if right.num_rows else np.zeros(sum(map(len, got)), bool)
        n, removed, spans, digest, stay, at = [], [], [], [], [], 0
        for t in got:
            mask = gone[at : at + len(t)]
            at += len(t)
            n.append(len(t))
            removed.append(int(mask.sum()))
            spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and mask[0]))
            left_over = t if not removed[-1] else np.frombuffer(t, np.uint8)[~mask].tobytes()
            digest.append(hashlib.sha256(left_over).hexdigest())
            stay.append(left_over if kept else None)
        columns = {doc_id: table.column("__id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(stay, pa.binary())} if kept else {}))

    segments = dealt(texts.mapInArrow(ask, SENT), parts, "part").mapInArrow(judge(judge_segments, hot), BACK)
    sent = texts.groupBy("__block").cogroup(segments.groupBy("block")).applyInArrow(candidates, SENT)
    strings = dealt(sent, parts, "part").mapInArrow(judge(judge_candidates, length), BACK)
    out = f"`{doc_id}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if kept else "")
    return texts.groupBy("__block").cogroup(reduce(DataFrame.unionByName, [segments, strings]).groupBy("block")).applyInArrow(finish, out)
