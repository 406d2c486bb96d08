"""Words and their hashes as arrays, a chunk of texts at once.

A hash is 64 bits of a polynomial over random byte values, mixed; it is the same in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm._common import LOWER, chunks

_U = np.uint64
_Q = _U(0x9E3779B97F4A7C15)
#: A random value for each byte, the same everywhere.
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 64, 256, dtype=np.uint64)
#: A-Z in lower case, ASCII white space as a blank.
SPACED = bytes(32 if c in b"\t\n\v\f\r " else LOWER[c] for c in range(256))
_SLICE = 1 << 20
#: Tasks of a shuffle at most; a task beyond takes several keys, one after another.
MOST_TASKS = 20_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over the whole word."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(29))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


class Words:
    """The words of some texts: ``start``, ``end`` in ``data``, and ``first`` (a text's words are first[i]:first[i+1])."""

    def __init__(self, texts: list[bytes], table: bytes = SPACED):
        self.data = b" ".join([*texts, b""]).translate(table)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.zeros(len(self.bytes) + 1, dtype=bool)
        inside[1:] = self.bytes != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        begin = np.r_[0, np.cumsum(sizes)] if len(sizes) else np.zeros(1, np.int64)
        self.first = np.searchsorted(self.start, begin)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), dtype=np.uint64)
        size = self.end - self.start
        total = np.r_[0, np.cumsum(size)]
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(total, total[at] + _SLICE)) - 1)
            n = size[at:to]
            offset = total[at:to] - total[at]
            place = np.arange(int(n.sum())) - np.repeat(offset, n)
            value = BYTE_VALUE[self.bytes[place + np.repeat(self.start[at:to], n)]]
            powers = np.full(int(n.max()), _Q)
            powers[0] = 1
            out[at:to] = np.add.reduceat(value * np.multiply.accumulate(powers)[place], offset)
            at = to
        return mix(out)


def packed_blocks(rows: DataFrame, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` as they lie, packed into blocks of about ``block_bytes`` of text (a longer text stands alone): (__block, __rows).

    Also returns the bytes of all texts. A block is named by its place, so rows that repeat a great
    many times fall into many blocks; where ``rows`` are read from files, a lost task makes the
    same blocks again.
    """
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0

    def run(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack_rows(table)], pa.binary())], names=["__block", "__rows"])

        for batch in chunks(batches, text, block_bytes):
            n = batch.column(text).nbytes
            if held and size + n > block_bytes:
                yield flush()
                held, size, number = [], 0, number + 1
            held.append(batch)
            size += n
        if held:
            yield flush()

    blocks = max(1, -(-total // block_bytes))
    packed = rows.mapInArrow(run, "__block long, __rows binary")
    return packed.repartition(min(blocks, MOST_TASKS), "__block"), total


def pack_rows(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def dealt(rows: DataFrame, parts: int, key: str) -> DataFrame:
    """``rows`` dealt to the owners of ``key``, in runs of it."""
    return rows.repartition(min(parts, MOST_TASKS), key).sortWithinPartitions(key)


def by_key(batches, key: str):
    """(key, rows) of a task whose rows are sorted by ``key``; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else values
        for a, b in zip(cuts, np.r_[cuts[1:], len(values)], strict=False):
            if held and values[a] != last:
                yield int(last), pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(last), pa.Table.from_batches(held)


def whole(batches) -> pa.Table | None:
    """All batches of a task as a table; None if it has no rows."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def split_parts(keys: np.ndarray, parts: int, ranges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys`` (uint64) by part and key, and where each part starts in it (parts + 1).

    ``ranges``: parts are ranges of keys, for keys that are spread evenly.
    """
    part = ((keys >> _U(32)) * _U(parts)) >> _U(32) if ranges else (keys >> _U(33)) % _U(parts)
    order = np.argsort(keys, kind="stable") if ranges else np.lexsort((keys, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of 8 bytes, their first bytes together, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
