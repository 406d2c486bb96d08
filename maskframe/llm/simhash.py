"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one node. Nodes are dealt into buckets by bands of their bits: of ``k``
bands, ``radius`` differing bits leave ``k - radius`` at least untouched, so every link meets in
the bucket of some ``k - radius`` bands; ``k`` follows from the number of nodes, as more bands
make more but narrower buckets. Within a bucket nodes are compared in tiles: numpy exclusive-or
and bit counts over a tile pair, which is skipped where the population counts of its tiles differ
by more than the radius. A task returns a spanning forest of what it has linked, never all pairs,
and components come from rounds of star contraction over those edges.

Null texts, empty ones and those without words have fingerprint zero, which links like any
other. Rows link as rows, whatever their ids: a row without an id links others and gets their
component, rows that share an id may lie in different components. A component is named by the
smallest id of its rows, by null if none has one. Repeated rows keep their number. Other columns
are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import join_hot, map_texts, materialize, materialize_at, remove
from maskframe.llm._tokens import SPACED, _U, mix, whole

SEED = 42
TILE = 1024
#: Nodes of a bucket above which it is compared in parts by several tasks.
BUCKET = 16384
#: Bits of a bucket's key below which buckets would be too large to compare.
LEAST_BITS = 10
#: Comparisons of two nodes that cost as much as dealing one node into one more bucket.
ROW_COST = 400


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` lower-cased words, or of all words where they are fewer."""
    found = text.translate(SPACED).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    end = np.cumsum(np.array([len(w) + 1 for w in found]))
    start = np.r_[0, end[:-words]].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(start, (end[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def majority(h: np.ndarray, lanes: int) -> str:
    """Hexadecimal digits of the majority bits (64 a lane) of some hashes."""
    if not len(h):
        return "0" * 16 * lanes
    out = []
    for lane in range(lanes):
        value = mix(h + _U(lane)) if lane else h
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(value), 1 << 16):
            ones += np.unpackbits(value[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes().hex())
    return "".join(out)


def fingerprint(text: bytes, words: int, lanes: int) -> tuple[str, int]:
    """Hexadecimal digits of the majority bits (64 a lane) and the number of shingles."""
    h = shingle_hashes(text, words)
    return majority(h, lanes), len(h)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """id and fingerprint of each text."""
    return map_texts(docs, text, lambda texts: [[fingerprint(t, words, lanes)[0] for t in texts]], T.StructType([T.StructField("fingerprint", T.StringType())]), [doc_id])


def _bits(column: list[str]) -> np.ndarray:
    """Fingerprints as rows of 64-bit lanes."""
    return np.frombuffer(bytes.fromhex("".join(column)), dtype=">u8").astype(np.uint64).reshape(len(column), -1)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives both ends of each pair the same least label, and all they were joined with."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label[:] = jump


def link_tiles(bits: np.ndarray, half: int | None, radius: int, size: np.ndarray | None = None, ratio: float = 0, tile: int = TILE) -> np.ndarray:
    """Least linked place for each row of ``bits``: within all, or with ``half`` across rows before and from it.

    With ``size``, only places whose sizes lie within a factor of ``ratio`` are linked. What lies
    near one row in the middle is linked through it first and not compared among itself, so a
    large group of near copies costs no square of its size.
    """
    label, n = np.arange(len(bits)), len(bits)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    cut = n if half is None else half
    loose = np.ones(n, dtype=bool)

    def alike(i, j):
        return True if size is None else np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])

    def near(i: int, places: np.ndarray) -> np.ndarray:
        return places[(np.bitwise_count(bits[places] ^ bits[i]).sum(axis=1, dtype=np.int64) <= radius) & alike(places, i)]

    if n > 2 * tile and cut:
        middle = int(np.argsort(ones[:cut], kind="stable")[cut // 2])
        far = near(middle, np.arange(0 if half is None else cut, n))
        own = far[:0] if half is None or not len(far) else near(int(far[0]), np.arange(cut))
        _join(label, np.full(len(far), middle), far)
        _join(label, own, np.full(len(own), far[0] if len(own) else 0))
        loose[far] = loose[own] = False

    def compare(left: np.ndarray, right: np.ndarray, same: bool) -> None:
        left = left[np.argsort(ones[left], kind="stable")]
        right = left if same else right[np.argsort(ones[right], kind="stable")]
        for a in range(0, len(left), tile):
            rows = left[a : a + tile]
            for b in range(a if same else 0, len(right), tile):
                columns = right[b : b + tile]
                if ones[columns[0]] - ones[rows[-1]] > radius:
                    break  # and so do all tiles beyond
                if ones[rows[0]] - ones[columns[-1]] > radius:
                    continue
                differ = np.zeros((len(rows), len(columns)), dtype=np.uint16)
                for lane in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[rows, lane][:, None] ^ bits[columns, lane][None, :])
                i, j = np.nonzero(differ <= radius)
                i, j = rows[i], columns[j]
                if size is not None:
                    good = alike(i, j)
                    i, j = i[good], j[good]
                _join(label, i, j)

    place = np.arange(n)
    if half is None:
        compare(place[loose], place[loose], True)
        compare(place[loose], place[~loose], False)
    else:
        compare(place[:cut][loose[:cut]], place[cut:], False)
        compare(place[:cut][~loose[:cut]], place[cut:][loose[cut:]], False)
    return label


def _forest(node: np.ndarray, label: np.ndarray):
    at = np.flatnonzero(label != np.arange(len(label)))
    a, b = node[at], node[label[at]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])


def bands_for(n: int, radius: int, bits: int) -> int:
    """The number of bands that makes dealing and comparing ``n`` nodes cheapest, exact for ``radius`` in any case."""

    def cost(k: int) -> float:
        return comb(k, radius) * (n * ROW_COST + n * n / 2.0 ** (bits * (k - radius) // k))

    able = [k for k in range(radius + 1, radius + 6) if bits * (k - radius) // k >= LEAST_BITS]
    if not able:
        raise ValueError(f"a radius of {radius} in {bits} bits leaves no band of {LEAST_BITS} bits")
    return min(able, key=cost)


def band_keys(bits: np.ndarray, radius: int, bands: int) -> np.ndarray:
    """The bucket of each row (first axis) for each choice of ``bands - radius`` bands."""
    flat = np.unpackbits(bits.astype(">u8").view(np.uint8).reshape(len(bits), -1), axis=1)
    cut = [round(flat.shape[1] * i / bands) for i in range(bands + 1)]
    value = [mix((flat[:, a:b].astype(_U) << np.arange(b - a, dtype=_U)).sum(axis=1, dtype=_U)) for a, b in zip(cut, cut[1:], strict=False)]
    keys = []
    for i, chosen in enumerate(combinations(range(bands), bands - radius)):
        key = np.full(len(bits), i, dtype=_U)
        for band in chosen:
            key = mix(key * _U(0x9E3779B97F4A7C15) ^ value[band])
        keys.append(key.view(np.int64))
    return np.stack(keys, axis=1) if len(bits) else np.zeros((0, comb(bands, radius)), np.int64)


def in_bands(nodes: DataFrame, radius: int, n: int, bits: int) -> DataFrame:
    """(bucket, node, fingerprint) of ``n`` nodes for each bucket that they fall into."""
    bands = bands_for(n, radius, bits)

    def run(batches):
        for batch in batches:
            keys = band_keys(_bits(batch.column("fingerprint").to_pylist()) if batch.num_rows else np.zeros((0, bits // 64), _U), radius, bands)
            at = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), batch.column("node").take(pa.array(at)), batch.column("fingerprint").take(pa.array(at))], names=["bucket", "node", "fingerprint"])

    return nodes.select("node", "fingerprint").mapInArrow(run, "bucket long, node long, fingerprint string")


def link_buckets(rows: DataFrame, radius: int, ratio: float = 0) -> DataFrame:
    """Edges (a, b) between nodes of a bucket (bucket, node, fingerprint, and n_shingles with a ``ratio``) that differ in ``radius`` bits at most."""
    size = ["n_shingles"] if ratio else []
    rows = materialize(rows.select("bucket", "node", "fingerprint", *size), "buckets")
    n = max(1, rows.count() // 50_000)
    large = rows.groupBy("bucket").count().filter(F.col("count") > BUCKET).select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("cuts"))
    # A large bucket falls into cuts; a cell is a pair of them, and a row goes to each cell of its cut.
    cuts = F.coalesce("cuts", F.lit(1))
    mine = F.pmod(F.xxhash64("node"), cuts).cast("int")
    dealt = rows.join(large, "bucket", "left").select("node", "fingerprint", *size, "bucket", mine.alias("mine"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
    dealt = dealt.select("node", "fingerprint", *size, "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("low"))

    def run(batches):
        table = whole(batches)
        if table is None:
            return
        node, bucket, i, j, low, *n_shingles = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "bucket", "i", "j", "low", *size))
        order = np.lexsort((~low, j, i, bucket))
        bucket, i, j = bucket[order], i[order], j[order]
        cell = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        end = np.r_[cell[1:], len(bucket)]
        for a, b in zip(cell[end - cell > 1].tolist(), end[end - cell > 1].tolist(), strict=True):
            at = order[a:b]
            half = int(low[at].sum()) if i[a] != j[a] else None
            label = link_tiles(_bits(table.column("fingerprint").take(pa.array(at)).to_pylist()), half, radius, n_shingles[0][at] if size else None, ratio)
            out = _forest(node[at], label)
            if out.num_rows:
                yield out

    return dealt.repartition(n, "bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots: the least node that it reaches, by large and small stars in turn.

    A node with a great many neighbours is a hot key of both joins, which ``join_hot`` spreads.
    """
    spark = edges.sparkSession
    current, path = materialize_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        total = 2 * current.count()
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, "a", "n", total).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "a", "n", total).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        before, (current, path) = path, materialize_at(small, "edges")
        remove(spark, before)
        # Done when every node hangs on one root that itself hangs on none.
        roots = current.select(F.col("b").alias("a")).distinct()
        open_ = current.join(roots, "a", "left_semi").limit(1).count() or current.groupBy("a").count().filter("count > 1").limit(1).count()
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, lanes: int = 1) -> DataFrame:
    """id, fingerprint and component_id (the smallest id reachable over links) of each text.

    A radius that leaves no band of LEAST_BITS bits is refused.
    """
    bands_for(1, radius, 64 * lanes)
    marks = materialize(fingerprints(docs, doc_id, text, words, lanes).withColumnRenamed(doc_id, "__id"), "fingerprints")
    nodes = marks.groupBy("fingerprint").agg(F.min("__id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    roots = materialize(components(link_buckets(in_bands(nodes, radius, nodes.count(), 64 * lanes), radius)), "roots")
    hung = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = hung.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("hung"))
    named = join_hot(hung.select("root", "fingerprint", "n"), names, "root", "hung").select("fingerprint", "n", "component_id")
    return join_hot(marks.select("__id", "fingerprint"), named, "fingerprint", "n").select(F.col("__id").alias(doc_id), "fingerprint", "component_id")
