"""Near-duplicates by the exact Jaccard similarity of shingle sets.

Texts with the same set of shingles are one node. Bands of least hashes (MinHash) of the sets deal
the nodes into buckets; in a bucket fingerprints of the sets are compared in tiles as in
``simhash``, and nodes that differ in ``radius`` bits at most are proposed as links. The shingle
sets of a group of proposed links then meet in one task, or in one for each pair of its cuts where
it is large, and every pair within the radius is compared there; only a pair that verified links
already join is passed over. Links, and so components, come from verified pairs alone.

Sets are compared by the XXH64 of their shingles. Texts without words share the empty set. Rows
link as rows, whatever their ids, which may be null or repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import join_hot, map_texts, materialize
from maskframe.llm._tokens import _U, mix, whole
from maskframe.llm.simhash import _bits, _forest, _join, components, link_buckets, majority, shingle_hashes

#: Nodes and shingles of a group above which it is compared in cuts by several tasks.
GROUP, GROUP_SHINGLES = 2048, 1 << 20
#: Bands and least hashes in each: sets of 0.8 similarity share no band with a chance of 1 in 4,600.
BANDS, ROWS = 16, 4


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A bucket for each set (first axis) and band: a hash of the ``rows`` least hashes of its shingles."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    full = np.flatnonzero(size)
    keys = np.zeros((bands, len(sets)), dtype=_U)
    if len(full):
        flat = mix(np.concatenate([sets[i] for i in full]))
        start = np.cumsum(size[full]) - size[full]
        draw = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, bands * rows, dtype=_U) << _U(1) | _U(1)
        for band in range(bands):
            key = np.full(len(full), band + 1, dtype=_U)
            for factor in draw[band * rows : (band + 1) * rows]:
                value = flat * factor
                key = mix(key * _U(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(value ^ value >> _U(32), start))
            keys[band, full] = key
    return keys.T.view(np.int64)


def _sets(rows: DataFrame, doc_id: str, text: str, row: str, words: int, lanes: int) -> DataFrame:
    """id, row, digest of the shingle set, its fingerprint, size and buckets, of each text."""

    def work(texts):
        sets = [np.unique(shingle_hashes(t, words)) for t in texts]
        return [[xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [majority(h, lanes) for h in sets], [len(h) for h in sets], list(band_keys(sets))]

    new = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
    return map_texts(rows, text, work, new, [doc_id, row])


def link_sets(bits: np.ndarray, sets: list[np.ndarray], radius: int, least: float, half: int | None = None) -> np.ndarray:
    """Least place linked with each, over pairs of ``radius`` bits at most whose Jaccard similarity is ``least`` or more.

    With ``half``, only pairs across it are compared.
    """
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets], dtype=np.int64)
    start = np.r_[0, np.cumsum(size)]
    shingles, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    held = np.zeros(len(shingles), dtype=bool)
    for i in range(len(sets) if half is None else half):
        j = np.arange(i + 1 if half is None else half, len(sets))
        j = j[(label[j] != label[i]) & (np.minimum(size[j], size[i]) + 1e-9 >= least * np.maximum(size[j], size[i]))]
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(j):
            continue
        own = flat[start[i] : start[i + 1]]
        held[own] = True
        both = np.array([np.count_nonzero(held[flat[start[k] : start[k + 1]]]) for k in j.tolist()], dtype=np.int64)
        held[own] = False
        alike = j[both + 1e-9 >= least * (size[i] + size[j] - both)]
        _join(label, np.full(len(alike), i), alike)
    return label


def _verified(groups: DataFrame, rows: DataFrame, text: str, row: str, words: int, radius: int, least: float) -> DataFrame:
    """Edges of verified pairs of the nodes (node, row, fingerprint, n_shingles, root) of each group."""
    counts = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("int").alias("cuts"))
    counts = materialize(counts, "groups")
    large = counts.filter("cuts > 1")
    # A large group falls into cuts; a cell is a pair of them, and a node goes to each cell of its cut.
    cuts = F.coalesce("cuts", F.lit(1))
    picked = groups.join(large, "root", "left").select(row, "node", "fingerprint", "n_shingles", "root", cuts.alias("cuts"), F.pmod(F.xxhash64("fingerprint", "node"), cuts).cast("int").alias("mine"))
    total = picked.agg(F.sum(F.col("n_shingles") * F.col("cuts"))).first()[0] or 0
    texts = rows.select(row, text).join(picked, row)
    shingles = map_texts(texts, text, lambda t: [[np.unique(shingle_hashes(x, words)).tobytes() for x in t]], T.StructType([T.StructField("shingles", T.BinaryType())]), ["node", "fingerprint", "root", "cuts", "mine"])
    dealt = shingles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("node", "fingerprint", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("low"), "shingles")

    def run(batches):
        table = whole(batches)
        if table is None:
            return
        bits = _bits(table.column("fingerprint").to_pylist())
        node, root, i, j, low = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "i", "j", "low"))
        sets = table.column("shingles")
        order = np.lexsort((~low, j, i, root))
        node, bits, root, i, j, low = node[order], bits[order], root[order], i[order], j[order], low[order]
        cell = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for a, b in zip(cell, np.r_[cell[1:], len(root)], strict=True):
            if b - a > 1:
                own = [np.frombuffer(sets[k].as_py(), dtype=np.uint64) for k in order[a:b].tolist()]
                out = _forest(node[a:b], link_sets(bits[a:b], own, radius, least, int(low[a:b].sum()) if i[a] != j[a] else None))
                if out.num_rows:
                    yield out

    return dealt.repartition(max(1, total // (2 * GROUP_SHINGLES)), "root", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(rows: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", words: int = 5, radius: int = 72, lanes: int = 4, least: float = 0.8) -> DataFrame:
    """The groups of ``rows``: (node, component), a row number for each different set of shingles and one for its group.

    ``row`` numbers ``rows``, which must be materialized. Both numbers are those of the row with
    the smallest id (rows without one come last), and of these the smallest number.
    """
    marks = materialize(_sets(rows, doc_id, text, row, words, lanes), "sets")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(row).alias("node"), "fingerprint", "n_shingles", "buckets"))
    nodes = materialize(marks.groupBy("digest").agg(first.alias("x")).select("x.*"), "nodes")
    # Sizes of sets of 0.8 similarity lie within that factor; a hair less, as it is compared in floating point.
    proposed = components(link_buckets(nodes.select(F.explode("buckets").alias("bucket"), "node", "fingerprint", "n_shingles"), radius, least - 1e-9))
    members = proposed.unionByName(proposed.select(F.col("root").alias("node"), "root").distinct())  # roots are not listed
    groups = materialize(nodes.select(F.col("node").alias(row), "node", "fingerprint", "n_shingles").join(members, "node"), "proposed")
    roots = materialize(components(_verified(groups, rows, text, row, words, radius, least)), "roots")
    hung = nodes.select("no_id", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = hung.groupBy("root").agg(F.min(F.struct("no_id", "id", "node"))["node"].alias("component"), F.count("*").alias("n"))
    return join_hot(hung.select("node", "root"), heads, "root", "n").select("node", "component")
