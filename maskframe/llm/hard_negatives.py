"""Hard-negative mining over k-means inverted lists with stored centroid radii.

Components become whole numbers (floor(scale * x)) and scores whole inner products. Equal vectors of a
label are one entry that keeps the few smallest ids any answer can name, so a vector that a third of
all rows share is one entry too. Entries are dealt to the nearest of k centroids (fit on a bounded
sample; every entry is indexed), and each list stores its radius. For an anchor q, a list with
centroid c and radius r holds scores from q.c - |q| r to q.c + |q| r only (Cauchy-Schwarz). Lists are
visited by their upper bound: the first few in one round, whose k-th score is the bar for the second;
lists that can't reach the window are skipped, and a list is left out as soon as its upper bound lies
strictly below the k-th score (at equality a smaller id may still win). So the answer is exact, for any
centroids: recall is 1.

Lists lie on shelves of about ``SHELF`` entries (a longer list takes several); a task holds one shelf and
streams the anchors that visit it, and hands on k rows for each of them. Where bounds rule out little
(random vectors), the work is anchors times entries, in blocks.

Rows with a null label or vector, or any null or non-finite component, take no part. Rows that repeat
are rows of their own (an anchor leaves out one occurrence of itself). A null id comes last among
ties and is no anchor. Shorter vectors count as padded with zeros; components beyond 2^26 in size
stop there. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm._common import join_hot, materialize

SCALE, LIMIT = 256, 1 << 26
#: Lists at most, and rows of the sample that centroids are fit on for each.
MOST_LISTS, SAMPLE_PER_LIST, ITERATIONS = 4096, 16, 8
SHELF = 16_384
#: Lists that an anchor visits in the first round.
FIRST_LISTS = 4
#: Scores that a task holds at once.
CELLS = 1 << 22
#: Anchors on one copy of a shelf.
ANCHORS_PER_COPY = 1 << 20
_NO_ID = (1 << 63) - 1
_LOW, _HIGH = -(1 << 62), 1 << 62


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * F.lit(float(scale))))).cast("int"))


def usable(label: Column, vector: Column) -> Column:
    return label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _packed(values: np.ndarray) -> bytes:
    """The one way to write a vector: 16 bits a component where all fit, 32 otherwise."""
    small = not len(values) or (values.min() >= -32768 and values.max() <= 32767)
    return b"\x02" + values.astype("<i2").tobytes() if small else b"\x04" + values.astype("<i4").tobytes()


def _packed_rows(column: pa.Array) -> list[bytes]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [_packed(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    if rows and all(len(r) == 1 + 2 * dim and r[0] == 2 for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)[:, 1:].copy().view("<i2").astype(np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, dtype="<i2" if r[0] == 2 else "<i4", offset=1)
        out[i, : len(v)] = v
    return out


def kmeans(points: np.ndarray, k: int, seed: int = 17) -> np.ndarray:
    """Centroids of a sample."""
    points = np.unique(points, axis=0).astype(np.float64)
    draw = np.random.default_rng(seed)
    centroids = points[draw.permutation(len(points))[:k]].copy()
    for _ in range(ITERATIONS):
        near = nearest(points, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, points)
        some = counts > 0
        centroids[some] = sums[some] / counts[some, None]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int32)
    half, step = (centroids**2).sum(1) / 2, max(1, CELLS // len(centroids))
    for a in range(0, len(points), step):
        out[a : a + step] = (points[a : a + step] @ centroids.T - half).argmax(1)
    return out


class Lists:
    """Inverted lists over entries: centroids, radii, and where each list lies."""

    def __init__(self, entries: DataFrame, centroids: np.ndarray, radius: np.ndarray, sizes: np.ndarray, dim: int, most: int):
        self.entries, self.centroids, self.radius, self.dim = entries, centroids, radius, dim
        self.copies = 1  # of each shelf, set by the number of anchors
        self.first = np.zeros(len(sizes), dtype=np.int64)
        self.span = np.maximum(1, -(-sizes // SHELF))
        shelf, room = 0, 0
        for c, n in enumerate(sizes):
            if room and room + n > SHELF:
                shelf, room = shelf + 1, 0
            self.first[c] = shelf
            if n >= SHELF:
                shelf, room = shelf + int(self.span[c]), 0
            else:
                room += int(n)
        self.shelves = shelf + 1
        # Products are exact in the narrowest type that holds any of their sums.
        bound = dim * most * most
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores that each list can hold, with room for rounding."""
        a = anchors.astype(np.float64)
        size = np.sqrt((a**2).sum(1))[:, None]
        middle = a @ self.centroids.T
        reach = size * self.radius * (1 + 1e-9) + 1e-9 * size * np.sqrt((self.centroids**2).sum(1)) + 1e-6
        return middle - reach, middle + reach

    def without_frame(self) -> Lists:
        """What tasks need."""
        out = object.__new__(Lists)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "entries"}
        return out


def entries(rows: DataFrame, vec_id: str, vector: str, label: str, anchor: Column, depth: int) -> DataFrame:
    """(label, v, ids, n_anchors): equal vectors of a label as one row with its ``depth`` smallest ids."""
    anchors = F.coalesce(anchor, F.lit(False))
    used = rows.filter(usable(F.col(label), F.col(vector))).select(F.col(label).cast("long").alias("label"), whole_numbers(F.col(vector)).alias("q"), F.coalesce(F.col(vec_id).cast("long"), F.lit(_NO_ID)).alias("id"), anchors.alias("anchor"))

    def run(batches):
        for batch in batches:
            got: dict[tuple[int, bytes], list] = {}
            for lab, v, i, is_anchor in zip(batch.column("label").to_pylist(), _packed_rows(batch.column("q")), batch.column("id").to_pylist(), batch.column("anchor").to_pylist(), strict=True):
                held = got.setdefault((lab, v), [0])
                held[0] += is_anchor
                held.append(i)
            keys = list(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array([sorted(got[k][1:])[:depth] for k in keys], pa.list_(pa.int64())), pa.array([got[k][0] for k in keys], pa.int64())],
                names=["label", "v", "ids", "n_anchors"],
            )

    partly = used.mapInArrow(run, "label long, v binary, ids array<long>, n_anchors long")
    # A vector has a row of ``depth`` ids for each batch that holds it.
    return partly.groupBy("label", "v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, depth).alias("ids"), F.sum("n_anchors").alias("n_anchors"))


def index(rows: DataFrame, vec_id: str, vector: str, label: str, anchor: Column, depth: int, lists: int | None = None) -> Lists | None:
    """Lists over all rows; None without any."""
    used = rows.filter(usable(F.col(label), F.col(vector)))
    q = whole_numbers(F.col(vector))
    n, dim, most = used.agg(F.count("*"), F.max(F.size(q)), F.max(F.greatest(F.coalesce(F.array_max(q), F.lit(0)), -F.coalesce(F.array_min(q), F.lit(0))))).first()
    if not n:
        return None
    dim = max(1, dim)
    k = lists or max(1, min(MOST_LISTS, (1 << 22) // dim, round(math.sqrt(n))))
    # The sample is bounded by the number of lists, whatever the number of rows.
    thin = max(1, n // (k * SAMPLE_PER_LIST))
    drawn = used.filter(F.pmod(F.xxhash64(F.col(vec_id), F.col(label)), F.lit(thin)) == 0).select(q.alias("q")).distinct().limit(k * SAMPLE_PER_LIST).collect()
    points = np.zeros((max(1, len(drawn)), dim))
    for i, r in enumerate(drawn):
        points[i, : len(r.q)] = r.q
    centroids = kmeans(points, k)

    def place(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dim)
            near = nearest(x.astype(np.float64), centroids)
            far = np.sqrt(((x - centroids[near]) ** 2).sum(1))
            columns = [pa.array(number + np.arange(len(x))), pa.array(near), pa.array(far), pa.array((x**2).sum(1))]
            number += len(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "entry", "list", "far", "norm"])

    schema = "label long, v binary, ids array<long>, n_anchors long, entry long, list int, far double, norm long"
    placed = materialize(entries(rows, vec_id, vector, label, anchor, depth).mapInArrow(place, schema), "entries")
    # One row a list.
    radius, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in placed.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r.list], sizes[r.list] = r.far * (1 + 1e-9) + 1e-9, r.n
    out = Lists(placed, centroids, radius, sizes, dim, most)
    out.copies = max(1, -(-placed.filter("n_anchors > 0").count() // ANCHORS_PER_COPY))
    return out


_VISIT = "anchor long, label long, v binary, lo array<long>, hi array<long>, bar array<long>, tried array<int>, shelf long"


def _visits(lists: Lists, anchors: DataFrame, first: bool) -> DataFrame:
    """Which shelves each anchor (anchor, label, v, lo, hi, bar, tried) visits: those of its ``FIRST_LISTS`` best lists, or of all others within reach."""
    small = lists.without_frame()

    def run(batches):
        for whole in batches:
            step = max(1, CELLS // len(small.radius))
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                low, high = small.bounds(_matrix(batch.column("v").to_pylist(), small.dim))
                lo, hi, bar = (_padded(batch.column(c).to_pylist(), empty) for c, empty in (("lo", 1), ("hi", 0), ("bar", 1)))
                reach = np.zeros(low.shape, dtype=bool)
                for w in range(lo.shape[1]):
                    floor = np.maximum(lo[:, w], bar[:, w])[:, None]
                    reach |= (high >= floor) & (low <= hi[:, w][:, None]) & (lo[:, w] <= hi[:, w])[:, None]
                tried = batch.column("tried").to_pylist()
                if first:
                    best = np.argsort(np.where(reach, -high, np.inf), axis=1, kind="stable")[:, :FIRST_LISTS]
                    tried = [[int(c) for c in row if reach[i, c]] for i, row in enumerate(best)]
                    reach[:] = False
                    for i, cs in enumerate(tried):
                        reach[i, cs] = True
                else:
                    for i, cs in enumerate(tried):
                        reach[i, cs] = False
                who, which = np.nonzero(reach)
                span = small.span[which]
                who = np.repeat(who, span)
                shelf = np.repeat(small.first[which], span) + np.arange(len(who)) - np.repeat(np.cumsum(span) - span, span)
                pairs = np.unique(np.stack([who, shelf]), axis=1) if len(who) else np.zeros((2, 0), np.int64)
                taken = batch.take(pa.array(pairs[0]))
                columns = [taken.column(c) for c in ("anchor", "label", "v", "lo", "hi", "bar")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([tried[i] for i in pairs[0]], pa.list_(pa.int32())), pa.array(pairs[1].astype(np.int64))], names=[f.split()[0] for f in _VISIT.split(", ")])

    return anchors.select("anchor", "label", "v", "lo", "hi", "bar", "tried").mapInArrow(run, _VISIT)


def _padded(rows: list, empty: int) -> np.ndarray:
    width = max([1, *map(len, rows)])
    return np.array([list(r) + [empty] * (width - len(r)) for r in rows], dtype=np.int64).reshape(len(rows), width)


def _search(lists: Lists, visits: DataFrame, same_label: bool, depth: int, first: bool) -> DataFrame:
    """(anchor, hi, score, id): the ``depth`` best of each shelf for each anchor and window."""
    small = lists.without_frame()
    copies = lists.copies
    # One row a list, at most MOST_LISTS.
    where = [(c, int(f), int(n)) for c, (f, n) in enumerate(zip(small.first, small.span, strict=True))]
    places = lists.entries.sparkSession.createDataFrame(where, "list int, first long, span long")
    stock = lists.entries.join(F.broadcast(places), "list")
    none, kind = F.lit(None), "array<long>"
    stock = stock.select((F.col("first") + F.pmod(F.xxhash64("entry"), F.col("span"))).alias("shelf"), F.lit(0).alias("kind"), F.col("entry").alias("id"), "label", "v", "ids", "list", *[none.cast(kind).alias(c) for c in ("lo", "hi", "bar")], none.cast("array<int>").alias("tried"))
    stock = stock.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 1 else stock.withColumn("copy", F.lit(0))
    calls = visits.select("shelf", F.lit(1).alias("kind"), F.col("anchor").alias("id"), "label", "v", none.cast(kind).alias("ids"), none.cast("int").alias("list"), "lo", "hi", "bar", "tried", F.pmod(F.xxhash64("anchor"), F.lit(copies)).cast("int").alias("copy"))
    parts = min(20_000, small.shelves * copies)
    dealt = stock.unionByName(calls).repartition(parts, "shelf", "copy").sortWithinPartitions("shelf", "copy", "kind", "list")

    def run(batches):
        held, key, shelf = [], None, None
        for batch in batches:
            place = np.stack([batch.column("shelf").to_numpy(), batch.column("copy").to_numpy(), batch.column("kind").to_numpy()], axis=1)
            cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)]) if len(place) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(place)].astype(int), strict=False):
                part, now = batch.slice(a, b - a), tuple(place[a, :2])
                if place[a, 2] == 0:
                    held, key = ([*held, part] if key == now else [part]), now
                    shelf = None
                elif key == now:  # anchors whose shelf is empty find nothing
                    shelf = shelf or _Shelf(small, held)
                    yield from shelf.answers(part, same_label, depth, first)

    return dealt.mapInArrow(run, "anchor long, hi long, score long, id long")


class _Shelf:
    """The entries of a shelf, list by list."""

    def __init__(self, lists: Lists, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.lists = lists
        self.x = _matrix(table.column("v").to_pylist(), lists.dim).astype(lists.kind)
        self.label = table.column("label").to_numpy()
        of = table.column("list").to_numpy()
        self.ids = table.column("ids").to_pylist()
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        self.runs = [(int(of[a]), int(a), int(b)) for a, b in zip(cuts, np.r_[cuts[1:], len(of)], strict=True)]

    def answers(self, calls: pa.RecordBatch, same_label: bool, depth: int, first: bool):
        longest = max(b - a for _, a, b in self.runs)
        step = max(1, CELLS // max(longest, len(self.lists.radius)))
        for at in range(0, calls.num_rows, step):
            yield self._answers(calls.slice(at, step), same_label, depth, first)

    def _answers(self, calls: pa.RecordBatch, same_label: bool, depth: int, first: bool) -> pa.RecordBatch:
        anchors = _matrix(calls.column("v").to_pylist(), self.lists.dim)
        low, high = self.lists.bounds(anchors)
        anchors = anchors.astype(self.lists.kind)
        label = calls.column("label").to_numpy()
        lo, hi, bar = (_padded(calls.column(c).to_pylist(), empty) for c, empty in (("lo", 1), ("hi", 0), ("bar", 1)))
        bar = np.maximum(lo, bar)
        tried = calls.column("tried").to_pylist()
        may = np.full(high.shape, not first)
        for i, cs in enumerate(tried):
            may[i, cs] = first
        windows = lo.shape[1]
        exact = np.int64 if self.lists.kind == np.int64 else np.float64
        best = np.full((len(anchors), windows, depth), _LOW, dtype=exact)
        found: list[tuple[np.ndarray, ...]] = []
        for c, a, b in sorted(self.runs, key=lambda r: -high[:, r[0]].max()):
            # A list goes once its upper bound lies strictly below the k-th score of each window.
            open_ = (high[:, c][:, None] >= bar) & (low[:, c][:, None] <= hi) & (lo <= hi)
            who = np.flatnonzero(open_.any(1) & may[:, c])
            if not len(who):
                continue
            scores = (anchors[who] @ self.x[a:b].T).astype(exact)
            fits = (self.label[a:b] == label[who][:, None]) == same_label
            for w in range(windows):
                ok = fits & (scores >= bar[who, w][:, None]) & (scores <= hi[who, w][:, None])
                some = np.flatnonzero(ok.any(1))
                if not len(some):
                    continue
                mine = np.where(ok[some], scores[some], exact(_LOW))
                top = np.partition(mine, max(0, mine.shape[1] - depth), axis=1)[:, -depth:]
                merged = np.sort(np.concatenate([best[who[some], w], top], axis=1), axis=1)[:, -depth:]
                best[who[some], w] = merged
                full = merged[:, 0] > _LOW
                bar[who[some], w] = np.where(full, np.maximum(bar[who[some], w], np.where(full, merged[:, 0], 0).astype(np.int64)), bar[who[some], w])
                r, e = np.nonzero(ok[some] & (mine >= bar[who[some], w][:, None]))
                found.append((who[some][r], np.full(len(r), w), a + e, mine[r, e].astype(np.int64)))
        names = ["anchor", "hi", "score", "id"]
        if not found:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        who, window, entry, score = (np.concatenate(c) for c in zip(*found, strict=True))
        stay = score >= bar[who, window]
        who, window, entry, score = who[stay], window[stay], entry[stay], score[stay]
        ids = [self.ids[e] for e in entry]
        count = np.array([len(i) for i in ids], dtype=np.int64)
        who, window, score = np.repeat(who, count), np.repeat(window, count), np.repeat(score, count)
        ids = np.array([i for some in ids for i in some], dtype=np.int64)
        order = np.lexsort((ids, -score, window, who))
        who, window, score, ids = who[order], window[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (window[1:] != window[:-1])]) if len(who) else np.zeros(0, np.int64)
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
        top = rank < depth
        who, window = who[top], window[top]
        return pa.RecordBatch.from_arrays([pa.array(calls.column("id").to_numpy()[who]), pa.array(hi[who, window]), pa.array(score[top]), pa.array(ids[top])], names=names)


def _best(hits: DataFrame, depth: int) -> DataFrame:
    order = Window.partitionBy("anchor", "hi").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def search(lists: Lists, anchors: DataFrame, same_label: bool, depth: int) -> DataFrame:
    """The best ``depth`` rows for each anchor (anchor, label, v) and window of scores (lo, hi: arrays): (anchor, hi, score, id, rank)."""
    none = F.array().cast("array<int>")
    asked = anchors.withColumns({"bar": F.col("lo"), "tried": none})
    calls = materialize(_visits(lists, asked, True), "first-visits")
    found = materialize(_best(_search(lists, calls, same_label, depth, True), depth), "first-answers")
    # The k-th score so far, where there are k.
    bars = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.when(F.col("rank") == depth, F.struct("hi", "score")))).alias("bars"))
    tried = calls.groupBy("anchor").agg(F.first("tried").alias("tried"))
    later = anchors.join(tried, "anchor", "left").join(bars, "anchor", "left")
    bar = F.transform(F.arrays_zip("lo", "hi"), lambda w: F.coalesce(F.element_at("bars", w["hi"]), w["lo"]))
    later = later.withColumns({"tried": F.coalesce("tried", none), "bar": F.when(F.col("bars").isNull(), F.col("lo")).otherwise(bar)})
    rest = _search(lists, _visits(lists, later, False), same_label, depth, False)
    return _best(found.drop("rank").unionByName(rest), depth)


def mine(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, lists: int | None = None) -> DataFrame:
    """Anchors (ids divisible by ``every``), their best rows of the label, and for each the best rows of other labels that score ``least`` to 100 percent of it.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    plain = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    is_anchor = F.col("vec_id") % every == 0
    depth = max(positives + 1, negatives)
    at = index(plain, "vec_id", "vector", "label", is_anchor, depth, lists)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if at is None:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = at.entries.filter("n_anchors > 0").select(F.col("entry").alias("anchor"), "label", "v")
    everything = {"lo": F.array(F.lit(_LOW).cast("long")), "hi": F.array(F.lit(_HIGH).cast("long"))}
    near = materialize(search(at, anchors.withColumns(everything), True, positives + 1), "positives")
    # 80 p <= 100 n <= 100 p holds for no n where p < 0.
    bars = near.filter("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("hi"))
    lo = F.transform("hi", lambda p: F.call_function("div", p.cast("decimal(20,0)") * least + 99, F.lit(100)).cast("long"))
    windows = anchors.join(bars, "anchor").withColumn("lo", lo)
    hard = search(at, windows, False, negatives)
    kept = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("near"))
    other = hard.groupBy("anchor", "hi").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("hard"))
    other = other.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("hi", "hard"))).alias("hard"))
    told = at.entries.filter("n_anchors > 0").select(F.col("entry").alias("anchor"), "label", "v", "norm", F.col("n_anchors")).join(kept, "anchor").join(other, "anchor")
    told = materialize(told.select(F.struct("label", "v").alias("key"), "norm", "near", "hard", "n_anchors"), "mined")
    mine_rows = plain.filter(is_anchor & usable(F.col("label"), F.col("vector"))).select("vec_id", F.col("label").cast("long").alias("label"), whole_numbers(F.col("vector")).alias("q"))

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(_packed_rows(b.column("q")), pa.binary())], names=["vec_id", "label", "v"])

    asked = mine_rows.mapInArrow(pack, "vec_id long, label long, v binary").select("vec_id", F.struct("label", "v").alias("key"))
    met = join_hot(asked, told, "key", "n_anchors", how="inner")
    me = F.array_position("near", F.struct(F.col("norm").alias("score"), F.col("vec_id").alias("id"))).cast("int")
    others = F.slice(F.filter("near", lambda x, i: (F.col("me") == 0) | (i != F.col("me") - 1)), 1, positives)
    rows_ = met.withColumn("me", me).select("vec_id", "hard", F.explode(others).alias("p"))
    ranked = rows_.select("vec_id", "p", F.posexplode(F.element_at("hard", F.col("p.score"))).alias("i", "n"))

    def known(c: Column) -> Column:
        return F.when(c != _NO_ID, c)

    return ranked.select(F.col("vec_id").alias("anchor_id"), known(F.col("p.id")).alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"), known(F.col("n.id")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
