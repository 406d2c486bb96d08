"""Benchmark decontamination by a prefix-filtered set join with positions.

The shingles of an item are its windows of ``window`` consecutive words (an item of fewer words
is one window). Words are ordered by how often the corpus has them. A text can hold a window
only if it holds its rarest word, the one prefix token that an exact containment needs, at the
window's place of it: so texts are joined with the windows on that word alone, the place gives
where the window would begin, bounds of position and length drop what would pass the text's
ends, and the rest is compared word by word and then byte by byte.

Benchmarks larger than ``slice_bytes`` are joined a slice at a time, so what a task is sent is
bounded: one pass over the corpus counts the words of all slices, and each slice takes a pass to
mark. Null and empty texts have no words. Items without words have no window; items with a
null id mark words but are not listed. Repeated rows are judged one by one, repeated items
count once by id. Added columns must be new to ``docs``; others stay.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import LOWER, chunks, map_texts, materialize, texts_of
from maskframe.llm._tokens import Words

WINDOW = 10
SLICE_BYTES = 8 << 20
#: Bytes of text that words are counted in at once.
CHUNK = 4 << 20
#: Lower-cases A-Z; ASCII other than letters and digits separates words.
LETTERS = bytes(LOWER[c] if chr(c).isalnum() or c >= 0x80 else 32 for c in range(256))
_LOW = (1 << 16) - 1


class Windows:
    """The windows of some items, and which of their words a text must have."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        texts = [(t or "").encode() for _, t in items]
        words = Words(texts, LETTERS)
        hashes = words.hashes()
        self.window, self.owners, found = window, [], {}
        spans = []
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            for start in range(a, max(a + 1, b - window + 1)) if b > a else ():
                end = min(b, start + window)
                at = found.setdefault(b" ".join([words.word(k) for k in range(start, end)]), len(found))
                if at == len(spans):
                    spans.append((start, end))
                    self.owners.append(set())
                if item is not None:
                    self.owners[at].add(str(item))
        self.text = list(found)
        self.size = np.array([b - a for a, b in spans], dtype=np.int64)
        self.words = np.zeros((len(spans), window), dtype=np.uint64)
        for k, (a, b) in enumerate(spans):
            self.words[k, : b - a] = hashes[a:b]
        self.vocabulary = np.unique(hashes)

    def order(self, counts: np.ndarray) -> None:
        """Picks each window's rarest word; ``counts`` follow ``vocabulary``."""
        if not len(self.text):
            return
        inside = np.arange(self.window) < self.size[:, None]
        often = np.where(inside, counts[np.minimum(np.searchsorted(self.vocabulary, self.words), len(self.vocabulary) - 1)], np.iinfo(np.int64).max)
        place = often.argmin(axis=1)
        token = self.words[np.arange(len(place)), place]
        order = np.argsort(token, kind="stable")
        self.posted, self.place = order, place[order]
        self.tokens, first = np.unique(token[order], return_index=True)
        self.post = np.r_[first, len(order)]
        self.low = np.zeros(_LOW + 1, dtype=bool)
        self.low[(self.tokens & np.uint64(_LOW)).astype(np.int64)] = True

    def found_in(self, texts: list[bytes]):
        """Words of each text; place (in all words) and number of each window that occurs."""
        words = Words(texts, LETTERS)
        none = np.zeros(0, dtype=np.int64)
        if not len(self.text) or not len(words):
            return words, none, none
        hashes = words.hashes()
        at = np.flatnonzero(self.low[(hashes & np.uint64(_LOW)).astype(np.int64)])
        token = np.minimum(np.searchsorted(self.tokens, hashes[at]), len(self.tokens) - 1)
        good = self.tokens[token] == hashes[at]
        at, token = at[good], token[good]
        starts, numbers = [], []
        # The join on the prefix token, a bounded number of pairs at once.
        n = self.post[token + 1] - self.post[token]
        total = np.cumsum(n)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20))))
            k = n[i:j]
            posting = np.repeat(self.post[token[i:j]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            number, where = self.posted[posting], np.repeat(at[i:j], k)
            start = where - self.place[posting]
            text = np.searchsorted(words.first, where, side="right") - 1
            fits = (start >= words.first[text]) & (start + self.size[number] <= words.first[text + 1])
            start, number = start[fits], number[fits]
            for k in range(self.window):
                if not len(start):
                    break
                same = (self.size[number] <= k) | (hashes[np.minimum(start + k, len(hashes) - 1)] == self.words[number, k])
                start, number = start[same], number[same]
            starts.append(start)
            numbers.append(number)
            i = j
        start, number = (np.concatenate(x) if x else none for x in (starts, numbers))
        exact = np.array([b" ".join([words.word(k) for k in range(s, s + self.size[w])]) == self.text[w] for s, w in zip(start.tolist(), number.tolist(), strict=True)], dtype=bool)
        return (words, start[exact], number[exact]) if len(start) else (words, start, number)


def _counts(docs: DataFrame, text: str, windows: Windows) -> np.ndarray:
    """How often the corpus has each word of the windows' vocabulary."""
    vocabulary = windows.vocabulary

    def count(batches):
        total = np.zeros(len(vocabulary), dtype=np.int64)
        low = np.zeros(_LOW + 1, dtype=bool)
        low[(vocabulary & np.uint64(_LOW)).astype(np.int64)] = True
        for batch in chunks(batches, text, 4 << 20):
            h = Words(texts_of(batch.column(0)), LETTERS).hashes()
            h = h[low[(h & np.uint64(_LOW)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    if len(vocabulary):
        got = docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # one row a word of a slice
        out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _all_counts(docs: DataFrame, text: str, items: DataFrame, item_text: str) -> DataFrame:
    """(word, n): how often the corpus has each word of a benchmark of any size, in one pass."""

    def tally(batches):
        for batch in chunks(batches, "__t", CHUNK):
            keys, n = np.unique(Words(texts_of(batch.column(0)), LETTERS).hashes().view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["word", "n"])

    of = lambda df, column: df.select(F.col(f"`{column}`").alias("__t")).mapInArrow(tally, "word long, n long")
    wanted = of(items, item_text).select("word").distinct()
    return of(docs, text).join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))


def _counts_of(counts: DataFrame, windows: Windows) -> np.ndarray:
    """The counts of a slice's own vocabulary."""
    own = counts.sparkSession.createDataFrame(pd.DataFrame({"word": windows.vocabulary.view(np.int64)}), "word long")
    got = counts.join(own, "word").toPandas()  # a row a word of a slice
    out = np.zeros(len(windows.vocabulary), dtype=np.int64)
    out[np.searchsorted(windows.vocabulary, got["word"].to_numpy(dtype=np.int64).view(np.uint64))] = got["n"].to_numpy()
    return out


def _marked(docs: DataFrame, text: str, windows: Windows, keep: list[str] | None) -> DataFrame:
    def work(texts):
        words, start, number = windows.found_in(texts)
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + windows.size[number], -1)
        hit = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        bounds = np.searchsorted(hit, words.first)
        listed: list[set[str]] = [set() for _ in texts]
        text_of = np.searchsorted(words.first, start, side="right") - 1
        for t, w in set(zip(text_of.tolist(), number.tolist(), strict=True)):
            listed[t] |= windows.owners[w]
        inside = hit - np.repeat(words.first[:-1], np.diff(bounds))
        return [np.diff(words.first), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(inside.astype(np.int32))), [sorted(x) for x in listed]]

    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    return map_texts(docs, text, work, schema, keep, limit=4 << 20)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_words (places of the words inside an occurring window) and items (ids, sorted as strings)."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = -(-max(1, size) // slice_bytes)

    def windows_of(i: int, counted) -> Windows:
        made = Windows([(r.id, r.t) for r in items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(slices)) == i).collect()], window)
        made.order(counted(made))
        return made

    if slices == 1:
        return _marked(docs, text, windows_of(0, lambda made: _counts(docs, text, made)), keep)
    base = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    counts = materialize(_all_counts(base, text, items, "t"), "words")
    found = [_marked(base, text, windows_of(i, lambda made: _counts_of(counts, made)), ["__row"]) for i in range(slices)]
    words = found[0].select("__row", "n_words")
    hits = reduce(DataFrame.unionByName, [x.filter(F.size("items") + F.size("hit_words") > 0).select("__row", "hit_words", "items") for x in found])
    hits = hits.groupBy("__row").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "items")])
    none = {"hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    out = base.join(words, "__row").join(hits, "__row", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()}).drop("__row")
    return out if keep is None else out.select(*keep, "n_words", "hit_words", "items")
