"""A weighted backoff automaton over n-grams, learnt from a corpus and run over all of its texts.

States are histories of up to ``order - 1`` tokens that training has often enough (``least``), and
the root, the empty one; a text begins in the history of its start. A state's arcs are the tokens
that training has after it; any other token follows the failure arc to the state of the history
without its first token. Weights are log10 probabilities under Dirichlet smoothing, which sums to
one over every state:

    root:         p(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))        w unseen: c(w) = 0
    arc of h:     p(w|h) = (c(h w) + mass p(w|h')) / (c(h) + mass)  h': h without its first token
    failure arc:  mass / (c(h) + mass)

One traversal from left to right carries the state and adds up weights. Over a block of texts it
runs in lanes: stretches of the block's tokens in step, each begun ``order - 1`` tokens early, after
which the state is the same from wherever it started.

The automaton grows with the corpus, so no task gets the whole of it. Texts are packed into blocks
as they lie. A block sends each n-gram that it has, with its own training count, to the part that
owns the hash; the part adds up and answers what other blocks add to each count, in the order in
which it was asked. Words and pairs go first; a longer n-gram is asked for only where its history
has turned out to be a state. So a block builds just the states and arcs that its texts can
reach, and no key meets more rows than there are blocks. N-grams are compared by 64-bit hash.

Null and empty texts are the end token alone. Repeated rows count each time. A block is the same
when a lost task is run again if ``docs`` is read from files or a checkpoint, as it should be.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.llm._common import chunks, texts_of
from maskframe.llm._tokens import Words, _U, by_key, dealt, mix, pack, packed_blocks, split_parts, unpack, unpack_rows

ORDER = 3
#: Weight of the next shorter history's distribution, in tokens, by length of the history.
MASS = (400.0, 4.0, 2.0, 1.0)
#: Training occurrences that make a history a state, by its length.
LEAST = (1, 2, 2, 2)
BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: Lanes of a traversal.
LANES = 8192
#: Hash of the end token, which is also the history at the start of a text.
END = _U(0x5851F42D4C957F2D)
SENT = "part int, block long, keys binary, n binary"
BACK = "block long, part int, round int, others binary"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then the end, and where each text starts."""
    words = Words(texts)
    first = words.first + np.arange(len(words.first))
    out = np.full(len(words) + len(texts), END, dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[first[1:] - 1] = False
    out[place] = words.hashes()
    return out, first


def extend(history: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their histories and the hashes of their last tokens."""
    return mix(history * _U(0x9E3779B97F4A7C15) ^ (hashes >> _U(1)) * _U(0xD1B54A32D192ED03) ^ hashes)


def _deltas(keys: np.ndarray) -> bytes:
    """Ascending keys as packed differences."""
    return pack(np.diff(keys, prepend=_U(0)))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _totals(docs: DataFrame, text: str, learn: str, parts: int) -> tuple[int, int]:
    """N and V: training tokens, and how many different ones."""

    def count(batches):
        for batch in chunks(batches, text, 8 << 20):
            hashes, _ = tokens(texts_of(batch.column(0)))
            keys, n = np.unique(hashes, return_counts=True)
            _, at = split_parts(keys, parts, ranges=True)
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([_deltas(keys[at[p] : at[p + 1]]) for p in full], pa.binary()), pa.array(np.add.reduceat(n, at[full]), pa.int64())], names=["part", "keys", "n"])

    def distinct(batches):
        for _, table in by_key(batches, "part"):
            keys = np.concatenate([_sums(x) for x in table.column("keys").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([int(sum(table.column("n").to_pylist()))], pa.int64()), pa.array([len(np.unique(keys))], pa.int64())], names=["n", "v"])

    sent = docs.filter(learn).select(text).mapInArrow(count, "part int, keys binary, n long")
    got = dealt(sent, parts, "part").mapInArrow(distinct, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return got[0] or 0, got[1] or 0


class Block:
    """The tokens of some texts, all their n-grams, and what training has of those.

    For each n: ``key[n]``, the n-gram that ends at each token, until it is asked for (``whole[n]``
    says where there is one), ``table[n]``, the different ones that were asked for, and ``count[n]`` their training counts.
    """

    def __init__(self, texts: list[bytes], learn: np.ndarray, order: int, least: tuple[int, ...]):
        self.order, self.least = order, least
        self.hashes, self.first = tokens(texts)
        self.learn = np.repeat(learn.astype(np.uint8), np.diff(self.first))
        place = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.begins = place == 0
        before = np.r_[END, self.hashes[:-1]]
        before[self.begins] = END
        self.key, self.whole = {1: self.hashes}, {1: np.ones(len(place), dtype=bool)}
        for n in range(2, order + 1):
            self.key[n] = extend(before if n == 2 else np.r_[END, self.key[n - 1][:-1]], self.hashes)
            self.whole[n] = place >= n - 2
        self.table, self.count, self.at, self.place = {}, {}, {}, {}

    def _add(self, n: int, which: np.ndarray) -> None:
        """The n-grams that end at ``which``: sorted, with their own training counts, an index from places and one place of each."""
        keys, place, back = np.unique(self.key.pop(n)[which], return_index=True, return_inverse=True)
        self.table[n], self.place[n] = keys, which[place].astype(np.int32)
        self.count[n] = np.bincount(back, weights=self.learn[which], minlength=len(keys)).astype(np.int64)
        self.at[n] = np.full(len(self.hashes), -1, dtype=np.int32)
        self.at[n][which] = back

    def states(self, n: int) -> np.ndarray:
        """Which n-grams of the table are states."""
        last = self.hashes[self.place[n]]
        return (self.count[n] >= self.least[n - 1]) & ((last != END) | (n == 1))

    def history(self, n: int, places: np.ndarray) -> np.ndarray:
        """Index of the history of the n-grams that end at ``places``; of a pair at the start, that of the start."""
        if n == 2:
            start = np.searchsorted(self.table[1], END)
            return np.where(self.begins[places], start, self.at[1][places - 1])
        return self.at[n - 1][places - 1]

    def ask(self, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and own counts of a round: words and pairs, then one length after another."""
        every = np.arange(len(self.hashes))
        if round_ == 0:
            self._add(1, every)
            if self.order > 1:
                self._add(2, every)
            return tuple(np.concatenate([x[n] for n in range(1, min(2, self.order) + 1)]) for x in (self.table, self.count))
        n = round_ + 2
        which = every[self.whole[n]]
        history = self.history(n, which)
        live = history >= 0
        live[live] = self.states(n - 1)[history[live]]
        self._add(n, which[live])
        return self.table[n], self.count[n]

    def take(self, round_: int, counts: np.ndarray) -> None:
        if round_ == 0:
            self.count[1] = counts[: len(self.table[1])]
            if self.order > 1:
                self.count[2] = counts[len(self.table[1]) :]
        else:
            self.count[round_ + 2] = counts


class Automaton:
    """The states and arcs that a block's texts can reach.

    States are numbered from the root, 0; ``depth`` is the length of a state's history, ``fail`` and
    ``fail_weight`` are the failure arcs. N-grams are numbered through all lengths: number g is the
    arc on its last word out of the state of its history, if training has it (``arc``), with
    ``weight`` and ``to``; words are the root's arcs, which all exist. ``named`` gives the number of
    the n-gram of each length that ends at each token: the arc that a state of that depth would take.
    """

    def __init__(self, block: Block, scale: float, mass: tuple[float, ...]):
        p = (block.count[1] + 0.5) / scale
        number, total, fail, fail_weight, depth = {}, 1, [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        next_: dict[int, np.ndarray] = {}
        for n in range(1, block.order):
            own = block.states(n)
            number[n] = np.where(own, total + np.cumsum(own) - 1, -1)
            shorter = next_[n - 1][block.at[n - 1][block.place[n]]] if n > 1 else np.zeros(len(own), np.int64)
            next_[n] = np.where(own, number[n], shorter)  # the state after an n-gram: itself, or else its longest end that is one
            fail.append(shorter[own])
            fail_weight.append(np.log10(mass[n - 1] / (block.count[n][own] + mass[n - 1])))
            depth.append(np.full(int(own.sum()), n))
            total += int(own.sum())
        self.fail, self.fail_weight, self.depth = np.concatenate(fail), np.concatenate(fail_weight), np.concatenate(depth)
        words = len(block.table[1])
        self.start = int(next_[1][np.searchsorted(block.table[1], END)]) if next_ and words else 0
        self.named = np.full((block.order + 1, len(block.hashes)), -1, dtype=np.int32)
        self.named[1] = block.at[1]
        arc, weight, to, source, base = [np.ones(words, bool)], [np.log10(p)], [next_.get(1, np.zeros(words, np.int64))], [np.zeros(words, np.int64)], words
        for n in range(2, block.order + 1):
            place = block.place[n]
            lower = p[block.at[n - 1][place]]
            history = block.history(n, place)
            state = number[n - 1][history]
            c = block.count[n - 1][history]
            p = np.where(state >= 0, (block.count[n] + mass[n - 2] * lower) / (c + mass[n - 2]), lower)
            arc.append((block.count[n] > 0) & (state >= 0))
            weight.append(np.log10(p))
            to.append(next_[n] if n in next_ else next_[n - 1][block.at[n - 1][place]])
            source.append(state)
            self.named[n] = np.where(block.at[n] >= 0, block.at[n] + base, -1)
            base += len(place)
        self.arc, self.weight, self.to, self.source = (np.concatenate(x) for x in (arc, weight, to, source))

    def traverse(self, begins: np.ndarray, warm: int, lanes: int = LANES) -> np.ndarray:
        """Weight of each token, by one pass that carries the state of each lane."""
        n = len(begins)
        out = np.zeros(n)
        long_ = max(1, -(-n // lanes))
        begin = np.arange(0, n, long_)
        state = np.zeros(len(begin), dtype=np.int64)
        for t in range(-warm, long_):
            at = begin + t
            lane = np.flatnonzero((at >= 0) & (at < n))
            at = at[lane]
            s = np.where(begins[at], self.start, state[lane])
            total = np.zeros(len(at))
            todo = np.arange(len(at))
            while len(todo):
                here = s[todo]
                g = self.named[self.depth[here] + 1, at[todo]]
                hit = (g >= 0) & self.arc[g]
                total[todo[hit]] += self.weight[g[hit]]
                s[todo[hit]] = self.to[g[hit]]
                todo, here = todo[~hit], here[~hit]
                total[todo] += self.fail_weight[here]
                s[todo] = self.fail[here]
            state[lane] = s
            if t >= 0:
                out[at] = total
        return out


def scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mass: tuple[float, ...] = MASS, least: tuple[int, ...] = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a text: id, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``learn``: which rows the model learns from. base_score is the root's score alone.
    """
    source = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    texts, total = packed_blocks(source, "__text", block_bytes)
    parts = max(1, -(-total // PART_BYTES))
    n_train, v_train = _totals(source, "__text", "__learn", parts)
    scale = n_train + 0.5 * (v_train + 1)
    id_type = dict(docs.dtypes)[doc_id]
    rounds = max(1, order - 1)

    def read(data: bytes) -> tuple[pa.Table, Block]:
        table = unpack_rows(data)
        return table, Block(texts_of(table.column("__text")), table.column("__learn").to_numpy(zero_copy_only=False), order, least)

    def replay(block: Block, answers: pa.Table, rounds: int) -> None:
        """Asks again, and takes what was answered."""
        for i in range(rounds):
            keys, n = block.ask(i)
            if i:
                n = n.copy()
            place, at = split_parts(keys, parts, ranges=True)
            got = answers.filter(pa.array(answers.column("round").to_numpy() == i)) if answers.num_rows else answers
            for part, others in zip(got.column("part").to_pylist(), got.column("others").to_pylist(), strict=True):
                n[place[at[part] : at[part + 1]]] += unpack(others).astype(np.int64)
            block.take(i, n)

    def send(number: int, block: Block, round_: int) -> pa.RecordBatch:
        keys, n = block.ask(round_)
        place, at = split_parts(keys, parts, ranges=True)
        keys, n = keys[place], n[place]
        full = np.flatnonzero(np.diff(at))
        cut = lambda a, f: pa.array([f(a[at[i] : at[i + 1]]) for i in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number, np.int64)), cut(keys, _deltas), cut(n, pack)], names=["part", "block", "keys", "n"])

    def first(batches):
        for batch in batches:
            for number, data in zip(batch.column("__block").to_pylist(), batch.column("__rows"), strict=True):
                yield send(number, read(data.as_py())[1], 0)

    def next_(round_: int):
        def run(left, right):
            block = read(left.column("__rows")[0].as_py())[1] if left.num_rows else None
            if block is None:
                return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
            replay(block, right, round_)
            return pa.Table.from_batches([send(left.column("__block")[0].as_py(), block, round_)])

        return run

    def answer(round_: int):
        def run(batches):
            for part, table in by_key(batches, "part"):
                asked = [_sums(x) for x in table.column("keys").to_pylist()]
                n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()]).astype(np.int64)
                ends = np.cumsum([len(x) for x in asked])
                keys = np.concatenate(asked)
                del asked
                place = np.argsort(keys)
                new = np.flatnonzero(np.r_[True, np.diff(keys[place]) != 0])
                others = np.empty(len(n), dtype=np.int64)
                others[place] = np.repeat(np.add.reduceat(n[place], new), np.diff(np.r_[new, len(keys)]))
                others -= n
                for i, end in enumerate(ends):
                    begin = ends[i - 1] if i else 0
                    if others[begin:end].any():
                        yield pa.RecordBatch.from_arrays([pa.array([table.column("block")[i].as_py()], pa.int64()), pa.array([part], pa.int32()), pa.array([round_], pa.int32()), pa.array([pack(others[begin:end])], pa.binary())], names=["block", "part", "round", "others"])

        return run

    def finish(left, right):
        table, block = read(left.column("__rows")[0].as_py())
        replay(block, right, rounds)
        starts = block.first[:-1]
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        word = block.at[1]
        automaton = Automaton(block, scale, mass)
        return pa.table({
            doc_id: table.column("__id"),
            "n_tokens": pa.array(np.diff(block.first), pa.int64()),
            "n_known": pa.array(total((block.count[1] > 0).astype(np.int64)[word]), pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), n_train), pa.int64()),
            "base_score": pa.array(total(automaton.weight[word]), pa.float64()),
            "score": pa.array(total(automaton.traverse(block.begins, order - 1)), pa.float64()),
        })

    answers = [dealt(texts.mapInArrow(first, SENT), parts, "part").mapInArrow(answer(0), BACK)]
    for i in range(1, rounds):
        so_far = reduce(DataFrame.unionByName, answers)
        sent = texts.groupBy("__block").cogroup(so_far.groupBy("block")).applyInArrow(next_(i), SENT)
        answers.append(dealt(sent, parts, "part").mapInArrow(answer(i), BACK))
    out = f"`{doc_id}` {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("__block").cogroup(reduce(DataFrame.unionByName, answers).groupBy("block")).applyInArrow(finish, out)
