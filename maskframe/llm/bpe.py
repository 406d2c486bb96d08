"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

All distinct pre-token words of a batch lie in one flat symbol array. A round looks up each
neighbouring pair by binary search over the sorted pair keys, takes the lowest rank of each
word, merges every place of that pair in it, and drops the words that have no pair left.

Null and empty texts give no ids. Special tokens written in a text become their own ids, as in
the library whose files are read. Only files of byte-level tokenizers without normalizer, added
blanks or options that change ids are accepted; others raise. A word costs a round for each rank
that occurs in it: 200,000 different letters without a blank take some seconds.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from maskframe.llm._common import map_texts

#: The pattern that splits text before the merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task remembers.
REMEMBERED = 300_000
#: Decoding keeps malformed bytes as U+FFFD, as the library does.
_NO_RANK = np.int64(1 << 62)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_file(spec: dict) -> None:
    """Refuses a tokenizer file that asks for anything but plain byte-level pairs."""
    model, split, decoder = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [k for k in ("normalizer", "post_processor") if spec.get(k)]
    if model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or decoder.get("type") != "ByteLevel":
        wrong.append("no byte-level pairs")
    if split.get("add_prefix_space") or not split.get("use_regex", True):
        wrong.append("pre_tokenizer")
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [a["content"] for a in spec.get("added_tokens", []) if any(a.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError(f"not a tokenizer file of plain byte-level pairs: {', '.join(wrong)}")


class BytePairs:
    """Vocabulary and merges of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_file(spec)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *[a["id"] for a in spec["added_tokens"]]])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.flat = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.length = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        of_byte = {v: k for k, v in letters.items()}
        self.byte_id = np.array([vocab[of_byte[b]] for b in range(256)], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.base = np.int64(size)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (none is empty)."""
        out: list[np.ndarray] = [None] * len(words)
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        names = np.arange(len(words))
        word = np.repeat(names, sizes)
        rank = np.full(len(ids), _NO_RANK)  # of the pair that starts here
        inner = np.nonzero(word[:-1] == word[1:])[0]
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(ids)])
            done = lowest == _NO_RANK
            if done.any():
                for k in np.nonzero(done)[0]:
                    out[word[first[k]]] = ids[first[k] : first[k] + sizes[k]]
                keep = np.repeat(~done, sizes)
                ids, word, rank = ids[keep], word[keep], rank[keep]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(lowest, sizes)
            at = np.nonzero(hit)[0]
            # In a run of overlapping places (a a a) every second one merges, from the left.
            run = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            ids, word, rank = ids[keep], word[keep], rank[keep]
            # Only pairs beside a merge have a new rank.
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
            rank[fresh] = _NO_RANK
            fresh = fresh[fresh + 1 < len(ids)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self.rank(ids[fresh], ids[fresh + 1])
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-token words, special tokens standing alone."""
        if self.split is None or self.split.search(text) is None:
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*self.words.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words.findall(text[at:])

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes the words that are not known yet, all in one batch."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for t in texts for w in t}.difference(self.known))
        if new:
            for w, ids in zip(new, self.merge([w.encode() for w in new]), strict=True):
                self.known[w] = (",".join(map(str, ids.tolist())), len(ids), ids.astype(np.int32).tobytes())
        for s, i in self.special.items():
            self.known[s] = (str(i), 1, np.array([i], dtype=np.int32).tobytes())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        self.learn(split)
        return [np.frombuffer(b"".join([self.known[w][2] for w in t]), dtype=np.int32) for t in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids."""
        size = self.length[ids]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.start[ids] - (end - size), size)
        raw = self.flat[at].tobytes()
        return raw.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of each text."""
    state: list[BytePairs] = []

    def work(texts):
        if not state:
            state.append(BytePairs(path))
        got = state[0].encode([t.decode() for t in texts])
        ends = np.cumsum([0, *[len(g) for g in got]], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))]

    return map_texts(docs, text, work, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), keep, limit=2 << 20)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes each text; returns the count and the SHA-256 of ids and of the decoded text, without the ids."""
    state: list[BytePairs] = []

    def work(texts):
        if not state:
            state.append(BytePairs(path))
        pairs = state[0]
        split = [pairs.pieces(t.decode()) for t in texts]
        pairs.learn(split)
        n, of_ids, of_text = [], [], []
        for t in split:
            got = [pairs.known[w] for w in t]
            ids = np.frombuffer(b"".join([g[2] for g in got]), dtype=np.int32)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([g[0] for g in got]).encode()).hexdigest())
            of_text.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
        return [n, of_ids, of_text]

    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_texts(docs, text, work, schema, keep if keep is not None else ["doc_id"], limit=2 << 20)
