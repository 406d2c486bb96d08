"""Many phrases found in one pass over a text: an automaton with failure links, as numpy arrays.

Nodes are the phrases' prefixes, numbered by depth. A node's edges are keys (node * 256 + byte) of one
sorted array, since deeper nodes have larger numbers; the root has a row for each byte. Failure links
lead to the longest suffix that is a prefix too. Texts are cut into segments that overlap by the
longest phrase less a byte, and all segments of a chunk advance side by side, a byte a step.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a segment at least.
SEGMENT = 4096


class Phrases:
    """Finds which of some phrases (bytes, none empty) occur in texts."""

    def __init__(self, phrases: list[bytes]):
        size = np.array([len(p) for p in phrases], dtype=np.int64)
        data = np.frombuffer(b"".join(phrases), dtype=np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        most = int(size.sum()) + 1
        self.keys = np.full(most, np.iinfo(np.int64).max, dtype=np.int64)  # edge i leads to node i + 1
        self.fail = np.zeros(most, dtype=np.int32)
        self.root = np.zeros(256, dtype=np.int32)
        self.edges, self.longest = 0, int(size.max()) if len(size) else 0
        end = np.full(most, -1, dtype=np.int32)
        link = np.zeros(most, dtype=np.int32)
        at = np.zeros(len(phrases), dtype=np.int64)
        for depth in range(self.longest):
            going = np.flatnonzero(size > depth)
            keys, which = np.unique(at[going] * 256 + data[begin[going] + depth], return_inverse=True)
            new = self.edges + 1 + np.arange(len(keys))
            parent, byte = keys >> 8, keys & 255
            if depth:
                fail = self.go(self.fail[parent], byte)
            else:
                fail = np.zeros(len(keys), dtype=np.int32)
                self.root[byte] = new
            self.keys[self.edges : self.edges + len(keys)] = keys
            self.edges += len(keys)
            self.fail[new] = fail
            at[going] = new[which]
            done = going[size[going] == depth + 1]
            end[at[done]] = done
            # All shorter suffixes have their ends by now.
            link[new] = np.where(end[fail] >= 0, fail, link[fail])
        nodes = self.edges + 1
        self.keys, self.fail, self.end, self.link = self.keys[: self.edges], self.fail[:nodes], end[:nodes], link[:nodes]
        self.first = np.where(self.end >= 0, np.arange(nodes, dtype=np.int32), self.link)

    def go(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.root[byte]
        open_ = np.flatnonzero(node > 0)
        at = node[open_].astype(np.int64)
        while len(open_):
            key = at * 256 + byte[open_]
            edge = np.searchsorted(self.keys[: self.edges], key)
            edge = np.minimum(edge, max(0, self.edges - 1))
            hit = self.keys[edge] == key
            out[open_[hit]] = edge[hit] + 1
            at = self.fail[at[~hit]].astype(np.int64)
            open_ = open_[~hit]
            deep = at > 0
            open_, at = open_[deep], at[deep]
        return out

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text with each phrase that it holds, once: (places in texts, places in phrases)."""
        none = np.zeros(0, dtype=np.int64)
        if not self.edges or not texts:
            return none, none
        over, step = self.longest - 1, max(SEGMENT, 4 * self.longest)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
        first = np.cumsum(size) - size
        count = -(-size // step)
        text = np.repeat(np.arange(len(texts)), count)
        inner = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
        length = np.minimum(size[text] - inner, step + over)
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], (first[text] + inner)[order], length[order]
        node = np.zeros(len(text), dtype=np.int32)
        found = []
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for i in range(longest):
            k = active[i]
            node = self.go(node[:k], data[start[:k] + i])
            hit = self.first[node]
            lanes = np.flatnonzero(hit)
            hit = hit[lanes]
            while len(lanes):
                found.append(text[lanes] * np.int64(len(self.end)) + self.end[hit])
                hit = self.link[hit]
                more = hit > 0
                lanes, hit = lanes[more], hit[more]
            if len(found) > 4096:
                found = [np.unique(np.concatenate(found))]
        pairs = np.unique(np.concatenate(found)) if found else none
        return pairs // len(self.end), pairs % len(self.end)
