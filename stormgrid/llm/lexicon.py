"""Frequent words with their ids in a minimal acyclic transducer.

Words are byte strings. The automaton shares prefixes and suffixes; each edge carries
the number of words that sort before it at its state, so that the sum along a path is
the word's rank, and the rank points into one table of ids. The whole is one file of
flat arrays, which readers map into memory.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Sequence

import numpy as np

_HEAD = struct.Struct("<8s5q")
_MAGIC = b"SGLEXIC1"
_ONE = [bytes([b]) for b in range(256)]


def build(entries: dict[bytes, Sequence[int]]) -> bytes:
    """Compile words and their ids into the file's bytes (empty words are left out)."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, edges: list[list[int]]) -> int:
        key = (final, tuple(map(tuple, edges)))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    # the open path: one [final, edges] per byte of the last word; edges end in the open child
    path: list[list] = [[False, []]]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = settle(*path.pop())
            path[-1][1][-1][1] = done

    last = b""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        for b in w[common:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    root = settle(*path[0])

    below = np.zeros(len(states), np.int64)  # words of each state; children are settled first
    for i, (final, edges) in enumerate(states):
        below[i] = final + sum(below[t] for _, t in edges)
    first = np.zeros(len(states) + 1, np.uint32)
    labels, targets, ranks = bytearray(), [], []
    for i, (final, edges) in enumerate(states):
        rank = int(final)
        for b, t in edges:
            labels.append(b)
            targets.append(t)
            ranks.append(rank)
            rank += int(below[t])
        first[i + 1] = len(targets)
    ids = [list(entries[w]) for w in words]
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.uint32)
    flat = np.asarray([i for x in ids for i in x], np.uint32)
    final = bytes(int(f) for f, _ in states)
    arrays = [first, np.asarray(targets, np.uint32), np.asarray(ranks, np.uint32), offsets, flat]
    head = _HEAD.pack(_MAGIC, len(states), len(targets), len(words), len(flat), root)
    return head + b"".join(a.tobytes() for a in arrays) + bytes(labels) + final


class Lexicon:
    """Reader of a compiled lexicon; ``source`` is a file path (mapped) or its bytes."""

    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            data = source
        magic, n_states, n_edges, self.n_words, n_ids, self.root = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a compiled lexicon")
        at = _HEAD.size
        parts = []
        for n in (n_states + 1, n_edges, n_edges, self.n_words + 1, n_ids):
            parts.append(memoryview(data)[at:at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.ranks, self.offsets, self.ids = parts
        self.labels_at, self.data = at, data
        self.final_at = at + n_edges
        self.n_states = n_states

    def get(self, word: bytes) -> tuple[int, ...] | None:
        """The word's ids, or None for a word that the automaton doesn't accept."""
        state, rank = self.root, 0
        first, ranks, targets, at, find = self.first, self.ranks, self.targets, self.labels_at, self.data.find
        for b in word:
            e = find(_ONE[b], at + first[state], at + first[state + 1])
            if e < 0:
                return None
            e -= at
            rank += ranks[e]
            state = targets[e]
        if not self.data[self.final_at + state]:
            return None
        return tuple(self.ids[self.offsets[rank]:self.offsets[rank + 1]])
