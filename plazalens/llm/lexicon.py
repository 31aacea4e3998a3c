"""A minimal acyclic transducer over byte strings, in flat arrays that can be memory-mapped.

Equal suffixes share states. Every arc carries a number; summed along a path they give the rank of
the word in sorted order, and the rank leads to the word's ids.
"""

from __future__ import annotations

import numpy as np


def build(entries: dict[bytes, list[int]]) -> np.ndarray:
    """One int32 array: header, arcs (sorted by state and byte), finals, id offsets and ids."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    below: list[int] = []  # words that end in or below a state

    def state(last: bool, out: dict[int, int]) -> int:
        key = (last, tuple(sorted(out.items())))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            final.append(last)
            below.append(last + sum(below[t] for t in out.values()))
        return register[key]

    # The path of the last word stays open; what the next word leaves behind is closed.
    path: list[list] = [[False, {}]]
    previous = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            last, out = path.pop()
            path[-1][1][previous[len(path) - 1]] = state(last, out)

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(previous, word)) if a != b), min(len(previous), len(word)))
        close(shared)
        path += [[False, {}] for _ in word[shared:]]
        path[-1][0] = True
        previous = word
    close(0)
    root = state(*path[0])
    keys, targets, adds = [], [], []
    for number, out in enumerate(arcs):
        before = int(final[number])
        for byte, target in out:
            keys.append(number * 256 + byte)
            targets.append(target)
            adds.append(before)
            before += below[target]
    ids = [entries[w] for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = np.array([i for x in ids for i in x], np.int32)
    header = np.array([root, len(keys), len(final), len(words), len(flat)], np.int32)
    return np.concatenate([header, np.array(keys, np.int32), np.array(targets, np.int32), np.array(adds, np.int32), np.array(final, np.int32), offsets, flat])


class Lexicon:
    """Looks many words up at once; ``whole`` is what ``build`` gave, in memory or mapped."""

    def __init__(self, whole: np.ndarray):
        root, arcs, states, words, ids = (int(x) for x in whole[:5])
        self.root, self.states = root, states
        self.keys, self.targets, self.adds, self.final, self.offsets, self.ids = np.split(
            whole[5:], np.cumsum([arcs, arcs, arcs, states, words + 1])
        )

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.int32, "r"))

    def ranks(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rank of each word ``data[start:stop]``, or -1."""
        out = np.full(len(start), -1, np.int64)
        lane = np.flatnonzero(stop > start)
        if not len(self.keys):
            return out
        state, rank, at = np.full(len(lane), self.root, np.int64), np.zeros(len(lane), np.int64), start[lane]
        while len(lane):
            key = (state * 256 + data[at]).astype(np.int32)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            lane, arc, rank, at = lane[known], arc[known], rank[known], at[known] + 1
            rank = rank + self.adds[arc]
            state = self.targets[arc].astype(np.int64)
            ended = at == stop[lane]
            good = ended & (self.final[state] > 0)
            out[lane[good]] = rank[good]
            lane, state, rank, at = lane[~ended], state[~ended], rank[~ended], at[~ended]
        return out
