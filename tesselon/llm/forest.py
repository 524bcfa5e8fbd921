"""Components of similar sets in blocks: a search that compares a set only with those that no component holds yet.

Large families of near copies, all alike, cost one comparison a member, not one a pair. What can
still cost a comparison a pair are sets that are candidates for each other and yet not linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64


class Signatures:
    """Signatures (a byte for each coordinate), those not yet found side by side; linked from so many equal coordinates on."""

    def __init__(self, signs: list[bytes], least: int):
        self.all = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1)
        self.least = least

    def start(self, order: np.ndarray) -> None:
        self.open = np.ascontiguousarray(self.all[order].T)

    def near(self, x: int, a: int, b: int) -> np.ndarray:
        return (self.open[:, a:b] == self.all[x][:, None]).sum(axis=0, dtype=np.uint8) >= self.least

    def keep(self, stays: np.ndarray) -> None:
        self.open = np.ascontiguousarray(self.open[:, stays])


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of words) with fewer words: those that fall together are joined."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1) if maps.shape[1] > words else maps


class Bitmaps:
    """Bitmaps of sets, wider ones for larger sets; linked while they differ in no more bits than the sets may in features."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray, percent: int):
        self.all, self.sizes, self.percent = [np.frombuffer(m, _U)[None] for m in maps], sizes, percent

    def start(self, order: np.ndarray) -> None:
        width = np.array([self.all[i].shape[1] for i in order])
        cuts = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(order)]
        self.open = [np.concatenate([self.all[i] for i in order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # by width, which grows with the size
        self.size = self.sizes[order]

    def near(self, x: int, a: int, b: int) -> np.ndarray:
        apart, at, own = [], 0, self.all[x]
        for maps in self.open:
            low, high = max(a - at, 0), min(b - at, len(maps))
            if low < high:
                words = min(maps.shape[1], own.shape[1])
                apart.append(np.bitwise_count(fold(maps[low:high], words) ^ fold(own, words)).sum(axis=1, dtype=np.int64))
            at += len(maps)
        return (100 + self.percent) * np.concatenate(apart) <= (100 - self.percent) * (self.sizes[x] + self.size[a:b])

    def keep(self, stays: np.ndarray) -> None:
        parts = np.split(stays, np.cumsum([len(m) for m in self.open])[:-1])
        self.open = [m[s] for m, s in zip(self.open, parts, strict=True) if s.any()]
        self.size = self.size[stays]


class Sets:
    """Sets of features, those not yet found one behind the other; linked by their Jaccard similarity."""

    def __init__(self, features: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(x) for x in features]), percent
        names, flat = np.unique(np.concatenate(features), return_inverse=True)
        self.all = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(names), bool)

    def start(self, order: np.ndarray) -> None:
        self.open, self.size = np.concatenate([self.all[i] for i in order]), self.sizes[order]
        self.at = np.cumsum(self.size) - self.size

    def near(self, x: int, a: int, b: int) -> np.ndarray:
        self.mark[self.all[x]] = True
        low, high = self.at[a], self.at[b - 1] + self.size[b - 1]
        both = np.add.reduceat(self.mark[self.open[low:high]], self.at[a:b] - low, dtype=np.int64)
        self.mark[self.all[x]] = False
        return 100 * both >= self.percent * (self.sizes[x] + self.size[a:b] - both)

    def keep(self, stays: np.ndarray) -> None:
        self.open, self.size = self.open[np.repeat(stays, self.size)], self.size[stays]
        self.at = np.cumsum(self.size) - self.size


def forest(sizes: np.ndarray, percent: int, sets: Signatures | Bitmaps | Sets) -> Iterator[tuple[int, int]]:
    """(x, y) of a spanning forest of the links between non-empty sets; sizes further apart than percent are not compared."""
    order = np.argsort(sizes, kind="stable")
    sets.start(order)
    size = sizes[order]
    while len(order):
        waiting = [int(order[0])]
        stays = np.ones(len(order), bool)
        stays[0] = False
        while True:
            if not stays.all():
                order, size = order[stays], size[stays]
                sets.keep(stays)
            if not waiting or not len(order):
                break
            x = waiting.pop()
            n = int(sizes[x])
            a, b = int(np.searchsorted(size, -(-percent * n // 100))), int(np.searchsorted(size, 100 * n // percent, "right"))
            stays = np.ones(len(order), bool)
            if a < b:
                good = sets.near(x, a, b)
                found = order[a:b][good].tolist()
                for y in found:
                    yield x, y
                waiting += found
                stays[a:b] = ~good
