"""Suffix arrays with common-prefix values by external induced sorting.

The suffixes of type S* (those that rise after a fall) are sorted by naming the substrings between
them and recursing on the names. All others follow by induction: suffixes leave a priority queue in
order, and each sends the one a place to its left into the queue, where it goes by its first symbol and
then by arrival. Tuples in the queue carry the common prefix with the suffix that arrived before them
at the same symbol: one more than the least value that passed in between. Both queues and texts work in
bulk: a batch leaves at once as far as nothing that it sends in belongs before its end. Queues keep
sorted runs and write those beyond a memory bound to disk, to the folders where Spark itself spills.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Tuples that a queue keeps in memory, and that leave it at once.
MEMORY, BATCH = 1 << 21, 1 << 16
ARRIVAL = np.uint64(40)


class Queue:
    """Tuples (key, position, common prefix) by key and then by arrival, in sorted runs, on disk beyond `memory` tuples."""

    def __init__(self, memory: int = MEMORY):
        self.batch, self.memory, self.arrived, self.runs = min(BATCH, memory), memory, 0, []
        self.folder: tempfile.TemporaryDirectory | None = None

    def __len__(self) -> int:
        return sum(len(r[0]) - r[3] for r in self.runs)

    def push(self, key: np.ndarray, position: np.ndarray, common: np.ndarray) -> None:
        if not len(key):
            return
        order = (key.astype(np.uint64) << ARRIVAL) + np.arange(self.arrived, self.arrived + len(key), dtype=np.uint64)
        self.arrived += len(key)
        by = np.argsort(order)
        self.runs.append([order[by], position[by], common[by], 0, []])
        while len(self.runs) > 1 and len(self.runs[-2][0]) - self.runs[-2][3] < 2 * (len(self.runs[-1][0]) - self.runs[-1][3]):
            self.merge()

    def merge(self) -> None:
        """Join the two youngest runs; a run of more than the memory's size lies on disk."""
        a, b = self.runs.pop(), self.runs.pop()
        arrays = [np.concatenate([x[i][x[3] :] for x in (b, a)]) for i in range(3)]
        by = np.argsort(arrays[0], kind="stable")
        arrays, paths = [x[by] for x in arrays], []
        for path in a[4] + b[4]:
            os.remove(path)
        if len(by) > self.memory:
            if self.folder is None:
                self.folder = tempfile.TemporaryDirectory(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None, prefix="queue")
            for i, x in enumerate(arrays):
                path = os.path.join(self.folder.name, f"{self.arrived}-{i}.npy")
                np.save(path, x)
                arrays[i] = np.load(path, mmap_mode="r")
                paths.append(path)
        self.runs.append([*arrays, 0, paths])

    def peek(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first tuples, in order: a batch, or fewer if no more are certain to be next."""
        most = self.batch
        heads = [tuple(x[r[3] : r[3] + most] for x in r[:3]) for r in self.runs]
        # A run that has more to come bounds what is certain to be next.
        bound = min((h[0][-1] for h, r in zip(heads, self.runs, strict=True) if len(r[0]) - r[3] > most), default=None)
        arrays = [np.concatenate([h[i] for h in heads]) for i in range(3)]
        by = np.argsort(arrays[0])
        if bound is not None:
            by = by[arrays[0][by] <= bound]
        by = by[:most]
        return arrays[0][by], arrays[1][by], arrays[2][by]

    def drop(self, last: np.uint64, taken: int) -> None:
        """Let go of all tuples up to this place in the order."""
        for r in self.runs:
            r[3] += int(np.searchsorted(r[0][r[3] : r[3] + self.batch], last, side="right"))
        # The next batch is a few times what could leave at once this time.
        self.batch = min(max(4 * taken, 256), BATCH, self.memory)
        for path in (path for r in self.runs if r[3] == len(r[0]) for path in r[4]):
            os.remove(path)
        self.runs = [r for r in self.runs if r[3] < len(r[0])]

    def close(self) -> None:
        self.runs = []
        if self.folder:
            self.folder.cleanup()


class RangeMinimum:
    """Least value of any range of an array, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            step = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum from start up to before end; ranges aren't empty."""
        level = np.frexp((end - start).astype(float))[1] - 1
        out = np.empty(len(start), self.table[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][start[own]], self.table[k][end[own] - (1 << int(k))])
        return out


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S (smaller than the next one), and how often its first symbol repeats from there."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    lengths = np.diff(np.append(-1, ends))
    following = np.append(text[ends[:-1] + 1], -1)
    rises = following > text[ends]
    rises[-1] = True
    return np.repeat(rises, lengths), np.repeat(ends, lengths) - np.arange(n) + 1


def names(text: np.ndarray, small: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of the substring from each S* suffix to the next, by symbols and types, equal ones alike; and how many there are."""
    symbol = (2 * text + small).astype(np.uint64)
    width = int(symbol.max()).bit_length() + 1
    per = max(1, 63 // width)
    lengths = np.diff(np.append(stars, len(text))) + 1
    lengths[-1] = 1
    name, at = np.zeros(len(stars), np.int64), 0
    padded = np.concatenate([symbol + np.uint64(1), np.zeros(per, np.uint64)])
    todo = np.arange(len(stars))
    while len(todo):
        word = np.zeros(len(todo), np.uint64)
        for k in range(per):
            inside = at + k < lengths[todo]
            word = (word << np.uint64(width)) + np.where(inside, padded[np.minimum(stars[todo] + at + k, len(padded) - 1)], np.uint64(0))
        # Those that have ended differ already from longer ones in their last symbol's type, so all words can be ranked together.
        full = np.zeros(len(stars), np.uint64)
        full[todo] = word
        order = np.lexsort((full, name))
        fresh = np.append(False, (name[order][1:] != name[order][:-1]) | (full[order][1:] != full[order][:-1]))
        name[order] = np.cumsum(fresh)
        at += per
        todo = np.flatnonzero(lengths > at)
    return name, int(name.max()) + 1


class Induction:
    """The suffixes of a text from its sorted S* suffixes, with common prefixes if those of the S* suffixes are given.

    base: symbols from here on may be those of several suffixes; smaller ones (separators) are each one suffix's first.
    """

    def __init__(self, text: np.ndarray, small: np.ndarray, repeats: np.ndarray, base: int, memory: int):
        self.text, self.small, self.repeats, self.base, self.memory = text, small, repeats, base, memory

    def scan(self, key: np.ndarray, position: np.ndarray, common: np.ndarray | None, falling: bool) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes that were induced (even keys), in order, and their common prefixes with the one before."""
        text, track, top = self.text, common is not None, int(self.text.max())
        queue = Queue(self.memory)
        queue.push(key, position, common if track else np.zeros(len(key), np.int32))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        since = np.full(top - self.base + 1, -1, np.int32)  # least value since a symbol's last arrival; -1: none yet
        last_key, last_position = None, 0
        while len(queue):
            order, place, value = queue.peek()
            keys = order >> ARRIVAL
            left = place - 1
            send = (place > 0) & (self.small[left] == falling)
            symbol = text[left].astype(np.int64)
            target = np.where(send, 2 * (top - symbol if falling else symbol), np.iinfo(np.int64).max)
            before = np.minimum.accumulate(target)
            stop = np.flatnonzero(before[:-1].astype(np.uint64) < keys[1:])
            k = int(stop[0]) + 1 if len(stop) else len(keys)
            place, value, keys, left, send, symbol, target = (x[:k] for x in (place, value, keys, left, send, symbol, target))
            queue.drop(order[k - 1], k)
            induced = keys & np.uint64(1) == 0
            out.append((place[induced], value[induced]))
            chosen = np.flatnonzero(send)
            new = np.zeros(len(chosen), np.int32)
            if track:
                earlier = np.append(last_position, place[:-1])
                previous = np.append(np.uint64(0) if last_key is None else last_key, keys[:-1])
                near = np.where(keys == previous, value, np.where(keys >> np.uint64(1) == previous >> np.uint64(1), np.minimum(self.repeats[earlier], self.repeats[place]), 0)).astype(np.int32)
                if last_key is None:
                    near[0] = 0
                minima = RangeMinimum(near)
                mine = chosen[symbol[chosen] >= self.base]
                by = mine[np.argsort(symbol[mine], kind="stable")]
                of = symbol[by] - self.base
                first = np.append(True, of[1:] != of[:-1])[: len(by)]
                start = np.where(first, 0, np.append(0, by[:-1] + 1)[: len(by)])
                if len(by):
                    least = minima.of(start, by + 1)
                    least = np.where(first, np.minimum(least, since[of]), least)
                    result = np.zeros(k, np.int32)
                    result[by] = least + 1  # 0 for the first at its symbol
                    new = result[chosen]
                since = np.where(since >= 0, np.minimum(since, near.min()), since)
                if len(by):
                    final = np.append(of[1:] != of[:-1], True)
                    rest = np.full(int(final.sum()), np.iinfo(np.int32).max, np.int32)
                    ends = by[final] + 1
                    some = ends < k
                    rest[some] = minima.of(ends[some], np.full(int(some.sum()), k))
                    since[of[final]] = rest
                last_key, last_position = keys[-1], place[-1]
            queue.push(target[chosen], left[chosen], new)
        queue.close()
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def run(self, stars: np.ndarray, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order and, if tracked, their common prefixes with the one before."""
        text, top = self.text.astype(np.int64), int(self.text.max())
        falls, near = self.scan(2 * text[stars] + 1, stars, common, False)
        shifted = np.append(near[1:], 0)[::-1] if common is not None else None
        # Across symbols the shifted value is that of another bucket's first, 0 as none came before it there.
        rises, back = self.scan(2 * (top - text[falls[::-1]]) + 1, falls[::-1], shifted, True)
        rises, back = np.append(rises, len(text) - 1)[::-1], np.append(back, 0)[::-1]
        order = np.argsort(np.concatenate([2 * text[falls], 2 * text[rises] + 1]), kind="stable")
        suffixes = np.concatenate([falls, rises])[order]
        if common is None:
            return suffixes, near
        # back[j] is the prefix shared with the next larger of its type, so it moves one place on.
        values = np.concatenate([near, np.append(0, back[:-1])])[order]
        symbol, kind = text[suffixes], self.small[suffixes]
        same = np.append(False, symbol[1:] == symbol[:-1])
        seam = same & np.append(False, kind[1:] != kind[:-1])
        values = np.where(same, values, 0)
        values[seam] = np.minimum(self.repeats[suffixes[1:]], self.repeats[suffixes[:-1]])[seam[1:]]
        return suffixes, values


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at places a and b, up to `most`; a text ends in a symbol of its own."""
    out, todo = np.zeros(len(a), np.int32), np.arange(len(a))
    for k in range(most):
        todo = todo[text[np.minimum(a[todo] + k, len(text) - 1)] == text[np.minimum(b[todo] + k, len(text) - 1)]]
        if not len(todo):
            break
        out[todo] = k + 1
    return out


def suffix_array(text: np.ndarray, base: int = 0, most: int | None = None, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffixes in order and, where `most` is given, each one's common prefix with the one before, exact up to that length.

    The text's last symbol is 0 and stands nowhere else. Symbols below `base` each stand once.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    small, repeats = types(text)
    stars = np.flatnonzero(small & np.append(False, ~small[:-1]))
    name, count = names(text, small, stars)
    order = np.argsort(name) if count == len(stars) else suffix_array(name, memory=memory)[0]
    stars = stars[order]
    common = None
    if most is not None:
        common = np.append(np.int32(0), common_prefixes(text, stars[:-1], stars[1:], most))
    suffixes, values = Induction(text, small, repeats, base, memory).run(stars, common)
    return suffixes, values if most is not None else None
