"""Suffix sorting with common-prefix values by induced sorting on disk-backed queues.

The suffixes at left-most S positions are sorted first, by recursion on their names; all others
are induced from them, L suffixes in a rising and S suffixes in a falling pass over the
characters. Each pass takes the suffixes of one character from a priority queue in bulk, in their final order,
and puts their predecessors into the queues of the predecessors' characters, together with the length of the prefix
shared with the one put there before: one more than the least shared length between the two sources. The
queues hold a bounded number of entries in memory and keep the rest in unnamed scratch files of the task.

Prefix lengths are counted up to a cap: suffixes equal that far may come in either order.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP = 200
#: Entries that a queue keeps in memory, and names that are sorted in memory.
ROOM = 1 << 22
_FAR = np.uint8(255)


class Queue:
    """Entries (position, shared length) by character, taken out one whole character at a time."""

    def __init__(self, room: int = ROOM) -> None:
        self.room, self.held = room, 0
        self.memory: dict[int, list] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def put(self, char: int, position: np.ndarray, shared: np.ndarray) -> None:
        self.memory.setdefault(char, []).append((position, shared))
        self.held += len(position)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for char, parts in self.memory.items():
            n = sum(len(p) for p, _ in parts)
            self.disk.setdefault(char, []).append((self.file.tell(), n))
            for p, _ in parts:
                self.file.write(np.ascontiguousarray(p, np.int64).tobytes())
            for _, s in parts:
                self.file.write(np.ascontiguousarray(s, np.uint8).tobytes())
        self.memory.clear()
        self.held = 0

    def chars(self) -> set:
        return set(self.memory) | set(self.disk)

    def take(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        position, shared = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        for at, n in self.disk.pop(char, []):
            self.file.seek(at)
            position.append(np.frombuffer(self.file.read(8 * n), np.int64))
            shared.append(np.frombuffer(self.file.read(n), np.uint8))
        for p, s in self.memory.pop(char, []):
            self.held -= len(p)
            position.append(p)
            shared.append(s)
        return np.concatenate(position), np.concatenate(shared)


class _Least:
    """The least of any range of a list of lengths."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low : high], high > low."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out


class Sorter:
    """Sorts the suffixes of one text whose last character is its only least one."""

    def __init__(self, text: np.ndarray, cap: int = CAP, room: int = ROOM) -> None:
        self.text, self.cap, self.room = text, cap, room
        n = len(text)
        # a suffix is S if the next different character is larger
        change = np.flatnonzero(text[:-1] != text[1:])
        self.small = np.ones(n, bool)
        if len(change):
            runs = np.diff(np.concatenate([[-1], change]))
            self.small[: change[-1] + 1] = np.repeat(text[change] < text[change + 1], runs)
        self.left = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.alphabet = np.unique(text)

    def _eight(self) -> np.ndarray:
        """The eight characters from each position on, as one number."""
        padded = np.concatenate([self.text.astype(np.uint8), np.zeros(8 + self.cap, np.uint8)])
        out = np.zeros(len(padded) - 8, np.uint64)
        for i in range(8):
            out |= padded[i : len(padded) - 8 + i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to the cap, by comparison (texts of bytes)."""
        if not hasattr(self, "eight"):
            self.eight = self._eight()
        out = np.full(len(a), self.cap, np.uint8)
        open_ = np.arange(len(a))
        for step in range(0, self.cap, 8):
            x = self.eight[a[open_] + step] ^ self.eight[b[open_] + step]
            differ = np.flatnonzero(x)
            if len(differ):
                low = x[differ] & (~x[differ] + np.uint64(1))
                byte = (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
                out[open_[differ]] = np.minimum(step + byte, self.cap)
                open_ = open_[x == 0]
            if not len(open_):
                break
        return out

    def _deal(self, queue: Queue, since: dict, position: np.ndarray, shared: np.ndarray, small: bool, same: int, lengths: bool):
        """Puts the predecessors of scanned suffixes into their queues; returns those of the character ``same`` for the next round."""
        k = len(position)
        before = position - 1
        good = np.flatnonzero((before >= 0) & (self.small[before] == small))
        before = before[good]
        chars = self.text[before]
        order = np.argsort(chars, kind="stable")
        good, before, chars = good[order], before[order], chars[order]
        edge = np.flatnonzero(np.diff(chars)) + 1 if len(chars) else np.empty(0, np.int64)
        starts = np.concatenate([[0], edge]).astype(np.int64) if len(chars) else edge
        ends = np.append(edge, len(chars)).astype(np.int64) if len(chars) else edge
        value = np.zeros(len(good), np.uint8)
        if lengths and k:
            least = _Least(shared)
            if len(good):
                low = np.empty(len(good), np.int64)
                low[1:] = good[:-1] + 1
                low[starts] = 0
                value = least.between(low, good + 1)
                whole = int(least.between(np.array([0]), np.array([k]))[0])
            else:
                whole = int(shared.min())
            for c in since:
                since[c] = min(since[c], whole) if c not in self._now(chars, starts) else since[c]
            for s, e in zip(starts.tolist(), ends.tolist()):
                c = int(chars[s])
                value[s] = min(int(value[s]), since[c]) if c in since else 0
                last = int(good[e - 1]) + 1
                since[c] = int(least.between(np.array([last]), np.array([k]))[0]) if last < k else int(_FAR)
            first = [s for s in starts.tolist() if (int(chars[s])) not in self._seen]
            value = np.minimum(value.astype(np.int64) + 1, self.cap).astype(np.uint8)
            value[first] = 0
            self._seen.update(int(chars[s]) for s in first)
        again = (np.empty(0, np.int64), np.empty(0, np.uint8))
        for s, e in zip(starts.tolist(), ends.tolist()):
            c = int(chars[s])
            if c == same:
                again = (before[s:e], value[s:e])
            else:
                queue.put(c, before[s:e], value[s:e])
        return again

    def _now(self, chars: np.ndarray, starts: np.ndarray) -> set:
        return set(chars[starts].tolist())

    def induce(self, order: np.ndarray, shared: np.ndarray | None):
        """All suffixes in order, with the length shared with the one before, given those of the left-most S positions."""
        lengths = shared is not None
        at = self.text[order]
        where = np.searchsorted(at, self.alphabet)
        upto = np.searchsorted(at, self.alphabet, side="right")
        queue, large = Queue(self.room), Queue(self.room)
        since: dict[int, int] = {}
        self._seen: set = set()
        for i, c in enumerate(self.alphabet.tolist()):
            position, length = queue.take(c)
            tail = None
            while len(position):
                tail = position[-1:]
                large.put(c, position, length)
                position, length = self._deal(queue, since, position, length, False, c, lengths)
            own = order[where[i] : upto[i]]
            if len(own):
                own_length = shared[where[i] : upto[i]].copy() if lengths else np.zeros(len(own), np.uint8)
                if lengths:
                    own_length[0] = self.shared(tail, own[:1])[0] if tail is not None else 0
                self._deal(queue, since, own, own_length, False, -1, lengths)
        out: list = []
        queue, since, self._seen = Queue(self.room), {}, set()
        n = len(self.text)
        for i in range(len(self.alphabet) - 1, -1, -1):
            c = int(self.alphabet[i])
            position, length = queue.take(c)
            if c == int(self.text[-1]):
                position, length = np.array([n - 1]), np.zeros(1, np.uint8)
            small: list = []
            while len(position):
                small.append((position, length))
                position, length = self._deal(queue, since, position, length, True, c, lengths)
            above, above_length = large.take(c)
            seam = 0
            if len(above):
                # falling: each with the one scanned before it, which is the next larger
                falling = np.zeros(len(above), np.uint8)
                falling[1:] = above_length[:0:-1]
                if small and lengths:
                    seam = int(self.shared(above[-1:], small[-1][0][-1:])[0])
                    falling[0] = seam
                self._deal(queue, since, above[::-1], falling, True, -1, lengths)
            if small:
                p = np.concatenate([x for x, _ in small])[::-1]
                f = np.concatenate([x for _, x in small])
                rising = np.zeros(len(p), np.uint8)
                rising[1:] = f[:0:-1]
                rising[0] = seam
                out.append((p, rising))
            if len(above):
                out.append((above, above_length))
        out.reverse()
        return np.concatenate([p for p, _ in out]), np.concatenate([s for _, s in out])

    def _names(self) -> np.ndarray:
        """A name for each left-most S position, in text order; equal for equal strings up to the next one, and in their order."""
        text, left = self.text, self.left
        by_char = left[np.argsort(text[left], kind="stable")]
        order, _ = self.induce(by_char, None)
        is_left = np.zeros(len(text), bool)
        is_left[left] = True
        order = order[is_left[order]]
        ends = np.append(left[1:], len(text) - 1)
        from .common import mix, powers  # the hash of each string, its last character included

        up, down = powers(len(text) + 1)
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
        h = mix((total[ends + 1] - total[left]) * down[left])
        number = np.empty(len(text), np.int64)
        number[left] = np.arange(len(left))
        index = number[order]
        length = (ends - left)[index]
        new = np.ones(len(order), bool)
        new[1:] = (h[index][1:] != h[index][:-1]) | (length[1:] != length[:-1])
        names = np.empty(len(order), np.int64)
        names[index] = np.cumsum(new) - 1
        return names

    def order_left(self) -> np.ndarray:
        """The left-most S positions in the order of their suffixes."""
        names = self._names()
        n = len(names)
        if n and int(names.max()) + 1 < n:
            if n > self.room:
                # the names as a text of their own, whose last is its only least: the end's
                order, _ = Sorter(names, self.cap, self.room).induce_all(False)
            else:
                order = _doubled(names, self.cap)
        else:
            order = np.argsort(names, kind="stable")
        return self.left[order]

    def induce_all(self, lengths: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if len(self.text) == 1:
            return np.zeros(1, np.int64), np.zeros(1, np.uint8)
        order = self.order_left()
        shared = None
        if lengths:
            shared = np.zeros(len(order), np.uint8)
            shared[1:] = self.shared(order[:-1], order[1:])
        return self.induce(order, shared)


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """Suffixes of a list of names in order, by doubling; each name stands for two characters or more."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    step = 1
    while 2 * step < cap + 2:  # after this round the ranks tell 2 * step names apart, 4 * step characters or more
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        after = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        group = rank[open_]
        place = np.argsort(group * (n + 2) + after)
        group, key = group[place], after[place]
        begins = np.concatenate([[True], np.diff(group) != 0])
        fresh = begins | np.concatenate([[True], np.diff(key) != 0])
        index = np.arange(len(place))
        start = np.maximum.accumulate(np.where(begins, index, 0))
        lead = np.maximum.accumulate(np.where(fresh, index, 0))
        rank[open_[place]] = group + lead - start
        step *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, cap: int = CAP, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` (bytes; the last its only least) in order, and their common-prefix lengths up to ``cap``."""
    return Sorter(text, cap, room).induce_all()
