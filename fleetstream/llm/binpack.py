"""Packing of lengths into bins of one capacity: best fit decreasing with a segment tree, and swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, insort


class CapacityTree:
    """Segment tree over capacities 0..most; a node holds the largest capacity below it that some bin has left."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.tree = [-1] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _set(self, left: int, value: int) -> None:
        at = left + self.base
        self.tree[at] = value
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])

    def add(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        if len(self.bins[left]) == 1:
            self._set(left, left)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) with the least capacity of at least ``need``."""
        if self.tree[1] < need:
            return None
        at = need + self.base
        if self.tree[at] < 0:
            while at & 1 or self.tree[at + 1] < 0:  # up until a right sibling has something
                at //= 2
            at += 1
            while at < self.base:
                at = 2 * at if self.tree[2 * at] >= 0 else 2 * at + 1
        left = at - self.base
        number = self.bins[left].pop()
        if not self.bins[left]:
            self._set(left, -1)
        return left, number


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item (lengths from 0 to ``capacity``); ties go by position, so the result is fixed."""
    tree, out, used = CapacityTree(capacity), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left, number = tree.take(lengths[i]) or (capacity, used)
        used += number == used
        out[i] = number
        tree.add(left - lengths[i], number)
    return out


class _Open:
    """Bins of a local search: items by length in each bin, and bins by fill."""

    def __init__(self, lengths: list[int], bins: list[int], capacity: int):
        self.capacity, self.items, self.fill = capacity, {}, {}
        for i, b in enumerate(bins):
            self.items.setdefault(b, []).append((lengths[i], i))
            self.fill[b] = self.fill.get(b, 0) + lengths[i]
        for x in self.items.values():
            x.sort()

    def shift(self, source: int, target: int, out: list[tuple[int, int]], back: list[tuple[int, int]]) -> None:
        for x in out:
            self.items[source].remove(x)
            insort(self.items[target], x)
        for x in back:
            self.items[target].remove(x)
            insort(self.items[source], x)
        moved = sum(n for n, _ in out) - sum(n for n, _ in back)
        self.fill[source] -= moved
        self.fill[target] += moved
        if not self.items[source]:
            del self.items[source], self.fill[source]

    def step(self, source: int, target: int) -> bool:
        """The exchange that moves most from ``source`` to the fuller ``target`` within its room: it raises the sum of squared fills."""
        room, best = self.capacity - self.fill[target], (0, [], [])
        mine, theirs = self.items[source], self.items[target]
        at = bisect_left(mine, (room + 1, -1))
        if at:
            best = (mine[at - 1][0], [mine[at - 1]], [])  # a move
        for x in mine:
            if best[0] == room:
                break
            k = bisect_left(theirs, (x[0] - room, -1))
            if k < len(theirs) and x[0] - theirs[k][0] > best[0]:
                best = (x[0] - theirs[k][0], [x], [theirs[k]])  # one for one
            lo, hi = 0, len(theirs) - 1  # one for two: the two least that free enough room
            while lo < hi:
                gain = x[0] - theirs[lo][0] - theirs[hi][0]
                if gain > room:
                    lo += 1
                else:
                    if gain > best[0]:
                        best = (gain, [x], [theirs[lo], theirs[hi]])
                    hi -= 1
        for y in theirs:
            if best[0] == room:
                break
            lo, hi = 0, len(mine) - 1  # two for one
            while lo < hi:
                gain = mine[lo][0] + mine[hi][0] - y[0]
                if gain > room:
                    hi -= 1
                else:
                    if gain > best[0]:
                        best = (gain, [mine[lo], mine[hi]], [y])
                    lo += 1
        if best[0] <= 0:
            return False
        self.shift(source, target, best[1], best[2])
        return True


def swap_search(lengths: list[int], capacity: int, start: list[int] | None = None) -> list[int]:
    """Bin of each item after local search from ``start`` (best fit decreasing if none).

    The emptiest bin gives items to fuller ones by moves and exchanges of one
    for one, one for two and two for one, each of which raises the sum of
    squared fills, so the search ends. It stops when as few bins are left as
    the total allows, or when no exchange helps.
    """
    state = _Open(lengths, start or best_fit_decreasing(lengths, capacity), capacity)
    least = -(-sum(lengths) // capacity)
    moved = True
    while moved and len(state.items) > max(least, 1):
        moved = False
        open_ = sorted((b for b in state.items if state.fill[b] < capacity), key=lambda b: (state.fill[b], b))
        for k, source in enumerate(open_):
            for target in reversed(open_[k + 1 :]):
                while source in state.items and state.fill[target] < capacity and state.step(source, target):
                    moved = True
                if source not in state.items:
                    break
            if moved:
                break
    out = [0] * len(lengths)
    for number, b in enumerate(sorted(state.items)):
        for _, i in state.items[b]:
            out[i] = number
    return out
