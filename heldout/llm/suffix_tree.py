"""Ukkonen suffix trees over whole numbers and constant-time common extensions by an Euler tour."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BLOCK = 16


class RangeMinimum:
    """Minimum of any stretch of an array: stored blocks for long stretches, prefixes and suffixes of blocks at their ends; linear memory."""

    def __init__(self, values: np.ndarray):
        n = -(-max(1, len(values)) // _BLOCK) * _BLOCK
        self.values = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, _BLOCK)
        self.prefix = np.minimum.accumulate(blocks, 1).ravel()
        self.suffix = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        span = 1
        while 2 * span <= len(blocks):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-span], low[span:]))
            span *= 2

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of ``values[first : last + 1]`` for arrays of stretches."""
        a, b = first // _BLOCK, last // _BLOCK
        out = np.minimum(self.suffix[first], self.prefix[last])
        same = np.flatnonzero(a == b)
        if len(same):
            at, stop = first[same], last[same]
            low = self.values[at]
            for _ in range(_BLOCK - 1):
                at = np.minimum(at + 1, stop)
                low = np.minimum(low, self.values[at])
            out[same] = low
        far = np.flatnonzero(b - a > 1)
        if len(far):
            lo, n = a[far] + 1, b[far] - a[far] - 1
            level = np.log2(n).astype(np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self.levels[k]
                out[far[at]] = np.minimum(out[far[at]], np.minimum(row[lo[at]], row[lo[at] + n[at] - (1 << int(k))]))
        return out


class SuffixTree:
    """The suffix tree of a sequence of whole numbers >= 0, with an end mark below them all.

    ``tour`` is the Euler tour as string depths of the nodes met, ``seen`` the
    place of each suffix's leaf in it, and ``rank`` the place of each suffix in
    the order of suffixes.  The depth of the lowest common ancestor of two leaves
    is the least depth between them.
    """

    def __init__(self, symbols: Sequence[int]):
        self.text = [*symbols, -1]
        self._build()
        self._tour()

    def _build(self) -> None:
        """Ukkonen's algorithm; a node's edge is ``text[begin:end]``, of leaves up to the end of the text."""
        text, size = self.text, len(self.text)
        begin, end, link = [0], [0], [0]
        child: list[dict[int, int] | None] = [{}]
        node, edge, length, waiting = 0, 0, 0, 0
        for i in range(size):
            symbol = text[i]
            waiting += 1
            before = 0
            while waiting:
                if not length:
                    edge = i
                first = text[edge]
                below = child[node].get(first)
                if below is None:
                    child[node][first] = len(begin)
                    begin.append(i)
                    end.append(size)
                    link.append(0)
                    child.append(None)
                    if before:
                        link[before] = node
                    before = node
                else:
                    start = begin[below]
                    stop = end[below]
                    span = (stop if stop <= i else i + 1) - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[start + length] == symbol:
                        length += 1
                        if before:
                            link[before] = node
                        break
                    middle = len(begin)
                    begin.append(start)
                    end.append(start + length)
                    link.append(0)
                    child[node][first] = middle
                    leaf = middle + 1
                    begin.append(i)
                    end.append(size)
                    link.append(0)
                    begin[below] = start + length
                    child.append({symbol: leaf, text[start + length]: below})
                    child.append(None)
                    if before:
                        link[before] = middle
                    before = middle
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        self.begin, self.end, self.child = begin, end, child

    def _tour(self) -> None:
        size = len(self.text)
        begin, end, child = self.begin, self.end, self.child
        tour, seen, rank, count = [0], [0] * size, [0] * size, 0
        depths, below = [0], [iter(sorted(child[0].items()))]
        while below:
            depth = depths[-1]
            for _, node in below[-1]:
                deeper = depth + end[node] - begin[node]
                if child[node] is None:
                    seen[size - deeper], rank[size - deeper] = len(tour), count
                    count += 1
                    tour += (deeper, depth)
                else:
                    tour.append(deeper)
                    depths.append(deeper)
                    below.append(iter(sorted(child[node].items())))
                    break
            else:
                below.pop()
                depths.pop()
                if depths:
                    tour.append(depths[-1])
        self.tour = RangeMinimum(np.array(tour, np.int32))
        self.seen = np.array(seen[:-1], np.int64)
        self.rank = rank[:-1]

    def mirror(self) -> list[int]:
        """Place of each suffix where larger numbers come first; the end mark stays below them all."""
        size = len(self.text)
        rank, count, stack = [0] * size, 0, [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if self.child[node] is None:
                if depth:
                    rank[size - depth] = count
                    count += 1
                continue
            items = sorted(self.child[node].items())
            if items[0][0] < 0:
                items.append(items.pop(0))
            stack += [(n, depth + self.end[n] - self.begin[n]) for _, n in items]
        return rank[:-1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, i != j, both inside the text."""
        a, b = self.seen[i], self.seen[j]
        return self.tour.query(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)
