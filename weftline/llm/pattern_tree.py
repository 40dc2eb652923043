"""Position-coded access-pattern tree.

Sequences are merged into one prefix tree whose nodes are numbered in pre-order. A node's code is
the pair (own number, last number below it), so that "x lies below y" is two comparisons. The header
of a label lists its nodes in pre-order, each with the nearest node of the same label above it.
A pattern is the set of nodes where it is first complete on each branch; its support is the sum of
their counts. Growing it by a label needs only that label's header, so no smaller trees are built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


class PatternTree:
    """Of sequences (strings of one character per label) with counts."""

    def __init__(self, counts: dict[str, int]):
        count, end, above, headers = [0], [0], [0], {}
        nearest: dict[str, list[int]] = {}
        path: list[int] = []
        previous = ""

        def leave(depth: int) -> None:
            while len(path) > depth:
                node = path.pop()
                end[node] = len(count) - 1
                nearest[previous[len(path)]].pop()

        for sequence in sorted(counts):
            n, common = counts[sequence], 0
            for x, y in zip(previous, sequence):
                if x != y:
                    break
                common += 1
            leave(common)
            for node in path:
                count[node] += n
            for x in sequence[common:]:
                node = len(count)
                same = nearest.setdefault(x, [])
                headers.setdefault(x, []).append(node)
                count.append(n)
                end.append(node)
                above.append(same[-1] if same else 0)
                same.append(node)
                path.append(node)
            count[0] += n
            previous = sequence
        leave(0)
        end[0] = len(count) - 1
        self.count, self.end = np.array(count, np.int64), np.array(end, np.int64)
        self.above = np.array(above, np.int64)
        self.headers = {x: np.array(nodes, np.int64) for x, nodes in headers.items()}

    def grow(self, at: np.ndarray, label: str) -> np.ndarray:
        """The nodes of `label` that come first below the nodes `at` (disjoint, in pre-order)."""
        nodes = self.headers.get(label)
        if nodes is None or not len(at):
            return np.empty(0, np.int64)
        under = at[np.maximum(np.searchsorted(at, nodes, "left") - 1, 0)]
        return nodes[(under < nodes) & (nodes <= self.end[under]) & (self.above[nodes] <= under)]

    def mine(self, keep: Callable[[str, int], bool], longest: int, different: bool = True) -> Iterator[tuple[str, int]]:
        """Every pattern of up to `longest` labels for which, and for all its prefixes, keep(pattern, support) holds."""
        labels = sorted(self.headers)
        todo = [("", np.zeros(1, np.int64))]
        while todo:
            pattern, at = todo.pop()
            for x in labels:
                if different and x in pattern:
                    continue
                nodes = self.grow(at, x)
                support = int(self.count[nodes].sum())
                if support and keep(pattern + x, support):
                    yield pattern + x, support
                    if len(pattern) + 1 < longest:
                        todo.append((pattern + x, nodes))
