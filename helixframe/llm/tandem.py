"""All runs of a sequence by its tandem repeats, after Gusfield and Stoye.

A tandem repeat is a square: ``2 * k`` symbols whose halves are equal. A run is a
stretch of smallest period k and length 2k or more that can't be extended.

1. The sequence is cut into Lempel-Ziv blocks. The leftmost occurrence of a square has
   the middle in some block and reaches over one of its ends, so Z functions over a
   block and its successor give pairs (start, k) that cover every leftmost occurrence.
2. Each pair is marked in the suffix tree, at the place where its square ends.
3. From each mark a walk by suffix links goes from the square ``a x a x`` to ``x a x a``
   as long as that occurs anywhere and isn't marked; then the vocabulary is complete.
4. The leaves below a mark are the square's occurrences. Those of one period at
   successive places merge into a run. Squares of squares lie in runs of smaller period
   and are left out, so a place starts few of the rest.

Work on one sequence is linear but for step 4, which is O(n log n), and so is memory.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict


class SuffixTree:
    """Ukkonen's tree over ``symbols`` (integers of 0 or more) and a last symbol of its own."""

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, -1]
        n = len(text)
        start, end, link, kids = [0], [0], [0], [{}]

        def new(a: int, b: int, below: dict | None) -> int:
            start.append(a)
            end.append(b)
            link.append(0)
            kids.append(below)
            return len(start) - 1

        node = edge = length = rest = 0
        for pos, symbol in enumerate(text):
            rest += 1
            last = 0  # the inner node that still waits for its suffix link
            while rest:
                if length == 0:
                    edge = pos
                first = text[edge]
                below = kids[node].get(first)
                if below is None:
                    kids[node][first] = new(pos, n, None)
                    if last:
                        link[last] = node
                    last = node
                else:
                    span = min(end[below], pos + 1) - start[below]
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    if text[start[below] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = new(start[below], start[below] + length, {})
                    kids[node][first] = middle
                    kids[middle][symbol] = new(pos, n, None)
                    start[below] += length
                    kids[middle][text[start[below]]] = below
                    if last:
                        link[last] = middle
                    last = middle
                rest -= 1
                if node == 0 and length:
                    length -= 1
                    edge = pos - rest + 1
                else:
                    node = link[node]
        self.link, self.kids = link, kids
        self._number(start, end, n)

    def _number(self, start: list[int], end: list[int], n: int) -> None:
        """Depths, parents, leaves in depth-first order, and each node's range of leaves and its first occurrence."""
        many = len(start)
        self.depth, self.parent, self.low, self.count, self.first = ([0] * many for _ in range(5))
        self.first = [n] * many
        self.leaves, self.leaf = [], [0] * n
        depth, parent, low, count, first, kids = self.depth, self.parent, self.low, self.count, self.first, self.kids
        order, stack = [], [0]
        while stack:
            v = stack.pop()
            order.append(v)
            low[v] = len(self.leaves)
            below = kids[v]
            if below is None:
                i = n - depth[v]
                first[v], count[v], self.leaf[i] = i, 1, v
                self.leaves.append(i)
            else:
                for c in below.values():
                    parent[c] = v
                    depth[c] = depth[v] + end[c] - start[c]
                    stack.append(c)
        for v in reversed(order[1:]):
            p = parent[v]
            count[p] += count[v]
            if first[v] < first[p]:
                first[p] = first[v]

    def blocks(self) -> list[int]:
        """Where the Lempel-Ziv blocks begin, then the end: each is the longest prefix that occurs earlier, or one new symbol."""
        text, kids, depth, first = self.text, self.kids, self.depth, self.first
        n, at, cuts = len(text) - 1, 0, []
        while at < n:
            cuts.append(at)
            node = 0
            while at + depth[node] < n:
                below = kids[node][text[at + depth[node]]]
                if first[below] >= at:
                    break
                node = below
            at += max(1, depth[node])
        return [*cuts, n]

    def turned(self, node: int, half: int) -> int | None:
        """The place of x a x a, for the square a x a x that ends on the edge into ``node``; None where it doesn't occur."""
        text, kids, depth = self.text, self.kids, self.depth
        i, wanted = self.first[node], 2 * half - 1
        u = self.link[self.parent[node]]
        while True:
            below = kids[u][text[i + 1 + depth[u]]]
            if depth[below] >= wanted:
                break
            u = below
        if depth[below] == wanted:
            return kids[below].get(text[i])
        return below if text[self.first[below] + wanted] == text[i] else None


def z_function(x: list[int]) -> list[int]:
    """For each place, how many symbols from there on equal the sequence's first ones."""
    n = len(x)
    z = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def covering_squares(text: list[int], cuts: list[int]) -> set[tuple[int, int]]:
    """(start, half) pairs; every square's leftmost occurrence follows one of them by steps of one place, each a square of that half."""
    found, n = set(), cuts[-1]
    for b in range(len(cuts) - 1):
        h, h1 = cuts[b], cuts[b + 1]
        h2 = cuts[b + 2] if b + 2 < len(cuts) else n
        size, both = h1 - h, h2 - h
        if h2 > h1:  # squares that reach over the block's end
            ahead = z_function([*text[h1:h2], -2, *text[h:h2]])[h2 - h1 + 1 :]
            back = z_function(text[max(0, h1 - 2 * size) : h1][::-1])
            for k in range(1, size + 1):
                q = h1 - k
                k1, k2 = ahead[size - k], back[k] if k < len(back) else 0
                if k1 and k1 + k2 >= k:
                    found.add((max(q - k2, q - k + 1), k))
        if h:  # squares that begin before the block
            ahead = z_function(text[h:h2])
            left = text[max(0, h - both) : h][::-1]
            back = z_function([*left, -2, *text[max(0, h - both) : h2][::-1]])[len(left) + 1 :]
            for k in range(1, both):
                k1, k2 = ahead[k], back[both - k]
                if k1 and k2 and k1 + k2 >= k:
                    start = max(h - k2, h - k + 1)
                    if start < h and start + k <= h1:
                        found.add((start, k))
    return found


def vocabulary(tree: SuffixTree, pairs: set[tuple[int, int]]) -> dict[int, set[int]]:
    """By half length, the tree's nodes whose edges hold the ends of all different squares."""
    depth, parent = tree.depth, tree.parent
    marks, by_start = defaultdict(set), defaultdict(list)
    for s, k in pairs:
        by_start[s].append(k)
    for s, halves in by_start.items():
        at = tree.leaf[s]
        for k in sorted(halves, reverse=True):
            while depth[parent[at]] >= 2 * k:
                at = parent[at]
            node, known = at, marks[k]
            while node is not None and node not in known:
                known.add(node)
                node = tree.turned(node, k)
    return marks


def located(tree: SuffixTree, marks: dict[int, set[int]]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run."""
    found, by_period = [], {}
    for k in sorted(marks):
        starts = []
        for node in marks[k]:
            i = tree.first[node]
            for q, (begins, ends) in by_period.items():
                if k % q == 0 and (at := bisect_right(begins, i)) and ends[at - 1] >= i + 2 * k:
                    break  # a square of squares
            else:
                starts += tree.leaves[tree.low[node] : tree.low[node] + tree.count[node]]
        if starts:
            starts.sort()
            begins, ends, last = [starts[0]], [], starts[0]
            for s in starts[1:]:
                if s > last + 1:
                    ends.append(last + 2 * k)
                    begins.append(s)
                last = s
            by_period[k] = begins, [*ends, last + 2 * k]
            found += [(a, b - a, k) for a, b in zip(*by_period[k])]
    return sorted(found)


def runs(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``symbols``, by start and period."""
    if len(symbols) < 2:
        return []
    tree = SuffixTree(symbols)
    return located(tree, vocabulary(tree, covering_squares(tree.text, tree.blocks())))
