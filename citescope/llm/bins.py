"""Trees for best-fit packing: the tightest bin that still has room, in logarithmic time."""

from __future__ import annotations


class RoomTree:
    """A segment tree over remaining capacities 0 to ``limit``, counting bins of each."""

    def __init__(self, limit: int):
        self.base = 1 << limit.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, room: int, n: int) -> None:
        at = self.base + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of any bin that is at least ``size``."""
        at = self.base + size
        if size >= self.base:
            return None
        while not self.count[at]:
            while at & 1:  # a right child, or the root: nothing further right below the parent
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.base:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.base


class BinTree:
    """A balanced (AA) tree of bins ordered by (remaining capacity, bin)."""

    class _Node:
        __slots__ = ("key", "left", "right", "level")

        def __init__(self, key):
            self.key, self.left, self.right, self.level = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _level(node) -> int:
        return node.level if node else 0

    def _skew(self, node):
        if node and node.left and node.left.level == node.level:
            left = node.left
            node.left, left.right = left.right, node
            return left
        return node

    def _split(self, node):
        if node and node.right and node.right.right and node.right.right.level == node.level:
            right = node.right
            node.right, right.left = right.left, node
            right.level += 1
            return right
        return node

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, node, key):
        if node is None:
            return self._Node(key)
        if key < node.key:
            node.left = self._insert(node.left, key)
        else:
            node.right = self._insert(node.right, key)
        return self._split(self._skew(node))

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, node, key):
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None:
            return node.right
        elif node.right is None:
            return node.left
        else:
            after = node.right
            while after.left:
                after = after.left
            node.key = after.key
            node.right = self._remove(node.right, after.key)
        low = min(self._level(node.left), self._level(node.right)) + 1
        if low < node.level:
            node.level = low
            if node.right and node.right.level > low:
                node.right.level = low
        node = self._skew(node)
        node.right = self._skew(node.right)
        if node.right:
            node.right.right = self._skew(node.right.right)
        node = self._split(node)
        node.right = self._split(node.right)
        return node

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity that is at least ``size``."""
        node, found = self.root, None
        while node:
            if node.key >= (size, -1):
                found, node = node.key, node.left
            else:
                node = node.right
        return found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; items of decreasing size enter the tightest bin with room.

    An item larger than ``capacity`` gets a bin of its own."""
    tree, bins = BinTree(), 0
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), bins)
            bins += 1
        else:
            tree.remove(found)
        out[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return out
