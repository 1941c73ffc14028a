"""An adaptive radix tree (Leis et al. 2013) over byte keys, for one range of sorted conversations.

Inner nodes hold their children in one of four layouts (4, 16, 48 or 256 places) and grow
from one to the next; bytes that all keys below a node share are kept in the node
(path compression). A key may end inside the path of a longer one: the node at that depth
then holds the places of the conversations that end there.
"""

from __future__ import annotations

from bisect import bisect_left

_NONE = 255  # no child, in the index of the 48-place layout


class Node:
    """``path``: bytes shared by all keys below, after the byte that leads here; ``ends``: places of keys ending after them."""

    __slots__ = ("path", "ends", "places", "keys", "kids")

    def __init__(self, path: bytes) -> None:
        self.path, self.ends, self.places, self.keys, self.kids = path, [], 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.places <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.places == 48:
            at = self.keys[byte]
            return self.kids[at] if at != _NONE else None
        return self.kids[byte]

    def replace(self, byte: int, kid: Node) -> None:
        at = self.keys.find(byte) if self.places <= 16 else self.keys[byte] if self.places == 48 else byte
        self.kids[at] = kid

    def add(self, byte: int, kid: Node) -> None:
        if self.places < 256 and len(self.kids) == self.places:
            self._grow()
        if self.places <= 16:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.places == 48:
            self.keys[byte] = len(self.kids)
            self.kids.append(kid)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray([_NONE] * 256)
            for at, byte in enumerate(self.keys):
                index[byte] = at
            self.places, self.keys = 48, index
        else:
            wide: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.keys):
                if at != _NONE:
                    wide[byte] = self.kids[at]
            self.places, self.keys, self.kids = 256, bytearray(), wide

    def children(self) -> list[Node]:
        """Children in order of their bytes."""
        if self.places <= 16:
            return self.kids
        if self.places == 48:
            return [self.kids[at] for at in self.keys if at != _NONE]
        return [kid for kid in self.kids if kid is not None]


def shared(a: bytes, b: bytes) -> int:
    """Leading bytes that ``a`` and ``b`` have in common."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Tree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, place: int) -> None:
        """Let the conversation with this place end after ``key``."""
        node, upper, led, at = self.root, None, 0, 0
        while True:
            rest = key[at : at + len(node.path)]
            same = shared(node.path, rest)
            if same < len(node.path):
                above = Node(node.path[:same])
                above.add(node.path[same], node)
                node.path = node.path[same + 1 :]
                if upper is None:
                    self.root = above
                else:
                    upper.replace(led, above)
                node = above
            at += same
            if at == len(key):
                node.ends.append(place)
                return
            led, at = key[at], at + 1
            below = node.child(led)
            if below is None:
                leaf = Node(key[at:])
                leaf.ends.append(place)
                node.add(led, leaf)
                return
            upper, node = node, below
