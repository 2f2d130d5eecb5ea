"""A compressed trie of byte strings: one edge for each stretch without a branch."""

from __future__ import annotations

from collections.abc import Iterator


def common_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix; compares slices, not single bytes."""
    n, low, step = min(len(a), len(b)), 0, 16
    while low < n and a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    low, high = min(low, n), min(low + step, n)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Node:
    __slots__ = ("children", "end", "label", "least", "members")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.end = False  # a text ends here
        self.least: int | None = None  # the smallest id of that text
        self.members: list = []


class RadixTrie:
    """Texts with the smallest id of each at its terminal. ``size`` is the number of bytes of its different texts.

    An insertion costs the length of the text; ids that are ``None`` are never the smallest.
    """

    def __init__(self) -> None:
        self.root = Node(b"")
        self.size = 0

    def insert(self, text: bytes, doc_id: int | None) -> Node:
        """The terminal of ``text``."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node, at = node.children.setdefault(text[at], Node(text[at:])), len(text)
                continue
            label = child.label
            if not text.startswith(label, at):
                shared = common_length(label, text[at : at + len(label)])
                middle = Node(label[:shared])
                child.label = label[shared:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = child = middle
            node, at = child, at + len(child.label)
        if not node.end:
            node.end = True
            self.size += len(text)
        if doc_id is not None and (node.least is None or doc_id < node.least):
            node.least = doc_id
        return node

    def terminals(self) -> Iterator[Node]:
        """All terminals in the order of their texts."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.end:
                yield node
            stack.extend(node.children[first] for first in sorted(node.children, reverse=True))

    def separators(self, step: int, begin: int = 0) -> list[bytes]:
        """Shortest prefixes that cut the trie's texts into ranges of about ``step`` bytes, in order.

        A prefix is as long as it has to be to tell the first text at or after it from the one before: one byte beyond the
        branch where they part. The first range is shorter by ``begin`` bytes, so that the prefixes of many tries, begun at
        different places, stand for equal parts of all their texts.
        """
        found: list[bytes] = []
        passed = begin
        stack: list[tuple[Node, bytes, int, bool]] = [(self.root, b"", 0, False)]
        while stack:
            node, path, depth, parted = stack.pop()
            if parted and passed >= step:
                found.append(path + node.label[:1])
                passed = 0
            depth += len(node.label)
            passed += depth if node.end else 0
            below = path + node.label if node.children else b""
            # The first child follows its parent's own text, if that ends here, or nothing that it has to be told from.
            children = [(node.children[b], below, depth, i > 0 or node.end) for i, b in enumerate(sorted(node.children))]
            stack.extend(reversed(children))
        return found
