"""Deep-shallow string sorting: multikey quicksort to a shallow depth, then blind tries for what still ties."""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort looks at, in words of eight; groups this small are compared outright.
SHALLOW = 24
FEW = 12


def _words(strings: list[bytes]) -> np.ndarray:
    """The first SHALLOW bytes of each string as big-endian words; ends are padded with zero bytes."""
    data = b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings])
    return np.frombuffer(data, ">u8").reshape(len(strings), -1).astype(np.uint64)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A trie of strings whose inner nodes hold only a depth and a child per byte there (-1: the string ends)."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly, without a look at the bytes between depths
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            above, node = (node, s[node[0]]), node[1][s[node[0]]]
        byte = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte] = [i]
            return
        inner = (same, {byte: [i], (other[same] if same < len(other) else -1): node})
        if above is None:
            self.root = inner
        else:
            above[0][1][above[1]] = inner

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before (that of the first is 0)."""
        order, prefixes, stack = [], [], [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, tuple):
                at, children = node
                kids = [children[b] for b in sorted(children)]
                stack += [(k, at) for k in reversed(kids[1:])] + [(kids[0], depth)]
            else:
                n = len(self.strings[node[0]])
                order += node
                prefixes += [depth] + [n] * (len(node) - 1)
        return order, prefixes


def sort_strings(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the order of the strings, and each one's common prefix with the one before it in that order.

    A string sorts before those it is a prefix of.
    """
    n = len(strings)
    words = _words(strings) if n else np.empty((0, SHALLOW // 8), np.uint64)
    order, lcp, filled = np.empty(n, np.int64), np.zeros(n, np.int64), 0
    # a stack of (indices, word): the top holds the least strings that are not placed yet
    stack: list[tuple[np.ndarray, int]] = [(np.arange(n), 0)] if n else []
    while stack:
        part, w = stack.pop()
        if w < words.shape[1] and len(part) > 1:
            key = words[part, w]
            if len(part) <= FEW:
                ranks = np.argsort(key, kind="stable")
                bounds = np.flatnonzero(np.diff(key[ranks])) + 1
                stack += [(p, w + 1) for p in np.split(part[ranks], bounds)[::-1]]
                continue
            pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
            less, more = part[key < pivot], part[key > pivot]
            stack += [(p, d) for p, d in ((more, w), (part[key == pivot], w + 1), (less, w)) if len(p)]
            continue
        if len(part) == 1:
            order[filled] = part[0]
            if filled:
                lcp[filled] = common_prefix(strings[order[filled - 1]], strings[part[0]])
            filled += 1
            continue
        trie = BlindTrie(strings)
        for i in part.tolist():
            trie.insert(i)
        found, prefixes = trie.ordered()
        order[filled : filled + len(found)], lcp[filled : filled + len(found)] = found, prefixes
        if filled:
            lcp[filled] = common_prefix(strings[order[filled - 1]], strings[found[0]])
        filled += len(found)
    return order, lcp
