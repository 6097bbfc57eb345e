"""Deep-shallow sorting of many short byte strings: multikey quicksort, then blind tries."""

from __future__ import annotations

import numpy as np

#: Partitions of fewer strings are put in order by comparing their shallow parts.
SMALL = 24


def words_of(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte big-endian numbers, zeros at the end."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    return padded.view(">u8").astype(np.uint64)


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of rows by their columns from left to right, and the ranges of that order whose rows are all equal.

    Each step splits a range in three by a pivot's value in one column; only the middle part goes on
    to the next column.
    """
    n, depth = keys.shape
    order = np.arange(n)
    equal: list[tuple[int, int]] = []
    pending = [(0, n, 0)]
    while pending:
        lo, hi, column = pending.pop()
        if hi - lo < 2:
            continue
        if column == depth:
            equal.append((lo, hi))
            continue
        if hi - lo <= SMALL:
            rows = keys[order[lo:hi], column:].tolist()
            rank = sorted(range(hi - lo), key=rows.__getitem__)
            order[lo:hi] = order[lo:hi][rank]
            start = 0
            for i in range(1, hi - lo + 1):
                if i == hi - lo or rows[rank[i]] != rows[rank[start]]:
                    if i - start > 1:
                        equal.append((lo + start, lo + i))
                    start = i
            continue
        part = order[lo:hi]
        value = keys[part, column]
        pivot = np.sort(value[:: max(1, (hi - lo) // 9)])
        pivot = pivot[len(pivot) // 2]
        less, more = value < pivot, value > pivot
        same = ~(less | more)
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        pending += [(lo, a, column), (a, b, column + 1), (b, hi, column)]
    return order, equal


class BlindTrie:
    """Patricia trie over byte strings of one length: a node looks at one position only.

    An insertion first walks down blindly, by the positions that the nodes look at, to some string;
    the first difference from that one is where the new string branches off.
    """

    __slots__ = ("root", "strings")

    def __init__(self) -> None:
        self.root: list | int | None = None
        self.strings: list[bytes] = []

    def insert(self, string: bytes) -> int:
        """Number of this string; an equal one keeps its number."""
        if self.root is None:
            self.strings.append(string)
            self.root = 0
            return 0
        node = self.root
        while not isinstance(node, int):  # blindly: any leaf below will do where there is no such branch
            branches = node[1]
            node = branches.get(string[node[0]])
            if node is None:
                node = next(iter(branches.values()))
        other = self.strings[node]
        if other == string:
            return node
        at = next(i for i, (x, y) in enumerate(zip(string, other, strict=True)) if x != y)
        made = len(self.strings)
        self.strings.append(string)
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < at:
            parent, node = node, node[1][string[node[0]]]
        if not isinstance(node, int) and node[0] == at:
            node[1][string[at]] = made
            return made
        branch = [at, {other[at]: node, string[at]: made}]
        if parent is None:
            self.root = branch
        else:
            parent[1][string[parent[0]]] = branch
        return made

    def ordered(self) -> list[int]:
        """Numbers of the strings in order."""
        out: list[int] = []
        pending = [self.root] if self.root is not None else []
        while pending:
            node = pending.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                pending += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: np.ndarray, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings (rows), and each one's common prefix with the one before it.

    Equal strings are next to one another. shallow: bytes sorted by multikey quicksort, a multiple
    of 8; strings that are equal so far are ordered by a blind trie over their remaining bytes.
    """
    n, width = strings.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, equal = multikey_quicksort(words_of(strings[:, :shallow]))
    if width > shallow:
        rest = np.ascontiguousarray(strings[:, shallow:])
        for lo, hi in equal:
            rows = order[lo:hi]
            if hi - lo == 2 and (rest[rows[0]] == rest[rows[1]]).all():
                continue
            trie = BlindTrie()
            numbers = np.array([trie.insert(rest[r].tobytes()) for r in rows])
            place = np.empty(len(trie.strings), np.int64)
            place[trie.ordered()] = np.arange(len(trie.strings))
            order[lo:hi] = rows[np.argsort(place[numbers], kind="stable")]
    together = strings[order]
    differ = together[1:] != together[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width) if n > 1 else np.empty(0, np.int64)
    return order, np.concatenate([[0], shared]).astype(np.int64)
