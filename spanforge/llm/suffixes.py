"""Suffix sorting by deep-shallow: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

#: Depth that quicksort goes to beyond what is known to be shared, and the group size that goes to a trie at once.
SHALLOW, FEW = 16, 2


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Inner:
    """A node of a blind trie: the depth at which its strings part, and the branch of each byte (-1: the end)."""

    __slots__ = ("depth", "branches")

    def __init__(self, depth: int, branches: dict) -> None:
        self.depth, self.branches = depth, branches


def blind(texts: list[bytes], which: list[int]) -> tuple[list[int], list[int]]:
    """Order of the given texts, and what each shares with the one before it (the first: 0).

    A trie that keeps only the bytes where strings part. A text goes down blindly to some leaf, is compared
    with that one string, and is put in where the two part. Leaves are lists of equal texts.
    """
    root: Inner | list[int] = [which[0]]
    for i in which[1:]:
        s = texts[i]
        n = len(s)
        node = root
        while node.__class__ is Inner:
            got = node.branches.get(s[node.depth] if node.depth < n else -1)
            node = got if got is not None else next(iter(node.branches.values()))
        other = texts[node[0]]
        if other == s:
            node.append(i)
            continue
        k = shared(s, other)
        above, node = None, root
        while node.__class__ is Inner and node.depth < k:
            above, node = node, node.branches[s[node.depth]]
        mine = s[k] if k < n else -1
        if node.__class__ is Inner and node.depth == k:
            node.branches[mine] = [i]
            continue
        new = Inner(k, {(other[k] if k < len(other) else -1): node, mine: [i]})
        if above is None:
            root = new
        else:
            above.branches[s[above.depth]] = new
    order: list[int] = []
    common: list[int] = []
    todo = [(root, 0)]
    while todo:
        node, first = todo.pop()
        if node.__class__ is Inner:
            below = sorted(node.branches.items())
            todo += [(x, first if not j else node.depth) for j, (_, x) in reversed(list(enumerate(below)))]
        else:
            order += node
            common.append(first)
            common += [len(texts[node[0]])] * (len(node) - 1)
    return order, common


def deep_shallow(texts: list[bytes], which: list[int], depth: int = 0) -> tuple[list[int], list[int]]:
    """Order of the given texts, which share their first `depth` bytes, and what each shares with the one before.

    A ternary quicksort by one byte at a time, smaller, equal and larger; groups that still share the shallow
    depth, and pairs, are ordered by a blind trie.
    """
    limit = depth + SHALLOW
    order: list[int] = []
    common: list[int] = []
    todo = [(which, depth, 0)]
    while todo:
        group, d, first = todo.pop()
        if len(group) == 1:
            order += group
            common.append(first)
        elif len(group) <= FEW or d >= limit:
            got, lcp = blind(texts, group)
            order += got
            common += [first, *lcp[1:]]
        else:
            byte = [texts[i][d] if d < len(texts[i]) else -1 for i in group]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less = [i for i, b in zip(group, byte, strict=True) if b < pivot]
            same = [i for i, b in zip(group, byte, strict=True) if b == pivot]
            more = [i for i, b in zip(group, byte, strict=True) if b > pivot]
            parts = [(x, y) for x, y in ((less, d), (same, d + 1 if pivot >= 0 else limit), (more, d)) if x]
            todo += [(x, y, first if not j else d) for j, (x, y) in reversed(list(enumerate(parts)))]
    return order, common
