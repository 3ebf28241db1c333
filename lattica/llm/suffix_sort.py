"""Deep-shallow suffix sorting of byte strings, and the windows that occur twice among them.

Strings are sorted by multikey quicksort to a shallow depth: at each depth all groups that are still equal are split
on their next eight bytes. The few groups left have long common prefixes; a blind trie orders each of them, which looks
only at the bits where its strings part and then checks against one stored string.
"""

from __future__ import annotations

import numpy as np

#: Shallow depth in words of eight bytes.
SHALLOW = 8


def blind_trie(values: list[int], bits: int, sizes: list[int]) -> list[int]:
    """Order of big-endian numbers of ``bits`` bits, by value and then size, by a blind trie.

    An inner node is [bit, zero child, one child]; a leaf holds the places of equal values. A new value is led down by
    the nodes' bits alone; the leaf it meets shows, in one comparison, the first bit at which it parts, and there it is
    put in.
    """
    root: list | tuple = ([0],)
    for i in range(1, len(values)):
        v, node = values[i], root
        while type(node) is list:
            node = node[1 + (v >> node[0] & 1)]
        differs = (v ^ values[node[0][0]]).bit_length() - 1
        if differs < 0:
            node[0].append(i)
            continue
        parent, side, node = None, 0, root
        while type(node) is list and node[0] > differs:
            side = 1 + (v >> node[0] & 1)
            parent, node = node, node[side]
        leaf = ([i],)
        new = [differs, leaf, node] if not v >> differs & 1 else [differs, node, leaf]
        if parent is None:
            root = new
        else:
            parent[side] = new
    order: list[int] = []
    stack: list[list | tuple] = [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack += [node[2], node[1]]
        else:
            order += sorted(node[0], key=lambda i: (sizes[i], i))
    return order


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded byte rows within their groups (groups in rising order), and the common prefix of each with the one before.

    Equal padded rows are ordered by size, so that a prefix stands before all that extend it. The first of a group has
    a common prefix of -1 with its predecessor.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    part = group[order]
    for depth in range(min(SHALLOW, words.shape[1])):
        # Only groups of two or more that are still equal are split; their rows stay at their group's places.
        alone = np.ones(n + 1, bool)
        alone[1:-1] = part[1:] != part[:-1]
        live = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(live):
            break
        own = order[live]
        key = words[own, depth]
        again = np.lexsort((key, part[live]))
        order[live], key = own[again], key[again]
        cut = alone[:-1].copy()
        cut[live[1:]] |= key[1:] != key[:-1]
        part = np.cumsum(cut)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        if b - a > 1:
            own = order[a:b]
            deep = [int.from_bytes(rows[i].tobytes(), "big") for i in own.tolist()]
            order[a:b] = own[blind_trie(deep, width * 8, sizes[own].tolist())]
    common = np.full(n, -1, np.int64)
    if n > 1:
        for a in range(1, n, 1 << 14):
            b = min(n, a + (1 << 14))
            left, right = rows[order[a - 1 : b - 1]], rows[order[a:b]]
            differ = left != right
            at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            common[a:b] = np.minimum(at, np.minimum(sizes[order[a - 1 : b - 1]], sizes[order[a:b]]))
        same = group[order[1:]] == group[order[:-1]]
        common[1:][~same] = -1
    return order, common


def repeated_windows(texts: list[bytes], offset: np.ndarray, starts: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` bytes occur twice or more among strings of a group.

    String i has an anchor at offset[i] and windows at places 0 .. starts[i] - 1, all of which span the anchor. Windows
    can only be equal if they have the anchor at one place and their strings are of one group. What follows the anchor
    is sorted; then windows that begin ``a`` bytes before it, for rising ``a``, are classed by the ``a`` bytes read
    backwards (refined byte by byte) and by the sorted order cut at common prefixes below size - a. Returns a flag for
    each string and place.
    """
    n = len(texts)
    most = int(starts.max()) if n else 0
    out = np.zeros((n, most), bool)
    if not n:
        return out
    right = np.fromiter((len(t) for t in texts), np.int64, n) - offset
    width = -(-int(right.max()) // 8) * 8
    rows = np.frombuffer(b"".join(t[o:].ljust(width, b"\0") for t, o in zip(texts, offset.tolist(), strict=True)), np.uint8).reshape(n, width)
    order, common = deep_shallow(rows, right, group)
    offset, starts = offset[order], starts[order]
    deepest = int(offset.max())
    left = np.frombuffer(b"".join(texts[i][:o][::-1].ljust(deepest + 1, b"\0") for i, o in zip(order.tolist(), offset.tolist(), strict=True)), np.uint8).reshape(n, deepest + 1)
    behind = group[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(deepest + 1):
        if a:
            behind = (behind ^ (left[:, a - 1].astype(np.uint64) + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
            behind ^= behind >> np.uint64(32)
        live = np.flatnonzero((offset >= a) & (offset - starts < a))
        if len(live) < 2:
            continue
        ahead = np.cumsum(common < size - a)[live].astype(np.uint64)
        key = (behind[live] ^ ahead * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0x9E3779B97F4A7C15)
        by = np.argsort(key)
        equal = key[by[1:]] == key[by[:-1]]
        twice = np.zeros(len(live), bool)
        twice[by[1:]] |= equal
        twice[by[:-1]] |= equal
        hits = live[twice]
        out[order[hits], offset[hits] - a] = True
    return out
