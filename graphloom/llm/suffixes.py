"""Deep-shallow sorting of suffixes that are compared up to a fixed length.

Multikey quicksort over eight bytes at a time orders all suffixes of all buckets together down
to a shallow depth; what still shares its first bytes goes to a blind trie a group, whose
nodes hold only the place and byte where strings part, so that a long common prefix is
compared once an insertion and never byte by byte.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at.
SHALLOW = 32


def words_at(text: bytes) -> np.ndarray:
    """The eight bytes from each place of ``text`` on as a big-endian number; zeros follow the end."""
    padded = np.frombuffer(text + b"\0" * 8, np.uint8).astype(np.uint64)
    out = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)] << np.uint64(56 - 8 * k)
    return out


def sort_suffixes(text: bytes, starts: np.ndarray, buckets: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``text[s : s + length]`` within their buckets, and each one's common prefix with the one before (0 for a bucket's first)."""
    words, n = words_at(text), len(starts)
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    first, lcp = np.ones(n, bool), np.zeros(n, np.int64)
    first[1:] = sorted_buckets[1:] != sorted_buckets[:-1]
    shallow = min(shallow, length // 8 * 8)
    for depth in range(0, shallow, 8):
        open_ = ~(first & np.append(first[1:], True))  # in a group of two or more
        at = np.flatnonzero(open_)
        if not len(at):
            return order, lcp
        group, word = np.cumsum(first)[at], words[starts[order[at]] + depth]
        by = np.lexsort((word, group))
        order[at], word = order[at][by], word[by]
        parts = np.flatnonzero((word[1:] != word[:-1]) & (group[1:] == group[:-1])) + 1
        differ = word[parts] ^ word[parts - 1]
        same = np.zeros(len(parts), np.int64)
        for k in range(1, 8):
            same += differ < np.uint64(1 << (64 - 8 * k))
        lcp[at[parts]], first[at[parts]] = depth + same, True
    begins = np.flatnonzero(first)
    sizes = np.diff(np.append(begins, n))
    for begin, size in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        members = order[begin : begin + size].tolist()
        strings = [text[s + shallow : s + length] for s in starts[members].tolist()]
        if size == 2:
            x, y = strings
            lcp[begin + 1] = shallow + _common(x, y)
            if y < x:
                order[begin], order[begin + 1] = members[1], members[0]
            continue
        ranks, common = blind_trie(strings)
        order[begin : begin + size] = [members[k] for k in ranks]
        lcp[begin + 1 : begin + size] = [shallow + c for c in common[1:]]
    return order, lcp


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    return len(x) - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The strings' (of one length) sorted order and common prefixes with their predecessors, by a blind trie.

    An inner node is (depth, children by byte), a leaf (-1, members, all equal).
    """
    root: tuple = (-1, [0])
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while node[0] >= 0:  # down by the parting bytes alone; where there is no way, any way
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = _common(s, strings[node[1][0]])
        if depth == len(s):
            node[1].append(k)
            continue
        above, node = None, root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = (-1, [k])
            continue
        some = node
        while some[0] >= 0:
            some = next(iter(some[1].values()))
        new = (depth, {strings[some[1][0]][depth]: node, s[depth]: (-1, [k])})
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    order, common, todo = [], [], [(0, root)]
    while todo:
        shared, node = todo.pop()
        if node[0] < 0:
            order += node[1]
            common += [shared] + [len(strings[0])] * (len(node[1]) - 1)
        else:
            ways = sorted(node[1], reverse=True)
            todo += [(shared if b == ways[-1] else node[0], node[1][b]) for b in ways]
    return order, common
