"""Patience diff over two sequences of line hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter


def _numbered(lines: list[int]) -> list[tuple[int, int]]:
    """(line, how many equal lines came before)."""
    seen: Counter[int] = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first, that also rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile:
            back[k] = at[pile - 1]
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b) of equal lines, rising in both.

    Between fixed ends: equal lines at both ends are aligned; then lines unique
    to both sides, as far as they keep their order, divide the rest. Where no
    line is unique, the n-th of one kind counts as the same as the other's n-th.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i >= m or j >= n:
            continue
        left, right = a[i:m], b[j:n]
        ca, cb = Counter(left), Counter(right)
        where = {x: k for k, x in enumerate(right) if cb[x] == 1}
        pairs = [(k, where[x]) for k, x in enumerate(left) if ca[x] == 1 and x in where]
        if not pairs:
            place = {x: k for k, x in enumerate(_numbered(right))}
            pairs = [(k, place[x]) for k, x in enumerate(_numbered(left)) if x in place]
        last = (i - 1, j - 1)
        for x, y in _rising(pairs):
            x, y = x + i, y + j
            found.append((x, y))
            if x > last[0] + 1 and y > last[1] + 1:
                todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
        if last[0] >= i and last[0] + 1 < m and last[1] + 1 < n:
            todo.append((last[0] + 1, m, last[1] + 1, n))
    return sorted(found)


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [start, stop) in a of pairs that follow one another in both."""
    out: list[list[int]] = []
    last = (-2, -2)
    for i, j in pairs:
        if (i - 1, j - 1) == last:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
        last = (i, j)
    return [(s, e) for s, e in out]


def anchored(a: list[int], b: list[int], done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of a, outside those ``done``, that stand in b too: around each line or pair of lines that is left, the widest."""
    gone = bytearray(len(a) + 1)
    for s, e in done:
        gone[s:e] = b"\1" * (e - s)
    if gone.count(0) == 1:
        return []
    line, pair = {x: j for j, x in enumerate(b)}, {x: j for j, x in enumerate(zip(b, b[1:]))}
    out = []
    for i in range(len(a)):
        if i + 1 < len(a) and not (gone[i] and gone[i + 1]) and (a[i], a[i + 1]) in pair:
            j = pair[a[i], a[i + 1]]
        elif not gone[i] and a[i] in line:
            j = line[a[i]]
        else:
            continue
        s, e, t, u = i, i, j, j
        while s and t and a[s - 1] == b[t - 1]:
            s, t = s - 1, t - 1
        while e < len(a) and u < len(b) and a[e] == b[u]:
            e, u = e + 1, u + 1
        out.append((s, e))
        if e - s > 1:
            gone[s:e] = b"\1" * (e - s)
    return out
