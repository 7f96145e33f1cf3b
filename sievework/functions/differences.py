"""What two lists of lines have in common."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b.

    What both begin or end with is common. Of the rest, few pairs of equal lines are chained as such (Hunt and
    Szymanski, 1977). Where lines repeat so often that their pairs are many, a is halved and b cut where the lengths of the
    two halves' subsequences add up to most (Hirschberg, 1975); the lengths for all cuts come from one number with a bit for
    each line of b (Hyyro, 2004), so that a thousand equal lines cost a thousand steps and not a million.
    """
    found: set[int] = set()
    work = [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            found.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.add(n)
        if i == n or j == m:
            continue
        where: dict[str, list[int]] = {}
        for k in range(j, m):
            where.setdefault(b[k], []).append(k)
        if n - i == 1:
            found |= {i} if a[i] in where else set()
        elif sum(len(where.get(a[k], ())) for k in range(i, n)) <= 20 * (n - i + m - j):
            found |= _chained(a, i, n, where)
        else:
            half = (i + n) // 2
            cut = j + int(np.argmax(_lengths(a[i:half], b[j:m]) + _lengths(a[half:n][::-1], b[j:m][::-1])[::-1]))
            work += [(i, half, j, cut), (half, n, cut, m)]
    return found


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and the first 0, 1, ... lines of b."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    often: dict[str, int] = {}  # of the other lines, which may be many, a number is made when it is met
    for x, js in places.items():
        if len(js) > 32:
            bits = bytearray(len(b) // 8 + 1)
            for j in js:
                bits[j // 8] |= 1 << j % 8
            often[x] = int.from_bytes(bits, "little")
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        mask = often[x] if x in often else sum(1 << j for j in places.get(x, ()))
        own = row & mask
        row = ((row + own) | (row - own)) & full
    steps = np.unpackbits(np.frombuffer((row ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def _chained(a: list[str], i: int, n: int, where: dict[str, list[int]]) -> set[int]:
    """Places in a[i:n] of a longest chain of lines whose places in the other text, given by line, ascend."""
    tails: list[int] = []
    ends: list[tuple] = []
    for at in range(i, n):
        for j in reversed(where.get(a[at], ())):
            k = bisect_left(tails, j)
            entry = (at, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(entry)
            else:
                tails[k], ends[k] = j, entry
    found, entry = set(), ends[-1] if ends else None
    while entry:
        found.add(entry[0])
        entry = entry[1]
    return found


def aligned(a: list[str], b: list[str]) -> list[tuple[str, int, int, str]]:
    """The lines of both in one order as (op, lines of a so far, lines of b so far, line): ' ' in both, '-' of a alone, '+' of b alone, removed before added."""
    kept = common_lines(a, b)
    out: list[tuple[str, int, int, str]] = []
    j = 0

    def added(until: str | None, i: int) -> None:
        nonlocal j
        while j < len(b) and (until is None or b[j] != until):
            j += 1
            out.append(("+", i, j, b[j - 1]))

    for i, line in enumerate(a):
        if i in kept:
            added(line, i)
            j += 1
            out.append((" ", i + 1, j, line))
        else:
            out.append(("-", i + 1, j, line))
    added(None, len(a))
    return out
