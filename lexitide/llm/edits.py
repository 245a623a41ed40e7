"""Edits between words."""

from __future__ import annotations


def slips(a: str, b: str, most: int) -> int:
    """Edits (swaps of neighbours count once) between two words, ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            least = min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, before[j - 2] + 1)
            new.append(least)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)
