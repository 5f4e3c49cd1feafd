"""Edit distance and edit counts of two sequences by bit vectors: a column of the table of costs is three whole numbers."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from math import isqrt


def _places(seq: Sequence[Hashable]) -> dict:
    """Bit i of an element's mask is set where it stands at place i."""
    masks: dict = {}
    for i, x in enumerate(seq):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def _column(same: int, up: int, down: int, full: int) -> tuple[int, int, int, int, int]:
    """The next column from where its element stands and the steps of the last column: (places that cost no more than their
    diagonal neighbour, steps up and down along the new column, steps up and down from the last column to it)."""
    level = (((same & up) + up) ^ up) | same | down
    right, left = down | (full & ~(level | up)), up & level
    moved, back = (right << 1) | 1, left << 1
    return level & full, (back | ~(level | moved)) & full, moved & level & full, right, left


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least number of substitutions, deletions and insertions; len(b) steps over whole numbers of len(a) bits."""
    if not len(a):
        return len(b)
    masks, full, last = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, cost = full, 0, len(a)
    for x in b:
        _, up, down, right, left = _column(masks.get(x, 0), up, down, full)
        cost += bool(right & last) - bool(left & last)
    return cost


def edit_counts(ref: Sequence[Hashable], hyp: Sequence[Hashable]) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of an optimal alignment, ties to the diagonal, then to a deletion. Of the
    table only one column in about sqrt(len(hyp)) is kept, and a block of columns is made again on the way back."""
    masks, full, n = _places(ref), (1 << len(ref)) - 1, len(hyp)
    block = isqrt(n) + 1
    up, down, marks = full, 0, []
    for j, x in enumerate(hyp):
        if j % block == 0:
            marks.append((up, down))
        _, up, down, _, _ = _column(masks.get(x, 0), up, down, full)
    hits = subs = dels = ins = 0
    i, j = len(ref), n
    while i and j:
        first = (j - 1) // block * block
        up, down = marks[first // block]
        columns = []
        for x in hyp[first:j]:
            level, up, down, _, _ = _column(masks.get(x, 0), up, down, full)
            columns.append((level, up))
        while i and j > first:
            level, up = columns[j - 1 - first]
            same = ref[i - 1] == hyp[j - 1]
            if same or not (level >> (i - 1)) & 1:
                hits, subs, i, j = hits + same, subs + (not same), i - 1, j - 1
            elif (up >> (i - 1)) & 1:
                dels, i = dels + 1, i - 1
            else:
                ins, j = ins + 1, j - 1
    return hits, subs, dels + i, ins + j
