"""Cartesian trees over the gaps of sorted events, by chunks that can be merged.

A sequence of events is a list of *atoms* in order: ``start``, ``end``, ``n`` (events) and ``inner`` (the largest gap
inside, 0 for one event). The tree's nodes are the maximal runs of atoms whose gaps are all at most some threshold: the
node of a gap reaches left and right to the nearest larger gaps, and its parent's gap is the smaller of those two. A node
is therefore a session of every threshold ``t`` with ``gap <= t < parent``, and of no other.

A chunk that is only a piece of its sequence can't know the gaps outside. Its nodes that touch neither end are final. The
rest is folded to few atoms: the sequence is split at the gaps that are new maxima seen from the left or from the right
(the spines of the chunk's tree), and each stretch between becomes one atom. Joining the folded atoms of all chunks and
building their tree gives exactly the missing nodes.
"""

from __future__ import annotations

import numpy as np

#: Stands for a gap that no threshold reaches: between sequences, beyond the ends, or larger than ``ceiling``.
CUT = np.iinfo(np.int64).max


def _nearest_larger(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each gap the place of the nearest larger one to the left (-1: none) and right (its length: none).

    Of equal gaps with no larger one between, only the last stays ``alive``; it has the left end of the first.
    """
    values, m = gaps.tolist(), len(gaps)
    left, right, alive = [-1] * m, [m] * m, bytearray(b"\x01") * m
    stack: list[int] = []
    for i, g in enumerate(values):
        if g == CUT:
            for j in stack:
                right[j] = i
            stack = [i]
            alive[i] = 0
            continue
        while values[stack[-1]] < g if stack else False:
            right[stack.pop()] = i
        if stack:
            j = stack[-1]
            if values[j] == g:
                left[i] = left[j]
                alive[j] = 0
                stack[-1] = i
                continue
            left[i] = j
        stack.append(i)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.frombuffer(alive, dtype=np.uint8).astype(bool)


def build(start, end, n, inner, first, last_open, floor: int, ceiling: int):
    """Nodes and folded atoms of one chunk.

    ``first[k]``: atom k begins a new sequence. ``last_open``: for each sequence of the chunk, in order, whether it may
    continue outside. Nodes whose thresholds lie wholly below ``floor`` or above ``ceiling`` aren't needed: smaller gaps
    are closed at once and larger ones always cut, without a step of the tree.

    Returns ``(nodes, atoms)``, each a tuple of arrays: nodes ``(at, gap, parent, start, end, n)`` and atoms ``(at, start,
    end, n, inner)``; ``at`` is the place in the input of an atom of the same sequence.
    """
    k = len(start)
    if not k:
        none = np.empty(0, dtype=np.int64)
        return (none,) * 6, (none,) * 5
    gaps = np.where(first[1:], CUT, start[1:] - end[:-1])
    closed = gaps <= floor
    at = np.flatnonzero(np.r_[True, ~closed])
    if len(at) < k:
        within = np.maximum(inner, np.r_[0, np.where(closed, gaps, 0)])
        inner = np.maximum.reduceat(within, at)
        n = np.add.reduceat(n, at)
        end = end[np.r_[at[1:] - 1, k - 1]]
        start = start[at]
        gaps = gaps[~closed]
    sequence = np.cumsum(first[at]) - 1
    gaps = np.where(gaps > ceiling, CUT, gaps)
    k, m = len(start), len(gaps)
    left, right, alive = _nearest_larger(gaps)
    fenced = np.r_[CUT, gaps, CUT]
    upto = np.r_[0, np.cumsum(n)]
    parent = np.minimum(fenced[left + 1], fenced[right + 1])
    leaf_parent = np.minimum(fenced[:-1], fenced[1:])
    node_ok, leaf_ok = alive & (gaps < parent), inner < leaf_parent
    folded: list[tuple] = []
    for s in np.flatnonzero(last_open):
        a, b = np.searchsorted(sequence, [s, s + 1])
        own = gaps[a : b - 1]
        if len(own):
            high, low = np.maximum.accumulate(own), np.maximum.accumulate(own[::-1])[::-1]
            spine = np.r_[True, own[1:] > high[:-1]] | np.r_[own[:-1] > low[1:], True]
        else:
            spine = np.empty(0, dtype=bool)
        cut = np.r_[0, np.flatnonzero(spine) + 1]
        of = np.r_[0, np.cumsum(spine)]
        inside = np.maximum(inner[a:b], np.r_[0, np.where(spine, 0, own)])
        top = np.maximum.reduceat(inside, cut)
        ends = np.r_[cut[1:] - 1, b - a - 1]
        folded.append((at[a + cut], start[a + cut], end[a + ends], np.add.reduceat(n[a:b], cut), top))
        leaf_ok[a:b] &= (ends - cut > 0)[of]
        node_ok[a : b - 1] &= ~spine & (own < top[of[:-1]])
    i, j = np.flatnonzero(node_ok & (parent > floor)), np.flatnonzero(leaf_ok & (leaf_parent > floor) & (inner <= ceiling))
    lo, hi = left[i] + 1, np.minimum(right[i], k - 1)
    nodes = (
        np.r_[at[i], at[j]],
        np.r_[gaps[i], inner[j]],
        np.r_[parent[i], leaf_parent[j]],
        np.r_[start[lo], start[j]],
        np.r_[end[hi], end[j]],
        np.r_[upto[hi + 1] - upto[lo], n[j]],
    )
    return nodes, tuple(np.concatenate(c) if folded else np.empty(0, dtype=np.int64) for c in (zip(*folded, strict=True) if folded else [()] * 5))
