"""Sorted runs of whole numbers, delta-coded: the differences in groups of seven bits, lowest first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def encode_runs(values: np.ndarray, begin: np.ndarray) -> pa.BinaryArray:
    """The coded differences of each run of ``values`` (64-bit, rising within a run); run k starts at ``begin[k]``.

    A run's first value isn't in its code; it is kept beside it. All runs are coded together.
    """
    unsigned = values.view(np.uint64)
    later = np.ones(len(values), dtype=bool)
    later[begin] = False
    deltas = (unsigned[1:] - unsigned[:-1])[later[1:]] if len(values) else unsigned
    size = np.ones(len(deltas), dtype=np.int64)
    for bits in range(7, 64, 7):
        size += deltas >= np.uint64(1 << bits)
    ends = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    for i in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        more = (size[has] > i + 1).astype(np.uint8) << 7
        out[ends[has] + i] = ((deltas[has] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more
    offsets = np.r_[ends[begin - np.arange(len(begin))], ends[-1]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def decode_runs(first: np.ndarray, n: np.ndarray, runs: pa.BinaryArray) -> np.ndarray:
    """All values of all runs, one run after the other; run k has ``n[k]`` values from ``first[k]`` on."""
    if not len(first):
        return np.empty(0, dtype=np.int64)
    ends = np.frombuffer(runs.buffers()[1], dtype=np.int32)[runs.offset : runs.offset + len(runs) + 1]
    data = np.frombuffer(runs.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if runs.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    start = np.cumsum(n) - n
    steps = np.zeros(int(n.sum()), dtype=np.uint64)
    if len(data):
        last = np.flatnonzero(data < 128)
        begin = np.r_[0, last[:-1] + 1]
        place = np.arange(len(data)) - np.repeat(begin, last + 1 - begin)
        later = np.ones(len(steps), dtype=bool)
        later[start] = False
        steps[later] = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin)
    total = np.cumsum(steps, dtype=np.uint64)
    return (total + np.repeat(first.view(np.uint64) - total[start], n)).view(np.int64)
