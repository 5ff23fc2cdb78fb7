"""Positional Burrows-Wheeler transforms of shards of aligned strings, and their merging by interleave refinement.

The strings are rows of one width, END where a row has no byte of its own. Rows
are aligned, so suffixes are compared at equal columns. A shard's transform holds,
for each column, the bytes there in the order of the suffixes behind that column.
Merging refines an interleaving column by column: it says of each suffix which
shard it is from; read through it, the shards' transforms give the bytes before
all suffixes in order; dealt out by those bytes, the interleaving is that of the
column before. No suffix is compared or sorted again.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # no UTF-8 text has this byte


def transform(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(width, rows): the transforms of all groups of rows side by side; ``group`` ascends."""
    columns = np.ascontiguousarray(rows.T)
    out = np.empty_like(columns)
    order = np.arange(len(rows))
    group = group.astype(np.uint16) if len(group) and group[-1] < 1 << 16 else group
    for c in range(len(columns) - 1, -1, -1):
        read = columns[c][order]
        out[c] = read[np.argsort(group[order], kind="stable")]
        order = order[np.argsort(read, kind="stable")]
    return out


def merged_repeats(shards: list[np.ndarray], least: np.ndarray, depth: int) -> np.ndarray:
    """For each string, shard after shard, a number whose bit c is set if its ``depth`` bytes from column c stand in a string of lesser value as well.

    Two neighbours' suffixes part at a column that is kept as the merging goes;
    neighbours that part ``depth`` columns on or later have a common prefix of
    that length, and such runs are the repeated intervals.
    """
    transforms = np.concatenate(shards, axis=1)
    width, n = transforms.shape
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    kind = np.uint16 if len(shards) < 1 << 16 else np.uint32
    source = np.repeat(np.arange(len(shards), dtype=kind), [s.shape[1] for s in shards])
    string, by_shard = np.arange(n), np.arange(n)
    parts = np.full(n + 1, width, np.int16)  # the column where a suffix parts from the one before it
    parts[0] = parts[n] = -1
    whole = {}  # column to whether each string has a byte of its own there
    read = np.empty(n, np.uint8)
    for c in range(width - 1, -1, -1):
        read[by_shard] = transforms[c]
        dealt = np.argsort(read, kind="stable")
        first, before = read[dealt], dealt[:-1]
        same = first[1:] == first[:-1]
        new = np.full(n + 1, -1, np.int16)
        new[1:n] = np.where(same, parts[dealt[1:]], c)
        far = np.nonzero(same & (dealt[1:] != before + 1))[0]
        if len(far):
            ranges = np.empty(2 * len(far), np.int64)
            ranges[::2], ranges[1::2] = before[far] + 1, dealt[far + 1] + 1
            new[far + 1] = np.minimum.reduceat(parts, ranges)[::2]
        parts, source, string = new, source[dealt], string[dealt]
        by_shard = np.argsort(source, kind="stable")
        if c >= depth - 1:
            held = np.empty(n, bool)
            held[string] = first != END
            whole[c] = held
        if c + depth <= width:
            starts = np.nonzero(parts[:n] < c + depth)[0]
            value = least[string]
            run = np.repeat(np.minimum.reduceat(value, starts), np.diff(np.append(starts, n)))
            repeated = string[(run < value) & (first != END) & whole[c + depth - 1][string]]
            out[repeated] |= np.uint64(1) << np.uint64(c)
    return out
