"""Shard Burrows-Wheeler transforms, and their merge by iterative interleave refinement.

A shard is a set of strings. Its transform lists, for the sorted suffixes of its strings, the ``STEP`` = 2 bytes that
stand before each one, and the row of the suffix that begins there. A merge never sorts suffixes again: it keeps an
interleave of the shards' rows, sorted by the first h bytes of the suffixes, with marks where neighbours differ in
them. One refinement reads the bytes before each row in the present order, deals the preceding rows stably by them and
has the interleave for h + STEP; a mark is set where bytes or old blocks differ, so h at that moment is the common
prefix of the two neighbours. Blocks of one row can hold no repeat, nor can any suffix to their left; they are dropped.
"""

from __future__ import annotations

import numpy as np

STEP = 2


class Shard:
    """Transform of the strings that lie one after the other in ``data``, string k in [starts[k], starts[k + 1])."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        lengths = np.diff(starts)
        # A string of n bytes has suffixes at 0 .. n; the one at n is empty.
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        inside = np.arange(len(owner)) - (starts[:-1] + np.arange(len(lengths)))[owner]
        left = lengths[owner] - inside
        order = self._sorted(data, owner, inside, left, starts)
        row_of = np.empty(len(order), dtype=np.int32)
        row_of[order] = np.arange(len(order), dtype=np.int32)
        self.string, self.offset = owner[order].astype(np.int32), inside[order].astype(np.int32)
        before = self.offset >= STEP
        self.preceding = np.where(before, row_of[np.maximum(order - STEP, 0)], -1)
        data = np.concatenate((data, np.zeros(1, dtype=np.uint8)))  # So there is a byte to read if all are empty.
        at = starts[self.string] + self.offset
        pair = data[np.maximum(at - 2, 0)].astype(np.uint16) << np.uint16(8) | data[np.maximum(at - 1, 0)]
        self.bytes_before = np.where(before, pair, 0).astype(np.uint16)

    @staticmethod
    def _sorted(data, owner, inside, left, starts) -> np.ndarray:
        """Suffixes by their first eight bytes, then by doubling, but only where neighbours are still equal."""
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
        at = starts[owner] + inside
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | np.where(k < left, padded[at + k], np.uint64(0))
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        rank = np.empty(len(order), dtype=np.int64)
        group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        rank[order] = group
        reach = 8
        longest = int(left.max(initial=0))
        while reach < longest:
            tied = np.concatenate((~fresh[1:], [False])) | ~fresh
            places = np.flatnonzero(tied)
            if not len(places):
                break
            rows = order[places]
            follow = np.where(left[rows] >= reach, rank[np.minimum(rows + reach, len(rank) - 1)], -1)
            again = np.lexsort((follow, group[places]))
            order[places] = rows[again]
            follow = follow[again]
            same = np.zeros(len(order), dtype=bool)
            if len(places) > 1:
                same[places[1:]] = (group[places[1:]] == group[places[:-1]]) & (follow[1:] == follow[:-1])
            fresh = ~same
            group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            rank[order] = group
            reach *= 2
        return order


def repeated(shards: list[Shard], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard (string, offset) of every ``length``-byte string (an even number) that occurs more than once."""
    bases = np.cumsum([0] + [len(s.string) for s in shards])
    rows = np.arange(bases[-1], dtype=np.int32)  # The interleave of h = 0: one block, shard after shard.
    bytes_before = np.concatenate([s.bytes_before for s in shards])
    preceding = np.concatenate(
        [np.where(s.preceding >= 0, s.preceding + b, -1) for s, b in zip(shards, bases[:-1], strict=True)]
    ).astype(np.int32)
    block = np.zeros(len(rows), dtype=np.int32)
    for _ in range(0, length, STEP):
        inside = preceding[rows] >= 0
        rows, block = rows[inside], block[inside]
        read = bytes_before[rows]
        dealt = np.argsort(read, kind="stable")
        rows, block, read = preceding[rows[dealt]], block[dealt], read[dealt]
        if not len(rows):
            break
        mark = np.empty(len(rows) + 1, dtype=bool)
        mark[0] = mark[-1] = True
        np.not_equal(read[1:], read[:-1], out=mark[1:-1])
        mark[1:-1] |= block[1:] != block[:-1]
        shared = ~(mark[:-1] & mark[1:])
        block = np.cumsum(mark[:-1], dtype=np.int32)
        rows, block = rows[shared], block[shared]
    out = []
    shard_of = np.searchsorted(bases, rows, side="right") - 1
    for k, shard in enumerate(shards):
        own = rows[shard_of == k] - bases[k]
        out.append((shard.string[own], shard.offset[own]))
    return out
