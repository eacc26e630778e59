"""A run-length index of texts: matching statistics, and long matches that start earlier.

The texts of a shard are joined with a mark after each.  Their suffixes are
sorted by doubling prefixes; the Burrows-Wheeler transform is kept as runs, each
with the text place of its first and last row.  A text is streamed from its end
through the runs: at each byte the row moves on by the last-to-first mapping,
or, where the byte differs, jumps to the nearest run of that byte above or
below, whichever matches longer, and takes that run's sampled place.  That gives
the length of the longest match at every byte, up to ``length``.

Shards are taken in the order of their texts: inside a shard equal windows are
neighbours in the suffix order and all but the first are marked, and each later
text is streamed through the indexes of all shards before.  The result is exact,
and equals that of ``repeats``; the work grows with the number of shards times
the corpus, which is why ``repeats`` does not use it (figures in the README).

Defined results: null and empty texts have no matches; matches do not cross texts.
"""

from __future__ import annotations

import numpy as np

from lexigraph.llm import ragged

LENGTH = 100


class RunLengthIndex:
    """Runs of the transform of the joined texts of a shard."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length = length
        flat = np.frombuffer(b"".join(t + b"\0" for t in texts), dtype=np.uint8).astype(np.int16) + 1
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.starts = ragged.offsets(lengths)
        flat[self.starts[1:] - 1] = 0
        self.text = np.append(flat, np.zeros(length + 1, np.int16))
        order, self._same = self._sorted(flat.astype(np.int64))
        before = flat[order - 1]  # the byte before the first one is the last mark
        begins = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(before)) - 1
        self.begins, self.ends, self.heads = begins, ends, before[begins].astype(np.int64)
        self.first, self.last = order[begins], order[ends]
        self.order = order
        sizes = ends - begins + 1
        by_head = np.lexsort((np.arange(len(begins)), self.heads))
        self.by_head = by_head
        self.keys = self.heads[by_head] * (len(begins) + 1) + by_head
        upto = ragged.offsets(sizes[by_head])[:-1]
        self.row = np.zeros(len(begins), np.int64)  # where the last-to-first mapping sends a run's first row
        self.row[by_head] = upto

    def _sorted(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix order, whether a suffix begins with the same ``length`` bytes as the one before it in the order)."""
        n = len(flat)
        # every mark is a letter of its own, so that no match reaches over it
        rank = np.where(flat > 0, flat + len(self.starts), np.cumsum(flat == 0))
        width, kept = 1, {}
        order = np.argsort(rank, kind="stable")
        while n:
            kept[width] = rank
            second = np.zeros(n, np.int64)
            second[: max(0, n - width)] = rank[width:] + 1
            key = rank * (int(second.max()) + 1) + second
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, np.int64)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            width *= 2
            if rank.max() == n and width >= self.length:
                break
        same, at, rest = np.ones(max(0, n - 1), bool), 0, self.length
        for width in sorted(kept, reverse=True):
            while rest >= width:
                a, b = order[1:] + at, order[:-1] + at
                inside = (a < n) & (b < n)
                same &= inside
                same[inside] &= kept[width][a[inside]] == kept[width][b[inside]]
                at, rest = at + width, rest - width
        return order, np.concatenate([[False], same]) if n else np.zeros(0, bool)

    def repeated(self) -> list[np.ndarray]:
        """For every text of the shard, the starts of windows that start earlier in the shard as well."""
        group = np.cumsum(~self._same)
        least = np.full(group[-1] + 1 if len(group) else 1, len(self.text))
        np.minimum.at(least, group, self.order)
        again = np.sort(self.order[self.order != least[group]])
        cuts = np.searchsorted(again, self.starts)
        return [again[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], self.starts)]

    def matching(self, texts: list[bytes]) -> list[np.ndarray]:
        """At every byte of every text the length of its longest match in the shard, up to ``length``."""
        n, cap = len(texts), self.length
        sizes = np.fromiter(map(len, texts), np.int64, n)
        width = int(sizes.max()) if n else 0
        out = np.zeros((n, width), np.int16)
        raw = np.full((n, width + cap + 1), -1, np.int16)
        for i, t in enumerate(texts):
            raw[i, : len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
        runs = len(self.begins)
        row, place, held = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ahead = np.arange(cap)
        for at in range(width - 1, -1, -1):
            who = np.flatnonzero(at < sizes)
            byte = raw[who, at].astype(np.int64)
            run = np.searchsorted(self.begins, row[who], side="right") - 1
            miss = np.flatnonzero(self.heads[run] != byte)
            if len(miss):
                slot = np.searchsorted(self.keys, byte[miss] * (runs + 1) + run[miss])
                best = np.full(len(miss), -1)
                for up in (True, False):
                    near = slot - 1 if up else slot
                    there = (near >= 0) & (near < runs)
                    other = self.by_head[np.where(there, near, 0)]
                    there &= self.heads[other] == byte[miss]
                    spot = np.where(there, (self.last if up else self.first)[other], 0)
                    mine = who[miss]
                    agree = self.text[spot[:, None] + ahead] == raw[mine[:, None], at + 1 + ahead]
                    size = np.where(there, np.where(agree.all(axis=1), cap, agree.argmin(axis=1)), -1)
                    better = size > best
                    best = np.where(better, size, best)
                    row[mine[better]] = (self.ends if up else self.begins)[other[better]]
                    place[mine[better]] = spot[better]
                    run[miss[better]] = other[better]
                held[who[miss]] = best
            good = self.heads[run] == byte
            go = who[good]
            row[go] = self.row[run[good]] + row[go] - self.begins[run[good]]
            place[go] -= 1
            held[go] = np.minimum(held[go] + 1, cap)
            held[who[~good]] = 0
            out[who, at] = held[who]
        return [out[i, :s] for i, s in enumerate(sizes)]


def repeated_starts(texts: list[bytes], shard_bytes: int, length: int = LENGTH) -> list[np.ndarray]:
    """For every text the starts of windows of ``length`` bytes that also start earlier."""
    shards: list[list[bytes]] = [[]]
    size = 0
    for t in texts:
        if size and size + len(t) > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(t)
        size += len(t)
    before: list[RunLengthIndex] = []
    out: list[np.ndarray] = []
    for shard in shards:
        index = RunLengthIndex(shard, length)
        found = index.repeated()
        for earlier in before:
            found = [np.union1d(f, np.flatnonzero(m >= length)) for f, m in zip(found, earlier.matching(shard))]
        out += found
        before.append(index)
    return out
