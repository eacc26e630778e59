"""Benchmark passages in documents, by CGK embedding, bit sampling and exact edit distance.

Texts are word sequences (lower case, punctuation at the ends of a word
dropped).  A CGK walk embeds a window of words: at step j it emits the word
under its pointer, and moves on if the j-th random bit of that word is set.  Two
windows of small edit distance mostly fall into step again after an edit, so
their embeddings differ in few places (Hamming distance).  Each of ``WALKS``
repetitions has its own bits and samples a few of the steps; windows that agree
in the sampled steps of one repetition are candidates.  An item is cut into
windows of up to half its length at every offset, and a document has one at
every word, so edits at any place leave many windows that can agree.  Items of
so few words that none may be edited are one window that must agree as a whole.
Each candidate is verified by the exact edit distance of the whole item to the
best stretch that can hold it; so what is found is right, and what is missed is
the share that the README gives by item length and by place of the edits.

Items are held in blocks of bounded size; a larger benchmark takes more passes
over the documents, never a larger broadcast.

Defined results: null or empty texts and items match nothing, nor do items
without a word; an item counts as found when at most ``share`` of its words
(rounded down) must be edited; equal items are found each under its own id;
repeated documents are found each; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.common import pieces

#: Largest share of an item's words that may be edited.
SHARE = 0.15
#: Repetitions of the walk, lengths of windows in words, and sampled steps.
WALKS, WINDOWS, SAMPLES = 12, (3, 4, 6, 8, 12, 16), 5
#: Items and characters of a block.
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 2_000_000
#: log2 of the places of the filter of neighbouring words.
_PAIR_BITS = 22

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


def words(text: str | None) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().split()) if w]


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of the text, end of that stretch)."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for word in item:
        best = np.minimum(row + 1, np.concatenate([[np.iinfo(np.int64).max // 2], row[:-1] + (text != word)]))
        row = np.minimum.accumulate(best - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class _Vocabulary(dict):
    """Raw word -> id; words of no item are 0, words of punctuation alone -1. Bounded: it forgets misses when large."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self._known = known

    def __missing__(self, raw: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update(self._known)
        bare = raw.strip(_EDGE)
        found = self._known.get(bare, 0) if bare else -1
        self[raw] = found
        return found


class Index:
    """Hash tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        known: dict[str, int] = {}
        for _, w in split:
            for x in w:
                known.setdefault(x, len(known) + 1)
        self.known = known
        self.ids = [i for i, _ in split]
        self.items = [np.array([known[x] for x in w], dtype=np.int32) for _, w in split]
        self.edits = [int(share * len(x)) for x in self.items]
        whole: dict[int, list[int]] = {}  # length -> items that allow no edit
        for k, x in enumerate(self.items):
            if not self.edits[k]:
                whole.setdefault(len(x), []).append(k)
        self.whole = []
        for length, own in sorted(whole.items()):
            rows = np.array([self.items[k] for k in own]).T
            at = []  # for each place in a key, which words stand there
            for row in rows:
                here = np.zeros(len(known) + 1, dtype=bool)
                here[row] = True
                at.append(here)
            folded = self._fold(rows)
            order = np.argsort(folded, kind="stable")
            self.whole.append((at, folded[order], np.array(own)[order]))
        rng = np.random.default_rng(20240611)
        self.bits = rng.integers(0, 2**63, (WALKS, len(known) + 1), dtype=np.int64)
        self.steps = {(w, size): np.sort(rng.choice(2 * size, min(SAMPLES, size + 1), replace=False)) for w in range(WALKS) for size in WINDOWS}
        self._index_windows()

    def _index_windows(self) -> None:
        long = [k for k in range(len(self.items)) if self.edits[k]]
        gap = np.zeros(2 * WINDOWS[-1], dtype=np.int32)
        flat = np.concatenate([gap[:0], *(part for k in long for part in (self.items[k], gap))])
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        self.pairs[self._pair(flat)[(flat[:-1] > 0) & (flat[1:] > 0)]] = True
        place, owner, offset, size_of = [], [], [], []
        at = 0
        for k in long:
            n = len(self.items[k])
            size = max(s for s in WINDOWS if s <= max(3, n // 2))
            starts = np.arange(n - size + 1)
            place.append(at + starts)
            offset.append(starts)
            owner.append(np.full(len(starts), k))
            size_of.append(np.full(len(starts), size))
            at += n + len(gap)
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if not long:
            return
        place, owner, offset, size_of = (np.concatenate(x) for x in (place, owner, offset, size_of))
        for walk in range(WALKS):
            for size, keys, inside in self._keys(flat, place, walk, np.unique(size_of).tolist(), True):
                mine = inside & (size_of == size)  # a walk that left its item would meet other words in a document
                order = np.argsort(keys[mine], kind="stable")
                self.tables[walk, size] = keys[mine][order], np.stack([owner[mine], offset[mine]], axis=1)[order]

    @staticmethod
    def _pair(flat: np.ndarray) -> np.ndarray:
        h = flat[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + flat[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)

    def _keys(self, flat: np.ndarray, place: np.ndarray, walk: int, sizes: list[int], judged: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(window size, key of every place, whether the sampled steps were all on words) of one repetition."""
        bits, pointer, rows = self.bits[walk], place.copy(), []
        for step in range(2 * max(sizes)):
            row = flat[pointer]
            rows.append(row)
            pointer += (bits[row] >> step) & 1
        for size in sizes:
            seen = np.stack([rows[j] for j in self.steps[walk, size]])
            yield size, self._fold(seen), (seen > 0).all(axis=0) if judged else None

    @staticmethod
    def _fold(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(rows.shape[1], dtype=np.uint64)
        for row in rows:
            h = (h ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def _met(folded: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in h, number in folded) of equal keys; ``folded`` is sorted."""
        low, high = np.searchsorted(folded, h), np.searchsorted(folded, h, side="right")
        n = high - low
        return np.repeat(np.arange(len(h)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())

    def candidates(self, flat: np.ndarray) -> np.ndarray:
        """Rows (place, item, offset): the item's window at the offset may begin at the place; after each text are zeros."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for at, folded, own in self.whole:
            hit = np.flatnonzero(at[0][flat])
            for j in range(1, len(at)):
                hit = hit[at[j][flat[hit + j]]]
            text, line = self._met(folded, self._fold(np.stack([flat[hit + j] for j in range(len(at))])))
            found.append(np.stack([hit[text], own[line], np.zeros(len(line), np.int64)], axis=1))
        if self.tables:
            # a window begins with two words that are neighbours in an item: of an item's windows only those after an edit do not
            start = np.flatnonzero((flat[:-1] > 0) & self.pairs[self._pair(flat)])
            sizes = sorted({size for _, size in self.tables})
            for low in range(0, len(start), 1 << 16):
                place = start[low : low + (1 << 16)]
                for walk in range(WALKS):
                    for size, keys, _ in self._keys(flat, place, walk, sizes):
                        folded, rows = self.tables[walk, size]
                        text, line = self._met(folded, keys)
                        found.append(np.concatenate([place[text][:, None], rows[line]], axis=1))
        return np.concatenate(found)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item id, distance, word at which the found stretch ends) of the verified items of each text, the best stretch of each."""
        vocabulary = _Vocabulary(self.known)
        parts, ends, total = [], [], 0
        gap = np.zeros(80, dtype=np.int32)  # no window reaches over from one text to the next
        for text in texts:
            raw = (text or "").lower().split()
            ids = np.fromiter((vocabulary[w] for w in raw), dtype=np.int32, count=len(raw))
            ids = ids[ids >= 0]
            parts += [ids, gap]
            total += len(ids) + len(gap)
            ends.append(total)
        if not parts or not self.items:
            return []
        flat = np.concatenate(parts)
        limits = np.array(ends)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        place, item_, offset = self.candidates(flat).T
        row_ = np.searchsorted(limits, place, side="right")
        begin = np.concatenate([[0], limits])[row_]
        # edits before the window move the item's begin by their number at most
        group_ = np.maximum(begin, place - offset - np.array(self.edits)[item_]) // 8
        for row, group, item in np.unique(np.stack([row_, group_, item_], axis=1), axis=0).tolist():
            words_, edits = self.items[item], self.edits[item]
            if best.get((row, item), (edits + 1, 0))[0] == 0:
                continue
            low = limits[row - 1] if row else 0
            a = max(low, group * 8)
            b = min(limits[row] - len(gap), group * 8 + 8 + len(words_) + 2 * edits)
            stretch = flat[a:b]
            # every kept word of the item must be there
            if np.isin(words_, stretch).sum() < len(words_) - edits:
                continue
            distance, end = edit_distance_within(words_, stretch)
            if distance <= edits and distance < best.get((row, item), (edits + 1, 0))[0]:
                best[(row, item)] = (distance, int(a - low + end))
        return [(row, self.ids[item], d, end) for (row, item), (d, end) in sorted(best.items())]


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    chars = 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row["text"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    yield block


def contaminated(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, distance, end_word) of every item that is found in a document."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    out = None
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, share)
            for batch in pieces(batches):
                hits = index.find(batch.column(1).to_pylist())
                if hits:
                    ids = batch.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int32())],
                        names=["doc_id", "item_id", "distance", "end_word"],
                    )

        found = source.mapInArrow(run, "doc_id bigint, item_id bigint, distance int, end_word int")
        out = found if out is None else out.union(found)
    return out


def without_items(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents in which no item is found, with their own columns; rows with a null doc_id stay."""
    columns = list(documents.columns)
    at = columns.index("text")
    kept = documents.select(*[F.col(f"`{c}`") for c in columns])
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, share)
            for batch in pieces(batches):
                hit = {h[0] for h in index.find(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept
