"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by a pattern; every distinct piece is merged once per batch.
Pieces of like length share one padded matrix.  In each round every row merges
its leftmost pair of least rank: pair ranks come from a hashed pair table, a
row loses exactly one cell, and rows without a known pair leave the matrix.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; repeated rows give repeated results.  Input columns named
like an output column are dropped in favour of the output.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lexigraph.llm import ragged
from lexigraph.llm.common import free_name, pieces

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Piece lengths in bytes up to which pieces share a matrix; longer ones are merged one by one with a heap.
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Pieces kept between batches, and cells of one matrix.
_CACHE_PIECES = 250_000
_MATRIX_CELLS = 1 << 20
#: Characters whose pieces are held at a time.
_BATCH_CHARS = 1 << 20


class ByteBpe:
    """Ranks of a ``.tiktoken`` file and the merges that they imply."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self._tokens = [b""] * size
        for token, rank in ranks.items():
            self._tokens[rank] = token
        lengths = np.array([len(t) for t in self._tokens], dtype=np.int64)
        self._token_starts = ragged.offsets(lengths)[:-1]
        self._token_lengths = lengths
        self._token_bytes = np.frombuffer(b"".join(self._tokens), dtype=np.uint8)
        self._of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                b = ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._build_pairs(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.int32))
        self._known: dict[str, int] = {}
        self._reset()

    def _build_pairs(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = (left << np.uint64(32)) | right
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._pair_keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self._pair_ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        waiting = np.arange(len(keys))
        slots = self._slots(keys)
        while len(waiting):
            free = self._pair_keys[slots] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self._pair_keys[slots[placed]] = keys[waiting[placed]]
            self._pair_ranks[slots[placed]] = merged[waiting[placed]]
            rest = np.ones(len(waiting), bool)
            rest[placed] = False
            waiting, slots = waiting[rest], (slots[rest] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self._shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every merged pair, or the largest int where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slots(keys)
        out = np.full(len(keys), _NONE, dtype=np.int32)
        at = np.arange(len(keys))
        while len(at):
            there = self._pair_keys[slots]
            hit = there == keys
            out[at[hit]] = self._pair_ranks[slots[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            at, keys, slots = at[go], keys[go], (slots[go] + 1) & self._mask
        return out

    def _reset(self) -> None:
        self._known.clear()
        self._piece_ids = np.zeros(0, np.int32)
        self._piece_starts = np.zeros(0, np.int64)
        self._piece_lengths = np.zeros(0, np.int64)

    def _merge_matrix(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the rows, flat and in order."""
        n = len(rows)
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        starts = ragged.offsets(lengths)
        flat = self._of_byte[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        valid = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[valid] = flat
        ranks = np.full((n, width), _NONE, dtype=np.int32)
        pairs = valid[:, 1:]
        ranks[:, :-1][pairs] = self.pair_ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        alive = np.arange(n)
        left = lengths.copy()
        out = np.zeros(starts[-1], dtype=np.int32)
        done_lengths = np.zeros(n, dtype=np.int64)
        while len(alive):
            at = ranks.argmin(axis=1)
            line = np.arange(len(alive))
            best = ranks[line, at]
            stop = best == _NONE
            if stop.any():
                gone = alive[stop]
                size = left[stop]
                done_lengths[gone] = size
                kept = np.arange(ids.shape[1]) < size[:, None]
                target = np.repeat(starts[gone], size) + np.arange(int(size.sum())) - np.repeat(ragged.offsets(size)[:-1], size)
                out[target] = ids[stop][kept]
                go = ~stop
                alive, left, ids, ranks, at, best = alive[go], left[go], ids[go], ranks[go], at[go], best[go]
                if not len(alive):
                    break
                line = np.arange(len(alive))
            ids[line, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, at + 1] = False
            width = ids.shape[1] - 1
            ids = ids[keep].reshape(-1, width)
            ranks = ranks[keep].reshape(-1, width)
            left = left - 1
            has = at + 1 < left
            ranks[line, at] = _NONE
            ranks[line[has], at[has]] = self.pair_ranks(ids[line[has], at[has]], ids[line[has], at[has] + 1])
            has = at > 0
            ranks[line[has], at[has] - 1] = self.pair_ranks(ids[line[has], at[has] - 1], ids[line[has], at[has]])
        # close the gaps that merges left between rows
        return ragged.gather(out, starts[:-1], done_lengths), done_lengths

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of pairs over a linked list."""
        n = len(piece)
        ids = self._of_byte[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        parts = [bytes([b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != int(_NONE)]
        current = {i: r for r, i in heap}
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or current.get(i) != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            alive[j] = False
            current.pop(j, None)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k < 0:
                    continue
                nxt = after[k]
                fresh = self.ranks.get(parts[k] + parts[nxt]) if nxt < n else None
                if fresh is None:
                    current.pop(k, None)
                else:
                    current[k] = fresh
                    heapq.heappush(heap, (fresh, k))
        return [self.ranks[p] for p, ok in zip(parts, alive) if ok]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that were not seen before and keep their ids."""
        raw = [p.encode("utf-8") for p in pieces]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        known: list[np.ndarray] = []
        order: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        whole = np.array([self.ranks.get(r, -1) for r in raw], dtype=np.int32)
        at = np.flatnonzero(whole >= 0)
        known.append(whole[at])
        order.append(at)
        counts.append(np.ones(len(at), np.int64))
        rest = whole < 0
        low = 0
        for width in _WIDTHS:
            at = np.flatnonzero(rest & (lengths > low) & (lengths <= width))
            step = max(1, _MATRIX_CELLS // width)
            for i in range(0, len(at), step):
                part = at[i : i + step]
                ids, sizes = self._merge_matrix([raw[k] for k in part], width)
                known.append(ids)
                order.append(part)
                counts.append(sizes)
            low = width
        for k in np.flatnonzero(rest & (lengths > low)):
            ids = np.array(self._merge_long(raw[k]), dtype=np.int32)
            known.append(ids)
            order.append(np.array([k]))
            counts.append(np.array([len(ids)], dtype=np.int64))
        sizes = np.concatenate(counts)
        base = len(self._piece_starts)
        starts = ragged.offsets(sizes)[:-1] + len(self._piece_ids)
        self._piece_ids = np.concatenate([self._piece_ids, *known])
        self._piece_starts = np.concatenate([self._piece_starts, starts])
        self._piece_lengths = np.concatenate([self._piece_lengths, sizes])
        for slot, k in enumerate(np.concatenate(order).tolist(), base):
            self._known[pieces[k]] = slot

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, special tokens not being known."""
        cuts, held = [0], 0
        for i, text in enumerate(texts):
            if held and held + len(text) > _BATCH_CHARS:
                cuts.append(i)
                held = 0
            held += len(text)
        cuts.append(len(texts))
        done = [self._encode_some(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        if len(done) == 1:
            return done[0]
        lengths = np.concatenate([np.diff(ends) for _, ends in done])
        return np.concatenate([ids for ids, _ in done]), ragged.offsets(lengths)

    def _encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = self.pattern.findall
        pieces = [split(t) for t in texts]
        if len(self._known) > _CACHE_PIECES:
            self._reset()
        fresh = set().union(*pieces).difference(self._known)
        if fresh:
            self._learn(list(fresh))
        slot = self._known
        flat = np.array([slot[p] for row in pieces for p in row], dtype=np.int64)
        sizes = self._piece_lengths[flat]
        ids = ragged.gather(self._piece_ids, self._piece_starts[flat], sizes)
        ends = ragged.offsets(sizes)
        return ids, ends[ragged.offsets(np.array([len(row) for row in pieces], dtype=np.int64))]

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the rows of ids."""
        sizes = self._token_lengths[ids]
        return ragged.gather(self._token_bytes, self._token_starts[ids], sizes), ragged.offsets(sizes)[ends]


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary file, once per Python process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(path, pattern)
    return _LOADED[key]


def encode_texts(path: str, pattern: str, texts: list[str]) -> list[list[int]]:
    """Ids of a few texts, outside Spark."""
    ids, ends = loaded(path, pattern).encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def encode(df: DataFrame, text_col: str, path: str, pattern: str, ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """Add ``ids_col`` (array<int>), and the bytes decoded from it where ``bytes_col`` is named.

    The text column is replaced by the outputs; other columns pass through.
    """
    outputs = {ids_col, bytes_col}
    carried = [c for c in df.columns if c != text_col and c.lower() not in {o.lower() for o in outputs if o}]
    name = free_name(df, "text_")
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(name))
    fields = [f for f in source.schema.fields if f.name != name]
    fields.append(StructField(ids_col, ArrayType(IntegerType(), False), False))
    if bytes_col:
        fields.append(StructField(bytes_col, BinaryType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            ids, ends = bpe.encode_batch(batch.column(len(carried)).to_pylist())
            columns = [batch.column(i) for i in range(len(carried))]
            names = [*carried, ids_col]
            columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
            if bytes_col:
                raw, cuts = bpe.decode_batch(ids, ends)
                columns.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]))
                names.append(bytes_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, StructType(fields))


def decode(df: DataFrame, ids_col: str, path: str, pattern: str, bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids count as none."""
    carried = [c for c in df.columns if c.lower() not in (ids_col.lower(), bytes_col.lower())]
    name = free_name(df, "ids_")
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias(name))
    fields = [f for f in source.schema.fields if f.name != name] + [StructField(bytes_col, BinaryType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in pieces(batches):
            rows = batch.column(len(carried))
            lengths = np.asarray(rows.value_lengths().fill_null(0)).astype(np.int64)
            raw, cuts = bpe.decode_batch(np.asarray(rows.flatten()).astype(np.int64), ragged.offsets(lengths))
            out = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), out], names=[*carried, bytes_col])

    return source.mapInArrow(run, StructType(fields))


def digests(df: DataFrame, text_col: str, path: str, pattern: str) -> DataFrame:
    """doc_id with the number of ids and SHA-256 digests of the ids and of the decoded bytes."""
    coded = encode(df.select("doc_id", text_col), text_col, path, pattern, "ids", "decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
