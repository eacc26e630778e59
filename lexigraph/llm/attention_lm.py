"""Scores of texts by a small causal self-attention model over subword ids.

A text is its words (A-Z in lower case, split at ASCII white space) and one
end.  Every word is encoded by a byte-level vocabulary, so a text is a row of
ids that starts and ends with an end mark.  An id's probability is that of its
class given the ids before, times its share of the class after the last id, from
bigram counts of all training text.  The class logits are a table by the last id
(from the same counts) plus one causal attention layer over the last ids.  The
layer works on embeddings of ids, which are the leading singular vectors of the
bigram counts; its query, key, value and output weights and its bias by distance
are trained in numpy by gradient descent.  Every task starts from the same
weights and makes one pass over all ids of its documents, and the weighted mean
of the results is the model; so the weights depend on how rows are parted.
Scoring cuts a text into overlapping windows in which every id is scored once,
with a stated least context, by batched masked attention.

The unigram base is computed beside it: exact word counts over all training
text, joined to the words of every document; words above a share of all tokens
(a bounded number of them) are looked up in the task instead of shuffled.  Words
are known by 95 bits of hash of their ids.

Defined results: a null or empty text is the end alone; equal texts have equal
scores; with no training text at all every id is equally likely.  Every row has
a row of its own in the result, also rows that repeat a doc_id or have none.
Rows with a null doc_id belong to the training part; other columns are not used.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.llm import ragged
from lexigraph.llm.common import ascii_lower, pieces, stored

#: Rows of the input tables (the most frequent ids have their own), classes, width, window, least context.
ROWS, CLASSES, WIDTH, WINDOW, CONTEXT = 2048, 64, 16, 24, 6
#: Windows of a training step, its rate, and windows scored at a time.
BATCH, RATE, SCORED = 64, 0.01, 256
#: Taken from the count of every pair of rows, and the least weight of a row's share of its class beside such counts.
DISCOUNT, BACKOFF = 0.75, 1.0
#: A word at least this share of all training tokens is looked up in memory: at most its inverse many words.
FREQUENT = 1 / 1_600_000
#: Words whose ids a worker keeps; beyond, it starts anew.
_CACHE_WORDS = 300_000
#: log2 of the places of the table of frequent words.
_TABLE_BITS = 21
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


#: What str.split() takes for white space beyond the ASCII blanks.
_ODD = "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \t\n\x0b\x0c\r")


def split(text: str | None) -> list[str]:
    """Words of a text whose A-Z are in lower case already; white space is ASCII alone."""
    if not text:
        return []
    if any(c in text for c in (_ODD[:4] if text.isascii() else _ODD)):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


_MIXERS = np.random.default_rng(20240607).integers(1, 2**63, (2, 1 << 17), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)] * 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 31 bits) of the words that are the ids [first, first + size); sizes are positive and words adjoin."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    place = np.arange(int(sizes.sum())) - np.repeat(ragged.offsets(sizes)[:-1], sizes)
    own = ids[first[0] : first[0] + len(place)]
    longest, out = int(sizes.max()), []
    for k in (0, 1):
        if len(_POWERS[k]) < longest:
            _POWERS[k] = np.cumprod(np.full(max(longest, 64), _STEPS[k], np.uint64))
        out.append(_mixed(np.add.reduceat(_MIXERS[k][own] * _POWERS[k][place], first - first[0])))
    return out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


class _Slots(dict):
    """Word -> slot; a new word gets the next one."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = slot = len(self)
        return slot


class Words:
    """Words by slot, with their ids and hashes; kept by a worker from task to task."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.sizes = np.zeros(self.end, np.int64)  # bytes of each id
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.reset()

    def reset(self) -> None:
        self.slot = _Slots()
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.hashes = (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def full(self) -> bool:
        return len(self.slot) > _CACHE_WORDS

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word): every word with a blank before it, by itself."""
        text = " " + " ".join(words)
        if any(c in text for c in (_ODD[:4] if text.isascii() else _ODD)):  # such blanks could reach over from word to word
            each = [self.coder.encode_ordinary(" " + w) for w in words]
            return np.array([i for row in each for i in row], dtype=np.int32), np.array(list(map(len, each)), dtype=np.int64)
        ids = np.array(self.coder.encode_ordinary(text), dtype=np.int32)
        begins = ragged.offsets(np.fromiter((len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in words), np.int64, len(words)))
        return ids, np.diff(np.searchsorted(ragged.offsets(self.sizes[ids])[:-1], begins))

    def slots(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(slot of every word, number of words of each row)."""
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        each = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=int(counts.sum()))
        fresh = self.slot.fresh
        if fresh:
            ids, sizes = self._encoded(fresh)
            starts = ragged.offsets(sizes)[:-1]
            self.hashes = tuple(map(np.concatenate, zip(self.hashes, word_hashes(ids, starts, sizes))))
            self.starts = np.concatenate([self.starts, starts + len(self.flat)])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, ids])
            self.slot.fresh = []
        return each, counts

    def documents(self, each: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): an end mark, the ids of the words, an end mark."""
        sizes = self.lengths[each]
        inner = ragged.gather(self.flat, self.starts[each], sizes)
        upto = ragged.offsets(sizes)[ragged.offsets(counts)]
        starts = ragged.offsets(np.diff(upto) + 2)
        out = np.full(starts[-1], self.end, dtype=np.int32)
        inside = np.ones(len(out), dtype=bool)
        inside[starts[:-1]] = False
        inside[starts[1:] - 1] = False
        out[inside] = inner
        return out, starts


_KEPT: dict[tuple[str, str], Words] = {}


def kept_words(path: str, pattern: str) -> Words:
    if (path, pattern) not in _KEPT:
        _KEPT.clear()  # one cache at a time
        _KEPT[path, pattern] = Words(path, pattern)
    return _KEPT[path, pattern]


_GAPS = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_PAST = (_GAPS >= 0).astype(np.float32)
_HIGH = np.float32(60.0)


@dataclass
class Weights:
    """Everything that scoring needs; arrays of a size that does not depend on the corpus."""

    row: np.ndarray  # id -> row
    group: np.ndarray  # id -> class
    inner: np.ndarray  # id -> ln share within its row
    follow: np.ndarray  # [row before, row] ln share of the row within its class
    bigram: np.ndarray  # [row, class] probability
    embedding: np.ndarray  # [row, WIDTH]
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    bias: np.ndarray  # by distance
    tables: tuple | None = field(default=None, repr=False)

    NAMES = ("query", "key", "value", "out", "bias")

    def trained(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exp of scores by row pair, values by row, masked exp of the bias); made once in a worker."""
        if self.tables is None:
            scores = (self.embedding @ self.query) @ (self.embedding @ self.key).T * np.float32(1 / math.sqrt(WIDTH))
            self.tables = (
                np.exp(np.minimum(scores, _HIGH / 2)).ravel(),
                np.concatenate([self.embedding @ self.value, np.ones((ROWS, 1))], axis=1).astype(np.float32),  # the last column adds up the weights
                (np.exp(np.minimum(self.bias, _HIGH / 2))[np.maximum(_GAPS, 0)] * _PAST).astype(np.float32),
            )
        return self.tables


def _rows(counts: np.ndarray) -> np.ndarray:
    """id -> row: the most frequent ids have their own, the others share the last quarter."""
    own = ROWS - ROWS // 4
    order = np.lexsort((np.arange(len(counts)), -counts))
    row = own + (np.arange(len(counts), dtype=np.int64) * 2654435761 % 2**32) % (ROWS - own)
    row = row.astype(np.int64)
    row[order[:own]] = np.arange(own)
    return row


def _spectrum(bigrams: np.ndarray, seed: int = 5) -> np.ndarray:
    """Leading singular vectors, scaled, of what comes before and after a row."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([bigrams, bigrams.T], axis=1).astype(np.float64)
    both = np.sqrt(both / np.maximum(1.0, both.sum(axis=1, keepdims=True)))
    u, s, _ = np.linalg.svd(both @ rng.normal(size=(both.shape[1], 64)) / 8.0, full_matrices=False)
    return u[:, :24] * s[:24]


def _classes(x: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """row -> class: k-means over the spectrum."""
    heavy = np.argsort(-mass, kind="stable")
    label = np.full(len(x), -1)
    alone = CLASSES // 4  # the most frequent rows are classes of their own
    label[heavy[:alone]] = np.arange(alone)
    rest = heavy[alone:]
    centers = x[rest[: CLASSES - alone]].copy()
    for _ in range(25):
        d = ((x[rest][:, None, :] - centers[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        for c in range(len(centers)):
            mine = rest[own == c]
            if len(mine):
                centers[c] = np.average(x[mine], axis=0, weights=mass[mine])
    label[rest] = own + alone
    return label


def assemble(counts: np.ndarray, row: np.ndarray, bigrams: np.ndarray, seed: int = 3) -> Weights:
    """Count tables and the common starting weights."""
    x = _spectrum(bigrams)
    label = _classes(x, bigrams.sum(axis=0) + 1.0)
    group = label[row].astype(np.int64)
    smooth = counts + 0.02
    of_row = np.bincount(row, weights=smooth, minlength=ROWS)
    inner = np.log(smooth) - np.log(np.maximum(of_row, 1e-9))[row]
    of_class = np.bincount(label, weights=of_row, minlength=CLASSES)
    share = of_row / np.maximum(of_class, 1e-9)[label]
    member = np.zeros((ROWS, CLASSES))
    member[np.arange(ROWS), label] = 1.0
    # absolute discounting: what is taken from seen pairs goes to the class's shares
    taken = DISCOUNT * ((bigrams > 0) @ member) + BACKOFF
    follow = np.log(np.maximum(np.maximum(bigrams - DISCOUNT, 0.0) + taken[:, label] * share, 1e-12)) - np.log(bigrams @ member + BACKOFF)[:, label]
    table = np.zeros((ROWS, CLASSES))
    np.add.at(table.T, label, bigrams.T)
    prior = np.bincount(group, weights=smooth, minlength=CLASSES)
    prior = (prior + 1e-3) * (of_class > 0)  # a class without ids has no outcome
    prior /= prior.sum()
    table = table + 20.0 * prior
    embedding = x[:, :WIDTH] - x[:, :WIDTH].mean(axis=0)
    embedding /= np.maximum(embedding.std(axis=0), 1e-6)
    rng = np.random.default_rng(seed)
    d, f = WIDTH, np.float32
    return Weights(
        row, group, inner, follow.astype(f), (np.maximum(table, 1e-12) / table.sum(axis=1, keepdims=True)).astype(f), np.clip(embedding, -4, 4).astype(f),
        rng.normal(0, 0.3, (d, d)).astype(f), rng.normal(0, 0.3, (d, d)).astype(f), rng.normal(0, 0.3, (d, d)).astype(f),
        np.zeros((d, CLASSES), f), (-0.02 * np.arange(WINDOW)).astype(f),
    )


def windows(starts: np.ndarray, lengths: np.ndarray, step: int = WINDOW - CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with ``lengths`` inputs: (row, start, size, first scored place) of every window."""
    count = np.where(lengths <= WINDOW, 1, 1 + -(-(lengths - WINDOW) // step))
    count = np.where(lengths <= 0, 0, count)
    owner = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(owner)) - np.repeat(ragged.offsets(count)[:-1], count)
    begin = number * step
    size = np.minimum(WINDOW, lengths[owner] - begin)
    return owner, starts[owner] + begin, size, np.where(number == 0, 0, WINDOW - step)


def log_probabilities(w: Weights, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ln probability of each row of ids that begins and ends with the end mark."""
    scores, values, near = w.prepared()
    lengths = np.diff(starts) - 1
    owner, begin, size, first = windows(starts[:-1], lengths)
    total = np.zeros(len(lengths))
    padded = np.concatenate([ids, np.zeros(WINDOW + 1, dtype=ids.dtype)])
    own = w.row.take(padded)
    ones = np.ones(CLASSES, np.float32)
    for head in (0, CONTEXT):  # the first windows of texts, and the others, whose first places are context alone
        those = np.flatnonzero(first == head)
        place = np.arange(head, WINDOW)
        bias = near[head:]
        for low in range(0, len(those), SCORED):
            some = those[low : low + SCORED]
            at = begin[some][:, None] + np.arange(WINDOW)
            rows = own.take(at)
            s = scores.take((rows[:, head:, None] * ROWS) + rows[:, None, :])
            s *= bias
            mixed = np.matmul(s, values.take(rows, axis=0)).reshape(-1, WIDTH + 1)
            p = (mixed[:, :WIDTH] / mixed[:, WIDTH:]) @ w.out
            np.minimum(p, _HIGH, out=p)
            np.exp(p, out=p)
            last = rows[:, head:].ravel()
            p *= w.bigram.take(last, axis=0)
            target = padded.take(at[:, head:] + 1).ravel()
            picked = p.take(np.arange(0, p.size, CLASSES) + w.group.take(target)).astype(np.float64)
            logp = np.log(picked / (p @ ones)) + w.follow.take(last * ROWS + w.row.take(target)) + w.inner.take(target)
            logp = np.where(place < size[some][:, None], logp.reshape(len(some), -1), 0.0).sum(axis=1)
            total += np.bincount(owner[some], weights=logp, minlength=len(total))
    return total


class Trainer:
    """Gradient descent (Adam) on the class logits of windows."""

    def __init__(self, w: Weights):
        self.w = w
        self.first = [np.zeros_like(p) for p in w.trained()]
        self.second = [np.zeros_like(p) for p in w.trained()]
        self.log_bigram = np.log(w.bigram)
        self.steps = 0
        self.tokens = 0

    def step(self, rows: np.ndarray, size: np.ndarray, groups: np.ndarray) -> float:
        w = self.w
        m, d, scale = len(rows), WIDTH, np.float32(1 / math.sqrt(WIDTH))
        flat = rows.ravel()
        e = w.embedding.take(flat, axis=0)
        q, k, v = ((e @ t).reshape(m, WINDOW, d) for t in (w.query * scale, w.key, w.value))
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += w.bias[np.maximum(_GAPS, 0)]
        np.minimum(a, _HIGH, out=a)  # so that exp stays finite without a pass for the maximum
        np.exp(a, out=a)
        a *= _PAST
        a *= (1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32))).reshape(m, WINDOW, 1)
        x = np.matmul(a, v).reshape(-1, d)
        p = x @ w.out
        p += self.log_bigram.take(flat, axis=0)
        np.minimum(p, _HIGH, out=p)
        np.exp(p, out=p)
        n = int(size.sum())
        target = np.arange(0, p.size, CLASSES) + groups.ravel()
        norm = 1 / (p @ np.ones(CLASSES, np.float32))
        real = (np.arange(WINDOW) < size[:, None]).ravel()
        loss = float(-np.log(np.maximum(p.take(target) * norm, 1e-12))[real].mean())
        weight_ = real * np.float32(1 / n)
        p *= (norm * weight_)[:, None]
        p.reshape(-1)[target] -= weight_
        d_out = x.T @ p
        d_x = p @ w.out.T
        d_mixed = d_x.reshape(m, WINDOW, d)
        d_v = np.matmul(a.transpose(0, 2, 1), d_mixed)
        d_s = np.matmul(d_mixed, v.transpose(0, 2, 1))
        d_s -= np.einsum("ij,ij->i", d_x, x).reshape(m, WINDOW, 1)
        d_s *= a
        d_bias = np.bincount(np.maximum(_GAPS, 0).ravel(), weights=d_s.sum(axis=0).ravel(), minlength=WINDOW).astype(np.float32)
        grads = [scale * (e.T @ np.matmul(d_s, k).reshape(-1, d)), e.T @ np.matmul(d_s.transpose(0, 2, 1), q).reshape(-1, d), e.T @ d_v.reshape(-1, d), d_out, d_bias]
        self.steps += 1
        self.tokens += n
        t = self.steps
        for weight, g, mean, square in zip(w.trained(), grads, self.first, self.second):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            weight -= (RATE / math.sqrt(1 + t / 200) / (1 - 0.9**t)) * mean / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        return loss

    def texts(self, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """One pass over every id of the texts, given as batches of (ids, offsets)."""
        held = [(np.zeros((0, WINDOW), self.w.row.dtype), np.zeros(0, np.int64), np.zeros((0, WINDOW), self.w.group.dtype))]
        for ids, starts in batches:
            _, begin, sizes, _ = windows(starts[:-1], np.diff(starts) - 1, WINDOW)
            padded = np.concatenate([ids, np.zeros(WINDOW + 1, dtype=ids.dtype)])
            for low in range(0, len(begin), 4096):  # bounds what is gathered at a time
                part = slice(low, low + 4096)
                at = begin[part][:, None] + np.arange(WINDOW)
                held.append((self.w.row.take(padded.take(at)), sizes[part], self.w.group.take(padded.take(at + 1))))
                rows, sizes_, groups = (np.concatenate(x) for x in zip(*held))
                whole = len(rows) // BATCH * BATCH
                for first in range(0, whole, BATCH):
                    step = slice(first, first + BATCH)
                    self.step(rows[step], sizes_[step], groups[step])
                held = [(rows[whole:], sizes_[whole:], groups[whole:])]
        if len(held[0][0]):
            self.step(*held[0])


def lowered(documents: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, th, held_out, text): equal texts have an equal ``th``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    quick = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(held_out, F.lit(False)).alias("held_out"), quick.alias("text"))


def _end(path: str) -> int:
    """The end mark: one more than the largest id of the vocabulary."""
    with open(path, "rb") as lines:
        return max(int(line.split()[1]) for line in lines) + 1


def _id_type(path: str) -> str:
    return "<u2" if _end(path) < 1 << 16 else "<u4"


def encoded(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of texts (doc_id, th, held_out, ids as packed integers), of words (h1, h2, c) and of ids (h1, -1, c).

    The latter two count the outcomes in training texts, added up within a task.
    """
    kind, size = _id_type(path), _end(path) + 1
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("h1", pa.int64()), ("h2", pa.int32()), ("c", pa.int64())])

    def counted(h1: np.ndarray, h2: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(c), 50_000):
            part = slice(low, low + 50_000)
            n = len(c[part])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in schema.types[:4]), pa.array(h1[part]), pa.array(h2[part]), pa.array(c[part])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_words(path, pattern)
        counts = np.zeros(0, np.int64)
        total = np.zeros(size, np.int64)

        def of_words() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(counts)
            yield from counted(words.hashes[0][at], words.hashes[1][at], counts[at])

        for batch in pieces(batches, 2048, 3):
            if words.full():
                yield from of_words()
                words.reset()
                counts = np.zeros(0, np.int64)
            each, sizes = words.slots([split(t) for t in batch.column(3).to_pylist()])
            training = ~np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            new = np.bincount(each[np.repeat(training, sizes)], minlength=len(words.slot))
            new[: len(counts)] += counts
            counts = new
            ids, starts = words.documents(each, sizes)
            total += np.bincount(ids[np.repeat(training, np.diff(starts))], minlength=size)
            total[size - 1] -= training.sum()  # the mark at the begin is no outcome
            raw = ids.astype(kind)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((starts * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, *(pa.nulls(batch.num_rows, t) for t in schema.types[4:])], schema=schema)
        yield from of_words()
        at = np.flatnonzero(total)
        yield from counted(at, np.full(len(at), -1, np.int32), total[at])

    return texts.mapInArrow(run, "doc_id bigint, th bigint, held_out boolean, ids binary, h1 bigint, h2 int, c bigint")


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    width = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], dtype=kind, count=int(ends[-1] - ends[0]) // width, offset=int(ends[0]))
    return flat.astype(np.int32), (ends - ends[0]) // width


def train(first: DataFrame, path: str) -> Weights:
    """The model of the training rows of ``encoded``; only tables of fixed size reach the driver."""
    kind = _id_type(path)
    texts = first.where("not held_out").select("ids")
    found = first.where("h2 = -1").groupBy("h1").agg(F.sum("c").alias("c")).toArrow()
    n = np.zeros(_end(path) + 1)
    n[found["h1"].to_numpy()] = found["c"].to_numpy()
    row = _rows(n)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()  # a worker may come from the pass that needed it
        total = np.zeros(ROWS * ROWS, dtype=np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                total.__iadd__(np.bincount(np.concatenate(held), minlength=len(total)))
                held.clear()

        for batch in pieces(batches):
            ids, starts = _unpacked(batch.column(0), kind)
            r = row[ids]
            cell = r[:-1] * ROWS + r[1:]
            inside = np.ones(len(cell), dtype=bool)
            inside[starts[1:-1] - 1] = False
            held.append(cell[inside])
            if sum(map(len, held)) > 1 << 21:
                add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    pairs = texts.mapInArrow(bigrams, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(ROWS * ROWS)
    table[pairs["cell"].to_numpy()] = pairs["n"].to_numpy()
    start = assemble(n, row, table.reshape(ROWS, ROWS))

    # what training does not read stays on the driver
    sent = replace(start, follow=np.zeros((0, 0), np.float32), inner=np.zeros(0))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()
        mine = replace(sent, **{k: np.copy(getattr(sent, k)) for k in Weights.NAMES})
        trainer = Trainer(mine)
        trainer.texts(_unpacked(batch.column(0), kind) for batch in pieces(batches))
        if trainer.tokens:
            flat = np.concatenate([p.ravel() for p in mine.trained()]).astype(np.float64) * trainer.tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), float(trainer.tokens)))], names=["i", "s", "n"])

    means = texts.mapInArrow(descend, "i int, s double, n double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("p")).toArrow()
    if means.num_rows:
        flat = np.zeros(means.num_rows)
        flat[means["i"].to_numpy()] = means["p"].to_numpy()
        at = 0
        for name in Weights.NAMES:
            old = getattr(start, name)
            setattr(start, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
    return start


class Frequent:
    """log10(c + 1) of frequent words in a table of fixed size; a word without a place in it is treated as a rare one."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray):
        self.words = (h1, h2, counts)
        self.tables: tuple | None = None

    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Made in the worker: the words alone are sent."""
        if self.tables is None:
            h1, h2, counts = self.words
            size = 1 << _TABLE_BITS
            tables = np.zeros(size, np.int64), np.full(size, -2, np.int32), np.zeros(size)
            at = h1 & (size - 1)
            tables[0][at], tables[1][at] = h1, h2
            there = (tables[0][at] == h1) & (tables[1][at] == h2)
            tables[2][at[there]] = np.log10(counts[there] + 1.0)
            self.tables = tables
        return self.tables

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The word's value, or -1."""
        one, two, worth = self.prepared()
        at = h1 & ((1 << _TABLE_BITS) - 1)
        return np.where((one[at] == h1) & (two[at] == h2), worth[at], -1.0)


_PARTS = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("held_out", pa.bool_()), ("copies", pa.int64()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("hits", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
)


def _scored(coded: DataFrame, shared, path: str) -> DataFrame:
    """A row for every text with its score, and one for every word of it that is not frequent.

    ``shared`` is a broadcast of the weights, the frequent words, and a mask of the ids that begin a word.
    """
    kind, end = _id_type(path), _end(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, frequent, begins = shared.value
        _KEPT.clear()
        for batch in pieces(batches, 1024, 3, 1 << 20):
            ids, starts = _unpacked(batch.column(3), kind)
            m = batch.num_rows
            score = log_probabilities(weights, ids, starts) / math.log(10)
            inside = ids != end
            owner = np.repeat(np.arange(m), np.diff(starts))[inside]
            flat = ids[inside]
            first = np.flatnonzero(begins[flat])
            h1, h2 = word_hashes(flat, first, np.diff(np.append(first, len(flat))))
            owner = owner[first]
            worth = frequent.find(h1, h2)
            common = worth >= 0
            base = np.bincount(owner[common], weights=worth[common], minlength=m)
            hits = np.bincount(owner[common], minlength=m)
            sizes = np.bincount(owner, minlength=m)
            h1, h2, owner = h1[~common], h2[~common], owner[~common]
            order = np.lexsort((h1, owner))
            h1, h2, owner = h1[order], h2[order], owner[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (owner[1:] != owner[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(h1)))
            k, whose = len(at), pa.array(owner[at])
            keys, marks = batch.column(0), batch.column(1)
            ones, none = pa.array(np.ones(m, np.int64)), pa.array(np.zeros(k, np.int64))
            # the key of a text's own row is no word's: these rows spread over all partitions
            yield pa.RecordBatch.from_arrays(
                [marks, pa.array(np.full(m, -1, np.int32)), keys, marks, batch.column(2), ones, pa.array(np.zeros(m, np.int64)), pa.array(sizes + 1), pa.array(hits), pa.array(base), pa.array(score)], schema=_PARTS
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at]), pa.array(h2[at]), keys.take(whose), marks.take(whose), pa.nulls(k, pa.bool_()), none, pa.array(times), none, none, pa.array(np.zeros(k)), pa.array(np.zeros(k))], schema=_PARTS
            )

    return coded.mapInArrow(run, "h1 bigint, h2 int, doc_id bigint, th bigint, held_out boolean, copies bigint, times bigint, n_tokens bigint, hits bigint, base double, score double")


def score(documents: DataFrame, held_out: Column, path: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    first = stored(encoded(lowered(documents, held_out), path, pattern), "lm-ids")
    coded = first.where("ids is not null").select("doc_id", "th", "held_out", "ids")
    counts = stored(first.where("h2 >= 0").groupBy("h1", "h2").agg(F.sum("c").alias("c")), "lm-words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = coded.where("not held_out").count()
    n, v = int(sums["n"]) + ends, int(sums["v"]) + (1 if ends else 0)
    weights = train(first, path)
    # at most 1 / FREQUENT words
    known = counts.where(F.col("c") >= max(2, math.ceil(n * FREQUENT))).toArrow()
    words = Words(path, pattern)
    begins = np.array([words.coder.decode_single_token_bytes(i)[:1] == b" " if words.sizes[i] else False for i in range(words.end)] + [False])
    shared = spark.sparkContext.broadcast((weights, Frequent(known["h1"].to_numpy(), known["h2"].to_numpy(), known["c"].to_numpy()), begins))
    joined = _scored(coded, shared, path).join(counts, ["h1", "h2"], "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    based = joined.select(
        "doc_id", "th", "held_out", "copies", "n_tokens", "score",
        (F.when(c > 0, F.col("times")).otherwise(0) + F.col("hits")).alias("hits"),
        (F.col("times") * F.log10(c + 1) + F.col("base")).alias("base"),
    )
    end, per = math.log10(ends + 1), F.col("copies")
    each = (
        based.groupBy("doc_id", "th")
        .agg(F.max("held_out").alias("held_out"), *[F.sum(k).alias(k) for k in ("copies", "n_tokens", "hits", "base", "score")])
        .select(
            "doc_id",
            "held_out",
            (F.col("n_tokens") / per).cast("bigint").alias("n_tokens"),
            (F.col("hits") / per + (1 if ends else 0)).cast("bigint").alias("n_known"),
            F.lit(n).cast("bigint").alias("train_tokens"),
            (F.col("base") / per + F.lit(end) - F.col("n_tokens") / per * F.lit(math.log10(n + v + 1))).alias("base_score"),
            (F.col("score") / per).alias("score"),
            "copies",
        )
    )
    # rows that are equal in doc_id and text were added up
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copy", "copies")
