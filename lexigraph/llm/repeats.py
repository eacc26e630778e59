"""Exact removal of long repeated byte strings from a corpus.

A byte goes when a string of ``length`` bytes that covers it also starts
earlier: in a document of smaller id, or before in the same document.  Matches
are judged on the input, may overlap, and never cross documents.

A run-length compressed suffix index answers whether a string occurs, but not
whether it occurs *earlier*, and one index over the corpus fits no executor.
The same set of bytes is found here by content-chosen anchors:

1. in every window of ``length`` bytes the k-gram of least hash is the anchor;
   equal windows have equal anchors, at equal offsets.  An anchor stands for
   the run of windows that chose it, and its field is all the bytes of them;
2. anchors are grouped by k-gram hash (copies within a batch are settled before
   the shuffle).  Of anchors with equal fields all but the earliest are repeats,
   with every window of theirs;
3. where one k-gram has several distinct fields, the windows of the earliest
   anchor of each field are compared one by one through their hashes;
4. the repeated windows are gathered per document and their bytes cut out.

All hashes are 64 bits wide.  Defined results: a null text counts as empty and
an empty or short text keeps all its bytes; of rows that share a doc_id an
arbitrary one comes first, and each gets its own result; rows with a null
doc_id are compared with nothing and come back unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lexigraph.llm import ragged
from lexigraph.llm.common import bit_filter, free_name, pieces, stored

LENGTH = 100
GRAM = 28
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    base = int(_BASE)
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.empty(n, dtype=np.uint64)
        p[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            p[done : done + step] = p[:step] * np.uint64(pow(b, done, 1 << 64))
            done += step
        out.append(p)
    return out[0], out[1]


_TABLE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Prefix sums that give the hash of any slice of one byte string."""

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if not _POWERS or len(_POWERS[0]) < n:
            _POWERS[:] = _powers(max(n, 1 << 16))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * _POWERS[0][: n - 1], out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * _POWERS[1][start] + (stop - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * _POWERS[1][:n] + np.uint64(width))


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, field hash, first start, last start) of the runs of windows with one anchor."""
    if len(raw) < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    hashed = Hashed(raw)
    grams = hashed.windows(gram)
    bits = max(1, int(len(grams)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    spot = at[first]
    # the offset of the anchor in its field is part of the field's identity
    field = hashed.slices(first, last + length) ^ _mix((spot - first).astype(np.uint64))
    return grams[spot], field, first, last


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def _anchor_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = np.asarray(batch.column(0))
            data, ends = _bytes(batch.column(1))
            found = [anchors(data[a:b], length, gram) for a, b in zip(ends[:-1], ends[1:])]
            if not found:
                continue
            sizes = np.array([len(x[0]) for x in found])
            h, f, lo, hi = (np.concatenate(x) for x in zip(*found))
            doc = np.repeat(ids, sizes)
            # copies within the batch are settled here: only the earliest is grouped further
            order = np.lexsort((lo, doc, f, h))
            same = np.zeros(len(h), dtype=bool)
            if len(order):
                a, b = order[1:], order[:-1]
                same[a] = (h[a] == h[b]) & (f[a] == f[b])
            settled = same.copy()
            h = np.where(settled, _mix(doc.astype(np.uint64) * np.uint64(31) + lo.astype(np.uint64)), h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(settled)],
                names=["h", "f", "doc_id", "lo", "hi", "settled"],
            )

    return documents.mapInArrow(run, "h bigint, f bigint, doc_id bigint, lo int, hi int, settled boolean")


def repeated_windows(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, lo, hi): runs of starts of windows that also start earlier. Runs of a document may overlap."""
    gram = min(gram, length)
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    rows = _anchor_rows(texts, length, gram)
    group = Window.partitionBy("h", "settled")
    field = Window.partitionBy("h", "settled").orderBy("f", "doc_id", "lo")
    judged = (
        rows.withColumn("before", F.lag("f").over(field))
        .withColumn("fields", (F.min("f").over(group) != F.max("f").over(group)) & ~F.col("settled"))
        .withColumn("repeat", F.col("settled") | F.coalesce(F.col("before") == F.col("f"), F.lit(False)))
        .where("repeat or fields")
    )
    verdicts = stored(judged.select("doc_id", "lo", "hi", "repeat"), "repeat-anchors")
    whole = verdicts.where("repeat").select("doc_id", "lo", "hi")

    open_runs = verdicts.where("not repeat")
    near = bit_filter(open_runs.select("doc_id").distinct(), "doc_id")
    lists = open_runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = texts.where(near(F.col("doc_id"))).join(lists, "doc_id").select("doc_id", "raw", F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, ends = _bytes(batch.column(1))
            ids = np.asarray(batch.column(0))
            for i in range(batch.num_rows):
                lo = np.asarray(batch.column(2)[i].values).astype(np.int64)
                size = np.asarray(batch.column(3)[i].values).astype(np.int64) - lo + 1
                hashed = Hashed(data[ends[i] : ends[i + 1]])
                starts = ragged.gather(np.arange(len(hashed.sums)), lo, size)
                h = hashed.slices(starts, starts + length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), ids[i])), pa.array(starts.astype(np.int32))], names=["w", "doc_id", "at"])

    windows = joined.mapInArrow(hashes, "w bigint, doc_id bigint, at int")
    ordered = Window.partitionBy("w").orderBy("doc_id", "at")
    later = windows.withColumn("k", F.lag("at").over(ordered)).where("k is not null")
    single = later.select("doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return whole.union(single)


def _cut(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, whole_characters: bool) -> tuple[np.ndarray, int]:
    """(mask of the bytes that stay, number of removed runs)."""
    steps = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(steps, lo, 1)
    np.add.at(steps, np.minimum(hi + length, len(raw)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    if whole_characters and gone.any():
        # a character goes only with all its bytes, so that the rest stays valid UTF-8
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        all_gone = np.logical_and.reduceat(gone, lead)
        gone = np.repeat(all_gone, np.diff(np.append(lead, len(raw))))
    edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
    return ~gone, edges


def cut(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, whole_characters: bool = False) -> DataFrame:
    """All columns of the documents and ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Columns of the documents with these names, in any case, are dropped.

    With ``whole_characters`` a character that is only partly covered stays.
    """
    names = list(documents.columns)
    key, raw, lo, hi = (free_name(documents, n) for n in ("doc_", "raw_", "lo_", "hi_"))
    outputs = ["kept", "n_bytes", "n_removed", "n_spans"]
    carried = [c for c in names if c.lower() not in outputs]
    runs = stored(repeated_windows(documents, length, gram).groupBy("doc_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "repeat-runs")
    maybe = bit_filter(runs.select("doc_id"), "doc_id")
    source = documents.select(*[F.col(f"`{c}`") for c in carried], F.col("doc_id").cast("bigint").alias(key), F.col("text").cast("binary").alias(raw))
    touched = F.coalesce(maybe(F.col(key)), F.lit(False))
    hit = source.where(touched).join(runs.select(F.col("doc_id").alias(key), F.col("lo").alias(lo), F.col("hi").alias(hi)), key, "left")
    hit = hit.select(*[F.col(f"`{c}`") for c in carried], raw, lo, hi)
    n = len(carried)
    fields = [f for f in source.schema.fields if f.name in carried]
    fields += [StructField("kept", BinaryType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, ends = _bytes(batch.column(n))
            kept, removed, spans = [], [], []
            for i in range(batch.num_rows):
                own = data[ends[i] : ends[i + 1]]
                first = batch.column(n + 1)[i]
                if not first.is_valid or not len(first):
                    kept.append(own.tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                stay, runs_ = _cut(own, np.asarray(first.values), np.asarray(batch.column(n + 2)[i].values), length, whole_characters)
                kept.append(own[stay].tobytes())
                removed.append(len(own) - int(stay.sum()))
                spans.append(runs_)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(kept, pa.binary()), pa.array(np.diff(ends).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                names=[f.name for f in fields],
            )

    changed = hit.mapInArrow(run, StructType(fields))
    size = F.coalesce(F.octet_length(F.col(raw)), F.lit(0)).cast("bigint")
    clean = source.where(~touched).select(
        *[F.col(f"`{c}`") for c in carried],
        F.coalesce(F.col(raw), F.lit(b"")).alias("kept"),
        size.alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
    )
    return changed.union(clean)


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    return cut(documents.select("doc_id", "text"), length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut from their texts; texts that end up empty stay as rows.

    A column ``n_chars`` follows the new text.
    """
    names = documents.columns
    # other columns travel under names of their own, so that none clashes with those of the result
    plain = documents.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(names) if c not in ("text", "n_chars")])
    done = cut(plain, length, whole_characters=True)
    text = F.col("kept").cast("string")
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return done.select(*[new[c] if c in new else F.col(f"carried_{i}").alias(c) for i, c in enumerate(names)])


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same digests by a set of all windows, for small inputs."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode("utf-8")
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
