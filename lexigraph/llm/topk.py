"""Exact top-k search by inner product with a pivot table.

Vectors are turned into integers.  One more coordinate, the root of the largest
squared norm less the own one, turns the largest inner product into the nearest
neighbour.  Each candidate's distances to many pivots are computed once; the
largest difference to the query's own distances bounds its distance from below,
hence its score from above.  Candidates are scored in the order of that bound
until the bound falls below the k-th score: the rest cannot enter.

Queries are written in blocks to the shared folder; every task holds the
candidates of its split and reads the blocks one after another, so neither side
is broadcast or multiplied.  Each task sends k rows a query at most.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; a finite component that leaves the range of 32-bit integers raises,
as its scores do not fit; vectors are
compared with those of equal length alone; ties go to the smaller id, and rows
that repeat an id are each a candidate; a query is never its own answer (no row
with its id is); with fewer than k candidates all are returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.llm.common import shared_dir

#: Pivots, and the vectors of the bounded sample (by hash order) from which they are chosen.
PIVOTS = 24
SAMPLE = 2048
#: Queries handled at a time, candidates in a chunk, and candidates scored between two looks at the bound.
QUERY_BLOCK = 1024
CHUNK = 8192
STEP = 64
_LIMIT = float(2**31 - 1)


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    norms = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, largest - norms))[:, None]], axis=1)


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal from the first row."""
    if not len(x):
        return x
    chosen = [0]
    distance = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)):
        nxt = int(distance.argmax())
        if distance[nxt] == 0:
            break
        chosen.append(nxt)
        distance = np.minimum(distance, np.linalg.norm(x - x[nxt], axis=1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


class Table:
    """Candidates of one length with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, largest: float):
        self.ids, self.x = ids, x
        self.pivots = pivots
        self.largest = largest
        self.to_pivots = _distances(_augmented(x.astype(np.float64), largest), pivots) if len(pivots) else np.zeros((len(x), 0))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, candidate ids, scores) of each query, best first."""
        exact = q.astype(np.float64)
        norms = np.einsum("ij,ij->i", exact, exact)
        spot = np.concatenate([exact, np.zeros((len(q), 1))], axis=1)
        own = _distances(spot, self.pivots) if len(self.pivots) else np.zeros((len(q), 0))
        for line in range(len(q)):
            ids = np.zeros(0, dtype=np.int64)
            scores = np.zeros(0, dtype=np.int64)
            for low in range(0, len(self.x), CHUNK):
                part = slice(low, low + CHUNK)
                if len(self.pivots):
                    least = np.abs(self.to_pivots[part] - own[line]).max(axis=1)
                    # a little slack keeps rounding from cutting a true answer
                    least = np.maximum(0.0, least * (1 - 1e-9) - 1e-6)
                    bound = (norms[line] + self.largest - least**2) / 2.0 + 1e-6 * (1.0 + abs(norms[line]) + self.largest) * 1e-3 + 1.0
                else:
                    bound = np.full(len(self.x[part]), np.inf)
                chunk_ids, chunk = self.ids[part], self.x[part]
                if len(ids) == k:
                    open_ = np.flatnonzero(bound >= scores[-1])
                else:
                    open_ = np.arange(len(chunk))
                order = open_[np.argsort(-bound[open_], kind="stable")]
                for at in range(0, len(order), STEP):
                    some = order[at : at + STEP]
                    if len(ids) == k and bound[some[0]] < scores[-1]:
                        break
                    some = some[chunk_ids[some] != query_ids[line]]
                    ids = np.concatenate([ids, chunk_ids[some]])
                    scores = np.concatenate([scores, chunk[some] @ q[line]])
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
            if len(ids):
                yield int(query_ids[line]), ids, scores


def _matrices(ids: np.ndarray, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ids, integer matrix)."""
    lengths = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = (ids[rows], flat[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0), dtype=np.int64))
    return out


def integers(vectors: DataFrame, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(factor * x) of the vectors that take part."""
    wide = F.raise_error(F.lit(f"a component of {vector_col} leaves the range of 32-bit integers")).cast("bigint")
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: F.when(F.abs(x.cast("double")) <= F.lit(_LIMIT / factor), F.floor(x.cast("double") * F.lit(factor))).otherwise(wide))
    fit = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ok = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & fit
    return vectors.where(ok).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.cast("array<bigint>").alias("v"))


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``vec_id, v`` rows; ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = {int(r["n"]): float(r["m"]) for r in vectors.groupBy(F.size("v").alias("n")).agg(F.max(norm).alias("m")).collect()}
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    chosen: dict[int, np.ndarray] = {}
    for n in {len(r["v"]) for r in sample}:
        own = [r["v"] for r in sample if len(r["v"]) == n]
        x = np.array(own, dtype=np.float64).reshape(len(own), n)
        chosen[n] = choose_pivots(_augmented(x, largest[n]), pivots)
    path = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    vectors.where(is_query).write.parquet(path)

    def blocks() -> Iterator[tuple[np.ndarray, pa.Array]]:
        fs, root = pafs.FileSystem.from_uri(path)
        for entry in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda e: e.path):
            if not entry.path.endswith(".parquet"):
                continue
            with fs.open_input_file(entry.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=QUERY_BLOCK):
                    yield np.asarray(batch.column(0)), batch.column(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for n, rows in _matrices(np.asarray(batch.column(0)), batch.column(1)).items():
                held.setdefault(n, []).append(rows)
        tables = {n: Table(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), chosen.get(n, np.zeros((0, n + 1))), largest[n]) for n, rows in held.items()}
        if not tables:
            return
        for ids, v in blocks():
            out = []
            for n, (query_ids, q) in _matrices(ids, v).items():
                if n in tables:
                    out += tables[n].search(query_ids, q, k)
            if out:
                sizes = [len(o[1]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([o[0] for o in out]), sizes)), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                    names=["query_id", "vec_id", "score"],
                )

    found = vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
