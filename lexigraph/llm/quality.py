"""Quality classifier: Bradley-Terry ranking of documents.

Every text becomes a short vector of surface statistics.  Preference pairs (a
labelled good document before a labelled bad one) are drawn from a bounded
sample of labelled rows; logistic loss on the difference of the two vectors
gives the weights of a latent score.  The cut lies at the quantile of the
sample's scores that equals the sample's share of bad documents, and scores are
squashed so that the cut falls on a stated probability.

Defined results: a null or empty text has the vector of an empty text and gets
a finite score; repeated texts get equal scores; with no usable pair (an empty
label table, or one class alone) all weights are 0 and every score is the cut
itself.  Label rows with a null document or label are ignored, and a document
with contradicting label rows counts with its smallest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexigraph.llm.common import free_name, pieces

#: Labelled rows that training may use; the sample is taken by hash order.
TRAIN_ROWS = 20_000
#: Preference pairs drawn from them, passes of the optimiser, and the ridge.
TRAIN_PAIRS = 200_000
TRAIN_STEPS = 300
RIDGE = 1e-3
CUT = 0.3

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digit", "symbol", "comma_stop", "other_ascii", "symbol_words",
    "repeat_1", "repeat_2", "repeat_3", "type_token", "top_word", "line_length", "line_repeat", "upper_words", "mark_run", "bang", "pipe",
)

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 4
for _c in b".,":
    _CLASS[_c] = 5
for _c in b"!?":
    _CLASS[_c] = 6
_CLASS[ord("|")] = 7
for _c in b"#$%&*@^~=+<>{}[]\\/_`":
    _CLASS[_c] = 8
_CLASS[128:] = 9


def vector(text: str | None) -> list[float]:
    """Surface statistics of one whole text; all zero for an empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    kind = np.bincount(_CLASS[raw], minlength=10)
    ink = max(1, len(raw) - int(kind[4]))
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    counts = np.bincount(ids)
    repeats = [float(np.mean(ids[k:] == ids[:-k])) if n > k else 0.0 for k in (1, 2, 3)]
    lengths = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    of_word = lengths[ids]
    uppers = np.fromiter((w.isupper() and len(w) > 1 for w in codes), dtype=np.int64, count=len(codes))
    marked = np.fromiter((not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in codes), dtype=np.int64, count=len(codes))
    lines = [x for x in text.split("\n") if x]
    symbols = int(kind[8])
    return [
        min(np.log1p(n), 8.0) / 8.0,
        min(float(of_word.mean()), 20.0) / 10.0,
        float(np.mean(of_word > 20)),
        kind[1] / ink,
        kind[3] / ink,
        symbols / ink,
        kind[5] / n,
        (ink - kind[1] - kind[2] - kind[9]) / ink,
        float((marked * counts).sum() / n),
        *repeats,
        len(codes) / n if n < 100 else len(codes) / (n**0.75 * 100**0.25),
        counts.max() / (n + 10.0),
        min(n / max(1, len(lines)), 200.0) / 200.0,
        1.0 - len(set(lines)) / max(1, len(lines)),
        float((uppers * counts).sum() / n),
        (kind[6] + symbols) / n,
        kind[6] / n,
        kind[7] / n,
    ]


def vectors(texts: list[str | None]) -> np.ndarray:
    return np.array([vector(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Model:
    """Weights over standardised features, and the map from latent score to probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float
    spread: float
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6.0, 6.0) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.latent(x) - self.at) / self.spread, -30.0, 30.0) + np.log(self.cut / (1.0 - self.cut))
        return 1.0 / (1.0 + np.exp(-z))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = TRAIN_PAIRS, steps: int = TRAIN_STEPS, ridge: float = RIDGE, cut: float = CUT, seed: int = 7) -> Model:
    """Bradley-Terry weights from feature differences of (good, bad) pairs."""
    width = x.shape[1]
    good = good.astype(bool)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(winners) or not len(losers):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, cut)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -6.0, 6.0)
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * len(winners) * len(losers))
    d = z[rng.choice(winners, n)] - z[rng.choice(losers, n)]
    w = np.zeros(width)
    first, second = np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        part = d[rng.integers(0, n, 8192)] if n > 8192 else d
        gradient = -(part / (1.0 + np.exp(np.clip(part @ w, -30, 30)))[:, None]).mean(axis=0) + ridge * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    latent = np.sort(z @ w)
    bad = len(losers)
    at = float((latent[bad - 1] + latent[bad]) / 2) if bad < len(latent) else float(latent[-1])
    spread = max(1e-6, float(np.std(d @ w)) / 2.0)
    return Model(mean, scale, w, at, spread, cut)


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out=None) -> DataFrame:
    """(text, quality) of the bounded sample; ``held_out`` is a condition on doc_id that excludes rows."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers: small enough to send to every task whatever the input
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out=None, cut: float = CUT) -> Model:
    """Fit on the bounded sample; only its feature vectors reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = vectors(batch.column(1).to_pylist())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2).cast(pa.int32())], names=["doc_id", "x", "quality"])

    sample = training_rows(documents, labels, rows, held_out)
    found = sample.mapInArrow(run, "doc_id bigint, x array<double>, quality int").toPandas()
    found = found.sort_values(["doc_id", "quality"], kind="stable").drop_duplicates("doc_id")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, found["quality"].to_numpy() > 0, cut=cut)


def score(documents: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """Add the score to every row, as the last column; an equally named column is dropped."""
    carried = [c for c in documents.columns if c.lower() != score_col.lower()]
    source = documents.select(*[F.col(f"`{c}`") for c in carried])
    at = carried.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = model.score(vectors(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*carried, score_col])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(score_col, DoubleType())]))


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """Documents whose score reaches the cut, with their own columns."""
    mark = free_name(documents, "quality_score")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return score(documents, model, mark).where(F.col(mark) >= model.cut).select(*columns)
