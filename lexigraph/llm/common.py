"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows of an Arrow batch that are worked on at a time; Spark bounds the bytes of a batch.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only on a single machine may that setting be absent; a temporary folder is then made
    for the life of the session.  On a cluster its absence is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Actions inside run with the setting, which is put back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Actions give their shuffle files back when they end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table_ in tables:
        jvm = table_.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table_.stored_at)
        path.getFileSystem(table_.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS, column: int | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows (without copies), which bounds what is worked out at a time.

    With a string or binary ``column`` a slice ends before its bytes exceed ``most``, unless it is one row.
    """
    for batch in batches:
        at, n = 0, batch.num_rows
        ends = None
        if column is not None and n:
            own = batch.column(column)
            ends = np.frombuffer(own.buffers()[1], dtype=np.int32)[own.offset : own.offset + n + 1]
        while at < n:
            stop = min(n, at + rows)
            if ends is not None:
                stop = min(stop, max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop


def crc_bucket(column: str, modulus: int):
    """crc32 of the decimal text of ``column``, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast(StringType())), F.lit(modulus))


def ascii_lower(column):
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def long_array(values: list[int]):
    """A constant array of longs, folded from one string literal: thousands of literals would slow the planner."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


#: log2 of the bits in a filter of ids.
FILTER_BITS = 18


def bit_filter(ids: DataFrame, column: str):
    """A test on a key column that is true for all ``ids`` and false for most others.

    The filter has a fixed size, whatever the number of ids: it spares work and
    shuffled rows, and decides nothing by itself.
    """
    bits = 1 << FILTER_BITS

    def spot(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    at = spot(F.col(column))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = [0] * (bits >> 6)
    for row in ids.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(one).alias("bits")).collect():
        words[int(row["w"])] = int(row["bits"])
    table = long_array(words)

    def test(c):
        at = spot(c)
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test
