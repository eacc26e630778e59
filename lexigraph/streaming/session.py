"""Streams of lines: analysis by micro-batch, with nodes that run on per session.

Distinct words, windows and joins of one batch need the whole batch, so the
stream is processed by ``foreachBatch``.  The only state is the next free node
of every session; it is written per batch, and a batch that is run again starts
from the state before it, so its output and state are the same again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigraph.config import Config, TokenNumbering
from lexigraph.operators.analyze import analyze
from lexigraph.operators.lexicon import Lexicon

STATE = "session string, next_node int"


class SessionStream:
    """Analyses rows ``session, seq, text``; results go to ``out``, one folder a batch."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon, out: str, config: Config = Config()):
        self.spark, self.lexicon, self.out = spark, lexicon, out.rstrip("/")
        self.config = replace(config, token_numbering=TokenNumbering.CONTINUOUS)

    def _state(self, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.out}/state/batch={batch_id}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("line", F.struct("session", "seq"))
        rows = analyze(lines, self.lexicon, self.config, id_col="line", session=["session"], order=["seq"])
        before = self._state(batch_id - 1)
        flat = rows.select("line.session", "line.seq", *[c for c in rows.columns if c not in ("line", "session", "seq")])
        placed = flat.join(before, "session", "left").withColumn("base", F.coalesce("next_node", F.lit(0))).drop("next_node")
        moved = placed.withColumn("start_node", F.col("start_node") + F.col("base")).withColumn("end_node", F.col("end_node") + F.col("base")).drop("base")
        path = f"{self.out}/rows/batch={batch_id}"
        moved.write.mode("overwrite").parquet(path)
        reached = self.spark.read.parquet(path).groupBy("session").agg(F.max("end_node").alias("next_node"))
        after = before.unionByName(reached).groupBy("session").agg(F.max("next_node").cast("int").alias("next_node"))
        after.write.mode("overwrite").parquet(f"{self.out}/state/batch={batch_id}")

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
