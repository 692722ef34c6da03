"""Edges kept up to date from a stream of payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge_edges
from ..operators.scan import Store


def edges_of(payments: DataFrame) -> DataFrame:
    """Edges of one batch of payments (block_num, a, b, value)."""
    return payments.where("a <> b and value > 0").groupBy("a", "b").agg(
        F.min("block_num").alias("reveal"), F.max("block_num").alias("last_seen"), F.count(F.lit(1)).alias("total"),
        F.min("value").alias("min_sent"), F.max("value").alias("max_sent"), F.sum("value").alias("total_sent"),
    )


def maintain_edges(payments: DataFrame, store: Store, checkpoint: str, name: str = "transaction_edges") -> StreamingQuery:
    """Merges each micro-batch into the table of edges, and stops when the source is read. The table carries the number of
    the last batch in it, written with the edges in one version, so a batch that is delivered again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        done, old = -1, None
        if store.exists(name):
            whole = store.read(name)
            old = whole.where("batch is null").drop("batch")
            done = whole.agg(F.max("batch")).first()[0]
        if number <= (-1 if done is None else done):
            return
        fresh = edges_of(batch)
        edges = merge_edges(old, fresh) if old is not None else fresh
        mark = batch.sparkSession.range(1).select(*(F.lit(None).cast("long").alias(c) for c in edges.columns), F.lit(number).cast("long").alias("batch"))
        store.write(name, edges.withColumn("batch", F.lit(None).cast("long")).unionByName(mark))

    return payments.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, value) by hour, in event time; later ones than late are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "n", "value")
