"""Pushing events to clients from a stream, and callbacks: a sink for foreachBatch that delivers each micro-batch once.

What a micro-batch delivers is written to an outbox, a folder of its own named by the batch's number, which is marked as
whole last. A batch that is run again, as a restarted stream does, finds its mark and delivers nothing; one that broke off
before is written anew. Clients read the outbox; callbacks are told of each batch that was delivered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.operators.events import route

#: Called with the batch's number and what it delivers, once it is in the outbox.
Callback = Callable[[int, DataFrame], None]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Push:
    """A foreachBatch sink: events (event_id, event_type, ts, ...) to the subscribers of their type, at most `most` of a
    client in a batch, the newest ones. An event that repeats its id is sent once. A callback that raises leaves the batch
    unmarked, so it is delivered and told of again; what it does must bear that, by the batch's number."""

    def __init__(self, outbox: str, subscriptions: DataFrame, most: int = 1000, callbacks: Sequence[Callback] = ()) -> None:
        self.outbox, self.subscriptions, self.most, self.callbacks = outbox.rstrip("/"), subscriptions, most, list(callbacks)

    def on_delivery(self, callback: Callback) -> None:
        self.callbacks.append(callback)

    def path(self, batch: int) -> str:
        return f"{self.outbox}/batch={batch}"

    def delivered(self, spark: SparkSession, batch: int) -> bool:
        fs, _ = _fs(spark, self.outbox)
        return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(batch)}/_DELIVERED"))

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        if self.delivered(spark, batch):
            return
        nth = F.row_number().over(W.partitionBy("subscriber").orderBy(F.desc("ts"), F.desc("event_id")))
        rows = route(events.dropDuplicates(["event_id"]), self.subscriptions).withColumn("__n", nth).filter(F.col("__n") <= self.most).drop("__n")
        rows.write.mode("overwrite").parquet(self.path(batch))
        sent = spark.read.schema(rows.schema).parquet(self.path(batch))
        for callback in self.callbacks:
            callback(batch, sent)
        fs, mark = _fs(spark, f"{self.path(batch)}/_DELIVERED")
        fs.create(mark, True).close()


def inbox(spark: SparkSession, outbox: str, client: str | None = None) -> DataFrame:
    """What was delivered so far, with the number of its batch (of one client, if named). Only whole batches count."""
    fs, top = _fs(spark, outbox)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    batches = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and fs.exists(jvm(s.getPath(), "_DELIVERED"))]
    rows = spark.read.option("basePath", outbox).parquet(*[p.toString() for p in batches])
    return rows if client is None else rows.filter(F.col("subscriber") == client)
