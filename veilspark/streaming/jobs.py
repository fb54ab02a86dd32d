"""Files and audit rows as they come: the batch plans over Structured Streaming."""

from __future__ import annotations

import collections
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from veilspark.functions.text import decoded
from veilspark.plans.engines import PROFILES


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder, one per trigger by default, as a queue would take them."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"), decoded("content").alias("text"))


def sanitize_stream(docs: DataFrame, sink: str, checkpoint: str, mode: str = "redact", profile: str = "gated", on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Masked texts and their summaries, appended to Parquet under `sink`; stops when what is there has been done.

    A batch is written to a folder of its own number, so a batch that is run again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        PROFILES[profile](batch, mode=mode).drop("spans").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """The states of queries as they go, in order, as rows of a table: started, each batch with its numbers, idle, ended or failed.

    Only numbers of batches come here, never their rows, and `most` rows of them are kept.
    """

    SCHEMA = "name string, run string, state string, batch long, rows long, rows_per_second double, late long, error string"

    def __init__(self, spark: SparkSession, most: int = 10_000) -> None:
        super().__init__()
        self.spark, self.rows, self.names = spark, collections.deque(maxlen=most), {}
        spark.streams.addListener(self)

    def _put(self, run, state: str, batch: int | None = None, rows: int | None = None, speed: float | None = None, late: int | None = None, error: str | None = None) -> None:
        self.rows.append((self.names.get(str(run)), str(run), state, batch, rows, speed, late, error))

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._put(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self._put(p.runId, "running", p.batchId, p.numInputRows, p.processedRowsPerSecond, late)

    def onQueryIdle(self, event) -> None:
        self._put(event.runId, "idle")

    def onQueryTerminated(self, event) -> None:
        self._put(event.runId, "failed" if event.exception else "ended", error=event.exception)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows), self.SCHEMA)

    def stop(self) -> None:
        self.spark.streams.removeListener(self)


def first_seen(events: DataFrame, key: str = "signature", at: str = "at", late: str = "30 seconds") -> DataFrame:
    """Events without those whose key has come within the time that a late one may take: a signature that is sent again is left out.

    State is kept for that time only, so it is bounded by the events of it.
    """
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fresh(events: DataFrame, at: str = "at", sent: str = "sent", old: int = 30, early: int = 5) -> DataFrame:
    """Events that are neither too old nor from the future."""
    age = F.col(at).cast("double") - F.col(sent).cast("double")
    return events.withWatermark(at, f"{old} seconds").where((age <= old) & (age >= -early))


def audit_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Audit rows by action and tumbling window."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def append_audit(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
