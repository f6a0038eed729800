"""Structured Streaming: dumps that arrive as files, and orphan references kept up to date as they do."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.common import shared_dir
from folioscope.operators import orphans
from folioscope.sources.readers import parse_tagged


def tagged_stream(spark: SparkSession, path: str) -> DataFrame:
    """Tagged text files as they come, parsed into records."""
    return parse_tagged(spark.readStream.option("lineSep", "\n\n").text(path))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has come so far, exactly once, as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of time; those later than ``late`` behind the newest are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")


class OrphanStream:
    """Keeps the state of orphan references over micro-batches. A batch holds references and arrivals of parents in one
    table: (kind 'ref' or 'parent', src_field, paper_id, ref_key, at, deleted_at).

    State and events are tables under ``home`` in the shared folder, one set a batch, and a mark is left once a batch is
    whole. A stream that is started again goes on from the last mark; a batch that comes again is left alone if it was
    whole, and else overwritten. References seen are added to, not rewritten."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = spark
        self.home = home or f"{shared_dir(spark)}/orphans-{uuid.uuid4().hex}"
        self.batch, self.last = -1, None
        self.state = orphans.empty_state(spark)
        done = self._read("done", "batch long, last string")
        row = None if done is None else done.orderBy(F.desc("batch")).first()
        if row is not None:
            self.batch, self.last = row.batch, row.last
            self.state = self._state()

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")
        except AnalysisException:  # nothing was written yet
            return None

    def _state(self) -> orphans.State:
        at = f"{self.home}/state/{self.batch}"
        seen = self._read("seen", orphans.REFS + ", batch long").filter(F.col("batch") <= self.batch).drop("batch")
        return orphans.State(self.spark.read.parquet(f"{at}/parents"), seen, self.spark.read.parquet(f"{at}/pending"))

    @property
    def events(self) -> DataFrame | None:
        """All transitions of whole batches."""
        e = self._read("events", orphans.REFS + ", event string, at timestamp, batch long")
        return None if e is None else e.filter(F.col("batch") <= self.batch).drop("batch")

    def process(self, batch: DataFrame, batch_id: int | None = None) -> None:
        k = self.batch + 1 if batch_id is None else batch_id
        if k <= self.batch:
            return
        end = batch.agg(F.max(F.unix_micros("at"))).first()[0]
        if end is None:
            return
        refs = batch.filter("kind = 'ref'").select("src_field", "paper_id", "ref_key", F.col("at").alias("came_at"))
        arrivals = batch.filter("kind = 'parent'").select("src_field", "ref_key", F.col("at").alias("first_at"), "deleted_at")
        # bounds are written in UTC, whatever the session's time zone
        upto = datetime.fromtimestamp((end + 1) / 1e6, UTC).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")
        state, events = orphans.step(self.state, refs, arrivals, self.last, upto)
        events.write.mode("overwrite").parquet(f"{self.home}/events/batch={k}")
        state.added.write.mode("overwrite").parquet(f"{self.home}/seen/batch={k}")
        state.parents.write.mode("overwrite").parquet(f"{self.home}/state/{k}/parents")
        state.pending.write.mode("overwrite").parquet(f"{self.home}/state/{k}/pending")
        self.spark.createDataFrame([(k, upto)], "batch long, last string").write.mode("append").parquet(f"{self.home}/done")
        self.batch, self.last = k, upto
        self.state = self._state()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
