"""The scoring stream: decode, enrich, fan out, score, alert."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strayrow.functions.expressions import message_value
from strayrow.operators.alerts import ALERTS_PER_BATCH, anomalies, first_alerts
from strayrow.operators.features import assemble
from strayrow.operators.forest import score
from strayrow.operators.records import enrich
from strayrow.sources.committed import CommittedSink, run_id
from strayrow.sources.filesystem import NumberedLines
from strayrow.sources.parsing import mark_json, split_marked
from strayrow.sources.schema import connection_features, connection_schema, message_schema
from strayrow.streaming.sinks import send_messages

INTERVAL_SEC = 15.0
#: Folder below the checkpoint with the number of batches done and the last one's id.
PROGRESS = "batches-done"
LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class ScoringOptions:
    """What one scoring stream reads and writes; an output left at None is off.

    Streams with different checkpoints may share the folders. ``landed_path`` takes the enriched records
    in the layout a trainer scans, ``date=/site=``, by the date they arrive and ``site``.
    """

    checkpoint: str
    schema: T.StructType = field(default_factory=lambda: message_schema(connection_schema()))
    features: Sequence[str] = field(default_factory=connection_features)
    total_of: Sequence[str] = ("src_bytes", "dst_bytes")
    order: Sequence[str] = ("sequence_id",)
    enriched_path: str | None = None
    landed_path: str | None = None
    site: str = "site1"
    enriched_topic: dict[str, str] | None = None
    alert_path: str | None = None
    alert_topic: dict[str, str] | None = None
    quarantine_path: str | None = None
    report_path: str | None = None
    alerts_per_batch: int = ALERTS_PER_BATCH
    vote: str = "soft"
    handle_invalid: str = "keep"
    interval_sec: float = INTERVAL_SEC
    available_now: bool = False
    max_batches: int = 0


class BatchReport(NamedTuple):
    """What a scored batch held."""

    batch: int
    rows: int
    anomalies: int


class _EnoughBatches(Exception):
    """Ends the stream before a batch beyond the limit, which then stays uncommitted."""


class BatchScorer:
    """The work done on every micro-batch of messages.

    How many batches are done, and which was the last, is kept beside the checkpoint: the limit
    counts over restarts, a batch run again counts once, and no list of batches grows on the driver.
    """

    def __init__(
        self, options: ScoringOptions, model: RandomForestClassificationModel | None = None
    ) -> None:
        self.options = options
        # A copy holds no training summary, whose session could not be sent to tasks once rows are observed.
        self.model = None if model is None else model.copy()
        self.report: BatchReport | None = None
        self.done_here = 0
        self._run: str | None = None
        self._progress = (0, -1)
        self._known = False

    def progress(self, spark: SparkSession) -> tuple[int, int]:
        """(batches done with this checkpoint, id of the last one)."""
        if not self._known:
            _, line = NumberedLines(spark, f"{self.options.checkpoint}/{PROGRESS}").latest()
            done, last = (line or "0 -1").split()
            self._progress, self._known = (int(done), int(last)), True
        return self._progress

    def _finished(self, spark: SparkSession, batch_id: int) -> None:
        done, last = self.progress(spark)
        if batch_id <= last:
            return
        lines = NumberedLines(spark, f"{self.options.checkpoint}/{PROGRESS}")
        number, _ = lines.latest()
        lines.follow(number, f"{done + 1} {batch_id}")
        lines.forget_before(number + 1)
        self._progress = done + 1, batch_id
        self.done_here += 1

    def enough(self) -> bool:
        return 0 < self.options.max_batches <= self._progress[0]

    def _write(self, df: DataFrame, path: str, batch_id: int, by: Sequence[str] = ("batch",)) -> None:
        spark = df.sparkSession
        if self._run is None:
            self._run = run_id(spark, self.options.checkpoint)
        CommittedSink(spark, path, self._run, by).write(df, batch_id)

    def __call__(self, messages: DataFrame, batch_id: int) -> None:
        if messages.isEmpty():
            return
        spark = messages.sparkSession
        if batch_id > self.progress(spark)[1] and self.enough():
            raise _EnoughBatches(f"{self.options.max_batches} batches done")
        self.process(messages, batch_id)
        self._finished(spark, batch_id)

    def process(self, messages: DataFrame, batch_id: int) -> None:
        opts = self.options
        texts = messages.select(message_value().alias("value"))
        decoded = mark_json(texts, opts.schema).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows, quarantine = split_marked(decoded, "malformed message", "stream")
            enriched = enrich(rows, opts.total_of)
            if opts.quarantine_path:
                self._write(quarantine, opts.quarantine_path, batch_id)
            if opts.enriched_path:
                self._write(enriched, opts.enriched_path, batch_id)
            if opts.landed_path:
                arrived = {"date": F.current_date(), "site": F.lit(opts.site)}
                self._write(enriched.withColumns(arrived), opts.landed_path, batch_id, ("date", "site"))
            if opts.enriched_topic:
                send_messages(enriched, opts.enriched_topic)
            if self.model is not None:
                self.alert(enriched, batch_id)
        finally:
            decoded.unpersist()

    def alert(self, enriched: DataFrame, batch_id: int) -> None:
        """Score a batch, write its first alerts, and report its counts, all in one pass over the rows."""
        opts = self.options
        vectors = assemble(enriched, opts.features, handle_invalid=opts.handle_invalid)
        seen, found = Observation(), Observation()
        scored = score(vectors, self.model, opts.vote).observe(seen, F.count(F.lit(1)).alias("rows"))
        flagged = anomalies(scored).observe(found, F.count(F.lit(1)).alias("anomalies"))
        found_first = first_alerts(flagged, opts.order, opts.alerts_per_batch)
        # At most alerts_per_batch rows: the one pass over the batch that also counts it.
        alerts = enriched.sparkSession.createDataFrame(found_first.collect(), found_first.schema)
        self.report = BatchReport(batch_id, seen.get["rows"], found.get["anomalies"])
        LOG.info("batch %d: %d rows, %d anomalies", *self.report)
        if opts.alert_path:
            self._write(alerts, opts.alert_path, batch_id)
        if opts.alert_topic:
            send_messages(alerts, opts.alert_topic)
        if opts.report_path:
            counts = enriched.sparkSession.createDataFrame([self.report[1:]], "rows long, anomalies long")
            self._write(counts, opts.report_path, batch_id)


def score_stream(
    messages: DataFrame,
    options: ScoringOptions,
    model: RandomForestClassificationModel | None = None,
) -> tuple[StreamingQuery, BatchScorer]:
    """Start scoring a stream of messages (a ``value`` column of JSON text)."""
    scorer = BatchScorer(options, model)
    scorer.progress(messages.sparkSession)
    writer = messages.writeStream.foreachBatch(scorer).option(
        "checkpointLocation", options.checkpoint
    )
    if options.available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{options.interval_sec} seconds")
    return writer.start(), scorer


def await_stream(query: StreamingQuery, scorer: BatchScorer, poll_sec: float = 1.0) -> int:
    """Wait until the stream ends or its batch limit is reached; gives the batches done since it was started."""
    try:
        while not query.awaitTermination(poll_sec):
            if scorer.enough():
                query.stop()
    except StreamingQueryException as failure:
        if not (scorer.enough() and _EnoughBatches.__name__ in str(failure)):
            raise
    return scorer.done_here
