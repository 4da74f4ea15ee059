"""The pipeline as streams.

Exchanges arrive as a stream; each micro-batch reads the routing table anew,
so a consent that was withdrawn stops the write, and a table that can't be
read lets nothing pass.
"""

from __future__ import annotations

import itertools
import json
import logging
import operator
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..functions import policy
from ..operators import assembly, delivery, envelope, verdict
from ..sources import records
from ..sources.delivery_log import DeliveryLog
from ..sources.numbered import Files

ROUTES = "token string, project_id_hash string, root_path string, upstream string, granted_at string, revoked_at string"


#: How often a table of routes that is there is tried, and the seconds between.
TRIES, BETWEEN = 3, 0.5


def fresh_routes(spark: SparkSession, path: str) -> DataFrame:
    """The routes as they are now; none if there are none, or if they can't be read after some tries (which is logged, as what comes meanwhile is not recorded)."""
    for i in range(TRIES):
        try:
            if not Files(spark, path).exists():
                break
            routes = spark.read.schema(ROUTES).json(path)
            routes.limit(1).collect()
            return routes
        except Exception:  # noqa: BLE001  fail closed
            logging.getLogger(__name__).warning("routes can't be read (%d of %d)", i + 1, TRIES, exc_info=True)
            time.sleep(BETWEEN)
    return spark.createDataFrame([], ROUTES)


def record_stream(exchanges: DataFrame, routes_path: str, store_path: str, checkpoint: str, client_version: str, paused_reason: Callable[[], str] = lambda: "", trigger: dict | None = None) -> DataStreamWriter:
    """A writer that adds recordable exchanges to a Parquet store.

    Each micro-batch has a folder of its own, which a repeated batch overwrites
    as a whole: what a consent that was withdrawn in between kept out is gone.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        kept = verdict.recordable(batch, fresh_routes(batch.sparkSession, routes_path), paused_reason())
        records.write_records(envelope.records(kept, client_version), store_path, epoch)

    return exchanges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"}))


def flush_stream(ticks: DataFrame, spool: delivery.Spool, log: DeliveryLog, sink: delivery.Sink, clock: Callable[[], float], checkpoint: str, client_version: str, trigger: dict | None = None, **options) -> DataStreamWriter:
    """On each tick, flush the store if it is due; the log has the state before each attempt and after each answer."""

    def run(batch: DataFrame, epoch: int) -> None:
        out = delivery.flush(spool, state := log.load(), sink, clock(), client_version=client_version, save=log.save, **options)
        if out.state != state:
            log.save(out.state)

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"}))


class ExitFlush(StreamingQueryListener):
    """When the stream that it watches ends, for whatever reason, one last flush follows within its budget, and the log is closed."""

    def __init__(self, spool: delivery.Spool, log: DeliveryLog, sink: delivery.Sink, clock: Callable[[], float], client_version: str, budget: float = policy.EXIT_BUDGET_SECONDS):
        self.parts, self.clock, self.options = (spool, log, sink), clock, {"client_version": client_version, "budget": budget}
        self.watched: str | None = None
        self.done = threading.Event()
        self.reply: delivery.Flush | None = None

    def watch(self, spark: SparkSession, query: StreamingQuery) -> StreamingQuery:
        self.watched = str(query.id)
        spark.streams.addListener(self)
        return query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) != self.watched or self.done.is_set():
            return
        spool, log, sink = self.parts
        try:
            self.reply = delivery.close(spool, log.load(), sink, self.clock(), save=log.save, **self.options)
        finally:
            self.done.set()


#: How long an exchange may be silent before it is given up, and how long an ended one is remembered.
SILENCE_MS, REMEMBERED_MS = 3_600_000, 600_000
ASSEMBLED = "exchange_id string, message string, error string"
#: Rows that a task gives out at once.
GIVEN_AT_ONCE = 1000


def message_of(events: Iterable[tuple[str, str]]) -> tuple[str | None, str | None]:
    """The message that events in order make, or the rule that they break."""
    message = assembly.Message()
    try:
        for name, data in events:
            assembly.apply(message, name, data)
        return assembly.finish(message), None
    except assembly.StreamError as e:
        return None, str(e)


def assemble_events(events: DataFrame, silence_ms: int = SILENCE_MS, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """Streamed single events (exchange_id, seq from 0, name, data) to exchange_id, message and error.

    Events are applied in the order of seq, whatever micro-batch brings them:
    those behind a gap wait until it closes, and what comes twice is taken
    once.  The message so far and the waiting events are kept, no others.  An
    exchange gives one row: its message at the stop event, or the rule that it
    broke.  What still comes for it is passed over, as a row that was given out
    can't be taken back; it is remembered for ``remembered_ms`` of silence.
    Exchanges that never stop, or of which events are missing, are given up
    after ``silence_ms``.
    """
    state = "due long, waiting string, built string, ended boolean"

    def step(key: tuple, parts: Iterator[pd.DataFrame], memory) -> Iterator[pd.DataFrame]:
        due, waiting, built, ended = memory.get if memory.exists else (0, "[]", None, False)
        behind = {seq: (name, data) for seq, name, data in json.loads(waiting)}
        if memory.hasTimedOut:
            memory.remove()
            if not ended:
                yield pd.DataFrame([(key[0], None, "missing events" if behind else "no stop")], columns=["exchange_id", "message", "error"])
            return
        if not ended:
            behind |= {int(e.seq): (e.name, e.data) for part in parts for e in part[["seq", "name", "data"]].itertuples(index=False) if e.seq >= due}
            message, text, error = assembly.Message.restored(built), None, None
            try:
                while due in behind and not message.stopped:
                    assembly.apply(message, *behind.pop(due))
                    due += 1
                text = assembly.finish(message) if message.stopped else None
            except assembly.StreamError as e:
                error = str(e)
            ended = error is not None or message.stopped
            if ended:
                yield pd.DataFrame([(key[0], text, error)], columns=["exchange_id", "message", "error"])
            built = None if ended else message.stored()
        left = [] if ended else [(seq, *event) for seq, event in sorted(behind.items())]
        memory.update((due, json.dumps(left), built, ended))
        memory.setTimeoutDuration(remembered_ms if ended else silence_ms)

    return events.groupBy("exchange_id").applyInPandasWithState(step, ASSEMBLED, state, "append", "ProcessingTimeTimeout")


def assemble_whole(events: DataFrame) -> DataFrame:
    """``assemble_events`` for events that are all there: a row per exchange, at once.

    Tasks take events in order and hold one exchange's message, however many
    exchanges they have.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("exchange_id", "name", "data")), strict=True))
        done = ((key, *message_of((name, data) for _, name, data in group)) for key, group in itertools.groupby(rows, key=operator.itemgetter(0)))
        while some := list(itertools.islice(done, GIVEN_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=["exchange_id", "message", "error"])

    return events.repartition("exchange_id").sortWithinPartitions("exchange_id", "seq").select("exchange_id", "name", "data").mapInArrow(whole, ASSEMBLED)
