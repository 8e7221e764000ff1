"""File events as a stream: what was seen last of each path, kept up to date batch by batch.

tracked() keeps a state for each path: what the last listing said, and the latest event, by its own time and not by when
it came. So events may come in any order and in any batches, and the changes at the end are those that the batch operators find.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codeloom.operators import incremental

EVENTS = "rel_path string, mtime double, size long, event_time timestamp, deleted boolean"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON files with file events."""
    return spark.readStream.schema(EVENTS).json(folder)


def latest_events(batch: DataFrame) -> DataFrame:
    """The last event of each path in a batch."""
    last = F.max_by(F.struct("mtime", "size", "deleted"), "event_time")
    return batch.groupBy("rel_path").agg(last.alias("r")).select("rel_path", "r.*")


def applied(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files after a batch, and the changes that it made."""
    last = latest_events(batch)
    now = state.join(last.select("rel_path"), "rel_path", "left_anti").unionByName(last.where("not coalesce(deleted, false)").drop("deleted"))
    return now, incremental.changes(now, state)


def follow(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands over all events that are there, once each, and stops."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by time window; later ones than the watermark allows are left out."""
    return stream.withWatermark("event_time", late).groupBy(F.window("event_time", width)).agg(F.count("*").alias("n"), F.count_if(F.coalesce("deleted", F.lit(False))).alias("deleted"))


#: Of each path: the number of events and the latest one (its time in microseconds, and its number among those of one time), and
#: what a listing before all events had.
STATE = "n long, at long, seq long, mtime double, size long, deleted boolean, known boolean, known_mtime double, known_size long"
CHANGES = "rel_path string, n long, change string, mtime double, size long, event_time timestamp"
#: Days after which a path that was deleted, and isn't in the listing before, is forgotten.
KEPT_DAYS = 30


class Tracker(StatefulProcessor):
    """The change of a path after each batch with events of it: new, modified, unchanged or deleted, against the listing before;
    gone: neither there before nor now. expired: a path that has been gone for long, of which no state is kept any more.

    The state is one row for each path, so it grows with the paths and not with the events, and expiry frees it.
    """

    def __init__(self, kept_days: float = KEPT_DAYS):
        self.kept = int(kept_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("file", STATE)

    def handleInitialState(self, key: tuple, row: Row, timerValues) -> None:
        self.state.update((0, None, None, None, None, None, True, row["mtime"], row["size"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each use of the state or of a timer is a call to another process, so none is made in vain
        n, at, seq, mtime, size, deleted, known, known_mtime, known_size = self.state.get() or (0, None, None, None, None, None, False, None, None)
        timer = at // 1000 + self.kept if deleted and not known else None
        for row in rows:
            n += 1
            when = round(row["event_time"].timestamp() * 1_000_000)
            if at is None or (when, row["seq"]) > (at, seq):  # else it came late, and a newer one counts
                at, seq, mtime, size, deleted = when, row["seq"], row["mtime"], row["size"], bool(row["deleted"])
        self.state.update((n, at, seq, mtime, size, deleted, known, known_mtime, known_size))
        due = at // 1000 + self.kept if deleted and not known else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        same = (mtime, size) == (known_mtime, known_size)
        change = ("deleted" if known else "gone") if deleted else "new" if not known else "unchanged" if same else "modified"
        yield Row(rel_path=key[0], n=n, change=change, mtime=None if deleted else mtime, size=None if deleted else size, event_time=_time(at))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, at = self.state.get()[:2]
        self.state.clear()
        yield Row(rel_path=key[0], n=n, change="expired", mtime=None, size=None, event_time=_time(at))

    def close(self) -> None:
        pass


def _time(micros: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=micros)


def tracked(stream: DataFrame, previous: DataFrame, late: str = "1 hour", kept_days: float = KEPT_DAYS) -> DataFrame:
    """rel_path, n, change, mtime, size, event_time: a row for each path that a batch has events of; the one with the highest n is
    the latest, an expired one after that.

    stream: EVENTS with seq, which tells events of one time apart. previous: rel_path, mtime, size of a listing before all
    events, once for each path. Events that come later than late after the newest are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = stream.where("rel_path is not null and event_time is not null").withWatermark("event_time", late)
    return timed.groupBy("rel_path").transformWithState(Tracker(kept_days), CHANGES, "update", "EventTime", initialState=previous.select("rel_path", "mtime", "size").groupBy("rel_path"))


def kept(changes: DataFrame, checkpoint: str, folder: str) -> StreamingQuery:
    """Writes each batch of changes to a folder of its own, over what an attempt before may have left there, until all events that
    are there are done."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of each path in what kept() has written; expired paths aren't there."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(folder)
    last = rows.groupBy("rel_path").agg(F.max_by(F.struct("n", "change", "mtime", "size", "event_time"), F.struct("n", F.col("change") == "expired", "batch")).alias("r"))
    return last.select("rel_path", "r.*").where("change <> 'expired'")
