"""Event logs as streams: duplicates dropped within a watermark, progress folded per job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.schemas import EVENT

PROGRESS = "job_id string, last_seq bigint, files_done int, current_file string, last_event string, n_events bigint"
_STATE = "last_seq bigint, files_done int, current_file string, last_event string, n_events bigint"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events from a folder of JSON files, one file a flush; a file is read once, so writers must not append to it."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The first event of each (job, seq) within the watermark; its state is dropped behind it."""
    stamped = events.withColumn("at", F.to_timestamp("ts"))
    return stamped.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["job_id", "seq"])


def _fold(state: tuple, rows: pd.DataFrame) -> tuple:
    last, done, name, event, n = state
    for r in rows.sort_values("seq").itertuples():
        n += 1
        if r.seq <= last:
            continue
        last, event = int(r.seq), r.event
        if r.event == "file_started":
            name = r.file_name
        elif r.event == "file_finished":
            done, name = max(done, 0 if pd.isna(r.file_index) else int(r.file_index)), None
        elif r.event == "job_finished":
            name = None
    return last, done, name, event, n


def progress(events: DataFrame, idle: str = "1 day") -> DataFrame:
    """Streaming fold of each job's events: files done, the current file, the last event.

    All of a job's events of one trigger are put in order before they are folded. A job whose
    newest event lies ``idle`` behind the watermark is forgotten; events need the watermark that
    ``deduplicated`` sets. Without one (``at`` missing) states are kept.
    """
    kept = int(pd.Timedelta(idle).total_seconds() * 1000)
    stamped = "at" in events.columns

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value = state.get if state.exists else (-1, 0, None, None, 0)
        rows = pd.concat(list(batches), ignore_index=True)
        value = _fold(value, rows)
        state.update(value)
        if stamped:
            newest = rows["at"].max()
            at = state.getCurrentWatermarkMs() if pd.isna(newest) else max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(at + kept)
        yield pd.DataFrame([(key[0], *value)], columns=["job_id", "last_seq", "files_done", "current_file", "last_event", "n_events"])

    timeout = GroupStateTimeout.EventTimeTimeout if stamped else GroupStateTimeout.NoTimeout
    return events.groupBy("job_id").applyInPandasWithState(update, PROGRESS, _STATE, "update", timeout)


def batch_progress(events: DataFrame) -> DataFrame:
    """The same fold over a complete table by aggregates."""
    entry = lambda c: F.when(c, F.col("seq"))
    started, ended = F.col("event") == "file_started", F.col("event").isin("file_finished", "job_finished")
    g = events.groupBy("job_id").agg(
        F.max("seq").alias("last_seq"), F.coalesce(F.max(F.when(F.col("event") == "file_finished", F.col("file_index"))), F.lit(0)).alias("files_done"),
        F.max_by(F.when(started, F.col("file_name")), entry(started)).alias("_name"), F.max(entry(started)).alias("_s"), F.max(entry(ended)).alias("_e"),
        F.max_by("event", "seq").alias("last_event"), F.count("*").alias("n_events"),
    )
    current = F.when(F.col("_s") > F.coalesce("_e", F.lit(-1)), F.col("_name"))
    return g.select("job_id", "last_seq", "files_done", current.alias("current_file"), "last_event", "n_events")


def event_lines(events: DataFrame, limit: int = 12) -> DataFrame:
    """(job_id, seq, line): the last ``limit`` events of each job as readable lines; the limit is the feature."""
    e = F.col("event")
    line = (
        F.when(e == "file_started", F.concat(F.lit("File "), F.col("file_index").cast("string"), F.lit(": "), F.coalesce("file_name", F.lit(""))))
        .when(e == "chunk_started", F.concat(F.coalesce("file_name", F.lit("")), F.lit(": chunk "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?"))))
        .when(e == "file_finished", F.concat(F.coalesce("file_name", F.lit("")), F.lit(": "), F.coalesce("status", F.lit("completed"))))
        .when(e == "job_cancelled", F.lit("Cancelled by operator"))
    )
    shown = events.select("job_id", "seq", line.alias("line")).where("line is not null")
    last = shown.groupBy("job_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("seq", "line")), asc=False), 1, limit).alias("l"))
    return last.select("job_id", F.inline("l"))


def guarded(consume: Callable[[DataFrame, int], None], report: Callable[[Exception], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body whose failure is reported and does not stop the stream."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            consume(batch, number)
        except Exception as error:  # noqa: BLE001 - consumers may fail in any way
            report(error)

    return run
