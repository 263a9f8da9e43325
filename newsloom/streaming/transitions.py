"""Legal transitions of documents over a stream of log rows.

Each document has a small state: where it is, how often its fetch failed, since when it waits.
A log row that fits moves it; one that does not is a dead letter and changes nothing. A document
that waits longer than EXPIRY for its fetch has failed once more, and says so by itself: a timer
goes off when the watermark has passed, or the next row finds the time over, whichever comes
first, so the result does not depend on how rows come in batches.

Rows of a document have to come in the order of their time; ones that come late are dead letters.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsloom import fixed_values as fv
from newsloom.operators.state import KEY
from newsloom.streaming.runs import batch_path, run_name
from newsloom.streaming.states import ON_DISK, settings

EXPIRED = "EXPIRED"
START = ""
# From where a document may go to a state.
COMES_FROM = {
    fv.PENDING: [START, fv.FAILED, fv.RESCRAPE],
    fv.RETRIEVED: [fv.PENDING],
    fv.FAILED: [fv.PENDING],
    fv.PARSED: [fv.RETRIEVED, fv.RESCRAPE],
    fv.RESCRAPE: [fv.RETRIEVED, fv.PARSED],
}
RETRIES = 5
EXPIRY_DAYS = 7
LATENESS = "1 hour"
OUTPUT = "dataset STRING, doc_id INT, seq BIGINT, state STRING, was STRING, legal BOOLEAN, fails INT"
_STATE = "state STRING, fails INT, since BIGINT, since_seq BIGINT, last BIGINT"
_DAY = 86_400_000_000


class Transitions(StatefulProcessor):
    """One document: its state, and a timer while it waits."""

    def __init__(self, retries: int = RETRIES, expiry_days: float = EXPIRY_DAYS):
        self.retries, self.expiry = retries, int(expiry_days * _DAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("document", _STATE)

    def close(self) -> None:
        pass

    def _row(self, key, seq, state, was, legal, fails) -> Row:
        return Row(dataset=key[0], doc_id=key[1], seq=seq, state=state, was=was, legal=legal, fails=fails)

    def _timer(self, since: int) -> int:
        """When the wait is over, in whole milliseconds."""
        return -(-(since + self.expiry) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, fails, since, since_seq, last = self.kept.get() if self.kept.exists() else (START, 0, 0, 0, 0)
        waited = since if state == fv.PENDING else None
        for row in sorted(rows, key=lambda row: (row["moment"], row["seq"])):
            moment, seq, to = row["moment"], row["seq"], row["state"]
            if moment < last:
                yield self._row(key, seq, to, state, False, fails)
                continue
            last = moment
            if state == fv.PENDING and moment >= since + self.expiry:
                fails += 1
                yield self._row(key, since_seq, EXPIRED, state, True, fails)
                state = fv.FAILED
            legal = state in COMES_FROM.get(to, [])
            if to == fv.PENDING and state == fv.FAILED and fails >= self.retries:
                legal = False
            was = state
            if legal:
                state = to
                if to == fv.PENDING:
                    since, since_seq = moment, seq
                elif to == fv.FAILED:
                    fails += 1
                elif to == fv.RETRIEVED:
                    fails = 0
            yield self._row(key, seq, to, was, legal, fails)
        self.kept.update((state, fails, since, since_seq, last))
        waits = since if state == fv.PENDING else None
        if waits != waited:
            if waited is not None:
                self.handle.deleteTimer(self._timer(waited))
            if waits is not None:
                self.handle.registerTimer(self._timer(waits))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, fails, since, since_seq, last = self.kept.get()
        if state == fv.PENDING:
            self.kept.update((fv.FAILED, fails + 1, since, since_seq, last))
            yield self._row(key, since_seq, EXPIRED, state, True, fails + 1)


def follow_transitions(
    log: DataFrame,
    out: str,
    checkpoint: str,
    retries: int = RETRIES,
    expiry_days: float = EXPIRY_DAYS,
    partitions: int | None = None,
) -> StreamingQuery:
    """Judge every row of a log stream and stop at its end.

    Each batch writes its verdicts (OUTPUT) to a folder of its run and number; the state of all
    documents is on disk."""
    run = run_name(log.sparkSession, checkpoint)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(out, run, batch_id))

    wanted = dict(ON_DISK)
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    timed = log.select(
        *KEY, "seq", "state", F.col("event_time").cast("timestamp").alias("event_time")
    ).withColumn("moment", F.unix_micros("event_time"))
    judged = (
        timed.withWatermark("event_time", LATENESS)
        .groupBy(*KEY)
        .transformWithState(Transitions(retries, expiry_days), OUTPUT, "Update", "EventTime")
    )
    with settings(log.sparkSession, wanted):
        return (
            judged.writeStream.outputMode("update")
            .foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """All verdicts written so far."""
    return spark.read.schema(OUTPUT).option("basePath", out).parquet(out).select(
        "dataset", "doc_id", "seq", "state", "was", "legal", "fails"
    )


def illegal(verdicts: DataFrame) -> DataFrame:
    """The dead letters: rows that did not fit, with the reason."""
    reason = F.concat(F.lit("cannot go from '"), F.col("was"), F.lit("' to '"), F.col("state"), F.lit("'"))
    return verdicts.where(~F.col("legal")).select(
        *KEY, F.lit("transition").alias("step"), reason.alias("error")
    )
