"""Run tracking with state and timers of its own, in event time.

Each processor keeps a few small values per run and sets a timer for the moment from which
they are of no more use, so state goes away again. Results depend on the times in the rows
only, not on how rows were dealt to micro-batches: a decision is taken when the watermark
has passed, after which no earlier row can come.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from labelloom.functions import constants as C
from labelloom.operators.series import in_utc, utc_clock
from labelloom.sources.session import ship_package

WATERMARK = "10 minutes"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
DAY = 24 * 3600


def use_disk_store(spark: SparkSession) -> None:
    """State of many runs lives on disk; processors need this store."""
    if "RocksDB" not in (spark.conf.get(STORE_CONF, None) or ""):
        spark.conf.set(STORE_CONF, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(rows: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Rows with ``ts`` as a moment, its watermark, and ``at`` in microseconds."""
    zoneless = rows.schema[ts].dataType.typeName() == "timestamp_ntz"
    moment = in_utc(F.col(ts)) if zoneless else F.col(ts).cast("timestamp")
    timed = rows.withColumn(ts, moment).withWatermark(ts, watermark)
    # Filters that don't name the time would be moved below the watermark, which is to see all
    # rows; so those that follow say "or the time is null", which no row is any more.
    return timed.filter(F.col(ts).isNotNull()).withColumn("at", F.unix_micros(ts))


def _named(*columns: str) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known | F.col("ts").isNull()


def _moment(micros: str) -> Column:
    return utc_clock(F.timestamp_micros(micros))


def _until(micros: int) -> int:
    """Milliseconds of a timer that is due once a moment has passed."""
    return -(-micros // 1000)


class _OneTimer(StatefulProcessor):
    """A processor with at most one timer per run."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open_state(handle)

    def open_state(self, handle) -> None:
        raise NotImplementedError

    def wake_at(self, due: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old == due:
                due = None
            else:
                self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class FirstEnd(_OneTimer):
    """The first terminal state of a run in event time; later rows never revive the run.

    The earliest end seen waits until the watermark has passed it, then it is sent out and
    forgotten. Only a mark stays, for ``keep`` seconds, that the run has ended.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep * 1_000_000

    def open_state(self, handle) -> None:
        self.first = handle.getValueState("first", "at bigint, seq bigint, state string")
        self.ended = handle.getValueState("ended", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.ended.exists():
            best = min((r.at, r.seq, r.state) for r in rows)
            if self.first.exists():
                best = min(best, tuple(self.first.get()))
            self.first.update(best)
            self.wake_at(_until(best[0]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.first.exists():
            at, seq, state = self.first.get()
            self.first.clear()
            self.ended.update((at,))
            self.wake_at(_until(at + self.keep))
            yield Row(run_id=key[0], at=at, seq=seq, state=state)
        else:
            self.ended.clear()
            self.wake_at(None)


class LostRun(_OneTimer):
    """Beats after which a run fell silent for longer than its stage allows.

    Kept are the beats that the watermark has not passed and the last one before them. Its
    timer fires without any further beat of the run.
    """

    def __init__(self, limits: dict[str, int], other: int) -> None:
        self.limits = {stage: s * 1_000_000 for stage, s in limits.items()}
        self.other = other * 1_000_000

    def open_state(self, handle) -> None:
        self.beats = handle.getListState("beats", "at bigint, seq bigint, stage string, ended boolean")

    def deadline(self, beat: tuple) -> int:
        return beat[0] + self.limits.get(beat[2], self.other)

    def decide(self, key, beats: list[tuple], passed: int) -> Iterator[Row]:
        beats.sort(key=lambda b: b[:2])
        done = 0
        for n, beat in enumerate(beats):
            if beat[0] > passed:
                break
            if not beat[3]:
                due = self.deadline(beat)
                if n + 1 == len(beats) or beats[n + 1][0] > due:
                    if due > passed:
                        break
                    yield Row(run_id=key[0], at=beat[0], stage=beat[2], due=due)
            done = n + 1
        left = beats[done:]
        if left:
            self.beats.put(left)
            head = left[0]
            self.wake_at(_until(head[0] if head[0] > passed else self.deadline(head)))
        else:
            self.beats.clear()
            self.wake_at(None)

    def _held(self) -> list[tuple]:
        return [tuple(b) for b in self.beats.get()] if self.beats.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        beats = self._held() + [(r.at, r.seq, r.stage, r.ended) for r in rows]
        return self.decide(key, beats, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.decide(key, self._held(), timerValues.getCurrentWatermarkInMs() * 1000)


class Newest(_OneTimer):
    """The newest progress of a run, sent out when it changes and forgotten after ``keep`` seconds without any."""

    def __init__(self, keep: int) -> None:
        self.keep = keep * 1_000_000

    def open_state(self, handle) -> None:
        self.newest = handle.getValueState("newest", "at bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r.at, r.event_id))
        known = tuple(self.newest.get()) if self.newest.exists() else None
        if known is None or (best.at, best.event_id) > known:
            self.newest.update((best.at, best.event_id))
            self.wake_at(_until(best.at + self.keep))
            yield Row(run_id=key[0], at=best.at, event_id=best.event_id, fraction=best.fraction, detail=best.detail)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        self.wake_at(None)
        return iter([])


def _tracked(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    ship_package(rows.sparkSession)
    use_disk_store(rows.sparkSession)
    return rows.groupBy("run_id").transformWithState(processor, schema, outputMode="Append", timeMode="EventTime")


def first_ends(states: DataFrame, keep: int = DAY, watermark: str = WATERMARK) -> DataFrame:
    """run_id, ts, seq and state of the first terminal state of each run, once it is certain.

    Rows without a time, run or seq take no part. A run that reports an end again more than
    ``keep`` seconds after its first one, when its mark is gone, counts as a new run.
    """
    ended = F.col("state").isin(C.TERMINAL_STATES) | F.col("ts").isNull()
    ends = _timed(states, "ts", watermark).filter(_named("run_id", "seq")).filter(ended)
    kind = states.schema["run_id"].dataType.simpleString()
    out = _tracked(ends.select("run_id", "ts", "at", "seq", "state"), FirstEnd(keep), f"run_id {kind}, at bigint, seq bigint, state string")
    return out.select("run_id", _moment("at").alias("ts"), "seq", "state")


def lost_runs(
    beats: DataFrame,
    limits: dict[str, int] = C.STAGE_TIMEOUTS,
    other: int = C.OTHER_TIMEOUT,
    watermark: str = WATERMARK,
) -> DataFrame:
    """run_id, last_seen, stage and lost_at for each silence longer than the stage of its last beat allows.

    ``limits`` are seconds per stage, ``other`` those of any other stage. A beat just at the
    limit is in time, and nothing is lost after a terminal state. Rows without a time, run or
    seq take no part. Rows of one run that one micro-batch brings are held together: bound
    the batches of a backfill.
    """
    kind = beats.schema["run_id"].dataType.simpleString()
    rows = _timed(beats, "ts", watermark).filter(_named("run_id", "seq"))
    ended = F.coalesce(F.col("state").isin(C.TERMINAL_STATES), F.lit(False)).alias("ended")
    out = _tracked(rows.select("run_id", "ts", "at", "seq", "stage", ended), LostRun(limits, other), f"run_id {kind}, at bigint, stage string, due bigint")
    return out.select("run_id", _moment("at").alias("last_seen"), "stage", _moment("due").alias("lost_at"))


def newest_progress(progress: DataFrame, keep: int = DAY, watermark: str = WATERMARK) -> DataFrame:
    """Changes of the newest progress per run, with state that a silent run loses after ``keep`` seconds."""
    kind = progress.schema["run_id"].dataType.simpleString()
    rows = _timed(progress, "ts", watermark).filter(_named("run_id", "event_id"))
    schema = f"run_id {kind}, at bigint, event_id bigint, fraction double, detail string"
    out = _tracked(rows.select("run_id", "ts", "at", "event_id", "fraction", "detail"), Newest(keep), schema)
    return out.select("run_id", _moment("at").alias("ts"), "event_id", "fraction", "detail")
