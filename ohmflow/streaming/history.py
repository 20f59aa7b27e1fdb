"""All causal shifts of a reading stream from one state per series.

A series keeps the readings of the longest shift's hours, and those that the watermark has not reached. When it passes a reading's hour, nothing
can come before it any more: a timer gives the reading out with what stood at each shift, so rows equal the batch windows whatever
the order of arrival. State holds at most the longest shift and the lateness in hours, and a series that has ended is forgotten by its
last timer.

Defined results: a row later than the watermark is dropped by Spark; repeated rows of an hour are each given out, and as a past hour count with
their highest reading; a null reading is given out and counts as no past reading; rows without building, meter or time are left out; what
the last watermark has not passed stays in the state for the next run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ohmflow.operators.features import TIE

HOUR_MS = 3_600_000
CAUSAL_SHIFTS = (*range(1, 31), 168)
_STATE = "hours array<bigint>, highest array<double>, waiting array<bigint>, readings array<double>"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which this operator needs and which bounds executors' memory."""
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_ROCKS[0]) if before is None else spark.conf.set(_ROCKS[0], before)


class _Series(StatefulProcessor):
    def __init__(self, shifts: tuple[int, ...]):
        self.shifts, self.reach = shifts, max(shifts) * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("series", _STATE)

    def _read(self) -> tuple[dict, list]:
        if not self.kept.exists():
            return {}, []
        hours, highest, waiting, readings = self.kept.get()
        return dict(zip(hours, highest, strict=True)), list(zip(waiting, readings, strict=True))

    def _write(self, past: dict, waiting: list) -> None:
        self.kept.update((list(past), list(past.values()), [w for w, _ in waiting], [r for _, r in waiting]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        past, waiting = self._read()
        soonest = min((w for w, _ in waiting), default=None)
        for row in rows:
            waiting.append((row["at"], row["meter_reading"]))
            if row["meter_reading"] is not None:
                past[row["at"]] = max(past.get(row["at"], row["meter_reading"]), row["meter_reading"])
        first = min(w for w, _ in waiting)
        if soonest is None or first < soonest:
            self.handle.registerTimer(first)
        self._write(past, waiting)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        past, waiting = self._read()
        ready = sorted((x for x in waiting if x[0] <= mark), key=lambda x: x[0])
        out = [Row(building_id=key[0], meter=key[1], at=at, meter_reading=reading, before=[past.get(at - n * HOUR_MS) for n in self.shifts]) for at, reading in ready]
        waiting = [x for x in waiting if x[0] > mark]
        # what still waits, or comes, lies after the mark
        past = {at: value for at, value in past.items() if at > mark - self.reach}
        if waiting or past:
            self.handle.registerTimer(min(w for w, _ in waiting) if waiting else max(past) + self.reach)
            self._write(past, waiting)
        else:
            self.kept.clear()
        return iter(out)


def causal_features(stream: DataFrame, shifts: tuple[int, ...] = CAUSAL_SHIFTS, ts: str = "timestamp", late: str = "2 hours", digits: int | None = None) -> DataFrame:
    """building_id, meter, timestamp, meter_reading and lag_value_diff_n, lag_value_ratio_n over exactly n hours before, for every shift, in one
    stateful step. Start the stream inside rocks_state()."""
    if not shifts or min(shifts) <= 0:
        raise ValueError("a stream has no future readings")
    known = stream.filter(f"building_id is not null and meter is not null and {ts} is not null").withWatermark(ts, late)
    keyed = known.select(F.col("building_id").cast("long").alias("building_id"), "meter", ts, F.unix_millis(ts).alias("at"), F.col("meter_reading").cast("double").alias("meter_reading"))
    schema = "building_id long, meter string, at long, meter_reading double, before array<double>"
    found = keyed.groupBy("building_id", "meter").transformWithState(_Series(tuple(shifts)), schema, "Append", "EventTime")
    trim = (lambda c: F.round(c + TIE, digits)) if digits is not None else (lambda c: c)
    now, out = F.col("meter_reading"), []
    for i, n in enumerate(shifts):
        then = F.get("before", F.lit(i))
        out += [trim(now - then).alias(f"lag_value_diff_{n}"), trim(F.try_divide(now + 1, then + 1)).alias(f"lag_value_ratio_{n}")]
    return found.select("building_id", "meter", F.timestamp_millis("at").alias(ts), "meter_reading", *out)
