"""Streaming forms of the telemetry and turn summaries; the batch operators are the reference for their results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veridix.sources.files import TRACE_SCHEMA


def read_trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(TRACE_SCHEMA).json(folder)


def gpu_windows(telemetry: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Tumbling means and peaks per device; rows later than the watermark are left out."""
    return telemetry.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "gpu").agg(F.count("*").alias("n"), F.avg("util").alias("mean_util"), F.max("mem_mib").alias("peak_mem_mib")).select(F.col("w.start").alias("start"), "gpu", "n", "mean_util", "peak_mem_mib")


def session_activity(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def early_stop_stream(flags: DataFrame) -> DataFrame:
    """Turns (session_id, turn_idx, is_correct) in arrival order -> with `stopped`; the state of a session is whether its
    last turn was incorrect and whether it has stopped."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        wrong, stopped = state.get if state.exists else (False, False)
        for pdf in parts:
            pdf = pdf.sort_values("turn_idx")
            out = []
            for ok in pdf["is_correct"]:
                out.append(stopped)
                stopped = stopped or (wrong and not ok)
                wrong = not ok
            yield pdf.assign(stopped=out)[["session_id", "turn_idx", "is_correct", "stopped"]]
        state.update((bool(wrong), bool(stopped)))

    return flags.groupBy("session_id").applyInPandasWithState(step, "session_id long, turn_idx int, is_correct boolean, stopped boolean", "wrong boolean, stopped boolean", "append", "NoTimeout")


ORDERED = "session_id long, turn_idx int, is_correct boolean, stopped boolean"


class _InOrder(StatefulProcessor):
    """A session's turns that wait for an earlier one, and what the rule knows of those before."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "due int, wrong boolean, stopped boolean")
        self.waiting = handle.getMapState("waiting", "turn_idx int", "is_correct boolean")

    def _judged(self, session: int, turns: list[tuple[int, bool]], wrong: bool, stopped: bool) -> tuple[pd.DataFrame, bool, bool]:
        rows = []
        for i, ok in turns:
            rows.append((session, i, ok, stopped))
            stopped = stopped or (wrong and not ok)
            wrong = not ok
        return pd.DataFrame(rows, columns=["session_id", "turn_idx", "is_correct", "stopped"]), wrong, stopped

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, wrong, stopped = self.told.get() if self.told.exists() else (0, False, False)
        come = {}
        for pdf in rows:
            for i, ok in zip(pdf["turn_idx"].tolist(), pdf["is_correct"].tolist(), strict=True):
                if i >= due and i not in come:
                    come[i] = ok
        turns = []
        while True:
            if due in come:
                ok = come.pop(due)
                if self.waiting.containsKey((due,)):
                    self.waiting.removeKey((due,))
            elif self.waiting.containsKey((due,)):
                ok = self.waiting.getValue((due,))[0]
                self.waiting.removeKey((due,))
            else:
                break
            turns.append((due, ok))
            due += 1
        for i, ok in come.items():
            if not self.waiting.containsKey((i,)):
                self.waiting.updateValue((i,), (bool(ok),))
        out, wrong, stopped = self._judged(key[0], turns, wrong, stopped)
        self.told.update((due, bool(wrong), bool(stopped)))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, wrong, stopped = self.told.get() if self.told.exists() else (0, False, False)
        left = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        self.told.clear()
        self.waiting.clear()
        yield self._judged(key[0], left, wrong, stopped)[0]

    def close(self) -> None:
        pass


def early_stop_ordered(flags: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """Turns (session_id, turn_idx from 0 without gaps, is_correct) in any order of batches -> with `stopped`, the rows of the
    batch rule: a turn waits until all before it have come, and a turn that comes twice counts once.

    A session that has had no turn for keep_ms of processing time is forgotten: what still waits (an earlier turn never
    came) is judged in its order then, and the session's state is gone; turns that come later begin a new session.
    Times are looked at with each batch, so Spark also runs batches of no data unless the session forbids them. Needs the
    RocksDB state store: spark.sql.streaming.stateStore.providerClass is the session's to set."""
    own = flags.select(F.col("session_id").cast("long").alias("session_id"), F.col("turn_idx").cast("int").alias("turn_idx"), "is_correct")
    return own.groupBy("session_id").transformWithStateInPandas(_InOrder(keep_ms), ORDERED, "Append", "ProcessingTime")
