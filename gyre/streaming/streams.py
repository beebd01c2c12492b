"""Streams: windowed means with late rows dropped, buoy input in time order, drifter sets as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gyre.operators.drifters import KEPT, STEP_T, Schedule, drifter_steps

MOVES_T = "drifter_id long, x double, y double, steps long, ts timestamp, alive boolean"


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def window_means(rows: DataFrame, ts: str, length: str, by: list[str], value: str, late: str = "0 seconds") -> DataFrame:
    """Means that are final once the watermark has passed their window."""
    w = rows.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), *by)
    return w.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "mean", "n")


def add_if_missing(rows: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """The first row of each key."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def drifters(rows: DataFrame, lifetime_s: int) -> DataFrame:
    """Sets of moving points.  rows: (drifter_id, ts, x, y, u, v, conc, limit); the first row of an id seeds it at x, y.

    Later ones move it by u, v; one that isn't over the concentration limit ends it,
    as does its lifetime.  Rows of one id are taken in time order; earlier rows than
    the last one taken are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, y, steps, born, last, alive = state.get if state.exists else (None, None, 0, None, None, True)
        out = []
        for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            t = r.ts.value
            if last is not None and t <= last or not alive:
                continue
            if born is None:
                x, y, born = float(r.x), float(r.y), t
            else:
                x, y, steps = x + float(r.u), y + float(r.v), steps + 1
            last, alive = t, bool(r.conc > r.limit) and t - born < lifetime_s * 1_000_000_000
            out.append((key[0], x, y, steps, r.ts, alive))
        if born is not None:
            state.update((x, y, steps, born, last, alive))
        yield pd.DataFrame(out, columns=["drifter_id", "x", "y", "steps", "ts", "alive"])

    state = "x double, y double, steps long, born long, last long, alive boolean"
    return rows.groupBy("drifter_id").applyInPandasWithState(step, MOVES_T, state, "append", GroupStateTimeout.NoTimeout)


class DrifterSteps(StatefulProcessor):
    """The steps of ``operators.drifters`` as keyed state, which a restart's table may begin with."""

    def __init__(self, schedule: Schedule):
        self.schedule = schedule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", f"{KEPT}, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.kept.get() if self.kept.exists() else None
        state, last = (tuple(held[:5]), held[5]) if held else (None, None)
        frame = pd.concat(list(rows)).sort_values("t", kind="stable")
        own = frame[frame["t"] > last] if last is not None else frame
        found = []
        for state, out in drifter_steps(state, own[["t", "x", "y", "u", "v", "conc", "reported"]].itertuples(index=False, name=None), self.schedule):
            found += [(key[0], *o) for o in out]
        if len(own):
            self.kept.update((*state[:2], float(state[2]), float(state[3]), int(state[4]), int(own["t"].iloc[-1])))
        yield pd.DataFrame(found, columns=["drifter_id", "t", "x", "y", "conc", "kind"])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.kept.update((bool(r["begun"]), bool(r["on"]), float(r["x"]), float(r["y"]), int(r["start"]), int(r["last"])))

    def close(self) -> None:
        pass


def drifter_updates(rows: DataFrame, schedule: Schedule, restart: DataFrame | None = None) -> DataFrame:
    """STEP_T rows of a stream of (drifter_id, t, x, y, u, v, conc, reported), as ``operators.drifters.run_steps`` gives them for a table.

    restart: (drifter_id, begun, on, x, y, start, last), the state to begin with; rows not after ``last`` are dropped.
    Needs the RocksDB state store.
    """
    initial = restart.groupBy("drifter_id") if restart is not None else None
    return rows.groupBy("drifter_id").transformWithStateInPandas(statefulProcessor=DrifterSteps(schedule), outputStructType=STEP_T, outputMode="append", timeMode="none", initialState=initial)
