"""Upkeep of a growing event table and its models: appends, retries, retention, slots."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = ("blue", "green")


@dataclass(frozen=True)
class State:
    """Which slot serves, up to which day it has learnt, and the days that failed."""

    active: str = SLOTS[0]
    start: date = date(2025, 1, 1)
    end: date = date(2025, 1, 1)
    failed: tuple[date, ...] = ()

    def __post_init__(self):
        if self.active not in SLOTS:
            raise ValueError(f"no slot {self.active}")

    @property
    def idle(self) -> str:
        return SLOTS[1 - SLOTS.index(self.active)]

    def due(self, today: date, days: int = 7) -> bool:
        return (today - self.end).days >= days


def save_state(spark: SparkSession, state: State, path: str) -> None:
    row = [(state.active, state.start, state.end, list(state.failed))]
    spark.createDataFrame(row, "active string, start date, end date, failed array<date>").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> State:
    """The stored state; the first one where none is stored."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return State()
    return State(row["active"], row["start"], row["end"], tuple(row["failed"])) if row else State()


def append_days(days: Iterable[date], fetch: Callable[[date], DataFrame], present: Callable[[date], bool], write: Callable[[date, DataFrame], None], tries: int = 3) -> tuple[list[date], list[date]]:
    """Days appended and days that failed after so many tries. A day that is there already counts as appended, so a rerun is safe."""
    done, failed = [], []
    for day in days:
        for k in range(tries):
            try:
                if not present(day):
                    write(day, fetch(day))
                done.append(day)
                break
            except Exception:
                if k == tries - 1:
                    failed.append(day)
    return done, failed


def update(state: State, today: date, append: Callable[[Iterable[date]], tuple[list[date], list[date]]], diverged: Callable[[], bool], retrain: Callable[[str, date, date], None], trim: Callable[[int], None]) -> State:
    """One run: failed days again, then new days; retrain the idle slot when a week has passed or the loss diverged; drop as many of the
    oldest days as came; serve the new slot."""
    new = [state.end + timedelta(d) for d in range(1, (today - state.end).days + 1)]
    done, failed = append([*state.failed, *new])
    if not done or not (state.due(today) or diverged()):
        return replace(state, failed=tuple(failed))
    trim(len(done))
    start = state.start + timedelta(len(done))
    retrain(state.idle, start, max([*done, state.end]))
    return replace(state, active=state.idle, start=start, end=max([*done, state.end]), failed=tuple(failed))


def daily_merge(table: DataFrame, incoming: DataFrame, day: str) -> DataFrame:
    """The table with the incoming days in place of its own."""
    days = incoming.select(F.col(day).alias("_d")).distinct()
    return table.join(days, F.col(day) == F.col("_d"), "left_anti").unionByName(incoming, allowMissingColumns=True)
