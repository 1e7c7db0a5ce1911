"""Paths, the sample split and the study's constants."""

from __future__ import annotations

import contextlib
import contextvars
import datetime as dt
import os
from dataclasses import dataclass, field
from pathlib import Path

#: Fixed values of the study.
FEE_BPS = 5.0
LATENCIES_MS = (0, 100, 500)
MAIN_LATENCY_MS = 100
WALK_FORWARD_DAYS = 12
MIN_OBSERVATIONS = 30
BOOTSTRAP_DRAWS = 10_000
BOOTSTRAP_SEED = 20260930
HELD_OUT = ("2026-04-01", "2026-09-30")
SPECS = (("main 10s/30min", 10, 1800), ("robust 1s/30min", 1, 1800), ("robust 60s/2h", 60, 7200))


def months_between(start: str, end: str) -> list[str]:
    """The first day of every month in the closed range."""
    day, last, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), []
    if day.day > 1:
        day = (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    while day <= last:
        out.append(day.isoformat())
        day = (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return out


@dataclass(frozen=True)
class Split:
    """Train, validation and held-out days."""

    train: list[str] = field(default_factory=lambda: months_between("2023-09-01", "2025-08-01"))
    valid: list[str] = field(default_factory=lambda: months_between("2025-09-01", "2026-03-01"))
    test: list[str] = field(default_factory=lambda: months_between("2026-04-01", "2026-09-01"))

    @property
    def in_sample(self) -> list[str]:
        return [*self.train, *self.valid]


@dataclass(frozen=True)
class Paths:
    """Where data and results lie; TOBFLOW_DATA_DIR and TOBFLOW_PROJECT_DIR move them."""

    data: Path = field(default_factory=lambda: Path(os.environ.get("TOBFLOW_DATA_DIR") or Path(os.environ.get("TOBFLOW_PROJECT_DIR", ".")) / "data"))
    project: Path = field(default_factory=lambda: Path(os.environ.get("TOBFLOW_PROJECT_DIR", ".")))

    def raw(self, dataset: str, symbol: str, date: str) -> Path:
        return self.data / "raw" / dataset / symbol / f"{date}.csv.gz"

    def buckets(self) -> str:
        return str(self.data / "buckets")

    def frames(self) -> str:
        return str(self.data / "predict")

    def reports(self) -> Path:
        return self.project / "reports"

    def research(self) -> Path:
        return self.project / "research"

    def models(self) -> Path:
        return self.research() / "models.json"

    def ledger(self) -> str:
        return str(self.research() / "ledger")


class HeldOutDateError(RuntimeError):
    """A held-out day was asked for outside unlocked()."""


_unlocked: contextvars.ContextVar[bool] = contextvars.ContextVar("unlocked", default=False)


@contextlib.contextmanager
def unlocked():
    """Within this block held-out days may be read."""
    token = _unlocked.set(True)
    try:
        yield
    finally:
        _unlocked.reset(token)


def check_date(date: str) -> str:
    """date, or HeldOutDateError if it is held out and not unlocked."""
    if HELD_OUT[0] <= date <= HELD_OUT[1] and not _unlocked.get():
        raise HeldOutDateError(f"{date} is held out until the final test")
    return date
