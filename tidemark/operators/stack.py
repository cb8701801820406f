"""What stands around a catalog: wrappers and their rules, extensions, presenters, the event bus, the scheduler."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schedule import next_moment

#: Kinds of wrappers, outermost first; a kind that changes sizes must say so.
ORDER = ("gate", "scope", "observe", "transform")


@dataclass(frozen=True)
class Wrapper:
    """A step DataFrame -> DataFrame of a kind; ``keeps_size`` promises that it neither drops nor adds rows."""

    name: str
    kind: str
    step: Callable[[DataFrame], DataFrame]
    keeps_size: bool = True


def stacked(wrappers: list[Wrapper]) -> Callable[[DataFrame], DataFrame]:
    """One step of all wrappers, the first being the outermost; unknown kinds, repeated names and another order of kinds are refused."""
    if bad := [w.name for w in wrappers if w.kind not in ORDER]:
        raise ValueError(f"wrapper {bad[0]} is of no known kind")
    if len({w.name for w in wrappers}) < len(wrappers):
        raise ValueError("a wrapper comes once")
    ranks = [ORDER.index(w.kind) for w in wrappers]
    if ranks != sorted(ranks):
        raise ValueError("wrappers must follow the order of their kinds")

    def run(rows: DataFrame) -> DataFrame:
        for w in reversed(wrappers):
            out = w.step(rows)
            if w.kind == "observe" and out.columns != rows.columns:
                raise ValueError(f"{w.name} must not change what it observes")
            rows = out
        return rows

    return run


@dataclass
class Extension:
    """A package of index, wrapper and jobs under one name."""

    name: str
    indexer: Callable[[DataFrame], DataFrame] | None = None
    wrapper: Wrapper | None = None
    jobs: dict[str, Callable] = field(default_factory=dict)


def installed(extensions: list[Extension]) -> dict:
    """Indexers, wrappers and jobs of all extensions; names of extensions and jobs come once."""
    names = [e.name for e in extensions]
    jobs = [j for e in extensions for j in e.jobs]
    for kind, own in (("extension", names), ("job", jobs)):
        if twice := [n for n in own if own.count(n) > 1]:
            raise ValueError(f"{kind} {twice[0]} comes twice")
    return {"indexers": {e.name: e.indexer for e in extensions if e.indexer}, "wrappers": [e.wrapper for e in extensions if e.wrapper], "jobs": {n: f for e in extensions for n, f in e.jobs.items()}}


def presented(rows: DataFrame, labels: dict[str, str], key: str = "doc_id", document: str = "ext") -> DataFrame:
    """(key, position, label, value) for every labelled JSON path that the document holds, in the order of the labels."""
    each = [F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), F.get_json_object(document, path).alias("value")) for k, (path, label) in enumerate(labels.items())]
    return rows.select(key, F.inline(F.filter(F.array(*each), lambda x: x["value"].isNotNull())))


class Bus:
    """Events go to every subscriber in order of subscription, before ``publish`` returns; one that fails does not stop the others."""

    def __init__(self) -> None:
        self.subscribers: list[tuple[str, Callable]] = []
        self.failures: list[tuple[str, str]] = []

    def subscribe(self, name: str, f: Callable) -> Callable[[], None]:
        entry = (name, f)
        self.subscribers.append(entry)
        return lambda: self.subscribers.remove(entry) if entry in self.subscribers else None

    def publish(self, kind: str, payload: dict) -> None:
        for name, f in list(self.subscribers):
            try:
                f(kind, payload)
            except Exception as e:  # noqa: BLE001
                self.failures.append((name, repr(e)))


@dataclass
class Job:
    """A job by interval or cron rule; ``due`` is its next moment."""

    name: str
    run: Callable[[], None]
    due: datetime
    every: timedelta | None = None
    rule: str | None = None

    def after(self, now: datetime) -> datetime:
        """The first moment after now on the job's own grid, so it never drifts."""
        if self.rule:
            return next_moment(self.rule, now)
        missed = max(0, (now - self.due) // self.every)
        return self.due + (missed + 1) * self.every


def tick(jobs: list[Job], now: datetime) -> list[str]:
    """Runs what is due, each job once however many moments it missed, and sets its next moment."""
    ran = []
    for job in jobs:
        if job.due <= now:
            job.run()
            job.due = job.after(now)
            ran.append(job.name)
    return ran
