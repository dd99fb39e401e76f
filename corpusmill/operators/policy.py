"""When a corpus is reindexed, and the maintenance sweep."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import parse_every
from corpusmill.sources.store import CorpusStore

#: Policies by kind of corpus; an entry's own settings come first, then its kind's, then these defaults.
DEFAULTS: Mapping[str, object] = {"reindex": "on-source-change", "every": "1d", "downtime": None}
BY_KIND: Mapping[str, Mapping[str, object]] = {"sessions": {"reindex": "interval", "every": "1h"}, "packages": {"reindex": "interval", "every": "1w"}}


def resolve_policy(kind: str | None, own: Mapping | None = None) -> dict:
    merged = {**DEFAULTS, **BY_KIND.get(kind or "", {}), **{k: v for k, v in (own or {}).items() if v is not None}}
    if merged["reindex"] not in ("on-source-change", "interval", "manual"):
        raise ValueError(f"unknown reindex mode {merged['reindex']!r}")
    return merged


def reindex_due(mode: Column, every_seconds: Column, last: Column, changed: Column, now: Column) -> Column:
    """Never indexed: due unless manual. On change: due if changed. Interval: due once it has passed."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    return F.when(mode == "manual", False).when(last.isNull(), True).when(mode == "on-source-change", F.coalesce(changed, F.lit(False))).otherwise(age >= every_seconds)


def in_downtime(hour: Column, start: Column, end: Column) -> Column:
    """Whether an hour lies in ``[start, end)``; a window may pass midnight; without a window every hour does."""
    inside = F.when(start <= end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))
    return F.when(start.isNull() | end.isNull(), True).otherwise(inside)


def every_seconds(policy: Mapping) -> float:
    return parse_every(str(policy["every"])).total_seconds()


class MaintenanceBusy(RuntimeError):
    pass


@contextmanager
def single_run(store: CorpusStore, stale_after: float = 6 * 3600):
    """A lock in the store: one maintenance at a time; a lock older than ``stale_after`` seconds is broken."""
    path, token = store.files.path("maintenance.lock"), uuid.uuid4().hex
    if store.files.fs.exists(path):
        age = time.time() - store.files.fs.getFileStatus(path).getModificationTime() / 1000
        if age < stale_after:
            raise MaintenanceBusy(f"{store.root} is being maintained")
        store.files.fs.delete(path, False)
    store.files.publish("maintenance.lock", token)
    try:
        yield token
    finally:
        store.files.fs.delete(path, False)


@dataclass
class MaintenanceResult:
    name: str
    status: str
    detail: str = ""


def maintain(corpora: Mapping[str, Callable[[], object]], due: Mapping[str, bool], only: str | None = None) -> list[MaintenanceResult]:
    """Runs the due corpora; one that fails does not stop a sweep, but a corpus asked for by name raises."""
    out = []
    for name, run in corpora.items():
        if only is not None and name != only:
            continue
        if only is None and not due.get(name, False):
            out.append(MaintenanceResult(name, "skipped"))
            continue
        try:
            out.append(MaintenanceResult(name, "ok", str(run())))
        except Exception as error:
            if only is not None:
                raise
            out.append(MaintenanceResult(name, "failed", repr(error)))
    return out
