"""Change events of a watched repository: filtering, debouncing, reindexing."""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a path that never trigger a run, and the quiet time after which one does.
IGNORED_PARTS = ("/.git/", "/__pycache__/", "/.venv/", "/node_modules/")
DEBOUNCE = "1500 milliseconds"
EVENT_SCHEMA = "ts timestamp, path string, is_directory boolean"


def wanted_event(path: Column, is_directory: Column, ignore: tuple[str, ...] = ()) -> Column:
    """No directories, no ignored parts, nothing under an ignored prefix (plain prefixes, without a separator)."""
    ok = ~is_directory
    for p in IGNORED_PARTS:
        ok = ok & ~path.contains(p)
    for p in ignore:
        ok = ok & ~path.startswith(p)
    return ok


def sessions(events: DataFrame, keys: list[str] = (), ts: str = "ts", gap: str = DEBOUNCE) -> DataFrame:
    """One row per burst: a run is due ``gap`` after a burst's last event; events exactly one gap apart share a burst.

    Works on batches, and on streams whose ``ts`` has a watermark.
    """
    return events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events")).select(
        *keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("due_at"), "n_events"
    )


class Debounce:
    """Runs an action once after a burst of calls: every call puts it off until ``quiet`` seconds have passed without one.

    One thread waits for the moment that is due and runs the action, so runs
    never overlap; an action that fails is reported and the next burst tries
    again.
    """

    def __init__(self, action: Callable[[], object], quiet: float = 1.5, clock: Callable[[], float] = time.monotonic):
        self.action, self.quiet, self.clock = action, quiet, clock
        self._due: float | None = None
        self._open = True
        self._changed = threading.Condition()
        self._thread = threading.Thread(target=self._wait, daemon=True)
        self._thread.start()

    def __call__(self) -> None:
        with self._changed:
            self._due = self.clock() + self.quiet
            self._changed.notify()

    def _wait(self) -> None:
        while True:
            with self._changed:
                while self._open and (self._due is None or self._due > self.clock()):
                    self._changed.wait(None if self._due is None else max(0.0, self._due - self.clock()))
                if not self._open:
                    return
                self._due = None
            try:
                self.action()
            except Exception as e:  # the watch outlives a failed run
                print(f"reindex failed: {e}")

    def stop(self) -> None:
        with self._changed:
            self._open = False
            self._changed.notify()
        if threading.current_thread() is not self._thread:
            self._thread.join()


def snapshot(root: str, ignore: tuple[str, ...] = ()) -> dict[str, tuple[int, int]]:
    """path -> (time of change in ns, size) of every file below a root, but for what never triggers a run."""
    out = {}
    skip = {p.strip("/") for p in IGNORED_PARTS}
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in skip and not os.path.join(at, d).startswith(ignore)] if ignore else [d for d in dirs if d not in skip]
        for n in names:
            full = os.path.join(at, n)
            with contextlib.suppress(OSError):
                s = os.stat(full)
                out[full] = s.st_mtime_ns, s.st_size
    return out


class FileEvents:
    """The source of the event log: looks at a tree every ``interval`` seconds and writes what changed since, one JSON file per look.

    A file is written under a hidden name and renamed, so a stream that reads
    the log never sees half of one.
    """

    def __init__(self, root: str, log_dir: str, interval: float = 0.5, ignore: tuple[str, ...] = ()):
        self.root, self.log_dir, self.interval, self.ignore = root, log_dir, interval, ignore
        os.makedirs(log_dir, exist_ok=True)
        self._stop = threading.Event()
        self._seen = snapshot(root, ignore)
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def look(self) -> list[str]:
        """Paths that were made, changed or removed since the last look, after writing them to the log."""
        now, before = snapshot(self.root, self.ignore), self._seen
        changed = sorted(p for p in now.keys() | before.keys() if now.get(p) != before.get(p))
        if changed:
            name = f"{time.time_ns()}.json"
            ts = datetime.datetime.now(datetime.timezone.utc).isoformat()
            with open(os.path.join(self.log_dir, "." + name), "w", encoding="utf-8") as f:
                f.writelines(json.dumps({"ts": ts, "path": p, "is_directory": False}) + "\n" for p in changed)
            os.replace(os.path.join(self.log_dir, "." + name), os.path.join(self.log_dir, name))
        self._seen = now
        return changed

    def _loop(self) -> None:
        while not self._stop.wait(self.interval):
            with contextlib.suppress(OSError):
                self.look()

    def start(self) -> "FileEvents":
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()


class Watch:
    """A running watch: the stream over the event log, the debounced action, and the source of events where one was asked for."""

    def __init__(self, query, debounce: Debounce, events: FileEvents | None):
        self.query, self.debounce, self.events = query, debounce, events

    def stop(self) -> None:
        if self.events is not None:
            self.events.stop()
        self.query.stop()
        self.debounce.stop()

    def awaitTermination(self) -> None:  # noqa: N802  (as a stream's)
        self.query.awaitTermination()


def start_watch(
    spark: SparkSession, log_dir: str, on_change: Callable[[], object], checkpoint: str, ignore: tuple[str, ...] = (), trigger: str = "200 milliseconds",
    quiet: float = 1.5, root: str | None = None,
) -> Watch:
    """Follow an append-only event log (one JSON file per burst of events) and run ``on_change`` once per burst, ``quiet`` seconds after its last wanted event.

    With ``root`` the events of that tree are written to the log as well.  A
    failed run is reported and the next burst tries again; the returned watch
    can be stopped.
    """
    os.makedirs(log_dir, exist_ok=True)
    debounce = Debounce(on_change, quiet)
    events = spark.readStream.schema(EVENT_SCHEMA).json(log_dir)
    wanted = events.where(wanted_event(F.col("path"), F.col("is_directory"), ignore))

    def note(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            debounce()

    query = wanted.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
    return Watch(query, debounce, FileEvents(root, log_dir, ignore=ignore).start() if root else None)


def watch(*args, **kwargs) -> None:
    """start_watch, until stopped."""
    start_watch(*args, **kwargs).awaitTermination()
