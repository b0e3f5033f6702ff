"""Watched folders: tells of a new file once it has stopped growing.

Each listing of a folder is one row. A file that is not empty and the same for two more
listings running is ready, and is loading until it is reported as done or failed; a failed one is
watched anew. A minute after its first listing a file that is not loading is given up, whether or not it has
just become stable. A file that is missing from a listing is forgotten, unless it is
loading. Files that were there at the start, are done or given up are ignored from then on.

State is kept by folder: a map of pending files, which holds new files only, and one of ignored files, which
are forgotten after a time of their own. A folder that is not listed any more loses all its
state when its timer ends. Time comes with the rows; only these two run by the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GIVE_UP_MS, STABLE = 60_000, 2
#: An ignored file is remembered, and a folder without listings kept, for this long.
REMEMBER_MS, QUIET_MS = 30 * 86_400_000, 86_400_000
FILES = "array<struct<path:string,size_bytes:long,mtime_ms:long>>"
INPUT = f"folder string, now_ms long, what string, files {FILES}"
OUTPUT = "folder string, path string, event string, at_ms long"
PENDING = "size long, mtime_ms long, first_ms long, stable int, loading boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Pending = tuple[int, int, int, int, bool]


def checked(state: Pending | None, size: int, mtime_ms: int, now_ms: int) -> tuple[Pending | None, str | None]:
    """A file's state after a listing that has it, and what became of it: ready, ignored (it is given up, without a state) or nothing yet."""
    if state is None:
        return (size, mtime_ms, now_ms, 0, False), None
    was_size, was_mtime, first, stable, loading = state
    if loading:
        return state, None
    if now_ms - first >= GIVE_UP_MS:
        return None, "ignored"
    stable = stable + 1 if size > 0 and (size, mtime_ms) == (was_size, was_mtime) else 0
    return (size, mtime_ms, first, stable, stable >= STABLE), "ready" if stable >= STABLE else None


def failed(state: Pending | None, now_ms: int) -> tuple[Pending | None, str | None]:
    """A file's state after a load that failed: it is watched anew, or ignored after a minute."""
    if state is None:
        return None, None
    if now_ms - state[2] >= GIVE_UP_MS:
        return None, "ignored"
    return (*state[:3], 0, False), None


def listed(pending: dict[str, Pending], ignored: set[str], what: str, files: list[tuple[str, int, int]], now_ms: int) -> tuple[dict[str, Pending | None], set[str], list[tuple[str, str]]]:
    """One row of a folder: changed states (None: the file is forgotten), files that are ignored from now on, and events (path, event).

    what is listing (all files of the folder), existing (files that were there when watching starts: it starts over), done or failed (files that were loading).
    """
    if what == "existing":
        return dict.fromkeys(pending), {f[0] for f in files}, []
    changed: dict[str, Pending | None] = {}
    out, events = set(), []
    for path, size, mtime_ms in files:
        state = changed.get(path, pending.get(path))
        if what == "done":
            state, event = None, "done"
        elif what == "failed":
            state, event = failed(state, now_ms)
        elif path in ignored:
            continue
        else:
            state, event = checked(state, size, mtime_ms, now_ms)
        changed[path] = state
        if event in ("done", "ignored"):
            out.add(path)
        if event in ("ready", "ignored"):
            events.append((path, event))
    if what == "listing":
        there = {f[0] for f in files}
        changed |= {path: None for path, state in pending.items() if path not in there and not state[4]}
    return changed, out, events


class Tracker(StatefulProcessor):
    """Keeps each folder's files between rows; what a row does is told by listed()."""

    def __init__(self, remember_ms: int = REMEMBER_MS, quiet_ms: int = QUIET_MS):
        self.remember_ms, self.quiet_ms = remember_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", PENDING)
        self.ignored = handle.getMapState("ignored", "path string", "since_ms long", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # State is read once and written once: each call costs as much as many rows.
        events, pending = [], {k[0]: tuple(v) for k, v in self.pending.iterator()}
        was, changed_paths, since = set(pending), set(), {}
        known = {} if self.ignored.exists() else None  # None: nothing was ignored before

        def is_ignored(path: str) -> bool:
            if path in since or known is None:
                return path in since
            if path not in known:
                known[path] = self.ignored.containsKey((path,))
            return known[path]

        for row in pd.concat(list(rows)).sort_values("now_ms", kind="stable").itertuples():
            files = [(f["path"], f["size_bytes"] or 0, f["mtime_ms"] or 0) for f in (row.files if row.files is not None else []) if f["path"] is not None]
            if row.what == "existing":
                self.ignored.clear()
                since, known = {}, None
            ignored = {f[0] for f in files if is_ignored(f[0])}
            changed, out, told = listed(pending, ignored, row.what, files, int(row.now_ms))
            for path, state in changed.items():
                changed_paths.add(path)
                if state is not None:
                    pending[path] = state
                else:
                    pending.pop(path, None)
            since |= dict.fromkeys(out, int(row.now_ms))
            events += [(key[0], path, event, int(row.now_ms)) for path, event in told]
        for path in changed_paths:
            if path in pending:
                self.pending.updateValue((path,), pending[path])
            elif path in was:
                self.pending.removeKey((path,))
        for path, at in since.items():
            self.ignored.updateValue((path,), (at,))
        for timer in list(self.handle.listTimers()):  # all are read before another call is made
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame(events, columns=["folder", "path", "event", "at_ms"]).astype({"at_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pending.clear()
        self.ignored.clear()
        yield pd.DataFrame({"folder": [], "path": [], "event": [], "at_ms": []}).astype({"folder": str, "path": str, "event": str, "at_ms": "int64"})

    def close(self) -> None:
        pass


def track(listings: DataFrame, remember_ms: int = REMEMBER_MS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Events (folder, path, event, at_ms) of listings, a stream or a table of INPUT's columns; see listed() for what a row can be.

    State of this kind is kept in RocksDB, to which the session's state store is set. A row without files
    is a listing of an empty folder; files without a path are passed over. Rows of a folder
    within a batch are taken in order of their time. A stream goes on by the clock, so it does not rest when all rows are taken.
    """
    spark = listings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    _ = spark.streams.active  # starts what tasks ask for their state, which a table alone would not
    rows = listings.select("folder", "now_ms", "what", "files")
    return rows.groupBy("folder").transformWithStateInPandas(Tracker(remember_ms, quiet_ms), OUTPUT, "Append", "ProcessingTime")


def moved_anchor(state: tuple[str, str], what: str, file: str) -> tuple[str, str]:
    """(anchor, last inserted file) after an event: a page is selected, a scan inserted, or the anchor cleared.

    Selecting the anchor or the scan inserted last is no new start, so scans go on behind one another.
    """
    anchor, last = state
    if what == "cleared":
        return "", ""
    if what == "selected" and file and file not in (anchor, last):
        return file, file
    if what == "inserted" and anchor:
        return anchor, file
    return state


def insertion_anchors(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """events (what, file, ...) with the anchor and the file that the next scan goes behind, after each; a session's events are one user's work and meet in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        state, seen = ("", ""), []
        for what, file in zip(part["what"], part["file"], strict=True):
            state = moved_anchor(state, what, file)
            seen.append(state)
        return part.assign(anchor=[s[0] for s in seen], after=[s[1] for s in seen])

    return events.groupBy(session).applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", anchor string, after string")
