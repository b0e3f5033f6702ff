"""Watched folders: new files, seen listing by listing, and as a stream."""

import collections
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.plans import settings_queries
from leafmill.streaming import scans

LIMIT = scans.GIVE_UP_MS


class Folder:
    """Listings of one folder, one after the other."""

    def __init__(self, existing=()):
        self.pending, self.ignored = {}, set(existing)

    def row(self, what, files, now):
        changed, out, events = scans.listed(self.pending, self.ignored, what, files, now)
        self.pending = {k: v for k, v in {**self.pending, **changed}.items() if v is not None}
        self.ignored |= out
        return events

    def listing(self, now, *files):
        return [p for p, e in self.row("listing", [(f + (0,))[:3] for f in files], now) if e == "ready"]

    def until_ready(self, *files):
        return next((i for i in range(1, 11) if self.listing(i * 250, *files)), None)


def test_existing_files_are_ignored():
    folder = Folder(["a.tif"])
    assert folder.until_ready(("a.tif", 100)) is None and not folder.pending


def test_a_new_file_is_ready_once_stable():
    folder = Folder()
    assert folder.until_ready(("b.tif", 100)) == scans.STABLE + 1
    assert not folder.listing(5000, ("b.tif", 100))  # it is loading
    folder.row("done", [("b.tif", 0, 0)], 5500)
    assert not folder.pending and not folder.listing(6000, ("b.tif", 100)) and not folder.pending


def test_a_growing_or_touched_file_waits():
    folder = Folder()
    for now, file in enumerate([("c.tif", 100), ("c.tif", 200), ("c.tif", 200, 1)]):
        assert not folder.listing(now * 250, file)
    assert [folder.listing(1000 + i, ("c.tif", 200, 1)) for i in range(3)] == [[], ["c.tif"], []]


def test_an_empty_file_waits():
    folder = Folder()
    assert folder.until_ready(("d.tif", 0)) is None and folder.pending


def test_a_failed_load_is_tried_again_then_given_up():
    folder = Folder()
    assert folder.until_ready(("e.tif", 100)) == 3
    assert folder.row("failed", [("e.tif", 0, 0)], 1000) == [] and folder.pending
    assert [folder.listing(1250 + 250 * i, ("e.tif", 100)) for i in range(2)] == [[], ["e.tif"]]
    assert folder.row("failed", [("e.tif", 0, 0)], LIMIT + 250) == [("e.tif", "ignored")]
    assert not folder.pending and not folder.listing(LIMIT + 500, ("e.tif", 100)) and not folder.pending
    assert folder.row("failed", [("unknown", 0, 0)], 5) == []


def test_a_file_that_is_never_stable_is_given_up():
    folder = Folder()
    for now, waits in ((0, True), (LIMIT - 250, True), (LIMIT, False), (LIMIT + 250, False)):
        assert not folder.listing(now, ("empty.tif", 0)) and bool(folder.pending) == waits
    folder = Folder()
    for i in range(LIMIT // 250):
        assert not folder.listing(i * 250, ("log.txt", i + 1)) and folder.pending
    assert not folder.listing(LIMIT, ("log.txt", 9999)) and not folder.pending


def test_a_file_that_turns_stable_after_a_minute_is_given_up():
    folder = Folder()
    assert not folder.listing(0, ("late.tif", 5)) and not folder.listing(LIMIT - 1, ("late.tif", 5))
    assert folder.row("listing", [("late.tif", 5, 0)], LIMIT) == [("late.tif", "ignored")]


def test_a_vanished_file_is_forgotten_but_not_one_that_loads():
    folder = Folder()
    assert not folder.listing(0, ("tmp.tif", 100)) and folder.pending
    assert not folder.listing(250) and not folder.pending
    assert not folder.listing(LIMIT, ("tmp.tif", 100)) and folder.pending  # its minute starts anew
    assert folder.listing(LIMIT + 1, ("tmp.tif", 100)) == [] and folder.listing(LIMIT + 2, ("tmp.tif", 100)) == ["tmp.tif"]
    assert not folder.listing(LIMIT + 3) and folder.pending


def test_watching_starts_over():
    folder = Folder()
    folder.listing(0, ("a", 1), ("b", 1))
    folder.row("existing", [("b", 0, 0)], 10)
    folder.ignored = {"b"}
    assert not folder.pending and folder.until_ready(("a", 1), ("b", 1)) == 3


def as_rows(steps):
    return [(folder, now, what, [{"path": p, "size_bytes": s, "mtime_ms": m} for p, s, m in files]) for folder, now, what, files in steps]


def by_hand(steps):
    folders, out = {}, []
    for folder, now, what, files in steps:
        own = folders.setdefault(folder, Folder())
        if what == "existing":
            own.ignored = set()
        out += [(folder, path, event, now) for path, event in own.row(what, files, now)]
    return sorted(out), folders


def random_steps(seed, n):
    rng, steps = random.Random(seed), []
    for i in range(n):
        files = [(f"f{k}", rng.choice([0, 5, 5, 5, 6]), rng.choice([1, 1, 1, 2])) for k in range(4) if rng.random() < 0.85]
        what = rng.choices(["listing", "failed", "done", "existing"], [20, 2, 1, 0.3])[0]
        steps.append((rng.choice("xyz"), i * 2500, what, files if what == "listing" else files[:1]))
    return steps


def taken(query, n):
    """Wait until the stream has taken n rows: timers keep it running, so it never comes to rest by itself."""
    for _ in range(300):
        assert query.exception() is None and query.isActive, query.exception()
        if sum(p.numInputRows for p in query.recentProgress) >= n:
            return
        time.sleep(0.1)
    raise AssertionError("the stream is too slow")


def state_of(spark, place, name):
    return {(r.key.folder, r.user_map_key.path) for r in spark.read.format("statestore").option("stateVarName", name).load(place).collect()}


def test_listings_as_a_stream(spark, tmp_path):
    steps = random_steps(1, 120)
    want, folders = by_hand(steps)
    assert {e for *_, e, _ in want} == {"ready", "ignored"}
    (tmp_path / "in").mkdir()
    listings = spark.readStream.schema(scans.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = None
    for i in range(0, len(steps), 30):
        spark.createDataFrame(as_rows(steps[i : i + 30]), scans.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = scans.track(listings).writeStream.format("memory").queryName("scans").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        taken(query, i + 30)
    query.stop()
    assert sorted(map(tuple, spark.table("scans").collect())) == want
    assert state_of(spark, str(tmp_path / "state"), "pending") == {(f, p) for f, own in folders.items() for p in own.pending}
    assert state_of(spark, str(tmp_path / "state"), "ignored") == {(f, p) for f, own in folders.items() for p in own.ignored}


def test_state_is_empty_after_files_vanish_and_folders_go_quiet(spark, tmp_path):
    place = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    listings = spark.readStream.schema(scans.INPUT).parquet(place)
    write = lambda steps: spark.createDataFrame(as_rows(steps), scans.INPUT).coalesce(1).write.mode("append").parquet(place)
    write([("x", 0, "listing", [("a", 1, 1)]), ("x", 1, "done", [("old", 0, 0)])])
    query = scans.track(listings, quiet_ms=1).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    taken(query, 2)
    write([("x", 250, "listing", []), ("y", 250, "listing", [("b", 1, 1)])])
    taken(query, 4)
    batch = query.lastProgress.batchId
    while query.lastProgress.batchId < batch + 2:  # the clock has gone on: timers end, and take all state of their folders
        assert query.isActive
        time.sleep(0.1)
    query.stop()
    assert state_of(spark, str(tmp_path / "state"), "pending") == set() and state_of(spark, str(tmp_path / "state"), "ignored") == set()


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    rows = [("x", 0, "listing", None), ("x", 1, "listing", [{"path": None, "size_bytes": 1, "mtime_ms": 1}, {"path": "a", "size_bytes": None, "mtime_ms": None}])]
    frame = spark.createDataFrame(rows, scans.INPUT).withColumn("pending", F.lit(1))
    assert scans.track(frame if not extra else frame.where("false")).collect() == []


def test_scan_events_of_users(spark, small):
    got = sorted(map(tuple, settings_queries.reg.queries["scan_events"](spark, small).collect()))
    rows = settings_queries.listings_of_users(spark, small).orderBy("folder", "now_ms").collect()
    want, _ = by_hand([(r.folder, r.now_ms, r.what, [tuple(f) for f in r.files]) for r in rows])
    assert got == want and {e for *_, e, _ in want} == {"ready", "ignored"}


def test_state_is_read_and_written_once_a_batch():
    calls = collections.Counter()

    class Map(dict):
        def __getattr__(self, name):
            calls[name] += 1
            own = {"iterator": lambda: iter([*self.items()]), "exists": lambda: bool(self), "containsKey": self.__contains__, "updateValue": self.__setitem__, "removeKey": lambda k: self.pop(k), "clear": lambda: dict.clear(self)}
            return own[name]

    class Handle:
        def __init__(self):
            self.maps = {}

        def getMapState(self, name, *_):
            return self.maps.setdefault(name, Map())

        listTimers = lambda self: []
        registerTimer = lambda self, at: None

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 0

    tracker, handle = scans.Tracker(), Handle()
    tracker.init(handle)
    listing = lambda at, size: {"now_ms": at, "what": "listing", "files": [{"path": "a", "size_bytes": size, "mtime_ms": 0}, {"path": "b", "size_bytes": 5, "mtime_ms": 0}]}
    (events,) = tracker.handleInputRows(("f",), iter([pd.DataFrame([listing(i * 1000, i) for i in range(100)])]), Clock())
    assert [tuple(e) for e in events.values.tolist()] == [("f", "b", "ready", 2000), ("f", "a", "ignored", 60000)]
    assert set(handle.maps["pending"]) == {("b",)} and set(handle.maps["ignored"]) == {("a",)}
    assert sum(calls.values()) < 10
