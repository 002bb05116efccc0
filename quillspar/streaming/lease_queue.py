"""A job queue as a stateful stream: events in, transitions out, leases that expire by themselves.

Every queue (a key of the stream) holds its jobs in state: those that are open in
one map, those that have ended in another one, whose entries go after a time to
live, as do the keys that keep a job from being created twice. A claim takes the
oldest job that is free, so two claims of one queue never get the same job: the
events of a queue meet in one task and are taken in the order of ``seq``.

A lease sets a timer. When it fires and nobody has prolonged the lease, the job is
free again and a transition says so; a job that was to be cancelled ends.

An event (queue, seq, action, job, dedup, owner, seconds, state) is one of

    create     a job, unless one of the same ``dedup`` is known
    claim      for ``owner``, for ``seconds``
    heartbeat  by the owner of a running lease, with the next ``state``
    finish     by the owner, in ``state``, or cancelled if that was asked for
    cancel     at once if queued, else when the job ends or its lease does
    retry      a job that has failed or was cancelled

and gives one transition (queue, seq, action, job, done, state, owner, until, at);
an expired lease gives one of action ``expire`` and no ``seq``. ``done`` is false
where an event is not allowed or finds no job, and changes nothing. Times are
milliseconds. With ``by_rows`` the time is the event's own column ``at``, so a log
can be replayed: leases are then looked at when the next event comes. The events
that one trigger brings for one queue are sorted in memory, so a long log is read
as a stream whose triggers are bounded. While they are taken, each entry of state
is read once at most and written once at the end, if it has changed; a table has
every queue once, so its replay has no state to read or to leave.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspar.registry import query
from quillspar.sources.tables import table

EVENT = "queue string, seq long, action string, job string, dedup string, owner string, seconds double, state string, at long"
TRANSITION = "queue string, seq long, action string, job string, done boolean, state string, owner string, until long, at long"
JOB = "state string, owner string, until long, cancel boolean, created long, dedup string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The parts of a job; the states of a job that runs, and those in which it has ended.
HELD = ("state", "owner", "until", "cancel", "created", "dedup")
RUNNING, ENDED = ("analyzing", "generating", "validating"), ("ready_for_review", "failed", "cancelled")


class _Entries:
    """A map of one queue's state while its events are taken. ``whole`` maps are read at once, others by the entry, and without a ``state`` nothing is."""

    def __init__(self, state, whole: bool = False) -> None:
        self.state, self.whole, self.changed = state, whole, set()
        self.now = {name[0]: value for name, value in state.iterator()} if state and whole else {}

    def get(self, name: str) -> tuple | None:
        if name not in self.now and self.state and not self.whole:
            self.now[name] = self.state.getValue((name,)) if self.state.containsKey((name,)) else None
        return self.now.get(name)

    def put(self, name: str, value: tuple | None) -> None:
        self.now[name] = value
        self.changed.add(name)

    def write(self) -> None:
        for name in self.changed if self.state else ():
            if self.now[name] is not None:
                self.state.updateValue((name,), self.now[name])
            elif self.state.containsKey((name,)):
                self.state.removeKey((name,))


class LeaseQueue(StatefulProcessor):
    def __init__(self, remember_ms: int, by_rows: bool, once: bool = False) -> None:
        """``once``: every queue comes once, so no state is there or needed again."""
        self.remember_ms, self.by_rows, self.once = remember_ms, by_rows, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = None if self.by_rows else self.remember_ms  # a replay's time is not the clock's
        self.maps = handle.getMapState("open", "job string", JOB), handle.getMapState("ended", "job string", JOB, kept), handle.getMapState("known", "dedup string", "job string", kept)

    def _read(self) -> None:
        opened, ended, known = (None, None, None) if self.once else self.maps
        self.open, self.ended, self.known = _Entries(opened, whole=True), _Entries(ended), _Entries(known)

    def _write(self) -> None:
        for entries in (self.open, self.ended, self.known):
            entries.write()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._read()
        clock = None if self.by_rows else timerValues.getCurrentProcessingTimeInMs()
        for event in sorted(rows, key=lambda row: row.seq):
            now = event.at if self.by_rows else clock
            job, done = getattr(self, "_" + event.action)(event, now)
            yield self._told(key[0], event.seq, event.action, job, done, now)
        self._write()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._read()
        now = timerValues.getCurrentProcessingTimeInMs()
        for job, held in self._jobs():
            if held["state"] in RUNNING and held["until"] < now:
                held["state"] = "cancelled" if held["cancel"] else "queued"
                self._put(job, held)
                yield self._told(key[0], None, "expire", job, True, now)
        self._write()

    def _told(self, queue: str, seq: int | None, action: str, job: str | None, done: bool, now: int) -> Row:
        held = self._get(job) or {"state": None, "owner": None, "until": None}
        return Row(queue=queue, seq=seq, action=action, job=job, done=done, state=held["state"], owner=held["owner"], until=held["until"], at=now)

    def _jobs(self) -> list[tuple[str, dict]]:
        return [(job, dict(zip(HELD, held))) for job, held in self.open.now.items() if held is not None]

    def _get(self, job: str | None) -> dict | None:
        held = None if job is None else self.open.get(job) or self.ended.get(job)
        return dict(zip(HELD, held)) if held is not None else None

    def _put(self, job: str, held: dict) -> None:
        """A job is in the map of its state, and only there."""
        to, other = (self.ended, self.open) if held["state"] in ENDED else (self.open, self.ended)
        to.put(job, tuple(held[name] for name in HELD))
        if other.get(job) is not None:
            other.put(job, None)

    def _lease(self, job: str, held: dict, event: Row, now: int, state: str) -> None:
        held |= {"state": state, "owner": event.owner, "until": now + int(1000 * (event.seconds or 600))}
        self._put(job, held)
        if not self.by_rows:
            self.handle.registerTimer(held["until"] + 1)

    def _create(self, event: Row, now: int) -> tuple[str | None, bool]:
        name = event.dedup if event.dedup is not None else event.job
        if (known := self.known.get(name)) is not None:
            return known[0], False
        if self._get(event.job):
            return event.job, False
        self.known.put(name, (event.job,))
        self._put(event.job, {"state": "queued", "owner": None, "until": 0, "cancel": False, "created": now, "dedup": name})
        return event.job, True

    def _claim(self, event: Row, now: int) -> tuple[str | None, bool]:
        free = []
        for job, held in self._jobs():
            expired = held["state"] in RUNNING and held["until"] < now
            if held["cancel"] and expired:
                self._put(job, held | {"state": "cancelled"})
            elif not held["cancel"] and (held["state"] == "queued" or expired):
                free.append((held["created"], job, held))
        if not free:
            return None, False
        _, job, held = min(free, key=lambda x: x[:2])
        self._lease(job, held, event, now, "analyzing")
        return job, True

    def _heartbeat(self, event: Row, now: int) -> tuple[str | None, bool]:
        held = self._get(event.job)
        if not held or held["state"] not in RUNNING or held["owner"] != event.owner or held["until"] < now or held["cancel"]:
            return event.job, False
        self._lease(event.job, held, event, now, event.state if event.state in RUNNING else "generating")
        return event.job, True

    def _finish(self, event: Row, now: int) -> tuple[str | None, bool]:
        held = self._get(event.job)
        if not held or held["state"] in ENDED or held["owner"] is None or held["owner"] != event.owner or event.state not in ENDED:
            return event.job, False
        self._put(event.job, held | {"state": "cancelled" if held["cancel"] else event.state, "until": 0})
        return event.job, True

    def _cancel(self, event: Row, now: int) -> tuple[str | None, bool]:
        held = self._get(event.job)
        if not held or held["state"] in ENDED:
            return event.job, False
        self._put(event.job, held | {"cancel": True, "state": "cancelled" if held["state"] == "queued" else held["state"]})
        return event.job, True

    def _retry(self, event: Row, now: int) -> tuple[str | None, bool]:
        held = self._get(event.job)
        if not held or held["state"] not in ("failed", "cancelled"):
            return event.job, False
        self._put(event.job, held | {"state": "queued", "owner": None, "until": 0, "cancel": False})
        return event.job, True


def transitions(events: DataFrame, remember_ms: int = 30 * 86_400_000, by_rows: bool = False) -> DataFrame:
    """The transitions of a stream of events, or of a table of them; with ``by_rows`` by the events' own times."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.streams.active  # the session's manager of streams keeps the places of state, for tables too
    return events.groupBy("queue").transformWithState(LeaseQueue(remember_ms, by_rows, by_rows and not events.isStreaming), TRANSITION, "Append", "None" if by_rows else "ProcessingTime")


def lease_log(events: DataFrame) -> DataFrame:
    """The table of events read as a log: a user has a queue of seven jobs, worked on by three owners."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    action = (
        F.when(F.col("event_id") % 11 == 0, "cancel").when(kind == "signup", "create").when(kind == "view", "claim").when(kind == "purchase", "finish")
        .when(kind == "error", "retry").otherwise("heartbeat")
    )
    number = F.crc32(F.col("event_id").cast("string"))
    return events.select(
        F.col("user_id").cast("string").alias("queue"), F.col("event_id").cast("long").alias("seq"), action.alias("action"), (number % 7).cast("string").alias("job"),
        F.lit(None).cast("string").alias("dedup"), (number % 3).cast("string").alias("owner"), F.lit(43_200.0).alias("seconds"),
        F.when(number % 2 == 0, "failed").otherwise("ready_for_review").alias("state"), millis.alias("at"),
    )


@query("i06_lease_replay")
def i06_lease_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(lease_log(table(spark, sf_dir, "events")), by_rows=True)
