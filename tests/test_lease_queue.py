"""The stateful queue against a plain replay of its log."""

import json
import time
from collections import defaultdict

from quillspar.streaming import lease_queue

RUNNING, ENDED = {"analyzing", "generating", "validating"}, {"ready_for_review", "failed", "cancelled"}
FIELDS = ("queue", "seq", "action", "job", "dedup", "owner", "seconds", "state", "at")


class Plain:
    """One queue as a dictionary."""

    def __init__(self):
        self.jobs, self.known = {}, {}

    def apply(self, e, now):
        j = self.jobs.get(e["job"])
        if e["action"] == "create":
            name = e["dedup"] if e["dedup"] is not None else e["job"]
            if name in self.known:
                return self.known[name], False
            if j:
                return e["job"], False
            self.known[name] = e["job"]
            self.jobs[e["job"]] = {"state": "queued", "owner": None, "until": 0, "cancel": False, "created": now}
            return e["job"], True
        if e["action"] == "claim":
            for x in self.jobs.values():
                if x["cancel"] and x["state"] in RUNNING and x["until"] < now:
                    x["state"] = "cancelled"
            free = [(x["created"], n) for n, x in self.jobs.items() if not x["cancel"] and (x["state"] == "queued" or x["state"] in RUNNING and x["until"] < now)]
            if not free:
                return None, False
            self.jobs[min(free)[1]] |= {"state": "analyzing", "owner": e["owner"], "until": now + int(1000 * e["seconds"])}
            return min(free)[1], True
        if e["action"] == "expire":
            if not j or j["state"] not in RUNNING or j["until"] >= now:
                return e["job"], False
            j["state"] = "cancelled" if j["cancel"] else "queued"
            return e["job"], True
        if not j:
            return e["job"], False
        done = {
            "heartbeat": j["state"] in RUNNING and j["owner"] == e["owner"] and j["until"] >= now and not j["cancel"],
            "finish": j["state"] not in ENDED and j["owner"] is not None and j["owner"] == e["owner"] and e["state"] in ENDED,
            "cancel": j["state"] not in ENDED,
            "retry": j["state"] in {"failed", "cancelled"},
        }[e["action"]]
        if done and e["action"] == "heartbeat":
            j |= {"state": e["state"] if e["state"] in RUNNING else "generating", "until": now + int(1000 * e["seconds"])}
        elif done and e["action"] == "finish":
            j |= {"state": "cancelled" if j["cancel"] else e["state"], "until": 0}
        elif done and e["action"] == "cancel":
            j |= {"cancel": True, "state": "cancelled" if j["state"] == "queued" else j["state"]}
        elif done:
            j |= {"state": "queued", "owner": None, "until": 0, "cancel": False}
        return e["job"], done

    def told(self, e, now):
        job, done = self.apply(e, now)
        held = self.jobs.get(job, {"state": None, "owner": None, "until": None})
        return (e["queue"], e["seq"], e["action"], job, done, held["state"], held["owner"], held["until"], now)


def test_replay_of_a_table(spark, small):
    log = lease_queue.lease_log(spark.read.parquet(f"{small}/events.parquet"))
    queues, wanted = defaultdict(Plain), set()
    for row in sorted(log.collect(), key=lambda r: r.seq):
        wanted.add(queues[row.queue].told(row.asDict(), row.at))
    got = lease_queue.i06_lease_replay(spark, small).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    done = {(r.action, r.state) for r in got if r.done}
    assert {a for a, _ in done} == {"create", "claim", "heartbeat", "finish", "cancel", "retry"}


def test_stream_with_leases_that_expire(spark, tmp_path):
    """Three triggers; the transitions, leases that expire among them, equal a replay at the times that they state."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def send(name, *events):
        lines = [json.dumps(dict(zip(FIELDS, (q, seq, action, job, dedup, owner, seconds, state, None)))) for q, seq, action, job, dedup, owner, seconds, state in events]
        (tmp_path / name).write_text("\n".join(lines))
        (tmp_path / name).rename(source / name)

    events = spark.readStream.schema(lease_queue.EVENT).json(str(source))
    stream = lease_queue.transitions(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start(str(out))
    read = lambda: [r.asDict() for r in spark.read.schema(lease_queue.TRANSITION).parquet(str(out)).collect()] if out.exists() else []

    def wait(test):
        until = time.time() + 120
        while not test(read()):
            assert time.time() < until and stream.exception() is None, (read(), stream.exception())
            time.sleep(0.3)

    try:
        send(
            "1.json",
            ("q", 1, "create", "a", "k", None, None, None), ("q", 2, "create", "b", "k", None, None, None), ("q", 3, "create", "c", None, None, None, None),
            ("q", 4, "claim", None, None, "x", 1.0, None), ("q", 5, "claim", None, None, "y", 600.0, None), ("q", 6, "claim", None, None, "z", 600.0, None),
            ("r", 1, "create", "a", "k", None, None, None), ("r", 2, "claim", None, None, "x", 1.5, None), ("r", 3, "cancel", "a", None, None, None, None),
        )
        wait(lambda rows: sum(r["action"] == "expire" for r in rows) >= 2)
        send(
            "2.json",
            ("q", 7, "heartbeat", "a", None, "x", 600.0, "generating"), ("q", 8, "heartbeat", "c", None, "y", 600.0, "validating"), ("q", 9, "claim", None, None, "z", 600.0, None),
            ("q", 10, "finish", "a", None, "x", None, "failed"), ("q", 11, "finish", "a", None, "z", None, "failed"), ("r", 4, "retry", "a", None, None, None, None),
        )
        wait(lambda rows: any(r["queue"] == "r" and r["seq"] == 4 for r in rows))
        send("3.json", ("q", 12, "retry", "a", None, None, None, None), ("q", 13, "cancel", "c", None, None, None, None), ("q", 14, "finish", "c", None, "y", None, "ready_for_review"))
        wait(lambda rows: any(r["seq"] == 14 for r in rows))
    finally:
        stream.stop()
    rows = read()
    queues, wanted = defaultdict(Plain), []
    order = sorted(rows, key=lambda r: (r["at"], r["seq"] is None, r["seq"] or 0))
    for r in order:
        event = next((dict(zip(FIELDS, e)) for e in _sent(source) if (e[0], e[1]) == (r["queue"], r["seq"])), None) or r
        wanted.append(queues[r["queue"]].told(event, r["at"]))
    assert [tuple(r.values()) for r in order] == wanted
    state = {(r["queue"], r["job"]): r["state"] for r in order if r["job"]}
    assert state == {("q", "a"): "queued", ("q", "c"): "cancelled", ("r", "a"): "queued"}
    by_seq = {(r["queue"], r["seq"]): r for r in rows}
    assert by_seq["q", 2]["job"] == "a" and not by_seq["q", 2]["done"] and not by_seq["q", 6]["done"] and not by_seq["q", 7]["done"] and by_seq["q", 9]["job"] == "a"


def _sent(source):
    for path in source.iterdir():
        for line in path.read_text().splitlines():
            yield tuple(json.loads(line).values())


class Map:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def __getattr__(self, name):
        self.asked += 1
        return {
            "iterator": lambda: iter([((k,), v) for k, v in self.held.items()]), "containsKey": lambda k: k[0] in self.held, "getValue": lambda k: self.held[k[0]],
            "updateValue": lambda k, v: self.held.__setitem__(k[0], v), "removeKey": lambda k: self.held.pop(k[0]),
        }[name]


class Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())


def test_state_is_asked_once_an_entry_and_not_at_all_for_a_table(spark, small):
    log = sorted(lease_queue.lease_log(spark.read.parquet(f"{small}/events.parquet")).collect(), key=lambda r: r.seq)
    events = [r for r in log if r.queue == log[0].queue] * 10
    events = [lease_queue.Row(**r.asDict() | {"seq": k, "at": events[0].at + k}) for k, r in enumerate(events)]
    plain = Plain()
    wanted = [plain.told(e.asDict(), e.at) for e in events]
    for once, parts in ((True, 1), (False, 1), (False, 4)):
        handle, queue, got = Handle(), lease_queue.LeaseQueue(0, True, *([True] if once else [])), []
        queue.init(handle)
        for part in range(parts):
            got += map(tuple, queue.handleInputRows((log[0].queue,), iter(events[part * len(events) // parts : (part + 1) * len(events) // parts]), None))
        assert got == wanted
        asked = sum(m.asked for m in handle.maps.values())
        assert asked <= (0 if once else parts * 80) and (once or len(events) > 40)
