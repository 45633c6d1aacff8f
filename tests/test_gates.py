import datetime as dt
import json
import random

import pytest

from veilframe.operators import guards
from veilframe.streaming import fleet, gates

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def write(folder, name, rows):
    """Events of a file; at is seconds after the start."""
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(json.dumps(r | {"at": (START + dt.timedelta(seconds=r["at"])).isoformat()}) for r in rows))
    (folder / f".{name}").rename(folder / name)


def run(spark, make, folder, schema, out, check):
    gates.use_rocksdb(spark)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = make(events).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return [r.asDict() for r in spark.read.parquet(str(out)).collect()]


ASKS = "device_id string, at timestamp, event_id string, kind string, request_id string, approved boolean"
ms = lambda s: int(START.timestamp() * 1000 + s * 1000)


def ask(d, at, r):
    return {"device_id": d, "at": at, "event_id": f"ask-{d}-{r}", "kind": "ask", "request_id": r, "approved": None}


def answer(d, at, r, yes=True, n=0):
    return {"device_id": d, "at": at, "event_id": f"answer-{d}-{r}-{n}", "kind": "answer", "request_id": r, "approved": yes}


def test_consents_late_repeated_missing_and_after_a_restart(spark, tmp_path):
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    write(folder, "1.json", [answer("a", 10, "r1"), ask("a", 5, "r1"), ask("b", 0, "r1"), ask("c", 0, "r1"), ask("c", 30, "r2")])  # the answer stands first
    write(folder, "2.json", [answer("a", 10, "r1"), answer("b", 61, "r1"), answer("c", 31, "r1"), ask("d", 40, "r1"), ask("e", 40, "r1")])  # repeated; too late; of a stale request
    first = run(spark, gates.consent_stream, folder, ASKS, out, check)
    write(folder, "3.json", [answer("d", 100, "r1", False), {"device_id": "e", "at": 50, "event_id": "x", "kind": "cancel", "request_id": None, "approved": None}, answer("e", 55, "r1"), answer("c", 70, "r2"), ask("z", 1000, "r")])
    write(folder, "4.json", [ask("z", 5000, "r'")])
    write(folder, "5.json", [ask("a", 20, "too late for the watermark"), ask("z", 9000, "r''")])
    got = run(spark, gates.consent_stream, folder, ASKS, out, check)  # the query starts again from its checkpoint
    told = sorted((r["device_id"], r["request_id"], r["outcome"], r["settled_ms"]) for r in got if r["device_id"] != "z")
    assert told == [("a", "r1", "approved", ms(10)), ("b", "r1", "timed-out", ms(60)), ("c", "r1", "stale", ms(30)), ("c", "r2", "approved", ms(70)), ("d", "r1", "declined", ms(100)), ("e", "r1", "stale", ms(50))]
    assert len(first) < len(got) and [r["outcome"] for r in got if r["request_id"] == "r"] == ["timed-out"]


def test_the_stream_decides_as_the_batch_does(spark, tmp_path):
    draw, events = random.Random(5), []
    for d in range(12):
        at = 0
        for k in range(6):
            at += draw.choice((5, 30, 60, 61, 90))
            events.append(ask(f"d{d}", at, f"q{k}"))
            events += [answer(f"d{d}", at + draw.choice((0, 5, 30, 60, 61)), f"q{k - draw.choice((0, 0, 1))}", draw.random() < 0.5, f"{k}.{n}") for n in range(draw.choice((0, 1, 2)))]
    asks, answers = ([e for e in events if e["kind"] == kind] for kind in ("ask", "answer"))
    batch = guards.consents(
        spark.createDataFrame([(e["device_id"], e["request_id"], ms(e["at"])) for e in asks], "device_id string, request_id string, at long"),
        spark.createDataFrame([(e["device_id"], e["request_id"], ms(e["at"]), e["approved"]) for e in answers], "device_id string, request_id string, at long, approved boolean"),
    )
    draw.shuffle(events)
    for k in range(3):
        write(tmp_path / "in", f"{k}.json", events[k::3])
    write(tmp_path / "in", "8.json", [ask("z", 90_000, "end")])
    write(tmp_path / "in", "9.json", [ask("z", 99_000, "end2")])
    got = run(spark, lambda e: gates.consent_stream(e, late="1 hour"), tmp_path / "in", ASKS, tmp_path / "out", tmp_path / "check")
    assert {(r["device_id"], r["request_id"]): r["outcome"] for r in got if r["device_id"] != "z"} == {(r.device_id, r.request_id): r.outcome for r in batch.collect()}


@pytest.mark.parametrize("shuffled", [False, True])
def test_runs_end_as_their_rules_say(spark, tmp_path, shuffled):
    step = lambda r, n, sign, final=False: {"run_id": r, "at": 10 * n, "event_id": f"{r}{n}", "step": n, "signature": sign, "final": final}
    events = [step("final", 1, "a"), step("final", 2, "b", True), step("final", 3, "c"), step("again", 1, "a"), step("again", 2, "a"), step("again", 3, "b", True), *[step("long", n, f"s{n}") for n in range(1, 9)], step("short", 1, "a"), step("null", 1, None), step("null", 2, None)]
    if shuffled:
        random.Random(1).shuffle(events)
    write(tmp_path / "in", "1.json", events[::2])
    write(tmp_path / "in", "2.json", events[1::2])
    write(tmp_path / "in", "3.json", [step("z", 500, "a")])
    write(tmp_path / "in", "4.json", [step("z", 900, "a")])
    schema = "run_id string, at timestamp, event_id string, step long, signature string, final boolean"
    got = run(spark, lambda e: gates.run_stream(e, late="5 minutes"), tmp_path / "in", schema, tmp_path / "out", tmp_path / "check")
    assert sorted((r["run_id"], r["steps"], r["stop"]) for r in got if r["run_id"] != "z") == [("again", 1, "repeat"), ("final", 2, "final"), ("long", 5, "most steps"), ("null", 2, "done"), ("short", 1, "done")]


def test_a_batch_rewrites_only_the_buckets_of_its_devices(spark, tmp_path):
    path, schema = str(tmp_path / "fleet"), "device_id string, seen long, report_id long, total long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / f"fleet/data/version={v}").rglob("*.parquet"))
    assert fleet.current(spark, path) is None
    fleet.apply(spark.range(3000).selectExpr("concat('d', id) AS device_id", "1L AS seen", "id AS report_id", "id AS total"), path, buckets=16)
    fleet.apply(rows(("d5", 2, 9000, -5), ("new", 1, 9001, 1), ("d6", 0, 9002, -6)), path, buckets=16)
    got = {r.device_id: r.total for r in fleet.current(spark, path).collect()}
    assert len(got) == 3001 and got["d5"] == -5 and got["d6"] == 6 and got["new"] == 1
    assert len(list((tmp_path / "fleet/data/version=1").glob("bucket=*"))) <= 3 and size(1) < size(0) / 3
    fleet.apply(rows(), path, buckets=16)  # nothing new, nothing written
    again = rows(("d5", 2, 9000, -5), ("new", 1, 9001, 1))
    for _ in range(4):
        fleet.apply(again, path, buckets=16)  # replays change nothing, and old versions go
    assert {r.device_id: r.total for r in fleet.current(spark, path).collect()} == got
    assert sorted(p.name for p in (tmp_path / "fleet/manifest").glob("version=*")) == ["version=3", "version=4", "version=5"]
    assert not (tmp_path / "fleet/data/version=2").exists()
    orphan = tmp_path / "fleet/data/version=6/bucket=0"  # a crash before the manifest
    orphan.mkdir(parents=True)
    (orphan / "part.parquet").write_text("broken")
    fleet.apply(rows(("d7", 5, 1, -7)), path, buckets=16)
    assert {r.device_id: r.total for r in fleet.current(spark, path).collect()} == got | {"d7": -7}


def test_counts_of_windows(spark):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0), ("2024-01-01 00:10:00", "b", 8.0)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    got = {(str(r.w.start), r.event_type): (r.n, r.value) for r in fleet.windowed_counts(events).collect()}
    assert got == {("2024-01-01 00:00:00", "a"): (2, 3.0), ("2024-01-01 01:00:00", "a"): (1, 4.0), ("2024-01-01 00:00:00", "b"): (1, 8.0)}
