from __future__ import annotations

import datetime as dt
import json
import threading

import pytest

from skylattice.session import materialize, temporary_tables
from skylattice.sources import readers
from skylattice.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))


def drain(df, tmp_path, name, mode="append"):
    rows = []
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, _: rows.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows


def test_tracks_stream_without_ghosts(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    ghost = {"lat": 37.621, "lon": -122.375, "alt_baro": 5000, "gs": 200, "track": 90, "type": "tisb_other"}
    real = {**ghost, "lat": 37.62, "type": "adsb_icao", "flight": "UAL1"}
    (feed / "1.json").write_text(json.dumps({"ac": [real, ghost]}))
    raw = readers.read_track_snapshots(spark, str(feed), streaming=True)
    sink = streams.parquet_sink(str(tmp_path / "out"))
    for name in ("2.json", "3.json"):
        streams.stream_tracks(raw, sink, str(tmp_path / "cp"), once=True).awaitTermination()
        (feed / name).write_text(json.dumps({"ac": [real, ghost, {"bad": 1}]}))
    streams.stream_tracks(raw, sink, str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("snapshot_id").count().filter("count = 1").count() == 3
    assert [r.callsign for r in got.select("callsign").distinct().collect()] == ["UAL1"]


def test_last_good_poll_survives_failures(spark, tmp_path):
    schema = "device string, at timestamp, ok boolean, body string"
    (tmp_path / "in").mkdir()
    latest = streams.keep_last_good(stream_of(spark, tmp_path / "in", schema), keys=["device"], ts="at")
    got = {}
    batches = [
        [("a", T0, True, "one"), ("b", T0, False, "x")],
        [("a", T0 + dt.timedelta(seconds=3), False, "failed"), ("b", T0 + dt.timedelta(seconds=3), True, "first")],
        [("a", T0 + dt.timedelta(seconds=1), True, "older"), ("b", T0 + dt.timedelta(seconds=6), True, "second")],
    ]
    for n, rows in enumerate(batches):
        write(spark, tmp_path / "in", str(n), rows, schema)
        got.update({r.device: (r.body, r.fetch_count) for r in drain(latest, tmp_path, "good", "update")})
    assert got == {"a": ("older", 2), "b": ("second", 2)}


def test_offsets_carry_across_batches(spark, tmp_path):
    """Each batch is a run of its own: the offsets outlive the query."""
    schema = "reading_id long, site_id string, fetched_at timestamp, valid boolean, utc_offset_sec int"
    (tmp_path / "in").mkdir()
    readings = stream_of(spark, tmp_path / "in", schema)
    got = {}

    def at(i, site, valid, offset):
        return (i, site, T0 + dt.timedelta(minutes=i), valid, offset)

    batches = [[at(0, "s", True, None), at(1, "s", True, 3600), at(2, "s", True, None)], [at(3, "s", True, None), at(4, "t", True, 60)], [at(5, "s", False, 99), at(6, "s", True, 7200), at(7, "s", True, None), at(8, "t", True, None)]]
    for n, rows in enumerate(batches):
        write(spark, tmp_path / "in", str(n), rows, schema)
        sink = lambda batch, _: got.update({r.reading_id: r.offset_sec for r in batch.collect()})
        streams.carry_offsets(readings, sink, str(tmp_path / "offsets"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert got == {0: 0, 1: 3600, 2: 3600, 3: 3600, 4: 60, 5: 3600, 6: 7200, 7: 7200, 8: 60}


def test_a_repeated_batch_starts_from_the_same_offsets(spark, tmp_path):
    """The sink of the second batch fails once; the run after it takes the batch again."""
    schema = "reading_id long, site_id string, fetched_at timestamp, valid boolean, utc_offset_sec int"
    (tmp_path / "in").mkdir()
    readings = stream_of(spark, tmp_path / "in", schema)
    got, fails = {}, [False, True, False]

    def sink(batch, batch_id):
        if batch_id == 1 and fails.pop(0):
            raise RuntimeError("lost")
        got.update({r.reading_id: r.offset_sec for r in batch.collect()})

    def run():
        streams.carry_offsets(readings, sink, str(tmp_path / "offsets"), str(tmp_path / "cp"), once=True).awaitTermination()

    write(spark, tmp_path / "in", "0", [(0, "s", T0, True, 60)], schema)
    run()
    write(spark, tmp_path / "in", "1", [(1, "s", T0 + dt.timedelta(minutes=1), True, None), (2, "s", T0 + dt.timedelta(minutes=2), True, 120)], schema)
    fails[0] = True
    with pytest.raises(Exception, match="lost"):
        run()
    fails[:] = [False]
    run()
    assert got == {0: 60, 1: 60, 2: 120}


def test_an_overtaken_answer_is_dropped_across_batches(spark, tmp_path):
    """The answer of the first request comes a batch after the second request started."""
    starts, results = "key string, generation int, started_at timestamp", "key string, generation int, finished_at timestamp, body string"
    for name in ("starts", "results"):
        (tmp_path / name).mkdir()
    at = lambda s: T0 + dt.timedelta(seconds=s)
    first = ([("k", 1, at(0)), ("k", 2, at(5)), ("j", 1, at(0))], [("j", 1, at(3), "only")])
    second = ([("far", 0, at(900))], [("k", 1, at(7), "late first"), ("k", 2, at(9), "second"), ("far", 0, at(900), "")])
    seen = []
    for n, (s, r) in enumerate((first, second, ([("far", 1, at(2000))], [("far", 1, at(2000), "")]))):
        write(spark, tmp_path / "starts", str(n), s, starts)
        write(spark, tmp_path / "results", str(n), r, results)
        joined = streams.answers_in_time(stream_of(spark, tmp_path / "results", results), stream_of(spark, tmp_path / "starts", starts), keys=["key"])
        seen += [(r.key, r.body) for r in drain(joined, tmp_path, "answers") if r.key != "far"]
    assert sorted(seen) == [("j", "only"), ("k", "second")]


def test_two_streams_keep_their_own_tables(spark):
    """Each thread deletes what it materialized, and nothing of the other's."""
    ready, done = threading.Barrier(2), []

    def work(n):
        with temporary_tables(spark):
            ready.wait(60)
            assert materialize(spark.range(10)).count() == 10
        ready.wait(60)
        done.append(n)

    def reader():
        with temporary_tables(spark):
            mine = materialize(spark.range(7))
            ready.wait(60)
            ready.wait(60)  # the other thread has left its block
            done.append(mine.count())

    threads = [threading.Thread(target=work, args=(1,)), threading.Thread(target=reader)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(done) == [1, 7]


def test_superseded_answers_never_win(spark, tmp_path):
    schema = "key string, gen int, body string"
    (tmp_path / "in").mkdir()
    answers = stream_of(spark, tmp_path / "in", schema)
    seen = {}
    for n, rows in enumerate([[("k", 2, "second")], [("k", 1, "late first"), ("j", 1, "only")]]):
        write(spark, tmp_path / "in", str(n), rows, schema)
        latest = streams.discard_superseded(answers, keys=["key"], generation="gen")
        seen.update({r.key: r.body for r in drain(latest, tmp_path, "sup", "update")})
    assert seen == {"k": "second", "j": "only"}


def test_windows_sessions_and_repeats(spark, tmp_path):
    schema = "call string, ts timestamp"
    seconds = [0, 10, 40, 100]
    write(spark, tmp_path / "in", "0", [("A", T0 + dt.timedelta(seconds=s)) for s in seconds] + [("A", T0)], schema)
    write(spark, tmp_path / "in", "1", [("B", T0 + dt.timedelta(hours=1))], schema)
    write(spark, tmp_path / "in", "2", [("A", T0), ("C", T0 + dt.timedelta(hours=2))], schema)
    one_by_one = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = drain(streams.exactly_one_per_key(one_by_one, keys=["call", "ts"], ts="ts", late_seconds=36_000), tmp_path, "once")
    assert len(once) == 6
    sessions = drain(streams.track_sessions(one_by_one, keys=["call"], ts="ts"), tmp_path, "sess")
    assert sorted((r.call, r.session_start.minute * 60 + r.session_start.second, r.sightings) for r in sessions if r.call == "A") == [("A", 0, 4), ("A", 100, 1)]
    rates = drain(streams.snapshot_rates(one_by_one, ts="ts"), tmp_path, "rates")
    assert sorted((r.window_start.minute, r.fetches) for r in rates if r.window_start.hour == 0) == [(0, 4), (1, 1)]


def test_stream_static_home_join(spark, tmp_path):
    schema = "site_id string, lat double, lon double, temp_f double"
    write(spark, tmp_path / "in", "0", [("s", 1.0, 2.0, 50.0), ("s", 9.0, 2.0, 60.0)], schema)
    homes = spark.createDataFrame([("s", 1.0, 2.0)], "site_id string, lat double, lon double")
    rows = drain(streams.readings_at_current_home(stream_of(spark, tmp_path / "in", schema), homes), tmp_path, "home")
    assert [r.temp_f for r in rows] == [50.0]


def test_late_rows_are_split_and_counted(spark):
    rows = [(T0, T0 + dt.timedelta(seconds=s)) for s in (0, 10, 11, 60)]
    on_time, late = streams.split_late(spark.createDataFrame(rows, "ts timestamp, seen timestamp"), ts="ts", seen_at="seen")
    assert on_time.count() == 2
    assert streams.late_counts(late).head().asDict() == {"reason": "late", "rows": 2}
