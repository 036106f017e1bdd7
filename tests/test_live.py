from __future__ import annotations

import random

from pyspark.sql import functions as F

from scriptorium.streaming import live

POLLS = "session string, seq long, ts timestamp, end double, speech boolean, tail double, text string"


def recording(seed, session, n=60):
    """Polls every 0.7 seconds, some late, some repeated, some while the recogniser is busy."""
    r, out, said = random.Random(seed), [], []
    for k in range(n):
        end = round(0.7 * (k + 1), 3)
        talk = r.random() < 0.8
        if talk:
            said.append(f"w{k}")
        out.append((session, k, 1_700_000_000 + int(end), end, talk or r.random() < 0.3, r.choice([0.0, 0.1, 0.5, 0.8, 1.2]), None if r.random() < 0.15 else " ".join(said[-6:])))
    for k in (7, 20):
        out[k], out[k + 1] = out[k + 1], out[k]
    return out + [out[5], out[30]]


def folded(polls):
    state, out = live.Segment(), []
    for s, seq, _, end, speech, tail, text in sorted(polls, key=lambda p: p[1]):
        state, closed = live.poll(state, seq, end, speech, tail, text)
        if closed:
            out.append((s, *closed))
    return out + ([(polls[0][0], state.done, state.start, None, state.text)] if state.text else [])


def test_the_rules_of_a_poll():
    s = live.Segment()
    assert live.poll(s, 0, 0.4, True, 0, "a")[0].text == ""  # too short
    assert live.poll(s, 0, 3.5, False, 0, "a")[0].start == 3.0 and live.poll(s, 0, 2.0, False, 0, "a")[0].start == 0.0
    assert live.poll(s, 0, 2.0, True, 0.0, None)[0].text == ""  # busy
    now, closed = live.poll(s, 3, 2.0, True, 0.9, " one  two ")
    assert closed == (0, 0.0, 2.0, "one two") and now.start == 1.7 and now.done == 1
    assert live.poll(now, 3, 9.0, True, 0.9, "late")[1] is None
    assert live.poll(s, 0, 14.1, True, 0.0, "long")[1] and not live.poll(s, 0, 14.0, True, 0.0, "long")[1]


def test_segments_of_a_stream_equal_a_fold(spark, tmp_path):
    sessions = [recording(k, f"s{k}") for k in range(5)]
    src = tmp_path / "in"
    parts = 4
    frame = lambda rows: spark.createDataFrame(rows, POLLS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1)
    folder = str(tmp_path / "w")
    frame([]).write.parquet(str(src))
    stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(str(src))
    found = live.segments(live.with_end(stream, folder))
    for k in range(parts):  # polls arrive in several batches, each session in its order
        frame([p for s in sessions for p in s[k * len(s) // parts : (k + 1) * len(s) // parts]]).write.mode("append").parquet(str(src))
        query = live.append(found, folder)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 5
    live.end(stream, folder)
    query = live.append(found, folder)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1] == 0
    got = spark.read.schema(found.schema).parquet(f"{folder}/out").select(*found.columns).collect()
    want = []
    for s in sessions:  # in a batch polls are sorted; what a later batch repeats is dropped
        order, seen = [], -1
        for k in range(parts):
            for p in sorted(s[k * len(s) // parts : (k + 1) * len(s) // parts], key=lambda p: p[1]):
                if p[1] > seen:
                    order.append(p)
                    seen = p[1]
        want += folded(order)
    assert sorted(tuple(r) for r in got if r["to"] is not None) == sorted(w for w in want if w[3] is not None)
    assert sorted((r["session"], r["segment"], r["text"]) for r in got if r["to"] is None) == sorted((w[0], w[1], w[4]) for w in want if w[3] is None)


def test_appended_sessions_and_late_rows(spark, tmp_path):
    t0 = 1_700_000_000
    src, folder = tmp_path / "in", str(tmp_path / "w")
    put = lambda rows: spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
    put([(1, t0), (1, t0 + 100), (2, t0)])
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(src))
    found = live.heartbeat_sessions(live.with_end(stream, folder))
    live.append(found, folder)
    put([(1, t0 + 4000)])
    live.append(found, folder)
    rows = lambda: sorted((r["user_id"], r["events"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert rows() == [(1, 2), (2, 1)]  # the newest session is still open
    put([(2, t0 + 10), (3, t0 + 3990)])  # one behind the watermark, one not
    live.append(found, folder)
    live.end(stream, folder)
    live.append(found, folder)
    assert rows() == [(1, 1), (1, 2), (2, 1), (3, 1)]
