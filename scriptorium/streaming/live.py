"""Structured Streaming: activity sessions, last activity, live transcripts.

Late rows are dropped behind the watermark; state is bounded by what lies within it. Results
are appended once they are final. A stream that is over says so (``end``): its watermark then
passes all there is, and what is still open is closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def heartbeat_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, started, ended, events`` of ``events(ts, user_id)``: a gap ends a session."""
    windowed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("ended"))
    return windowed.select("user_id", F.col("s.start").alias("started"), "ended", "events")


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``started, event_type, events, users`` by tumbling window."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
    return windowed.select(F.col("w.start").alias("started"), "event_type", "events", "users")


def fold(done: list[str], texts: list[str]) -> list[str]:
    """Recogniser results in order: an extension replaces what it extends, a repeated ending is dropped."""
    for raw in texts:
        x = (raw or "").strip()
        last = done[-1].lower() if done else ""
        if not x:
            continue
        if done and x.lower().startswith(last):
            done[-1] = x
        elif not done or not last.endswith(x.lower()):
            done.append(x)
    return done


def _expire(state: GroupState, newest: int, quiet: str) -> None:
    """A state goes when the watermark is ``quiet`` past its newest row (milliseconds), not past the last watermark, which may lag far behind."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, newest + pd.Timedelta(quiet) // pd.Timedelta("1ms")))


def transcripts(results: DataFrame, quiet: str = "1 minute") -> DataFrame:
    """``session, transcript, results`` of ``results(session, seq, ts, transcript)``, updated
    as results arrive; a session's state goes after ``quiet`` without any."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, n, seen = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, -1)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        newest = int(rows["at_ms"].fillna(0).max())
        rows = rows[rows["seq"] > seen]  # what comes again, or after its successor, is stale
        if len(rows):
            done, n, seen = fold(done, list(rows["transcript"])), n + len(rows), int(rows["seq"].max())
        state.update((done, n, seen))
        _expire(state, newest, quiet)
        yield pd.DataFrame({"session": [key[0]], "transcript": [" ".join(" ".join(done).split())], "results": [n]})

    return results.withWatermark("ts", quiet).withColumn("at_ms", F.unix_millis("ts")).groupBy("session").applyInPandasWithState(
        step, "session string, transcript string, results long", "done array<string>, n long, seen long", "update", GroupStateTimeout.EventTimeTimeout
    )


class Segment(NamedTuple):
    """What a session keeps between two polls of its recording."""

    start: float = 0.0  # where the segment that is read now begins, in seconds
    done: int = 0  # segments committed
    text: str = ""  # the last reading of the open segment
    seen: int = -1  # the newest poll


#: Fixed values of the loop, in seconds: shortest segment read, silence that is skipped, silence that
#: closes a segment, longest segment, what a new segment keeps of the old one's end.
SHORTEST, SKIPPED, CLOSING, LONGEST, KEPT, BEHIND = 0.5, 3.0, 0.8, 14.0, 0.3, 0.5


def poll(state: Segment, seq: int, end: float, speech: bool, tail: float, text: str | None) -> tuple[Segment, tuple[int, float, float, str] | None]:
    """One poll: the recording is ``end`` seconds long, the open segment has ``speech`` or not and ends in
    ``tail`` seconds of silence; ``text`` is its reading, null where the recogniser was busy. Returns the
    state and the segment (number, from, to, text) that it committed. Polls that come late are dropped."""
    if seq <= state.seen:
        return state, None
    state = state._replace(seen=seq)
    length = end - state.start
    if length < SHORTEST:
        return state, None
    if not speech:  # a long silence moves the segment's start, so that it isn't read again
        return (state._replace(start=end - BEHIND) if length > SKIPPED else state), None
    if text is None:
        return state, None
    said = " ".join(text.split())
    if tail >= CLOSING or length > LONGEST:
        return state._replace(start=end - min(tail, KEPT), done=state.done + 1, text=""), (state.done, state.start, end, said)
    return state._replace(text=said), None


def segments(polls: DataFrame, quiet: str = "1 minute") -> DataFrame:
    """``session, segment, from, to, text`` of ``polls(session, seq, ts, end, speech, tail, text)``: a segment of a live
    recording is appended when 0.8 seconds of silence or 14 seconds of length close it; the one left open when
    ``quiet`` has passed without a poll. A session's state is four values, whatever it has said."""
    shape = "session string, segment int, `from` double, `to` double, text string"
    names = ["session", "segment", "from", "to", "text"]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # no session: also the row that ends the stream, which only moves the watermark
            return
        now = Segment(*state.get) if state.exists else Segment()
        if state.hasTimedOut:
            state.remove()
            if now.text:
                yield pd.DataFrame([(key[0], now.done, now.start, float("nan"), now.text)], columns=names)
            return
        out, rows = [], pd.concat(list(frames)).sort_values("seq", kind="stable")
        newest = int(rows["at_ms"].fillna(0).max())
        for r in rows.itertuples():
            now, closed = poll(now, int(r.seq), float(r.end), bool(r.speech), float(r.tail), None if pd.isna(r.text) else r.text)
            if closed:
                out.append((key[0], *closed))
        state.update(tuple(now))
        _expire(state, newest, quiet)
        if out:
            yield pd.DataFrame(out, columns=names)

    found = polls.withWatermark("ts", quiet).withColumn("at_ms", F.unix_millis("ts")).groupBy("session").applyInPandasWithState(step, shape, "start double, done int, text string, seen long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("to", F.nanvl("to", F.lit(None).cast("double")))


def with_end(rows: DataFrame, folder: str) -> DataFrame:
    """A stream joined by a second source in ``folder``, from which ``end`` says that it is over."""
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{folder}/end")
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{folder}/end"))


def end(rows: DataFrame, folder: str, ts: str = "ts") -> None:
    """No row of the stream comes any more: one row far in the future, null but for its time."""
    spark = rows.sparkSession
    last = spark.range(1).select(*[(F.lit("2262-01-01").cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    last.write.mode("append").parquet(f"{folder}/end")


def append(stream: DataFrame, folder: str) -> StreamingQuery:
    """Run ``stream`` over what is there and add what became final to ``folder``/out. A batch is a folder
    by its number, so one that is run again after a failure replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return query


def whole(rows: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """``build`` of a stream that ends with what is there."""
    stream = build(with_end(rows, folder))
    append(stream, folder)
    end(rows, folder)
    append(stream, folder)
    return rows.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> None:
    """Run ``stream`` over what is there and leave its result as Parquet in ``folder``/out. In complete mode
    all groups stay in the state: for small streams that are looked at as a whole; ``append`` is for others."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
