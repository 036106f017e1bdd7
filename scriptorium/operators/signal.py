"""Loudness of clips: frames, thresholds, silence, speech timing.

A clip is a row ``(clip_id, samples array<float>)``; framing is an explode and one
aggregation by (clip, frame), so long clips and many clips are the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def samples(clips: DataFrame) -> DataFrame:
    return clips.select("clip_id", F.posexplode("samples").alias("idx", "x"))


def resample(clips: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """``clip_id, idx, x``: means over blocks ``[floor(i r), floor((i + 1) r))``."""
    ratio = from_rate / to_rate
    n = F.floor(F.size("samples") / F.lit(ratio)).cast("int")

    def block(i: Column) -> Column:
        start = F.floor(i * F.lit(ratio)).cast("int")
        end = F.least(F.size("samples"), F.floor((i + 1) * F.lit(ratio)).cast("int"))
        part = F.slice("samples", start + 1, F.greatest(end - start, F.lit(0)))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(end - start, F.lit(1))

    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), block)).otherwise(F.array().cast("array<double>"))
    return clips.select("clip_id", F.posexplode(made).alias("idx", "x"))


def frame_energy(clips: DataFrame, size: int) -> DataFrame:
    """``clip_id, frame, rms``."""
    x = F.col("x").cast("double")
    return samples(clips).groupBy("clip_id", F.floor(F.col("idx") / size).cast("int").alias("frame")).agg(F.sqrt(F.avg(x * x)).alias("rms"))


def index_pick(values: Column, p: float) -> Column:
    """``sorted[floor(n p)]``: an element, never between two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * F.lit(p)).cast("int"))


def thresholds(frames: DataFrame, low: float = 0.1, high: float = 0.9, times: float = 3.0, least: float = 0.008) -> DataFrame:
    """``clip_id, frames, threshold``: above the noise floor and below half the loud level."""
    each = frames.groupBy("clip_id").agg(F.collect_list("rms").alias("e"))
    floor, loud = index_pick(F.col("e"), low), index_pick(F.col("e"), high)
    value = F.least(F.greatest(F.lit(least), floor * times), F.greatest(loud * 0.5, F.lit(least)))
    return each.select("clip_id", F.size("e").alias("frames"), value.alias("threshold"))


def speech(frames: DataFrame, frame_seconds: float = 0.03) -> DataFrame:
    """``clip_id, first_frame, last_frame, speech_seconds, trailing_silence``."""
    joined = frames.join(thresholds(frames), "clip_id")
    loud = F.col("rms") >= F.col("threshold")
    found = joined.groupBy("clip_id", "frames").agg(F.min(F.when(loud, F.col("frame"))).alias("first_frame"), F.max(F.when(loud, F.col("frame"))).alias("last_frame"), F.count_if(loud).alias("n"))
    tail = F.col("frames") - 1 - F.coalesce("last_frame", F.lit(-1))
    return found.select("clip_id", "first_frame", "last_frame", F.round(F.col("n") * frame_seconds, 6).alias("speech_seconds"), F.round(tail * frame_seconds, 6).alias("trailing_silence"))


def gain(peak: Column) -> Column:
    """Quiet clips are raised to 0.9, eightfold at most."""
    return F.when((peak > 0) & (peak < 0.5), F.least(0.9 / peak, F.lit(8.0))).otherwise(1.0)


def voice_stats(loudness: DataFrame, step: float = 0.1, pause: float = 1.5) -> DataFrame:
    """Per clip of ``(clip_id, idx, rms)``: speaking time, pauses, longest gap, steadiness."""
    held = thresholds(loudness, 0.05, 0.9, 2.5, 0.012)
    marked = loudness.join(held, "clip_id").where(F.col("rms") >= F.col("threshold"))
    per = Window.partitionBy("clip_id").orderBy("idx")
    gaps = marked.withColumn("gap", (F.col("idx") - F.lag("idx").over(per) - 1) * step)
    loud = gaps.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.count_if(F.round("gap", 6) >= pause).alias("pauses"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("longest"),
        F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("sd"),
    )
    steady = F.least(F.greatest(1 - F.col("sd") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")) / 1.2, F.lit(0.0)), F.lit(1.0))
    return held.join(loud, "clip_id", "left").select(
        "clip_id", F.round(F.col("frames") * step, 6).alias("duration_sec"), F.round(F.coalesce("n", F.lit(0)) * step, 6).alias("speaking_sec"),
        F.coalesce("pauses", F.lit(0)).alias("pauses"), F.coalesce(T.js_round(F.col("longest") * 10) / 10, F.lit(0.0)).alias("longest_pause_sec"),
        F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("avg_volume"), F.round(F.coalesce(steady, F.lit(0.0)), 6).alias("steadiness"),
    )


def speech_timing(marks: DataFrame, pause: float = 1.5) -> DataFrame:
    """Per session of ``(session, ts)``: a gap of ``pause`` seconds counts one pause and a
    second of speech; shorter gaps are speech; the first mark is worth a second."""
    order = Window.partitionBy("session").orderBy("ts")
    # in whole microseconds: exact at any size
    gap = (T.micros(F.col("ts")) - T.micros(F.lag("ts").over(order))) / F.lit(1_000_000.0)
    each = marks.withColumn("gap", F.coalesce(gap, F.lit(1.0)))
    return each.groupBy("session").agg(
        F.count("*").alias("marks"), F.count_if(F.col("gap") >= pause).alias("pauses"),
        F.round(F.sum(F.when(F.col("gap") >= pause, 1.0).otherwise(F.col("gap"))), 3).alias("speaking_sec"),
        (T.js_round(F.coalesce(F.max(F.when(F.col("gap") >= pause, F.col("gap"))), F.lit(0.0)) * 10) / 10).alias("longest_pause_sec"),
    )


def merge_voice(stats: DataFrame, by: str) -> DataFrame:
    """Recordings of one answer merged: sums, maxima and means weighted by duration."""
    d = F.col("duration_sec")
    known = F.when(F.col("steadiness").isNotNull(), d)
    return stats.groupBy(by).agg(
        F.sum(d).alias("duration_sec"), F.sum("speaking_sec").alias("speaking_sec"), F.sum("pauses").alias("pauses"), F.max("longest_pause_sec").alias("longest_pause_sec"),
        F.try_divide(F.sum(F.col("avg_volume") * d), F.sum(d)).alias("avg_volume"), F.try_divide(F.sum(F.col("steadiness") * d), F.sum(known)).alias("steadiness"),
    )
