"""Streaming operators over search events: the same plans run on batch tables.

Late rows: a watermark drops what comes after it; a batch has no late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, *more, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """user, start, end and n_events of each session: a user's events without a pause longer than the gap.

    A pause equal to the gap doesn't end a session, so windows reach a microsecond
    further; ``end`` is the gap after the last event. ``more`` are aggregates of a
    session's events. Events merge into sessions before they are shuffled.
    """
    if watermark:
        events = events.withWatermark(at, watermark)
    window = F.session_window(at, f"{gap} 1 microsecond")
    found = events.groupBy(F.col(user).alias("user"), window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), *more)
    rest = [c for c in found.columns if c not in ("user", "w", "n_events")]
    return found.select("user", F.col("w.start").alias("start"), (F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n_events", *rest)


def trending(events: DataFrame, key: str, at: str = "ts", width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Counts of each key by tumbling windows."""
    if watermark:
        events = events.withWatermark(at, watermark)
    found = events.groupBy(F.window(at, width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), "key", "n")


def rising(counts: DataFrame, previous, current, factor: float = 2.0, floor: int = 5) -> DataFrame:
    """Keys whose count rose by the factor, appeared or fell between two windows of ``trending`` counts."""
    at = lambda w: F.coalesce(F.sum(F.when(F.col("start") == F.lit(w), F.col("n"))), F.lit(0))
    both = counts.groupBy("key").agg(at(previous).alias("before"), at(current).alias("now"))
    trend = (
        F.when((F.col("before") == 0) & (F.col("now") >= floor), "newborn")
        .when((F.col("before") > 0) & (F.col("now") >= floor) & (F.col("now") >= factor * F.col("before")), "rising")
        .when((F.col("before") >= floor) & ((F.col("now") == 0) | (F.col("before") >= factor * F.col("now"))), "falling")
    )
    return both.withColumn("trend", trend).where("trend is not null")


def sliding(events: DataFrame, key: str, at: str = "ts", width: str = "1 day", slide: str = "6 hours", watermark: str | None = None) -> DataFrame:
    """Counts of each key by windows that start every ``slide`` and overlap."""
    if watermark:
        events = events.withWatermark(at, watermark)
    found = events.groupBy(F.window(at, width, slide).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), "key", "n")


def silent_users(events: DataFrame, user: str = "user_id", at: str = "ts", patience: str = "12 hours", watermark: str = "1 hour") -> DataFrame:
    """user, last and beats of users who say nothing for ``patience``, once each silence, as a stateful stream.

    A user's state is the last time and a count; an event-time timer tells when
    patience is over. For streams only: a batch has no timers.
    """
    import pandas as pd

    wait = pd.Timedelta(patience)

    def step(key, batches, state):
        last, beats = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user": [key[0]], "last": [pd.Timestamp(last, unit="us")], "beats": [beats]})
            return
        for batch in batches:
            beats += len(batch)
            last = max(last, int(batch[at].max().value // 1000))
        state.update((last, beats))
        due = last // 1000 + int(wait.total_seconds() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    keyed = events.select(F.col(user), F.col(at)).withWatermark(at, watermark).groupBy(user)
    kind = events.schema[user].dataType.simpleString()
    return keyed.applyInPandasWithState(step, f"user {kind}, last timestamp, beats long", "last long, beats long", "append", "EventTimeTimeout")
