"""Structured Streaming forms of the incremental behaviours (§2.11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def overlay(bids: DataFrame, key: str, time: str, bid: str) -> DataFrame:
    """Latest snapshot and highest bid of each lot: a merge that does not mind order or repeats."""
    return bids.groupBy(key).agg(F.max(time).alias("last_seen"), F.max_by(bid, F.struct(time, bid)).alias("last_bid"), F.max(bid).alias("high_bid"), F.count("*").alias("n_bids"))


def first_calls(calls: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, time: str, width: str, slide: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def changed_snapshots(bids: DataFrame, key: str, time: str, bid: str, delay: str = "1 day", quiet: str = "30 days") -> DataFrame:
    """Snapshots whose bid differs from the key's last one kept in state (X3). The rows of a key in a
    micro-batch are ordered as a whole; a snapshot older than the last one kept is passed over, and the
    state of a key goes when it has been quiet for so long."""
    idle = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, None)
        rows = []
        for t, v in pd.concat([f[[time, bid]] for f in frames]).sort_values([time, bid]).itertuples(index=False):
            if seen is not None and t.value < seen:
                continue
            if last is None or v != last:
                rows.append((k[0], t, v))
                last = float(v)
            seen = t.value
        if last is not None:
            state.update((last, seen))
            state.setTimeoutTimestamp(max(seen // 1_000_000 + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, time, bid])

    rows = bids.select(key, time, bid).withWatermark(time, delay)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {time} timestamp, {bid} double", "last double, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def velocity(bids: DataFrame, key: str, time: str, bid: str, fresh: str) -> DataFrame:
    """Change between the last two snapshots of each key and whether they are close enough in time.

    In batch by a window; as a stream (update mode) the state of a key is its two latest snapshots, so
    order and repeats don't matter."""
    seconds = pd.Timedelta(fresh).total_seconds()
    if not bids.isStreaming:
        order = W.partitionBy(key).orderBy(F.desc(time), F.desc(bid))
        rows = bids.select(key, time, bid).withColumn("_n", F.row_number().over(order)).withColumn("_then", F.lead(time).over(order)).withColumn("_was", F.lead(bid).over(order))
        gap = F.unix_timestamp(time) - F.unix_timestamp("_then")
        return rows.where("_n = 1 and _then is not null").select(key, (F.col(bid) - F.col("_was")).alias("delta"), (gap <= seconds).alias("fresh"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, None, None)
        known = [(held[i], held[i + 1]) for i in (0, 2) if held[i] is not None]
        for f in frames:
            known = sorted(known + [(t.value // 1000, float(v)) for t, v in f[[time, bid]].itertuples(index=False)], reverse=True)[:2]
        flat = [x for pair in known for x in pair]
        state.update(tuple(flat + [None] * (4 - len(flat))))
        out = [(k[0], known[0][1] - known[1][1], known[0][0] // 1_000_000 - known[1][0] // 1_000_000 <= seconds)] if len(known) == 2 else []
        yield pd.DataFrame(out, columns=[key, "delta", "fresh"])

    return bids.groupBy(key).applyInPandasWithState(step, f"{key} long, delta double, fresh boolean", "t0 long, v0 double, t1 long, v1 double", "update", GroupStateTimeout.NoTimeout)


def late_status(status: str, close: str, now: Column, grace_days: int, stale_days: int) -> Column:
    """What a lot without a result counts as (X6): live before its close, awaiting a result within the grace,
    stale up to ``stale_days``, then lost."""
    days = F.datediff(now, F.col(close))
    return F.when(F.col(status) != "upcoming", F.col(status)).when(days < 0, "live").when(days <= grace_days, "awaiting").when(days <= stale_days, "stale").otherwise("lost")


def restated(before: DataFrame, fresh: DataFrame, key: str, day: str, now: Column, horizon_days: int) -> DataFrame:
    """Results by key: a fresh one replaces a stored one within the horizon, later it only fills gaps."""
    old, new = before.alias("o"), fresh.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    open_ = F.datediff(now, F.coalesce(F.col(f"o.{day}"), F.col(f"n.{day}"))) <= horizon_days
    takes = F.col(f"n.{key}").isNotNull() & (open_ | F.col(f"o.{key}").isNull())
    return joined.select(*[F.when(takes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in before.columns])


def matched_streams(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Rows of two streams of equal key, the right one up to ``within`` after the left one (X15). Both sides
    are watermarked and the time bound lets Spark drop state."""
    a = left.withWatermark(left_time, delay).alias("a")
    b = right.withWatermark(right_time, delay).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.{right_time} >= a.{left_time} AND b.{right_time} <= a.{left_time} + INTERVAL {within}"))


def day_capped(events: DataFrame, time: str, key: str, per_minute: int, per_day: int) -> DataFrame:
    """Counts a day and key of events that pass a cap a minute and one a day (X11), over finished minutes."""
    minutes = events.groupBy(F.window(time, "1 minute").alias("w"), key).agg(F.least(F.count("*"), F.lit(per_minute)).alias("_n"))
    return minutes.groupBy(F.to_date("w.start").alias("day"), key).agg(F.least(F.sum("_n"), F.lit(per_day)).alias("counted"))


def capped_counts(events: DataFrame, time: str, key: str, per_minute: int) -> DataFrame:
    """Events counted a minute and key, at most so many (X11)."""
    return tumbling(events, time, "1 minute", [key]).withColumn("counted", F.least("n", F.lit(per_minute)))


def alerts(fresh: DataFrame, queries: DataFrame, sent: DataFrame, most: int) -> DataFrame:
    """(query, lot) of fresh rows within a query's bounds, none sent before, newest ``most`` a query."""
    from pyspark.sql import Window as W

    hits = fresh.join(queries, (fresh.category == queries.q_category) & (fresh.price.between(queries.q_low, queries.q_high)))
    new = hits.join(sent, ["query_id", "lot_id"], "left_anti")
    order = W.partitionBy("query_id").orderBy(F.desc("day"), "lot_id")
    return new.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("query_id", "lot_id")
