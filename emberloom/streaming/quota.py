"""Call budgets by calendar day and month, as a batch plan and as streams.

A call is granted if the month's and then the day's budget has room, and only
granted calls use a budget up. Days and months are UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: days for which a day's count is kept.
DAY_RETENTION = 35


def calendar_keys(ts: str = "ts") -> tuple[Column, Column]:
    return F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM")


def batch_quota(calls: DataFrame, per_day: int, per_month: int, key: str = "event_id") -> DataFrame:
    """key, day, month, allowed and denied_by ('month' before 'day', null if allowed) of each call (key, ts).

    Within a day the granted calls are its first ones, so a day is decided by
    the place of its last granted call. Only the first per_day calls of a day
    (all of it if per_day is 0, for no daily budget) are ordered; the table of
    days is as long as the calendar, and calls are compared with their day's
    row without a shuffle. Calls of equal time are taken in the order of key;
    a call without a time is denied by neither budget and not allowed.
    """
    day, month = calendar_keys()
    dated = calls.select(key, "ts", day.alias("day"), month.alias("month"))
    known = dated.where("ts is not null")
    most = per_day if per_day > 0 else per_month
    first = known.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("ts", key))).where(F.col("place") <= most)
    # the month's grants before a day: what the days before it could grant, up to the month's budget
    days = known.groupBy("day", "month").agg(F.least(F.count("*"), F.lit(most)).alias("could"))
    before = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    room = days.withColumn("used", F.least(F.lit(per_month), F.coalesce(F.sum("could").over(before), F.lit(0))))
    granted = room.withColumn("granted", F.least("could", F.lit(per_month) - F.col("used")))
    last = first.join(granted.select("day", F.col("granted")), "day").where("place = granted").select("day", F.struct("ts", key).alias("last"))
    table = granted.join(last, "day", "left").select("day", "last", (F.col("used") + F.col("granted") >= per_month).alias("month_full"))
    decided = dated.join(F.broadcast(table), "day", "left")
    allowed = F.coalesce(F.struct("ts", key) <= F.col("last"), F.lit(False))
    return decided.select(
        key, "day", "month", allowed.alias("allowed"), F.when(~allowed & F.col("ts").isNotNull(), F.when(F.col("month_full"), "month").otherwise("day")).alias("denied_by")
    )


def kept_counts(granted: DataFrame, today: Column) -> DataFrame:
    """Counters of granted calls (day, month): one row a month, and one a day for DAY_RETENTION days before today."""
    months = granted.groupBy(F.col("month").alias("period")).agg(F.count("*").alias("used"))
    days = granted.where(F.col("day") >= F.date_format(F.date_sub(today, DAY_RETENTION), "yyyy-MM-dd"))
    return months.unionByName(days.groupBy(F.col("day").alias("period")).agg(F.count("*").alias("used")))


def stateful_quota(calls: DataFrame, per_day: int, per_month: int, key: str = "event_id") -> DataFrame:
    """Streaming: (key, ts) calls -> key, day, allowed, with the counts of each month as state.

    Calls of one micro-batch are taken in the order of time and key; state is
    one month's total, its day and that day's total.
    """
    day, month = calendar_keys()
    rows = calls.select(F.col(key).cast("bigint").alias(key), "ts", day.alias("day"), month.alias("month"))

    def step(group: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        of, used_day, used_month = state.get if state.exists else ("", 0, 0)
        frame = pd.concat(list(parts)).sort_values(["ts", key])
        allowed = []
        for now in frame["day"]:
            if now != of:
                of, used_day = now, 0
            grant = used_month < per_month and (per_day <= 0 or used_day < per_day)
            used_month, used_day = used_month + grant, used_day + grant
            allowed.append(bool(grant))
        state.update((of, used_day, used_month))
        yield pd.DataFrame({key: frame[key].to_numpy(), "day": frame["day"].to_numpy(), "allowed": allowed})

    return rows.groupBy("month").applyInPandasWithState(step, f"{key} bigint, day string, allowed boolean", "day string, used_day bigint, used_month bigint", "append", "NoTimeout")


def daily_counts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming: calls per day, closed when the watermark passes the day's end."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("day"), "calls")


def rate_limited(calls: DataFrame, key: str, per_window: int, length: str = "1 minute") -> DataFrame:
    """Streaming or batch: counts per key and fixed window, with those over the limit."""
    counted = calls.withWatermark("ts", length).groupBy(F.window("ts", length), key).agg(F.count("*").alias("calls"))
    return counted.select(F.col("window.start").alias("start"), key, "calls", F.greatest(F.lit(0), F.col("calls") - per_window).alias("denied"))
