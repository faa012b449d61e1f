"""Sessions and active users as streams: session windows under a watermark, daily sketches that unite into any span of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers; its standard error is ``ERROR``, and it is exact to a few in ten thousand for small sets.
REGISTERS = 12
ERROR = 1.04 / 2 ** (REGISTERS / 2)


def sessions(events: DataFrame, user: str, at: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """STM5: (user, start, end, events) of each session that has ended: no event of the user within ``gap`` of its last. ``end`` is the last
    event's time plus the gap. On a stream, a session is given out once the watermark has passed its end, and what comes later than
    ``late`` is left out; on a table, all sessions are given."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    s = e.filter(F.col(at).isNotNull()).groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def daily_sketches(events: DataFrame, user: str, at: str, late: str = "1 hour") -> DataFrame:
    """STM6: (day, sketch) of the distinct users of each day, of at most 2 KB however many they are; null users don't count."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    s = e.filter(F.col(at).isNotNull()).groupBy(F.window(at, "1 day").alias("w")).agg(F.hll_sketch_agg(user, REGISTERS).alias("sketch"))
    return s.select(F.to_date("w.start").alias("day"), "sketch")


def actives(sketches: DataFrame, days: int) -> DataFrame:
    """STM6: (until, actives) for each span of ``days`` days that ends at ``until`` and holds a day of the table, by uniting daily sketches: a
    user of several days counts once, and no day is read again for its users."""
    spans = F.explode(F.sequence("day", F.date_add("day", days - 1)))
    return sketches.select(spans.alias("until"), "sketch").groupBy("until").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("actives"))


def within(estimate: Column, exact: Column) -> Column:
    """Whether an estimate is within four standard errors, or one user, of the exact number."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), 4 * ERROR * exact)
