"""Joins over time and runs of ordered rows, without comparing every row with every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity(rows: DataFrame, key: str, start: str) -> DataFrame:
    """valid_to: the start of the key's next row (null: still valid)."""
    return rows.withColumn("valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def nearest_before_after(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value and time of the key's last row of right at or before each row's time, the first one after it,
    and the nearer of both (ties: the earlier). left and right share the names key and time.

    One sort of both sides together by key and time; keys without rows in right get nulls. Rows of right that share
    a time count as their largest value.
    """
    r = right.groupBy(key, time).agg(F.max(value).alias("_v")).withColumn("_r", F.struct(F.col(time).alias("t"), F.col("_v").alias("v"))).drop("_v")
    names = [c for c in left.columns if c not in (key, time)]
    both = left.withColumn("_l", F.lit(1)).unionByName(r.withColumn("_l", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(time, "_l")
    before = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    out = both.withColumns({"_b": before, "_a": after}).where("_l = 1")
    gap = lambda x, y: F.timestamp_diff("MICROSECOND", x, y)
    to_before, to_after = gap(F.col("_b.t"), F.col(time)), gap(F.col(time), F.col("_a.t"))
    near = F.when(F.col("_a.t").isNull() | (to_before <= to_after), F.col("_b.v")).otherwise(F.col("_a.v"))
    return out.select(key, time, *names, F.col("_b.v").alias("before"), F.col("_a.v").alias("after"), near.alias("nearest"))


def overlapping(rows: DataFrame, start: str, end: str, step_days: int, name: str) -> DataFrame:
    """rows once for each window of step_days (numbered from 1970-01-01) that the half-open [start, end) overlaps."""
    day = lambda c: F.unix_date(F.to_date(c))
    last = F.floor(day(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")) / step_days)
    return rows.where(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(F.floor(day(F.col(start)) / step_days), last)))


def sessions(rows: DataFrame, key: str, time: str, gap: Column, tie: str) -> DataFrame:
    """session: the number of the run of rows, at most gap microseconds apart, that each row is in, from 1."""
    order = Window.partitionBy(key).orderBy(time, tie)
    opens = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag(time).over(order), F.col(time)) > gap, F.lit(True))
    return rows.withColumn("_o", opens.cast("int")).withColumn("session", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def missing_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key and each whole number that is left out between two neighbours of a key."""
    seen = rows.select(key, number).distinct().withColumn("_p", F.lag(number).over(Window.partitionBy(key).orderBy(number)))
    return seen.where(F.col(number) - F.col("_p") > 1).select(key, F.explode(F.sequence(F.col("_p") + 1, F.col(number) - 1)).alias("missing"))


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by order; aggregated before it is shuffled."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def valid_on(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, day) -> DataFrame:
    """left with the columns of each row of right that has its keys and holds on a day: begun by it and not ended before
    it (a null end is open). Several such rows keep several, none gives nulls."""
    d = F.lit(day)
    return left.join(right.where((F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) >= d))), keys, "left")


def within_days(c: Column, today, days: int) -> Column:
    """From the start of a day and before the start of the one so many days later; 1 to 366."""
    if not 1 <= days <= 366:
        raise ValueError("days must be 1 to 366")
    first = F.date_trunc("day", F.lit(today).cast("timestamp"))
    return (c >= first) & (c < first + F.make_dt_interval(F.lit(days)))


def in_period(c: Column, kind: str, today, start=None, end=None, days: int | None = None) -> Column:
    """Period kinds: today, current_month, next_days and date_range (both days included)."""
    first = F.date_trunc("day", F.lit(today).cast("timestamp"))
    match kind:
        case "today":
            return (c >= first) & (c < first + F.expr("INTERVAL 1 DAY"))
        case "current_month":
            month = F.date_trunc("month", first)
            return (c >= month) & (c < month + F.expr("INTERVAL 1 MONTH"))
        case "next_days":
            return within_days(c, today, days or 0)
        case "date_range":
            if start > end:
                raise ValueError("the range ends before it starts")
            return (c >= F.lit(start)) & (c < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    raise ValueError(f"unknown period {kind}")


def calendar(year: Column, month: Column, day: Column) -> tuple[Column, Column, Column]:
    """Whether the numbers are a day of the calendar, whether the year is a leap year, and how many days its month has
    (null where there is no such month)."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).when(month.between(1, 12), 31)
    return F.coalesce(year.between(1, 9999) & (day >= 1) & (day <= days), F.lit(False)), leap, days


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], ours: tuple[str, str], theirs: tuple[str, str], width: float) -> DataFrame:
    """Each pair of rows with the same keys whose half-open intervals of numbers overlap: ours ends after theirs starts
    and starts before theirs ends.

    Both sides are dealt into windows of that width; a pair counts in the first window that both touch. Choose the width
    near the usual length, and a row meets only rows of its time, however many a key has. Empty intervals meet nothing.
    """
    (a, b), (c, d) = ours, theirs
    windows = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width).cast("long"), F.greatest(F.floor(F.col(s) / width), F.ceil(F.col(e) / width) - 1).cast("long")))
    x = left.where(F.col(b) > F.col(a)).withColumn("_w", windows(a, b))
    y = right.where(F.col(d) > F.col(c)).withColumn("_w", windows(c, d))
    first = F.floor(F.greatest(F.col(a), F.col(c)) / width).cast("long")
    return x.join(y, [*keys, "_w"]).where((F.col(b) > F.col(c)) & (F.col(a) < F.col(d)) & (F.col("_w") == first)).drop("_w")


#: Seconds of silence, and of a topic, after which a new one opens; beginnings that open one (fixed values).
SILENCE, LONG = 8.0, 120.0
CUES = r"(?i)^(teraz|następnie|kolejny temat|przejdźmy|rozdział|slajd)|^#{1,3}\s"
#: The longest that a topic may get before it is closed whatever follows (fixed value).
LONGEST = 180.0


def topics(segments: DataFrame, key: str, start: str, end: str, text: str, cues: str = CUES, silence: float = SILENCE, long: float = LONG, longest: float = LONGEST) -> DataFrame:
    """segments with topic, numbered from 1 in each source: a new one opens after silence, when the topic's segments
    already last long, or with a cue; a topic beyond longest closes.

    How long a topic already is depends on where it opened, so that part is a fold. It runs inside runs without silence
    and cues, found by a window: no source is held whole in Python, and the fold sees two numbers for each segment.
    """
    order = Window.partitionBy(key).orderBy(start, end, text)
    gap = F.col(start) - F.lag(end).over(order)
    opens = F.coalesce((gap >= silence) | F.trim(text).rlike(cues), F.lit(True))
    rows = segments.withColumn("_run", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_run").orderBy(start, end, text)))
    spans = rows.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("_n", F.greatest(F.col(end) - F.col(start), F.lit(0.0)).alias("s")))).alias("_spans"))

    def fold(state: Column, x: Column) -> Column:
        again = (F.size(state["at"]) > 0) & (state["sum"] >= min(long, longest))
        total = F.when(again, 0.0).otherwise(state["sum"]) + x["s"]
        return F.struct(total.alias("sum"), F.concat(state["at"], F.array(F.coalesce(F.try_element_at(state["at"], F.lit(-1)), F.lit(0)) + F.when(again, 1).otherwise(0))).alias("at"))

    first = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("at"))
    steps = F.transform(F.aggregate("_spans", first, fold)["at"], lambda x, i: F.struct((i + 1).alias("_n"), x.alias("_part")))
    parts = spans.select(key, "_run", F.inline(steps))
    out = rows.join(parts, [key, "_run", "_n"])
    opened = F.dense_rank().over(Window.partitionBy(key).orderBy("_run", "_part"))
    return out.withColumn("topic", opened).drop("_run", "_n", "_part")


def window_chunks(segments: DataFrame, key: str, start: str, end: str, text: str, width: float = 60.0, shared: float = 0.0) -> DataFrame:
    """key, window, begins, ends, first, last, text: the texts of all segments that overlap each window of width seconds. Windows
    follow each other, or share so many seconds with the next; the last one ends where the source's last segment does; those
    without text are left out."""
    step = width - shared
    w = F.explode(F.sequence(F.greatest(F.floor((F.col(start) - width) / step) + 1, F.lit(0)).cast("long"), F.greatest(F.ceil(F.col(end) / step) - 1, F.lit(0)).cast("long")))
    spoken = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.trim(text).alias("t"))))
    whole = segments.groupBy(key).agg(F.max(end).alias("duration"))
    rows = segments.where((F.col(end) > F.col(start)) & (F.trim(text) != "")).withColumn("window", w)
    out = rows.groupBy(key, "window").agg(F.min(start).alias("first"), F.max(end).alias("last"), spoken.alias("parts")).join(whole, key)
    begins = F.col("window") * step
    return out.select(key, "window", begins.alias("begins"), F.least(begins + width, F.col("duration")).alias("ends"), "first", "last", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def sections(lines: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """lines with section: 0 for what stands before a source's first heading, then one more with each heading."""
    by = Window.partitionBy(key).orderBy(order)
    return lines.withColumn("section", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def unexpired(rows: DataFrame, expires: str, now, stale: str | None = None, hours: float | None = None) -> DataFrame:
    """Rows that a time has not outlived: not past their end and, with stale, touched within so many hours."""
    left = rows.where(F.col(expires) > F.lit(now))
    return left if stale is None else left.where(F.col(stale) >= F.lit(now) - F.make_dt_interval(hours=F.lit(int(hours))))


def newest_first(rows: DataFrame, preferred: tuple[str, ...], *ties: str) -> DataFrame:
    """rows by the first of the preferred columns that they have, or else their first column of dates, the newest first and
    nulls last; by ties alone if there is none."""
    dates = [c for c, kind in rows.dtypes if kind in ("date", "timestamp", "timestamp_ntz")]
    by = next((c for c in (*preferred, *dates) if c in rows.columns), None)
    return rows.orderBy(*([F.desc_nulls_last(by)] if by else []), *ties)
