"""Schedules: fuzzy activity matching, date propagation over dependencies, holidays, lengths; free calendar slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fuzzy import common_length, fuzzy_best_match, fuzzy_candidates, indel_ratio
from .propagation import MONTHS, propagate_dates, propagation

#: Holiday periods that go to every task, a few for each year.
MAX_PERIODS = 10_000


def _month_day(text: Column, year: Column) -> Column:
    """The date of 'middle of June' (15th), 'end of June' (last day, 28 in February), or else the first; null without a month."""
    low = F.lower(text)
    month = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(low.contains(name), k).otherwise(month)
    last = F.when(month == 2, 28).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.make_date(year, month, F.when(low.contains("middle"), 15).when(low.contains("end"), last).otherwise(1))


def holiday_periods(holidays: DataFrame, years: DataFrame) -> DataFrame:
    """Holidays (row_pos, from_text, to_text, adder_weeks) as dates in each year (column year): pos, begin, until, adder_weeks, label."""
    rows = holidays.crossJoin(years.distinct())  # both small lists
    begin, until = _month_day(F.col("from_text"), F.col("year")), _month_day(F.col("to_text"), F.col("year"))
    out = rows.select((F.col("year") * 10_000 + F.col("row_pos")).alias("pos"), begin.alias("begin"), until.alias("until"), "adder_weeks", F.concat("from_text", F.lit(" to "), "to_text", F.lit(" holiday period")).alias("label"))
    return out.where("begin is not null and until is not null")


def holiday_hit(tasks: DataFrame, periods: DataFrame) -> DataFrame:
    """Each task (id, start, finish) with the first period (by pos) that overlaps it with a week's grace after the period."""
    if periods.limit(MAX_PERIODS + 1).count() > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    on = (F.col("start") <= F.date_add("until", 7)) & (F.col("finish") >= F.col("begin"))
    hits = tasks.join(F.broadcast(periods), on, "left")  # periods: a few rows for each year
    return hits.groupBy("id", "start", "finish").agg(F.min_by(F.struct("adder_weeks", "label"), "pos").alias("h")).select("id", "start", "finish", F.coalesce("h.adder_weeks", F.lit(0)).alias("adder_weeks"), "h.label")


def current_lengths(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """Weeks (one place) between the dates of an edge's activities, and for each activity the texts of what comes before and after, by newlines.

    plan: project_id, activity, date. edges: project_id, row_pos, from_activity, to_activity.
    """
    a = plan.select("project_id", F.col("activity").alias("from_activity"), F.col("date").alias("from_date"))
    b = plan.select("project_id", F.col("activity").alias("to_activity"), F.col("date").alias("to_date"))
    rows = edges.join(a, ["project_id", "from_activity"]).join(b, ["project_id", "to_activity"]).withColumn("weeks", F.round(F.datediff("to_date", "from_date") / 7.0, 1))
    before = F.struct(F.col("from_activity").alias("activity"), "row_pos", F.lit("before").alias("side"), F.concat(F.col("weeks").cast("string"), F.lit("W before "), "to_activity").alias("text"))
    after = F.struct(F.col("to_activity").alias("activity"), "row_pos", F.lit("after").alias("side"), F.concat(F.col("weeks").cast("string"), F.lit("W after "), "from_activity").alias("text"))
    both = rows.select("project_id", F.inline(F.array(before, after)))
    texts = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("row_pos", "text")))), lambda s: s["text"]), "\n")
    return both.groupBy("project_id", "activity").agg(texts("before").alias("before"), texts("after").alias("after"))


def merge_matches(plan: DataFrame, matches: DataFrame, marks: DataFrame, dates: DataFrame) -> DataFrame:
    """P5: plan rows (project_id, row_pos, activity) with the matched target, its marks and score, and the requested date.

    matches: project_id, row_pos, target, ratio. marks: target and mark columns. dates: project_id, activity (the target), date, reason.
    """
    rows = plan.join(matches.select("project_id", "row_pos", "target", "ratio"), ["project_id", "row_pos"], "left").join(marks, "target", "left")
    return rows.join(dates.select("project_id", F.col("activity").alias("target"), "date", "reason"), ["project_id", "target"], "left")


def common_slots(freebusy: DataFrame, minutes: int = 60, begin: int = 8, end: int = 16, lunch: tuple[int, int] = (12, 14), after: str | None = None) -> DataFrame:
    """Day and start (half hours from midnight) at which all required attendees are free for the minutes; optional_free tells of the others.

    freebusy: attendee, required, day, bitmap (48 characters, 0 and 1 are free; short ones are busy at the end). Weekdays within the hours, clear of lunch. A
    required attendee without a bitmap for a day leaves the day without slots.
    """
    n = minutes // 30
    need = freebusy.where("required").select("attendee").distinct().agg(F.count("*").alias("needed"))
    starts = F.sequence(F.lit(begin * 2), F.lit(end * 2 - n))
    rows = freebusy.where(F.dayofweek("day").between(2, 6)).withColumn("bits", F.rpad(F.coalesce("bitmap", F.lit("")), 48, F.lit("2")))
    rows = rows if after is None else rows.where(F.col("day") >= F.lit(after).cast("date"))
    slots = rows.select("attendee", "required", "day", "bits", F.explode(starts).alias("slot")).where((F.col("slot") + n <= lunch[0] * 2) | (F.col("slot") >= lunch[1] * 2))
    free = F.col("bits").substr(F.col("slot") + 1, F.lit(n)).rlike(f"^[01]{{{n}}}$")
    g = slots.groupBy("day", "slot").agg(F.countDistinct(F.when(F.col("required") & free, F.col("attendee"))).alias("ok"), F.coalesce(F.bool_and(F.when(~F.col("required"), free)), F.lit(True)).alias("optional_free"))
    return g.crossJoin(F.broadcast(need)).where("ok = needed").select("day", "slot", "optional_free")  # one row
