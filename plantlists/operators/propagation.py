"""Requested dates by propagation over dependencies, of all projects at once.

The rule is one of passes: a project's dependencies are gone through in order, again and again; each dates its earlier activity from its later one, or the other
way round, if one of them has a date and the other has none. So an activity is dated at a time (pass, way), and a way fires for the first time
after its source's time. The dates of all projects are found by rounds over what changed in the round before (the frontier): each way from it offers its
target a time, the least time wins, and a target whose time or date changed is in the next frontier. A round is a join of the frontier with the ways; the
rounds are as many as the longest chain of dependencies is long, however many projects and activities there are. Ways lie in buckets of their sources and
dates in buckets of their activities, as many of both, so a round shuffles nothing but the offers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged, staged_buckets
from .ranges import placed

#: Months by name (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MAX_PASSES = 100
#: A time (pass, way) is one number, pass * PASS + way; ways begin at 2, an anchor's is 0.
PASS = 1 << 56
#: Ways that a bucket holds on the average, and most buckets.
BUCKET_ROWS, MAX_BUCKETS = 500_000, 50_000
#: The reason of a project's anchor (fixed text).
ANCHOR_REASON = "Anchor milestone (reference point)"


def on_weekday(day: Column) -> Column:
    """Saturdays and Sundays become the Monday after."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))


def _day_of(words: str) -> tuple[int, int] | None:
    """Month and day of 'middle of June' (15th), 'end of June' (last day, 28 in February), or else the first; None without a month."""
    low = words.lower()
    month = next((k for k, m in enumerate(MONTHS, 1) if m in low), None)
    last = 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31
    return month and (month, 15 if "middle" in low else last if "end" in low else 1)


def _shifted(rows: DataFrame, holidays: Sequence[tuple[str, str, int]]) -> DataFrame:
    """rows (way, given, start, year) with other_date, plain, weeks, adder, label: the weekday some weeks from start, moved by the first holiday period it overlaps with a week's grace.

    Periods are those of the anchor's year and the years beside it, in this order. Each step is a column of its own, since an expression that
    names another several times works it out as often.
    """
    known = [(begin, until, adder, f"{a} to {b} holiday period") for a, b, adder in holidays if (begin := _day_of(a)) and (until := _day_of(b))]
    sign = F.when(F.col("way") % 2 == 0, -1).otherwise(1)
    moved = lambda weeks: F.date_add("start", (sign * weeks * 7).cast("int"))
    rows = rows.withColumn("_day", moved(F.col("given"))).withColumn("plain", on_weekday(F.col("_day")))
    rows = rows.withColumns({"_low": F.least("start", "plain"), "_high": F.greatest("start", "plain")})
    hit = adder = F.lit(None).cast("long")
    label = F.lit(None).cast("string")
    if known:
        date = lambda more, day: F.make_date(F.col("year") + more, F.lit(day[0]), F.lit(day[1]))
        periods = [(F.col("_low") <= F.date_add(date(more, until), 7)) & (F.col("_high") >= date(more, begin)) for more in (-1, 0, 1) for begin, until, _, _ in known]
        hit = F.coalesce(*(F.when(meets, F.lit(k % len(known))) for k, meets in enumerate(periods)))
        adder, label = F.get(F.array(*(F.lit(h[2]).cast("long") for h in known)), F.col("_hit")), F.get(F.array(*(F.lit(h[3]) for h in known)), F.col("_hit"))
    rows = rows.withColumn("_hit", hit).withColumns({"adder": adder, "label": label}).withColumn("weeks", F.col("given") + F.coalesce("adder", F.lit(0)))
    rows = rows.withColumn("_day", moved(F.col("weeks"))).withColumn("other_date", F.when(F.col("_hit").isNull(), F.col("plain")).otherwise(on_weekday(F.col("_day"))))
    return rows.drop("_day", "_low", "_high", "_hit")


def _reason() -> Column:
    """The text of a date from a way (source, comments) and its shift."""
    comments = F.when(F.trim(F.coalesce("comments", F.lit(""))) != "", F.concat(F.lit(". "), F.col("comments"))).otherwise("")
    day = F.date_format("plain", "dd/MM/yyyy")
    note = F.when(F.col("adder").isNotNull(), F.concat(F.lit(". Originally "), day, F.lit(" (based on "), F.col("given").cast("string"), F.lit("W), shifted by "), F.col("adder").cast("string"), F.lit("W due to "), F.col("label"))).otherwise("")
    return F.concat(F.col("weeks").cast("string"), F.lit("W "), _word(), F.lit(" '"), F.col("source"), F.lit("'"), comments, note)


def _word() -> Column:
    return F.when(F.col("way") % 2 == 0, "before").otherwise("after")


def _pass(time: str) -> Column:
    return F.shiftright(time, 56)


def later_anchor(dates: DataFrame, first: Sequence[str], second: Sequence[str], activity: str = "Anchor", names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """The anchor of each project (project_id, activity, date, reason): the later of two milestones, the first on ties; the one there is, if only one is.

    dates: project_id, activity, date. A milestone is the first of its names that the project has a date for (later names are fallbacks); projects with neither have no anchor.
    """
    one = dates.where("date is not null").groupBy("project_id", "activity").agg(F.min("date").alias("date"))

    def chosen(wanted: Sequence[str], c: str) -> DataFrame:
        place = F.array_position(F.array(*map(F.lit, wanted)), F.col("activity"))
        return one.where(F.col("activity").isin(*wanted)).groupBy("project_id").agg(F.min_by(F.struct("activity", "date"), place).alias(c))

    both = chosen(first, "a").join(chosen(second, "b"), "project_id", "full")
    is_first = F.col("b").isNull() | (F.col("a").isNotNull() & (F.col("a.date") >= F.col("b.date")))
    text = lambda c, k: F.concat(F.lit(f"{names[k]} "), F.col(f"{c}.activity"), F.lit(" ["), F.date_format(f"{c}.date", "dd/MM/yyyy"), F.lit("]"))
    alone = F.col("a").isNull() | F.col("b").isNull()
    reason = F.concat(F.lit("Anchor = "), F.when(is_first, text("a", 0)).otherwise(text("b", 1)), F.when(alone, " (only date)").otherwise(F.concat(F.lit(" (later than "), F.when(is_first, text("b", 1)).otherwise(text("a", 0)), F.lit(")"))))
    return both.select("project_id", F.lit(activity).alias("activity"), F.when(is_first, F.col("a.date")).otherwise(F.col("b.date")).alias("date"), reason.alias("reason"))


def _buckets(rows: DataFrame, times: int) -> int:
    """How many buckets hold the rows, each that many times."""
    return min(max(rows.sparkSession.sparkContext.defaultParallelism, times * rows.count() // BUCKET_ROWS + 1), MAX_BUCKETS)


def _ways(edges: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """Both ways of each dependency, growing in the order of a pass (even: before, odd: after), and the number of buckets of (project_id, source) they lie in.

    project_id, source, target, way, given, comments; targets that may not be dated never count.
    """
    order = [F.col(c) for c in ("row_pos", "from_activity", "to_activity", "weeks", "comments")]
    rows = placed(edges.where("weeks is not null"), order, "_n", ["project_id"])
    parts = _buckets(rows, 2)
    backward = F.struct((2 * F.col("_n") + 2).alias("way"), F.col("to_activity").alias("source"), F.col("from_activity").alias("target"))
    forward = F.struct((2 * F.col("_n") + 3).alias("way"), F.col("from_activity").alias("source"), F.col("to_activity").alias("target"))
    ways = rows.select("project_id", F.col("weeks").cast("long").alias("given"), "comments", F.inline(F.array(backward, forward))).where("source is not null")
    # activities that may be dated are hashed in as many parts as hold them, not sorted; a hash keeps a repeated one once
    allowed, keys = known.select("project_id", F.col("activity").alias("target")), ["project_id", "target"]
    ways = ways.join(allowed.repartition(max(parts, _buckets(allowed, 1)), *keys).hint("shuffle_hash"), keys, "left_semi")
    return staged_buckets(ways.repartition(parts, "project_id", "source"), "ways", ["project_id", "source"], parts), parts


def _times(ways: DataFrame, parts: int, anchors: DataFrame, holidays: Sequence[tuple[str, str, int]]) -> DataFrame:
    """project_id, activity, time, date, year of all activities that get a date, in buckets of (project_id, activity).

    Ways and dates stay in their buckets from round to round: only the frontier and its offers are shuffled, and a round hashes these, sorting nothing.
    """
    keys = ["project_id", "activity"]
    day = on_weekday(F.col("date"))
    first = anchors.where("date is not null").select(*keys, F.lit(PASS).alias("time"), day.alias("date"), F.year(day).alias("year"), F.lit(True).alias("changed"))
    state = staged_buckets(first.repartition(parts, *keys), "anchors", keys, parts)
    while not (frontier := state.where("changed")).isEmpty():
        sources = frontier.select("project_id", F.col("activity").alias("source"), "time", F.col("date").alias("start"), "year")
        offers = ways.select("project_id", "source", "target", "way", "given").join(sources.hint("shuffle_hash"), ["project_id", "source"])
        offers = offers.where(F.col("way") != F.col("time").bitwiseXOR(F.lit(1)) % PASS)  # the other way of the dependency that dated a source comes too late for whence it came
        same_pass = F.col("time") - F.col("time") % PASS + F.col("way")
        offers = offers.withColumn("time", F.when(same_pass > F.col("time"), same_pass).otherwise(same_pass + PASS)).where(F.col("time") < (MAX_PASSES + 1) * PASS)
        offers = _shifted(offers, holidays).select("project_id", F.col("target").alias("activity"), "time", "other_date", "year").repartition(parts, *keys)
        best = offers.groupBy(*keys).agg(F.min("time").alias("new_time"), F.min_by("other_date", "time").alias("new_date"), F.min_by("year", "time").alias("new_year"))
        both = state.drop("changed").join(best.hint("shuffle_hash"), keys, "full")
        # the same time is the same way, whose source may have another date now
        better = F.col("time").isNull() | (F.col("new_time") < F.col("time")) | ((F.col("new_time") == F.col("time")) & (F.col("new_date") != F.col("date")))
        both = both.withColumn("changed", F.col("new_time").isNotNull() & better)
        state = staged_buckets(both.select(*keys, *(F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("time", "date", "year")), "changed"), "dated", keys, parts)
    return state.drop("changed")


def propagation(edges: DataFrame, anchors: DataFrame, known: DataFrame, holidays: Sequence[tuple[str, str, int]] = ()) -> tuple[DataFrame, DataFrame]:
    """(dates, conflicts) of each project by passes over its dependencies in order, from its anchor, until a pass dates nothing (MAX_PASSES at most).

    edges: project_id, row_pos, from_activity, to_activity, weeks, comments; weeks that are null do not count. anchors: project_id, activity, date, one for each project, and
    maybe reason (see later_anchor()). known: project_id, activity, those that may be dated. dates: project_id, activity, date, reason, reference, weeks, direction (the
    dependency that gave the date), conflicts (how often a pass came to another date). conflicts: project_id, activity, date, other_date, reason (of the
    other date), reference, times. The first date of an activity wins. Repeated dependencies count each; null activities match nothing.
    """
    holidays = tuple(map(tuple, holidays))
    ways, parts = _ways(edges, known)
    dated = _times(ways, parts, anchors, holidays)
    sources = dated.select("project_id", F.col("activity").alias("source"), F.col("time").alias("source_time"), F.col("date").alias("start"), "year")
    targets = dated.select("project_id", F.col("activity").alias("target"), F.col("time").alias("target_time"), "date")
    fired = ways.join(sources.hint("shuffle_hash"), ["project_id", "source"]).repartition(parts, "project_id", "target").join(targets.hint("shuffle_hash"), ["project_id", "target"])
    gave = F.col("way") == F.col("target_time") % PASS
    # rows that give no date and come to no other one end here. The filter names a partition's number, which keeps it behind the shifts: before them, Spark would work them out inside it again
    fired = _shifted(fired, holidays).withColumn("_part", F.spark_partition_id()).where((gave | (F.col("other_date") != F.col("date"))) & (F.col("_part") >= 0))
    fired = staged(fired.drop("_part", "start", "year"), "fired")

    # the last pass is the one after the last that dated something
    passes = dated.groupBy("project_id").agg(F.max(F.when(F.col("time") == PASS, 0).otherwise(_pass("time"))).alias("last"))
    other = fired.where("other_date <> date").withColumn("_t", F.greatest("source_time", "target_time")).join(passes, "project_id")
    times = F.least(F.col("last") + 1, F.lit(MAX_PASSES)) - _pass("_t") + F.when(F.col("way") > F.col("_t") % PASS, 1).otherwise(0)
    conflicts = other.select("project_id", F.col("target").alias("activity"), "date", "other_date", _reason().alias("reason"), F.col("source").alias("reference"), times.cast("long").alias("times")).where("times > 0")

    given = fired.where(gave).select("project_id", F.col("target").alias("activity"), "date", _reason().alias("reason"), F.col("source").alias("reference"), "weeks", _word().alias("direction"))
    reasons = anchors.select("project_id", "activity", F.col("reason") if "reason" in anchors.columns else F.lit(ANCHOR_REASON).alias("reason"))
    start = dated.where(F.col("time") == PASS).join(reasons, ["project_id", "activity"]).select("project_id", "activity", "date", "reason", F.lit("anchor").alias("reference"), F.lit(0).cast("long").alias("weeks"), F.lit("anchor").alias("direction"))
    counts = conflicts.groupBy("project_id", "activity").agg(F.sum("times").alias("conflicts"))
    dates = start.unionByName(given).join(counts, ["project_id", "activity"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0).cast("long")))
    return dates.select("project_id", "activity", "date", "reason", "reference", "weeks", "direction", "conflicts"), conflicts


def propagate_dates(edges: DataFrame, anchors: DataFrame, known: DataFrame, holidays: Sequence[tuple[str, str, int]] = ()) -> DataFrame:
    """The dates of propagation()."""
    return propagation(edges, anchors, known, holidays)[0]

