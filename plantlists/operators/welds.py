"""Weld counting from 3-D model listings: parsing, specification lookup, connections, ends, adjacency, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..staging import staged
from .ranges import filled
from .spatial import own_pairs

#: Elements of a listing that are no components, and one that does not count as a first or last component (fixed values).
STRUCTURE = ("BRANCH", "PIPE", "ZONE", "SITE", "STRUCTURE", "SUBSTRUCTURE", "CYLINDER", "CTORUS")
ATTACHMENT = "ATTACHMENT"
#: Names that several branches have and that are broadcast; more of them are joined by a merge.
FEW_NAMES = 100_000
#: Component types that may touch (fixed values, either order).
TOUCHING_PAIRS = (
    ("ELBO", "ELBO"), ("ELBO", "REDU"), ("ELBO", "FLAN"), ("ELBO", "TEE"), ("ELBO", "CAP"), ("ELBO", "VALV"), ("TEE", "REDU"),
    ("TEE", "TEE"), ("TEE", "CAP"), ("TEE", "FLAN"), ("REDU", "FLAN"), ("REDU", "CAP"), ("REDU", "REDU"), ("REDU", "VALV"),
)


def parse_listing(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branches, components) of lines (file, line_no, line).

    'NEW PIPE /code', 'NEW BRANCH /code/B1' and 'NEW <type>' open elements (structural ones are no components); the attribute lines that follow belong to the last opened one. The state
    is carried by filled(), so a long file spreads over tasks. branches: file, branch, pipe, h*/t* positions, hcon, tcon, hstu, head_length and tail_length (to the first and
    last component with a position). components: file, branch, seq, type, spre, x, y, z.
    """
    got = lambda pattern: F.when(F.regexp_extract("line", pattern, 1) != "", F.regexp_extract("line", pattern, 1))
    rows = lines.withColumns({"new_pipe": got(r"NEW PIPE /?(\S+)"), "new_branch": got(r"NEW BRANCH /?(\S+)"), "new_part": got(r"^\s*NEW (\w+)")})
    rows = rows.withColumn("new_part", F.when(~F.col("new_part").isin("BRANCH", "PIPE"), F.col("new_part")))
    opened = F.col("new_pipe").isNotNull() | F.col("new_branch").isNotNull() | F.col("new_part").isNotNull()
    state = {
        "pipe": F.col("new_pipe"), "in_branch": F.when(F.col("new_pipe").isNotNull() | F.col("new_branch").isNotNull(), F.struct(F.col("new_branch").alias("b"))),
        "element": F.when(opened, F.col("line_no")), "part": F.when(opened, F.coalesce("new_part", F.lit("-"))),
    }
    rows = filled(rows, state, [F.col("line_no")], ["file"]).withColumn("branch", F.col("in_branch.b"))
    attribute = lambda name: F.max(F.when(F.ltrim("line").startswith(name + " "), F.trim(F.regexp_extract("line", rf"^\s*{name}\s+(.*)$", 1))))
    in_branch = rows.where("branch is not null")
    heads = in_branch.where("part = '-'").groupBy("file", "branch").agg(F.max("pipe").alias("pipe"), F.min("line_no").alias("line_no"), *(attribute(n).alias(n.lower()) for n in ("HPOS", "TPOS", "HCON", "TCON", "HSTU")))
    for end in ("h", "t"):
        xyz = text.parse_xyz(F.col(f"{end}pos"))
        heads = heads.withColumns({f"{end}{a}": xyz[a] for a in "xyz"})
    parts = in_branch.where((F.col("part") != "-") & ~F.col("part").isin(*STRUCTURE)).groupBy("file", "branch", "element").agg(F.max("part").alias("type"), F.regexp_replace(attribute("SPRE"), r"^SPCOMPONENT\s+", "").alias("spre"), attribute("POS").alias("pos"))
    at = text.parse_xyz(F.col("pos"))
    seq = F.row_number().over(Window.partitionBy("file", "branch").orderBy("element"))
    components = parts.select("file", "branch", seq.alias("seq"), "type", "spre", at["x"].alias("x"), at["y"].alias("y"), at["z"].alias("z"))
    placed = components.where(F.col("x").isNotNull() & (F.col("type") != ATTACHMENT))
    ends = placed.groupBy("file", "branch").agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("first"), F.max_by(F.struct("x", "y", "z"), "seq").alias("last"))
    branches = heads.join(ends, ["file", "branch"], "left")
    branches = branches.select("file", "branch", "pipe", "line_no", "hx", "hy", "hz", "tx", "ty", "tz", "hcon", "tcon", "hstu", _distance("h", "first").alias("head_length"), _distance("t", "last").alias("tail_length"))
    return branches, components


def _distance(end: str, point: str) -> Column:
    return F.sqrt(sum(((F.col(f"{end}{a}") - F.col(f"{point}.{a}")) ** 2 for a in "xyz"), F.lit(0.0)))


def lookup_specs(components: DataFrame, spec: DataFrame) -> DataFrame:
    """Components with their specification (the last row of an id counts), found, welds (BWD ends, OLET as one; WELD types none) and length by type."""
    one = spec.groupBy("spre").agg(F.max_by(F.struct("p1_conn", "p2_conn", F.col("type").alias("spec_type"), "pbor", "pbor1", "form"), "row_pos").alias("s")).select("spre", "s.*", F.lit(True).alias("found"))
    rows = components.join(one, "spre", "left")
    kind = F.coalesce("spec_type", F.lit(""))
    welds = F.when(kind.contains("WELD"), 0).otherwise((F.coalesce("p1_conn", F.lit("")) == "BWD").cast("int") + (F.coalesce("p2_conn", F.lit("")) == "BWD").cast("int") + (kind == "OLET").cast("int"))
    mm = lambda c: F.coalesce(F.replace(F.col(c), F.lit("mm"), F.lit("")).try_cast("double"), F.lit(0.0))
    bore, bore1, form = mm("pbor"), mm("pbor1"), F.col("form").try_cast("double")
    length = (
        F.when((kind == "ELBO") & (bore > 0), form * bore).when((kind == "TEE") & (bore > 0), 0.90 * bore).when((kind == "FLAN") & (bore > 0), 0.4 * bore)
        .when(kind == "VALV", F.when(bore > 0, 0.5 * bore).when(bore1 > 0, 0.5 * bore1)).when((kind == "REDU") & (bore1 > 0), 1.15 * bore1).when(kind == "CAP", 0.0)
    )
    return rows.withColumns({"found": F.coalesce("found", F.lit(False)), "welds": F.when(F.col("found"), welds).otherwise(0), "length": length})


def connect_branches(branches: DataFrame, tight: float = 5.0, loose: float = 150.0) -> DataFrame:
    """Tails at heads of other branches: two axes within tight, the third within loose (XY, XZ, YZ in this order), one end BWD; an unordered pair once.

    branches: branch, hx..tz, hcon, tcon, line_no (the order). Ends meet in own_pairs(), one box for each of the three kinds of match. Both rows of a pair are at hand there, so
    whether it is met the other way round, and earlier, is seen at once; only pairs of a name that several rows have are brought together.
    """
    kinds = {"XY_tight_Z_loose": ("x", "y", "z"), "XZ_tight_Y_loose": ("x", "z", "y"), "YZ_tight_X_loose": ("y", "z", "x")}
    bwd = lambda c: (F.coalesce(c, F.lit("")) == "BWD").alias(f"{c[0]}_bwd")
    rows = branches.select("branch", "line_no", *(f"{end}{a}" for end in "th" for a in "xyz"), bwd("tcon"), bwd("hcon"))
    hashed = F.xxhash64("branch").alias("_name")
    repeated = staged(rows.select(hashed).groupBy("_name").count().where("count > 1").select("_name", F.lit(True).alias("_again")), "repeated-names")
    repeats = repeated.limit(FEW_NAMES + 1).count()
    if repeats:
        marks = F.broadcast(repeated) if repeats <= FEW_NAMES else repeated.hint("merge")
        rows = rows.withColumn("_name", hashed).join(marks, "_name", "left").drop("_name").withColumn("_again", F.coalesce("_again", F.lit(False)))
        rows = rows if repeats <= FEW_NAMES else staged(rows, "marked-branches")  # own_pairs() reads them several times
    boxes = {name: [(f"t{axis}", f"h{axis}", width) for axis, width in zip(axes, (tight, tight, loose), strict=True)] for name, axes in kinds.items()}

    def match(tail: str, head: str) -> tuple[dict[str, Column], Column, Column]:
        """Distances by axis, kind of match and the greater of its tight offsets, null where there is none."""
        d = {a: F.abs(F.col(f"{tail}_t{a}") - F.col(f"{head}_h{a}")) for a in "xyz"}
        kind, worst = F.lit(None).cast("string"), F.lit(None).cast("double")
        for name, (p, q, r) in reversed(kinds.items()):
            hit = (d[p] <= tight) & (d[q] <= tight) & (d[r] <= loose)
            kind, worst = F.when(hit, name).otherwise(kind), F.when(hit, F.greatest(d[p], d[q])).otherwise(worst)
        return d, F.when(F.col(f"{tail}_t_bwd") | F.col(f"{head}_h_bwd"), kind), worst

    d, kind, worst = match("a", "b")
    met = own_pairs(rows, boxes).where(F.col("a_branch") != F.col("b_branch")).where(F.col("box") == kind)  # a pair in several boxes counts in the first
    place = lambda side: F.struct(f"{side}_line_no", f"{side}_branch")
    earlier = match("b", "a")[1].isNotNull() & (place("b") < place("a"))
    columns = [F.col("a_branch").alias("a"), F.col("b_branch").alias("b"), F.col("box").alias("match_type"), worst.alias("tight_offset"), F.round(F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2), 3).alias("distance")]
    again = F.col("a__again") | F.col("b__again") if repeats else F.lit(False)
    once = met.where(~again & ~earlier).select(*columns)
    if repeats:
        first = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("pa", "pb")
        several = met.where(again).select(*columns, F.col("a_line_no").alias("pa"), F.col("b_line_no").alias("pb"))
        once = once.unionByName(several.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*once.columns))
    accuracy = F.round(F.greatest(F.lit(0.0), 100.0 * (1 - F.col("tight_offset") / tight)), 1)
    return once.select("a", "b", "match_type", "distance", F.round("tight_offset", 3).alias("tight_offset"), accuracy.alias("accuracy"))


def components_at_ends(components: DataFrame, branches: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Components (with length) no farther from an end of their branch than half their length plus the tolerance: branch, side, seq, type, distance."""
    sides = F.array(*(F.struct(F.lit(name).alias("side"), *(F.col(f"{e}{a}").alias(f"e{a}") for a in "xyz"), F.col(f"{e}con").alias("con")) for name, e in (("HEAD", "h"), ("TAIL", "t"))))
    ends = branches.select("file", "branch", F.inline(sides))
    both = components.where("x is not null").join(ends, ["file", "branch"])
    distance = F.sqrt((F.col("x") - F.col("ex")) ** 2 + (F.col("y") - F.col("ey")) ** 2 + (F.col("z") - F.col("ez")) ** 2)
    return both.withColumn("distance", F.round(distance, 3)).where(F.col("distance") <= F.coalesce("length", F.lit(0.0)) / 2 + tolerance).select("file", "branch", "side", "con", "seq", "type", "distance")


def end_statistics(branches: DataFrame, ends: DataFrame) -> DataFrame:
    """D20, by file: BWD heads, tails and both; components_at_ends() at heads, at tails, at BWD heads and tails, and all."""
    bwd = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "BWD")
    open_ends = branches.groupBy("file").agg(bwd("hcon").alias("bwd_heads"), bwd("tcon").alias("bwd_tails"))
    at = lambda side: F.col("side") == side
    welded = F.coalesce("con", F.lit("")) == "BWD"
    numbers = {"at_heads": at("HEAD"), "at_tails": at("TAIL"), "at_bwd_heads": at("HEAD") & welded, "at_bwd_tails": at("TAIL") & welded, "at_ends": F.lit(True)}
    found = ends.groupBy("file").agg(*(F.count_if(x).alias(n) for n, x in numbers.items()))
    return open_ends.join(found, "file", "left").fillna(0, list(numbers)).withColumn("bwd_ends", F.col("bwd_heads") + F.col("bwd_tails"))


def bwd_report(branches: DataFrame, ends: DataFrame) -> DataFrame:
    """Every BWD end with the nearest component at it, or 'No'."""
    sides = F.array(F.struct(F.lit("HEAD").alias("side"), F.col("hcon").alias("con")), F.struct(F.lit("TAIL").alias("side"), F.col("tcon").alias("con")))
    wanted = branches.select("file", "branch", F.inline(sides)).where("con = 'BWD'").drop("con")
    near = ends.groupBy("file", "branch", "side").agg(F.min_by("type", F.struct("distance", "seq")).alias("type"), F.min("distance").alias("distance"))
    return wanted.join(near, ["file", "branch", "side"], "left").select("file", "branch", "side", F.coalesce("type", F.lit("No")).alias("component"), "distance")


def adjacent_components(components: DataFrame) -> DataFrame:
    """neighbouring welded components of touching types: expected distance by types, Touching (to 1.1 times), Near (to 1.5) or Separated."""
    rows = components.where((F.col("welds") > 0) & F.col("x").isNotNull())
    following = F.lead(F.struct("seq", "type", "length", "x", "y", "z")).over(Window.partitionBy("file", "branch").orderBy("seq"))
    pairs = rows.withColumn("n", following).where("n is not null")
    kinds = F.concat_ws("-", "type", F.col("n.type"))
    allowed = sorted({f"{p}-{q}" for a, b in TOUCHING_PAIRS for p, q in ((a, b), (b, a))})
    pairs = pairs.where(kinds.isin(*allowed) & F.col("length").isNotNull() & F.col("n.length").isNotNull())
    both = F.col("length") + F.col("n.length")
    a, b = F.col("type"), F.col("n.type")
    expected = F.when((a == "ELBO") & (b == "ELBO"), both).when(a == "ELBO", F.col("length")).when(b == "ELBO", F.col("n.length")).when(b == "CAP", F.col("length")).when(a == "CAP", F.col("n.length")).otherwise(both)
    distance = F.sqrt(sum(((F.col(c) - F.col(f"n.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    relation = F.when(distance <= expected * F.lit(1.10), "Touching").when(distance <= expected * F.lit(1.50), "Near").otherwise("Separated")
    return pairs.select("file", "branch", "seq", a.alias("type_a"), b.alias("type_b"), F.round(distance, 3).alias("distance"), F.round(expected, 3).alias("expected"), relation.alias("relation"))


def weld_total(components: DataFrame, branches: DataFrame, adjacent: DataFrame, ends: DataFrame) -> DataFrame:
    """E27, one row: component welds + BWD ends - touching pairs (no OLET, no FLAN-FLAN) - components at BWD ends."""
    welds = components.agg(F.coalesce(F.sum("welds"), F.lit(0)).alias("component_welds"))
    bwd = branches.agg(F.coalesce(F.sum((F.coalesce("hcon", F.lit("")) == "BWD").cast("int") + (F.coalesce("tcon", F.lit("")) == "BWD").cast("int")), F.lit(0)).alias("bwd_ends"))
    flanges = (F.col("type_a") == "FLAN") & (F.col("type_b") == "FLAN")
    touching = adjacent.where((F.col("relation") == "Touching") & ~flanges & (F.col("type_a") != "OLET") & (F.col("type_b") != "OLET")).agg(F.count("*").alias("touching"))
    at_ends = ends.where("con = 'BWD'").select("file", "branch", "side").distinct().agg(F.count("*").alias("at_ends"))
    one = welds.crossJoin(bwd).crossJoin(touching).crossJoin(at_ends)  # four tables of one row
    return one.withColumn("total", F.col("component_welds") + F.col("bwd_ends") - F.col("touching") - F.col("at_ends"))
