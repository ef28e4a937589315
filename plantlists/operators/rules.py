"""Rule tables: pipe classes, pressure categories, component choice, spare rules and what follows from them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ranges import numbered

#: Words of media (fixed values).
LIQUID = ("water", "liquid", "oil", "fuel", "hydraulic", "coolant")
GAS = ("air", "gas", "steam", "vapor", "nitrogen", "oxygen", "co2", "methane")
#: Pressure categories (fixed values): phase, fluid group, criteria, category.
PRESSURE_RULES = (
    ("Gas", "1", "(PS>0.5 AND DN>350) OR (PS>0.5 AND DN>100 AND PS*DN>3500)", "Category III"),
    ("Gas", "1", "(PS>0.5 AND 100<DN<=350 AND PS*DN<=3500) OR (25<DN<=100 AND PS*DN>1000) OR (25<DN<=350 AND 1000<PS*DN<3500)", "Category II"),
    ("Gas", "1", "(PS>0.5 AND 25<DN<=100 AND PS*DN<=1000)", "Category I"),
    ("Gas", "1", "(PS>0.5 AND DN<=25)", "Category 0"),
    ("Gas", "2", "(PS>0.5 AND DN>250 AND PS*DN>5000)", "Category III"),
    ("Gas", "2", "(PS>0.5 AND DN>250 AND 3500<PS*DN<=5000) OR (100<DN<=250 AND PS*DN>3500)", "Category II"),
    ("Gas", "2", "(PS>0.5 AND DN>32 AND 1000<PS*DN<=3500) OR (32<DN<=100 AND PS*DN>1000)", "Category I"),
    ("Gas", "2", "(PS>0.5 AND DN<=32) OR (PS>0.5 AND PS*DN<=1000)", "Category 0"),
    ("Gas", "any", "PS<=0.5", "See 5.3"),
    ("Liquid", "1", "PS>500 AND DN>25", "Category III"),
    ("Liquid", "1", "10<PS<=500 AND DN>25 AND PS*DN>2000", "Category II"),
    ("Liquid", "1", "0.5<PS<=10 AND PS*DN>2000", "Category I"),
    ("Liquid", "1", "(PS>0.5 AND DN<=25) OR (PS>0.5 AND PS*DN<=2000)", "Category 0"),
    ("Liquid", "2", "PS>500 AND DN>200", "Category II"),
    ("Liquid", "2", "10<PS<=500 AND DN>200 AND PS*DN>5000", "Category I"),
    ("Liquid", "2", "(0.5<PS<=10) OR (PS>0.5 AND DN<=200) OR (PS>0.5 AND PS*DN<=5000)", "Category 0"),
    ("Liquid", "any", "PS<=0.5", "See 5.3"),
)
CATEGORIES = ("Category III", "Category II", "Category I", "Category 0", "See 5.3")


def criteria_sql(criteria: str) -> str:
    """Criteria with chained comparisons (100<DN<=350) as a SQL condition."""
    chain = re.compile(r"([\d.]+)\s*(<=?)\s*([A-Z*]+)\s*(<=?)\s*([\d.]+)")
    out = chain.sub(r"(\1 \2 \3 AND \3 \4 \5)", criteria)
    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])", r"CAST(\1 AS DOUBLE)", out)


def categorise_by_rules(lines: DataFrame, rules: Sequence[tuple[str, str, str, str]] = PRESSURE_RULES) -> DataFrame:
    """Lines (medium, fluid_group, ps, dn) with category: the highest one whose rule for the group, or for any, holds.

    Missing or negative values and unknown media give 'Invalid Data', no rule 'Not Categorized'.
    """
    phase = text.fluid_phase(F.col("medium"), LIQUID, GAS)
    rows = lines.withColumns({"PS": F.col("ps").try_cast("double"), "DN": F.col("dn").try_cast("double"), "_phase": phase})
    holds = {c: F.lit(False) for c in CATEGORIES}
    for kind, group, criteria, category in rules:
        own = (F.col("_phase") == kind) & (F.lit(True) if group == "any" else F.trim("fluid_group") == group)
        holds[category] = holds[category] | (own & F.expr(criteria_sql(criteria)))
    out = F.lit("Not Categorized")
    for category in reversed(CATEGORIES):
        out = F.when(F.coalesce(holds[category], F.lit(False)), category).otherwise(out)
    invalid = F.col("PS").isNull() | F.col("DN").isNull() | (F.col("PS") < 0) | (F.col("DN") < 0) | (F.col("_phase") == "Unknown")
    return rows.withColumn("category", F.when(invalid, "Invalid Data").otherwise(out)).select(*lines.columns, "category")


CHECKS = ("medium", "ps", "ts", "dn", "pn", "material")


#: A list of classes with so many rows at most is broadcast; lines of a longer one are dealt into CLASS_BLOCKS blocks, each with a copy of the list.
FEW_CLASSES, CLASS_BLOCKS = 10_000, 64


def _beside_classes(lines: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Lines with what their pipe_class has in the list (column key), if anything; most lines share few classes, so a class is never one task's."""
    same = F.col("pipe_class") == F.col(key)
    if listed.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
        return lines.join(F.broadcast(listed), same, "left")
    dealt = lines.withColumn("_own", F.monotonically_increasing_id() % CLASS_BLOCKS)
    copies = listed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CLASS_BLOCKS - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), same & (F.col("_own") == F.col("_block")), "left").drop("_own", "_block")


def check_line_list(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines (all text: medium, ps, ts, dn, pn, material, pipe_class) against classes (pipe_class, medium list, pn, t_min, t_max, dn_from, dn_to, material).

    Adds check_<name> (OK, NOK, nan where a value is missing) and status: 'NOK: ...' with the failing names first, then 'nan: ...', OK, or 'class not found'.
    """
    c = F.col
    k = classes.select(*(c(x).alias(f"c_{x}") for x in classes.columns))
    rows = _beside_classes(lines, k, "c_pipe_class")
    told = lambda ok, *need: F.when(F.greatest(*(n.isNull().cast("int") for n in need), F.lit(0)) == 1, "nan").when(ok, "OK").otherwise("NOK")
    ps, ts, dn, pn = (c(x).try_cast("double") for x in ("ps", "ts")), None, text.dn_number(c("dn")), text.first_int(c("pn")).cast("double")
    ps, ts = ps
    media = F.transform(F.split("c_medium", ","), lambda m: F.trim(m))
    checks = {
        "medium": told(F.array_contains(media, F.trim("medium")), c("medium"), c("c_medium")), "ps": told(ps <= c("c_pn"), ps, c("c_pn")), "ts": told(ts.between(c("c_t_min"), c("c_t_max")), ts, c("c_t_min"), c("c_t_max")),
        "dn": told(dn.between(c("c_dn_from"), c("c_dn_to")), dn, c("c_dn_from"), c("c_dn_to")), "pn": told(F.coalesce(pn == c("c_pn"), F.lit(False)), c("pn"), c("c_pn")), "material": told(F.trim("material") == F.trim("c_material"), c("material"), c("c_material")),
    }
    rows = rows.withColumns({f"check_{n}": F.when(c("c_pipe_class").isNotNull(), x) for n, x in checks.items()})
    named = lambda state: F.array_join(F.array_compact(F.array(*(F.when(c(f"check_{n}") == state, n) for n in CHECKS))), ", ")
    parts = F.array_compact(F.array(*(F.when(named(s) != "", F.concat(F.lit(f"{s}: "), named(s))) for s in ("NOK", "nan"))))
    status = F.when(c("c_pipe_class").isNull(), "class not found").when(F.size(parts) == 0, "OK").otherwise(F.array_join(parts, "; "))
    return rows.select(*lines.columns, *(f"check_{n}" for n in CHECKS), status.alias("status"))


def pipe_class_summary(checked: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """For each class the sorted values of a column whose check is OK and NOK (a value's first row decides), counts, whether the class is known, share of OK rows."""
    first = Window.partitionBy("pipe_class", column).orderBy("row_pos")
    one = checked.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(first))
    lists = one.where("_r = 1").groupBy("pipe_class")
    pick = lambda state: F.array_join(F.sort_array(F.collect_set(F.when(F.col(f"check_{column}") == state, F.col(column)))), ", ")
    values = lists.agg(pick("OK").alias("valid"), pick("NOK").alias("invalid"))
    counts = checked.groupBy("pipe_class").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col(f"check_{column}") == "OK") / F.count("*"), 1).alias("compliance"))
    known = classes.select("pipe_class").distinct().withColumn("in_reference", F.lit(True))
    return counts.join(values, "pipe_class", "left").join(known, "pipe_class", "left").withColumn("in_reference", F.coalesce("in_reference", F.lit(False)))


def process_section_summary(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """For each process section its classes and media (sorted), counts, and the classes that the reference lacks."""
    rows = _beside_classes(lines, classes.select(F.col("pipe_class").alias("_k")).distinct(), "_k")
    join = lambda x: F.array_join(F.sort_array(F.collect_set(x)), ", ")
    return rows.groupBy("process_section").agg(join(F.col("pipe_class")).alias("classes"), join(F.col("medium")).alias("media"), F.count("*").alias("n"), F.countDistinct("pipe_class").alias("n_classes"), join(F.when(F.col("_k").isNull(), F.col("pipe_class"))).alias("unknown_classes"))


#: Blocks into which the loads of a DN are dealt when they meet its components; each block gets a copy of them.
LOAD_BLOCKS = 16


def select_component(loads: DataFrame, allowable: DataFrame) -> DataFrame:
    """Loads (id, support_type, dn, qx, qy, qz, axis) with the smallest component (by sum of capacities, first on ties) of the DN that carries them.

    allowable: dn, fax, flat, fz, support_type, component, pos. Misses say why: 'DN not found', 'DO NOT USE', 'no capacity'. Distinct loads meet distinct
    capacities of their DN, in LOAD_BLOCKS blocks of loads, and only carriers leave the join; counts are sums over the DN.
    """
    load, block = ["kind", "want", "axial", "lateral", "vertical"], F.lit(LOAD_BLOCKS)
    f = text.forces_by_axis(F.col("qx"), F.col("qy"), F.col("qz"), F.col("axis"))
    asked = loads.withColumn("f", f).select("id", F.col("support_type").alias("kind"), F.col("dn").alias("want"), "f.*")
    offered = allowable.withColumnsRenamed({"support_type": "kind", "dn": "want"})
    usable = F.coalesce(~F.upper("component").contains("DO NOT USE"), F.lit(False))
    known = offered.groupBy("kind", "want").agg(F.count("*").alias("n"), F.count_if(usable).alias("n_usable"))
    first = F.min_by("component", "pos").alias("component"), F.min("pos").alias("pos")
    offers = offered.where(usable).groupBy("kind", "want", "fax", "flat", "fz").agg(*first).withColumn("block", F.explode(F.sequence(F.lit(0), block - 1)))
    distinct = asked.select(*load).distinct()
    strong = (F.col("fax") >= F.col("axial")) & (F.col("flat") >= F.col("lateral")) & (F.col("fz") >= F.col("vertical"))
    met = distinct.withColumn("block", F.pmod(F.xxhash64(*load), block).cast("int")).join(offers.hint("merge"), ["kind", "want", "block"]).where(strong)
    best = met.groupBy(*load).agg(F.min(F.struct((F.col("fax") + F.col("flat") + F.col("fz")).alias("total"), "pos", "component")).alias("best"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(*(F.col(c).alias(f"_{c}") for c in load), *(c for c in right.columns if c not in load))
        return left.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in load)), "left").drop(*(f"_{c}" for c in load))

    judged = beside(distinct.join(known, ["kind", "want"], "left"), best)
    g = beside(asked, judged).groupBy("id").agg(F.min("best").alias("best"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_usable"), F.lit(0)).alias("n_usable"))
    miss = F.when(F.col("n") == 0, "DN not found").when(F.col("n_usable") == 0, "DO NOT USE").otherwise("no capacity")
    return g.select("id", F.col("best.component").alias("component"), F.when(F.col("best.component").isNull(), miss).alias("miss"))


@dataclass(frozen=True)
class MainSpare:
    """Thresholds of E12 (fixed values by default)."""

    seal_qty: int = 10
    seal_low: int = 5
    seal_high: int = 5
    seal_share: float = 0.10
    critical_qty: int = 10
    critical_least: int = 3
    critical_low: float = 0.50
    critical_high: float = 0.10
    first: int = 5
    second: int = 20
    size: float = 50.0
    pcs_small: float = 0.075
    pcs_large: float = 0.05
    m_small: float = 0.15
    m_large: float = 0.10
    tubi_multiple: int = 6
    seal_words: tuple[str, ...] = ("seal", "ring", "fkm")
    not_seal: tuple[str, ...] = ("elbow", "flange", "tee", "reducer")
    critical_words: tuple[str, ...] = ("nipple", "nipples", "union", "connection", "connections", "welding", "adaptor", "coupling", "threaded")
    tubi_words: tuple[str, ...] = ("tubi",)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """C4: some word is part of the text, whatever the case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def contains_all(c: Column, words: Sequence[str]) -> Column:
    """C4: every word is part of the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(True)
    for w in words:
        out = out & low.contains(w.lower())
    return out


def spare_main(rows: DataFrame, p: MainSpare | None = None) -> DataFrame:
    """Rows (description, type_label, type, qty_pcs, qty_m) with spare and rule (#1-#8b, #T1, or none), in the order seal, critical, TUBI, standard."""
    p = p or MainSpare()
    c = F.col
    pcs, m = (F.greatest(F.coalesce(c(x).cast("double"), F.lit(0.0)), F.lit(0.0)) for x in ("qty_pcs", "qty_m"))
    rows = rows.withColumns({"_q": F.when(pcs > 0, pcs).otherwise(m), "_p": pcs > 0, "_size": text.extract_numeric(c("type"))})
    q, size = c("_q"), c("_size")
    up = lambda share: F.ceil(q * F.lit(share)).cast("double")
    seal = contains_all(c("description"), p.seal_words) & ~contains_any(c("description"), p.not_seal)
    critical = contains_any(c("description"), p.critical_words)
    tubi = contains_any(c("type_label"), p.tubi_words) | contains_any(c("type"), p.tubi_words) | contains_any(c("description"), p.tubi_words)
    tubi_up = F.when((size > 0) & (size < p.size), up(p.m_small)).otherwise(up(p.m_large))
    tubi_spare = F.greatest(F.lit(0.0), text.ceil_multiple(q + tubi_up, p.tubi_multiple) - q)
    cell = lambda spare, rule: F.struct(F.lit(spare).cast("double").alias("spare") if not isinstance(spare, Column) else spare.cast("double").alias("spare"), F.lit(rule).alias("rule"))
    found = (
        F.when(q <= 0, cell(0, "none"))
        .when(seal & (q <= p.seal_qty), cell(p.seal_low, "#1"))
        .when(seal, cell(F.greatest(F.lit(float(p.seal_high)), up(p.seal_share)), "#2"))
        .when(critical & (q <= p.critical_qty), cell(F.greatest(F.lit(float(p.critical_least)), up(p.critical_low)), "#3"))
        .when(critical, cell(F.greatest(F.lit(float(p.critical_least)), up(p.critical_high)), "#4"))
        .when(tubi, cell(tubi_spare, "#T1"))
        .when(c("_p") & (q <= p.first), cell(0, "#5"))
        .when(c("_p") & (q <= p.second), cell(1, "#6"))
        .when(c("_p") & (size < p.size), cell(up(p.pcs_small), "#7a"))
        .when(c("_p"), cell(up(p.pcs_large), "#7b"))
        .when(size < p.size, cell(up(p.m_small), "#8a"))
        .otherwise(cell(up(p.m_large), "#8b"))
    )
    return rows.withColumn("_f", found).select(*[x for x in rows.columns if x not in ("_q", "_p", "_size")], "_f.*")


@dataclass(frozen=True)
class ErectionSpare:
    """Thresholds of E13 (fixed values by default)."""

    nwb: tuple[int, int, int] = (30, 100, 400)
    nwb_share: tuple[float, float, float, float] = (1.0, 0.5, 0.35, 0.2)
    gasket: tuple[int, int] = (30, 500)
    gasket_share: tuple[float, float, float] = (1.0, 0.5, 0.3)
    standard: int = 400
    standard_share: tuple[float, float] = (0.35, 0.2)
    nut_words: tuple[str, ...] = ("nut", "washer")
    bolt_words: tuple[str, ...] = ("bolt",)
    gasket_words: tuple[str, ...] = ("gasket",)


def spare_erection(rows: DataFrame, p: ErectionSpare | None = None) -> DataFrame:
    """Rows (description, qty_pcs) with spare and rule (#1-#9, #1B-#4B), in the order nuts and washers, bolts, gaskets, standard."""
    p = p or ErectionSpare()
    q = F.greatest(F.coalesce(F.col("qty_pcs").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("_q", q)
    q, d = F.col("_q"), F.col("description")
    base = lambda share: F.ceil(q * F.lit(share)).cast("double")
    cell = lambda spare, rule: F.struct(spare.cast("double").alias("spare"), F.lit(rule).alias("rule"))
    nut, bolt, gasket = (contains_any(d, w) for w in (p.nut_words, p.bolt_words, p.gasket_words))
    found = F.when(q <= 0, cell(F.lit(0.0), "none"))
    for kind, rounded, mark in ((nut, text.nut_washer_round, ""), (bolt, lambda x: text.ceil_multiple(x, 10), "B")):
        for k, share in enumerate(p.nwb_share):
            hit = kind & (q <= p.nwb[k]) if k < 3 else kind
            found = found.when(hit, cell(rounded(q + base(share)) - q, f"#{k + 1}{mark}"))
    found = found.when(gasket & (q <= p.gasket[0]), cell(base(p.gasket_share[0]), "#5"))
    found = found.when(gasket & (q <= p.gasket[1]), cell(text.ceil_multiple(q + base(p.gasket_share[1]), 10) - q, "#6")).when(gasket, cell(text.ceil_multiple(q + base(p.gasket_share[2]), 10) - q, "#7"))
    found = found.when(q < p.standard, cell(base(p.standard_share[0]), "#8")).otherwise(cell(base(p.standard_share[1]), "#9"))
    return rows.withColumn("_f", found).select(*[x for x in rows.columns if x != "_q"], "_f.*")


def _rounded(c: Column, places: int) -> Column:
    """c to so many decimal places, halves away from zero, as SQL has it: scaled first, since the shortest decimal text of a half may lie just below it (F.round goes by that text)."""
    return F.round(c * 10.0**places, 0) / 10.0**places


def order_columns(rows: DataFrame) -> DataFrame:
    """Rows (qty_pcs, qty_m, weight_kg, surface_m2, spare) with total_qty, unit_weight, weight_w_spare, surface_w_spare."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    q = F.when(zero("qty_pcs") > 0, zero("qty_pcs")).otherwise(zero("qty_m"))
    total = q + zero("spare")
    per = lambda c: F.when(q > 0, zero(c) / q).otherwise(0.0)
    return rows.withColumns({"total_qty": total, "unit_weight": _rounded(per("weight_kg"), 6), "weight_w_spare": _rounded(per("weight_kg") * total, 3), "surface_w_spare": _rounded(per("surface_m2") * total, 3)})


def align_tubi(rows: DataFrame) -> DataFrame:
    """Per size, a positive difference of paint shop total over carbon steel shop total goes to the largest shop row (first on ties).

    rows: shop ('paint' or 'cs'), size, total, row_pos. Adds added (0 elsewhere) and note; sizes without a shop row are warned of in their paint rows.
    """
    sums = rows.groupBy("size").agg(F.sum(F.when(F.col("shop") == "paint", F.col("total"))).alias("paint"), F.sum(F.when(F.col("shop") == "cs", F.col("total"))).alias("cs"))
    rank = F.row_number().over(Window.partitionBy("shop", "size").orderBy(F.desc("total"), "row_pos"))
    joined = rows.withColumn("_r", rank).join(sums, "size", "left")
    gap = F.col("paint") - F.col("cs")
    added = F.when((F.col("shop") == "cs") & (F.col("_r") == 1) & (gap > 0), F.round(gap, 3)).otherwise(0.0)
    note = F.when(F.col("paint").isNotNull() & F.col("cs").isNull(), "no shop row").when(gap > 0, "aligned to paint").when(gap < 0, "paint below shop").otherwise("")
    return joined.select(*rows.columns, added.alias("added"), note.alias("note"))


def touch_up_paint(rows: DataFrame, tubi_share: float = 0.05) -> DataFrame:
    """Surface of touch-up paint by colour, TUBI rows at 5 %, each colour's surface also counted as 'basic only'; cans by B28."""
    share = F.when(contains_any(F.col("description"), ("tubi",)), tubi_share).otherwise(1.0)
    area = F.col("surface_m2") * share
    both = rows.select(F.explode(F.array(F.struct(F.coalesce("paint_colour", F.lit("N/A")).alias("colour"), area.alias("m2")), F.struct(F.lit("basic only").alias("colour"), area.alias("m2")))).alias("x")).select("x.*")
    g = both.groupBy("colour").agg(F.round(F.sum("m2"), 6).alias("m2"))
    return g.withColumn("cans", text.paint_cans(F.col("m2")))


def blind_disks(rows: DataFrame, thickness: dict[int, float]) -> DataFrame:
    """Disks by DN of the flanges (type or description): 10 above 50 pieces, 4 above 30, else 2, with the thickness of the DN."""
    g = rows.where(contains_any(F.col("type"), ("flan",)) | contains_any(F.col("description"), ("flan",))).withColumn("dn", text.extract_numeric(F.col("size")).cast("int")).groupBy("dn").agg(F.sum("qty_pcs").alias("flanges"))
    mm = F.create_map(*[F.lit(x) for dn, t in thickness.items() for x in (dn, float(t))])
    return g.select("dn", "flanges", F.when(F.col("flanges") > 50, 10).when(F.col("flanges") > 30, 4).otherwise(2).alias("disks"), mm[F.col("dn")].alias("thickness_mm"))


def flange_guards(rows: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Flanges of the systems by (material, size, system) with spare max(1, 5 % rounded up)."""
    kept = rows.where(contains_any(F.col("type"), ("flan",)) & contains_any(F.col("system"), systems))
    g = kept.groupBy("material", "size", "system").agg(F.sum("qty_pcs").cast("double").alias("qty"))
    return g.withColumn("spare", F.greatest(F.lit(1.0), F.ceil(F.col("qty") * F.lit(0.05)).cast("double")))


#: Shop codes of unique ids (fixed values): word of the material type, number, code.
UID_CODES = (("mapress shop", 1, "MA"), ("ss shop", 2, "SS"), ("cs shop", 3, "CS"), ("erection", 4, "ER"), ("paint shop", 5, "PAS"), ("paint erection", 6, "PAE"), ("blind disks", 7, "BD"), ("orifice plates", 8, "OP"), ("flange guards", 9, "FG"))


def uid_category(material_type: Column) -> Column:
    """struct(number, code) of a material type."""
    low = F.lower(F.trim(F.coalesce(material_type, F.lit(""))))
    out = F.struct(F.lit(99).alias("number"), F.lit("OT").alias("code"))
    for word, number, code in reversed(UID_CODES):
        hit = low.contains(word) & ~low.contains("paint") if word == "erection" else low.contains(word)
        out = F.when(hit, F.struct(F.lit(number).alias("number"), F.lit(code).alias("code"))).otherwise(out)
    return out


def assign_uids(rows: DataFrame) -> DataFrame:
    """uid NN-CODE-001 by category, in order of type, material (N/A last), numeric size, size text, row_pos; few large categories spread over tasks."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    order = [low("type"), (F.upper(F.trim(F.coalesce("material", F.lit("")))) == "N/A").cast("int"), low("material"), text.extract_numeric(F.col("size")), low("size"), F.col("row_pos")]
    rows = rows.withColumn("_c", uid_category(F.col("material_type")))
    rows = numbered(rows.withColumns({"_number": F.col("_c.number"), "_code": F.col("_c.code")}), order, "_n", ["_number", "_code"])
    return rows.withColumn("uid", F.format_string("%02d-%s-%03d", F.col("_number"), F.col("_code"), F.col("_n"))).drop("_c", "_n", "_number", "_code")
