"""Bills of material to order sheets: routing, grouping, bar packing, tape rolls, spare, folding, totals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..staging import staged
from .ranges import numbered

#: Material types: label, prefixes, keywords (fixed values; prefixes of all rules go before keywords).
MATERIAL_RULES = (
    ("04 Beam Sections", ("TP F", "FLS", "MS"), ("channel", "rail", "profile", "beam section ms", "beam section tp")),
    ("02 Brackets Consoles", ("WD F", "WBD", "SA F"), ("bracket", "console", "base", "pivot joint", "connector", "mounting angle", "beam clip", "beam connection", "holder", "eye", "plate", "end support", "adapter", "joining")),
    ("01 Primary Supports", ("Stabil", "Ratio"), ("clamp", "hanger", "pipe clamp", "assembly set", "fixed point", "guided", "sliding", "guiding", "assembly", "axial", "threaded rod")),
    ("03 Bolts Screws Nuts", ("HZM", "SK", "Formlock"), ("bolt", "screw", "nut", "washer", "resin anchor")),
    ("05 Installation Material", (), ("glass fabric", "end cap")),
)
#: Spare shares by material type (fixed values).
SPARE_SHARE = {
    "01 Primary Supports": 0.05, "02 Brackets Consoles": 0.05, "03 Bolts Screws Nuts": 0.15, "05 Installation Material": 0.15,
    "06 Primary Supports C5": 0.05, "07 Brackets Consoles C5": 0.05, "08 Bolts Screws Nuts C5": 0.15, "10 Installation Material C5": 0.15,
}
#: Material types of coating C5 (fixed values).
C5_TYPES = {
    "01 Primary Supports": "06 Primary Supports C5", "02 Brackets Consoles": "07 Brackets Consoles C5", "03 Bolts Screws Nuts": "08 Bolts Screws Nuts C5",
    "04 Beam Sections": "09 Beam Sections C5", "05 Installation Material": "10 Installation Material C5",
}
#: Groups of pieces that a task holds as Python objects at a time.
GROUPS_AT_ONCE = 64
KERF_MM, BEAM_MM, TAPE_ROLL_M, TAPE_FACTOR, ORDER_FACTOR = 3, 6000, 10, 1.30, 1.05
SHEET = (
    "material_type string, article_number long, description string, qty long, total_weight_kg double, remarks string, coating string, spare long, order_qty long, "
    "order_weight_kg double, net_cut_length_m double, net_cut_weight_kg double, total_order_length_m double, utilisation_pct double, rule string, row_pos long"
)


def remap_coating(material_type: Column, coating: Column) -> Column:
    """Material types 01-05 of a C5 coating become 06-10."""
    mapped = F.create_map(*[F.lit(x) for pair in C5_TYPES.items() for x in pair])
    return F.when(F.coalesce(coating, F.lit("")).contains("C5"), F.coalesce(mapped[material_type], material_type)).otherwise(material_type)


def spare_share(material_type: Column, description: Column) -> Column:
    shares = F.create_map(*[F.lit(x) for pair in SPARE_SHARE.items() for x in pair])
    channel = material_type.isin("04 Beam Sections", "09 Beam Sections C5") & F.lower(F.coalesce(description, F.lit(""))).contains("channel")
    return F.when(channel, 0.05).otherwise(F.coalesce(shares[material_type], F.lit(0.0)))


def spare_quantity(qty: Column, share: Column) -> Column:
    """5 % only from ten pieces on, other shares always; rounded up."""
    return F.when((share == 0) | (qty == 0) | ((share == 0.05) & (qty < 10)), 0).otherwise(F.ceil(qty.cast("double") * share)).cast("long")


def _rule_text(qty: Column, share: Column, spare: Column) -> Column:
    """The spare rule as text (fixed wording, which readers of order sheets search for)."""
    percent = F.round(share * 100).cast("int").cast("string")
    few = F.concat(F.lit("5% spare: qty "), qty.cast("string"), F.lit(" < 10 → 0 spare"))
    full = F.concat(percent, F.lit("% spare: ceil("), qty.cast("string"), F.lit(" × "), share.cast("string"), F.lit(") = "), spare.cast("string"))
    return F.when(share == 0, "No spare").when((share == 0.05) & (qty < 10), few).otherwise(full)


def routed(raw: DataFrame) -> DataFrame:
    """Raw rows (row_pos, item_number, qty, description, cut_length_mm, total_weight_kg, remarks, coating) with material_type, clean description and route.

    Routes: beam, rod, tape (to be packed or rolled), bracket, standard (to be grouped), individual.
    """
    c = F.col
    cut, low, clean_low = c("cut_length_mm").isNotNull(), F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("clean", F.lit("")))

    def route(kind: Column) -> Column:
        return (
            F.when((kind == "04 Beam Sections") & cut & clean_low.rlike("beam section (ms|tp)"), "beam")
            .when((kind == "01 Primary Supports") & cut & low.contains("threaded rod"), F.when(text.rod_length(c("description")) > 0, "rod").otherwise("individual"))
            .when((kind == "05 Installation Material") & cut & low.contains("glass fabric"), "tape")
            .when(kind == "02 Brackets Consoles", F.when(low.contains("angled"), "individual").otherwise("bracket"))
            .when(cut, "individual")
            .otherwise("standard")
        )

    strip = lambda kind: kind.isin("04 Beam Sections", "02 Brackets Consoles") & c("description").contains(" x ")
    # type, clean description and route in one struct: what follows filters by its fields, and no plan copies the classification into each use
    rows = raw.withColumn("kind", text.once(text.classify_by_rules(c("description"), MATERIAL_RULES), lambda k: F.struct(k.alias("material_type"), F.when(strip(k), text.strip_cut_length(c("description"))).otherwise(c("description")).alias("clean"))))
    rows = rows.select("*", "kind.*").drop("kind")
    return rows.withColumn("route", text.once(c("material_type"), route))


def _sheet(df: DataFrame, **columns: Column) -> DataFrame:
    cells = [f.strip().rsplit(" ", 1) for f in SHEET.split(",")]
    return df.select(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in cells))


def _sum_weight(c: str = "total_weight_kg") -> Column:
    return F.round(F.sum(c), 2)


def _exact_sum(c: str) -> Column:
    """The sum of weights to ten decimals, the same in whatever order rows come; of doubles, where one of them is no such decimal (infinite, 10^18 or more)."""
    exact = F.col(c).try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(c), F.sum(exact).cast("double")).otherwise(F.sum(c))


def _with_spare(df: DataFrame, description: str = "description") -> DataFrame:
    share = spare_share(F.col("material_type"), F.col(description))
    df = df.withColumn("share", share).withColumn("spare_n", spare_quantity(F.col("qty"), F.col("share"))).withColumn("order_n", F.col("qty") + F.col("spare_n"))
    weight = F.when((F.col("weight") != 0) & (F.col("qty") != 0), F.round(F.col("weight") * F.col("order_n") / F.col("qty"), 2)).otherwise(F.col("weight"))
    return df.withColumns({"order_weight": weight, "rule": _rule_text(F.col("qty"), F.col("share"), F.col("spare_n"))})


def grouped_standard(rows: DataFrame) -> DataFrame:
    """Standard rows by (article, coating): sums, first description and type, distinct remarks in order, spare by type."""
    keys = ["item_number", "coating"]
    per = rows.where("route = 'standard'").groupBy(*keys, F.when(F.col("remarks") != "", F.col("remarks")).alias("remark")).agg(
        F.sum(F.coalesce("qty", F.lit(0))).alias("q"), F.sum("total_weight_kg").alias("w"), F.min("row_pos").alias("p"), F.min_by(F.struct("description", "material_type"), "row_pos").alias("head")
    )
    remarks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("remark").isNotNull(), F.struct("p", "remark")))), lambda s: s["remark"]), " | ")
    g = per.groupBy(*keys).agg(F.sum("q").alias("qty"), F.round(F.sum("w"), 2).alias("weight"), F.min("p").alias("row_pos"), F.min_by("head", "p").alias("head"), remarks.alias("remarks"))
    g = _with_spare(g.select(*keys, "qty", "weight", "row_pos", "remarks", "head.*"))
    c = F.col
    return _sheet(g, material_type=c("material_type"), article_number=c("item_number"), description=c("description"), qty=c("qty"), total_weight_kg=c("weight"), remarks=F.when(c("remarks") != "", c("remarks")), coating=c("coating"),
                  spare=F.when(c("share") != 0, c("spare_n")), order_qty=c("order_n"), order_weight_kg=c("order_weight"), rule=c("rule"), row_pos=c("row_pos"))


def grouped_brackets(rows: DataFrame) -> DataFrame:
    """Brackets by (article, coating, clean description), cut lengths and remarks cleared."""
    g = rows.where("route = 'bracket'").groupBy("item_number", "coating", F.coalesce("clean", F.lit("")).alias("description"), "material_type")
    g = _with_spare(g.agg(F.sum(F.coalesce("qty", F.lit(0))).alias("qty"), _sum_weight().alias("weight"), F.min("row_pos").alias("row_pos")))
    c = F.col
    return _sheet(g, material_type=c("material_type"), article_number=c("item_number"), description=c("description"), qty=c("qty"), total_weight_kg=c("weight"), coating=c("coating"), spare=c("spare_n"),
                  order_qty=c("order_n"), order_weight_kg=c("order_weight"), rule=c("rule"), row_pos=c("row_pos"))


def bar_runs(pieces: list[tuple[int, int]], bar: int, kerf: int = KERF_MM) -> list[tuple[int, int, tuple]]:
    """First-fit decreasing over (length, count) in descending order: runs of equal bars, in order, as (rest, bars, ((length, count), ...)).

    Equal pieces fill the bars in order, each bar with as many as fit, which gives the bars that one piece at a time would. A run
    is filled as a whole, so a length adds two runs at most however many pieces and bars there are.
    """
    runs: list[tuple[int, int, tuple]] = []
    for length, count in pieces:
        need = min(length + kerf, bar)
        out: list[tuple[int, int, tuple]] = []

        def fill(rest: int, bars: int, held: tuple) -> None:
            """Put what is left of this length into bars of one kind."""
            nonlocal count
            fit = rest // need
            full = min(bars, count // fit) if fit else 0
            part = min(count - full * fit, fit) if full < bars else 0
            count -= full * fit + part
            some = [(full, fit), (1 if part else 0, part), (bars - full - (1 if part else 0), 0)]
            out.extend((rest - n * need, k, (*held, (length, n)) if n else held) for k, n in some if k)

        for run in runs:
            fill(*run)
        if count > 0:
            fill(bar, -(-count // (bar // need)), ())
        runs = out
    return runs


def first_fit(pieces: list[tuple[int, int]], bar: int, kerf: int = KERF_MM) -> list[list]:
    """bar_runs() bar by bar, as [rest, [(length, count), ...]]; one empty bar where there are no pieces."""
    return [[rest, list(held)] for rest, bars, held in bar_runs(pieces, bar, kerf) for _ in range(bars)] or [[bar, []]]


def pieces_of(rows: DataFrame, route: str) -> DataFrame:
    """Pieces by (article, coating, bar length, cut length) in run-length form, with the group's first description and weight per run."""
    chosen = rows.where(F.col("route") == route).withColumn("bar_mm", F.lit(BEAM_MM).cast("long") if route == "beam" else text.rod_length(F.col("description")))
    first = Window.partitionBy("item_number", "coating")
    chosen = chosen.withColumns({"bar_mm": F.min_by("bar_mm", "row_pos").over(first), "label": F.min_by("clean", "row_pos").over(first)})
    n = F.greatest(F.coalesce(F.col("qty"), F.lit(0)), F.lit(0))
    return chosen.groupBy("item_number", "coating", "bar_mm", "label", F.col("cut_length_mm").cast("long").alias("cut_mm")).agg(F.sum(n).alias("n"), _exact_sum("total_weight_kg").alias("w"), F.min("row_pos").alias("p"))


def _runs(pieces: DataFrame) -> DataFrame:
    """One row per (item_number, coating): bar length, label, sums, and its distinct lengths, long ones first, with their counts.

    A bar's lengths are whole millimetres, so a group has as many runs as a bar has millimetres at most.
    """
    runs = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("cut_mm", "n"))), asc=False)
    return pieces.groupBy("item_number", "coating").agg(F.min("bar_mm").alias("bar_mm"), F.min_by("label", "p").alias("label"), runs.alias("runs"), F.sum(F.col("cut_mm") * F.col("n")).alias("net_mm"), _exact_sum("w").alias("weight"), F.min("p").alias("row_pos"))


def _by_group(groups: DataFrame, work: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows that work() makes of each group; a task holds GROUPS_AT_ONCE groups as Python objects, however many an Arrow batch has."""
    names = [f.split()[0] for f in re.split(r", (?![^<]*>)", schema)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUPS_AT_ONCE):
                out = [row for g in batch.slice(start, GROUPS_AT_ONCE).to_pylist() for row in work(g)]
                yield pa.RecordBatch.from_arrays([pa.array([row[n] for row in out], kinds[n]) for n in names], names)

    kinds = {f.name: f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))}
    return groups.mapInArrow(each, schema)


def pack_bars(pieces: DataFrame) -> DataFrame:
    """Bars by first-fit decreasing for each (item_number, coating): n_bars and sums. pieces as pieces_of() gives them."""

    schema = "item_number long, coating string, bar_mm long, label string, n_bars long, net_mm long, weight double, row_pos long"

    def pack(g: dict) -> list[dict]:
        return [{**g, "n_bars": sum(bars for _, bars, _ in bar_runs([(r["cut_mm"], r["n"]) for r in g["runs"]], g["bar_mm"]))}]

    return _by_group(_runs(pieces), pack, schema)


def packed_rows(rows: DataFrame, route: str) -> DataFrame:
    """E4 as order sheet rows: ordered bars = ceil(bars x 1.05), naive bars, spare, lengths, utilisation, scaled weight."""
    g = pack_bars(pieces_of(rows, route)).where("n_bars > 0")
    c = F.col
    ordered = F.ceil(c("n_bars") * c("bar_mm") * F.lit(ORDER_FACTOR) / c("bar_mm"))
    g = g.withColumns({"ordered": ordered, "naive": F.ceil(c("net_mm") / c("bar_mm")), "net_m": F.round(c("net_mm") / 1000.0, 3), "w": F.when(c("weight") != 0, F.round("weight", 2))})
    g = g.withColumn("order_m", F.round(c("ordered") * c("bar_mm") / 1000.0, 3))
    kind, unit = ("04 Beam Sections", "m bar") if route == "beam" else ("01 Primary Supports", "m rod")
    remark = F.concat(F.regexp_replace((c("bar_mm") / 1000.0).cast("string"), r"\.0$", ""), F.lit(unit))
    # fixed wording of the rule, as in _rule_text()
    rule = F.format_string("FFD: min %d bars; FFD→%d bars; ×1.05→%d ordered; spare=%d", c("naive"), c("n_bars"), c("ordered"), c("ordered") - c("naive"))
    return _sheet(g, material_type=F.lit(kind), article_number=c("item_number"), description=c("label"), qty=c("naive"), total_weight_kg=c("w"), remarks=remark, coating=c("coating"), spare=c("ordered") - c("naive"), order_qty=c("ordered"),
                  order_weight_kg=F.when(c("net_m") > 0, F.round(c("w") / c("net_m") * c("order_m"), 2)), net_cut_length_m=c("net_m"), net_cut_weight_kg=c("w"), total_order_length_m=c("order_m"),
                  utilisation_pct=F.round(c("net_m") / c("order_m") * 100, 1), rule=rule, row_pos=c("row_pos"))


def cut_plan(pieces: DataFrame, bar_mm: int | None = None) -> DataFrame:
    """E5: the bars of each group: item_number, coating, bar, length, n, used_mm (with kerf), left_mm, too_long.

    Python makes runs of equal bars, whose number does not grow with the pieces; Spark makes bars of them.
    """

    def plan(g: dict) -> list[dict]:
        bar, first, out = bar_mm or g["bar_mm"], 1, []
        for rest, bars, held in bar_runs([(r["cut_mm"], r["n"]) for r in g["runs"]], bar):
            out.append({**g, "bar_mm": bar, "first": first, "bars": bars, "left_mm": rest, "held": [{"length": length, "n": n} for length, n in held]})
            first += bars
        return out

    runs = _by_group(_runs(pieces).select("item_number", "coating", "bar_mm", "runs"), plan, "item_number long, coating string, bar_mm long, first long, bars long, left_mm long, held array<struct<length: long, n: long>>")
    each = runs.withColumn("bar", F.explode(F.sequence("first", F.col("first") + F.col("bars") - 1))).select("*", F.inline("held"))
    return each.select("item_number", "coating", "bar", "length", "n", (F.col("bar_mm") - F.col("left_mm")).alias("used_mm"), "left_mm", (F.col("length") > F.col("bar_mm")).alias("too_long"))


def cut_summary(pieces: DataFrame) -> DataFrame:
    """E5: by group: pieces, bars (by first-fit) and ordered ones, net length, kerf loss (KERF_MM a piece), used and total length, what is left of it, efficiency in percent, and a warning for pieces longer than a bar."""
    pieces = pieces.where("n > 0")
    sums = pieces.groupBy("item_number", "coating").agg(F.sum("n").alias("pieces"), F.max("cut_mm").alias("longest"))
    g = pack_bars(pieces).drop("row_pos", "weight").join(sums, ["item_number", "coating"])
    ordered = F.ceil(F.col("n_bars") * F.lit(ORDER_FACTOR)).cast("long")
    g = g.withColumns({"ordered_bars": ordered, "kerf_loss_mm": F.col("pieces") * KERF_MM, "total_mm": ordered * F.col("bar_mm")}).withColumn("used_mm", F.col("net_mm") + F.col("kerf_loss_mm"))
    efficiency = F.round(F.col("used_mm") * 100.0 / F.col("total_mm"), 1)
    warning = F.when(F.col("longest") > F.col("bar_mm"), "piece longer than a bar").otherwise("")
    return g.select("item_number", "coating", "label", "pieces", F.col("n_bars").alias("bars"), "ordered_bars", "net_mm", "kerf_loss_mm", "used_mm", "total_mm", (F.col("total_mm") - F.col("used_mm")).alias("left_mm"), efficiency.alias("efficiency_pct"), warning.alias("warning"))


def tape_rolls(rows: DataFrame) -> DataFrame:
    """Glass fabric tape: metres x 1.30 in rolls of 10 m, weights by density."""
    n = F.greatest(F.coalesce("qty", F.lit(0)), F.lit(0))
    g = rows.where("route = 'tape'").groupBy("item_number", "coating").agg(F.sum(F.col("cut_length_mm").cast("long") * n).alias("net_mm"), F.min_by("description", "row_pos").alias("description"), F.min("row_pos").alias("row_pos")).where("net_mm > 0")
    c = F.col
    g = g.withColumns({"net_m": F.round(c("net_mm") / 1000.0, 3), "per_m": text.tape_weight_per_m(c("description"))})
    g = g.withColumns({"rolls": F.ceil(c("net_m") * F.lit(TAPE_FACTOR) / TAPE_ROLL_M), "naive": F.ceil(c("net_m") / TAPE_ROLL_M)})
    g = g.withColumn("order_m", c("rolls") * float(TAPE_ROLL_M))
    # fixed wording of the rule, as in _rule_text()
    rule = F.format_string("30%% factor: ×1.30 = %d rolls; naive %d; spare=%d", c("rolls"), c("naive"), c("rolls") - c("naive"))
    return _sheet(g, material_type=F.lit("05 Installation Material"), article_number=c("item_number"), description=c("description"), qty=c("naive"), total_weight_kg=F.round(c("per_m") * c("naive") * TAPE_ROLL_M, 3), remarks=F.lit(f"{TAPE_ROLL_M}m roll"),
                  coating=c("coating"), spare=c("rolls") - c("naive"), order_qty=c("rolls"), order_weight_kg=F.round(c("per_m") * c("order_m"), 3), net_cut_length_m=c("net_m"), net_cut_weight_kg=F.round(c("per_m") * c("net_m"), 3),
                  total_order_length_m=c("order_m"), utilisation_pct=F.round(c("net_m") / c("order_m") * 100, 1), rule=rule, row_pos=c("row_pos"))


def individual_rows(rows: DataFrame) -> DataFrame:
    """E7, first part: rows of their own with their spare; the cut length goes into the remarks."""
    own = rows.where("route = 'individual'").select("item_number", F.coalesce("qty", F.lit(0)).alias("qty"), F.col("total_weight_kg").alias("weight"), "coating", "row_pos", F.col("clean").alias("description"), "cut_length_mm", "remarks",
                                                    remap_coating(F.col("material_type"), F.col("coating")).alias("material_type"))
    g = _with_spare(own)
    c = F.col
    label = F.concat(F.lit("cut: "), c("cut_length_mm").cast("long").cast("string"), F.lit(" mm"))
    remarks = F.when(c("cut_length_mm").isNull(), c("remarks")).when(F.coalesce(c("remarks"), F.lit("")) != "", F.concat(c("remarks"), F.lit(" / "), label)).otherwise(label)
    return _sheet(g, material_type=c("material_type"), article_number=c("item_number"), description=c("description"), qty=c("qty"), total_weight_kg=c("weight"), remarks=remarks, coating=c("coating"), spare=F.when(c("share") != 0, c("spare_n")),
                  order_qty=c("order_n"), order_weight_kg=c("order_weight"), rule=c("rule"), row_pos=c("row_pos"))


def folded(sheet: DataFrame) -> DataFrame:
    """E7, second part: rows of one (article, coating, remarks) become one: sums of quantities and weights, the first row's other cells."""
    kept = ["material_type", "description", "net_cut_length_m", "total_order_length_m", "utilisation_pct", "rule"]
    rows = sheet.withColumn("material_type", remap_coating(F.col("material_type"), F.col("coating")))
    sums = [F.sum("qty").alias("qty"), F.round(F.sum("total_weight_kg"), 2).alias("total_weight_kg"), F.sum("spare").alias("spare"), F.sum("order_qty").alias("order_qty"), F.round(F.sum("order_weight_kg"), 2).alias("order_weight_kg"), F.round(F.sum("net_cut_weight_kg"), 2).alias("net_cut_weight_kg")]
    one = rows.groupBy("article_number", "coating", "remarks").agg(*sums, F.min_by(F.struct(*kept), "row_pos").alias("head"), F.min("row_pos").alias("row_pos"))
    names = [f.strip().rsplit(" ", 1)[0] for f in SHEET.split(",")]
    return one.select("*", "head.*").select(*names)


def order_sheet(raw: DataFrame) -> DataFrame:
    """Raw bill of material to the order sheet. Rows are routed once, into a staged table that the six routes read."""
    rows = staged(routed(raw), "routed")
    parts = [grouped_standard(rows), grouped_brackets(rows), packed_rows(rows, "beam"), packed_rows(rows, "rod"), tape_rolls(rows), individual_rows(rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return folded(out)


def in_order(sheet: DataFrame) -> DataFrame:
    """G1: by material type and description in lower case."""
    return sheet.orderBy(F.coalesce("material_type", F.lit("")), F.lower(F.coalesce("description", F.lit(""))), "row_pos")


def shop_class(c: Column, erection: str = "Erection", paint: str = "paint", shop: str = "shop") -> Column:
    """Paint, erection, shop or other, as the spare rules read a material type; the words are settings."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    is_erection = (low == erection.lower()) | (low.contains("erection") & ~low.contains("paint"))
    return F.when(low.contains("paint shop"), "paint").when(is_erection, "erection").when(low.contains(paint.lower()) & low.contains("shop"), "paint").when(low.endswith(shop.lower()), "shop").otherwise("other")


#: Words of material types in the order of price rows (fixed values); erection without paint comes between the last two, prefixes after all.
PRICE_ORDER, PRICE_PREFIXES = ("mapress shop", "ss shop", "cs shop", "paint shop"), ("mapress", "ss", "cs", "paint")


def price_order(rows: DataFrame, name: str = "place") -> DataFrame:
    """G1: price rows (material_type, material, type, size, row_pos) with their place from 1: by rank of the material type, material, type, size as a number (texts and N/A last), material type, row_pos.

    Places come from numbered(), so the order is a global one without a task that holds all rows.
    """
    low = F.lower(F.trim(F.coalesce("material_type", F.lit(""))))
    rank = F.lit(len(PRICE_ORDER) + 2 + len(PRICE_PREFIXES))
    for k, prefix in reversed(list(enumerate(PRICE_PREFIXES, len(PRICE_ORDER) + 2))):
        rank = F.when(low.startswith(prefix), k).otherwise(rank)
    rank = F.when(low.contains("paint erection"), len(PRICE_ORDER) + 1).otherwise(rank)
    rank = F.when(low.contains("04 erection") | (low.contains("erection") & ~low.contains("paint")), len(PRICE_ORDER)).otherwise(rank)
    for k, word in reversed(list(enumerate(PRICE_ORDER))):
        rank = F.when(low.contains(word), k).otherwise(rank)
    plain = F.replace(F.trim(F.coalesce("size", F.lit(""))), F.lit(" "), F.lit(""))
    number = F.when(plain.contains(",") & ~plain.contains("."), F.replace(plain, F.lit(","), F.lit("."))).otherwise(plain).try_cast("double")
    text_of = lambda c: F.coalesce(c, F.lit(""))
    order = [rank, text_of(F.col("material")), text_of(F.col("type")), number.isNull().cast("int"), F.coalesce(number, F.lit(0.0)), F.trim(text_of(F.col("size"))), text_of(F.col("material_type")), F.col("row_pos")]
    return numbered(rows, order, name)


def material_subtotals(sheet: DataFrame) -> DataFrame:
    """Subtotals by material type and the grand total ('TOTAL')."""
    total = sheet.rollup("material_type").agg(F.sum("qty").alias("qty"), F.round(F.sum("total_weight_kg"), 2).alias("total_weight_kg"), F.sum("order_qty").alias("order_qty"), F.round(F.sum("order_weight_kg"), 2).alias("order_weight_kg"), F.grouping("material_type").alias("g"))
    return total.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("material_type")).alias("material_type"), "qty", "total_weight_kg", "order_qty", "order_weight_kg")


def price_summary(sheet: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Weights and price (by kg) for each of the ten material types, zeros where the sheet has none."""
    types = [*C5_TYPES, *C5_TYPES.values()]
    price = F.create_map(*[F.lit(x) for t in types for x in (t, float(prices.get(t, 0.0)))])
    frame = sheet.sparkSession.createDataFrame([(t,) for t in sorted(types)], "material_type string")
    sums = sheet.groupBy("material_type").agg(F.round(F.sum("total_weight_kg"), 2).alias("bom_kg"), F.round(F.sum("order_weight_kg"), 2).alias("order_kg"))
    out = frame.join(sums, "material_type", "left").select("material_type", F.coalesce("bom_kg", F.lit(0.0)).alias("bom_kg"), F.coalesce("order_kg", F.lit(0.0)).alias("order_kg"))
    return out.select("material_type", "bom_kg", F.round(F.col("order_kg") - F.col("bom_kg"), 2).alias("spare_kg"), "order_kg", F.round(F.col("order_kg") * price[F.col("material_type")], 2).alias("price"))


def aggregate_innova(bom: DataFrame) -> DataFrame:
    """Bill rows (row_pos, item_number, qty, description, cut_length_mm, total_weight_kg, remarks, corrosion) merged by kind.

    Rows with remarks stay alone; brackets add up; cut items add qty x length by (item, description without length, corrosion); the rest
    adds up. kind tells which; threaded rods become pieces of their own length. Rows of one (item, corrosion) in several kinds are flagged.
    """
    c = F.col
    kind = F.when(F.coalesce(c("remarks"), F.lit("")) != "", "remark").when(F.lower("description").contains("bracket"), "bracket").when(c("cut_length_mm") > 0, "cut").otherwise("plain")
    rows = bom.withColumns({"kind": kind, "text": text.strip_cut_length(c("description"), "first")})
    alone = rows.where("kind = 'remark'").select("item_number", "corrosion", c("description").alias("text"), "kind", c("qty").cast("double").alias("qty"), F.lit(None).cast("double").alias("length_mm"), "total_weight_kg", "row_pos")
    sums = rows.where("kind <> 'remark'").groupBy("item_number", "corrosion", "text", "kind").agg(F.sum("qty").cast("double").alias("qty"), F.sum(F.when(c("kind") == "cut", c("qty") * c("cut_length_mm"))).alias("length_mm"), F.round(F.sum("total_weight_kg"), 2).alias("total_weight_kg"), F.min("row_pos").alias("row_pos"))
    rods = F.when(F.lower("text").contains("threaded rod") & c("length_mm").isNotNull(), text.rod_pieces(c("text"), c("length_mm")).cast("double")).otherwise(F.coalesce("qty", "length_mm"))
    both = alone.unionByName(sums.select("item_number", "corrosion", "text", "kind", rods.alias("qty"), c("length_mm").cast("double").alias("length_mm"), "total_weight_kg", "row_pos"))
    return both.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy("item_number", "corrosion")) > 1)


def sum_extra_long(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Remarks of a group: 'n off extra-long' adds up, other distinct remarks follow in order, joined by '; '."""
    n = text.extra_long(F.col("remarks"))
    other = F.when(n.isNull() & (F.coalesce("remarks", F.lit("")) != ""), F.col("remarks"))
    firsts = rows.groupBy(*keys, other.alias("other")).agg(F.sum(n).alias("n"), F.min("row_pos").alias("p"))
    lists = F.transform(F.array_sort(F.collect_list(F.when(F.col("other").isNotNull(), F.struct("p", "other")))), lambda s: s["other"])
    g = firsts.groupBy(*keys).agg(F.sum("n").alias("n"), lists.alias("others"))
    head = F.when(F.col("n").isNotNull(), F.array(F.concat(F.col("n").cast("string"), F.lit(" off extra-long")))).otherwise(F.array().cast("array<string>"))
    return g.select(*keys, F.array_join(F.concat(head, "others"), "; ").alias("remarks"))


def aggregate_price(rows: DataFrame) -> DataFrame:
    """Price rows by (description, material, type, size, bucket, corrosion, colour): four sums. Branch rows of OLETs go; corrosion and colour count for the paint shop only."""
    paint = F.lower("material_type").contains("paint shop")
    kept = rows.where(~F.coalesce(F.upper("description").contains("OLET") & (F.lower("add_info") == "branch"), F.lit(False)))
    keys = ["description", "material", "type", "size", material_bucket(F.col("material_type")).alias("bucket"), F.when(paint, F.col("corrosion_category")).alias("corrosion_category"), F.when(paint, F.col("paint_colour")).alias("paint_colour")]
    return kept.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("qty_pcs", "qty_m", "weight_kg", "surface_m2")))


def material_bucket(c: Column) -> Column:
    """The shop of a material type, in the order of the rules."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.contains("paint"), "paint").when(low.contains("erection"), "erection").when(low.endswith("shop"), "shop").otherwise("other")


def orifice_groups(rows: DataFrame) -> DataFrame:
    """Codes of one (description, size) as 'KKS: a, b', distinct and sorted, with the sum of pieces."""
    return rows.groupBy("description", "size").agg(F.sum("qty_pcs").alias("qty_pcs"), F.concat(F.lit("KKS: "), F.array_join(F.sort_array(F.collect_set("kks")), ", ")).alias("note"))


def seal_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Seals to order: order numbers of the descriptions times their multipliers and pieces, with the size of the order number."""
    found = rows.select("qty_pcs", F.inline(text.extract_seal_orders(F.col("description"))))
    total = found.groupBy("order_no").agg(F.sum(F.col("qty_pcs") * F.col("multiplier")).alias("qty_pcs"))
    return total.join(sizes, "order_no", "left")


def support_weights(pps: DataFrame, supports: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Per support: greatest bore, primary weight (its pipe supports'), secondary = listed minus primary, SB or LB; difference to a control total within 1 kg."""
    primary = pps.groupBy("support_structure").agg(F.max("nb").alias("nb"), F.sum("total_weight").alias("primary_kg"), F.min("pipe_support").alias("first_support"))
    listed = supports.groupBy("support_structure").agg(F.sum("total_weight").alias("listed_kg"), F.max(text.max_in_list(F.col("nb_text"))).alias("listed_nb"))
    both = listed.join(primary, "support_structure", "left")
    nb = F.coalesce("nb", "listed_nb")
    out = both.select("support_structure", nb.alias("nb"), text.bore_class(nb).alias("bore"), F.coalesce("primary_kg", F.lit(0.0)).alias("primary_kg"), F.round(F.col("listed_kg") - F.coalesce("primary_kg", F.lit(0.0)), 2).alias("secondary_kg"), "listed_kg")
    if total is None:
        return out
    sums = out.agg(F.sum("listed_kg").alias("sum_kg"))
    return out.crossJoin(F.broadcast(sums.crossJoin(total).select((F.abs(F.col("sum_kg") - F.col("control_kg")) <= 1.0).alias("total_ok"))))  # one row


def weight_by_dn(rows: DataFrame) -> DataFrame:
    """Weights of stainless rows (1.4571 in the material) by file and DN, and a SUMMARY row for each DN."""
    kept = rows.where(F.col("material").rlike(r"1[.,]4571")).withColumn("dn", text.dn_number(F.col("size")))
    g = kept.groupBy("file", "dn").agg(F.round(F.sum("weight_kg"), 3).alias("weight_kg"), F.count("*").alias("n"))
    return g.unionByName(g.groupBy("dn").agg(F.round(F.sum("weight_kg"), 3).alias("weight_kg"), F.sum("n").alias("n")).withColumn("file", F.lit("SUMMARY")))


def distinct_codes(files: DataFrame) -> DataFrame:
    """For each short system code the count of files and of full codes, and the least path as its example."""
    return files.where("system_code_short is not null").groupBy("system_code_short").agg(F.count("*").alias("files"), F.countDistinct("system_code").alias("codes"), F.min("full_path").alias("example"))


