"""Validation of order sheets and of extracted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bom import SPARE_SHARE

#: Offending rows that a check shows.
SHOWN = 30
_C = F.col


def _blank(x: str) -> Column:
    return F.coalesce(F.trim(_C(x).cast("string")), F.lit("")) == ""


def _raw_checks() -> list[tuple[str, str, str, str, Column]]:
    """(id, category, name, level, fails) of the checks of single raw rows."""
    weight_differs = _C("cut_length_mm").isNull() & (F.abs(_C("weight_kg") * _C("qty") - _C("total_weight_kg")) > 0.02)
    return [
        ("V01", "raw", "article numbers given", "FAIL", _C("item_number").isNull()),
        ("V02", "raw", "descriptions given", "FAIL", _blank("description")),
        ("V03", "raw", "quantities above zero", "FAIL", _C("qty").isNull() | (_C("qty") <= 0)),
        ("V04", "raw", "total weights given", "WARN", _C("total_weight_kg").isNull()),
        ("V05", "raw", "unit weight x quantity = total weight (0.02 kg), rows without a cut", "WARN", weight_differs),
        ("V06", "raw", "cut lengths above zero", "FAIL", _C("cut_length_mm") <= 0),
    ]


def _sheet_checks() -> list[tuple[str, str, str, str, Column]]:
    cut = _C("net_cut_length_m").isNotNull()
    per_piece = F.abs(_C("total_weight_kg") / _C("qty") - _C("order_weight_kg") / _C("order_qty")) > 0.05
    beam = _C("material_type").isin("04 Beam Sections", "09 Beam Sections C5") & ~F.lower("description").contains("channel")
    return [
        ("V12", "spare", "order quantity at least the quantity", "FAIL", _C("order_qty") < _C("qty")),
        ("V13", "spare", "spare = order quantity - quantity", "FAIL", F.abs(_C("spare") - (_C("order_qty") - _C("qty"))) > 0.01),
        ("V14", "spare", "spare set for types that have a share", "WARN", _C("material_type").isin(*SPARE_SHARE) & _C("spare").isNull()),
        ("V15", "spare", "utilisation at most 100 %", "FAIL", _C("utilisation_pct") > 100),
        ("V16", "spare", "order length at least the net cut length", "FAIL", cut & (_C("total_order_length_m") < _C("net_cut_length_m") - 0.01)),
        ("V17", "spare", "order weight at least the net cut weight", "FAIL", cut & (_C("order_weight_kg") < _C("net_cut_weight_kg") - 0.01)),
        ("V18", "weight", "no total weight below zero", "FAIL", _C("total_weight_kg") < 0),
        ("V19", "weight", "no order weight below zero", "FAIL", _C("order_weight_kg") < 0),
        ("V20", "weight", "unit weight kept by the order (0.05 kg)", "FAIL", ~cut & (_C("qty") > 0) & (_C("order_qty") > 0) & per_piece),
        ("V21", "weight", "total weights given in the sheet", "WARN", _C("total_weight_kg").isNull()),
        ("V23", "sheet", "no quantity of zero", "WARN", _C("qty") == 0),
        ("V24", "sheet", "spare rule given", "FAIL", F.coalesce("rule", F.lit("")) == ""),
        ("V25", "sheet", "beams that are neither packed nor channels have spare", "WARN", beam & ~cut & (_C("spare").isNull() | (_C("rule") == "No spare"))),
    ]


def _failing(df: DataFrame, checks: list[tuple[str, str, str, str, Column]], place: str, label: Column) -> DataFrame:
    """(id, place, label) of each row and check that it fails, in one pass."""
    return df.select(F.col(place).alias("place"), label.alias("label"), F.explode(F.array_compact(F.array(*(F.when(x, i) for i, _, _, _, x in checks)))).alias("id"))


def validate_order_sheet(raw: DataFrame, sheet: DataFrame) -> DataFrame:
    """V1: one row per check V01 to V29: id, category, name, status (PASS, WARN, FAIL, INFO), n (offending rows), detail, rows.

    raw: row_pos, item_number, description, qty, weight_kg (per piece), total_weight_kg, cut_length_mm, coating. sheet: the columns
    of an order sheet. Both are read several times, so pass tables and not long plans. rows shows up to SHOWN offending rows as
    texts, in order of row_pos or article. Null cells fail only the checks that ask for them. Empty tables pass; their totals are 0.
    Fidelity (V07-V11) compares sums by article, or by article and coating (null coatings equal each other).
    """
    article = lambda a, *more: F.concat_ws(" | ", F.coalesce(a.cast("string"), F.lit("-")), *(F.coalesce(x.cast("string"), F.lit("-")) for x in more))
    raw_label = article(_C("item_number"), _C("description"), _C("qty"), _C("cut_length_mm"), _C("total_weight_kg"))
    sheet_label = article(_C("article_number"), _C("material_type"), _C("description"), _C("qty"), _C("spare"), _C("order_qty"), _C("total_weight_kg"), _C("order_weight_kg"))

    # one row per article and coating from either side
    cut = _C("net_cut_length_m").isNotNull()
    whole = ~cut & ~F.coalesce(_C("remarks").rlike("(?s)cut: .* mm"), F.lit(False))
    per_raw = raw.groupBy(_C("item_number").alias("article"), "coating").agg(F.count("*").alias("raw_rows"), F.sum("qty").alias("raw_qty"), F.sum(F.when(_C("cut_length_mm").isNotNull(), _C("qty") * _C("cut_length_mm"))).alias("raw_mm"), F.sum("total_weight_kg").alias("raw_kg"))
    per_sheet = sheet.groupBy(_C("article_number").alias("article"), "coating").agg(
        F.count("*").alias("sheet_rows"), F.max(F.when(whole, _C("qty"))).alias("qty_hi"), F.min(F.when(whole, _C("qty"))).alias("qty_lo"), F.max("net_cut_length_m").alias("net_hi"), F.min("net_cut_length_m").alias("net_lo"),
        F.sum(F.when(~cut, _C("total_weight_kg"))).alias("sheet_kg"), F.max(cut).alias("packed"),
    )
    both = per_raw.alias("r").join(per_sheet.alias("s"), _C("r.article").eqNullSafe(_C("s.article")) & _C("r.coating").eqNullSafe(_C("s.coating")), "full_outer")
    both = both.select(F.coalesce("r.article", "s.article").alias("article"), F.coalesce("r.coating", "s.coating").alias("coating"), "raw_rows", "raw_qty", "raw_mm", "raw_kg", "sheet_rows", "qty_hi", "qty_lo", "net_hi", "net_lo", "sheet_kg", "packed")
    by_article = both.groupBy("article").agg(F.count("raw_rows").alias("in_raw"), F.count("sheet_rows").alias("in_sheet"), F.coalesce(F.max("packed"), F.lit(False)).alias("packed"), F.sum("raw_kg").alias("raw_kg"), F.sum("sheet_kg").alias("sheet_kg"))
    lost = [("V07", "articles", "raw articles in the sheet", "FAIL", _C("in_sheet") == 0), ("V08", "articles", "sheet articles in raw", "FAIL", _C("in_raw") == 0)]
    off = lambda x, y: F.greatest(F.abs(_C(f"{x}_hi") - y), F.abs(_C(f"{x}_lo") - y))
    fidelity = [
        ("V09", "fidelity", "quantity of rows without a cut = sum of raw, by article and coating", "FAIL", off("qty", _C("raw_qty")) > 0.01),
        ("V10", "fidelity", "net cut length = sum of raw quantity x cut length, by article and coating", "FAIL", off("net", _C("raw_mm") / 1000.0) * 1000 > 1),
    ]
    keys = sheet.groupBy("article_number", "coating", "remarks").agg(F.count("*").alias("times"), F.min("row_pos").alias("row_pos")).where("times > 1")
    twice = [("V22", "sheet", "keys (article, coating, remarks) stand once", "FAIL", F.lit(True))]
    failing = _failing(raw, _raw_checks(), "row_pos", raw_label).unionByName(_failing(sheet, _sheet_checks(), "row_pos", sheet_label))
    failing = failing.unionByName(_failing(by_article, lost, "article", article(_C("article")))).unionByName(_failing(both.where("raw_rows is not null and sheet_rows is not null"), fidelity, "article", article(_C("article"), _C("coating"), _C("qty_hi"), _C("raw_qty"), _C("net_hi"), _C("raw_mm"))))
    failing = failing.unionByName(_failing(keys, twice, "row_pos", article(_C("article_number"), _C("coating"), _C("remarks"), _C("times"))))

    # counts come from partial sums; of the rows each task keeps SHOWN at most
    counts = failing.groupBy("id").agg(F.count("*").alias("n"))
    shown = failing.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_first("place"), "label"))).where(F.col("k") <= SHOWN)
    shown = shown.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]).alias("rows"))
    found = counts.join(shown, "id")

    named = [*_raw_checks(), *lost, *fidelity, *_sheet_checks(), *twice]
    listed = raw.sparkSession.createDataFrame([(i, category, name, level) for i, category, name, level, _ in named], "id string, category string, name string, level string")
    checks = listed.join(F.broadcast(found), "id", "left")  # 23 rows
    checks = checks.select("id", "category", "name", F.when(_C("n") > 0, _C("level")).otherwise("PASS").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.lit("").alias("detail"), F.coalesce("rows", F.array().cast("array<string>")).alias("rows"))
    return checks.unionByName(_totals(raw, sheet, by_article))


def _totals(raw: DataFrame, sheet: DataFrame, by_article: DataFrame) -> DataFrame:
    """Statements on sums."""
    none = F.array().cast("array<string>")
    shown = lambda x, d=1: F.format_string(f"%.{d}f", F.coalesce(x.cast("double"), F.lit(0.0)))
    row = lambda df, i, category, name, status, detail, n=F.lit(0), rows=none: df.select(F.lit(i).alias("id"), F.lit(category).alias("category"), F.lit(name).alias("name"), status.alias("status"), n.cast("long").alias("n"), detail.alias("detail"), rows.alias("rows"))
    kg = by_article.agg(F.round(F.coalesce(F.sum(F.when(~_C("packed"), _C("raw_kg"))), F.lit(0.0)), 2).alias("raw"), F.round(F.coalesce(F.sum("sheet_kg"), F.lit(0.0)), 2).alias("sheet"))
    apart = F.round(F.abs(_C("raw") - _C("sheet")), 2)
    weight = row(kg, "V11", "fidelity", "total weight of what is not packed: raw = sheet (below 1 kg)", F.when(apart < 1, "PASS").otherwise("FAIL"), F.concat(F.lit("raw "), shown(_C("raw"), 2), F.lit(" kg, sheet "), shown(_C("sheet"), 2), F.lit(" kg, apart "), shown(apart, 2), F.lit(" kg")), F.when(apart < 1, 0).otherwise(1))
    sums = [F.count("*").alias("rows"), F.sum("qty").alias("qty"), F.sum("spare").alias("spare"), F.sum("order_qty").alias("order_qty"), F.sum("total_weight_kg").alias("kg"), F.sum("order_weight_kg").alias("order_kg")]
    per = sheet.groupBy("material_type").agg(*sums)
    text = F.concat(F.coalesce("material_type", F.lit("-")), *(F.concat(F.lit(" | "), shown(_C(c), d)) for c, d in (("rows", 0), ("qty", 0), ("spare", 0), ("order_qty", 0), ("kg", 1), ("order_kg", 1))))
    total = per.agg(*(F.sum(c).alias(c) for c in ("rows", "qty", "spare", "order_qty", "kg", "order_kg")), F.array_sort(F.collect_list(text)).alias("types"))  # as many as there are material types
    one = total.crossJoin(raw.agg(F.count("*").alias("raw_rows")))  # one row and one row
    info = F.lit("INFO")
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return (
        weight.unionByName(row(one, "V26", "summary", "row counts", info, said("raw ", shown(_C("raw_rows"), 0), ", sheet ", shown(_C("rows"), 0))))
        .unionByName(row(one, "V27", "summary", "quantities", info, said("quantity ", shown(_C("qty"), 0), ", spare ", shown(_C("spare"), 0), ", order ", shown(_C("order_qty"), 0))))
        .unionByName(row(one, "V28", "summary", "weights", info, said("net ", shown(_C("kg")), " kg, order ", shown(_C("order_kg")), " kg")))
        .unionByName(row(one, "V29", "summary", "by material type: rows, quantity, spare, order, net kg, order kg", info, F.lit(""), rows=_C("types")))
    )


def overall_status(checks: DataFrame) -> DataFrame:
    """FAIL if any check fails, else WARN if any warns, else PASS."""
    return checks.agg(F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("status") == "WARN") > 0, "WARN").otherwise("PASS").alias("overall"))


def quality_flags(bom: DataFrame) -> DataFrame:
    """V2: bom (texts filename, pos, article_number, description, qty, weight, total_weight, cut_length, kks, kks_su) with the column flags, joined by '; '."""
    c = F.col
    number = lambda x: F.replace(c(x), F.lit(","), F.lit(".")).try_cast("double")
    empty = lambda x: F.coalesce(F.trim(c(x)), F.lit("")) == ""
    flags = {
        "missing article": empty("article_number"), "article not a number": ~empty("article_number") & ~c("article_number").rlike(r"^\d+$"), "missing description": empty("description"),
        "missing qty": number("qty").isNull(), "qty not positive": number("qty") <= 0, "missing weight": number("weight").isNull(),
        "total weight differs": F.abs(number("qty") * number("weight") - number("total_weight")) > 0.05 * F.greatest(number("total_weight"), F.lit(1.0)), "missing code": empty("kks") & empty("kks_su"),
    }
    return bom.withColumn("flags", F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), name) for name, x in flags.items()))), "; "))


def flag_breakdown(flagged: DataFrame) -> DataFrame:
    """V2: rows by flag."""
    return flagged.where("flags <> ''").select(F.explode(F.split("flags", "; ")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
