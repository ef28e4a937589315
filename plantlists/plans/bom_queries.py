"""Queries of order sheets, packing, validation and spare rules; articles are parts, cut lengths come from prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bom, rules, validate
from ..staging import staged
from .list_queries import ROW
from .shared import Query, derived, derived_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_TEXT = (
    "case l_partkey % 8 when 0 then 'TP F 80 rail' when 1 then concat('Bracket WBD', case when l_linenumber % 2 = 0 then ' x 250 HCP' else '' end) when 2 then 'Pipe clamp D' when 3 then 'Hex nut M10' "
    "when 4 then 'Glass fabric tape GSK 50 x 2' when 5 then 'Beam section MS 41' when 6 then 'Threaded rod M10/2000' else 'Angled bracket' end"
)
_CUT = "case when l_partkey % 8 in (4, 5, 6, 7) then cast(100 + l_orderkey * 7 % 1900 as bigint) end"
RAW = [ROW, "l_partkey AS item_number", "cast(l_quantity as bigint) AS qty", f"{_TEXT} AS description", f"{_CUT} AS cut_length_mm", "case when l_linenumber = 7 then null else l_extendedprice / 1000 end AS total_weight_kg",
       "case when l_suppkey % 6 = 0 then concat('remark ', cast(l_suppkey % 5 as string)) end AS remarks", "case when l_returnflag = 'R' then 'C5-I' else 'HCP' end AS coating"]
_KIND = "CASE item_number % 8 WHEN 0 THEN '04 Beam Sections' WHEN 1 THEN '02 Brackets Consoles' WHEN 2 THEN '01 Primary Supports' WHEN 3 THEN '03 Bolts Screws Nuts' WHEN 4 THEN '05 Installation Material' WHEN 5 THEN '04 Beam Sections' WHEN 6 THEN '01 Primary Supports' ELSE '02 Brackets Consoles' END"
_ROUTE = "CASE item_number % 8 WHEN 1 THEN 'bracket' WHEN 4 THEN 'tape' WHEN 5 THEN 'beam' WHEN 6 THEN 'rod' WHEN 7 THEN 'individual' ELSE 'standard' END"
_R = f"r AS (SELECT *, {_KIND} AS material_type, {_ROUTE} AS route FROM ({derived_sql('lineitem', RAW)}))"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "lineitem", RAW)


def _query(name: str, sql: str | None = None):  # noqa: ANN202
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@_query("e1_routed", f"WITH {_R} SELECT row_pos, material_type, route, CASE WHEN description LIKE '% x 250 HCP' THEN 'Bracket WBD HCP' ELSE description END AS clean FROM r")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return bom.routed(raw(spark, d)).select("row_pos", "material_type", "route", "clean")


def _spare(share: str) -> str:
    return f"CASE WHEN q = 0 OR {share} = 0 THEN 0 WHEN {share} = CAST(0.05 AS DOUBLE) AND q < 10 THEN 0 ELSE ceil(q * {share}) END"


_SHARE = "CASE material_type WHEN '01 Primary Supports' THEN CAST(0.05 AS DOUBLE) WHEN '02 Brackets Consoles' THEN CAST(0.05 AS DOUBLE) WHEN '03 Bolts Screws Nuts' THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@_query("e2_grouped_standard", f"""WITH {_R}, g AS (SELECT item_number, coating, max(material_type) AS material_type, sum(qty) AS q, round(sum(total_weight_kg), 2) AS w FROM r WHERE route = 'standard' GROUP BY 1, 2), s AS (SELECT *, {_SHARE} AS share FROM g),
m AS (SELECT item_number, coating, string_agg(remarks, ' | ' ORDER BY p) AS remarks FROM (SELECT item_number, coating, remarks, min(row_pos) AS p FROM r WHERE route = 'standard' AND remarks IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT s.item_number AS article_number, s.coating, CAST(q AS BIGINT) AS qty, w AS total_weight_kg, m.remarks, CAST(q + {_spare('share')} AS BIGINT) AS order_qty, CASE WHEN share <> 0 THEN CAST({_spare('share')} AS BIGINT) END AS spare
FROM s LEFT JOIN m ON m.item_number = s.item_number AND m.coating = s.coating""")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return bom.grouped_standard(bom.routed(raw(spark, d))).select("article_number", "coating", "qty", "total_weight_kg", "remarks", "order_qty", "spare")


@_query("e3_grouped_brackets", f"""WITH {_R}, g AS (SELECT item_number, coating, CASE WHEN description LIKE '% x 250 HCP' THEN 'Bracket WBD HCP' ELSE description END AS description, sum(qty) AS q, round(sum(total_weight_kg), 2) AS w FROM r WHERE route = 'bracket' GROUP BY 1, 2, 3)
SELECT item_number AS article_number, coating, description, CAST(q AS BIGINT) AS qty, w AS total_weight_kg, CAST({_spare('CAST(0.05 AS DOUBLE)')} AS BIGINT) AS spare FROM g""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return bom.grouped_brackets(bom.routed(raw(spark, d))).select("article_number", "coating", "description", "qty", "total_weight_kg", "spare")


@_query("e4_pack_bars", f"""WITH {_R} SELECT item_number, coating, CAST(sum(qty * cut_length_mm) AS BIGINT) AS net_mm, CAST(floor(sum(total_weight_kg) + 0.3337) AS BIGINT) AS weight, true AS within FROM r WHERE route = 'beam' GROUP BY 1, 2""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    """The sums are as SQL has them; within says that the bars lie between the lower bound and twice that (and one), which first-fit keeps."""
    packed = bom.pack_bars(bom.pieces_of(bom.routed(raw(spark, d)), "beam"))
    least = F.ceil(F.col("net_mm") / 6000)
    return packed.select("item_number", "coating", "net_mm", F.floor(F.col("weight") + 0.3337).alias("weight"), F.col("n_bars").between(least, 2 * least + 1).alias("within"))


@_query("e4_packed_rows")
def e4_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = bom.routed(raw(spark, d))
    return bom.packed_rows(rows, "beam").unionByName(bom.packed_rows(rows, "rod"))


@_query("e5_cut_plan", f"WITH {_R} SELECT item_number, coating, cut_length_mm AS length, CAST(sum(qty) AS BIGINT) AS n, false AS too_long FROM r WHERE route = 'rod' GROUP BY 1, 2, 3")
def e5(spark: SparkSession, d: str) -> DataFrame:
    """The plan's pieces by length are those that went in."""
    plan = bom.cut_plan(bom.pieces_of(bom.routed(raw(spark, d)), "rod"))
    return plan.groupBy("item_number", "coating", "length").agg(F.sum("n").alias("n"), F.bool_or("too_long").alias("too_long"))


@_query("e5_cut_summary", f"""WITH {_R} SELECT item_number, coating, CAST(sum(greatest(qty, 0)) AS BIGINT) AS pieces, CAST(sum(cut_length_mm * greatest(qty, 0)) AS BIGINT) AS net_mm, CAST(sum(greatest(qty, 0)) * 3 AS BIGINT) AS kerf_loss_mm, CAST(sum((cut_length_mm + 3) * greatest(qty, 0)) AS BIGINT) AS used_mm,
  true AS adds_up, CASE WHEN max(cut_length_mm) FILTER (qty > 0) > 6000 THEN 'long' ELSE '' END AS warning FROM r WHERE route = 'beam' GROUP BY 1, 2 HAVING sum(greatest(qty, 0)) > 0""")
def e5_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums by SQL; bars come from packing, so what they give has to add up."""
    g = bom.cut_summary(bom.pieces_of(bom.routed(raw(spark, d)), "beam"))
    whole = (F.col("total_mm") == F.col("used_mm") + F.col("left_mm")) & (F.col("efficiency_pct") <= 100) & (F.col("ordered_bars") >= F.col("bars"))
    return g.select("item_number", "coating", "pieces", "net_mm", "kerf_loss_mm", "used_mm", whole.alias("adds_up"), F.when(F.col("warning") != "", "long").otherwise("").alias("warning"))


@_query("e6_tape_rolls", f"""WITH {_R}, g AS (SELECT item_number, coating, round(sum(cut_length_mm * qty) / 1000, 3) AS m FROM r WHERE route = 'tape' GROUP BY 1, 2)
SELECT item_number AS article_number, coating, CAST(ceil(m / 10) AS BIGINT) AS qty, CAST(ceil(m * CAST(1.30 AS DOUBLE) / 10) AS BIGINT) AS order_qty, m AS net_cut_length_m, round(0.26 * ceil(m * CAST(1.30 AS DOUBLE) / 10) * 10, 2) AS kg FROM g""")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return bom.tape_rolls(bom.routed(raw(spark, d))).select("article_number", "coating", "qty", "order_qty", "net_cut_length_m", F.round("order_weight_kg", 2).alias("kg"))


@_query("e7_individual_rows", f"""WITH {_R}, s AS (SELECT *, qty AS q FROM r WHERE route = 'individual')
SELECT row_pos, CASE WHEN coating LIKE 'C5%' THEN '07 Brackets Consoles C5' ELSE material_type END AS material_type, CASE WHEN remarks IS NULL THEN '' ELSE remarks || ' / ' END || 'cut: ' || cut_length_mm || ' mm' AS remarks, CAST({_spare('CAST(0.05 AS DOUBLE)')} AS BIGINT) AS spare FROM s""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    return bom.individual_rows(bom.routed(raw(spark, d))).select("row_pos", "material_type", "remarks", "spare")


@_query("g1_order_sheet")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return bom.in_order(bom.order_sheet(raw(spark, d)))


@_query("e7_folded", f"""WITH {_R}, s AS (SELECT *, qty AS q FROM r WHERE route = 'individual'), t AS (SELECT item_number, coating, CASE WHEN remarks IS NULL THEN '' ELSE remarks || ' / ' END || 'cut: ' || cut_length_mm || ' mm' AS remarks, qty, {_spare('CAST(0.05 AS DOUBLE)')} AS spare FROM s)
SELECT item_number AS article_number, coating, remarks, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(spare) AS BIGINT) AS spare FROM t GROUP BY 1, 2, 3""")
def e7_fold(spark: SparkSession, d: str) -> DataFrame:
    return bom.folded(bom.individual_rows(bom.routed(raw(spark, d)))).select("article_number", "coating", "remarks", "qty", "spare")


_STANDARD = f"SELECT material_type, sum(q) AS qty, sum(q + {_spare('share')}) AS order_qty FROM (SELECT *, {_SHARE} AS share FROM (SELECT item_number, coating, max(material_type) AS material_type, sum(qty) AS q FROM r WHERE route = 'standard' GROUP BY 1, 2)) GROUP BY 1"


@_query("e8_material_subtotals", f"WITH {_R}, s AS ({_STANDARD}) SELECT material_type, CAST(qty AS BIGINT) AS qty, CAST(order_qty AS BIGINT) AS order_qty FROM s UNION ALL SELECT 'TOTAL', CAST(sum(qty) AS BIGINT), CAST(sum(order_qty) AS BIGINT) FROM s")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return bom.material_subtotals(bom.grouped_standard(bom.routed(raw(spark, d)))).select("material_type", "qty", "order_qty")


@_query("e8_price_summary")
def e8_price(spark: SparkSession, d: str) -> DataFrame:
    return bom.price_summary(bom.order_sheet(raw(spark, d)), {"01 Primary Supports": 4.5, "04 Beam Sections": 2.25})


_INNOVA = ["row_pos", "item_number", "qty", "description", "cast(cut_length_mm as double) AS cut_length_mm", "total_weight_kg", "remarks", "coating AS corrosion"]


@_query("e9_aggregate_innova", f"""WITH {_R}, k AS (SELECT *, CASE WHEN remarks IS NOT NULL THEN 'remark' WHEN lower(description) LIKE '%bracket%' THEN 'bracket' WHEN cut_length_mm > 0 THEN 'cut' ELSE 'plain' END AS kind FROM r),
a AS (SELECT item_number, coating AS corrosion, kind, qty::DOUBLE AS qty, row_pos FROM k WHERE kind = 'remark'
 UNION ALL SELECT item_number, coating, kind, CASE WHEN kind = 'cut' AND max(lower(description)) LIKE '%threaded rod%' THEN ceil(sum(qty * cut_length_mm) / 2000) ELSE sum(qty) END, min(row_pos) FROM k WHERE kind <> 'remark' GROUP BY item_number, coating, regexp_replace(CASE WHEN description LIKE '%abric Tape%' THEN description ELSE regexp_replace(description, '^(.*?) x [0-9]+', '\\1') END, ' +$', ''), kind)
SELECT item_number, corrosion, kind, qty, row_pos, count(*) OVER (PARTITION BY item_number, corrosion) > 1 AS duplicate FROM a""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return bom.aggregate_innova(raw(spark, d).selectExpr(*_INNOVA)).select("item_number", "corrosion", "kind", "qty", "row_pos", "duplicate")


PRICE = [ROW, "concat(case l_partkey % 6 when 0 then 'Elbow' when 1 then 'Weldolet' when 2 then 'Seal ring FKM' when 3 then 'TUBI pipe' when 4 then 'Flange WN' else 'Hex bolt with nut' end, ' ', cast(l_partkey % 30 as string)) AS description",
         "case l_partkey % 6 when 4 then 'FLAN' else concat('DN', cast(l_partkey % 100 as string)) end AS type", "case when l_partkey % 6 = 3 then 'Tubi' else 'Fitting' end AS type_label", "case when l_suppkey % 3 = 0 then '1.4571' when l_suppkey % 3 = 1 then 'P235' else 'N/A' end AS material",
         "concat('DN', cast(15 + l_partkey % 5 * 25 as string)) AS size", "case l_suppkey % 4 when 0 then '03 CS shop' when 1 then '05 Paint shop' when 2 then '04 Erection' else '02 SS shop' end AS material_type", "concat('SYS', cast(l_suppkey % 3 as string)) AS system",
         "case when l_linenumber = 2 then 0 else l_quantity end AS qty_pcs", "case when l_linenumber = 2 then l_quantity * 1.5 else 0 end AS qty_m", "l_extendedprice / 100 AS weight_kg", "l_tax * 100 AS surface_m2", "l_returnflag AS corrosion_category",
         "l_linestatus AS paint_colour", "case when l_linenumber = 4 then 'branch' else '' end AS add_info", "concat('KKS', cast(l_suppkey % 20 as string)) AS kks", "l_linestatus AS file"]
_P = f"p AS ({derived_sql('lineitem', PRICE)})"


def price(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "lineitem", PRICE)


@_query("e10_aggregate_price", f"""WITH {_P} SELECT description, material, type, size, CASE WHEN lower(material_type) LIKE '%paint%' THEN 'paint' WHEN lower(material_type) LIKE '%erection%' THEN 'erection' ELSE 'shop' END AS bucket,
CASE WHEN lower(material_type) LIKE '%paint shop%' THEN corrosion_category END AS corrosion_category, CASE WHEN lower(material_type) LIKE '%paint shop%' THEN paint_colour END AS paint_colour, sum(qty_pcs) AS qty_pcs, round(sum(qty_m), 3) AS qty_m FROM p WHERE NOT (upper(description) LIKE '%OLET%' AND add_info = 'branch') GROUP BY ALL""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return bom.aggregate_price(price(spark, d)).select("description", "material", "type", "size", "bucket", "corrosion_category", "paint_colour", "qty_pcs", F.round("qty_m", 3).alias("qty_m"))


@_query("e11_orifice_groups", f"WITH {_P} SELECT description, size, sum(qty_pcs) AS qty_pcs, 'KKS: ' || (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT DISTINCT kks AS k FROM p x WHERE x.description = p.description AND x.size = p.size)) AS note FROM p GROUP BY ALL")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return bom.orifice_groups(price(spark, d))


_SEAL = "concat('Orifice with seal ', cast(1 + l_linenumber % 3 as string), ' x ', cast(10000 + l_suppkey as string)) AS description"


@_query("e11_seal_rows", "WITH s AS (SELECT CAST(10000 + l_suppkey AS VARCHAR) AS order_no, sum(l_quantity * (1 + l_linenumber % 3)) AS qty_pcs FROM lineitem GROUP BY 1) SELECT order_no, qty_pcs, CASE WHEN CAST(order_no AS BIGINT) % 2 = 0 THEN 'DN' || order_no END AS size FROM s")
def e11_seal(spark: SparkSession, d: str) -> DataFrame:
    sizes = derived(spark, d, "supplier", ["cast(10000 + s_suppkey as string) AS order_no", "concat('DN', cast(10000 + s_suppkey as string)) AS size"], "s_suppkey % 2 = 0")
    return bom.seal_rows(derived(spark, d, "lineitem", [_SEAL, "l_quantity AS qty_pcs"]), sizes)


_MAIN = """CASE WHEN q <= 0 THEN 'none' WHEN seal AND q <= 10 THEN '#1' WHEN seal THEN '#2' WHEN tubi THEN '#T1' WHEN pcs AND q <= 5 THEN '#5' WHEN pcs AND q <= 20 THEN '#6' WHEN pcs AND sz < 50 THEN '#7a' WHEN pcs THEN '#7b' WHEN sz < 50 THEN '#8a' ELSE '#8b' END AS rule,
CASE WHEN q <= 0 THEN 0 WHEN seal AND q <= 10 THEN 5 WHEN seal THEN greatest(5, ceil(q * CAST(0.10 AS DOUBLE))) WHEN tubi THEN greatest(0, ceil((q + ceil(q * CASE WHEN sz > 0 AND sz < 50 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.10 AS DOUBLE) END)) / 6) * 6 - q)
WHEN pcs AND q <= 5 THEN 0 WHEN pcs AND q <= 20 THEN 1 WHEN pcs AND sz < 50 THEN ceil(q * CAST(0.075 AS DOUBLE)) WHEN pcs THEN ceil(q * CAST(0.05 AS DOUBLE)) WHEN sz < 50 THEN ceil(q * CAST(0.15 AS DOUBLE)) ELSE ceil(q * CAST(0.10 AS DOUBLE)) END AS spare"""


@_query("e12_spare_main", f"""WITH {_P}, x AS (SELECT row_pos, CASE WHEN qty_pcs > 0 THEN qty_pcs ELSE qty_m END AS q, qty_pcs > 0 AS pcs, coalesce(try_cast(nullif(regexp_extract(type, '([0-9]+)', 1), '') AS DOUBLE), 0) AS sz, description LIKE 'Seal ring%' AS seal, description LIKE 'TUBI%' AS tubi FROM p) SELECT row_pos, {_MAIN} FROM x""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return rules.spare_main(price(spark, d)).select("row_pos", "rule", "spare")


_NWB = "CASE WHEN q <= 30 THEN 1 WHEN q <= 100 THEN CAST(0.5 AS DOUBLE) WHEN q <= 400 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END"
_STEP = "CASE WHEN t <= 100 THEN ceil(t / 10) * 10 WHEN t <= 500 THEN ceil(t / 50) * 50 ELSE ceil(t / 100) * 100 END"


@_query("e13_spare_erection", f"""WITH x AS (SELECT {ROW}, l_quantity * 10 AS q, l_partkey % 4 AS kind FROM lineitem), y AS (SELECT *, q + ceil(q * {_NWB}) AS t FROM x)
SELECT row_pos, CASE kind WHEN 0 THEN {_STEP} - q WHEN 1 THEN ceil(t / 10) * 10 - q WHEN 2 THEN CASE WHEN q <= 30 THEN q WHEN q <= 500 THEN ceil((q + ceil(q * CAST(0.5 AS DOUBLE))) / 10) * 10 - q ELSE ceil((q + ceil(q * CAST(0.3 AS DOUBLE))) / 10) * 10 - q END ELSE CASE WHEN q < 400 THEN ceil(q * CAST(0.35 AS DOUBLE)) ELSE ceil(q * CAST(0.2 AS DOUBLE)) END END AS spare,
CASE kind WHEN 0 THEN '#' || n WHEN 1 THEN '#' || n || 'B' WHEN 2 THEN CASE WHEN q <= 30 THEN '#5' WHEN q <= 500 THEN '#6' ELSE '#7' END ELSE CASE WHEN q < 400 THEN '#8' ELSE '#9' END END AS rule FROM (SELECT *, CASE WHEN q <= 30 THEN 1 WHEN q <= 100 THEN 2 WHEN q <= 400 THEN 3 ELSE 4 END AS n FROM y)""")
def e13(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "lineitem", [ROW, "l_quantity * 10 AS qty_pcs", "case l_partkey % 4 when 0 then 'Washer A' when 1 then 'Hex bolt' when 2 then 'Flat gasket' else 'Clamp' end AS description"])
    return rules.spare_erection(rows).select("row_pos", "spare", "rule")


@_query("e14_order_columns", f"WITH {_P}, x AS (SELECT row_pos, CASE WHEN qty_pcs > 0 THEN qty_pcs ELSE qty_m END AS q, weight_kg FROM p) SELECT row_pos, q + 3 AS total_qty, CAST(floor(round(weight_kg / q, 6) * 1000 + 0.3337) AS BIGINT) AS unit_grams, CAST(floor(round(weight_kg / q * (q + 3), 3) + 0.3337) AS BIGINT) AS kg_w_spare FROM x")
def e14(spark: SparkSession, d: str) -> DataFrame:
    return rules.order_columns(price(spark, d).withColumn("spare", F.lit(3))).select("row_pos", "total_qty", F.floor(F.col("unit_weight") * 1000 + 0.3337).alias("unit_grams"), F.floor(F.col("weight_w_spare") + 0.3337).alias("kg_w_spare"))


_TUBI = [ROW, "case when l_linenumber % 2 = 0 then 'paint' else 'cs' end AS shop", "l_partkey % 300 AS size", "l_quantity AS total"]


@_query("e15_align_tubi", f"""WITH t AS ({derived_sql('lineitem', _TUBI)}), s AS (SELECT size, sum(total) FILTER (shop = 'paint') AS paint, sum(total) FILTER (shop = 'cs') AS cs FROM t GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY shop, size ORDER BY total DESC, row_pos) AS k FROM t)
SELECT row_pos, CASE WHEN shop = 'cs' AND k = 1 AND paint > cs THEN paint - cs ELSE 0 END AS added, CASE WHEN paint IS NOT NULL AND cs IS NULL THEN 'no shop row' WHEN paint > cs THEN 'aligned to paint' WHEN paint < cs THEN 'paint below shop' ELSE '' END AS note FROM r JOIN s USING (size)""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    return rules.align_tubi(derived(spark, d, "lineitem", _TUBI)).select("row_pos", "added", "note")


@_query("e16_touch_up_paint", f"""WITH {_P}, a AS (SELECT paint_colour AS colour, surface_m2 * CASE WHEN description LIKE 'TUBI%' THEN CAST(0.05 AS DOUBLE) ELSE 1 END AS m2 FROM p), b AS (SELECT * FROM a UNION ALL SELECT 'basic only', m2 FROM a) SELECT colour, round(sum(m2), 3) AS m2 FROM b GROUP BY 1""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    return rules.touch_up_paint(price(spark, d)).select("colour", F.round("m2", 3).alias("m2"))


@_query("e17_blind_disks", f"WITH {_P} SELECT CAST(substr(size, 3) AS INTEGER) AS dn, sum(qty_pcs) AS flanges, CASE WHEN sum(qty_pcs) > 50 THEN 10 WHEN sum(qty_pcs) > 30 THEN 4 ELSE 2 END AS disks, CASE CAST(substr(size, 3) AS INTEGER) WHEN 15 THEN 3.0 WHEN 40 THEN 4.0 END AS thickness_mm FROM p WHERE lower(description) LIKE '%flan%' GROUP BY 1, 4")
def e17(spark: SparkSession, d: str) -> DataFrame:
    return rules.blind_disks(price(spark, d), {15: 3.0, 40: 4.0})


@_query("e18_flange_guards", f"WITH {_P} SELECT material, size, system, sum(qty_pcs) AS qty, greatest(1, ceil(sum(qty_pcs) * CAST(0.05 AS DOUBLE))) AS spare FROM p WHERE type = 'FLAN' AND system IN ('SYS0', 'SYS2') GROUP BY 1, 2, 3")
def e18(spark: SparkSession, d: str) -> DataFrame:
    return rules.flange_guards(price(spark, d), ["sys0", "sys2"])


@_query("e19_support_weights", """WITH l AS (SELECT l_suppkey AS s, sum(l_extendedprice) AS kg, max(greatest(l_linenumber, 25)) AS nb FROM lineitem GROUP BY 1), p AS (SELECT l_suppkey AS s, sum(l_quantity) AS kg, max(l_linenumber * 10) AS nb FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1)
SELECT l.s AS support_structure, coalesce(p.nb, l.nb)::DOUBLE AS nb, CASE WHEN coalesce(p.nb, l.nb) <= 40 THEN 'SB' ELSE 'LB' END AS bore, round(coalesce(p.kg, 0), 2) AS primary_kg, round(l.kg - coalesce(p.kg, 0), 2) AS secondary_kg FROM l LEFT JOIN p USING (s)""")
def e19(spark: SparkSession, d: str) -> DataFrame:
    pps = derived(spark, d, "lineitem", ["l_suppkey AS support_structure", "cast(l_partkey as string) AS pipe_support", "cast(l_linenumber * 10 as double) AS nb", "l_quantity AS total_weight"], "l_suppkey % 7 <> 0")
    listed = derived(spark, d, "lineitem", ["l_suppkey AS support_structure", "concat(cast(l_linenumber as string), ', 25') AS nb_text", "l_extendedprice AS total_weight"])
    return bom.support_weights(pps, listed).select("support_structure", "nb", "bore", F.round("primary_kg", 2).alias("primary_kg"), F.round("secondary_kg", 2).alias("secondary_kg"))


@_query("e20_weight_by_dn", f"WITH {_P}, g AS (SELECT file, CAST(substr(size, 3) AS DOUBLE) AS dn, sum(weight_kg) AS w, count(*) AS n FROM p WHERE material = '1.4571' GROUP BY 1, 2) SELECT file, dn, CAST(floor(w + 0.3337) AS BIGINT) AS weight_kg, n FROM g UNION ALL SELECT 'SUMMARY', dn, CAST(floor(sum(w) + 0.3337) AS BIGINT), CAST(sum(n) AS BIGINT) FROM g GROUP BY dn")
def e20(spark: SparkSession, d: str) -> DataFrame:
    return bom.weight_by_dn(price(spark, d)).select("file", "dn", F.floor(F.col("weight_kg") + 0.3337).alias("weight_kg"), "n")


@_query("f3_assign_uids", f"""WITH {_P}, x AS (SELECT *, CASE WHEN material_type LIKE '%CS shop' THEN 3 WHEN material_type LIKE '%Paint shop' THEN 5 WHEN material_type LIKE '%Erection' THEN 4 ELSE 2 END AS c FROM p)
SELECT row_pos, printf('%02d-%s-%03d', c, CASE c WHEN 3 THEN 'CS' WHEN 5 THEN 'PAS' WHEN 4 THEN 'ER' ELSE 'SS' END, row_number() OVER (PARTITION BY c ORDER BY lower(type), material = 'N/A', lower(material), CAST(substr(size, 3) AS DOUBLE), lower(size), row_pos)) AS uid FROM x""")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return rules.assign_uids(price(spark, d)).select("row_pos", "uid")


_PRICED = ["l_orderkey * 10 + l_linenumber AS row_pos", "case l_suppkey % 9 when 0 then '01 Mapress shop' when 1 then '02 SS shop' when 2 then '03 CS shop' when 3 then '05 Paint shop' when 4 then '04 Erection' when 5 then '06 Paint erection' when 6 then 'SS site' when 7 then 'paint other' else 'Zinc' end AS material_type",
           "l_linestatus AS material", "case when l_linenumber = 1 then null else l_returnflag end AS type", "case when l_partkey % 6 = 0 then 'N/A' when l_partkey % 6 = 1 then concat(' ', cast(l_partkey % 40 as string), ',5') when l_partkey % 6 = 2 then 'DN x' else cast(l_partkey % 90 as string) end AS size"]


@_query("g1_price_order", f"""WITH p AS ({derived_sql('lineitem', _PRICED)}), r AS (SELECT *, CASE WHEN material_type LIKE '%Mapress shop' THEN 0 WHEN material_type LIKE '%SS shop' THEN 1 WHEN material_type LIKE '%CS shop' THEN 2 WHEN material_type LIKE '%Paint shop' THEN 3 WHEN material_type LIKE '%Paint erection' THEN 5 WHEN material_type LIKE '%Erection' THEN 4 WHEN material_type LIKE 'SS%' THEN 7 WHEN material_type LIKE 'paint%' THEN 9 ELSE 10 END AS rank,
  try_cast(replace(replace(size, ' ', ''), ',', '.') AS DOUBLE) AS n FROM p) SELECT row_pos, row_number() OVER (ORDER BY rank, material, coalesce(type, ''), n IS NULL, coalesce(n, 0), trim(size), material_type, row_pos) AS place FROM r""")
def g1_price(spark: SparkSession, d: str) -> DataFrame:
    return bom.price_order(derived(spark, d, "lineitem", _PRICED)).select("row_pos", F.col("place").cast("long").alias("place"))


@_query("v1_validate_order_sheet")
def v1(spark: SparkSession, d: str) -> DataFrame:
    """weight_kg, which the table does not have, is the total weight by piece; one row in a hundred is 1 kg off."""
    rows = raw(spark, d).withColumn("weight_kg", F.col("total_weight_kg") / F.col("qty") + F.when(F.col("row_pos") % 100 == 0, 1.0).otherwise(0.0))
    return validate.validate_order_sheet(rows, staged(bom.order_sheet(rows), "order-sheet"))


_FLAGGED = [ROW, "concat('f', cast(l_suppkey as string)) AS filename", "case when l_linenumber = 1 then '' else cast(l_partkey as string) end AS article_number", "case when l_linenumber = 2 then null else 'x' end AS description", "case when l_linenumber = 3 then '0' else cast(l_quantity as string) end AS qty",
            "case when l_linenumber = 4 then 'n' else '2' end AS weight", "cast(case when l_partkey % 5 = 0 then 1 else l_quantity * 2 end as string) AS total_weight", "'' AS kks", "case when l_linenumber = 5 then ' ' else 'k' end AS kks_su"]
_FLAGS = """concat_ws('; ', CASE WHEN article_number = '' THEN 'missing article' END, CASE WHEN description IS NULL THEN 'missing description' END, CASE WHEN CAST(qty AS DOUBLE) <= 0 THEN 'qty not positive' END, CASE WHEN weight = 'n' THEN 'missing weight' END,
CASE WHEN weight <> 'n' AND abs(CAST(qty AS DOUBLE) * 2 - CAST(total_weight AS DOUBLE)) > 0.05 * greatest(CAST(total_weight AS DOUBLE), 1) THEN 'total weight differs' END, CASE WHEN kks_su = ' ' THEN 'missing code' END)"""


@_query("v2_quality_flags", f"SELECT row_pos, {_FLAGS} AS flags FROM ({derived_sql('lineitem', _FLAGGED)})")
def v2(spark: SparkSession, d: str) -> DataFrame:
    return validate.quality_flags(derived(spark, d, "lineitem", _FLAGGED)).select("row_pos", "flags")


@_query("v2_flag_breakdown", f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split({_FLAGS}, '; ')) AS flag FROM ({derived_sql('lineitem', _FLAGGED)})) WHERE flag <> '' GROUP BY 1")
def v2_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return validate.flag_breakdown(validate.quality_flags(derived(spark, d, "lineitem", _FLAGGED)))


_LINES = ["p_partkey AS row_pos", "case p_partkey % 5 when 0 then 'Water' when 1 then 'Steam' when 2 then 'Gas' when 3 then 'Hydraulic oil' end AS medium", "case p_partkey % 3 when 0 then '1' else '2' end AS fluid_group", "cast(p_size * p_size / 4 - 1 as double) AS ps", "cast(p_partkey % 500 as double) AS dn"]


def _pressure_sql() -> str:
    phase = "CASE WHEN medium IS NULL THEN 'Unknown' WHEN medium IN ('Water', 'Hydraulic oil') THEN 'Liquid' ELSE 'Gas' END"
    whens = " ".join(f"WHEN phase = '{k}' AND {'true' if g == 'any' else f'fluid_group = {chr(39)}{g}{chr(39)}'} AND ({rules.criteria_sql(c)}) THEN '{n}'" for n in rules.CATEGORIES for k, g, c, m in rules.PRESSURE_RULES if m == n)
    return f"WITH t AS (SELECT *, ps AS \"PS\", dn AS \"DN\", {phase} AS phase FROM ({derived_sql('part', _LINES)})) SELECT row_pos, CASE WHEN phase = 'Unknown' OR ps < 0 OR dn < 0 THEN 'Invalid Data' {whens} ELSE 'Not Categorized' END AS category FROM t".replace('ps AS "PS", dn AS "DN", ', "")


@_query("d17_categorise_by_rules", _pressure_sql())
def d17(spark: SparkSession, d: str) -> DataFrame:
    return rules.categorise_by_rules(derived(spark, d, "part", _LINES)).select("row_pos", "category")


_LIST = [ROW, "case l_linenumber when 1 then null when 2 then ' Steam' else 'Water' end AS medium", "cast(l_quantity as string) AS ps", "case when l_linenumber = 3 then 'x' else cast(l_suppkey as string) end AS ts", "concat('DN ', cast(l_partkey % 400 as string)) AS dn", "case l_linenumber % 3 when 0 then 'PN16' when 1 then 'PN' else '25' end AS pn",
         "case when l_linenumber = 5 then '' else '1.0425' end AS material", "concat('A', cast(l_suppkey % 5 as string)) AS pipe_class", "concat('sec', cast(l_partkey % 7 as string)) AS process_section"]
_CLASSES = [("A1", "Water", 16.0, 0.0, 80.0, 15.0, 300.0, "1.0425"), ("A2", "Gas, Steam", 25.0, -10.0, 50.0, 15.0, 100.0, "1.0425"), ("A3", "Water, Steam", 40.0, 0.0, 80.0, 50.0, 400.0, "1.4571")]
_CLASS_SQL = f"c(pipe_class, c_medium, c_pn, t_min, t_max, dn_from, dn_to, c_material) AS (VALUES {', '.join(str(c) for c in _CLASSES)})"
_CHECKED = f"""l AS (SELECT *, try_cast(ps AS DOUBLE) AS p, try_cast(ts AS DOUBLE) AS t, CAST(substr(dn, 4) AS DOUBLE) AS n FROM ({derived_sql('lineitem', _LIST)})), {_CLASS_SQL},
k AS (SELECT l.*, c.c_pn, CASE WHEN c_pn IS NULL THEN NULL WHEN medium IS NULL THEN 'nan' WHEN list_contains(string_split(c_medium, ', '), trim(medium)) THEN 'OK' ELSE 'NOK' END AS k1, CASE WHEN c_pn IS NULL THEN NULL WHEN p <= c_pn THEN 'OK' ELSE 'NOK' END AS k2,
CASE WHEN c_pn IS NULL THEN NULL WHEN t IS NULL THEN 'nan' WHEN t BETWEEN t_min AND t_max THEN 'OK' ELSE 'NOK' END AS k3, CASE WHEN c_pn IS NULL THEN NULL WHEN n BETWEEN dn_from AND dn_to THEN 'OK' ELSE 'NOK' END AS k4,
CASE WHEN c_pn IS NULL THEN NULL WHEN try_cast(nullif(regexp_extract(pn, '([0-9]+)', 1), '') AS DOUBLE) = c_pn THEN 'OK' ELSE 'NOK' END AS k5, CASE WHEN c_pn IS NULL THEN NULL WHEN material = c_material THEN 'OK' ELSE 'NOK' END AS k6 FROM l LEFT JOIN c USING (pipe_class))"""


def _list_text(state: str) -> str:
    return "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN k{i} = '{state}' THEN '{n}' END" for i, n in enumerate(rules.CHECKS, 1)) + "), '')"


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CLASSES, "pipe_class string, medium string, pn double, t_min double, t_max double, dn_from double, dn_to double, material string")


def checked(spark: SparkSession, d: str) -> DataFrame:
    return rules.check_line_list(derived(spark, d, "lineitem", _LIST), classes(spark))


@_query("d11_check_line_list", f"WITH {_CHECKED} SELECT row_pos, k1 AS check_medium, k3 AS check_ts, k5 AS check_pn, CASE WHEN c_pn IS NULL THEN 'class not found' ELSE coalesce(nullif(concat_ws('; ', 'NOK: ' || {_list_text('NOK')}, 'nan: ' || {_list_text('nan')}), ''), 'OK') END AS status FROM k")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).select("row_pos", "check_medium", "check_ts", "check_pn", "status")


@_query("e25_pipe_class_summary", f"""WITH {_CHECKED}, o AS (SELECT pipe_class, pn, arg_min(k5, row_pos) AS r FROM k GROUP BY 1, 2), v AS (SELECT pipe_class, coalesce(string_agg(pn, ', ' ORDER BY pn) FILTER (r = 'OK'), '') AS valid, coalesce(string_agg(pn, ', ' ORDER BY pn) FILTER (r = 'NOK'), '') AS invalid FROM o GROUP BY 1)
SELECT pipe_class, count(*) AS n, round(100.0 * count(*) FILTER (k5 = 'OK') / count(*), 1) AS compliance, max(valid) AS valid, max(invalid) AS invalid, pipe_class IN ('A1', 'A2', 'A3') AS in_reference FROM k JOIN v USING (pipe_class) GROUP BY 1""")
def e25(spark: SparkSession, d: str) -> DataFrame:
    return rules.pipe_class_summary(checked(spark, d), classes(spark), "pn")


@_query("e26_process_section_summary", f"""WITH l AS ({derived_sql('lineitem', _LIST)}) SELECT process_section, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT pipe_class AS x FROM l i WHERE i.process_section = l.process_section)) AS classes, count(*) AS n, count(DISTINCT pipe_class) AS n_classes,
(SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT pipe_class AS x FROM l i WHERE i.process_section = l.process_section AND pipe_class NOT IN ('A1', 'A2', 'A3'))) AS unknown_classes FROM l GROUP BY 1""")
def e26(spark: SparkSession, d: str) -> DataFrame:
    return rules.process_section_summary(derived(spark, d, "lineitem", _LIST), classes(spark)).select("process_section", "classes", "n", "n_classes", "unknown_classes")


_ALLOW = ["s_suppkey AS pos", "cast(s_suppkey % 10 as int) AS dn", "cast(s_suppkey % 37 * 3 as double) AS fax", "cast(s_suppkey % 11 * 9 as double) AS flat", "cast(s_suppkey % 17 * 7 as double) AS fz", "'guide' AS support_type", "case when s_suppkey % 9 = 0 then 'X DO NOT USE' else s_name end AS component"]
_LOAD = [ROW.replace("row_pos", "id"), "'guide' AS support_type", "cast(l_partkey % 11 as int) AS dn", "l_quantity AS qx", "-l_quantity / 2 AS qy", "cast(l_linenumber as double) AS qz", "case when l_linenumber % 2 = 0 then 'X' else 'Y' end AS axis"]


@_query("d18_select_component", f"""WITH a AS ({derived_sql('supplier', _ALLOW)}), l AS (SELECT *, CASE axis WHEN 'X' THEN abs(qx) ELSE abs(qy) END AS ax, CASE axis WHEN 'X' THEN abs(qy) ELSE abs(qx) END AS la FROM ({derived_sql('lineitem', _LOAD)})),
j AS (SELECT l.id, count(a.dn) AS n, count_if(component NOT LIKE '%DO NOT USE%') AS u, arg_min(component, fax + flat + fz + pos / 100000.0) FILTER (component NOT LIKE '%DO NOT USE%' AND fax >= ax AND flat >= la AND fz >= abs(qz)) AS component FROM l LEFT JOIN a ON a.dn = l.dn GROUP BY 1)
SELECT id, component, CASE WHEN component IS NOT NULL THEN NULL WHEN n = 0 THEN 'DN not found' WHEN u = 0 THEN 'DO NOT USE' ELSE 'no capacity' END AS miss FROM j""")
def d18(spark: SparkSession, d: str) -> DataFrame:
    return rules.select_component(derived(spark, d, "lineitem", _LOAD), derived(spark, d, "supplier", _ALLOW))


_FILES = ["concat('/f/', cast(l_orderkey as string), '-', cast(l_linenumber as string), '.pdf') AS full_path", "concat('1', chr(cast(65 + l_partkey % 5 as int)), 'TX', lpad(cast(l_suppkey % 30 as string), 2, '0')) AS system_code", "concat(chr(cast(65 + l_partkey % 5 as int)), 'TX') AS system_code_short"]


@_query("e29_distinct_codes", f"SELECT system_code_short, count(*) AS files, count(DISTINCT system_code) AS codes, min(full_path) AS example FROM ({derived_sql('lineitem', _FILES)}) GROUP BY 1")
def e29(spark: SparkSession, d: str) -> DataFrame:
    return bom.distinct_codes(derived(spark, d, "lineitem", _FILES))
