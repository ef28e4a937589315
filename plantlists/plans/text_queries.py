"""Queries of the text and date functions over texts built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import bom, rules
from .shared import Query, derived, derived_sql, scalar, table

KEY = "l_orderkey * 10 + l_linenumber AS k"
LINES = "lineitem"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, base: list[str], make, sql: dict[str, str], source: str = LINES) -> None:  # noqa: ANN001
    QUERIES[name], SQL[name] = scalar(source, base, make, sql)


C = F.col
_S = "cast(l_partkey as string)"
_add("b01_norm_label", [KEY, f"concat('  Pos-', {_S}, '.  ', l_linestatus, '/KG ') AS s"],
     lambda: {"label": text.norm_label(C("s")), "low": text.norm_text(C("s")), "up": text.norm_upper(C("s"))},
     {"label": "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))", "low": "lower(trim(s))", "up": "upper(trim(s))"})
_UNIT = "case l_linenumber % 6 when 0 then concat({0}, ',25 kg') when 1 then concat(' ', {0}, ' MM') when 2 then {0} when 3 then concat('+', {0}, '.5m') when 4 then concat({0}, ' pcs') else ' ' end AS s".format(_S)
_add("b02_parse_unit_number", [KEY, _UNIT], lambda: {"value": text.parse_unit_number(C("s"))["value"], "rest": text.parse_unit_number(C("s"))["text"]},
     {"value": "round(try_cast(nullif(replace(regexp_extract(trim(s), '(?i)^([+-]?[0-9]+(?:[.,][0-9]+)?)\\s*(?:kg|mm|m)?$', 1), ',', '.'), '') AS DOUBLE), 2)",
      "rest": "CASE WHEN regexp_extract(trim(s), '(?i)^([+-]?[0-9]+(?:[.,][0-9]+)?)\\s*(?:kg|mm|m)?$', 1) = '' AND trim(s) <> '' THEN trim(s) END"})
_NUM = "case l_linenumber % 4 when 0 then concat('1.', lpad({0}, 3, '0'), ',50 EUR') when 1 then concat({0}, ',5') when 2 then concat('ca. ', {0}, '.75') else concat({0}, ' x') end AS s".format("cast(l_partkey % 1000 as string)")
_add("b03_parse_number", [KEY, _NUM],
     lambda: {"last_sep": text.parse_number(C("s"), "last_sep"), "thousands": text.parse_number(C("s"), "comma_thousands"), "decimal": text.parse_number(C("s"), "comma_decimal", 0.0), "bare": text.parse_number(C("s"), "strip_nondigits")},
     {"last_sep": "CASE l_kind WHEN 0 THEN 1000 + n + 0.5 WHEN 1 THEN n + 0.5 WHEN 2 THEN n + 0.75 ELSE n END::DOUBLE", "thousands": "CASE l_kind WHEN 1 THEN n + 0.5 END::DOUBLE",
      "decimal": "CASE l_kind WHEN 1 THEN n + 0.5 ELSE 0 END::DOUBLE", "bare": "CASE l_kind WHEN 1 THEN n + 0.5 WHEN 3 THEN n END::DOUBLE"})
SQL["b03_parse_number"] = SQL["b03_parse_number"].replace("SELECT l_orderkey", "SELECT l_partkey % 1000 AS n, l_linenumber % 4 AS l_kind, l_orderkey", 1)
_STRICT = "case l_linenumber % 7 when 0 then concat('(', {0}, '.50)') when 1 then concat({0}, '%') when 2 then concat('EUR', {0}) when 3 then concat('1,', lpad({0}, 3, '0')) when 4 then concat('€ 1,', lpad({0}, 3, '0'), '.25') when 5 then concat({0}, '-') else concat({0}, 'e2') end AS s".format("cast(l_partkey % 1000 as string)")
_add("b04_parse_number_strict", [KEY, _STRICT], lambda: {"value": text.parse_number_strict(C("s"))["value"], "decimals": text.parse_number_strict(C("s"))["decimals"], "percent": text.parse_number_strict(C("s"))["is_percent"]},
     {"value": "CASE kind WHEN 0 THEN -(n + 0.5) WHEN 1 THEN n / 100.0 WHEN 4 THEN 1000 + n + 0.25 WHEN 5 THEN -n WHEN 6 THEN n * 100 END::DOUBLE", "decimals": "CASE WHEN kind = 0 THEN 2 WHEN kind = 4 THEN 2 WHEN kind IN (1, 5, 6) THEN 0 END",
      "percent": "CASE WHEN kind IN (0, 1, 4, 5, 6) THEN kind = 1 END"})
SQL["b04_parse_number_strict"] = SQL["b04_parse_number_strict"].replace("SELECT l_orderkey", "SELECT l_partkey % 1000 AS n, l_linenumber % 7 AS kind, l_orderkey", 1)
_add("b05_preserve_decimals", [KEY, f"case l_linenumber % 3 when 0 then concat('DN ', {_S}) when 1 then concat({_S}, ',250') else concat({_S}, ' bar') end AS s"],
     lambda: {"value": text.preserve_decimals(C("s"))["value"], "decimals": text.preserve_decimals(C("s"))["decimals"]},
     {"value": "try_cast(replace(regexp_extract(s, '^(?:DN )?([0-9]+(?:,[0-9]+)?)$', 1), ',', '.') AS DOUBLE)", "decimals": "CASE WHEN s LIKE 'DN%' THEN 0 WHEN s LIKE '%,250' THEN 3 END"})
_add("b07_cell_text", [KEY, "cast(l_quantity as double) / 4 AS q", f"concat(' ', {_S}, ' ') AS s"], lambda: {"q_text": text.cell_text(C("q"), "double", 1), "s_text": text.cell_text(C("s"))},
     {"q_text": "CASE WHEN round(q, 1) = floor(round(q, 1)) THEN CAST(CAST(round(q, 1) AS BIGINT) AS VARCHAR) ELSE CAST(round(q, 1) AS VARCHAR) END", "s_text": "trim(s)"})
_add("b08_codes_articles", [KEY, f"concat(' 1htx ', lpad({_S}, 6, '0'), case when l_linenumber % 2 = 0 then '/su1' else '' end) AS code", f"concat({_S}, case when l_linenumber % 2 = 0 then '.0' else 'A' end) AS art", "case l_linenumber % 3 when 0 then '0' when 1 then concat(cast(l_suppkey as string), ',6') else 'x' end AS cut"],
     lambda: {"code_n": text.norm_code(C("code")), "art_n": text.norm_article(C("art")), "cut_n": text.norm_cut_length(C("cut"))},
     {"code_n": "CASE WHEN upper(code) LIKE '%/SU%' THEN '/' ELSE '' END || upper(regexp_replace(code, '\\s+', '', 'g'))", "art_n": "regexp_replace(art, '\\.0$', '')", "cut_n": "CASE WHEN cut LIKE '%,6' THEN CAST(replace(cut, ',6', '') AS BIGINT) + 1 END"})
_add("b09_strip_cut_length", [KEY, "concat('Beam section MS 41', case l_linenumber % 3 when 0 then concat(' x ', cast(100 + l_partkey % 900 as string), ' HCP') when 1 then concat(' x ', cast(1000 + l_partkey % 900 as string)) else ' x 12' end) AS s"],
     lambda: {"a": text.strip_cut_length(C("s")), "b": text.strip_cut_length(C("s"), "first")},
     {"a": "CASE WHEN s LIKE '%HCP' THEN 'Beam section MS 41 HCP' WHEN s LIKE '% x 12' THEN s ELSE 'Beam section MS 41' END", "b": "trim(regexp_replace(s, ' x [0-9]+', ''))"})
_add("b10_numbers_in_text", [KEY, f"concat(case when l_linenumber % 2 = 0 then 'DN ' else 'DN' end, {_S}, ',5 mm') AS s", "concat(cast(l_linenumber as string), ', ', cast(l_suppkey as string), ', 25') AS lst"],
     lambda: {"first": text.first_int(C("s")), "dn": text.dn_number(C("s")), "num": text.extract_numeric(C("s")), "most": text.max_in_list(C("lst"))},
     {"first": "CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT)", "dn": "CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) + 0.5", "num": "CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) + 0.5", "most": "list_max([CAST(trim(x) AS DOUBLE) FOR x IN string_split(lst, ',')])"})
_add("b11_natural_key", [KEY, f"concat('a', cast(l_linenumber as string), 'ba', {_S}) AS s"], lambda: {"token": text.natural_key(C("s"))},
     {"token": "'A' || lpad(regexp_extract(s, 'a([0-9]+)ba', 1), 6, '0') || 'BA' || lpad(regexp_extract(s, 'ba([0-9]+)', 1), 6, '0')"})
_KINDS = "case p_partkey % 9 when 0 then 'TP F 80 rail' when 1 then 'WD F console' when 2 then 'Stabil D' when 3 then 'Hex nut M10' when 4 then 'Glass fabric tape' when 5 then 'Bracket with bolt' when 6 then 'Threaded rod M10/2000' when 7 then 'Unknown thing' else p_name end AS s"


def _cases(kinds) -> str:  # noqa: ANN001
    parts = [f"WHEN lower(s) LIKE '{p.lower()}%' THEN '{label}'" for label, prefixes, _ in kinds for p in prefixes] + [f"WHEN lower(s) LIKE '%{w}%' THEN '{label}'" for label, _, words in kinds for w in words]
    return f"CASE {' '.join(parts)} ELSE '' END"


_add("b12_classify_by_rules", ["p_partkey AS k", _KINDS], lambda: {"label": text.classify_by_rules(C("s"), bom.MATERIAL_RULES)}, {"label": _cases(bom.MATERIAL_RULES)}, "part")
_add("b13_material_buckets", ["p_partkey AS k", "case p_size % 7 when 0 then '03 CS shop' when 1 then '04 Erection' when 2 then '05 Paint shop' when 3 then '06 Paint erection' when 4 then '02 SS shop' when 5 then '07 Blind disks' else 'x' end AS s", "case when p_partkey % 2 = 0 then 'C5-I' else 'HCP' end AS coat"],
     lambda: {"bucket": bom.material_bucket(C("s")), "number": rules.uid_category(C("s"))["number"], "code": rules.uid_category(C("s"))["code"], "mapped": bom.remap_coating(F.lit("01 Primary Supports"), C("coat"))},
     {"bucket": "CASE WHEN lower(s) LIKE '%paint%' THEN 'paint' WHEN lower(s) LIKE '%erection%' THEN 'erection' WHEN lower(s) LIKE '%shop' THEN 'shop' ELSE 'other' END",
      "number": "CASE s WHEN '03 CS shop' THEN 3 WHEN '04 Erection' THEN 4 WHEN '05 Paint shop' THEN 5 WHEN '06 Paint erection' THEN 6 WHEN '02 SS shop' THEN 2 WHEN '07 Blind disks' THEN 7 ELSE 99 END",
      "code": "CASE s WHEN '03 CS shop' THEN 'CS' WHEN '04 Erection' THEN 'ER' WHEN '05 Paint shop' THEN 'PAS' WHEN '06 Paint erection' THEN 'PAE' WHEN '02 SS shop' THEN 'SS' WHEN '07 Blind disks' THEN 'BD' ELSE 'OT' END",
      "mapped": "CASE WHEN coat LIKE '%C5%' THEN '06 Primary Supports C5' ELSE '01 Primary Supports' END"}, "part")
_add("b14_fluid_phase", ["p_partkey AS k", "case p_size % 5 when 0 then 'Feed Water' when 1 then 'Steam' when 2 then 'lube OIL' when 3 then 'unknown stuff' end AS s"], lambda: {"phase": text.fluid_phase(C("s"), rules.LIQUID, rules.GAS)},
     {"phase": "CASE WHEN s IS NULL THEN 'Unknown' WHEN lower(s) LIKE '%water%' OR lower(s) LIKE '%oil%' THEN 'Liquid' ELSE 'Gas' END"}, "part")
_add("b15_building_section", ["s_suppkey AS k", "case s_suppkey % 4 when 0 then 'a12-UMA-3' when 1 then 'YARD' when 2 then 'XX9' else concat('UBC', cast(s_suppkey as string)) end AS s", "case when s_suppkey % 5 = 0 then null else cast(s_suppkey % 80 as double) end AS nb"],
     lambda: {"section": text.building_section(C("s"), ["YARD"]), "bore": text.bore_class(C("nb"))},
     {"section": "CASE WHEN s = 'YARD' THEN 'N/A' WHEN s LIKE '%UMA%' THEN 'UMA' WHEN s LIKE 'UBC%' THEN 'UBC' ELSE 'UNKNOWN' END", "bore": "CASE WHEN nb IS NULL THEN 'Unknown' WHEN nb <= 40 THEN 'SB' ELSE 'LB' END"}, "supplier")
QUERIES["b16_bore_class"], SQL["b16_bore_class"] = scalar(LINES, [KEY, "cast(l_quantity as double) AS nb"], lambda: {"bore": text.bore_class(C("nb"), 25)}, {"bore": "CASE WHEN nb <= 25 THEN 'SB' ELSE 'LB' END"})
_CODE = "concat('see 1HTX', lpad(cast(l_linenumber * 7 as string), 2, '0'), 'BR', lpad(cast(l_suppkey % 1000 as string), 3, '0'), ' and 2 hgc 60 br 100, 1HTX', lpad(cast(l_linenumber * 7 as string), 2, '0'), 'BR', lpad(cast(l_suppkey % 1000 as string), 3, '0'))"
_add("b17_extract_codes", [KEY, f"{_CODE} AS s"], lambda: {"codes": F.array_join(text.extract_codes(C("s")), ","), "pipes": F.array_join(text.extract_codes(C("s"), text.PIPE_CODE), ",")},
     {"codes": "regexp_extract(s, '1HTX[0-9]{2}BR[0-9]{3}') || ',2HGC60BR100'", "pipes": "regexp_extract(s, '1HTX[0-9]{2}BR[0-9]{3}')"})
_add("b19_filename_fields", [KEY, "concat('PRJ-XY-1HTX', lpad(cast(l_linenumber as string), 2, '0'), 'BR', lpad(cast(l_suppkey % 1000 as string), 3, '0'), '-A_2.', cast(l_linenumber as string), '.pdf') AS s"],
     lambda: {n: text.filename_fields(C("s"))[n] for n in ("code", "system", "line_no", "short", "revision")},
     {"code": "string_split(s, '-')[3]", "system": "substr(string_split(s, '-')[3], 1, 6)", "line_no": "right(string_split(s, '-')[3], 3)", "short": "'HTX'", "revision": "regexp_extract(s, '_([0-9]+\\.[0-9]+)', 1)"})
_add("b20_parse_list_literal", [KEY, f"case when l_linenumber % 2 = 0 then concat('[''A', {_S}, ''',''B'']') else concat(' ', {_S}) end AS s"], lambda: {"n": F.size(text.parse_list_literal(C("s"))), "first": text.parse_list_literal(C("s"))[0]},
     {"n": "CASE WHEN s LIKE '[%' THEN 2 ELSE 1 END", "first": "CASE WHEN s LIKE '[%' THEN regexp_extract(s, '(A[0-9]+)', 1) ELSE trim(s) END"})
_add("b21_parse_xyz", [KEY, f"concat('X ', {_S}, 'mm Y -', cast(l_suppkey as string), '.5mm Z ', case when l_linenumber = 1 then 'n/a' else '7mm' end) AS s"], lambda: {a: text.parse_xyz(C("s"))[a] for a in "xyz"},
     {"x": "CAST(regexp_extract(s, 'X ([0-9]+)mm', 1) AS DOUBLE)", "y": "CAST(regexp_extract(s, 'Y (-[0-9.]+)mm', 1) AS DOUBLE)", "z": "CASE WHEN s LIKE '%7mm' AND s NOT LIKE '%n/a' THEN 7.0 END::DOUBLE"})
_add("b22_extract_dates", ["o_orderkey AS k", "concat('Rev of ', cast(o_orderdate as string), ' and 3.4.2019, June 2020; year 2021') AS s"], lambda: {"dates": F.array_join(text.extract_dates(C("s")), ";")},
     {"dates": "regexp_extract(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') || ';3.4.2019;June 2020;2020;2021'"}, "orders")
_add("b23_extract_seal_orders", [KEY, "concat('Orifice with seal ', cast(l_linenumber as string), ' x ', lpad(cast(10000 + l_suppkey % 90000 as string), 5, '0'), ', 54321 x 3') AS s"],
     lambda: {"orders": F.array_join(F.transform(text.extract_seal_orders(C("s")), lambda o: F.concat_ws("*", o["order_no"], o["multiplier"].cast("string"))), ";")},
     {"orders": "regexp_extract(s, 'x ([0-9]{5})', 1) || '*' || regexp_extract(s, 'seal ([0-9]+) x', 1) || ';54321*3'"})
_add("b13_shop_class", ["p_partkey AS k", "case p_size % 8 when 0 then '03 CS shop' when 1 then '04 Erection' when 2 then ' 05 Paint Shop' when 3 then '06 Paint erection' when 4 then 'painted in the shop area' when 5 then '07 Blind disks' when 6 then null else 'Erection' end AS s"], lambda: {"class": bom.shop_class(C("s"))},
     {"class": "CASE WHEN lower(s) LIKE '%paint shop%' THEN 'paint' WHEN lower(trim(s)) = 'erection' OR (lower(s) LIKE '%erection%' AND lower(s) NOT LIKE '%paint%') THEN 'erection' WHEN lower(s) LIKE '%paint%' AND lower(s) LIKE '%shop%' THEN 'paint' WHEN lower(trim(s)) LIKE '%shop' THEN 'shop' ELSE 'other' END"}, "part")
_add("b22_year_label", ["o_orderkey AS k", "case when o_orderkey % 5 = 0 then 'none' else concat('Rev ', cast(o_orderdate as string), '; 12.3.', cast(1990 + o_custkey % 40 as string), ', 2019') end AS s"], lambda: {"label": text.year_label(C("s"))},
     {"label": "CASE WHEN s = 'none' THEN 'no year' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(s, '\\b((?:19|20)[0-9]{2})\\b', 1))), '_') END"}, "orders")
_add("b23_rewrite_note", [KEY, "concat(case l_linenumber % 4 when 0 then '' when 1 then 'Elbow 90  ' else 'Tee ' end, case l_linenumber % 3 when 0 then 'Seal ring FKM blue order no. 12345 x 2' when 1 then 'SEAL RING FMK BLUE ORDER NO. 54321' else 'plain' end) AS s"], lambda: {"note": text.rewrite_note(C("s"))},
     {"note": f"CASE WHEN strpos(lower(s), 'seal ring f') = 0 THEN s ELSE trim(rtrim(substr(s, 1, strpos(lower(s), 'seal ring f') - 1)) || ' {text.SEAL_NOTE}') END"})
_SUBJECT = "concat(case o_orderkey % 3 when 0 then 'FW: [EXT] ' when 1 then 'RE: ' else '' end, 'Plant A, AB/CD/', lpad(cast(o_orderkey % 100000 as string), 5, '0'), ': Plant A, AB/CD/00071: Re: Fw: Valve list ', cast(o_custkey as string))"
_add("b24_clean_subject", ["o_orderkey AS k", f"{_SUBJECT} AS s"], lambda: {"subject": text.clean_subject(C("s"))}, {"subject": "'valve list ' || regexp_extract(s, 'Valve list ([0-9]+)', 1)"}, "orders")
_add("b25_label_fields", [KEY, f"concat('BoM Item No: ', {_S}, ' box 10 x 20 x 30 ', cast(l_suppkey as string)) AS s"], lambda: {n: text.label_fields(C("s"))[n] for n in ("bom_item", "size_number")},
     {"bom_item": "regexp_extract(s, 'No: ([0-9]+)', 1)", "size_number": "regexp_extract(s, '30 ([0-9]+)', 1)"})
_DATE = "concat(lpad(cast(1 + o_orderkey % 28 as string), 2, '0'), case when o_orderkey % 2 = 0 then '/' else '.' end, lpad(cast(1 + o_custkey % 12 as string), 2, '0'), case when o_orderkey % 2 = 0 then '/2024' else '.24' end, case when o_orderkey % 3 = 0 then ' A*' else '' end) AS s"
_add("b26_parse_date_swiss", ["o_orderkey AS k", _DATE], lambda: {"d": dates.parse_date_swiss(C("s"))}, {"d": "make_date(2024, CAST(substr(s, 4, 2) AS BIGINT), CAST(substr(s, 1, 2) AS BIGINT))"}, "orders")
_add("b27_weekdays", ["o_orderkey AS k", "cast(o_orderdate as date) AS d", "cast(o_custkey % 9 - 4 as int) AS w", "cast(o_orderkey % 100 as int) AS n"],
     lambda: {"weekday": dates.ensure_weekday(C("d")), "moved": dates.add_weeks_workday(C("d"), C("w")), "weeks": dates.weeks_between(C("d"), F.date_add(C("d"), C("n")))},
     {"weekday": "d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END", "moved": "d + w * 7 + CASE WHEN w < 0 THEN CASE isodow(d) WHEN 6 THEN -1 WHEN 7 THEN -2 ELSE 0 END ELSE CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END END",
      "weeks": "round(n / 7.0::DOUBLE, 1)"}, "orders")
_add("b28_rounding", [KEY, "cast(l_quantity as double) * l_linenumber * 4 AS q"], lambda: {"six": text.ceil_multiple(C("q"), 6).cast("double"), "nut": text.nut_washer_round(C("q")).cast("double"), "cans": text.paint_cans(C("q"))},
     {"six": "ceil(q / 6) * 6", "nut": "CASE WHEN q <= 100 THEN ceil(q / 10) * 10 WHEN q <= 500 THEN ceil(q / 50) * 50 ELSE ceil(q / 100) * 100 END",
      "cans": "CASE WHEN q <= 0 THEN 0 ELSE ceil(q / 5 / 20) + CASE WHEN q / 5 - 20 * (ceil(q / 5 / 20) - 1) >= 15 AND q / 5 - 20 * (ceil(q / 5 / 20) - 1) < 20 THEN 1 ELSE 0 END END::BIGINT"})
_add("b29_tape_and_rods", [KEY, "concat('GSK ', cast(10 + l_linenumber as string), ' x ', cast(l_linenumber as string), '.5 rod M10/', cast(1000 * l_linenumber as string)) AS s"], lambda: {"kg": F.round(text.tape_weight_per_m(C("s")), 9), "mm": text.rod_length(C("s"))},
     {"kg": "round(CAST(regexp_extract(s, 'GSK ([0-9]+)', 1) AS DOUBLE) / 1000 * (CAST(regexp_extract(s, ' x ([0-9.]+)', 1) AS DOUBLE) / 1000) * 2600, 9)", "mm": "CAST(regexp_extract(s, '/([0-9]+)', 1) AS BIGINT)"})
_add("b31_forces_by_axis", [KEY, "cast(l_quantity as double) AS qx", "-cast(l_extendedprice as double) AS qy", "cast(l_suppkey as double) AS qz", "case l_linenumber % 3 when 0 then ' x' when 1 then 'Y' else 'Z' end AS ax"],
     lambda: {n: text.forces_by_axis(C("qx"), C("qy"), C("qz"), C("ax"))[n] for n in ("axial", "lateral", "vertical")},
     {"axial": "CASE upper(trim(ax)) WHEN 'X' THEN abs(qx) WHEN 'Y' THEN abs(qy) ELSE abs(qz) END", "lateral": "CASE upper(trim(ax)) WHEN 'X' THEN abs(qy) WHEN 'Y' THEN abs(qx) ELSE greatest(abs(qx), abs(qy)) END", "vertical": "CASE upper(trim(ax)) WHEN 'Z' THEN 0 ELSE abs(qz) END::DOUBLE"})
_add("b32_viewpoint_rows", [KEY, "cast(l_partkey as double) AS x", "cast(l_suppkey as double) AS y", "cast(l_linenumber as double) AS z", f"concat('1HTX', {_S}) AS code"],
     lambda: {"camera_x": text.viewpoint(C("x"), C("y"), C("z"), C("code"))["camera_x"], "box_max_z": text.viewpoint(C("x"), C("y"), C("z"), C("code"))["box_max_z"], "folder": text.viewpoint(C("x"), C("y"), C("z"), C("code"))["folder"], "uid_size": F.length(text.uuid5(C("code")))},
     {"camera_x": "x / 1000 + 2.0::DOUBLE", "box_max_z": "z / 1000 + 1.0::DOUBLE", "folder": "substr(code, 1, 7)", "uid_size": "36"})


def b18_extract_split_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes that run over two lines: the first part on a line and the second on the next."""
    line = "case when o_orderkey % 2 = 1 then concat('1 HTX', lpad(cast(o_orderkey % 89 as string), 2, '0')) else concat('BR', lpad(cast(o_custkey % 1000 as string), 3, '0')) end AS line"
    lines = derived(spark, folder, "orders", ["cast(floor(o_orderkey / 6) as bigint) AS file", "o_orderkey % 6 AS line_no", line])
    from ..operators.split_codes import extract_split_codes

    return extract_split_codes(lines)


QUERIES["b18_extract_split_codes"] = b18_extract_split_codes
SQL["b18_extract_split_codes"] = """
WITH l AS (SELECT CAST(floor(o_orderkey / 6) AS BIGINT) AS file, o_orderkey % 6 AS line_no, o_orderkey AS o, lead(o_custkey) OVER (PARTITION BY floor(o_orderkey / 6) ORDER BY o_orderkey) AS c FROM orders)
SELECT DISTINCT file, line_no, '1HTX' || lpad(CAST(o % 89 AS VARCHAR), 2, '0') || 'BR' || lpad(CAST(c % 1000 AS VARCHAR), 3, '0') AS code FROM l WHERE o % 2 = 1 AND c IS NOT NULL
"""


def b30_sum_extra_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived(spark, folder, "lineitem", ["l_orderkey AS item", "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + cast(floor(l_extendedprice * 100) as bigint) % 10000 AS row_pos", "case l_linenumber % 3 when 0 then concat(cast(l_linenumber as string), ' off extra-long') when 1 then l_linestatus end AS remarks"])
    return bom.sum_extra_long(rows, ["item"])


QUERIES["b30_sum_extra_long"] = b30_sum_extra_long
SQL["b30_sum_extra_long"] = """
WITH r AS (SELECT l_orderkey AS item, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + cast(floor(l_extendedprice * 100) as bigint) % 10000 AS p, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END AS n, CASE WHEN l_linenumber % 3 = 1 THEN l_linestatus END AS other FROM lineitem),
o AS (SELECT item, string_agg(other, '; ' ORDER BY p) AS others FROM (SELECT item, other, min(p) AS p FROM r WHERE other IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT r.item, concat_ws('; ', CASE WHEN sum(n) IS NOT NULL THEN CAST(sum(n) AS VARCHAR) || ' off extra-long' END, max(o.others)) AS remarks FROM r LEFT JOIN o USING (item) GROUP BY 1
"""
__all__ = ["QUERIES", "SQL", "derived_sql", "table"]
