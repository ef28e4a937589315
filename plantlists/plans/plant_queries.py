"""Queries of welds, schedules, calendars, batches and streams; points, dates and listings are made from keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching, propagation, schedule, welds
from ..streaming import jobs
from .list_queries import ROW
from ..staging import shared_folder
from .shared import Query, derived, derived_sql, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):  # noqa: ANN202
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


# a listing with a branch of up to four components for each supplier, most of it in one file; some ends and components have no position
_LINES = (
    "concat('NEW PIPE /', code, 'BR100')", "concat('NEW BRANCH /', code, 'BR100/B1')", "case when k % 11 = 0 then 'DESC none' else concat('  HPOS X ', x, 'mm Y 0mm Z 0mm') end", "concat('TPOS X ', x, 'mm Y 900mm Z 0mm')",
    "concat('HCON ', hcon)", "case when k % 4 = 1 then 'TCON BWD' else 'TCON OPEN' end", "'NEW ELBO'", "concat('SPRE /E', kind)", "concat('POS X ', x, 'mm Y 100mm Z 0mm')",
    "'NEW TEE'", "'SPRE SPCOMPONENT /T1'", "case when k % 9 = 0 then 'DESC nowhere' else concat('POS X ', x, 'mm Y ', y, 'mm Z 0mm') end", "'NEW CYLINDER'", "'POS X 0mm Y 0mm Z 0mm'",
    "case when k % 5 = 0 then 'NEW FLAN' else 'NEW ATTACHMENT' end", "case when k % 5 = 0 then 'SPRE /F1' else 'SPRE /none' end", "concat('POS X ', x, 'mm Y ', case when k % 10 = 0 then '100' else '890' end, 'mm Z 0mm')", "'END'",
)
_PLANT = ["case when s_suppkey % 16 = 0 then 'f1' else 'f0' end AS file", "s_suppkey AS k", "concat('1HTX', lpad(cast(s_suppkey as string), 7, '0')) AS code", "cast(s_suppkey * 1000 as string) AS x", "cast(100 + s_suppkey % 8 * 100 as string) AS y", "case when s_suppkey % 3 = 0 then 'BWD' else 'OPEN' end AS hcon", "cast(s_suppkey % 2 as string) AS kind"]
_SPEC = [(0, "/E0", "BWD", "BWD", "ELBO", "100mm", None, "3"), (1, "/T1", "BWD", None, "TEE", "100mm", None, None), (2, "/E1", "x", "x", "ELBO", "50mm", None, "5"), (3, "/E1", "BWD", "FLG", "ELBO", "50mm", None, "5"), (4, "/F1", "BWD", None, "FLAN", None, "80mm", None)]


def listing(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "supplier", _PLANT).selectExpr("file", "k", f"posexplode(array({', '.join(_LINES)})) AS (line_no, line)")
    return rows.select("file", (F.col("k") * 100 + F.col("line_no")).alias("line_no"), "line")


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    branches, components = welds.parse_listing(listing(spark, d))
    spec = spark.createDataFrame(_SPEC, "row_pos long, spre string, p1_conn string, p2_conn string, type string, pbor string, pbor1 string, form string")
    return branches, welds.lookup_specs(components, spec)


def _attribute(name: str) -> str:
    return f"max(trim(regexp_extract(line, '^\\s*{name}\\s+(.*)$', 1))) FILTER (ltrim(line) LIKE '{name} %')"


def _at(pos: str, axis: str) -> str:
    return f"CAST(nullif(regexp_extract({pos}, '{axis} (-?[0-9.]+)mm', 1), '') AS DOUBLE)"


def _far(a: str, b: str) -> str:
    return f"sqrt({' + '.join(f'({a}{x} - {b}{x}) * ({a}{x} - {b}{x})' for x in 'xyz')})"


_SPECS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _SPEC)
#: The same lines read by SQL: the state carried down a file, then branches (b), components (c), those with specifications (s), components at ends (e) and neighbours (n).
_PARSED = rf"""WITH l AS (SELECT file, k * 100 + unnest(range({len(_LINES)})) AS line_no, unnest([{', '.join(_LINES)}]) AS line FROM ({derived_sql('supplier', _PLANT)})),
o AS (SELECT *, nullif(regexp_extract(line, 'NEW PIPE /?(\S+)', 1), '') AS new_pipe, nullif(regexp_extract(line, 'NEW BRANCH /?(\S+)', 1), '') AS new_branch, nullif(regexp_extract(line, '^\s*NEW (\w+)', 1), '') AS opened FROM l),
w AS (SELECT *, last_value(new_pipe IGNORE NULLS) OVER d AS pipe, last_value(CASE WHEN new_pipe IS NOT NULL THEN '-' ELSE new_branch END IGNORE NULLS) OVER d AS branch,
  last_value(CASE WHEN opened IS NOT NULL THEN line_no END IGNORE NULLS) OVER d AS element, last_value(opened IGNORE NULLS) OVER d AS part FROM o WINDOW d AS (PARTITION BY file ORDER BY line_no)),
h AS (SELECT file, branch, max(pipe) AS pipe, {_attribute('HPOS')} AS hpos, {_attribute('TPOS')} AS tpos, {_attribute('HCON')} AS hcon, {_attribute('TCON')} AS tcon FROM w WHERE branch <> '-' AND part IN ('PIPE', 'BRANCH') GROUP BY 1, 2),
p AS (SELECT file, branch, element, part AS type, regexp_replace({_attribute('SPRE')}, '^SPCOMPONENT\s+', '') AS spre, {_attribute('POS')} AS pos FROM w
  WHERE branch <> '-' AND part NOT IN ('PIPE', 'BRANCH', 'ZONE', 'SITE', 'STRUCTURE', 'SUBSTRUCTURE', 'CYLINDER', 'CTORUS') GROUP BY 1, 2, 3, 4),
c AS (SELECT file, branch, row_number() OVER (PARTITION BY file, branch ORDER BY element) AS seq, type, spre, {', '.join(f"{_at('pos', a.upper())} AS {a}" for a in 'xyz')} FROM p),
ends AS (SELECT file, branch, {', '.join(f'arg_min({a}, seq) AS f{a}, arg_max({a}, seq) AS l{a}' for a in 'xyz')} FROM c WHERE x IS NOT NULL AND type <> 'ATTACHMENT' GROUP BY 1, 2),
b AS (SELECT *, {_far('h', 'f')} AS head_length, {_far('t', 'l')} AS tail_length FROM (SELECT h.*, {', '.join(f"{_at(f'{e}pos', a.upper())} AS {e}{a}" for e in 'ht' for a in 'xyz')} FROM h) LEFT JOIN ends USING (file, branch)),
spec AS (SELECT * FROM (VALUES {_SPECS}) v(row_pos, spre, p1, p2, kind, pbor, pbor1, form) QUALIFY row_number() OVER (PARTITION BY spre ORDER BY row_pos DESC) = 1),
s AS (SELECT c.*, kind IS NOT NULL AS found, CASE WHEN kind IS NULL THEN 0 ELSE coalesce(p1 = 'BWD', false)::INT + coalesce(p2 = 'BWD', false)::INT + (kind = 'OLET')::INT END AS welds,
  CASE kind WHEN 'ELBO' THEN CAST(form AS DOUBLE) * bore WHEN 'TEE' THEN 0.90::DOUBLE * bore WHEN 'FLAN' THEN CASE WHEN bore > 0 THEN 0.4::DOUBLE * bore END END AS length
  FROM c LEFT JOIN (SELECT *, CAST(coalesce(replace(pbor, 'mm', ''), '0') AS DOUBLE) AS bore FROM spec) USING (spre)),
sides AS (SELECT file, branch, 'HEAD' AS side, hcon AS con, hx AS ex, hy AS ey, hz AS ez FROM b UNION ALL SELECT file, branch, 'TAIL', tcon, tx, ty, tz FROM b),
e AS (SELECT *, round(far, 3) AS distance FROM (SELECT s.*, side, con, {_far('', 'e')} AS far FROM s JOIN sides USING (file, branch)) WHERE far <= coalesce(length, 0) / 2 + 10),
n AS (SELECT *, round(far, 3) AS distance, round(wide, 3) AS expected, CASE WHEN far <= wide * CAST(1.1 AS DOUBLE) THEN 'Touching' WHEN far <= wide * 1.5 THEN 'Near' ELSE 'Separated' END AS relation FROM (
  SELECT file, branch, seq, type, t2, {_far('', 'n')} AS far, CASE WHEN type = 'ELBO' AND t2 <> 'ELBO' THEN length WHEN t2 = 'ELBO' AND type <> 'ELBO' THEN l2 ELSE length + l2 END AS wide FROM (
    SELECT file, branch, seq, type, length, x, y, z, lead(type) OVER q AS t2, lead(length) OVER q AS l2, {', '.join(f'lead({a}) OVER q AS n{a}' for a in 'xyz')} FROM s WHERE welds > 0 AND x IS NOT NULL WINDOW q AS (PARTITION BY file, branch ORDER BY seq))
  WHERE length IS NOT NULL AND l2 IS NOT NULL AND (type || '-' || t2) IN ('ELBO-TEE', 'TEE-ELBO', 'TEE-FLAN', 'FLAN-TEE', 'ELBO-FLAN', 'FLAN-ELBO', 'TEE-TEE', 'ELBO-ELBO')))"""


@_query("f4_parse_listing_branches", f"{_PARSED} SELECT file, branch, pipe, hx, tx, ty, hcon, head_length, tail_length FROM b")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)[0].select("file", "branch", "pipe", "hx", "tx", "ty", "hcon", "head_length", "tail_length")


@_query("f4_parse_listing_components", f"{_PARSED} SELECT file, branch, seq::INT AS seq, type, spre, x, y FROM c")
def f4_components(spark: SparkSession, d: str) -> DataFrame:
    return welds.parse_listing(listing(spark, d))[1].select("file", "branch", "seq", "type", "spre", "x", "y")


@_query("d12_lookup_specs", f"{_PARSED} SELECT file, branch, seq::INT AS seq, found, welds, length FROM s")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)[1].select("file", "branch", "seq", "found", "welds", "length")


@_query("f6_adjacent_components", f"{_PARSED} SELECT file, branch, seq::INT AS seq, distance, expected, relation FROM n")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return welds.adjacent_components(parts(spark, d)[1]).select("file", "branch", "seq", "distance", "expected", "relation")


def _ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    branches, components = parts(spark, d)
    return branches, components, welds.components_at_ends(components, branches)


@_query("d20_components_at_ends", f"{_PARSED} SELECT file, branch, side, seq::INT AS seq, type, distance FROM e")
def d20(spark: SparkSession, d: str) -> DataFrame:
    return _ends(spark, d)[2].select("file", "branch", "side", "seq", "type", "distance")


@_query("d20_end_statistics", f"""{_PARSED}, q AS (SELECT file, count_if(hcon = 'BWD') AS bwd_heads, count_if(tcon = 'BWD') AS bwd_tails FROM b GROUP BY 1),
r AS (SELECT file, count_if(side = 'HEAD') AS at_heads, count_if(side = 'TAIL') AS at_tails, count_if(side = 'HEAD' AND con = 'BWD') AS at_bwd_heads, count_if(side = 'TAIL' AND con = 'BWD') AS at_bwd_tails, count(*) AS at_ends FROM e GROUP BY 1)
SELECT q.*, bwd_heads + bwd_tails AS bwd_ends, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('at_heads', 'at_tails', 'at_bwd_heads', 'at_bwd_tails', 'at_ends'))} FROM q LEFT JOIN r USING (file)""")
def d20_statistics(spark: SparkSession, d: str) -> DataFrame:
    branches, _, ends = _ends(spark, d)
    return welds.end_statistics(branches, ends)


@_query("d21_bwd_report", f"{_PARSED} SELECT x.file, x.branch, x.side, coalesce(arg_min(e.type, (e.distance, e.seq)), 'No') AS component, min(e.distance) AS distance FROM sides x LEFT JOIN e ON e.file = x.file AND e.branch = x.branch AND e.side = x.side WHERE x.con = 'BWD' GROUP BY 1, 2, 3")
def d21(spark: SparkSession, d: str) -> DataFrame:
    branches, _, ends = _ends(spark, d)
    return welds.bwd_report(branches, ends)


@_query("e27_weld_total", f"""{_PARSED}, t AS (SELECT (SELECT sum(welds) FROM s)::BIGINT AS component_welds, (SELECT count(*) FROM sides WHERE con = 'BWD') AS bwd_ends,
(SELECT count(*) FROM n WHERE relation = 'Touching' AND NOT (type = 'FLAN' AND t2 = 'FLAN')) AS touching, (SELECT count(*) FROM (SELECT DISTINCT file, branch, side FROM e WHERE con = 'BWD')) AS at_ends) SELECT *, component_welds + bwd_ends - touching - at_ends AS total FROM t""")
def e27(spark: SparkSession, d: str) -> DataFrame:
    branches, components, ends = _ends(spark, d)
    return welds.weld_total(components, branches, welds.adjacent_components(components), ends)


_POINTS = [ROW.replace("row_pos", "line_no"), "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) AS branch", "cast(l_partkey * 3 % 500 as double) AS hx", "cast(l_suppkey * 7 % 300 as double) AS hy", "cast(l_orderkey as double) AS hz",
           "cast(l_partkey * 5 % 500 as double) AS tx", "cast(l_suppkey * 11 % 300 as double) AS ty", "cast(l_orderkey + l_partkey % 200 as double) AS tz", "case when l_linenumber % 2 = 0 then 'BWD' else 'OPEN' end AS hcon", "case when l_linenumber % 3 = 0 then 'BWD' else 'OPEN' end AS tcon"]


@_query("d19_connect_branches", f"""WITH b AS ({derived_sql('lineitem', _POINTS)}), t AS (SELECT *, floor(tz / 150) + unnest([-1, 0, 1]) AS cell FROM b), j AS (SELECT a.branch AS a, c.branch AS b, a.line_no AS pa, c.line_no AS pb, abs(a.tx - c.hx) AS dx, abs(a.ty - c.hy) AS dy, abs(a.tz - c.hz) AS dz FROM t a JOIN b c ON a.cell = floor(c.hz / 150) AND a.branch <> c.branch AND abs(a.tx - c.hx) <= 150 AND abs(a.ty - c.hy) <= 150 AND abs(a.tz - c.hz) <= 150 AND (a.tcon = 'BWD' OR c.hcon = 'BWD')),
m AS (SELECT *, CASE WHEN dx <= 5 AND dy <= 5 THEN 'XY_tight_Z_loose' WHEN dx <= 5 AND dz <= 5 THEN 'XZ_tight_Y_loose' WHEN dy <= 5 AND dz <= 5 THEN 'YZ_tight_X_loose' END AS match_type FROM j),
f AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY pa, pb) AS k FROM m WHERE match_type IS NOT NULL)
SELECT a, b, match_type, round(sqrt(dx * dx + dy * dy + dz * dz), 3) AS distance, CASE match_type WHEN 'XY_tight_Z_loose' THEN greatest(dx, dy) WHEN 'XZ_tight_Y_loose' THEN greatest(dx, dz) ELSE greatest(dy, dz) END AS tight_offset FROM f WHERE k = 1""")
def d19(spark: SparkSession, d: str) -> DataFrame:
    return welds.connect_branches(derived(spark, d, "lineitem", _POINTS)).select("a", "b", "match_type", "distance", "tight_offset")


# schedules
_NAMES = ["cast(c_nationkey % 5 as bigint) AS project_id", "c_custkey AS row_pos", "concat('Lot ', cast(c_custkey % 50 as string), ' ', c_mktsegment, case when c_custkey % 4 = 0 then ' piping' else ' pipes' end) AS name"]
_TARGETS = ["cast(c_nationkey % 5 as bigint) AS project_id", "concat('lot ', cast(c_custkey % 25 as string), ' ', lower(c_mktsegment), ' piping') AS target"]


@_query("d23_fuzzy_best_match")
def d23(spark: SparkSession, d: str) -> DataFrame:
    return schedule.fuzzy_best_match(derived(spark, d, "customer", _TARGETS).distinct(), derived(spark, d, "customer", _NAMES), 90)


_SUFFIXED = ["cast(c_nationkey % 5 as bigint) AS project_id", "c_custkey AS row_pos", "concat('Lot ', cast(c_custkey % 40 as string), ' ', c_mktsegment, ' - DTS', case c_custkey % 3 when 0 then ' (S)' when 1 then ' (T)' else '' end) AS name"]


@_query("d23_repaired_match")
def d23_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Names of (S) and (T) deliveries, some of which exist in one kind only."""
    rows = derived(spark, d, "customer", _SUFFIXED)
    targets = rows.where("row_pos % 4 = 0").selectExpr("project_id", "regexp_replace(name, '[(][ST][)]', case when row_pos % 2 = 0 then '(S)' else '(T)' end) AS target").distinct()
    return schedule.fuzzy_best_match(targets, rows, 90, repair=True)


_HOLIDAYS = [(1, "middle of July", "end of August", 2), (2, "middle of December", "end of December", 1), (3, "May", "middle of May", 1)]


@_query("d22_holiday_hit", """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), h AS (SELECT y * 10000 + 1 AS pos, make_date(y, 7, 15) AS b, make_date(y, 8, 31) AS u, 2 AS w, 'middle of July to end of August holiday period' AS label FROM y UNION ALL SELECT y * 10000 + 2, make_date(y, 12, 15), make_date(y, 12, 31), 1, 'middle of December to end of December holiday period' FROM y UNION ALL SELECT y * 10000 + 3, make_date(y, 5, 1), make_date(y, 5, 15), 1, 'May to middle of May holiday period' FROM y),
t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 AS INTEGER) AS finish FROM orders) SELECT id, start, finish, coalesce(arg_min(w, pos), 0) AS adder_weeks, arg_min(label, pos) AS label FROM t LEFT JOIN h ON start <= u + 7 AND finish >= b GROUP BY 1, 2, 3""")
def d22(spark: SparkSession, d: str) -> DataFrame:
    tasks = derived(spark, d, "orders", ["o_orderkey AS id", "cast(o_orderdate as date) AS start", "date_add(cast(o_orderdate as date), cast(o_custkey % 40 as int)) AS finish"])
    years = tasks.select(F.year("start").alias("year"))
    return schedule.holiday_hit(tasks, schedule.holiday_periods(spark.createDataFrame(_HOLIDAYS, "row_pos long, from_text string, to_text string, adder_weeks int"), years))


_EDGES = ["cast(floor(o_orderkey / 10) as bigint) AS project_id", "o_orderkey % 10 AS row_pos", "concat('A', cast(o_orderkey % 10 as string)) AS from_activity", "concat('A', cast(o_orderkey % 10 + 1 as string)) AS to_activity", "cast(1 + o_custkey % 9 as bigint) AS weeks", "cast(null as string) AS comments"]


def _sql_day(words: str, year: str) -> str:
    names = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    month = next(k for k, m in enumerate(names, 1) if m in words.lower())
    return f"make_date({year}, {month}, {15 if 'middle' in words else {2: 28, 4: 30, 6: 30, 9: 30, 11: 30}.get(month, 31) if 'end' in words else 1})"


def _sql_shifted(start: str, weeks: str, sign: str, year: str) -> str:
    """The date as SQL: the weekday, moved by the first period that overlaps."""
    weekday = lambda d: f"({d} + CASE isodow({d}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)"
    plain = weekday(f"CAST({start} + CAST({sign} * {weeks} * 7 AS INTEGER) AS DATE)")
    adder = "CASE " + " ".join(f"WHEN least({start}, {plain}) <= {_sql_day(h[2], f'({year} + {more})')} + 7 AND greatest({start}, {plain}) >= {_sql_day(h[1], f'({year} + {more})')} THEN {h[3]}" for more in (-1, 0, 1) for h in _HOLIDAYS) + " ELSE 0 END"
    return weekday(f"CAST({start} + CAST({sign} * ({weeks} + {adder}) * 7 AS INTEGER) AS DATE)")


#: Dates along the chain of each project by recursion (each activity can be reached by one path only), with the pass and the way that gave them.
_DATED = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY row_pos) AS n FROM ({derived_sql('orders', _EDGES)})),
w AS (SELECT project_id, 2 * n AS way, to_activity AS source, from_activity AS target, weeks, -1 AS sign FROM e UNION ALL SELECT project_id, 2 * n + 1, from_activity, to_activity, weeks, 1 FROM e),
a AS (SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS project_id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 10 = 0),
t AS (SELECT project_id, 'A5' AS activity, 1 AS pass, -1::BIGINT AS way, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date, year(d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS y, 0 AS went FROM a
  UNION ALL SELECT t.project_id, target, pass + CASE WHEN w.way > t.way THEN 0 ELSE 1 END, w.way, {_sql_shifted('date', 'weeks', 'sign', 'y')}, y, sign FROM t JOIN w ON w.project_id = t.project_id AND w.source = t.activity AND (went = 0 OR went = sign)),
f AS (SELECT w.*, t.date AS start, x.date AS date, {_sql_shifted('t.date', 'w.weeks', 'w.sign', 't.y')} AS other_date, CASE WHEN (t.pass, t.way) > (x.pass, x.way) THEN (t.pass, t.way) ELSE (x.pass, x.way) END AS latest
  FROM w JOIN t ON t.project_id = w.project_id AND t.activity = w.source JOIN t x ON x.project_id = w.project_id AND x.activity = w.target),
q AS (SELECT project_id, least(max(CASE WHEN way < 0 THEN 0 ELSE pass END) + 1, 100) AS passes FROM t GROUP BY 1),
c AS (SELECT f.project_id, target AS activity, date, other_date, source AS reference, CAST(passes - latest[1] + CASE WHEN way > latest[2] THEN 1 ELSE 0 END AS BIGINT) AS times FROM f JOIN q USING (project_id) WHERE date <> other_date)"""


def _propagation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = derived(spark, d, "orders", _EDGES)
    anchors = derived(spark, d, "orders", ["cast(floor(o_orderkey / 10) as bigint) AS project_id", "'A5' AS activity", "cast(o_orderdate as date) AS date"], "o_orderkey % 10 = 0")
    known = edges.selectExpr("project_id", "from_activity AS activity").union(edges.selectExpr("project_id", "to_activity"))
    return schedule.propagation(edges, anchors, known, [h[1:] for h in _HOLIDAYS])


@_query("p3_propagate_dates", f"{_DATED} SELECT t.project_id, t.activity, t.date, coalesce(sum(times) FILTER (times > 0), 0)::BIGINT AS conflicts, CASE went WHEN 0 THEN 'anchor' WHEN 1 THEN 'after' ELSE 'before' END AS direction FROM t LEFT JOIN c ON c.project_id = t.project_id AND c.activity = t.activity GROUP BY 1, 2, 3, went")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return _propagation(spark, d)[0].select("project_id", "activity", "date", "conflicts", "direction")


@_query("p3_date_conflicts", f"{_DATED} SELECT * FROM c WHERE times > 0")
def p3_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _propagation(spark, d)[1].select("project_id", "activity", "date", "other_date", "reference", "times")


_MILESTONES = ["o_custkey % 500 AS project_id", "concat('M', cast(o_orderkey % 8 as string)) AS activity", "case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) end AS date"]


@_query("p3_later_anchor", f"""WITH o AS (SELECT project_id, activity, min(date) AS date FROM ({derived_sql('orders', _MILESTONES)}) WHERE date IS NOT NULL GROUP BY 1, 2),
a AS (SELECT project_id, arg_min(activity, activity) AS activity, arg_min(date, activity) AS date FROM o WHERE activity IN ('M1', 'M2') GROUP BY 1), b AS (SELECT project_id, arg_min(date, activity) AS date FROM o WHERE activity IN ('M3', 'M4') GROUP BY 1)
SELECT coalesce(a.project_id, b.project_id) AS project_id, CASE WHEN b.date IS NULL OR a.date >= b.date THEN a.date ELSE b.date END AS date FROM a FULL JOIN b USING (project_id)""")
def p3_anchor(spark: SparkSession, d: str) -> DataFrame:
    return propagation.later_anchor(derived(spark, d, "orders", _MILESTONES), ["M1", "M2"], ["M3", "M4"]).select("project_id", "date")


_PLAN = ["cast(floor(o_orderkey / 10) as bigint) AS project_id", "concat('A', cast(o_orderkey % 10 as string)) AS activity", "cast(o_orderdate as date) AS date"]


@_query("p4_current_lengths", """WITH p AS (SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS project_id, o_orderkey % 10 AS k, CAST(o_orderdate AS DATE) AS d FROM orders), j AS (SELECT a.project_id, a.k, round((b.d - a.d) / 7.0::DOUBLE, 1) AS w FROM p a JOIN p b ON a.project_id = b.project_id AND b.k = a.k + 1)
SELECT p.project_id, 'A' || p.k AS activity, coalesce(x.w || 'W before A' || (p.k + 1), '') AS before, coalesce(y.w || 'W after A' || (p.k - 1), '') AS after FROM p LEFT JOIN j x ON x.project_id = p.project_id AND x.k = p.k LEFT JOIN j y ON y.project_id = p.project_id AND y.k = p.k - 1 WHERE x.w IS NOT NULL OR y.w IS NOT NULL""")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return schedule.current_lengths(derived(spark, d, "orders", _PLAN), derived(spark, d, "orders", _EDGES))


@_query("p5_merge_matches", """SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS project_id, o_orderkey AS row_pos, CASE WHEN o_orderkey % 10 < 4 THEN 'A' || (o_orderkey % 10) END AS target, CASE WHEN o_orderkey % 10 < 4 THEN 'X' END AS piping, CASE WHEN o_orderkey % 10 < 4 THEN CAST(o_orderdate AS DATE) END AS date FROM orders""")
def p5(spark: SparkSession, d: str) -> DataFrame:
    plan = derived(spark, d, "orders", [*_PLAN, "o_orderkey AS row_pos"])
    matches = plan.where("row_pos % 10 < 4").selectExpr("project_id", "row_pos", "activity AS target", "100D AS ratio")
    marks = plan.selectExpr("activity AS target", "'X' AS piping").distinct()
    dates = plan.selectExpr("project_id", "activity", "date", "'r' AS reason")
    return schedule.merge_matches(plan.drop("date"), matches, marks, dates).select("project_id", "row_pos", "target", "piping", "date")


_CALENDAR = ["concat('u', cast(s_suppkey % 6 as string)) AS attendee", "s_suppkey % 6 < 4 AS required", "date_add(date '2024-01-01', cast(floor(s_suppkey / 6) as int)) AS day", "concat(repeat('2', cast(17 + s_suppkey % 3 as int)), repeat('0', cast(4 + s_suppkey % 5 as int)), '2', repeat('1', 20)) AS bitmap"]


@_query("p6_common_slots", """WITH c AS (SELECT 'u' || (s_suppkey % 6) AS attendee, s_suppkey % 6 < 4 AS required, DATE '2024-01-01' + CAST(floor(s_suppkey / 6) AS INTEGER) AS day, rpad(repeat('2', CAST(17 + s_suppkey % 3 AS INTEGER)) || repeat('0', CAST(4 + s_suppkey % 5 AS INTEGER)) || '2' || repeat('1', 20), 48, '2') AS bits FROM supplier),
s AS (SELECT *, unnest(range(16, 31)) AS slot FROM c WHERE isodow(day) < 6), f AS (SELECT *, regexp_full_match(substr(bits, slot + 1, 2), '[01][01]') AS free FROM s WHERE slot + 2 <= 24 OR slot >= 28)
SELECT day, CAST(slot AS INTEGER) AS slot, coalesce(bool_and(free) FILTER (NOT required), true) AS optional_free FROM f GROUP BY 1, 2 HAVING count(DISTINCT attendee) FILTER (required AND free) = 4""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return schedule.common_slots(derived(spark, d, "supplier", _CALENDAR))


# batches
_SCOPE = ["cast(floor(s_suppkey / 200) as bigint) AS project_id", "s_name AS code", "concat('U', chr(cast(65 + s_suppkey % 4 as int)), 'A-', cast(s_suppkey % 40 as string)) AS working_area", "concat('U', chr(cast(65 + s_suppkey % 4 as int)), 'A') AS section", "case when s_suppkey % 11 = 0 then null else abs(s_acctbal) end AS weight"]


@_query("p1_split_batches")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return batching.split_batches(derived(spark, d, "supplier", _SCOPE), 4)


@_query("e24_batch_summary", f"WITH s AS (SELECT *, 1 + CAST(floor(length(code) + weight) AS BIGINT) % 4 AS batch FROM ({derived_sql('supplier', _SCOPE)}) WHERE weight IS NOT NULL) SELECT project_id, batch, round(sum(weight), 1) AS weight, count(DISTINCT working_area) AS areas, count(DISTINCT section) AS sections, count(DISTINCT code) AS codes FROM s GROUP BY 1, 2")
def e24(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "supplier", _SCOPE).where("weight is not null").selectExpr("*", "1 + cast(floor(length(code) + weight) as bigint) % 4 AS batch")
    return batching.batch_summary(rows, 4).select("project_id", "batch", F.round("weight", 1).alias("weight"), "areas", "sections", "codes")


@_query("p1_overweight_areas", f"WITH a AS (SELECT project_id, working_area, sum(coalesce(weight, 0)) AS weight FROM ({derived_sql('supplier', _SCOPE)}) GROUP BY 1, 2), m AS (SELECT project_id, sum(weight) / 30 * CAST(1.1 AS DOUBLE) AS most FROM a GROUP BY 1) SELECT project_id, working_area, round(weight, 1) AS weight FROM a JOIN m USING (project_id) WHERE weight > most")
def p1_overweight(spark: SparkSession, d: str) -> DataFrame:
    return batching.overweight_areas(derived(spark, d, "supplier", _SCOPE), 30).select("project_id", "working_area", F.round("weight", 1).alias("weight"))


@_query("e24_area_summary", f"SELECT project_id, 1 + length(working_area) % 4 AS batch, section, working_area, round(sum(coalesce(weight, 0)), 1) AS weight, count(weight) AS known, count(*) - count(weight) AS missing FROM ({derived_sql('supplier', _SCOPE)}) GROUP BY ALL")
def e24_areas(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "supplier", _SCOPE).selectExpr("*", "1 + length(working_area) % 4 AS batch")
    return batching.area_summary(rows).withColumn("weight", F.round("weight", 1))


@_query("g2_area_order", f"SELECT project_id, code, row_number() OVER (PARTITION BY project_id ORDER BY CASE section WHEN 'UCA' THEN 0 WHEN 'UAA' THEN 1 ELSE 2 END, section, lpad(split_part(working_area, '-', 2), 6, '0'), code) AS place FROM ({derived_sql('supplier', _SCOPE)})")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return batching.in_area_order(derived(spark, d, "supplier", _SCOPE), order=("UCA", "UAA")).select("project_id", "code", "place")


_REMARKS = ["s_suppkey AS row_pos", "s_name AS code", "s_suppkey % 4 = 0 AS gone", "case when s_suppkey % 5 = 0 then 'See BQ not exist' when s_suppkey % 7 = 0 then 'SOLID handling support not in GP lot.' end AS note", "case when s_suppkey % 35 = 0 then 'solid handling support not in gp lot' else s_name end AS other"]


@_query("p2_exclusions", f"""SELECT row_pos, concat_ws('; ', CASE WHEN gone THEN 'Deleted' END, CASE WHEN lower(coalesce(note, '') || '|' || other) LIKE '%bq not exist%' THEN 'BQ not exist' END, CASE WHEN lower(coalesce(note, '') || '|' || other) LIKE '%solid handling support not in gp lot%' THEN 'Solid handling not in GP' END) AS exclusion FROM ({derived_sql('supplier', _REMARKS)})""")
def p2_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return batching.with_exclusions(derived(spark, d, "supplier", _REMARKS), "gone").select("row_pos", "exclusion")


@_query("p2_integrate_missing")
def p2(spark: SparkSession, d: str) -> DataFrame:
    scope = derived(spark, d, "supplier", ["s_suppkey AS row_pos", *_SCOPE])
    detail = batching.split_batches(scope.where("row_pos % 3 <> 0").drop("row_pos"), 4)
    return batching.integrate_missing(scope.where("row_pos % 3 = 0"), detail)


# streams, as the batches they are made of
_CHANGES = ["concat(case when event_id % 9 = 0 then ' ' else '' end, case user_id % 10 when 0 then '-' when 1 then 'N/A' else concat('Group ', cast(user_id % 10 as string)) end) AS group_text", "case when event_id % 7 = 0 then '' else concat(event_type, cast(event_id as string)) end AS comment", "event_id AS seq"]


@_query("t2_latest_comments", "SELECT lower(trim(g)) AS key, arg_max(comment, seq) AS comment, max(seq) AS seq FROM (SELECT 'Group ' || (user_id % 10) AS g, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || event_id END AS comment, event_id AS seq FROM events WHERE user_id % 10 > 1) GROUP BY 1")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_comments(derived(spark, d, "events", _CHANGES))


_TARGET = ["c_custkey AS id", "concat(case when c_custkey % 2 = 0 then ' GROUP ' else 'group ' end, cast(c_custkey % 12 as string), ' ') AS group_text", "case when c_custkey % 5 = 0 then null else c_mktsegment end AS comment"]


@_query("t2_stream_replicate", f"""WITH l AS (SELECT lower(trim(group_text)) AS key, arg_max(comment, seq) AS c FROM ({derived_sql('events', _CHANGES)}) WHERE trim(group_text) NOT IN ('-', 'N/A', '') GROUP BY 1)
SELECT id, group_text, CASE WHEN key IS NULL THEN comment WHEN c <> '' THEN c END AS comment FROM ({derived_sql('customer', _TARGET)}) LEFT JOIN l ON l.key = lower(trim(group_text))""")
def t2_stream(spark: SparkSession, d: str) -> DataFrame:
    """Changes in three files, a batch each and not in the order of seq; the last batch runs twice."""
    folder = f"{shared_folder(spark)}/replicate-{uuid.uuid4().hex}"
    jobs.create_target(derived(spark, d, "customer", _TARGET), f"{folder}/target", 16)
    changes = derived(spark, d, "events", _CHANGES)
    for k in (1, 0, 2):
        changes.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/drop")
    jobs.stream_upsert(spark, f"{folder}/drop", "group_text string, comment string, seq long", f"{folder}/target", f"{folder}/checkpoint", 16, 1).awaitTermination()
    jobs.upsert_comments(changes.where("seq % 3 = 2"), 2, f"{folder}/target", 16)
    return jobs.read_target(spark, f"{folder}/target").select("id", "group_text", "comment")


@_query("t1_stream_ingest", "SELECT 'f' || (user_id % 20) AS filename, CAST(event_id % 5 AS INTEGER) AS page, count(*) AS rows, bool_or(event_id % 3 = 0) AS code_found, CASE WHEN bool_or(event_id % 3 = 0) THEN 'OK' ELSE 'NO CODE' END AS status FROM events GROUP BY 1, 2")
def t1(spark: SparkSession, d: str) -> DataFrame:
    """The stream over a drop folder of extracted rows, in the shared folder; the result is its page log."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = derived(spark, d, "events", ["concat('f', cast(user_id % 20 as string)) AS filename", "cast(event_id % 5 as int) AS page", "case when event_id % 3 = 0 then 'k' else '' end AS kks"])
    rows.write.parquet(f"{folder}/drop")
    jobs.stream_ingest(spark, f"{folder}/drop", "filename string, page int, kks string", f"{folder}/sink", f"{folder}/checkpoint").awaitTermination()
    # a page's rows may come in several batches
    log = spark.read.parquet(f"{folder}/sink/log").groupBy("filename", "page").agg(F.sum("rows").alias("rows"), F.bool_or("code_found").alias("code_found"))
    return log.withColumn("status", F.when(F.col("code_found"), "OK").otherwise("NO CODE"))


__all__ = ["QUERIES", "SQL", "table"]
