"""Queries of revision compare and reconciliation over two revisions of lineitem and of sums from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, predicates
from .shared import Query, derived, derived_sql, table

ROW = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + cast(floor(l_extendedprice * 100) as bigint) % 10000 AS row_pos"
OLD = [ROW, "l_partkey AS part", "l_returnflag AS flag", "l_quantity AS qty", "l_linestatus AS status", "l_suppkey AS supp"]
NEW = [ROW, "l_partkey AS part", "l_returnflag AS flag", "case when l_partkey % 7 = 0 then l_quantity + 1 when l_partkey % 7 = 1 then l_quantity - 1 else l_quantity end AS qty", "case when l_partkey % 5 = 0 then 'X' else l_linestatus end AS status", "l_suppkey AS supp"]
OLD_ROWS, NEW_ROWS = "l_orderkey % 10 <> 3", "l_orderkey % 11 <> 5"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _old(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "lineitem", OLD, OLD_ROWS)


def _new(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "lineitem", NEW, NEW_ROWS)


_REVISIONS = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY part, flag ORDER BY row_pos) AS occ FROM ({derived_sql("lineitem", OLD, OLD_ROWS)})),
n AS (SELECT *, row_number() OVER (PARTITION BY part, flag ORDER BY row_pos) AS occ FROM ({derived_sql("lineitem", NEW, NEW_ROWS)})),
p AS (SELECT coalesce(n.part, o.part) AS part, coalesce(n.flag, o.flag) AS flag, coalesce(n.occ, o.occ) AS occ, o.occ IS NOT NULL AS in_old, n.occ IS NOT NULL AS in_new,
  o.qty AS old_qty, n.qty AS new_qty, o.status AS old_status, n.status AS new_status, o.supp AS old_supp, n.supp AS new_supp
  FROM o FULL JOIN n ON o.part = n.part AND o.flag = n.flag AND o.occ = n.occ)"""


def _query(name: str, sql: str):  # noqa: ANN202
    def add(run: Query) -> Query:
        QUERIES[name], SQL[name] = run, sql
        return run

    return add


@_query("f1_occurrences", f"SELECT part, flag, row_pos, row_number() OVER (PARTITION BY part, flag ORDER BY row_pos) AS occ, count(*) OVER (PARTITION BY part, flag) > 1 AS duplicate FROM ({derived_sql('lineitem', OLD)})")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return compare.occurrences(derived(spark, d, "lineitem", OLD), ["part", "flag"]).select("part", "flag", "row_pos", "occ", "duplicate")


@_query("f7_pick_by_key", f"SELECT part, arg_min(supp, row_pos) AS first_supp, arg_max(supp, row_pos) AS last_supp FROM ({derived_sql('lineitem', OLD)}) GROUP BY 1")
def f7(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "lineitem", OLD)
    first, last = (compare.pick_by_key(rows, ["part"], last=x).selectExpr("part", f"supp AS {n}_supp") for n, x in (("first", False), ("last", True)))
    return first.join(last, "part")


@_query("d1_pair_positional", f"WITH {_REVISIONS} SELECT part, flag, occ, in_old, in_new, old_qty, new_qty FROM p")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return compare.pair_positional(_old(spark, d), _new(spark, d), ["part", "flag"]).select("part", "flag", "occ", "in_old", "in_new", "old_qty", "new_qty")


@_query("d2_compare_revision", f"""WITH {_REVISIONS}, k AS (SELECT *, CASE WHEN old_qty = new_qty THEN NULL WHEN new_qty > old_qty THEN 'Changed' ELSE 'Smaller' END AS q, CASE WHEN old_status <> new_status THEN 'Changed' END AS s,
  CASE WHEN old_supp = new_supp THEN NULL WHEN new_supp > old_supp THEN 'Changed' ELSE 'Smaller' END AS u FROM p)
SELECT part, flag, occ, CASE WHEN NOT in_old THEN 'New Row' WHEN NOT in_new THEN 'Deleted Row' WHEN q = 'Smaller' OR u = 'Smaller' THEN 'Smaller' WHEN q IS NOT NULL OR s IS NOT NULL OR u IS NOT NULL THEN 'Changed' ELSE 'Unchanged' END AS status,
  CASE WHEN in_old AND in_new THEN concat_ws(', ', CASE WHEN q IS NOT NULL THEN 'qty' END, CASE WHEN s IS NOT NULL THEN 'status' END, CASE WHEN u IS NOT NULL THEN 'supp' END) ELSE '' END AS changed, coalesce(new_qty, 0) - coalesce(old_qty, 0) AS qty_change FROM k""")  # fmt: skip
def d2(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_revision(_old(spark, d), _new(spark, d), ["part", "flag"], ["qty", "status", "supp"], "qty")


@_query("d2_cell_changes", f"""WITH {_REVISIONS}, c AS (SELECT part, flag, occ, unnest([{{'column': 'qty', 'old': CAST(old_qty AS VARCHAR), 'new': CAST(new_qty AS VARCHAR)}}, {{'column': 'status', 'old': old_status, 'new': new_status}}]) AS x FROM p WHERE in_old AND in_new)
SELECT part, flag, occ, x."column" AS "column", x."old" AS "old", x."new" AS "new", 'Changed' AS change FROM c WHERE x."old" <> x."new" """)
def d2_cells(spark: SparkSession, d: str) -> DataFrame:
    return compare.cell_changes(_old(spark, d), _new(spark, d), ["part", "flag"], ["qty", "status"])


@_query("d16_enrich_status", f"WITH {_REVISIONS} SELECT n.row_pos, n.part, n.flag, n.occ, o.status AS status FROM n LEFT JOIN o ON o.part = n.part AND o.flag = n.flag AND o.occ = n.occ")
def d16(spark: SparkSession, d: str) -> DataFrame:
    new = compare.occurrences(_new(spark, d), ["part", "flag"]).select("row_pos", "part", "flag", "occ")
    return compare.enrich_status(_old(spark, d), new.drop("occ"), ["part", "flag"], ["status"]).join(new.select("row_pos", "occ"), "row_pos").select("row_pos", "part", "flag", "occ", "status")


_BOM = ["concat(' p', cast(l_partkey as string), ' ') AS item", "l_returnflag AS uom", "l_quantity AS qty"]


@_query("d3_reconcile_shipping", """
WITH b AS (SELECT 'P' || l_partkey AS item, l_returnflag AS uom, sum(l_quantity) AS bom_qty FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2),
s AS (SELECT 'P' || l_partkey AS item, l_returnflag AS uom, sum(l_quantity) AS ship_qty FROM lineitem WHERE l_orderkey % 4 = 0 OR l_partkey % 5 = 1 GROUP BY 1, 2)
SELECT item, uom, bom_qty, ship_qty, CASE WHEN ship_qty IS NULL THEN 'MISSING' WHEN abs(ship_qty - bom_qty) < 1e-9 THEN 'MATCH' ELSE 'MISMATCH' END AS status, coalesce(ship_qty, 0) - bom_qty AS diff FROM b LEFT JOIN s USING (item, uom)
UNION ALL SELECT item, uom, NULL, ship_qty, 'EXTRA', ship_qty FROM s WHERE item NOT IN (SELECT item FROM b)""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    bom = derived(spark, d, "lineitem", _BOM, "l_orderkey % 3 <> 0").groupBy("item", "uom").agg({"qty": "sum"}).selectExpr("item", "uom", "`sum(qty)` AS qty")
    return compare.reconcile_shipping(bom, derived(spark, d, "lineitem", _BOM, "l_orderkey % 4 = 0 OR l_partkey % 5 = 1"))


_ARTICLES = [ROW, "cast(l_partkey as string) AS article", "l_quantity AS qty", "case when l_linenumber % 2 = 0 then concat('text ', cast(l_suppkey as string)) end AS description"]


@_query("d4_reconcile_articles", f"""
WITH b AS (SELECT article, sum(qty) AS q, arg_min(description, row_pos) FILTER (description IS NOT NULL) AS t FROM ({derived_sql('lineitem', _ARTICLES, "l_orderkey % 5 <> 0")}) GROUP BY 1),
u AS (SELECT article, sum(qty) AS q, arg_min(description, row_pos) FILTER (description IS NOT NULL) AS t FROM ({derived_sql('lineitem', _ARTICLES, "l_orderkey % 5 <> 1 AND l_partkey % 6 <> 0 OR l_partkey % 6 = 3")}) GROUP BY 1)
SELECT coalesce(b.article, u.article) AS article, coalesce(u.t, b.t) AS description, coalesce(b.q, 0) AS base_qty, coalesce(u.q, 0) AS update_qty, coalesce(u.q, 0) - coalesce(b.q, 0) AS delta,
  CASE WHEN b.article IS NULL THEN 'New' WHEN u.article IS NULL THEN 'Deleted' ELSE 'Changed' END AS status FROM b FULL JOIN u ON b.article = u.article WHERE coalesce(u.q, 0) <> coalesce(b.q, 0)""")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return compare.reconcile_articles(derived(spark, d, "lineitem", _ARTICLES, "l_orderkey % 5 <> 0"), derived(spark, d, "lineitem", _ARTICLES, "l_orderkey % 5 <> 1 AND l_partkey % 6 <> 0 OR l_partkey % 6 = 3"))


_RULES = [("supplier", ["supp", "flag"], "qty"), ("part", ["part"], "qty")]


def _rule_sql(name: str, key: str) -> str:
    total = lambda rows, n: f"(SELECT {key} AS key, sum(qty) AS qty_{n}, count(*) AS rows_{n} FROM ({rows}) GROUP BY 1)"
    a, b = derived_sql("lineitem", OLD, "l_orderkey % 7 <> 0 OR l_partkey % 4 = 1"), derived_sql("lineitem", OLD, "l_orderkey % 7 <> 1 OR l_partkey % 4 = 1")
    return f"""SELECT '{name}' AS rule, key, CASE WHEN rows_b IS NULL THEN 'only in A' WHEN rows_a IS NULL THEN 'only in B' ELSE 'Mismatch' END AS status, qty_a, qty_b, coalesce(rows_a, 0) AS rows_a, coalesce(rows_b, 0) AS rows_b
FROM {total(a, 'a')} a FULL JOIN {total(b, 'b')} b USING (key) WHERE rows_a IS NULL OR rows_b IS NULL OR abs(qty_a - qty_b) > 1e-9 OR rows_a <> rows_b"""


def _rule_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return derived(spark, d, "lineitem", OLD, "l_orderkey % 7 <> 0 OR l_partkey % 4 = 1"), derived(spark, d, "lineitem", OLD, "l_orderkey % 7 <> 1 OR l_partkey % 4 = 1")


@_query("d5_reconcile_rules", f"{_rule_sql('supplier', 'concat_ws(chr(124), supp, flag)')} UNION ALL {_rule_sql('part', 'CAST(part AS VARCHAR)')}")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return compare.reconcile_rules(*_rule_sides(spark, d), _RULES)


_CUT_RULES = [("Cut List", ["part", "flag"], "qty"), ("Support List", ["supp"], None)]
_ROLLED = " UNION ALL ".join(f"SELECT '{name}' AS rule, * FROM ({sql})" for name, sql in (
    (name, f"SELECT key, CASE WHEN rows_b IS NULL THEN 'a' WHEN rows_a IS NULL THEN 'b' WHEN rows_a <> rows_b{' OR abs(qa - qb) > 1e-9' if q else ''} THEN 'x' ELSE 'm' END AS s FROM (SELECT {key} AS key, sum(qty) AS qa, count(*) AS rows_a FROM ({derived_sql('lineitem', OLD, 'l_orderkey % 7 <> 0 OR l_partkey % 4 = 1')}) GROUP BY 1) FULL JOIN (SELECT {key} AS key, sum(qty) AS qb, count(*) AS rows_b FROM ({derived_sql('lineitem', OLD, 'l_orderkey % 7 <> 1 OR l_partkey % 4 = 1')}) GROUP BY 1) USING (key)")
    for name, key, q in (("Cut List", "concat_ws('|', part, flag)", True), ("Cut List by item", "CAST(part AS VARCHAR)", True), ("Support List", "CAST(supp AS VARCHAR)", False))
))


@_query("d5_reconcile_statistics", f"SELECT rule, count_if(s = 'a') AS only_a, count_if(s = 'b') AS only_b, count_if(s = 'x') AS mismatch, count_if(s = 'm') AS match FROM ({_ROLLED}) GROUP BY 1")
def d5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return compare.reconcile_statistics(*_rule_sides(spark, d), compare.rolled_up(_CUT_RULES))


@_query("d5_scope_hint", f"""WITH n AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN l_orderkey || '/SU' ELSE CAST(l_orderkey AS VARCHAR) END AS key FROM lineitem), m AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN l_orderkey || '/SU' ELSE CAST(l_orderkey AS VARCHAR) END AS key FROM lineitem WHERE l_quantity < 40),
o AS (SELECT key FROM n EXCEPT SELECT key FROM m) SELECT count(*) AS only_a, count_if(NOT ends_with(key, '/SU')) AS without_suffix, 'some names only in A lack the suffix: A may have more scope' AS hint FROM o""")
def d5_hint(spark: SparkSession, d: str) -> DataFrame:
    side = lambda where: derived(spark, d, "lineitem", ["case when l_partkey % 3 = 0 then concat(cast(l_orderkey as string), '/SU') else cast(l_orderkey as string) end AS structure"], where)
    return compare.scope_hint(compare.reconcile_rules(side("true"), side("l_quantity < 40"), [("Support List", ["structure"], None)]))


@_query("g5_diff_order", f"SELECT key, status FROM ({_rule_sql('part', 'CAST(part AS VARCHAR)')})")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_order(compare.reconcile_rules(*_rule_sides(spark, d), _RULES[1:])).select("key", "status")


_COR_NEW = ["l_partkey AS item", "case when l_returnflag = 'R' then null else l_returnflag end AS corrosion", "case when l_orderkey % 7 = 0 then l_quantity + 1 else l_quantity end AS qty", "case when l_linenumber = 3 then 'Special cut' end AS remarks"]
_COR = ["l_partkey AS item", "case when l_returnflag = 'R' then null else l_returnflag end AS corrosion", "l_quantity AS qty", "case when l_linenumber = 3 then 'Special cut' end AS remarks"]


@_query("d6_reconcile_po_cor", f"""WITH b AS ({derived_sql('lineitem', _COR, "l_partkey % 89 <> 0")}), u AS ({derived_sql('lineitem', _COR_NEW, "l_partkey % 97 <> 0")})
SELECT b.item, b.corrosion, CASE WHEN u.qty IS NULL THEN 'Deleted' WHEN u.qty = b.qty THEN 'Same' ELSE 'Changed' END AS status, coalesce(u.qty, 0) - b.qty AS delta, CASE WHEN lower(b.remarks) LIKE '%special%' THEN b.remarks END AS remark
FROM b LEFT JOIN u ON b.item = u.item AND b.corrosion IS NOT DISTINCT FROM u.corrosion
UNION ALL SELECT item, corrosion, 'New', qty, NULL FROM u WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.item = u.item AND b.corrosion IS NOT DISTINCT FROM u.corrosion)""")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return compare.reconcile_po_cor(derived(spark, d, "lineitem", _COR, "l_partkey % 89 <> 0"), derived(spark, d, "lineitem", _COR_NEW, "l_partkey % 97 <> 0"))


_PO = [ROW, "concat(' pipe ', cast(l_partkey as string)) AS description", "l_quantity AS qty", "case when l_linenumber % 4 = 0 then null else l_extendedprice end AS weight"]


@_query("d7_reconcile_po_bom", f"""
WITH a AS (SELECT trim(description) AS description, arg_min({{'q': qty, 'w': weight}}, row_pos) AS x FROM ({derived_sql('lineitem', _PO, "l_orderkey % 3 <> 1")}) GROUP BY 1),
b AS (SELECT trim(description) AS description, arg_min({{'q': qty, 'w': weight}}, row_pos) AS x FROM ({derived_sql('lineitem', _PO, "l_orderkey % 3 <> 0 OR l_partkey % 3 = 1")}) GROUP BY 1),
j AS (SELECT coalesce(a.description, b.description) AS description, a.x.q AS pq, b.x.q AS bq, b.x.w AS bw, round(coalesce(b.x.q, 0) - coalesce(a.x.q, 0), 2) AS dq, round(coalesce(b.x.w, 0) - coalesce(a.x.w, 0), 2) AS dw FROM a FULL JOIN b ON a.description = b.description)
SELECT description, CASE WHEN pq IS NULL THEN 'New' WHEN bq IS NULL THEN 'Removed' WHEN dq <> 0 OR dw <> 0 THEN 'Changed' ELSE 'Same' END AS status, CASE WHEN dq <> 0 THEN dq END AS qty_diff, CASE WHEN dw <> 0 THEN dw END AS weight_diff, CASE WHEN bw IS NULL AND bq IS NOT NULL THEN 'no weight' END AS note FROM j""")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return compare.reconcile_po_bom(derived(spark, d, "lineitem", _PO, "l_orderkey % 3 <> 1"), derived(spark, d, "lineitem", _PO, "l_orderkey % 3 <> 0 OR l_partkey % 3 = 1"))


_PLACED = [ROW, "l_partkey % 40 AS category", "l_suppkey % 7 AS sub"]


@_query("d8_insertion_position", f"""
WITH b AS ({derived_sql('lineitem', _PLACED, "l_partkey % 40 < 38 AND l_suppkey % 7 < 5")}), n AS (SELECT row_pos AS id, * FROM ({derived_sql('lineitem', _PLACED, "NOT (l_partkey % 40 < 38 AND l_suppkey % 7 < 5)")})),
p AS (SELECT id, row_pos, coalesce(s.p, c.p, (SELECT max(row_pos) FROM b)) AS after_pos FROM n LEFT JOIN (SELECT category, sub, max(row_pos) AS p FROM b GROUP BY 1, 2) s USING (category, sub) LEFT JOIN (SELECT category, max(row_pos) AS p FROM b GROUP BY 1) c USING (category))
SELECT id, after_pos, row_number() OVER (PARTITION BY after_pos ORDER BY row_pos) AS seq FROM p""")
def d8(spark: SparkSession, d: str) -> DataFrame:
    new = derived(spark, d, "lineitem", _PLACED, "NOT (l_partkey % 40 < 38 AND l_suppkey % 7 < 5)").selectExpr("row_pos AS id", "*")
    return compare.insertion_position(new, derived(spark, d, "lineitem", _PLACED, "l_partkey % 40 < 38 AND l_suppkey % 7 < 5"))


_SET = [ROW, "l_partkey % 200 AS part", "case when l_linenumber = 2 then null else l_returnflag end AS flag", "l_suppkey % 10 AS supp"]


@_query("d9_row_set_compare", f"""WITH a AS (SELECT part, flag, supp, max(row_pos) AS row_a FROM ({derived_sql('lineitem', _SET, "l_orderkey % 3 <> 1")}) GROUP BY ALL), b AS (SELECT part, flag, supp, max(row_pos) AS row_b FROM ({derived_sql('lineitem', _SET, "l_orderkey % 3 <> 0")}) GROUP BY ALL)
SELECT coalesce(a.part, b.part) AS part, CASE WHEN row_a IS NULL THEN b.flag ELSE a.flag END AS flag, coalesce(a.supp, b.supp) AS supp, CASE WHEN row_b IS NULL THEN 'MISSING' WHEN row_a IS NULL THEN 'EXTRA' ELSE 'IDENTICAL' END AS status, row_a, row_b
FROM a FULL JOIN b ON a.part = b.part AND a.flag IS NOT DISTINCT FROM b.flag AND a.supp = b.supp""")
def d9(spark: SparkSession, d: str) -> DataFrame:
    return compare.row_set_compare(derived(spark, d, "lineitem", _SET, "l_orderkey % 3 <> 1"), derived(spark, d, "lineitem", _SET, "l_orderkey % 3 <> 0"), ["part", "flag", "supp"])


@_query("d10_hierarchical_match", """
WITH b AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + cast(floor(l_extendedprice * 100) as bigint) % 10000 AS row_pos, l_partkey AS p, '1HTX01BR' || lpad(CAST(l_partkey % 900 AS VARCHAR), 3, '0') || '-' || l_partkey || '.' AS code, l_suppkey % 20 AS article, l_quantity AS qty, l_linenumber AS cut_length FROM lineitem),
c AS (SELECT '/1HTX01BR' || lpad(CAST(l_partkey % 900 AS VARCHAR), 3, '0') || '-' || l_partkey || './SU1' AS code, l_suppkey % 20 AS article, l_quantity + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS qty, l_linenumber AS cut_length, l_partkey AS p FROM lineitem WHERE l_partkey % 13 <> 0),
m AS (SELECT b.row_pos, b.code, count(c.code) AS n1, count_if(b.article = c.article) AS n2, count_if(b.article = c.article AND b.qty = c.qty) AS n3, count_if(b.article = c.article AND b.qty = c.qty AND b.cut_length = c.cut_length) AS n4 FROM b LEFT JOIN c ON b.p = c.p AND contains(c.code, b.code) GROUP BY 1, 2)
SELECT row_pos, code, CASE WHEN n1 = 0 THEN 'NO_KKS_MATCH' WHEN n2 = 0 THEN 'ARTICLE_MISMATCH' WHEN n3 = 0 THEN 'QTY_MISMATCH' WHEN n4 = 0 THEN 'CUT_LENGTH_MISMATCH' WHEN n4 = 1 THEN 'EXACT' ELSE 'MULTIPLE' END AS level FROM m""")
def d10(spark: SparkSession, d: str) -> DataFrame:
    code = "concat('1HTX01BR', lpad(cast(l_partkey % 900 as string), 3, '0'), '-', cast(l_partkey as string), '.')"
    base = derived(spark, d, "lineitem", [ROW, f"{code} AS code", "l_suppkey % 20 AS article", "l_quantity AS qty", "l_linenumber AS cut_length"])
    comp = derived(spark, d, "lineitem", [f"concat('/', {code}, '/SU1') AS code", "l_suppkey % 20 AS article", "l_quantity + case when l_orderkey % 7 = 0 then 1 else 0 end AS qty", "l_linenumber AS cut_length"], "l_partkey % 13 <> 0")
    return compare.hierarchical_match(base, comp)


_D9 = """WITH a AS (SELECT DISTINCT l_partkey % 200 AS part, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag, l_suppkey % 10 AS supp FROM lineitem WHERE l_orderkey % 3 <> 1), b AS (SELECT DISTINCT l_partkey % 200 AS part, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag, l_suppkey % 10 AS supp FROM lineitem WHERE l_orderkey % 3 <> 0),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS i, (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y)
SELECT 'IDENTICAL' AS status, i AS n, round(i * 100.0 / x, 2) AS percent FROM n UNION ALL SELECT 'MISSING', x - i, round((x - i) * 100.0 / x, 2) FROM n UNION ALL SELECT 'EXTRA', y - i, round((y - i) * 100.0 / y, 2) FROM n"""


@_query("d9_statistics", _D9)
def d9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return compare.row_set_statistics(d9(spark, d))


_SHEET = [ROW, "l_partkey AS item", "l_returnflag AS coating", "cast(l_suppkey % 10 as string) AS kind", "l_linestatus AS unit", "case when l_linenumber = 3 then '' else concat('n', cast(l_suppkey as string)) end AS note", "cast(l_quantity as bigint) AS qty", "cast(l_linenumber as string) AS spare", "cast(cast(l_quantity as bigint) + l_linenumber as string) AS order_qty"]
_SHEET_NEW = [*_SHEET[:5], "case when l_linenumber = 5 then '' when l_partkey % 9 = 0 then 'new' else concat('n', cast(l_suppkey as string)) end AS note", "cast(l_quantity as bigint) + case when l_partkey % 7 = 0 then -1 else 0 end AS qty", _SHEET[7], "cast(cast(l_quantity as bigint) + l_linenumber + case when l_partkey % 5 = 0 then 2 else 0 end as string) AS order_qty"]
_SHEET_PAIRS = f"""o AS (SELECT *, row_number() OVER (PARTITION BY item, coating, kind, unit ORDER BY row_pos) AS occ FROM ({derived_sql('lineitem', _SHEET, OLD_ROWS)})), n AS (SELECT *, row_number() OVER (PARTITION BY item, coating, kind, unit ORDER BY row_pos) AS occ FROM ({derived_sql('lineitem', _SHEET_NEW, NEW_ROWS)})),
p AS (SELECT coalesce(n.item, o.item)::VARCHAR AS item, coalesce(n.coating, o.coating) AS coating, coalesce(n.kind, o.kind) AS kind, coalesce(n.unit, o.unit) AS unit, coalesce(n.occ, o.occ) AS occ, o.occ IS NULL AS is_new, n.occ IS NULL AS is_gone, o.note AS on_, n.note AS nn, o.qty AS oq, n.qty AS nq, o.spare AS os, n.spare AS ns, CAST(o.order_qty AS DOUBLE) AS oo, CAST(n.order_qty AS DOUBLE) AS no
  FROM o FULL JOIN n ON o.item = n.item AND o.coating = n.coating AND o.kind = n.kind AND o.unit = n.unit AND o.occ = n.occ)"""


@_query("d2_compare_sheet", f"""WITH {_SHEET_PAIRS}, k AS (SELECT *, [CASE WHEN on_ = nn THEN NULL WHEN on_ = '' THEN 'Added' WHEN nn = '' THEN 'Deleted' ELSE 'Changed' END, CASE WHEN oq = nq THEN NULL WHEN nq < oq THEN 'Smaller' ELSE 'Changed' END, CASE WHEN os = ns THEN NULL WHEN CAST(ns AS INT) < CAST(os AS INT) THEN 'Smaller' ELSE 'Changed' END, CASE WHEN oo = no THEN NULL WHEN no < oo THEN 'Smaller' ELSE 'Changed' END] AS c FROM p)
SELECT item, coating, kind, unit, occ, CASE WHEN is_new THEN 'New Row' WHEN is_gone THEN 'Deleted Row' ELSE concat_ws(', ', CASE WHEN list_contains(c, 'Deleted') THEN 'Deleted' END, CASE WHEN list_contains(c, 'Smaller') THEN 'Smaller' END,
  CASE WHEN list_contains(c, 'Changed') AND (NOT list_contains(c, 'Smaller') OR len(c) - list_position(list_reverse(c), 'Changed') > len(c) - list_position(list_reverse(c), 'Smaller')) THEN 'Changed' END, CASE WHEN list_contains(c, 'Added') THEN 'Added' END) END AS marker,
  CASE WHEN coalesce(no, 0) <> coalesce(oo, 0) THEN coalesce(no, 0) - coalesce(oo, 0) END AS qty_change FROM k""")
def d2_sheet(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_sheet(derived(spark, d, "lineitem", _SHEET, OLD_ROWS), derived(spark, d, "lineitem", _SHEET_NEW, NEW_ROWS), ["item", "coating", "kind", "unit", "note", "qty", "spare", "order_qty"])


_LISTED = ["o_orderkey AS row_pos", "lpad(cast(o_custkey as string), 7, '0') AS kks", "o_orderpriority AS medium", "case when o_orderkey % 4 = 0 then '' else cast(o_orderkey % 13 as string) end AS pressure", "case when o_orderkey % 6 = 0 then null else o_orderstatus end AS state"]
_LISTED_NEW = [*_LISTED[:3], "case when o_orderkey % 10 = 0 then '' else cast(o_orderkey % 13 as string) end AS pressure", "case when o_orderkey % 9 = 0 then 'new' else o_orderstatus end AS state"]


@_query("d2_compare_list", f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY kks ORDER BY row_pos) AS occ FROM ({derived_sql('orders', _LISTED, 'o_orderkey % 8 <> 3')})), n AS (SELECT *, row_number() OVER (PARTITION BY kks ORDER BY row_pos) AS occ FROM ({derived_sql('orders', _LISTED_NEW, 'o_orderkey % 9 <> 4')})),
p AS (SELECT coalesce(n.kks, o.kks) AS kks, coalesce(n.occ, o.occ) AS occ, o.occ IS NULL AS is_new, n.occ IS NULL AS is_gone, [{{'c': 'medium', 'a': o.medium, 'b': n.medium}}, {{'c': 'pressure', 'a': o.pressure, 'b': n.pressure}}, {{'c': 'state', 'a': coalesce(o.state, ''), 'b': coalesce(n.state, '')}}] AS x FROM o FULL JOIN n ON o.kks = n.kks AND o.occ = n.occ),
k AS (SELECT *, list_filter(x, lambda y: y.a <> y.b) AS d FROM p), m AS (SELECT DISTINCT kks FROM (SELECT kks FROM o GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT kks FROM n GROUP BY 1 HAVING count(*) > 1))
SELECT k.kks, occ, CASE WHEN is_new THEN 'Added' WHEN is_gone THEN 'Deleted' ELSE concat_ws(', ', CASE WHEN len(list_filter(d, lambda y: y.b = '')) > 0 THEN 'Deleted' END, CASE WHEN len(list_filter(d, lambda y: y.a <> '' AND y.b <> '')) > 0 THEN 'Changed' END, CASE WHEN len(list_filter(d, lambda y: y.a = '')) > 0 THEN 'Added' END) END AS marker,
  m.kks IS NOT NULL AS duplicate, CASE WHEN is_new OR is_gone THEN '' ELSE array_to_string(list_transform(d, lambda y: y.c || ': ' || CASE WHEN y.a = '' THEN '(empty)' ELSE y.a END), '; ') END AS comments FROM k LEFT JOIN m ON m.kks = k.kks""")
def d2_list(spark: SparkSession, d: str) -> DataFrame:
    found = compare.compare_list(derived(spark, d, "orders", _LISTED, "o_orderkey % 8 <> 3"), derived(spark, d, "orders", _LISTED_NEW, "o_orderkey % 9 <> 4"), "kks", ["medium", "pressure", "state"])
    return found.withColumn("comments", F.array_join("comments", "; "))


@_query("d26_balance_summary", """WITH s AS (SELECT o_orderkey AS code FROM orders), f AS (SELECT DISTINCT l_orderkey AS code FROM lineitem WHERE l_quantity < 40), c AS (SELECT code, code % 5 = 0 AS d0, code IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS d1, code IN (SELECT code FROM f) AS fin FROM s),
n AS (SELECT count(*) AS a, (SELECT count(*) FROM f) AS b, count_if(d0) AS d0, count_if(d1) AS d1, count_if(d0 OR d1) AS u, count_if(NOT (d0 OR d1)) AS e, count_if(NOT (d0 OR d1) AND NOT fin) AS m, count_if((d0 OR d1) AND fin) + (SELECT count(*) FROM f WHERE code NOT IN (SELECT code FROM s)) AS x FROM c)
SELECT 'status' AS metric, a AS value FROM n UNION ALL SELECT 'final', b FROM n UNION ALL SELECT 'deducted: deleted', d0 FROM n UNION ALL SELECT 'deducted: heavy', d1 FROM n UNION ALL SELECT 'deducted', u FROM n UNION ALL SELECT 'expected', e FROM n UNION ALL SELECT 'missing in final', m FROM n UNION ALL SELECT 'unexpected in final', x FROM n UNION ALL SELECT 'sets match', CASE WHEN m + x = 0 THEN 1 ELSE 0 END FROM n""")
def d26_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda where: derived(spark, d, "lineitem", ["l_orderkey AS code"], where)
    orders = lambda where: derived(spark, d, "orders", ["o_orderkey AS code"], where)
    return compare.balance_summary(orders("true"), lines("l_quantity < 40"), {"deleted": orders("o_orderkey % 5 = 0"), "heavy": lines("l_quantity > 45")})


@_query("d10_breakdown", f"SELECT level, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS percent FROM ({SQL['d10_hierarchical_match']}) GROUP BY 1")
def d10_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return compare.match_breakdown(d10(spark, d))


_LOOSE = """WITH b AS (SELECT p_partkey AS row_pos, CASE WHEN p_partkey % 3 = 0 THEN '1HTX01BR' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0') || '/' || p_partkey ELSE 'K' || p_partkey || '.' END AS code, p_size AS article, p_size % 5 AS qty FROM part),
c AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'xK' || s_suppkey || '.y' WHEN 1 THEN CAST(s_suppkey AS VARCHAR) ELSE '/' || s_suppkey END AS code, s_suppkey % 50 AS article, s_suppkey % 5 AS qty FROM supplier),
m AS (SELECT b.row_pos, b.code, count(c.code) AS n1, count_if(b.article = c.article) AS n2, count_if(b.article = c.article AND b.qty = c.qty) AS n3 FROM b LEFT JOIN c ON contains(c.code, b.code) OR contains(b.code, c.code) GROUP BY 1, 2)
SELECT row_pos, code, CASE WHEN n1 = 0 THEN 'NO_KKS_MATCH' WHEN n2 = 0 THEN 'ARTICLE_MISMATCH' WHEN n3 = 0 THEN 'QTY_MISMATCH' WHEN n3 = 1 THEN 'EXACT' ELSE 'MULTIPLE' END AS level FROM m"""


@_query("d10_codes_without_core", _LOOSE)
def d10_loose(spark: SparkSession, d: str) -> DataFrame:
    core = "concat('1HTX01BR', lpad(cast(p_partkey % 900 as string), 3, '0'), '/', cast(p_partkey as string))"
    base = derived(spark, d, "part", ["p_partkey AS row_pos", f"case when p_partkey % 3 = 0 then {core} else concat('K', cast(p_partkey as string), '.') end AS code", "p_size AS article", "p_size % 5 AS qty", "1 AS cut_length"])
    code = "case s_suppkey % 4 when 0 then concat('xK', cast(s_suppkey as string), '.y') when 1 then cast(s_suppkey as string) else concat('/', cast(s_suppkey as string)) end AS code"
    return compare.hierarchical_match(base, derived(spark, d, "supplier", [code, "s_suppkey % 50 AS article", "s_suppkey % 5 AS qty", "1 AS cut_length"]))


@_query("d13_copy_flag", """SELECT s_suppkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_partkey % 3 = 0) THEN 'intumescent' ELSE 'none' END AS coating FROM supplier""")
def d13(spark: SparkSession, d: str) -> DataFrame:
    target = derived(spark, d, "supplier", ["s_suppkey AS id", "cast(s_suppkey as double) AS supp", "'none' AS coating"])
    return compare.copy_flag_by_keys(derived(spark, d, "lineitem", ["l_suppkey AS supp"], "l_quantity > 49 AND l_partkey % 3 = 0"), target, ["supp"], "coating", "intumescent").select("id", "coating")


_NOTES = [ROW, "l_partkey AS id", "case when l_linenumber % 3 = 0 then concat('note ', cast(l_suppkey as string)) end AS comment"]


@_query("d14_carry_comments", f"SELECT p_partkey AS id, coalesce(c.x, p_type) AS comment FROM part LEFT JOIN (SELECT id, arg_min(comment, row_pos) FILTER (comment IS NOT NULL) AS x FROM ({derived_sql('lineitem', _NOTES)}) GROUP BY 1) c ON c.id = p_partkey")
def d14(spark: SparkSession, d: str) -> DataFrame:
    return compare.carry_comments(derived(spark, d, "lineitem", _NOTES), derived(spark, d, "part", ["p_partkey AS id", "p_type AS comment"]), "id", ["comment"])


_TARGET = ["p_partkey AS id", "concat(p_type, case when p_size % 3 = 0 then '' else p_brand end) AS group_text", "p_partkey AS row_pos"]


@_query("d15_copy_and_propagate", f"""
WITH l AS (SELECT id, arg_max(comment, row_pos) FILTER (comment IS NOT NULL) AS own FROM ({derived_sql('lineitem', _NOTES)}) GROUP BY 1), t AS (SELECT t.*, l.own FROM ({derived_sql('part', _TARGET)}) t LEFT JOIN l USING (id)),
g AS (SELECT group_text, arg_max(own, row_pos) AS shared FROM t WHERE own IS NOT NULL AND length(group_text) > 5 GROUP BY 1) SELECT id, group_text, row_pos, coalesce(shared, own) AS comment FROM t LEFT JOIN g USING (group_text)""")
def d15(spark: SparkSession, d: str) -> DataFrame:
    return compare.copy_and_propagate(derived(spark, d, "lineitem", _NOTES), derived(spark, d, "part", _TARGET))


@_query("d24_infer_category", """
WITH n AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS description FROM part WHERE p_partkey % 40 <> 1), b AS (SELECT p_partkey AS row_pos, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE p_name || ' ' || p_brand END AS description, p_brand AS category FROM part WHERE p_partkey % 40 = 1),
e AS (SELECT description, arg_min(category, row_pos) AS same FROM b GROUP BY 1), s AS (SELECT n.id, arg_min(b.category, b.row_pos) AS near FROM n JOIN b ON len(list_filter(string_split(lower(n.description), ' '), lambda w: contains(lower(b.description), w))) >= 2 GROUP BY 1)
SELECT id, description, coalesce(same, near, 'Unknown') AS category FROM n LEFT JOIN e USING (description) LEFT JOIN s USING (id)""")
def d24(spark: SparkSession, d: str) -> DataFrame:
    new = derived(spark, d, "part", ["p_partkey AS id", "concat(p_name, ' ', p_type) AS description"], "p_partkey % 40 <> 1")
    base = derived(spark, d, "part", ["p_partkey AS row_pos", "case when p_partkey % 2 = 0 then concat(p_name, ' ', p_type) else concat(p_name, ' ', p_brand) end AS description", "p_brand AS category"], "p_partkey % 40 = 1")
    return compare.infer_category(new, base)


@_query("d25_missing_codes", """SELECT o_orderkey AS code, o_orderstatus AS state, o_orderkey % 5 = 0 AS deducted, CASE WHEN o_orderstatus = 'P' THEN 'inactive' ELSE 'active' END AS tag FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def d25(spark: SparkSession, d: str) -> DataFrame:
    status = derived(spark, d, "orders", ["o_orderkey AS code", "o_orderstatus AS shown", "case when o_orderstatus = 'P' then 'Withdrawn' else o_orderstatus end AS state"])
    out = compare.missing_codes(status.drop("shown"), derived(spark, d, "lineitem", ["l_orderkey AS code"]), derived(spark, d, "orders", ["o_orderkey AS code"], "o_orderkey % 5 = 0"))
    return out.selectExpr("code", "case when state = 'Withdrawn' then 'P' else state end AS state", "deducted", "tag")


@_query("d26_balance_sets", """
WITH e AS (SELECT o_orderkey AS code FROM orders WHERE o_orderkey % 5 <> 0 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45), f AS (SELECT DISTINCT l_orderkey AS code FROM lineitem WHERE l_quantity < 40)
SELECT code, 'missing in final' AS side FROM (SELECT code FROM e EXCEPT SELECT code FROM f) UNION ALL SELECT code, 'unexpected in final' FROM (SELECT code FROM f EXCEPT SELECT code FROM e)""")
def d26(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda where: derived(spark, d, "lineitem", ["l_orderkey AS code"], where)
    orders = lambda where: derived(spark, d, "orders", ["o_orderkey AS code"], where)
    return compare.balance_sets(orders("true"), lines("l_quantity < 40"), [orders("o_orderkey % 5 = 0"), lines("l_quantity > 45")])


@_query("e28_duplicate_keys", f"SELECT item, corrosion, count(*) AS n, coalesce(bool_or(lower(remarks) LIKE '%special%'), false) AS special FROM ({derived_sql('lineitem', _COR)}) GROUP BY 1, 2 HAVING count(*) > 1")
def e28(spark: SparkSession, d: str) -> DataFrame:
    return compare.duplicate_keys(derived(spark, d, "lineitem", _COR), ["item", "corrosion"], "remarks")


@_query("e30_join_unique", f"SELECT part, string_agg(CAST(supp AS VARCHAR), ' | ' ORDER BY p) AS supp FROM (SELECT part, supp, min(row_pos) AS p FROM ({derived_sql('lineitem', OLD)}) GROUP BY 1, 2) GROUP BY 1")
def e30(spark: SparkSession, d: str) -> DataFrame:
    return compare.join_unique(derived(spark, d, "lineitem", OLD).selectExpr("row_pos", "part", "cast(supp as string) AS supp"), ["part"], "supp")


@_query("s1_concatenated", "SELECT p_partkey AS id, p_type AS kind, NULL AS balance FROM part UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return predicates.concatenated([derived(spark, d, "part", ["p_partkey AS id", "p_type AS kind"]), derived(spark, d, "supplier", ["s_suppkey AS id", "s_acctbal AS balance"])])


@_query("s2_article_differences", "SELECT part, 'raw only' AS side FROM (SELECT l_partkey AS part FROM lineitem WHERE l_partkey % 13 <> 0 EXCEPT SELECT l_partkey FROM lineitem WHERE l_partkey % 17 <> 0) UNION ALL SELECT part, 'aggregated only' FROM (SELECT l_partkey AS part FROM lineitem WHERE l_partkey % 17 <> 0 EXCEPT SELECT l_partkey FROM lineitem WHERE l_partkey % 13 <> 0)")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return compare.article_differences(*(derived(spark, d, "lineitem", ["l_partkey AS part"], f"l_partkey % {k} <> 0") for k in (13, 17)), "part")


@_query("s3_key_sets", f"""WITH a AS (SELECT DISTINCT part, flag FROM ({derived_sql('lineitem', OLD, "l_orderkey % 3 <> 1")})), b AS (SELECT DISTINCT part, flag FROM ({derived_sql('lineitem', OLD, "l_orderkey % 3 <> 0")}))
SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return predicates.key_sets(derived(spark, d, "lineitem", OLD, "l_orderkey % 3 <> 1"), derived(spark, d, "lineitem", OLD, "l_orderkey % 3 <> 0"), ["part", "flag"])


_NAMED = ["c_custkey AS row_pos", "c_mktsegment AS name"]


@_query("f2_dedupe_names", "SELECT c_custkey AS row_pos, c_mktsegment || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return predicates.dedupe_names(derived(spark, d, "customer", _NAMED))


_BLANKS = [ROW, "l_orderkey AS file", "case when l_linenumber = 6 then ' ' else l_returnflag end AS key", "case when l_partkey % 9 = 0 then '' else l_linestatus end AS a", "l_quantity - 20 AS b", "case when l_partkey % 4 = 0 then null else 'x' end AS c"]


@_query("c1_drop_rows", f"SELECT row_pos, key FROM ({derived_sql('lineitem', _BLANKS)}) WHERE trim(key) NOT IN ('', 'R')")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return predicates.drop_null_key(predicates.drop_blank_rows(derived(spark, d, "lineitem", _BLANKS), ["key", "a"]), "key", ["R"]).select("row_pos", "key")


@_query("c2_truncate_at_first_blank", f"WITH t AS ({derived_sql('lineitem', _BLANKS)}) SELECT row_pos, key FROM t LEFT JOIN (SELECT file, min(row_pos) AS stop FROM t WHERE trim(key) = '' GROUP BY 1) s USING (file) WHERE stop IS NULL OR row_pos < stop")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return predicates.truncate_at_first_blank(derived(spark, d, "lineitem", _BLANKS), "key").select("row_pos", "key")


@_query("c3_drop_artifacts", "SELECT o_orderkey AS pos, o_orderstatus AS status FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0")
def c3(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "orders", ["case when o_orderkey % 13 = 0 then 'status' when o_orderkey % 17 = 0 then 'Legend: x' else o_orderstatus end AS status", "case when o_orderkey % 13 = 0 then 'pos' else cast(o_orderkey as string) end AS pos", "1 AS Changed", "2 AS `Unnamed: 3`"])
    return predicates.drop_artifacts(rows).selectExpr("cast(pos as bigint) AS pos", "status")


@_query("c4_contains", "SELECT p_partkey AS k, p_name LIKE '%ring%' OR p_name LIKE '%bolt%' AS any_word, p_name LIKE '%red%' AND p_name LIKE '%ring%' AS all_words, p_partkey % 3 < 2 AS stainless FROM part")
def c4(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = derived(spark, d, "part", ["p_partkey AS k", "p_name AS s", "case p_partkey % 3 when 0 then 'X 1,4571 pipe' when 1 then '1.45710' else '1.0345' end AS m"])
    return rows.select("k", predicates.contains_any(F.col("s"), ["RING", "bolt"]).alias("any_word"), predicates.contains_all(F.col("s"), ["red", "ring"]).alias("all_words"), predicates.stainless(F.col("m")).alias("stainless"))


@_query("c7_flag_empty_cells", f"SELECT row_pos, CASE WHEN a = '' OR trim(key) = '' OR (c IS NULL AND b > 0) THEN 'X' ELSE '' END AS flag FROM ({derived_sql('lineitem', _BLANKS)})")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return predicates.flag_empty_cells(derived(spark, d, "lineitem", _BLANKS), ["row_pos", "file"], {"c": "b"}).select("row_pos", "flag")


@_query("g4_spec_order", "SELECT p_partkey AS row_pos, p_brand AS second FROM part")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return predicates.spec_order(derived(spark, d, "part", ["p_partkey AS row_pos", "concat('/', p_type, '/', p_name) AS path", "p_brand AS second", "cast(p_size as string) AS third"]), "path", "second", "third").select("row_pos", "second")


__all__ = ["QUERIES", "SQL", "table"]
