"""Queries of text search, messages, layout, sources over documents, pages, conversations and derived cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, search
from ..sources import tables as sources
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


DOCS = ["doc_id AS doc", "cast(0 as bigint) AS page", "coalesce(text, '') AS text"]
_WORD = r"(^|[^\p{{L}}\p{{N}}_]){0}($|[^\p{{L}}\p{{N}}_])"


def _has(word: str) -> str:
    return f"regexp_matches(lower(text), '{_WORD.format(word)}')"


@_query("c5_boolean_match", f"SELECT doc_id, ({_has('token')} AND NOT {_has('secret')}) OR (regexp_matches(lower(text), 'licen') AND {_has('the')}) AS hit FROM documents")
def c5(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "documents", ["doc_id", "text"])
    return rows.select("doc_id", search.boolean_match(F.col("text"), "(token AND NOT secret) OR (licen* AND the)").alias("hit"))


@_query("c6_message_filter", """SELECT conv_id, turn FROM conversations WHERE role = 'user' AND ((lower(text) LIKE '%tion%' AND lower(text) LIKE '%the%') OR lower(text) LIKE '%der%') AND TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (conv_id % 60) BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'
AND conv_id % 3 = 0""")
def c6(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "conversations", ["conv_id", "turn", "role AS sender", "'x' AS recipient", "'' AS subject", "text AS body", "date_add(date '2024-01-01', cast(conv_id % 60 as int)) AS date", "case when conv_id % 3 = 0 then array('a.PDF') else array('b.txt') end AS attachments"])
    return search.message_filter(rows, sender="user", terms='"tion"+the,"der"', in_subject=False, date_from="2024-01-10", date_to="2024-02-10", attachment=".pdf").select("conv_id", "turn")


_CELLS = ["concat('f', cast(l_orderkey % 50 as string)) AS file", "l_returnflag AS sheet", "l_orderkey AS row", "cast(l_linenumber as bigint) AS col", "concat('v', cast(l_partkey as string)) AS value"]


@_query("c8_cell_hits", f"SELECT file, sheet, chr(CAST(64 + col AS INTEGER)) || row AS coordinate, value FROM ({derived_sql('lineitem', _CELLS)}) WHERE value LIKE '%v11%'")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return search.cell_hits(derived(spark, d, "lineitem", _CELLS), "V11")


_GRID = ["concat('f', cast(o_orderkey % 20 as string)) AS file", "'s' AS sheet", "cast(1 + floor(o_orderkey / 80) as bigint) AS row", "cast(1 + floor(o_orderkey / 20) % 4 as bigint) AS col", "concat('v', cast(o_custkey as string)) AS value"]


@_query("c8_row_search", f"WITH g AS ({derived_sql('orders', _GRID)}), h AS (SELECT DISTINCT file, row FROM g WHERE value LIKE '%v12%') SELECT g.file, g.sheet, g.row, g.col, t.value AS header, g.value FROM g JOIN h USING (file, row) LEFT JOIN (SELECT file, col, value FROM g WHERE row = 1) t ON t.file = g.file AND t.col = g.col")
def c8_rows(spark: SparkSession, d: str) -> DataFrame:
    return search.row_search(derived(spark, d, "orders", _GRID), "v12")


_PAGED = ["conv_id AS doc", "turn AS page", "text"]


@_query("c9_search_pages", f"""WITH p AS ({derived_sql('conversations', _PAGED)}), f AS (SELECT doc FROM p GROUP BY 1 HAVING bool_or({_has('the')}) AND bool_or(regexp_matches(lower(text), 'tion')) AND NOT bool_or({_has('der')})),
h AS (SELECT doc, page, text, 'the' AS term, instr(lower(text), 'the') AS hit, 3 AS n FROM p WHERE {_has('the')} UNION ALL SELECT doc, page, text, 'tion*', instr(lower(text), 'tion'), 4 FROM p WHERE regexp_matches(lower(text), 'tion') UNION ALL SELECT doc, page, text, 'der', instr(lower(text), 'der'), 3 FROM p WHERE {_has('der')})
SELECT doc, page, term, substr(text, greatest(hit - 50, 1), hit - greatest(hit - 50, 1) + n + 50) AS context FROM h WHERE doc IN (SELECT doc FROM f)""")
def c9(spark: SparkSession, d: str) -> DataFrame:
    return search.search_pages(derived(spark, d, "conversations", _PAGED), "the AND tion* AND NOT der")


@_query("c10_screen_documents", """SELECT doc_id AS doc, concat_ws(', ', CASE WHEN contains(text, 'AK') THEN 'AK' END, CASE WHEN contains(text, 'ER') THEN 'ER' END) AS codes, 'doc-' || (2000 + doc_id % 20) AS path FROM documents
WHERE (lower(text) LIKE '%token%' OR lower(text) LIKE '%licen%') AND (contains(text, 'AK') OR contains(text, 'ER'))""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "documents", ["doc_id AS doc", "concat('doc-', cast(2000 + doc_id % 20 as string)) AS path", "text"])
    return search.screen_documents(rows, ["token", "licen"], ["AK", "ER"]).join(rows.select("doc", "path"), "doc").select("doc", "codes", "path")


_KEYWORDS = "SELECT keyword, arg_max(category, p) AS category FROM (SELECT lower(trim(split_part(text, ' ', 1 + CAST(item_id % 5 AS INTEGER)))) AS keyword, 'cat' || (item_id % 4) AS category, item_id AS p FROM benchmark) WHERE length(keyword) BETWEEN 4 AND 12 AND regexp_matches(keyword, '^[a-z]+$') GROUP BY 1"


def keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "benchmark", ["split(text, ' ')[cast(item_id % 5 as int)] AS keyword", "concat('cat', cast(item_id % 4 as string)) AS category", "item_id AS row_pos"])
    return sources.keyword_list(rows).where("length(keyword) between 4 and 12 and keyword rlike '^[a-z]+$'")


@_query("a2_keyword_list", _KEYWORDS)
def a2(spark: SparkSession, d: str) -> DataFrame:
    return keywords(spark, d)


def matches(spark: SparkSession, d: str) -> DataFrame:
    return search.screen_keywords(derived(spark, d, "conversations", _PAGED), keywords(spark, d))


_PIECES = f"""k AS ({_KEYWORDS}), m AS (SELECT conv_id AS doc, turn AS page, k.keyword, k.category, text, string_split(lower(text), k.keyword) AS x FROM conversations JOIN k ON contains(lower(text), k.keyword)),
e AS (SELECT doc, page, keyword, category, text, unnest(list_transform(range(1, len(x)), lambda i: list_sum(list_transform(x[1:i], lambda y: length(y)))::BIGINT + (i - 1) * length(keyword))) AS position FROM m)"""


@_query("e21_screen_keywords", f"""WITH {_PIECES} SELECT doc, page, keyword, category, position, array_to_string(regexp_extract_all(text, '\\S+')[greatest(len(regexp_extract_all(substr(text, 1, position + 1), '\\S+')) - 10, 1):len(regexp_extract_all(substr(text, 1, position + 1), '\\S+')) + 10], ' ') AS context FROM e""")
def e21(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d)


_STATS = f"WITH {_PIECES}, s AS (SELECT doc, page, count(*) AS matches, count(DISTINCT keyword) AS unique_keywords, count(*) + count(DISTINCT keyword) * 0.5::DOUBLE AS score FROM e GROUP BY 1, 2)"


@_query("e22_page_statistics", f"{_STATS} SELECT doc, page, matches, unique_keywords, score FROM s")
def e22(spark: SparkSession, d: str) -> DataFrame:
    return search.page_statistics(matches(spark, d)).select("doc", "page", "matches", "unique_keywords", "score")


@_query("g3_high_scoring_pages", f"{_STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS k, count(*) OVER (PARTITION BY doc) AS n FROM s) SELECT doc, page, score FROM r WHERE score >= 5 AND k <= greatest(1, n // 5)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return search.high_scoring_pages(search.page_statistics(matches(spark, d))).select("doc", "page", "score")


@_query("e23_category_summary", f"WITH {_PIECES} SELECT category, count(*) AS matches, count(DISTINCT (doc, page)) AS pages, round(count(*) / count(DISTINCT (doc, page)), 2) AS per_page FROM e GROUP BY 1")
def e23(spark: SparkSession, d: str) -> DataFrame:
    return search.category_summary(matches(spark, d))


@_query("e23_top_keywords", f"WITH {_PIECES} SELECT keyword, count(*) AS matches FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def e23_top(spark: SparkSession, d: str) -> DataFrame:
    return search.top_keywords(matches(spark, d))


_SUBJECTS = ["concat(case o_orderkey % 4 when 0 then 'FW: [EXT] ' when 1 then 'RE: ' when 2 then '[EXT] ' else '' end, case when o_orderkey % 5 = 4 then 'no prefix' else concat('Plant, A', cast(o_custkey % 3 as string), '/CD/', lpad(cast(o_orderkey % 1000 as string), 5, '0'), ': x') end) AS subject"]


@_query("e31_subject_patterns", """SELECT CASE WHEN o_orderkey % 5 = 4 THEN 'none' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'reply and gateway' WHEN 1 THEN 'reply' WHEN 2 THEN 'gateway' ELSE 'plain' END END AS kind, CASE WHEN o_orderkey % 5 = 4 THEN '/' ELSE 'A' || (o_custkey % 3) || '/CD' END AS codes,
CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE 5 END AS digits, count(*) AS n FROM orders GROUP BY ALL""")
def e31(spark: SparkSession, d: str) -> DataFrame:
    return search.subject_patterns(derived(spark, d, "orders", _SUBJECTS))


# drawing text: five files, a title, parts, sections and cut pieces at places made from keys
_ENTITY_ROWS = [
    "cast(floor(s_suppkey / 20) as bigint) AS file", "inline(array(struct('MATERIALS', 100D, 1000D), struct('TOTAL WEIGHT', 120D, 10D), struct('CUT PIPE LENGTH', 400D, 990D), struct('DRAWING NO', 700D, 40D), struct('PIPE CLASS', 700D, 80D), struct('ABCD', 720D, 82D), struct('WXYZ', 10D, 1D), "
    "struct(concat('1HTX', lpad(cast(cast(floor(s_suppkey / 20) as bigint) % 100 as string), 2, '0'), 'BR100-1'), 760D, 41D), "
    "struct(case when s_suppkey % 7 = 0 then 'FITTINGS' else cast(s_suppkey as string) end, 101D, 900D - s_suppkey % 20 * 40), struct('Elbow 90', 150D, 900.02D - s_suppkey % 20 * 40), struct('50', 200D, 900D - s_suppkey % 20 * 40), struct('3', 250D, 900D - s_suppkey % 20 * 40), struct('1.5', 300D, 900D - s_suppkey % 20 * 40), "
    "struct(concat('<', cast(s_suppkey as string), '>'), 401D, 895.5D - s_suppkey % 20 * 40), struct('1200', 430D, 895.5D - s_suppkey % 20 * 40), struct('80', 460D, 895.5D - s_suppkey % 20 * 40), struct('PL', 480D, 895.5D - s_suppkey % 20 * 40), struct(concat('<9', cast(s_suppkey as string), '>'), 500D, 895.5D - s_suppkey % 20 * 40), struct('700', 520D, 895.5D - s_suppkey % 20 * 40))) AS (text, x, y)",
]


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Twenty suppliers a drawing; files grow in number with the table."""
    return derived(spark, d, "supplier", _ENTITY_ROWS)


@_query("l1_layout_rows", "SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS file, round(895.5 - s_suppkey % 20 * 40, 1)::DOUBLE AS y, 6 AS n, '<' || s_suppkey || '>' AS first FROM supplier ")
def l1(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.layout_rows(entities(spark, d), "CUT PIPE LENGTH").where(F.col("cells")[0].startswith("<"))
    return rows.select("file", "y", F.size("cells").alias("n"), F.col("cells")[0].alias("first"))


@_query("l2_materials_table", """WITH r AS (SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS file, (900 - s_suppkey % 20 * 40)::DOUBLE AS y, s_suppkey AS k FROM supplier) SELECT file, y, CASE WHEN (SELECT count(*) FROM r x WHERE x.file = r.file AND x.k % 7 = 0 AND x.k < r.k) > 0 THEN 'FITTINGS' ELSE '' END AS category, CAST(k AS VARCHAR) AS pt_no, 'Elbow 90' AS component_description, '50' AS n_s, '3' AS qty, '1.5' AS weight FROM r WHERE k % 7 <> 0 AND y > 10""")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return layout.materials_table(entities(spark, d))


@_query("l3_cut_length_table", """WITH r AS (SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS file, (895.5 - s_suppkey % 20 * 40)::DOUBLE AS y, s_suppkey AS k FROM supplier) SELECT file, y, CAST(k AS VARCHAR) AS piece_no, '1200' AS cut_length, '80' AS n_s, 'PL' AS remarks FROM r UNION ALL SELECT file, y, '9' || k, '700', '', '' FROM r""")
def l3(spark: SparkSession, d: str) -> DataFrame:
    return layout.cut_length_table(entities(spark, d))


@_query("l4_drawing_fields", "SELECT DISTINCT CAST(floor(s_suppkey / 20) AS BIGINT) AS file, '1HTX' || lpad(CAST(CAST(floor(s_suppkey / 20) AS BIGINT) % 100 AS VARCHAR), 2, '0') || 'BR100-1' AS drawing_no, 'ABCD' AS pipe_class FROM supplier")
def l4(spark: SparkSession, d: str) -> DataFrame:
    return layout.drawing_fields(entities(spark, d))


# tables with a two-row header: words of a header, and cells of parts, each at a place of its own; some cells are missing, some drawings have their columns in another order
_TABLES = [
    "cast(floor(s_suppkey / 20) as bigint) AS file", "s_suppkey AS k", "900 - s_suppkey % 20 * 40 AS y", "case when floor(s_suppkey / 20) % 2 = 0 then 200 else 300 end AS xs", "case when floor(s_suppkey / 20) % 2 = 0 then 300 else 200 end AS xw", "s_suppkey % 20 = 0 AS top",
]
_TABLE_CELLS = (
    ("top", "'MATERIALS'", "100", "1000"), ("top", "'PT'", "101", "960"), ("top", "'NO'", "103", "950"), ("top", "'COMPONENT'", "150", "960"), ("top", "'DESCRIPTION'", "148", "950"), ("top", "'N.S.'", "xs", "960"), ("top", "'(MM)'", "xs + 4", "950"),
    ("top", "'QTY'", "250", "960"), ("top", "'WEIGHT'", "xw", "960"), ("top", "'(KG)'", "xw - 3", "950"), ("top", "'TOTAL WEIGHT'", "120", "100"),
    ("k % 7 = 0", "'FITTINGS'", "101", "y + 20"), ("true", "cast(k as string)", "101", "y"), ("k % 3 <> 0", "'Elbow'", "140", "y"), ("k % 3 <> 0", "'90'", "160", "y + 0.02"), ("k % 5 <> 0", "'50'", "xs + k % 9", "y"),
    ("k % 4 <> 0", "'3'", "252", "y"), ("true", "'1.5'", "xw - k % 11", "y"),
)
_TABLE_SQL = "e AS (" + " UNION ALL ".join(f"SELECT file, {t} AS text, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM h WHERE {w}" for w, t, x, y in _TABLE_CELLS) + ")"


def headed_entities(spark: SparkSession, d: str) -> DataFrame:
    cells = F.expr("array(" + ", ".join(f"case when {w} then struct({t} AS text, cast({x} as double) AS x, cast({y} as double) AS y) end" for w, t, x, y in _TABLE_CELLS) + ")")
    return derived(spark, d, "supplier", _TABLES).select("file", F.inline(F.array_compact(cells)))


@_query("l2_headed_materials", rf"""WITH h AS ({derived_sql('supplier', _TABLES)}), {_TABLE_SQL},
b AS (SELECT e.file, e.text, e.x, round(e.y, 1) AS y FROM e JOIN (SELECT file, x, y FROM e WHERE text = 'MATERIALS') t ON t.file = e.file AND e.y < t.y AND e.x >= t.x - 1),
top AS (SELECT file, list_sort(list(DISTINCT y), 'DESC')[1:2] AS y FROM b GROUP BY 1),
one AS (SELECT b.file, b.x, b.text FROM b JOIN top ON top.file = b.file AND b.y = top.y[1]), two AS (SELECT b.file, b.x, b.text FROM b JOIN top ON top.file = b.file AND b.y = top.y[2]),
near AS (SELECT two.file, two.text, arg_min(one.x, abs(one.x - two.x)) AS home FROM two JOIN one ON one.file = two.file AND abs(one.x - two.x) <= 12 GROUP BY two.file, two.text, two.x),
label AS (SELECT one.file, one.x, regexp_replace(one.text || coalesce(near.text, ''), '[^A-Za-z0-9]', '', 'g') AS label FROM one LEFT JOIN near ON near.file = one.file AND near.home = one.x),
col AS (SELECT file, CASE label WHEN 'PTNO' THEN 'pt_no' WHEN 'COMPONENTDESCRIPTION' THEN 'description' WHEN 'NSMM' THEN 'n_s' WHEN 'QTY' THEN 'qty' WHEN 'WEIGHTKG' THEN 'weight' END AS name, coalesce((lag(x) OVER w + x) / 2, -1e9) AS lo, coalesce((lead(x) OVER w + x) / 2, 1e9) AS hi FROM label WINDOW w AS (PARTITION BY file ORDER BY x)),
r AS (SELECT b.file, b.y, name, b.x, b.text FROM b JOIN top ON top.file = b.file AND b.y < top.y[2] JOIN (SELECT file, y FROM b WHERE text = 'TOTAL WEIGHT') s ON s.file = b.file AND b.y > s.y JOIN col ON col.file = b.file AND b.x >= lo AND b.x < hi),
g AS (SELECT file, y, arg_min(text, x) AS first, {', '.join(f"coalesce(string_agg(text, ' ' ORDER BY x) FILTER (name = '{c}'), '') AS {c}" for c in ('pt_no', 'description', 'n_s', 'qty', 'weight'))} FROM r GROUP BY 1, 2),
f AS (SELECT *, coalesce(last_value(CASE WHEN first = 'FITTINGS' THEN first END IGNORE NULLS) OVER (PARTITION BY file ORDER BY y DESC), '') AS category FROM g)
SELECT file, y, category, pt_no, description AS component_description, n_s, qty, weight FROM f WHERE regexp_full_match(pt_no, '\d+')""")
def l2_headed(spark: SparkSession, d: str) -> DataFrame:
    return layout.materials_table(headed_entities(spark, d))


@_query("l5_extraction_summary", """WITH r AS (SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS file, s_suppkey AS k FROM supplier) SELECT file, count_if(k % 7 <> 0 AND 900 - k % 20 * 40 > 10) AS mat_rows, 2 * count(*) AS cut_rows, false AS cut_missing, CASE WHEN file % 3 = 0 THEN 'damaged' ELSE '' END AS error FROM r GROUP BY 1
UNION ALL SELECT -1 - file, 0, 0, true, 'no reader' FROM (SELECT DISTINCT CAST(floor(s_suppkey / 20) AS BIGINT) AS file FROM supplier) WHERE file % 5 = 0""")
def l5(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    errors = e.select("file").distinct().selectExpr("inline(array(struct(file AS file, case when file % 3 = 0 then 'damaged' end AS error), struct(-1 - file AS file, case when file % 5 = 0 then 'no reader' end AS error)))").where("error is not null")
    found = layout.extraction_summary(e, layout.materials_table(e), layout.cut_length_table(e), layout.drawing_fields(e), errors)
    return found.select("file", "mat_rows", "cut_rows", "cut_missing", "error")


@_query("f8_forward_fill", f"SELECT row_pos, last_value(v IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_pos ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT {ROW}, l_suppkey AS file, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END AS v FROM lineitem)")
def f8(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "lineitem", [ROW, "l_suppkey AS file", "case when l_linenumber % 3 = 0 then l_partkey end AS v"])
    return layout.forward_fill(rows, F.col("v"), "filled", "file", F.asc("row_pos")).select("row_pos", "filled")


# sources
@_query("a3_attribute_rows", "SELECT 'id' || p_partkey AS id, p_type AS a, replace(p_brand || ',x', ',', '') AS c FROM part")
def a3(spark: SparkSession, d: str) -> DataFrame:
    lines = derived(spark, d, "part", ["concat('id', cast(p_partkey as string), ';A;old;A;', p_type, ';P1 CONN;', p_brand, ',x') AS value"])
    return sources.wide_attributes(sources.attribute_rows(lines)).select("id", F.col("A").alias("a"), F.col("P1 CONN").alias("c"))


@_query("a4_filter_files", "SELECT '/r/' || o_orderkey || '/Rev' || (o_custkey % 9) || '.PDF' AS path, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders WHERE floor(o_totalprice) BETWEEN 50000 AND 200000 AND o_custkey % 9 IN (1, 2)")
def a4(spark: SparkSession, d: str) -> DataFrame:
    files = derived(spark, d, "orders", ["concat('/r/', cast(o_orderkey as string), '/Rev', cast(o_custkey % 9 as string), '.PDF') AS path", "cast(floor(o_totalprice) as bigint) AS length"])
    return sources.filter_files(files, ".pdf", 50_000, 200_000, "rev[12]")


@_query("a4_list_files")
def a4_list(spark: SparkSession, d: str) -> DataFrame:
    """The inventory of the tables' own files: names, not contents."""
    return sources.list_files(spark, d, ".parquet").select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), "length")


@_query("a5_cells_from_rows", "SELECT 'part' AS file, 's' AS sheet, p_partkey + 1 AS row, 2 AS col, p_type AS value, 'B' || (p_partkey + 1) AS coordinate FROM part UNION ALL SELECT 'part', 's', p_partkey + 1, 1, p_name, 'A' || (p_partkey + 1) FROM part")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return sources.cells_from_rows(derived(spark, d, "part", ["*"]), F.lit("part"), F.lit("s"), F.col("p_partkey") + 1, ["p_name", "p_type"])


_HEADED = ["concat('f', cast(o_orderkey % 40 as string)) AS file", "'s' AS sheet", "cast(1 + floor(o_orderkey / 160) as bigint) AS row", "cast(1 + floor(o_orderkey / 40) % 4 as bigint) AS col",
           "case when floor(o_orderkey / 160) = o_orderkey % 40 % 3 + 1 then case floor(o_orderkey / 40) % 4 when 0 then 'Item' when 1 then ' QTY' when 2 then 'Description' else 'x' end when floor(o_orderkey / 160) <= 1 then '' else concat('v', cast(o_custkey as string)) end AS value"]


def headed(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "orders", _HEADED)


@_query("a6_detect_header", "SELECT DISTINCT 'f' || (o_orderkey % 40) AS file, 's' AS sheet, CAST(o_orderkey % 40 % 3 + 2 AS BIGINT) AS header_row, CAST(o_orderkey % 40 % 3 + 2 AS BIGINT) AS hits_row, CAST(o_orderkey % 40 % 3 + 2 AS BIGINT) AS part_row FROM orders")
def a6(spark: SparkSession, d: str) -> DataFrame:
    cells = headed(spark, d)
    asked = ["item", "qty", "description"]
    required, hits, part = (sources.detect_header(cells, m, t) for m, t in (("required", asked), ("min_hits", asked), ("contains_all", ["tem", "descr"])))
    return required.join(hits.withColumnRenamed("header_row", "hits_row"), ["file", "sheet"]).join(part.withColumnRenamed("header_row", "part_row"), ["file", "sheet"])


@_query("a7_table_from_cells", f"""WITH c AS ({derived_sql('orders', _HEADED)}), b AS (SELECT *, CAST(substr(file, 2) AS BIGINT) % 3 + 2 AS h FROM c) SELECT file, sheet, row, max(value) FILTER (col = 1) AS "Item", max(value) FILTER (col = 2) AS "QTY" FROM b WHERE row > h AND trim(value) <> '' AND col IN (1, 2) GROUP BY 1, 2, 3""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    cells = headed(spark, d)
    return sources.table_from_cells(cells, sources.detect_header(cells, "required", ["item", "qty", "description"]), ["Item", "QTY"])


@_query("a8_resolve_columns", "SELECT p_partkey AS item, p_size AS size, p_brand AS description FROM part")
def a8(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "part", ["p_partkey AS `Item No.`", "p_size AS DN", "p_brand AS Descriptoin"])
    found = sources.resolve_columns(rows.columns, {"item": ["item no"], "size": ["dn"], "description": ["Description"]})
    return rows.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


@_query("a9_sanitize_columns", 'SELECT p_partkey AS "Item_No", p_size AS "C_1st", p_brand AS "Item_No_2" FROM part')
def a9(spark: SparkSession, d: str) -> DataFrame:
    return sources.sanitize_columns(derived(spark, d, "part", ["p_partkey AS `Item No.`", "p_size AS `1st`", "p_brand AS `Item  No`"]))


@_query("a10_infer_types", "SELECT p_partkey AS a, p_retailprice AS b, p_type AS c FROM part")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return sources.infer_types(derived(spark, d, "part", ["cast(p_partkey as string) AS a", "cast(p_retailprice as string) AS b", "p_type AS c"]))


@_query("b06_mm_to_header", 'SELECT p_partkey AS k, p_size::DOUBLE AS "bore [mm]", p_type AS kind FROM part')
def b06(spark: SparkSession, d: str) -> DataFrame:
    return sources.mm_to_header(derived(spark, d, "part", ["p_partkey AS k", "concat(cast(p_size as string), ' mm') AS bore", "p_type AS kind"]))


@_query("a13_file_schema_report", "SELECT DISTINCT 'f' || (o_orderkey % 40) AS file, true AS has_item, false AS has_price, false AS all_present FROM orders")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return sources.file_schema_report(headed(spark, d), ["Item", "Price"], "S").select("file", "has_item", "has_price", "all_present")


_PEOPLE = ["lpad(cast(c_custkey as string), 6, '0') AS id", "concat(c_name, case when c_custkey % 3 = 0 then ', \"quoted\"' else ' é' end) AS name", "case when c_custkey % 7 = 0 then null else c_acctbal end AS balance"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query("a1_read_table", f"SELECT * FROM ({derived_sql('customer', _PEOPLE)})")
def a1(spark: SparkSession, d: str) -> DataFrame:
    """Written as text with a header and read again: ids keep their zeros."""
    folder = _folder(spark, "table")
    derived(spark, d, "customer", _PEOPLE).write.option("header", True).option("sep", ";").option("escape", '"').csv(folder)
    return sources.read_table(spark, folder, "id string, name string, balance double", ";")


@_query("a2_read_keyword_list", "SELECT lower(c_mktsegment || ' ' || c_custkey % 50) AS keyword, 'cat' || (c_custkey % 50) AS category FROM customer GROUP BY ALL")
def a2_file(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "keywords")
    rows = derived(spark, d, "customer", ["concat('cat', cast(c_custkey % 50 as string), ' ') AS category", "concat(' ', c_mktsegment, ' ', cast(c_custkey % 50 as string)) AS keyword"])
    rows.write.option("header", True).option("sep", "\t").csv(folder)
    return sources.read_keyword_list(spark, folder)


@_query("a11_write_revision", """SELECT o_orderkey AS id, o_orderstatus AS state, 'R1' AS revision FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'new', 'R2' FROM orders WHERE o_orderkey % 5 <> 0""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """A revision that is kept, one that is replaced, and one that is there already and stays."""
    folder = _folder(spark, "revisions")
    rows = lambda state, where: derived(spark, d, "orders", ["o_orderkey AS id", f"{state} AS state"], where)
    sources.write_revision(rows("o_orderstatus", "o_orderkey % 4 <> 0"), folder, "R1")
    sources.write_revision(rows("'old'", "o_orderkey % 3 <> 0"), folder, "R2")
    sources.write_revision(rows("'new'", "o_orderkey % 5 <> 0"), folder, "R2", "replace")
    sources.write_revision(rows("'lost'", "true"), folder, "R1", "keep")
    return spark.read.parquet(folder)


@_query("a12_write_report", "SELECT 'status' AS name, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a12(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "report")
    tables = {name: table(spark, d, "orders").groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")) for name, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))}
    sources.write_report(tables, folder, "csv")
    read = [spark.read.schema("key string, n long").option("header", True).csv(f"{folder}/{name}").withColumn("name", F.lit(name)) for name in tables]
    return read[0].union(read[1]).select("name", "key", "n")


@_query("a14_import_warnings", """WITH e AS (SELECT DISTINCT 'c' || (p_partkey % 97) AS category FROM part), f AS (SELECT 'c' || (s_suppkey % 97) AS category, count(*) AS n FROM supplier WHERE s_suppkey % 97 <> 5 GROUP BY 1) SELECT category, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS warning FROM e LEFT JOIN f USING (category) WHERE n IS NULL OR n > 1""")
def a14_warnings(spark: SparkSession, d: str) -> DataFrame:
    return sources.import_warnings(derived(spark, d, "part", ["concat('c', cast(p_partkey % 97 as string)) AS category"]).distinct(), derived(spark, d, "supplier", ["concat('c', cast(s_suppkey % 97 as string)) AS category"], "s_suppkey % 97 <> 5"))


@_query("a14_import_price_rows", """WITH u AS (SELECT 'a.csv' AS file_name, p_partkey AS row_pos, CAST(p_name AS VARCHAR) AS description, CAST(p_size AS VARCHAR) AS qty, 'main' AS material_type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'b.csv', p_partkey, CAST(p_brand AS VARCHAR), NULL, 'paint' FROM part WHERE p_partkey % 2 = 1)
SELECT file_name, description, qty, material_type, 'R1' AS bom_rev, row_number() OVER (ORDER BY file_name, row_pos) AS uid FROM u""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    even, odd = (derived(spark, d, "part", ["p_partkey AS row_pos", "p_name AS text", "p_size AS n", "p_brand AS brand"], f"p_partkey % 2 = {k}") for k in (0, 1))
    found = sources.import_price_rows({"a.csv": (even, {"description": "text", "qty": "n"}, "main"), "b.csv": (odd, {"description": "brand"}, "paint")}, ["description", "qty"], "R1")
    return found.select("file_name", "description", "qty", "material_type", "bom_rev", "uid")
