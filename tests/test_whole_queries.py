"""Queries without SQL, and the checks of order sheets, against plain Python or SQL on the rows that Spark made."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import types as T

from plantlists import catalog
from plantlists.operators import batching, bom, schedule, validate
from plantlists.plans import bom_queries, plant_queries
from plantlists.plans.shared import derived
from tests.oracle import FOLDER

_QUERIES = catalog.queries()

#: Conditions of the checks on single rows and keys, in SQL: id, table, condition.
CHECKS = [
    ("V01", "raw", "item_number IS NULL"), ("V02", "raw", "description IS NULL OR trim(description) = ''"), ("V03", "raw", "qty IS NULL OR qty <= 0"), ("V04", "raw", "total_weight_kg IS NULL"),
    ("V05", "raw", "cut_length_mm IS NULL AND abs(weight_kg * qty - total_weight_kg) > 0.02"), ("V06", "raw", "cut_length_mm <= 0"),
    ("V12", "sheet", "order_qty < qty"), ("V13", "sheet", "abs(spare - (order_qty - qty)) > 0.01"),
    ("V14", "sheet", "spare IS NULL AND regexp_matches(material_type, '^(01|02|03|05|06|07|08|10) ')"), ("V15", "sheet", "utilisation_pct > 100"),
    ("V16", "sheet", "total_order_length_m < net_cut_length_m - 0.01"), ("V17", "sheet", "net_cut_length_m IS NOT NULL AND order_weight_kg < net_cut_weight_kg - 0.01"),
    ("V18", "sheet", "total_weight_kg < 0"), ("V19", "sheet", "order_weight_kg < 0"),
    ("V20", "sheet", "net_cut_length_m IS NULL AND qty > 0 AND order_qty > 0 AND abs(total_weight_kg / qty - order_weight_kg / order_qty) > 0.05"), ("V21", "sheet", "total_weight_kg IS NULL"),
    ("V23", "sheet", "qty = 0"), ("V24", "sheet", "rule IS NULL OR rule = ''"),
    ("V25", "sheet", "regexp_matches(material_type, '^0[49] ') AND net_cut_length_m IS NULL AND lower(description) NOT LIKE '%channel%' AND (spare IS NULL OR rule = 'No spare')"),
    ("V07", "(SELECT DISTINCT item_number AS a FROM raw) r", "NOT EXISTS (SELECT 1 FROM sheet WHERE article_number IS NOT DISTINCT FROM r.a)"), ("V08", "(SELECT DISTINCT article_number AS a FROM sheet) s", "NOT EXISTS (SELECT 1 FROM raw WHERE item_number IS NOT DISTINCT FROM s.a)"),
    ("V09", "(SELECT item_number AS i, coating AS k, sum(qty) AS q FROM raw GROUP BY 1, 2) r", "EXISTS (SELECT 1 FROM sheet WHERE article_number = r.i AND coating IS NOT DISTINCT FROM r.k AND net_cut_length_m IS NULL AND (remarks IS NULL OR remarks NOT LIKE '%cut: % mm%') AND abs(qty - r.q) > 0.01)"),
    ("V10", "(SELECT item_number AS i, coating AS k, sum(qty * cut_length_mm) AS mm FROM raw GROUP BY 1, 2) r", "EXISTS (SELECT 1 FROM sheet WHERE article_number = r.i AND coating IS NOT DISTINCT FROM r.k AND abs(net_cut_length_m * 1000 - r.mm) > 1)"),
    ("V22", "(SELECT count(*) AS n FROM sheet GROUP BY article_number, coating, remarks) t", "n > 1"),
]


def test_order_sheet_checks(spark) -> None:
    """The 29 checks on the given rows, and again on rows with every fault planted."""
    rows = bom_queries.raw(spark, FOLDER).selectExpr("*", "total_weight_kg / qty AS weight_kg")
    sheet = bom.order_sheet(rows).toPandas()
    good = rows.toPandas()
    raw, bad = good.copy(), sheet.copy()
    for k, (column, value) in enumerate([("item_number", None), ("description", " "), ("qty", 0), ("total_weight_kg", None), ("weight_kg", 1e6), ("cut_length_mm", 0), ("item_number", 10**9), ("coating", None)]):
        raw.loc[raw.index[40 * k : 40 * k + k + 1], column] = value
    faults = {"order_qty": 0, "spare": None, "utilisation_pct": 101.0, "total_order_length_m": 0.0, "order_weight_kg": -5.0, "total_weight_kg": -1.0, "qty": 0, "rule": "", "article_number": 10**9 + 1, "net_cut_length_m": 7.5, "remarks": "cut: 5 mm", "coating": None}
    for k, (column, value) in enumerate(faults.items()):
        bad.loc[bad.index[30 * k : 30 * k + 35], column] = value
    packed = bad.index[bad["net_cut_length_m"].notna() & bad["order_weight_kg"].notna()]
    bad.loc[packed[-4:], "net_cut_weight_kg"] = 1e6
    bad = bad.loc[[*bad.index, *bad.index[:3]]]
    raw_schema, sheet_schema = (T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]) for df in (rows, bom.order_sheet(rows)))
    for r, s in ((good, sheet), (raw, bad)):
        table = lambda df, schema: spark.createDataFrame([tuple(None if x != x or x is None else int(x) if f.dataType.simpleString() == "bigint" else x for x, f in zip(row, schema, strict=True)) for row in df[schema.names].astype(object).itertuples(index=False, name=None)], schema)
        left, right = table(r, raw_schema), table(s, sheet_schema)
        found = {x.id: x for x in validate.validate_order_sheet(left, right).collect()}
        assert sorted(found) == [f"V{k:02d}" for k in range(1, 30)]
        con = duckdb.connect()
        con.register("raw", left.toPandas().convert_dtypes())
        con.register("sheet", right.toPandas().convert_dtypes())
        for i, source, condition in CHECKS:
            n = con.execute(f"SELECT count(*) FROM {source} WHERE {condition}").fetchone()[0]
            assert found[i].n == n and len(found[i]["rows"]) == min(n, 30), i
            assert (found[i].status == "PASS") == (n == 0), i
        kg = con.execute("SELECT round(coalesce((SELECT sum(total_weight_kg) FROM raw WHERE NOT EXISTS (SELECT 1 FROM sheet WHERE article_number IS NOT DISTINCT FROM item_number AND net_cut_length_m IS NOT NULL)), 0), 2), round(coalesce((SELECT sum(total_weight_kg) FROM sheet WHERE net_cut_length_m IS NULL), 0), 2)").fetchone()
        assert found["V11"].detail.startswith(f"raw {kg[0]:.2f} kg, sheet {kg[1]:.2f} kg") and found["V11"].status == ("PASS" if abs(kg[0] - kg[1]) < 1 else "FAIL")
        assert found["V26"].detail == f"raw {len(r)}, sheet {len(s)}" and len(found["V29"]["rows"]) == s["material_type"].nunique()
    assert all(found[i].n > 0 for i, _, _ in CHECKS), [i for i, _, _ in CHECKS if not found[i].n]
    empty = {x.id: x for x in validate.validate_order_sheet(left.limit(0), right.limit(0)).collect()}
    assert len(empty) == 29 and {x.status for x in empty.values()} == {"PASS", "INFO"}


def bars_one_by_one(pieces: list[int], bar: int) -> int:
    rest: list[int] = []
    for p in sorted(pieces, reverse=True):
        need = min(p + bom.KERF_MM, bar)
        k = next((k for k, r in enumerate(rest) if r >= need), None)
        if k is None:
            rest.append(bar - need)
        else:
            rest[k] -= need
    return len(rest)


def test_packed_rows_query(spark) -> None:
    groups, kind = defaultdict(list), {}
    for r in bom.routed(bom_queries.raw(spark, FOLDER)).where("route IN ('beam', 'rod')").collect():
        groups[r.item_number, r.coating] += [r.cut_length_mm] * r.qty
        kind[r.item_number, r.coating] = 6000 if r.route == "beam" else 2000
    found = {(r.article_number, r.coating): r for r in _QUERIES["e4_packed_rows"](spark, FOLDER).collect()}
    assert set(found) == set(groups)
    for key, pieces in groups.items():
        bars, bar = bars_one_by_one(pieces, kind[key]), kind[key]
        ordered, naive = -(-bars * 105 // 100), -(-sum(pieces) // bar)
        assert (found[key].order_qty, found[key].qty, found[key].spare) == (ordered, naive, ordered - naive)


def test_fuzzy_query(spark) -> None:
    names = [(r.project_id, r.row_pos, r.name) for r in derived(spark, FOLDER, "customer", plant_queries._NAMES).collect()]
    targets = {(r.project_id, r.target) for r in derived(spark, FOLDER, "customer", plant_queries._TARGETS).collect()}

    def ratio(a: str, b: str) -> float:
        a, b = a.strip().lower(), b.strip().lower()
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return float(round(200 * row[-1] / (len(a) + len(b))))

    expected = set()
    for project, target in targets:
        scored = [(ratio(target, n), -pos, n) for p, pos, n in names if p == project and SequenceMatcher(None, target, n.lower()).real_quick_ratio() > 0.8]
        best = max((x for x in scored if x[0] >= 90), default=None)
        if best:
            expected.add((project, target, -best[1], best[2], best[0]))
    assert {tuple(r) for r in _QUERIES["d23_fuzzy_best_match"](spark, FOLDER).select("project_id", "target", "row_pos", "name", "ratio").collect()} == expected


def test_repaired_query(spark) -> None:
    """All names of a project against each target, with the suffixes set right."""
    rows = [(r.project_id, r.row_pos, r.name) for r in derived(spark, FOLDER, "customer", plant_queries._SUFFIXED).collect()]
    targets = {(p, re.sub(r"\([ST]\)", "(S)" if k % 2 == 0 else "(T)", n)) for p, k, n in rows if k % 4 == 0}

    def ratio(a: str, b: str) -> float:
        a, b = a.strip().lower(), b.strip().lower()
        return float(round(200 * schedule.common_length(a, b) / (len(a) + len(b))))

    expected = set()
    for project, target in targets:
        scored = [(ratio(target, n), -pos, n) for p, pos, n in rows if p == project]
        best = max((x for x in scored if x[0] >= 90), default=None)
        if best is None:
            continue
        for own, other in ((" (S)", " (T)"), (" (T)", " (S)")):
            if own in target and other in best[2] and own not in best[2]:
                best = max((x for x in scored if own in x[2] and other not in x[2] and x[0] >= 70), default=best)
                break
        expected.add((project, target, -best[1], best[2], best[0]))
    assert {tuple(r) for r in _QUERIES["d23_repaired_match"](spark, FOLDER).select("project_id", "target", "row_pos", "name", "ratio").collect()} == expected


def test_propagation_query(spark) -> None:
    """Dates by following the chain away from the anchor, first dates winning, without passes."""
    edges, start = defaultdict(list), {}
    for r in derived(spark, FOLDER, "orders", plant_queries._EDGES).collect():
        edges[r.project_id].append(r)
    for r in derived(spark, FOLDER, "orders", ["cast(floor(o_orderkey / 10) as bigint) AS project_id", "cast(o_orderdate as date) AS date"], "o_orderkey % 10 = 0").collect():
        start[r.project_id] = r.date
    found = defaultdict(dict)
    for r in _QUERIES["p3_propagate_dates"](spark, FOLDER).collect():
        found[r.project_id][r.activity] = r.date
    month = {name: k for k, name in enumerate(schedule.MONTHS, 1)}

    def weekday(d: dt.date) -> dt.date:
        while d.weekday() > 4:
            d += dt.timedelta(1)
        return d

    def day(words: str, year: int) -> dt.date:
        m = month[words.split()[-1].lower()]
        last = {2: 28, 4: 30, 6: 30, 9: 30, 11: 30}.get(m, 31)
        return dt.date(year, m, 15 if "middle" in words else last if "end" in words else 1)

    def moved(d: dt.date, weeks: int, year: int) -> dt.date:
        other = weekday(d + dt.timedelta(7 * weeks))
        for y in (year - 1, year, year + 1):
            for _, a, b, more in plant_queries._HOLIDAYS:
                if min(d, other) <= day(b, y) + dt.timedelta(7) and max(d, other) >= day(a, y):
                    return weekday(d + dt.timedelta(7 * (weeks + (more if weeks > 0 else -more))))
        return other

    assert set(found) == set(start)
    for project, first in start.items():
        dates = {"A5": weekday(first)}
        chain = {(e.from_activity, e.to_activity): e.weeks for e in edges[project]}
        for sign in (1, -1):
            k = 5
            while (f"A{min(k, k + sign)}", f"A{max(k, k + sign)}") in chain:
                dates[f"A{k + sign}"] = moved(dates[f"A{k}"], sign * chain[f"A{min(k, k + sign)}", f"A{max(k, k + sign)}"], dates["A5"].year)
                k += sign
        assert found[project] == dates, project


def test_batch_queries(spark) -> None:
    """Areas stay whole; every missing row follows the rules, one after another."""
    scope = derived(spark, FOLDER, "supplier", ["s_suppkey AS row_pos", *plant_queries._SCOPE]).toPandas()
    got = _QUERIES["p1_split_batches"](spark, FOLDER).toPandas()
    assert Counter(got["code"]) == Counter(scope["code"]) and set(got["batch"]) <= {1, 2, 3, 4}
    assert (got.groupby(["project_id", "working_area", "section"])["batch"].nunique() == 1).all()
    for _, own in got.groupby("project_id"):
        loads, heaviest = own.groupby("batch")["weight"].sum(), own.groupby("working_area")["weight"].sum().max()
        assert loads.max() <= own["weight"].sum() / 4 * 1.1 + heaviest
    detail = batching.split_batches(derived(spark, FOLDER, "supplier", plant_queries._SCOPE, "s_suppkey % 3 <> 0"), 4).toPandas()
    placed = {r.row_pos: (r.batch, r.reason) for r in _QUERIES["p2_integrate_missing"](spark, FOLDER).collect()}
    missing = scope[scope["row_pos"] % 3 == 0].sort_values("row_pos")
    for project, rows in missing.groupby("project_id"):
        own = detail[detail["project_id"] == project]
        weight = own.assign(weight=own["weight"].fillna(0.0)).groupby("batch")["weight"].sum().to_dict()
        area = own.groupby("working_area")["batch"].min().to_dict()
        sections = {s: set(b) for s, b in own.groupby("section")["batch"]}
        lightest = lambda among: min(among, key=lambda b: (round(weight[b], 6), b))  # noqa: E731,B023
        for r in rows.itertuples():
            near = sections.get(r.section, set())
            expected = (area[r.working_area], batching.BY_AREA) if r.working_area in area else (lightest(near), batching.BY_SECTION) if near else (lightest(weight), batching.BY_WEIGHT)
            assert placed[r.row_pos] == expected
            weight[expected[0]] += 0.0 if r.weight != r.weight else r.weight
            sections.setdefault(r.section, set()).add(expected[0])
    assert set(placed) == set(missing["row_pos"])


def test_price_summary_and_order_queries(spark) -> None:
    sheet = _QUERIES["g1_order_sheet"](spark, FOLDER).toPandas()
    places = [(t or "", (d or "").lower()) for t, d in zip(sheet["material_type"], sheet["description"], strict=True)]
    assert places == sorted(places)
    raw = bom_queries.raw(spark, FOLDER).toPandas()
    assert set(sheet["article_number"]) == set(raw["item_number"])
    whole = sheet[sheet["net_cut_length_m"].isna()]
    per = raw[raw["item_number"].isin(whole["article_number"])].groupby(["item_number", "coating"])["qty"].sum()
    assert (whole.groupby(["article_number", "coating"])["qty"].sum() == per.reindex(whole.groupby(["article_number", "coating"])["qty"].sum().index)).all()


@pytest.mark.parametrize("count", [1, 5, 1_000_000])
def test_many_equal_bars_are_one_run(count: int) -> None:
    runs = bom.bar_runs([(2000, count), (900, count), (100, count)], 6000)
    assert len(runs) <= 7 and sum(bars * sum(n for length, n in held if length == 900) for _, bars, held in runs) == count
