"""What showed on larger copies of the tables only, on small rows."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import product

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantlists.operators import bom, compare, ranges, rules, spatial, welds
from plantlists.sources import tables


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_never_broadcast(spark) -> None:
    """d10: staged codes look small as compressed files, but their exploded beginnings went through the driver."""
    rows = [(k, f"1HTX01BR{k:03d}-{k}." if k % 3 else f"K{k}.", k % 4, float(k % 5), k % 2) for k in range(60)]
    base = spark.createDataFrame(rows, "row_pos long, code string, article long, qty double, cut_length long")
    comp = base.selectExpr("concat('/', code, '/SU1') AS code", "article", "qty", "cut_length")
    found = compare.hierarchical_match(base, comp)
    assert "BroadcastHashJoin" not in _plan(found)
    assert {r["level"] for r in found.collect()} <= {"EXACT", "MULTIPLE"}


def test_halves_round_as_in_sql(spark) -> None:
    """e14: weights whose third decimal is decided by a half; the first ones differed."""
    rows = [(2.0, 0.0, price / 100, 0.0, 3) for price in (10266.66, 10306.66, 10346.66, 10426.66, 10466.66, 10267.0)]
    found = rules.order_columns(spark.createDataFrame(rows, "qty_pcs double, qty_m double, weight_kg double, surface_m2 double, spare int"))
    expected = [duckdb.execute("SELECT floor(round(CAST(? AS DOUBLE) / ? * (? + 3), 3) + 0.3337)", [r[2], r[0], r[0]]).fetchone()[0] for r in rows]
    assert [r[0] for r in found.select(F.floor(F.col("weight_w_spare") + 0.3337)).collect()] == expected


def test_loads_meet_distinct_and_spread(spark) -> None:
    """d18: many equal loads of one DN; pairs that left the join were loads x components before."""
    loads = [(k, "guide", k % 3, float(k % 4), float(k % 5), float(k % 2), "xyz"[k % 3] if k % 7 else None) for k in range(300)] + [(0, "guide", 9, 1.0, 1.0, 1.0, "x")]
    allowed = [(pos, pos % 2, float(pos % 5), float(pos % 4), float(pos % 3), "guide", "X do not use" if pos % 6 == 0 else f"c{pos}") for pos in range(40)] + [(99, 2, 9.0, 9.0, 9.0, "guide", "DO NOT USE"), (98, 1, None, 4.0, 4.0, "guide", "c98")]
    left = spark.createDataFrame(loads, "id long, support_type string, dn int, qx double, qy double, qz double, axis string")
    found = rules.select_component(left, spark.createDataFrame(allowed, "pos long, dn int, fax double, flat double, fz double, support_type string, component string"))
    assert "BroadcastNestedLoopJoin" not in _plan(found) and _plan(found).count("block") > 0
    expected = {}
    for k, _, dn, x, y, z, axis in loads:
        own = [c for c in allowed if c[1] == dn]
        a, b, v = {"x": (x, y, z), "y": (y, x, z), "z": (z, max(x, y), 0.0), None: (None, None, None)}[axis]
        fit = [(c[2] + c[3] + c[4], c[0], c[6]) for c in own if "DO NOT" not in c[6].upper() and a is not None and None not in c and c[2] >= a and c[3] >= b and c[4] >= v]
        was = expected.setdefault(k, [[], 0, 0])
        was[0] += fit
        was[1] += len(own)
        was[2] += sum("DO NOT" not in c[6].upper() for c in own)
    told = {k: (min(fit)[2], None) if fit else (None, "DN not found" if n == 0 else "DO NOT USE" if u == 0 else "no capacity") for k, (fit, n, u) in expected.items()}
    assert {r["id"]: (r["component"], r["miss"]) for r in found.collect()} == told


def test_few_copies_of_points(spark) -> None:
    """d19: every copy of a point crosses the exchange; there were 3.4 of them in each grid."""
    points = spark.range(4000).selectExpr("cast(id * 37 % 1009 as double) AS x", "cast(id * 91 % 1013 as double) AS y", "cast(id * 53 % 1019 as double) AS z")
    axes = [(c, 5.0) for c in "xyz"]
    copies = points.select(F.size(spatial._cells(0, axes, True)).alias("n"))
    assert copies.agg(F.avg("n")).first()[0] < 2.1
    assert points.select(F.size(spatial._cells(0, axes, False)).alias("n")).agg(F.max("n")).first()[0] == 1


def _sorts(spark, monkeypatch, run) -> list[str]:  # noqa: ANN001
    """Sort lines of the plans that ranges writes while run() works."""
    plans, write = [], ranges.staged
    monkeypatch.setattr(ranges, "staged", lambda df, name: plans.append(_plan(df)) or write(df, name))
    run()
    return [line for plan in plans for line in plan.splitlines() if "Sort [" in line]


def test_price_order_sorts_by_columns(spark, monkeypatch) -> None:
    """g1_price_order: a sort works its expressions out at every comparison."""
    rows = spark.range(20).selectExpr("id AS row_pos", "if(id % 2 = 0, '02 SS shop', 'paint other') AS material_type", "'m' AS material", "'t' AS type", "concat(' ', id % 7, ',5') AS size")
    found = []
    sorts = _sorts(spark, monkeypatch, lambda: found.extend(bom.price_order(rows).orderBy("place").collect()))
    assert sorts and not any("CASE" in line for line in sorts)
    assert [r["row_pos"] for r in found] == sorted(range(20), key=lambda k: (k % 2, k % 7, k)) and set(found[0].asDict()) == {*rows.columns, "place"}


def test_uids_sort_by_columns(spark, monkeypatch) -> None:
    """f3_assign_uids: the same sort with groups."""
    rows = spark.range(20).selectExpr("id AS row_pos", "if(id % 2 = 0, '02 SS shop', '03 CS shop') AS material_type", "'m' AS material", "'t' AS type", "concat('DN', id % 7) AS size")
    found = []
    sorts = _sorts(spark, monkeypatch, lambda: found.extend(rules.assign_uids(rows).collect()))
    assert sorts and not any("lower" in line for line in sorts)
    assert sorted(r["uid"] for r in found) == sorted(f"{n}-{k:03d}" for n in ("02-SS", "03-CS") for k in range(1, 11))


def test_bars_are_made_outside_python(spark) -> None:
    """e5_cut_plan: Python held a row for each length of each bar of a batch of groups."""
    pieces = spark.createDataFrame([(1, "a", 2000, "rod", 1500, 3, 1.0, 5), (1, "a", 2000, "rod", 450, 100_000, 2.0, 6), (2, None, 2000, "rod", 2500, 2, None, 7), (3, "b", 2000, "rod", 10, 0, 0.0, 8)], "item_number long, coating string, bar_mm long, label string, cut_mm long, n long, w double, p long")
    found = bom.cut_plan(pieces)
    assert 0 <= _plan(found).find("Generate") < _plan(found).find("MapInArrow")
    expected = [(i, c, k, length, n, 2000 - rest, rest, length > 2000) for i, c, runs in ((1, "a", [(1500, 3), (450, 100_000)]), (2, None, [(2500, 2)])) for k, (rest, held) in enumerate(bom.first_fit(runs, 2000), 1) for length, n in held]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert {r["item_number"]: r["n_bars"] for r in bom.pack_bars(pieces).collect()} == {1: len(bom.first_fit([(1500, 3), (450, 100_000)], 2000)), 2: 2, 3: 0}


def test_attribute_lines_are_split_once(spark) -> None:
    """a3_attribute_rows: the split stood in the plan once for each use of the cells."""
    lines = ["a;A;1;B;2;A;3", "b", "c;;1;X;", "d;A", "e;K;1;K;2;K;", "f;A;1;B", ";A;x", ""]
    rows = tables.attribute_rows(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string"))
    plan = _plan(rows)
    assert plan.count("split(") == 1
    assert {r["id"]: r["attributes"] for r in rows.collect()} == {"a": {"A": "3", "B": "2"}, "b": {}, "c": {"X": ""}, "d": {}, "e": {"K": ""}, "f": {"A": "1"}, "": {"A": "x"}}


def test_lines_of_a_class_spread(spark, monkeypatch) -> None:
    """d11: all lines of a class were one task's; a long list deals them into blocks, with the same result."""
    lines = spark.range(40).selectExpr("'Water' AS medium", "'9' AS ps", "'5' AS ts", "concat('DN ', id) AS dn", "'PN16' AS pn", "'m' AS material", "if(id % 9 = 0, null, concat('A', id % 3)) AS pipe_class", "concat('s', id % 2) AS process_section")
    classes = spark.createDataFrame([("A1", "Water", 16.0, 0.0, 80.0, 15.0, 300.0, "m"), ("A2", "Gas", 25.0, -10.0, 50.0, 15.0, 100.0, "m"), ("A2", "Oil", 25.0, -10.0, 50.0, 15.0, 100.0, "m")], "pipe_class string, medium string, pn double, t_min double, t_max double, dn_from double, dn_to double, material string")
    short = rules.check_line_list(lines, classes)
    assert "BroadcastHashJoin" in _plan(short)
    sections = rules.process_section_summary(lines, classes)
    told, summed = sorted(map(str, short.collect())), sorted(map(str, sections.collect()))
    monkeypatch.setattr(rules, "FEW_CLASSES", 1)
    dealt = rules.check_line_list(lines, classes)
    assert "_block" in _plan(dealt)
    assert sorted(map(str, dealt.collect())) == told and len(told) == 40 + sum(k % 3 == 2 and k % 9 != 0 for k in range(40))
    assert sorted(map(str, rules.process_section_summary(lines, classes).collect())) == summed


def test_sheet_routes_rows_once(spark) -> None:
    """g1_order_sheet, e8_price_summary, v1_validate_order_sheet: each of six routes classified all rows again."""
    rows = spark.range(64).selectExpr("id AS row_pos", "id % 8 AS item_number", "3L AS qty", "elt(1 + id % 4, 'Hex nut M10', 'Bracket WBD', 'Beam section MS 41', 'Threaded rod M10/2000') AS description", "if(id % 4 > 1, 400L, null) AS cut_length_mm", "1.5D AS total_weight_kg", "cast(null as string) AS remarks", "'HCP' AS coating")
    sheet = bom.order_sheet(rows)
    assert "washer" not in _plan(sheet)  # a keyword of the classification, which the staged rows have behind them
    assert sheet.count() == 8


@pytest.mark.parametrize(("coarse", "crowd"), [(32.0, 131_072), (3.0, 131_072), (3.0, 25)])
def test_own_pairs(spark, monkeypatch, coarse: float, crowd: int) -> None:
    """d19: left and right points of one table, also in crowded cells and at odd places, against all pairs."""
    monkeypatch.setattr(spatial, "COARSE", coarse)
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rng = random.Random(int(coarse) + crowd)
    near = lambda: tuple(round(rng.choice([rng.uniform(-40, 40), rng.gauss(3, 1), 5.0, -5.0]), 2) for _ in range(4))
    odd = [(None, 1.0, 5.0, 5.0), (5.0, 5.0, float("nan"), 1.0), (float("inf"), 0.0, float("inf"), 0.0), (1e18, 2.0, 1e18, 2.0), (-1e18, 2.0, 1.0, None)]
    rows = [(k, f"n{k}", *p) for k, p in enumerate([near() for _ in range(150)] + odd)]
    df = spark.createDataFrame(rows, "i long, name string, x double, y double, u double, v double")
    boxes = {"wide": [("x", "u", 2.0), ("y", "v", 10.0)], "flat": [("y", "v", 1.0), ("x", "u", 6.0)]}
    found = spatial.own_pairs(df, boxes)
    assert ("Broadcast" in _plan(found)) == (crowd < 100)
    told = Counter((r.box, r.a_i, r.a_name, r.b_i, r.b_name) for r in found.collect())
    close = lambda p, q, t: p is not None and q is not None and abs(p - q) <= t
    pairs = [("wide", a, b) for a, b in product(rows, rows) if close(a[2], b[4], 2.0) and close(a[3], b[5], 10.0)]
    pairs += [("flat", a, b) for a, b in product(rows, rows) if close(a[2], b[4], 6.0) and close(a[3], b[5], 1.0)]
    assert told == Counter((box, a[0], a[1], b[0], b[1]) for box, a, b in pairs) and len(told) > 500
    assert spatial.own_pairs(df.limit(0), boxes).count() == 0


def test_cells_stay_whole(monkeypatch) -> None:
    """d19: tasks take some whole cells at a time and test a bounded number of candidates at a time."""
    monkeypatch.setattr(spatial, "BATCH_ROWS", 7)
    cells = sorted(random.Random(3).choices(range(12), k=60) + [4] * 30)
    batches = [pa.RecordBatch.from_pydict({"_cell": cells[k : k + 5]}) for k in range(0, 90, 5)]
    tables = [t.column("_cell").to_pylist() for t in spatial._whole_cells(iter(batches))]
    assert sum(tables, []) == cells and len(tables) > 3
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False))
    monkeypatch.setattr(spatial, "CANDIDATES", 11)
    rng = random.Random(4)
    rows = {c: [float(rng.randrange(30)) for _ in range(40)] for c in "xyuv"} | {"_cell": [0] * 40, "_right": [True] * 40}
    met = list(spatial._met(pa.table(rows), [("b", [("x", "u", 2.0, 0), ("y", "v", 3.0, 1)])], [(96.0, 0.0, 1), (96.0, 0.0, 1)]))
    assert sorted((int(i), int(j)) for _, a, b in met for i, j in zip(a, b, strict=True)) == [(i, j) for i in range(40) for j in range(40) if abs(rows["x"][i] - rows["u"][j]) <= 2 and abs(rows["y"][i] - rows["v"][j]) <= 3]
    assert len(met) > 1 and all(len(a) <= 7 for _, a, _ in met)


@pytest.mark.parametrize(("repeated", "few"), [(False, 100_000), (True, 100_000), (True, 0)])
def test_ends_cross_one_exchange(spark, monkeypatch, repeated: bool, few: int) -> None:
    """d19: ends were copied to three grids, with the pairs sent round once more; 6 GB ran out of disk."""
    monkeypatch.setattr(welds, "FEW_NAMES", few)
    rng = random.Random(repeated)
    at = lambda: [float(rng.choice([rng.randrange(60), rng.randrange(300)])) for _ in range(6)]
    rows = [(f"b{k % 70 if repeated and k > 90 else k}", *at(), rng.choice(["BWD", "OPEN", None]), rng.choice(["BWD", "OPEN"]), k * 37 % 241) for k in range(220)]
    df = spark.createDataFrame(rows, "branch string, hx double, hy double, hz double, tx double, ty double, tz double, hcon string, tcon string, line_no long")
    out = welds.connect_branches(df, 9.0)
    plan = _plan(out)
    assert repeated or (plan.count("Exchange") == 1 and "Window" not in plan)
    best: dict = {}
    for a, b in product(rows, rows):
        d = [abs(t - h) for t, h in zip(a[4:7], b[1:4], strict=True)]
        kind = next((n for n, p, q, r in (("XY_tight_Z_loose", 0, 1, 2), ("XZ_tight_Y_loose", 0, 2, 1), ("YZ_tight_X_loose", 1, 2, 0)) if d[p] <= 9 and d[q] <= 9 and d[r] <= 150), None)
        if a[0] != b[0] and kind and "BWD" in (a[8], b[7]):
            tight = max(d[k] for k, axis in enumerate("XYZ") if f"{axis}_tight" in kind or f"{axis}Y_tight" in kind or f"{axis}Z_tight" in kind)
            best.setdefault(frozenset((a[0], b[0])), []).append((a[9], b[9], a[0], b[0], kind, tight, round(math.hypot(*d), 3)))
    told = [(r.a, r.b, r.match_type, r.tight_offset, r.distance) for r in out.collect()]
    assert sorted(told) == sorted(min(found)[2:] for found in best.values()) and len(told) > 100
    assert any(len(found) > 1 for found in best.values())


def test_weights_do_not_depend_on_order(spark) -> None:
    """e4_pack_bars: weights whose sum and 0.3337 are a whole number; a sum of doubles lies above or below it as rows come."""
    rng = random.Random(5)
    rows, expected = [], {}
    for k in range(120):
        cents = [rng.randrange(90_000, 10_500_000) for _ in range(rng.randrange(4, 20))]
        cents.append((66_630 - sum(cents)) % 100_000 + 100_000 * rng.randrange(1, 100))
        rng.shuffle(cents)
        rows += [(len(rows) + i, k, 1, 500 + i % 3, c / 100 / 1000) for i, c in enumerate(cents)] + [(1_000_000 + k, k, 1, 500, None)]
        expected[k] = (sum(cents) + 33_370) // 100_000
    rows += [(2_000_000, 900, 1, 500, None), (2_000_001, 901, 1, 500, 1e300), (2_000_002, 901, 1, 500, 1e300), (2_000_003, 902, 1, 500, float("nan"))]
    df = spark.createDataFrame(rows, "row_pos long, item_number long, qty long, cut_length_mm long, total_weight_kg double").selectExpr("*", "'beam' AS route", "'m' AS clean", "'m' AS description", "'HCP' AS coating")
    packed = {r["item_number"]: r["weight"] for r in bom.pack_bars(bom.pieces_of(df, "beam")).collect()}
    assert packed.pop(900) is None and packed.pop(901) == 2e300 and math.isnan(packed.pop(902))
    assert {k: math.floor(w + 0.3337) for k, w in packed.items()} == expected
