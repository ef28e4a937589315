"""Scenarios of the operators on tiny tables, and helpers against plain versions."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantlists.operators import batching, bom, compare, predicates, rules, schedule, search
from plantlists.sources import tables as sources
from plantlists.streaming import jobs

SHEET = "row_pos long, article long, coating string, qty long, text string"


def compared(spark, old: list, new: list) -> list:
    found = compare.compare_revision(spark.createDataFrame(old, SHEET), spark.createDataFrame(new, SHEET), ["article", "coating"], ["qty", "text"], "qty").collect()
    return sorted((r.article, r.coating or "", r.occ, r.status, r.changed, r.qty_change) for r in found)


def test_compare_scenarios(spark) -> None:
    assert compared(spark, [(1, 1, "A", 5, "x")], [(1, 1, "A", 5, "x")]) == [(1, "A", 1, "Unchanged", "", 0)]
    assert compared(spark, [], [(1, 1, "A", 5, "x")]) == [(1, "A", 1, "New Row", "", 5)]
    assert compared(spark, [(1, 1, "A", 5, "x")], []) == [(1, "A", 1, "Deleted Row", "", -5)]
    assert compared(spark, [(1, 1, "A", 5, "x")], [(1, 1, "A", 4, "x")]) == [(1, "A", 1, "Smaller", "qty", -1)]
    assert compared(spark, [(1, 1, "A", 5, None)], [(1, 1, "A", 7, "y")]) == [(1, "A", 1, "Added", "qty, text", 2)]
    assert compared(spark, [(1, 1, None, 5, "x"), (2, 1, "B", 5, "x")], [(1, 1, None, 5, "x")]) == [(1, "", 1, "Unchanged", "", 0), (1, "B", 1, "Deleted Row", "", -5)]
    # the k-th row of a key meets the k-th
    assert [r[3] for r in compared(spark, [(1, 1, "A", 5, "x"), (2, 1, "A", 6, "x")], [(3, 1, "A", 5, "x"), (4, 1, "A", 6, "x"), (5, 1, "A", 7, "x")])] == ["Unchanged", "Unchanged", "New Row"]


def test_compare_does_not_depend_on_partitions(spark) -> None:
    old = spark.range(200).selectExpr("id AS row_pos", "id % 7 AS article", "case when id % 3 = 0 then null else 'A' end AS coating", "id % 5 AS qty", "'x' AS text")
    new = old.withColumn("qty", F.col("qty") + F.col("article") % 2)
    a, b = (sorted(map(tuple, compare.compare_revision(old.repartition(n), new.repartition(n), ["article", "coating"], ["qty"], "qty").collect()), key=str) for n in (1, 7))
    assert a == b


def naive_bars(pieces: list[int], bar: int, kerf: int = 3) -> list[int]:
    bins = [bar]
    for p in sorted(pieces, reverse=True):
        need = min(p + kerf, bar)
        for k, rest in enumerate(bins):
            if rest >= need:
                bins[k] -= need
                break
        else:
            bins.append(bar - need)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 130), st.integers(1, 9), max_size=12))
def test_run_length_first_fit(runs: dict[int, int]) -> None:
    found = bom.first_fit(sorted(runs.items(), reverse=True), 120)
    assert [b[0] for b in found] == naive_bars([p for p, n in runs.items() for _ in range(n)], 120)


def test_packing_sample(spark) -> None:
    runs = [(2400, 1), (1800, 2), (900, 4), (450, 3), (125, 7)]
    assert len(bom.first_fit(runs, 5900)) == 3
    assert len(bom.first_fit(runs, 6000)) == 2
    rows = spark.createDataFrame([(k, 7, n, "Beam section MS 41", cut, 10.0, None, "HCP") for k, (cut, n) in enumerate(runs)], "row_pos long, item_number long, qty long, description string, cut_length_mm long, total_weight_kg double, remarks string, coating string")
    one = bom.packed_rows(bom.routed(rows), "beam").first()
    assert (one.order_qty, one.net_cut_length_m, one.remarks) == (3, 11.825, "6m bar")


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=14), st.text("abcé ", max_size=14))
def test_common_length(a: str, b: str) -> None:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert schedule.common_length(a, b) == table[-1][-1]


def test_pressure_categories(spark) -> None:
    rows = [("Steam", "1", 10.0, 400.0, "Category III"), ("Steam", "1", 0.5, 400.0, "See 5.3"), ("Air", "2", 100.0, 32.0, "Category 0"), ("Water", "1", 600.0, 50.0, "Category III"), ("Water", "2", 5.0, 1750.0, "Category 0"), (None, "1", 1.0, 1.0, "Invalid Data"), ("Gas", "3", 1.0, 50.0, "Not Categorized"), ("Gas", "1", -1.0, 5.0, "Invalid Data")]
    df = spark.createDataFrame(rows, "medium string, fluid_group string, ps double, dn double, expected string")
    assert all(r.category == r.expected for r in rules.categorise_by_rules(df).collect())


def test_boolean_queries(spark) -> None:
    df = spark.createDataFrame([("a test and a histogram",), ("test",), ("prehistoric history",)], "t string")
    hits = lambda q: [r[0] for r in df.select(search.boolean_match(F.col("t"), q)).collect()]
    assert hits("test AND histogram") == [True, False, False]
    assert hits("test OR histogram") == [True, True, False]
    assert hits("test AND NOT histogram") == [False, True, False]
    assert hits("hist*") == [True, False, True]
    assert hits("(test OR nothing) AND (histogram OR NOT test)") == [True, False, False]
    assert hits("test histogram") == [True, True, False]
    assert hits("TEST") == [True, True, False]
    assert hits("") == [False, False, False]


def test_propagation(spark) -> None:
    edges = spark.createDataFrame([(1, 1, "A", "B", 2, None), (1, 2, "B", "C", 1, "x"), (1, 3, "A", "C", 9, None)], "project_id long, row_pos long, from_activity string, to_activity string, weeks long, comments string")
    anchors = spark.createDataFrame([(1, "B", dt.date(2024, 1, 6))], "project_id long, activity string, date date")
    known = spark.createDataFrame([(1, x) for x in "ABC"], "project_id long, activity string")
    found = {r.activity: r for r in schedule.propagate_dates(edges, anchors, known).collect()}
    assert found["B"].date == dt.date(2024, 1, 8)  # a Saturday moves to Monday
    assert found["A"].date == dt.date(2023, 12, 25) and found["A"].reason == "2W before 'B'"
    assert found["C"].date == dt.date(2024, 1, 15) and found["C"].conflicts > 0
    shifted = schedule.propagate_dates(edges, anchors, known, [("middle of December", "end of December", 1)]).where("activity = 'A'").first()
    assert shifted.weeks == 3 and shifted.date == dt.date(2023, 12, 18)


def test_batches_keep_areas_and_balance(spark) -> None:
    rows = [(1, f"c{k}", f"UAA-{k % 12}", f"S{k % 3}", float(10 + k % 5)) for k in range(60)]
    found = batching.split_batches(spark.createDataFrame(rows, "project_id long, code string, working_area string, section string, weight double"), 4).collect()
    assert len(found) == 60
    assert all(len({r.batch for r in found if r.working_area == a}) == 1 for a in {r.working_area for r in found})
    assert {r.batch for r in found} == {1, 2, 3, 4}


def test_empty_tables(spark) -> None:
    empty = spark.createDataFrame([], SHEET)
    assert compare.compare_revision(empty, empty, ["article"], ["qty"], "qty").count() == 0
    assert predicates.drop_blank_rows(empty).count() == 0
    raw = spark.createDataFrame([], "row_pos long, item_number long, qty long, description string, cut_length_mm long, total_weight_kg double, remarks string, coating string")
    assert bom.order_sheet(raw).count() == 0


def test_columns_resolved() -> None:
    assert sources.resolve_columns(["Item No.", "Descripton", "DN 2", "Qty"], {"item": ["item no"], "description": ["description"], "dn": ["DN"], "qty": ["qty"]}) == {"item": "Item No.", "qty": "Qty", "description": "Descripton"}


def test_revisions_and_reports(spark, tmp_path) -> None:
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    path = str(tmp_path / "rev")
    sources.write_revision(df, path, "R1")
    sources.write_revision(df.union(df), path, "R2")
    sources.write_revision(df.union(df), path, "R1", "keep")
    assert {(r.revision, r["count"]) for r in spark.read.parquet(path).groupBy("revision").count().collect()} == {("R1", 1), ("R2", 2)}
    sources.write_revision(df.union(df).union(df), path, "R1", "replace")
    assert {(r.revision, r["count"]) for r in spark.read.parquet(path).groupBy("revision").count().collect()} == {("R1", 3), ("R2", 2)}
    sources.write_report({"one": df}, str(tmp_path / "report"), "csv")
    assert sources.read_table(spark, str(tmp_path / "report" / "one"), "id string, t string").first().id == "1"


def test_streams(spark, tmp_path) -> None:
    for k, rows in enumerate(([("G1 ", "first", 1), ("-", "no", 2)], [("g1", "second", 3), ("G2", "", 4)])):
        spark.createDataFrame(rows, "group_text string, comment string, seq long").coalesce(1).write.parquet(str(tmp_path / "changes" / str(k)))
    query = jobs.stream_replicate(spark, str(tmp_path / "changes" / "*"), "group_text string, comment string, seq long", str(tmp_path / "store"), str(tmp_path / "cp"))
    query.awaitTermination()
    latest = spark.read.parquet(str(tmp_path / "store")).groupBy("key").agg(F.max_by("comment", "seq").alias("comment"), F.max("seq").alias("seq"))
    target = spark.createDataFrame([(1, " G1", "old"), (2, "G2", "old"), (3, "G3", "old"), (4, "-", "old")], "id long, group_text string, comment string")
    assert {r.id: r.comment for r in jobs.replicated(target, latest).collect()} == {1: "second", 2: None, 3: "old", 4: "old"}
