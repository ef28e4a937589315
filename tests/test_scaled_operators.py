"""Operators that spread hot groups over tasks, against plain Python: ranges, boxes, codes in codes, page search, keywords, propagation."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from plantlists.operators import batching, compare, fuzzy, layout, propagation, ranges, schedule, search, spatial, welds
from plantlists.streaming import jobs


@pytest.fixture
def many_partitions(spark):  # noqa: ANN201
    """Small tables keep their partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_numbered_and_filled(spark, many_partitions) -> None:
    rng = random.Random(1)
    rows = [(k, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, None, None, k]), float(rng.randrange(50))) for k in range(3000)]
    df = spark.createDataFrame(rows, "row_pos long, g string, v long, x double").repartition(7)
    order = [F.desc("x"), F.col("row_pos")]
    numbers = {r.row_pos: r.n for r in ranges.numbered(df, order, "n", ["g"]).collect()}
    whole = {r.row_pos: r.n for r in ranges.numbered(df, order, "n").collect()}
    fills = {r.row_pos: r.f for r in ranges.filled(df, {"f": F.col("v")}, order, ["g"]).collect()}
    sorted_rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    count, last = Counter(), {}
    for k, (pos, g, v, _) in enumerate(sorted_rows, 1):
        count[g] += 1
        last[g] = v if v is not None else last.get(g)
        assert (numbers[pos], whole[pos], fills[pos]) == (count[g], k, last[g])
    # the hot group lies in several ranges
    laid = ranges._laid_out(df, ["g"], order)
    per = laid.where("g = 'hot'").groupBy("_range").count().collect()
    assert len(per) > 1 and ranges.numbered(df.limit(0), order, "n", ["g"]).count() == 0


@pytest.mark.parametrize("dense", [4096, 5])
def test_box_pairs(spark, monkeypatch, dense: int) -> None:
    monkeypatch.setattr(spatial, "DENSE", dense)
    rng = random.Random(dense)
    near = lambda: tuple(round(rng.choice([rng.uniform(-40, 40), rng.gauss(3, 1), 5.0, -5.0]), 2) for _ in range(2))
    left, right = [(k, *near()) for k in range(150)] + [(900, None, 1.0)], [(k, *near()) for k in range(150)] + [(901, float("nan"), 2.0)]
    left += left[:3]
    a, b = spark.createDataFrame(left, "i long, x double, y double"), spark.createDataFrame(right, "j long, u double, v double")
    boxes = {"wide": [("x", "u", 2.0), ("y", "v", 10.0)], "one axis": [("x", "u", 1.0)]}
    found = Counter((r.box, r.i, r.j) for r in spatial.box_pairs(a, b, boxes).collect())
    expected: Counter = Counter()
    for (i, x, y), (j, u, v) in product(left, right):
        if x is not None and abs(x - u) <= 1.0:
            expected["one axis", i, j] += 1
        if x is not None and abs(x - u) <= 2.0 and abs(y - v) <= 10.0:
            expected["wide", i, j] += 1
    assert found == expected and len(found) > 500


def test_connections_neither_broadcast_nor_lost(spark) -> None:
    rows = [("a", 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, "BWD", "BWD", 1), ("b", 14.9, 4.0, 149.0, 900.0, 0.0, 0.0, "OPEN", "OPEN", 2), ("c", 10.0, 5.0, -150.0, 5.0, 5.0, 5.0, "OPEN", "BWD", 3), ("d", None, None, None, 0.0, 0.0, 0.0, None, "OPEN", 4)]
    df = spark.createDataFrame(rows, "branch string, hx double, hy double, hz double, tx double, ty double, tz double, hcon string, tcon string, line_no long")
    out = welds.connect_branches(df)
    assert {(r.a, r.b, r.match_type) for r in out.collect()} == {("a", "b", "XY_tight_Z_loose"), ("a", "c", "XY_tight_Z_loose"), ("d", "a", "XY_tight_Z_loose")}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_codes_with_several_cores(spark) -> None:
    core = "1HTX01BR"
    base = [(1, f"{core}002", 1, 1, 1), (2, f"x{core}001 {core}002y", 1, 1, 1), (3, "2HTX01BR003", 1, 1, None), (4, None, 1, 1, 1), (5, "K7", 1, 1, 1), (6, f"{core}009", None, 1, 1), (7, "longer K7", 2, 5, 1)]
    comp = [(f"{core}001 {core}002", 1, 1, 1), ("1HTX01BR0012HTX01BR003/SU", 1, 1, None), (f"{core}002HTX01BR003", 1, 1, 3), ("K7", 2, 5, 1), ("K7", 2, 5, 1), (f"{core}009", None, 1, 1), (None, 1, 1, 1)]
    kind = "code string, article int, qty int, cut_length int"
    found = {r.row_pos: r.level for r in compare.hierarchical_match(spark.createDataFrame(base, f"row_pos long, {kind}"), spark.createDataFrame(comp, kind)).collect()}

    def level(code: str | None, *cells: int | None) -> str:
        met = [c for c in comp if code is not None and c[0] is not None and (code in c[0] or c[0] in code)]
        steps = [met, *([c for c in met if all(cells[k] is not None and c[1 + k] == cells[k] for k in range(n))] for n in (1, 2))]
        steps.append([c for c in steps[2] if c[3] == cells[2]])
        names = ("NO_KKS_MATCH", "ARTICLE_MISMATCH", "QTY_MISMATCH", "CUT_LENGTH_MISMATCH")
        return next((n for n, s in zip(names, steps, strict=True) if not s), "EXACT" if len(steps[3]) == 1 else "MULTIPLE")

    assert found == {k: level(*rest) for k, *rest in base}


def test_code_containment(spark) -> None:
    rng = random.Random(8)
    part = lambda: rng.choice(["1ABC12DE345", "5XYZ00AA111", "1ABC12DE3451ABC12DE345", "/", "-x", "S" * 20, "\n"])
    codes = sorted({"".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(120)})
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    core = r"(\d[A-Z]{3}\d{2}[A-Z]{2}\d{3})"
    found = {(r.needle, r.text) for r in compare.codes_in_codes(df.select(F.col("code").alias("needle")), df.select(F.col("code").alias("text")), core).collect()}
    assert found == {(a, b) for a in codes for b in codes if re.search(core, a) and a in b}


def test_page_search_reads_queries_as_documents_do(spark) -> None:
    """C9 chooses a document if and only if C5 holds on its whole text, for all short queries."""
    pages = [("d1", 1, "alpha"), ("d1", 2, "beta"), ("d2", 1, "alpha gamma"), ("d3", 1, "gamma"), ("d4", 1, None)]
    df = spark.createDataFrame(pages, "doc string, page int, text string").cache()
    whole = df.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")).cache()
    rng = random.Random(3)
    tokens = ["alpha", "beta", "AND", "OR", "NOT", "(", ")"]
    queries = [" ".join(q) for n in (0, 1, 2) for q in product(tokens, repeat=n)] + [" ".join(rng.choice(tokens) for _ in range(rng.randrange(3, 6))) for _ in range(150)]
    texts = [F.struct(F.lit(k).alias("k"), search.boolean_match(F.col("text"), q).alias("hit")) for k, q in enumerate(queries)]
    holds = {(r.k, r.doc) for r in whole.select("doc", F.inline(F.array(*texts))).where("hit").collect()}
    flags = {t: F.coalesce(F.bool_or(search._term(F.col("text"), t, False)), F.lit(False)).alias(f"h{k}") for k, t in enumerate(tokens)}
    over = [F.struct(F.lit(k).alias("k"), search._over_terms(q, lambda t: F.col(f"h{tokens.index(t)}")).alias("hit")) for k, q in enumerate(queries)]
    assert {(r.k, r.doc) for r in df.groupBy("doc").agg(*flags.values()).select("doc", F.inline(F.array(*over))).where("hit").collect()} == holds
    for q in ("alpha (beta)", "(alpha) (beta)", "", "alpha AND", "NOT", "gamma OR beta"):
        k = queries.index(q) if q in queries else None
        docs = {r.doc for r in search.search_pages(df, q).collect()}
        expected = {d for j, d in holds if j == k} if k is not None else {r.doc for r in whole.where(search.boolean_match(F.col("text"), q)).collect()}
        assert docs == {d for d in expected if any(x == d and re.search(rf"\b({'|'.join(search.query_terms(q)) or '$.'})\b", t or "") for x, _, t in pages)}, q


@pytest.mark.parametrize("most", [16_000_000, 40])
def test_many_keywords(spark, most: int) -> None:
    rng = random.Random(most)
    keywords = [("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 5))), rng.choice(["x", "y", None])) for _ in range(40)] + [("", "x"), (None, "x"), ("aa", "x"), ("aa", "z")]
    pages = [(f"d{k % 4}", k, "".join(rng.choice("aAbB \n") for _ in range(rng.randrange(60)))) for k in range(30)] + [("d9", 1, None), ("d9", 2, ""), ("d9", 3, "aa")]
    found = Counter(map(tuple, search.screen_keywords(spark.createDataFrame(pages, "doc string, page int, text string"), spark.createDataFrame(keywords, "keyword string, category string"), 2, most).collect()))
    expected: Counter = Counter()
    for doc, page, text in pages:
        tokens = re.findall(r"\S+", text or "")
        for keyword, category in keywords:
            for m in re.finditer(re.escape(keyword), (text or "").lower()) if keyword else ():
                before = len(re.findall(r"\S+", text[: m.start() + 1]))
                expected[doc, page, keyword, category, m.start(), " ".join(tokens[max(before - 2, 1) - 1 : before + 2])] += 1
    assert found == expected
    lists = search.page_keywords(spark.createDataFrame([("d", 1, "b"), ("d", 1, "a"), ("d", 1, "b")], "doc string, page int, keyword string")).first()
    assert lists.keywords == ["a", "b"]


def by_passes(edges: list[tuple], anchor: str, start: dt.date, known: set[str], holidays: list[tuple]) -> tuple[dict, Counter]:
    """Dates and conflicts of one project, pass after pass."""

    def weekday(d: dt.date) -> dt.date:
        return d + dt.timedelta({5: 2, 6: 1}.get(d.weekday(), 0))

    start = weekday(start)
    periods = [(dt.date(start.year + y, *propagation._day_of(a)), dt.date(start.year + y, *propagation._day_of(b)), n) for y in (-1, 0, 1) for a, b, n in holidays]
    dates, conflicts = {anchor: start}, Counter()
    for _ in range(100):
        progress = False
        for _, a, b, weeks, _ in sorted(edges, key=lambda e: (e[0], e[1], e[2], e[3])):
            for source, target, sign in ((b, a, -1), (a, b, 1)):
                if source in dates and target in known:
                    other = weekday(dates[source] + dt.timedelta(weeks=sign * weeks))
                    low, high = sorted((dates[source], other))
                    hit = next((n for begin, until, n in periods if low <= until + dt.timedelta(7) and high >= begin), None)
                    day = other if hit is None else weekday(dates[source] + dt.timedelta(weeks=sign * (weeks + hit)))
                    if target not in dates:
                        dates[target], progress = day, True
                    elif dates[target] != day:
                        conflicts[target, source, day] += 1
        if not progress:
            break
    return dates, conflicts


def test_propagation_by_passes(spark) -> None:
    rng = random.Random(11)
    holidays = [("middle of July", "end of August", 2), ("December", "end of December", 1), ("nothing", "May", 3)]
    edges, anchors, known = [], [], []
    for p in range(25):
        n = rng.randrange(2, 12)
        for pos in range(rng.randrange(1, 25)):
            edges.append((p, rng.randrange(8) if p % 3 else pos, f"A{rng.randrange(n)}", f"A{rng.randrange(n)}", rng.choice([0, 1, 3, 9, None]), rng.choice([None, " ", "note"])))
        anchors.append((p, "A0", dt.date(2024, rng.randrange(1, 13), rng.randrange(1, 28))))
        known += [(p, f"A{k}") for k in range(n) if rng.random() < 0.9] + [(p, "A0")] * 2
    kind = "project_id long, row_pos long, from_activity string, to_activity string, weeks long, comments string"
    dates, conflicts = schedule.propagation(spark.createDataFrame(edges, kind), spark.createDataFrame(anchors, "project_id long, activity string, date date"), spark.createDataFrame(known, "project_id long, activity string"), holidays)
    found, clashes = defaultdict(dict), defaultdict(Counter)
    for r in dates.collect():
        found[r.project_id][r.activity] = r.date
    for r in conflicts.collect():
        clashes[r.project_id][r.activity, r.reference, r.other_date] += r.times
    valid = [h for h in holidays if propagation._day_of(h[0])]
    for p, anchor, start in anchors:
        own = [e[1:] for e in edges if e[0] == p and e[4] is not None]
        expected = by_passes([e for e in own], anchor, start, {a for q, a in known if q == p}, valid)
        assert (found[p], clashes[p]) == expected, p
    assert sum(len(c) for c in clashes.values()) > 20


def test_one_project_of_many_dependencies(spark) -> None:
    edges = spark.range(200_000).selectExpr("1L AS project_id", "id AS row_pos", "concat('A', cast(id div 40 as string)) AS from_activity", "concat('A', cast(id + 1 as string)) AS to_activity", "1 + id % 5 AS weeks", "cast(null as string) AS comments")
    known = edges.selectExpr("project_id", "to_activity AS activity").union(edges.selectExpr("project_id", "from_activity"))
    anchors = spark.createDataFrame([(1, "A0", dt.date(2024, 5, 1))], "project_id long, activity string, date date")
    assert schedule.propagate_dates(edges, anchors, known).count() == 200_001


def test_rounds_of_propagation(spark, monkeypatch) -> None:
    """A round shuffles offers only, not the ways or the dates so far, and no step works a holiday's dates out more than once a row."""
    plans = []

    def recorded(write):  # noqa: ANN001, ANN202
        def run(df, name, *more):  # noqa: ANN001, ANN002, ANN202
            query = df._jdf.queryExecution()
            plans.append((name, query.optimizedPlan().toString().count("make_date"), query.executedPlan().toString().count("Exchange ")))
            return write(df, name, *more)

        return run

    for write in ("staged", "staged_buckets"):
        if hasattr(propagation, write):
            monkeypatch.setattr(propagation, write, recorded(getattr(propagation, write)))
    edges = spark.range(200).selectExpr("id div 10 AS project_id", "id AS row_pos", "concat('A', cast(id % 10 as string)) AS from_activity", "concat('A', cast(id % 10 + 1 as string)) AS to_activity", "3 + id % 5 AS weeks", "'c' AS comments")
    known = edges.selectExpr("project_id", "to_activity AS activity").union(edges.selectExpr("project_id", "from_activity"))
    anchors = edges.where("row_pos % 10 = 0").selectExpr("project_id", "'A5' AS activity", "date_add(date '2024-04-01', cast(project_id * 17 as int)) AS date")
    holidays = [("middle of July", "end of August", 2), ("December", "end of December", 1)]
    dates, conflicts = schedule.propagation(edges, anchors, known, holidays)
    rounds = [p for p in plans if p[0] == "dated"]
    assert len(rounds) >= 5 and all(shuffles <= 1 for _, _, shuffles in rounds)
    assert max(made for _, made, _ in plans) == 2 * 3 * len(holidays)
    rows, starts = edges.collect(), {r.project_id: r.date for r in anchors.collect()}
    found, clashes = defaultdict(dict), defaultdict(Counter)
    for r in dates.collect():
        found[r.project_id][r.activity] = r.date
    for r in conflicts.collect():
        clashes[r.project_id][r.activity, r.reference, r.other_date] += r.times
    for p, start in starts.items():
        own = [tuple(r)[1:] for r in rows if r.project_id == p]
        assert (found[p], clashes[p]) == by_passes(own, "A5", start, {f"A{k}" for k in range(11)}, holidays)


def test_rows_of_propagation(spark, monkeypatch) -> None:
    """Activities that may be dated are hashed, not sorted; a round offers nothing to whence a date came; only rows that give a date or come to another are written."""
    plans, offers, written = {}, [], {}

    def recorded(write):  # noqa: ANN001, ANN202
        def run(df, name, *more):  # noqa: ANN001, ANN002, ANN202
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            out = write(df, name, *more)
            if name == "fired":
                written[name] = out.count()
            return out

        return run

    for write in ("staged", "staged_buckets"):
        monkeypatch.setattr(propagation, write, recorded(getattr(propagation, write)))
    shifted = propagation._shifted
    monkeypatch.setattr(propagation, "_shifted", lambda rows, holidays: (offers.append(rows), shifted(rows, holidays))[1])
    edges = spark.range(200).selectExpr("id div 10 AS project_id", "id AS row_pos", "concat('A', cast(id % 10 as string)) AS from_activity", "concat('A', cast(id % 10 + 1 as string)) AS to_activity", "3 + id % 5 AS weeks", "'c' AS comments")
    known = edges.selectExpr("project_id", "to_activity AS activity").union(edges.selectExpr("project_id", "from_activity"))  # repeats
    anchors = edges.where("row_pos % 10 = 0").selectExpr("project_id", "'A5' AS activity", "date_add(date '2024-04-01', cast(project_id * 17 as int)) AS date")
    dates, conflicts = schedule.propagation(edges, anchors, known, [("middle of July", "end of August", 2)])
    assert dates.count() == 20 * 11 and conflicts.count() > 0
    assert "SortMergeJoin" not in plans["ways"] and "ShuffledHashJoin" in plans["ways"]
    assert [rows.count() for rows in offers[:-1]] == [20 * 2] * 5 + [0]
    assert written["fired"] < 20 * 10 * 2 and written["fired"] == 20 * 10 + conflicts.count()


def test_later_anchor(spark) -> None:
    rows = [(1, "S", dt.date(2024, 1, 2)), (1, "H", dt.date(2024, 1, 2)), (2, "T", dt.date(2024, 3, 1)), (2, "S", None), (2, "H2", dt.date(2024, 4, 1)), (2, "H", dt.date(2024, 1, 1)), (3, "H2", dt.date(2024, 5, 1)), (4, "other", dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "project_id long, activity string, date date")
    found = {r.project_id: (r.date, r.reason) for r in propagation.later_anchor(df, ["S", "T"], ["H", "H2"], names=("Pipes", "Hangers")).collect()}
    assert found == {
        1: (dt.date(2024, 1, 2), "Anchor = Pipes S [02/01/2024] (later than Hangers H [02/01/2024])"), 2: (dt.date(2024, 3, 1), "Anchor = Pipes T [01/03/2024] (later than Hangers H [01/01/2024])"), 3: (dt.date(2024, 5, 1), "Anchor = Hangers H2 [01/05/2024] (only date)"),
    }


def ratio(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return float(round(200 * row[-1] / (len(a) + len(b)))) if a or b else 100.0


@pytest.mark.parametrize("threshold", [30, 70, 90, 97])
def test_fuzzy_candidates(spark, threshold: int) -> None:
    """All pairs that reach the threshold, from short texts on."""
    rng = random.Random(threshold)
    word = lambda: rng.choice(["pipe", "Pipes", "valve", "lot", "x", "ab", "é", "hanger (S)", "hanger (T)"])
    name = lambda: " ".join(word() for _ in range(rng.randrange(0, 6)))
    names, targets = [(k % 2, k, name()) for k in range(150)] + [(0, 900, None)], [(k % 2, name()) for k in range(40)] + [(3, "alone")]
    found = Counter((r.project_id, r.target, r.row_pos, r.ratio) for r in schedule.fuzzy_candidates(spark.createDataFrame(targets, "project_id long, target string"), spark.createDataFrame(names, "project_id long, row_pos long, name string"), threshold).collect())
    assert found == Counter((p, t, k, ratio(t, n or "")) for p, t in set(targets) for q, k, n in names if p == q and ratio(t, n or "") >= threshold)
    pairs = fuzzy.candidate_pairs(spark.createDataFrame([(0, t) for _, t in targets], "project_id long, text string"), spark.createDataFrame([(0, n) for _, _, n in names], "project_id long, text string"), threshold).count()
    everything = len({t for _, t in targets}) * len({n for _, _, n in names})
    assert pairs < everything * (0.3 if threshold >= 90 else 1.01)


def test_suffixes_are_repaired(spark) -> None:
    targets = [(1, "Lot Pipe DTS (S)"), (1, "Lot Hanger DTS (T)"), (1, "Lot Valve DTS (S)")]
    names = [(1, 1, "Lot Pipe DTS (T)"), (1, 2, "Lot Pipes for DTS (S)"), (1, 3, "Lot Hanger DTS (S)"), (1, 4, "Lot Hanger DTS (S) (T)"), (1, 5, "Lot Valve DTS (T)")]
    found = {r.target: (r.row_pos, r.ratio) for r in schedule.fuzzy_best_match(spark.createDataFrame(targets, "project_id long, target string"), spark.createDataFrame(names, "project_id long, row_pos long, name string"), 90, repair=True).collect()}
    expected = {}
    for _, t in targets:
        best = max(((ratio(t, n), -k, n) for _, k, n in names if ratio(t, n) >= 90), default=None)
        own, other = (" (S)", " (T)") if " (S)" in t else (" (T)", " (S)")
        if best and other in best[2] and own not in best[2]:
            best = max(((ratio(t, n), -k, n) for _, k, n in names if own in n and other not in n and ratio(t, n) >= 70), default=best)
        if best:
            expected[t] = (-best[1], best[0])
    assert found == expected and found["Lot Pipe DTS (S)"][0] == 2


def test_comments_into_a_target(spark, tmp_path) -> None:
    """Batches touch their buckets only, run again without effect, and leave two versions of a bucket at most; older comments change nothing."""
    path = str(tmp_path / "target")
    rows = [(k, ["Group A", " group a ", "GROUP B", "-", "", None, "c"][k % 7], f"old {k}" if k % 3 else None) for k in range(40)]
    jobs.create_target(spark.createDataFrame(rows, "id long, group_text string, comment string"), path, 4)
    batch = lambda *changes: spark.createDataFrame(list(changes), "group_text string, comment string, seq long")
    state = lambda: {r.id: r.comment for r in jobs.read_target(spark, path).collect()}
    key = lambda g: (g or "").strip().lower()
    expected = {k: c for k, _, c in rows}
    assert state() == expected
    for number, changes in enumerate([[("group A", "first", 5), ("n/a", "never", 6), ("Group b", "b1", 7)], [("Group A", "late, but older", 4)], [(" Group A", "", 9), ("C", "c1", 8)], [("c", "c2", 20)], [("c", "c3", 21), ("-", "never", 22)]]):
        for _ in range(2):
            jobs.upsert_comments(batch(*changes), number, path, 4)
        for group, comment, _ in changes if number != 1 else ():
            for k, g, _ in rows:
                if key(g) == key(group) and key(g) not in ("", "-", "n/a"):
                    expected[k] = comment or None
        assert state() == expected, number
    versions = Counter(bucket for bucket, _ in jobs._versions(spark, path))
    assert max(versions.values()) <= 2 and len(versions) <= 4


def test_exclusions(spark) -> None:
    rows = [(1, "a", True, "BQ NOT EXIST here"), (2, "b", None, None), (3, "x solid handling support not in GP lot y", False, "z")]
    df = spark.createDataFrame(rows, "row_pos long, code string, gone boolean, note string")
    found = lambda **more: {r.row_pos: r.exclusion for r in batching.with_exclusions(df, "gone", **more).collect()}
    assert found() == {1: "Deleted; BQ not exist", 2: "", 3: "Solid handling not in GP"}
    assert found(but=("Deleted",)) == {1: "BQ not exist", 2: "", 3: "Solid handling not in GP"}


def test_rows_with_an_area_stay_outside_the_group(spark) -> None:
    """The sequential step sees rows without an area only, and decides as if it had seen all."""
    rng = random.Random(2)
    detail = [(1, f"A{k}", f"S{k % 3}" if k % 5 else "N/A", 1 + k % 4, float(rng.randrange(50))) for k in range(12)]
    missing = [(1, k, f"c{k}", rng.choice(["A1", "A2", "A7", None, "B9"]), rng.choice(["S0", "S2", "S8", "N/A", None]), rng.choice([None, 7.0, 30.0])) for k in range(80)]
    out = batching.integrate_missing(spark.createDataFrame(missing, "project_id long, row_pos long, code string, working_area string, section string, weight double"), spark.createDataFrame(detail, "project_id long, working_area string, section string, batch long, weight double"))
    weight, area, sections = defaultdict(float), {}, defaultdict(set)
    for _, a, s, b, w in detail:
        weight[b] += w
        area[a] = min(b, area.get(a, b))
        sections[s].add(b)
    expected = {}
    for _, k, _, a, s, w in missing:
        light = lambda among: min(among, key=lambda b: (round(weight[b], 6), b))
        own = sections.get(s, set())
        if a in area:
            expected[k] = (area[a], batching.BY_AREA)
        elif s == "N/A":
            expected[k] = (min(own), batching.BY_ANCHOR) if own else (light(weight), batching.FIRST_ANCHOR)
        else:
            expected[k] = (light(own), batching.BY_SECTION) if own else (light(weight), batching.BY_WEIGHT)
        weight[expected[k][0]] += w or 0.0
        sections[s].add(expected[k][0])
    assert {r.row_pos: (r.batch, r.reason) for r in out.collect()} == expected


def test_headers_in_two_rows(spark) -> None:
    words = [("MATERIALS", 10, 100), ("PT", 10, 90), ("QTY", 60, 90), ("COMPONENT", 30, 90), ("NO", 12, 85), ("DESCRIPTION", 28, 85), ("WEIGHT", 80, 90), ("1", 11, 70), ("9.5", 79, 70), ("Tee", 27, 70), ("90", 33, 70), ("PIPE", 10, 75), ("2", 9, 60), ("4", 61, 60), ("TOTAL WEIGHT", 30, 20), ("3", 10, 15)]
    df = spark.createDataFrame([("f", t, float(x), float(y)) for t, x, y in words], "file string, text string, x double, y double")
    found = {tuple(r) for r in layout.materials_table(df).collect()}
    assert found == {("f", 70.0, "PIPE", "1", "Tee 90", "", "", "9.5"), ("f", 60.0, "PIPE", "2", "", "", "4", "")}
