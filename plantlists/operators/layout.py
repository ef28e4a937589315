"""Tables from positioned drawing text: entities (file, text, x, y) to rows, materials, cut lengths, drawing fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import filled


def layout_rows(entities: DataFrame, title: str) -> DataFrame:
    """L1: file, y and cells (texts from left to right) of the rows below and not left of the title, y rounded to one place.

    A file's title is the entity with the title in it that stands highest.
    """
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"])
    return _below(entities, title).groupBy("file", "y").agg(cells.alias("cells"))


def forward_fill(rows: DataFrame, value: Column, name: str, group: str = "file", order: Column | None = None) -> DataFrame:
    """F8: the last value that is not null, going down the rows of a file."""
    return filled(rows, {name: value}, [order if order is not None else F.desc("y")], [group])


#: Section headers of materials tables (fixed values).
SECTIONS = ("PIPE", "FITTINGS", "FLANGES", "GASKETS", "BOLTS", "VALVES", "SUPPORTS", "INSTRUMENTS", "MISCELLANEOUS")


#: Header labels (two rows, one above the other) of the columns of a materials table, without signs and spaces (fixed values).
MATERIAL_COLUMNS = {"pt_no": ("PTNO",), "component_description": ("COMPONENTDESCRIPTION", "DESCRIPTION"), "n_s": ("NS", "NSMM", "NSINS"), "qty": ("QTY", "QTYM"), "weight": ("WEIGHT", "WEIGHTKG")}


def _below(entities: DataFrame, title: str) -> DataFrame:
    """Entities (file, text, x, y to one place) below and not left of the file's title."""
    at = entities.where(F.upper("text").contains(title.upper())).groupBy("file").agg(F.max_by(F.struct("x", "y"), F.struct("y", (-F.col("x")).alias("left"))).alias("t"))
    below = entities.join(at, "file").where((F.col("y") < F.col("t.y")) & (F.col("x") >= F.col("t.x") - 1.0))
    return below.select("file", "text", "x", F.round("y", 1).alias("y"))


def header_columns(below: DataFrame, wanted: Mapping[str, Sequence[str]] = MATERIAL_COLUMNS, near: float = 12.0) -> DataFrame:
    """L2: (file, columns): of a table's wanted columns the name and the range of x, from the two rows under the title.

    A word of the second row belongs to the word of the first row that is nearest in x, if it is no farther than `near`, and continues its label; other words are
    columns of their own. A column reaches half way to its neighbours. Files where fewer than two labels are wanted ones have no header.
    """
    rows = below.groupBy("file").agg(F.slice(F.sort_array(F.collect_set("y"), asc=False), 1, 2).alias("top"))
    words = below.join(rows, "file").where(F.array_contains("top", F.col("y"))).withColumn("second", F.col("y") != F.col("top")[0])
    first = words.where("not second").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("heads"))  # a table's header
    word = words.join(first, "file").withColumn("gap", F.transform("heads", lambda h: F.struct(F.abs(h["x"] - F.col("x")).alias("d"), h["x"].alias("x"))))
    home = F.when(F.col("second") & (F.array_min("gap")["d"] <= near), F.array_min("gap")["x"]).otherwise(F.col("x"))
    merged = word.select("file", home.alias("x"), F.struct("second", F.col("x").alias("own"), "text").alias("w")).groupBy("file", "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["text"]), "").alias("label"))
    label = F.upper(F.regexp_replace("label", r"[^A-Za-z0-9]", ""))
    name = F.lit(None).cast("string")
    for column, labels in wanted.items():
        name = F.when(label.isin(*labels), column).otherwise(name)
    way = Window.partitionBy("file").orderBy("x")  # a header's columns
    lo, hi = (F.lag("x").over(way) + F.col("x")) / 2, (F.lead("x").over(way) + F.col("x")) / 2
    ranged = merged.select("file", name.alias("name"), F.coalesce(lo, F.lit(float("-inf"))).alias("lo"), F.coalesce(hi, F.lit(float("inf"))).alias("hi"))
    found = ranged.groupBy("file").agg(F.collect_list(F.struct("name", "lo", "hi")).alias("columns"), F.count("name").alias("known"))
    return found.where("known >= 2").join(rows, "file").select("file", "columns", F.array_min("top").alias("header_y"))


def materials_table(entities: DataFrame, title: str = "MATERIALS") -> DataFrame:
    """L2: materials (file, y, category, pt_no, component_description, n_s, qty, weight) below the title down to TOTAL WEIGHT.

    With a two-row header a text goes to the column whose range of x holds it, so cells may be missing or drawn in any order; texts of one
    cell are joined by blanks from left to right. Without one, cells count from the left. Rows whose first column is a number are parts; rows of a section
    word alone carry the category downwards; missing cells are ''.
    """
    below = _below(entities, title)
    total = below.where(F.upper("text").contains("TOTAL WEIGHT")).groupBy("file").agg(F.max("y").alias("stop"))
    kept = below.join(total, "file", "left").where(F.col("stop").isNull() | (F.col("y") > F.col("stop"))).join(header_columns(below), "file", "left")
    kept = kept.where(F.col("header_y").isNull() | (F.col("y") < F.col("header_y")))
    own = F.get(F.filter("columns", lambda c: (F.col("x") >= c["lo"]) & (F.col("x") < c["hi"])), F.lit(0))["name"]
    rows = kept.withColumn("own", own).groupBy("file", "y").agg(F.bool_or(F.col("columns").isNotNull()).alias("headed"), F.array_sort(F.collect_list(F.struct("x", "text", "own"))).alias("cells"))
    head = F.upper(F.trim(F.col("cells")[0]["text"]))
    rows = forward_fill(rows, F.when(head.isin(*SECTIONS), head), "category")

    def cell(name: str, k: int) -> Column:
        named = F.array_join(F.transform(F.filter("cells", lambda c: c["own"] == name), lambda c: c["text"]), " ")
        return F.when(F.col("headed"), named).otherwise(F.coalesce(F.try_element_at("cells", F.lit(k))["text"], F.lit(""))).alias(name)

    cells = [cell(name, k) for k, name in enumerate(MATERIAL_COLUMNS, 1)]
    return rows.select("file", "y", F.coalesce("category", F.lit("")).alias("category"), *cells).where(F.col("pt_no").rlike(r"^\d+$"))


def cut_length_table(entities: DataFrame, title: str = "CUT PIPE LENGTH") -> DataFrame:
    """L3: one row per cut piece (file, y, piece_no, cut_length, n_s, remarks): rows with <n>, up to two pieces side by side. A piece takes the two numbers after it and the first other text."""
    rows = layout_rows(entities, title).withColumn("starts", F.filter(F.transform("cells", lambda c, i: F.when(c.rlike(r"^<\d+>$"), i)), lambda i: i.isNotNull())).where("size(starts) > 0")
    begin = lambda k: F.try_element_at("starts", F.lit(k))
    first = F.slice(F.col("cells"), begin(1) + 1, F.coalesce(begin(2), F.size("cells")) - begin(1))
    second = F.when(begin(2).isNotNull(), F.slice(F.col("cells"), begin(2) + 1, F.size("cells") - begin(2)))
    pieces = rows.select("file", "y", F.explode(F.array_compact(F.array(first, second))).alias("p"))
    rest = F.slice("p", 2, F.size("p"))
    numbers = F.filter(rest, lambda c: c.rlike(r"^\d+([.,]\d+)?$"))
    words = F.filter(rest, lambda c: ~c.rlike(r"^\d+([.,]\d+)?$"))
    at = lambda a, k: F.coalesce(F.try_element_at(a, F.lit(k)), F.lit(""))
    return pieces.select("file", "y", F.regexp_replace(F.col("p")[0], "[<>]", "").alias("piece_no"), at(numbers, 1).alias("cut_length"), at(numbers, 2).alias("n_s"), at(words, 1).alias("remarks"))


def drawing_fields(entities: DataFrame, marker: str = "DRAWING NO", code: str = r"^\d[A-Z]{3}\d{2}BR\d{3}", label: str = "PIPE CLASS") -> DataFrame:
    """L4: file, drawing_no (the code right of or below the marker with the least |dy|), pipe_class (the four letters nearest to the label, else the lowest ones)."""
    point = lambda word: entities.where(F.upper("text").contains(word)).groupBy("file").agg(F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("m"))
    codes = entities.where(F.col("text").rlike(code)).join(point(marker), "file").where((F.col("x") >= F.col("m.x")) | (F.col("y") <= F.col("m.y")))
    numbers = codes.groupBy("file").agg(F.min_by("text", F.struct(F.abs(F.col("y") - F.col("m.y")), "x", "text")).alias("drawing_no"))
    letters = entities.where(F.col("text").rlike(r"^[A-Z]{4}$"))
    near = letters.join(point(label), "file").groupBy("file").agg(F.min_by("text", F.struct(F.hypot(F.col("x") - F.col("m.x"), F.col("y") - F.col("m.y")), "text")).alias("near"))
    low = letters.groupBy("file").agg(F.min_by("text", F.struct("y", "x", "text")).alias("low"))
    files = entities.select("file").distinct()
    return files.join(numbers, "file", "left").join(near, "file", "left").join(low, "file", "left").select("file", "drawing_no", F.coalesce("near", "low").alias("pipe_class"))


def extraction_summary(files: DataFrame, materials: DataFrame, cuts: DataFrame, fields: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """By file: rows of both tables, whether they are missing, drawing number, class, and the reader's error (file, error; the least one), '' for none.

    Files that only have an error come too.
    """
    count = lambda df, n: df.groupBy("file").agg(F.count("*").alias(n))
    names = files.select("file")
    failed = errors.groupBy("file").agg(F.min("error").alias("error")) if errors is not None else names.select("file", F.lit("").alias("error")).limit(0)
    rows = names.union(failed.select("file")).distinct().join(count(materials, "mat_rows"), "file", "left").join(count(cuts, "cut_rows"), "file", "left").join(fields, "file", "left").join(failed, "file", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mat_rows", "cut_rows")})
    return rows.withColumns({"mat_missing": F.col("mat_rows") == 0, "cut_missing": F.col("cut_rows") == 0, "error": F.coalesce("error", F.lit(""))})
