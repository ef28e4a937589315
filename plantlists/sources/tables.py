"""Reading lists, cell tables and inventories; writing revisions and reports."""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.ranges import numbered


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",") -> DataFrame:
    """A1: a CSV with a header and an explicit schema (ids stay text); quotes inside quotes are doubled; a byte-order mark does not count."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("encoding", "UTF-8").option("escape", '"').option("multiLine", False).option("enforceSchema", True).csv(path)


def keyword_list(rows: DataFrame) -> DataFrame:
    """A2: keywords in lower case and trimmed; of several rows (keyword, category, row_pos) of one the last counts."""
    low = F.lower(F.trim("keyword"))
    return rows.where(low != "").groupBy(low.alias("keyword")).agg(F.max_by(F.trim("category"), "row_pos").alias("category"))


def read_keyword_list(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A2 from a file of category and keyword."""
    rows = spark.read.schema("category string, keyword string").option("header", True).option("sep", separator).csv(path)
    return keyword_list(rows.withColumn("row_pos", F.monotonically_increasing_id()))


def attribute_rows(lines: DataFrame) -> DataFrame:
    """A3: lines (value: 'id;name;value;name;value...') as id and a map of attributes, the last of a name counting."""

    def paired(rest: Column) -> Column:
        count = F.greatest(F.floor(F.size(rest) / 2) - 1, F.lit(0)).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(F.try_element_at(rest, 2 * i + 1).alias("k"), F.try_element_at(rest, 2 * i + 2).alias("v")))
        return text.once(F.reverse(F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["k"] != ""))), lasts)

    def lasts(back: Column) -> Column:
        value_of = lambda n: F.element_at(back["v"], F.array_position(back["k"], n).cast("int"))
        return text.once(F.reverse(F.array_distinct(back["k"])), lambda names: F.map_from_arrays(names, F.transform(names, value_of)))

    # each step is worked out once a row: copied into the lambdas that use it, a line was split again for each pair of its cells
    attributes = text.once(F.split("value", ";"), lambda cells: text.once(F.slice(cells, 2, F.size(cells)), paired))
    return lines.where(F.col("value") != "").select(F.substring_index("value", ";", 1).alias("id"), attributes.alias("attributes"))


def wide_attributes(rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A3: one column per attribute; commas go from connection columns. Names are the distinct keys, found by one pass, if none are given."""
    if names is None:
        names = [r[0] for r in rows.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().orderBy("k").collect()]
    value = lambda n: F.replace(F.col("attributes")[n], F.lit(","), F.lit("")) if n in ("P1 CONN", "P2 CONN") else F.col("attributes")[n]
    return rows.select("id", *(value(n).alias(n) for n in names))


def list_files(spark: SparkSession, root: str, extension: str = "", name_glob: str = "*", min_size: int = 0, max_size: int | None = None, modified_after: str | None = None, modified_before: str | None = None, regex: str = "", case_sensitive: bool = False) -> DataFrame:
    """A4: path, length and time of files below root; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob)
    for name, value in (("modifiedAfter", modified_after), ("modifiedBefore", modified_before)):
        reader = reader.option(name, value) if value else reader
    return filter_files(reader.load(root).select("path", "length", "modificationTime"), extension, min_size, max_size, regex, case_sensitive)


def filter_files(files: DataFrame, extension: str = "", min_size: int = 0, max_size: int | None = None, regex: str = "", case_sensitive: bool = False) -> DataFrame:
    """A4: the predicates over an inventory (path, length)."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    keep = F.col("length") >= min_size
    keep = keep & (F.col("length") <= max_size) if max_size is not None else keep
    keep = keep & F.lower(name).endswith(extension.lower()) if extension else keep
    return files.where(keep & name.rlike(regex if case_sensitive else f"(?i){regex}") if regex else keep)


def cells_from_rows(df: DataFrame, file: Column, sheet: Column, row: Column, columns: Sequence[str]) -> DataFrame:
    """A5: file, sheet, row, col (from 1), value, coordinate of every cell that is not null."""
    cells = df.select(file.alias("file"), sheet.alias("sheet"), row.alias("row"), F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("col", "value")).where("value is not null")
    return cells.select("file", "sheet", "row", (F.col("col") + 1).alias("col"), "value", text.coordinate(F.col("row"), F.col("col") + 1).alias("coordinate"))


def detect_header(cells: DataFrame, mode: str, tokens: Sequence[str] = (), first_rows: int = 40) -> DataFrame:
    """The header row of each (file, sheet).

    required: all tokens stand in the row. first_col_in: column 1 holds a token. min_hits: three cells or more and two tokens or more. densest: most of 10 *
    distinct + cells within the first rows. contains_all: each token is part of some cell. Earliest on ties; sheets without one have no row.
    """
    value = text.norm_text(F.col("value"))
    rows = cells.where(value != "").groupBy("file", "sheet", "row").agg(F.collect_set(value).alias("v"), F.count("*").alias("n"), F.max(F.when(F.col("col") == 1, value)).alias("first"))
    low = [t.lower() for t in tokens]
    known = F.array(*map(F.lit, low)) if low else F.array().cast("array<string>")
    hits = F.size(F.array_intersect("v", known))
    if mode == "densest":
        best = F.struct((10 * F.size("v") + F.col("n")).alias("s"), (-F.col("row")).alias("r"))
        return rows.where(F.col("row") <= first_rows).groupBy("file", "sheet").agg(F.max_by("row", best).alias("header_row"))
    test = {
        "required": hits == len(set(low)), "first_col_in": F.coalesce(F.array_contains(known, F.col("first")), F.lit(False)), "min_hits": (F.col("n") >= 3) & (hits >= 2),
        "contains_all": F.forall(known, lambda t: F.exists("v", lambda v: v.contains(t))),
    }[mode]
    return rows.where(test).groupBy("file", "sheet").agg(F.min("row").alias("header_row"))


def table_from_cells(cells: DataFrame, header: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows below the header as a table of the named columns (others go; a cell without a header is Col_n); blank rows drop out."""
    below = cells.join(header, ["file", "sheet"])
    names = below.where("row = header_row").select("file", "sheet", "col", F.trim("value").alias("name"))
    body = below.where("row > header_row and trim(value) <> ''").join(names, ["file", "sheet", "col"], "left")
    body = body.withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("Col_"), F.col("col").cast("string"))))
    return body.where(F.col("name").isin(*columns)).groupBy("file", "sheet", "row").pivot("name", list(columns)).agg(F.first("value"))


def resolve_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]], least: float = 0.88, apart: float = 0.05) -> dict[str, str]:
    """Names of a header for wanted columns: an exact alias, else a similar one (0.88 and 0.05 ahead of the next). A column named DN is taken exactly only."""
    norm = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    free, out = list(columns), {}
    for want, names in aliases.items():
        for c in list(free):
            if want not in out and norm(c) in {norm(n) for n in names}:
                out[want] = c
                free.remove(c)
    for want, names in aliases.items():
        if want not in out and want.upper() != "DN":
            scores = sorted(((max(difflib.SequenceMatcher(None, norm(c), norm(n)).ratio() for n in names), c) for c in free), reverse=True)
            if scores and scores[0][0] >= least and (len(scores) == 1 or scores[0][0] - scores[1][0] >= apart):
                out[want] = scores[0][1]
                free.remove(scores[0][1])
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    """White space to _, other signs gone, C_ before a digit, _2 and so on for repeats."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = re.sub(r"[^\w]", "", re.sub(r"\s+", "_", c.strip())) or "COL"
        n = f"C_{n}" if n[0].isdigit() else n
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        names.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
    return df.toDF(*names)


def infer_types(df: DataFrame) -> DataFrame:
    """A10: text columns of whole numbers become long, of numbers double, the rest stay; one pass decides. Columns without values stay text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    count = lambda c, kind: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull())
    found = df.agg(*(x.alias(f"{n}{k}") for k, c in enumerate(texts) for n, x in (("l", count(c, "long")), ("d", count(c, "double")), ("n", F.count(c))))).first()
    kind = {c: "long" if not found[f"l{k}"] else "double" if not found[f"d{k}"] else "string" for k, c in enumerate(texts) if found[f"n{k}"]}
    return df.select(*(F.col(c).try_cast(kind[c]).alias(c) if kind.get(c, "string") != "string" else F.col(c) for c in df.columns))


def mm_to_header(df: DataFrame) -> DataFrame:
    """Text columns with '12 mm' values become numbers and are named 'name [mm]'; one pass decides."""
    pattern = r"(?i)^\s*[+-]?\d+([.,]\d+)?\s*mm\s*$"
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    hit = df.agg(*(F.coalesce(F.bool_or(F.col(c).rlike(pattern)), F.lit(False)).alias(f"c{k}") for k, c in enumerate(texts))).first()
    named = {c for k, c in enumerate(texts) if hit[f"c{k}"]}
    return df.select(*(text.parse_unit_number(F.col(c))["value"].alias(f"{c} [mm]") if c in named else F.col(c) for c in df.columns))


def import_price_rows(tables: Mapping[str, tuple[DataFrame, Mapping[str, str], str]], columns: Sequence[str], revision: str) -> DataFrame:
    """Sources (name: table, mapping of wanted to own columns, material label) as one table with label, revision, file_name and uid (by file, row_pos). All-missing rows go."""
    out = None
    for name, (df, mapping, label) in tables.items():
        cells = [F.col(mapping[c]).cast("string").alias(c) if c in mapping else F.lit(None).cast("string").alias(c) for c in columns]
        some = F.coalesce(*(F.when(F.trim(F.col(m).cast("string")).isin("", "N/A"), None).otherwise(F.col(m).cast("string")) for m in mapping.values()))
        part = df.where(some.isNotNull()).select(*cells, F.lit(label).alias("material_type"), F.lit(revision).alias("bom_rev"), F.lit(name).alias("file_name"), "row_pos")
        out = part if out is None else out.unionByName(part)
    return numbered(out, [F.col("file_name"), F.col("row_pos")], "uid")


def import_warnings(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Categories of the expected list without a file, or with several."""
    n = files.groupBy("category").agg(F.count("*").alias("n"))
    return expected.join(n, "category", "left").select("category", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").alias("warning")).where("warning is not null")


def file_schema_report(cells: DataFrame, targets: Sequence[str], tag: str) -> DataFrame:
    """For each sheet whose name contains the tag: last row, has_<target> flags, all_present; files without such a sheet have a '<no-sheet>' row."""
    chosen = cells.where(F.lower("sheet").contains(tag.lower()))
    names = [f"has_{re.sub(r'[^a-z0-9]+', '_', t.lower())}" for t in targets]
    has = [F.coalesce(F.bool_or(text.norm_label(F.col("value")) == re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()), F.lit(False)).alias(n) for n, t in zip(names, targets, strict=True)]
    rows = chosen.groupBy("file", "sheet").agg(F.max("row").alias("max_row"), *has)
    out = cells.select("file").distinct().join(rows, "file", "left").withColumn("sheet", F.coalesce("sheet", F.lit("<no-sheet>"))).withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    return out.withColumn("all_present", every)


def write_revision(df: DataFrame, path: str, revision: str, if_exists: str = "error") -> None:
    """One partition per revision; if_exists: keep, replace or error."""
    spark = df.sparkSession
    try:
        there = not spark.read.parquet(path).where(F.col("revision") == revision).isEmpty()
    except Exception as problem:  # a first revision has no table yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        there = False
    if there and if_exists == "error":
        raise ValueError(f"revision {revision} is there already")
    if there and if_exists == "keep":
        return
    df.withColumn("revision", F.lit(revision)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision").parquet(path)


def write_report(tables: Mapping[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder per table."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/{name}") if form == "csv" else writer.parquet(f"{path}/{name}")
