"""Revision compare and reconciliation of keyed lists.

Order matters in these lists, so every input whose order counts carries a row_pos. Keys compare null-safe: a null coating is a
coating of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Characters after a core that codes_in_codes() joins on.
CONTEXT = 16


def occurrences(df: DataFrame, keys: Sequence[str], order: str = "row_pos") -> DataFrame:
    """occ, the number of the row among those with its key (from 1), and duplicate, whether the key has more."""
    same = Window.partitionBy(*keys)
    return df.withColumns({"occ": F.row_number().over(same.orderBy(order)), "duplicate": F.count(F.lit(1)).over(same) > 1})


def pick_by_key(df: DataFrame, keys: Sequence[str], order: str = "row_pos", last: bool = False) -> DataFrame:
    """the first (or last) row of each key."""
    by = F.desc(order) if last else F.asc(order)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_rank = 1").drop("_rank")


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def pair_positional(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The k-th row of a key in old beside the k-th in new: keys, occ, in_old, in_new and every other column as old_x and new_x.

    Surplus rows stand alone. The window and the join share the partitioning by keys.
    """
    rest = [c for c in old.columns if c in new.columns and c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        numbered = occurrences(df, keys).drop("duplicate")
        return numbered.select(*(F.col(k).alias(f"{name}__{k}") for k in keys), F.col("occ").alias(f"{name}__occ"), *(F.col(c).alias(f"{name}_{c}") for c in rest))

    a, b = side(old, "old"), side(new, "new")
    on = F.col("old__occ") == F.col("new__occ")
    for k in keys:
        on = on & F.col(f"old__{k}").eqNullSafe(F.col(f"new__{k}"))
    both = a.join(b, on, "full_outer")
    return both.select(
        *(F.coalesce(f"new__{k}", f"old__{k}").alias(k) for k in keys), F.coalesce("new__occ", "old__occ").alias("occ"),
        F.col("old__occ").isNotNull().alias("in_old"), F.col("new__occ").isNotNull().alias("in_new"),
        *(F.col(f"{n}_{c}") for c in rest for n in ("old", "new")),
    )


def _change(old: Column, new: Column, number: bool) -> Column:
    """The kind of a cell's change; null where the texts are equal."""
    a, b = F.coalesce(old.cast("string"), F.lit("")), F.coalesce(new.cast("string"), F.lit(""))
    if number:
        up = F.coalesce(new, F.lit(0)) > F.coalesce(old, F.lit(0))
        return F.when(a == b, F.lit(None)).when(a == "", "Added").when(b == "", "Deleted").when(~up, "Smaller").otherwise("Changed")
    return F.when(a == b, F.lit(None)).when(a == "", "Added").when(b == "", "Deleted").otherwise("Changed")


def compare_revision(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], quantity: str) -> DataFrame:
    """D2, one row per pair: keys, occ, status, changed (columns in order), qty_change.

    status is New Row, Deleted Row, Unchanged or the first kind found of Added, Deleted, Smaller, Changed. qty_change is new minus old, the whole
    quantity for new rows and its negative for deleted ones.
    """
    numbers = {f.name for f in new.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "decimal", "float", "short")}
    pairs = pair_positional(old, new, keys)
    kinds = {c: _change(F.col(f"old_{c}"), F.col(f"new_{c}"), c in numbers) for c in columns}
    found = F.array_compact(F.array(*kinds.values()))
    first = F.lit("Unchanged")
    for kind in ("Changed", "Smaller", "Deleted", "Added"):
        first = F.when(F.array_contains(found, kind), kind).otherwise(first)
    status = F.when(~F.col("in_old"), "New Row").when(~F.col("in_new"), "Deleted Row").otherwise(first)
    changed = F.array_join(F.array_compact(F.array(*(F.when(k.isNotNull(), c) for c, k in kinds.items()))), ", ")
    delta = F.coalesce(F.col(f"new_{quantity}"), F.lit(0)) - F.coalesce(F.col(f"old_{quantity}"), F.lit(0))
    return pairs.select(*keys, "occ", status.alias("status"), F.when(F.col("in_old") & F.col("in_new"), changed).otherwise("").alias("changed"), delta.alias("qty_change"))


def cell_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """D2, one row per changed cell: keys, occ, column, old, new, change (Added, Deleted, Changed)."""
    pairs = pair_positional(old, new, keys).where("in_old and in_new")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"old_{c}").cast("string").alias("old"), F.col(f"new_{c}").cast("string").alias("new")) for c in columns))
    return pairs.select(*keys, "occ", F.inline(cells)).withColumn("change", _change(F.col("old"), F.col("new"), False)).where("change is not null")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def compare_sheet(old: DataFrame, new: DataFrame, columns: Sequence[str], keys: int = 4) -> DataFrame:
    """D2, style `sheet`: one row per pair of rows of two sheets with the same columns, in order: key columns, occ, marker, qty_change.

    The key is the first columns; cells compare as trimmed texts. marker is New Row, Deleted Row, or the kinds found, of Deleted, Smaller (both numbers, the new one less), Changed
    and Added in this order; a Smaller cell takes a Changed back that stands left of it. The quantity is the first column with qty or quantity in its name
    after one with spare, else the last such one; qty_change is null for no change and for texts.
    """
    key, low = list(columns[:keys]), [c.lower() for c in columns]
    is_quantity = ["qty" in c or "quantity" in c for c in low]
    spare = next((k for k, c in enumerate(low) if "spare" in c), len(low))
    quantity = next((c for k, c in enumerate(columns) if is_quantity[k] and k > spare), next((c for k, c in reversed(list(enumerate(columns))) if is_quantity[k]), None))
    texts = lambda df: df.select("row_pos", *(_text(c).alias(c) for c in columns))
    pairs = pair_positional(texts(old), texts(new), key)
    kinds = []
    for c in columns[keys:]:
        a, b = F.col(f"old_{c}"), F.col(f"new_{c}")
        smaller = b.try_cast("double") < a.try_cast("double")
        kinds.append(F.when(a == b, F.lit(None).cast("string")).when(a == "", "Added").when(b == "", "Deleted").when(smaller, "Smaller").otherwise("Changed"))
    found = F.array(*kinds) if kinds else F.array().cast("array<string>")
    last = lambda kind: F.size(found) - F.array_position(F.reverse(found), kind)
    changed = F.array_contains(F.array_compact(found), "Changed") & (~F.array_contains(F.array_compact(found), "Smaller") | (last("Changed") > last("Smaller")))
    has = lambda kind: F.when(changed if kind == "Changed" else F.array_contains(F.array_compact(found), kind), kind)
    marker = F.when(~F.col("in_old"), "New Row").when(~F.col("in_new"), "Deleted Row").otherwise(F.concat_ws(", ", *map(has, ("Deleted", "Smaller", "Changed", "Added"))))
    amount = lambda n: F.when(F.coalesce(F.col(f"{n}_{quantity}"), F.lit("")) == "", 0.0).otherwise(F.col(f"{n}_{quantity}").try_cast("double"))
    delta = F.round(amount("new") - amount("old"), 6) if quantity and quantity not in key else F.lit(None).cast("double")
    return pairs.select(*key, "occ", marker.alias("marker"), F.when(delta != 0, delta).alias("qty_change"))


def list_key(c: Column) -> Column:
    """A number of a list as text: texts stay as they are, leading zeros too, whole numbers lose their decimals, null is ''."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^(\d+)\.0$", "$1"), F.lit(""))


def compare_list(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """D2, style `list`: one row per pair of rows of an id (list_key()), in order: id, occ, marker, duplicate, comments.

    marker is Added or Deleted for rows of one side, else the kinds of the changed cells, of Deleted, Changed, Added in this order; a row all of whose cells are new is Added. duplicate
    tells whether the id comes several times on a side. comments: the changed cells as 'column: old value', '(empty)' for none, in the order of the columns.
    """
    texts = lambda df: df.select("row_pos", list_key(F.col(key)).alias(key), *(_text(c).alias(c) for c in columns))
    a, b = texts(old), texts(new)
    several = a.groupBy(key).agg(F.count("*").alias("n")).union(b.groupBy(key).agg(F.count("*").alias("n"))).where("n > 1").select(F.col(key).alias("_several")).distinct()
    pairs = pair_positional(a, b, [key]).join(several, F.col(key) == F.col("_several"), "left")
    kinds = {c: _change(F.col(f"old_{c}"), F.col(f"new_{c}"), False) for c in columns}
    found = F.array_compact(F.array(*kinds.values()))
    marker = F.when(~F.col("in_old"), "Added").when(~F.col("in_new"), "Deleted").otherwise(F.concat_ws(", ", *(F.when(F.array_contains(found, k), k) for k in ("Deleted", "Changed", "Added"))))
    was = [F.when(k.isNotNull() & F.col("in_old") & F.col("in_new"), F.concat(F.lit(f"{c}: "), F.when(F.col(f"old_{c}") == "", "(empty)").otherwise(F.col(f"old_{c}")))) for c, k in kinds.items()]
    return pairs.select(key, "occ", marker.alias("marker"), F.col("_several").isNotNull().alias("duplicate"), F.array_compact(F.array(*was)).alias("comments"))


def enrich_status(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """New with status columns filled, by positional match, from old where new has none. Key columns must not be empty."""
    if not columns:
        raise ValueError("no status columns given")
    there = [c for c in columns if c in new.columns]
    a = occurrences(old, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("occ").alias("_occ"), *(F.col(c).alias(f"_{c}") for c in columns))
    b = occurrences(new, keys).drop("duplicate")
    on = F.col("occ") == F.col("_occ")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = b.join(a, on, "left")
    filled = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in there else F.col(f"_{c}").alias(c) for c in columns]
    return joined.select(*(c for c in new.columns if c not in columns), *filled)


def reconcile_shipping(bom: DataFrame, ship: DataFrame) -> DataFrame:
    """D3: bom (item, qty, uom) against what was shipped: status MATCH, MISMATCH or MISSING, diff; EXTRA where only the item is unknown to bom.

    Items and units compare trimmed and in upper case.
    """
    key = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    a = bom.select(key(F.col("item")).alias("item"), key(F.col("uom")).alias("uom"), F.col("qty").alias("bom_qty"))
    b = ship.groupBy(key(F.col("item")).alias("item"), key(F.col("uom")).alias("uom")).agg(F.sum("qty").alias("ship_qty"))
    known = a.join(b, ["item", "uom"], "left")
    status = F.when(F.col("ship_qty").isNull(), "MISSING").when(F.abs(F.col("ship_qty") - F.col("bom_qty")) < 1e-9, "MATCH").otherwise("MISMATCH")
    known = known.select("item", "uom", "bom_qty", "ship_qty", status.alias("status"), (F.coalesce("ship_qty", F.lit(0.0)) - F.col("bom_qty")).alias("diff"))
    extra = b.join(a.select("item").distinct(), "item", "left_anti")
    return known.unionByName(extra.select("item", "uom", F.lit(None).cast("double").alias("bom_qty"), "ship_qty", F.lit("EXTRA").alias("status"), F.col("ship_qty").alias("diff")))


def reconcile_articles(base: DataFrame, update: DataFrame, only_differences: bool = True) -> DataFrame:
    """Quantities summed by article in both lists (article, qty, description, row_pos): delta is update minus base, status New, Deleted, Changed or Same.

    The description is the first one that is not null, of update before base.
    """
    total = lambda df, n: df.groupBy("article").agg(F.sum("qty").alias(f"{n}_qty"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("row_pos"))).alias(f"{n}_text"))
    both = total(base, "base").join(total(update, "update"), "article", "full_outer")
    delta = F.coalesce("update_qty", F.lit(0.0)) - F.coalesce("base_qty", F.lit(0.0))
    status = F.when(F.col("base_qty").isNull(), "New").when(F.col("update_qty").isNull(), "Deleted").when(delta != 0, "Changed").otherwise("Same")
    out = both.select("article", F.coalesce("update_text", "base_text").alias("description"), F.coalesce("base_qty", F.lit(0.0)).alias("base_qty"), F.coalesce("update_qty", F.lit(0.0)).alias("update_qty"), delta.alias("delta"), status.alias("status"))
    return out.where("delta <> 0") if only_differences else out


Rule = tuple[str, Sequence[str], str | None]


def rolled_up(rules: Sequence[Rule], name: str = "Cut List") -> list[Rule]:
    """The rules and, after the one of that name, a rule by its first key alone."""
    return [r for rule in rules for r in ([rule, (f"{name} by item", rule[1][:1], rule[2])] if rule[0] == name else [rule])]


def _reconciled(a: DataFrame, b: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All keys of both sides by rule, with status; a rule without a quantity compares the numbers of rows only."""
    out = None
    for name, keys, quantity in rules:
        key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).alias("key")
        amount = F.sum(quantity) if quantity else F.lit(None).cast("double")
        total = lambda df, n: df.groupBy(key).agg(amount.alias(f"qty_{n}"), F.count("*").alias(f"rows_{n}"))  # noqa: E731,B023
        both = total(a, "a").join(total(b, "b"), "key", "full_outer")
        differs = (F.abs(F.col("qty_a") - F.col("qty_b")) > 1e-9) | (F.col("rows_a") != F.col("rows_b"))
        status = F.when(F.col("rows_b").isNull(), "only in A").when(F.col("rows_a").isNull(), "only in B").when(differs, "Mismatch").otherwise("Match")
        part = both.select(F.lit(name).alias("rule"), "key", status.alias("status"), "qty_a", "qty_b", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))
        out = part if out is None else out.unionByName(part)
    return out


def reconcile_rules(a: DataFrame, b: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """For each rule (name, keys, quantity column or None): rule, key, status (only in A, only in B, Mismatch), qty_a, qty_b, rows_a, rows_b. Equal keys are left out."""
    return _reconciled(a, b, rules).where("status <> 'Match'")


def reconcile_statistics(a: DataFrame, b: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """For each rule the numbers of keys only_a, only_b, mismatch and match."""
    n = {"only_a": "only in A", "only_b": "only in B", "mismatch": "Mismatch", "match": "Match"}
    return _reconciled(a, b, rules).groupBy("rule").agg(*(F.count_if(F.col("status") == status).alias(c) for c, status in n.items()))


#: What a scope hint says (own wording): all names only in A lack the suffix, some do, none does.
SCOPE_HINTS = ("all names only in A lack the suffix: A has more scope", "some names only in A lack the suffix: A may have more scope", "no pattern of the suffix")


def scope_hint(differences: DataFrame, rule: str = "Support List", suffix: str = "/SU") -> DataFrame:
    """D5, one row: only_a, the keys of a rule that only A has, those of them without the suffix, and what that hints at."""
    names = differences.where((F.col("rule") == rule) & (F.col("status") == "only in A") & (F.trim("key") != ""))
    one = names.agg(F.count("*").alias("only_a"), F.count_if(~F.col("key").endswith(suffix)).alias("without_suffix"))
    hint = F.when((F.col("only_a") > 0) & (F.col("only_a") == F.col("without_suffix")), SCOPE_HINTS[0]).when(F.col("without_suffix") > 0, SCOPE_HINTS[1]).otherwise(SCOPE_HINTS[2])
    return one.withColumn("hint", hint)


def diff_order(df: DataFrame) -> DataFrame:
    """Mismatches first, then by row and quantity differences, larger ones first."""
    rows = F.abs(F.col("rows_a") - F.col("rows_b"))
    quantity = F.abs(F.coalesce("qty_a", F.lit(0)) - F.coalesce("qty_b", F.lit(0)))
    return df.orderBy(F.desc(F.when(F.col("status") == "Mismatch", 1).otherwise(0)), F.desc(rows), F.desc(quantity), "rule", "key")


def row_set_statistics(compared: DataFrame) -> DataFrame:
    """Counts of row_set_compare() by status, and their share of the side that has them (a for IDENTICAL and MISSING, b for EXTRA) in percent."""
    n = lambda status: F.count_if(F.col("status") == status)
    one = compared.agg(n("IDENTICAL").alias("i"), n("MISSING").alias("m"), n("EXTRA").alias("e"))
    share = lambda x, whole: F.when(whole > 0, F.round(x * 100.0 / whole, 2)).otherwise(0.0)
    i, m, e = F.col("i"), F.col("m"), F.col("e")
    rows = F.array(*(F.struct(F.lit(s).alias("status"), x.alias("n"), share(x, whole).alias("percent")) for s, x, whole in (("IDENTICAL", i, i + m), ("MISSING", m, i + m), ("EXTRA", e, i + e))))
    return one.select(F.inline(rows))


def match_breakdown(matched: DataFrame) -> DataFrame:
    """Rows by level of hierarchical_match() and their share in percent."""
    total = matched.agg(F.count("*").alias("all"))  # one row
    return matched.groupBy("level").agg(F.count("*").alias("n")).crossJoin(total).select("level", "n", F.round(F.col("n") * 100.0 / F.col("all"), 2).alias("percent"))


def reconcile_po_cor(base: DataFrame, update: DataFrame) -> DataFrame:
    """By (item, corrosion), one row per matching row of update: delta of quantities; Deleted gives the negative, New the whole quantity.

    'special' remarks of the base are kept.
    """
    u = update.select(F.col("item").alias("u_item"), F.col("corrosion").alias("u_corrosion"), F.col("qty").alias("u_qty"))
    on = F.col("item").eqNullSafe(F.col("u_item")) & F.col("corrosion").eqNullSafe(F.col("u_corrosion"))
    matched = base.join(u, on, "left")
    status = F.when(F.col("u_qty").isNull(), "Deleted").when(F.col("u_qty") == F.col("qty"), "Same").otherwise("Changed")
    keep = F.when(F.lower("remarks").contains("special"), F.col("remarks"))
    left = matched.select("item", "corrosion", status.alias("status"), (F.coalesce("u_qty", F.lit(0)) - F.col("qty")).alias("delta"), keep.alias("remark"))
    b = base.select(F.col("item").alias("b_item"), F.col("corrosion").alias("b_corrosion")).distinct()
    new = update.join(b, F.col("item").eqNullSafe(F.col("b_item")) & F.col("corrosion").eqNullSafe(F.col("b_corrosion")), "left_anti")
    return left.unionByName(new.select("item", "corrosion", F.lit("New").alias("status"), F.col("qty").alias("delta"), F.lit(None).cast("string").alias("remark")))


def reconcile_po_bom(po: DataFrame, bom: DataFrame) -> DataFrame:
    """First row of each trimmed description of both (description, qty, weight, row_pos): status Same, Changed, Removed or New, differences where not 0."""
    first = lambda df: pick_by_key(df.withColumn("description", F.trim("description")), ["description"])
    a = first(po).select("description", F.col("qty").alias("po_qty"), F.col("weight").alias("po_weight"))
    b = first(bom).select("description", F.col("qty").alias("bom_qty"), F.col("weight").alias("bom_weight"))
    both = a.join(b, "description", "full_outer")
    qty, weight = (F.round(F.coalesce(f"bom_{c}", F.lit(0.0)) - F.coalesce(f"po_{c}", F.lit(0.0)), 2) for c in ("qty", "weight"))
    status = F.when(F.col("po_qty").isNull(), "New").when(F.col("bom_qty").isNull(), "Removed").when((qty != 0) | (weight != 0), "Changed").otherwise("Same")
    return both.select("description", status.alias("status"), F.when(qty != 0, qty).alias("qty_diff"), F.when(weight != 0, weight).alias("weight_diff"), F.when(F.col("bom_weight").isNull() & F.col("bom_qty").isNotNull(), "no weight").alias("note"))


def insertion_position(new: DataFrame, base: DataFrame) -> DataFrame:
    """For new rows (id, category, sub, row_pos) the base row after which they go: the last of category and sub, else of category, else of all; seq orders those of one place."""
    by_sub = base.groupBy("category", "sub").agg(F.max("row_pos").alias("sub_pos"))
    by_category = base.groupBy("category").agg(F.max("row_pos").alias("category_pos"))
    end = base.agg(F.max("row_pos").alias("end_pos"))  # one row
    placed = new.join(by_sub, ["category", "sub"], "left").join(by_category, "category", "left").crossJoin(F.broadcast(end))
    placed = placed.withColumn("after_pos", F.coalesce("sub_pos", "category_pos", "end_pos"))
    return placed.select("id", "after_pos", F.row_number().over(Window.partitionBy("after_pos").orderBy("row_pos")).alias("seq"))


def row_set_compare(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole rows over columns as keys: status IDENTICAL, MISSING (in a only) or EXTRA (in b only), with the last row number on each side."""
    last = lambda df, n: df.groupBy(*columns).agg(F.max("row_pos").alias(f"row_{n}"))
    x, y = last(a, "a").withColumn("_h", F.xxhash64(*columns)), last(b, "b").withColumn("_h", F.xxhash64(*columns))
    y = y.select(*(F.col(c).alias(f"b_{c}") for c in columns), "row_b", F.col("_h").alias("_hb"))
    on = F.col("_h") == F.col("_hb")
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    both = x.join(y, on, "full_outer")
    status = F.when(F.col("row_b").isNull(), "MISSING").when(F.col("row_a").isNull(), "EXTRA").otherwise("IDENTICAL")
    return both.select(*(F.when(F.col("row_a").isNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in columns), status.alias("status"), "row_a", "row_b")


def copy_flag_by_keys(source: DataFrame, target: DataFrame, keys: Sequence[str], column: str, value: str) -> DataFrame:
    """Column set to value in the target rows whose keys (nulls and whole floats equal) stand in source."""
    norm = lambda c: F.coalesce(F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0+$", ""), F.lit(""))
    wanted = source.select(*(norm(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_hit", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & (norm(k) == F.col(f"_{k}"))
    return target.join(wanted, on, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(target.columns)


def carry_comments(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of new take the first value of old that is not null for the key, where there is one."""
    firsts = old.groupBy(F.col(key).alias("_key")).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_pos"))).alias(f"_{c}") for c in columns))
    joined = new.join(firsts, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns))


def copy_and_propagate(source: DataFrame, target: DataFrame) -> DataFrame:
    """The last comment of each id goes to the target rows of that id, then the last of a group text longer than five characters to all rows of the group.

    source: id, comment, row_pos. target: id, group_text, row_pos. Result: id, group_text, row_pos, comment.
    """
    last = source.where("comment is not null").groupBy("id").agg(F.max_by("comment", "row_pos").alias("own"))
    direct = target.join(last, "id", "left")
    groups = direct.where("own is not null and length(group_text) > 5").groupBy("group_text").agg(F.max_by("own", "row_pos").alias("shared"))
    return direct.join(groups, "group_text", "left").select("id", "group_text", "row_pos", F.coalesce("shared", "own").alias("comment"))


def contained_pairs(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, text) for all texts of hay (column text) that contain a needle (column needle); both distinct, empty needles left out.

    A text with the needle has all of its three-character pieces (shorter needles: the needle itself), so the join is on the piece
    of the needle that fewest texts have, and then the containment is tested.
    """
    pieces = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    texts = hay.select("text").distinct()
    have = texts.select("text", F.explode(F.array_distinct(F.concat(*(pieces(F.col("text"), n) for n in (1, 2, 3))))).alias("piece"))
    size = F.least(F.lit(3), F.length("needle"))
    own = needles.select("needle").distinct().where("needle <> ''").select("needle", F.explode(F.array_distinct(F.when(size == 3, pieces(F.col("needle"), 3)).otherwise(F.array("needle")))).alias("piece"))
    often = have.groupBy("piece").agg(F.count("*").alias("n"))
    rare = own.join(often.hint("merge"), "piece").groupBy("needle").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return rare.join(have.hint("merge"), "piece").where(F.col("text").contains(F.col("needle"))).select("needle", "text")


def infer_category(new: DataFrame, base: DataFrame) -> DataFrame:
    """New (id, description) takes the category of the base row with the same description, else of the first base row that holds two of its words, else Unknown.

    base: description, category, row_pos. Case does not count, a word may stand inside a longer one, and a word that the description
    repeats counts as often. Descriptions are compared once each, words once each against the words of base.
    """
    exact = base.groupBy("description").agg(F.min_by("category", "row_pos").alias("same"))
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    mine = new.where("description is not null").select("description").distinct().select("description", F.explode(words(F.col("description"))).alias("needle")).groupBy("description", "needle").agg(F.count("*").alias("times"))
    firsts = base.where("description is not null").groupBy(F.lower("description").alias("lowered")).agg(F.min_by(F.struct("row_pos", "category"), "row_pos").alias("first"))
    theirs = firsts.select("lowered", "first", F.explode(F.array_distinct(words(F.col("lowered")))).alias("text"))
    held = contained_pairs(mine, theirs).join(theirs, "text").select("needle", "lowered", "first").distinct()
    shared = mine.join(held, "needle").groupBy("description", "lowered", "first").agg(F.sum("times").alias("n")).where("n >= 2")
    best = shared.groupBy("description").agg(F.min("first").alias("near"))
    out = new.join(exact, "description", "left").join(best, "description", "left")
    return out.select("id", "description", F.coalesce("same", F.col("near.category"), F.lit("Unknown")).alias("category"))


def missing_codes(status: DataFrame, batched: DataFrame, deducted: DataFrame) -> DataFrame:
    """Codes of status (code, state) that are in no batch: flag for the deducted list, tag for deleted or withdrawn ones."""
    missing = status.join(batched.select("code").distinct(), "code", "left_anti")
    listed = deducted.select("code").distinct().withColumn("deducted", F.lit(True))
    inactive = F.lower("state").rlike("deleted|withdrawn")
    return missing.join(listed, "code", "left").select("code", "state", F.coalesce("deducted", F.lit(False)).alias("deducted"), F.when(inactive, "inactive").otherwise("active").alias("tag"))


def balance_sets(status: DataFrame, final: DataFrame, deductions: Sequence[DataFrame]) -> DataFrame:
    """expected = status without all deductions, against final: code and side ('missing in final' or 'unexpected in final')."""
    expected = status.select("code").distinct()
    for d in deductions:
        expected = expected.subtract(d.select("code"))
    got = final.select("code").distinct()
    return expected.subtract(got).withColumn("side", F.lit("missing in final")).unionByName(got.subtract(expected).withColumn("side", F.lit("unexpected in final")))


def balance_summary(status: DataFrame, final: DataFrame, deductions: Mapping[str, DataFrame]) -> DataFrame:
    """(metric, value) of balance_sets(): the codes of status and final, those of status in each deduction and in any, expected, both differences, and sets_match (1 or 0)."""
    flag = lambda df, name: df.select("code").distinct().select("code", F.lit(True).alias(name))
    rows = flag(status, "status").join(flag(final, "final"), "code", "full")
    names = {f"d{k}": name for k, name in enumerate(deductions)}
    for c, df in zip(names, deductions.values(), strict=True):
        rows = rows.join(flag(df, c), "code", "left")
    is_in = lambda c: F.coalesce(F.col(c), F.lit(False))
    deducted = reduce(or_, map(is_in, names), F.lit(False))
    expected = is_in("status") & ~deducted
    counts = {"status": is_in("status"), "final": is_in("final"), **{f"deducted: {name}": is_in("status") & is_in(c) for c, name in names.items()}, "deducted": is_in("status") & deducted, "expected": expected, "missing in final": expected & ~is_in("final"), "unexpected in final": is_in("final") & ~expected}
    one = rows.agg(*(F.count_if(x).alias(f"m{k}") for k, x in enumerate(counts.values())))
    metrics = [F.struct(F.lit(name).alias("metric"), F.col(f"m{k}").alias("value")) for k, name in enumerate(counts)]
    match = ((F.col(f"m{len(counts) - 2}") + F.col(f"m{len(counts) - 1}")) == 0).cast("long")
    return one.select(F.inline(F.array(*metrics, F.struct(F.lit("sets match").alias("metric"), match.alias("value")))))


def duplicate_keys(df: DataFrame, keys: Sequence[str], remark: str) -> DataFrame:
    """Keys with more than one row, and whether any of them has a 'special' remark."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.lower(remark).contains("special")), F.lit(False)).alias("special")).where("n > 1")


def join_unique(df: DataFrame, keys: Sequence[str], column: str, separator: str = " | ") -> DataFrame:
    """Distinct texts of a column in the order of their first rows; distinct ones are found before they are gathered."""
    firsts = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(*keys, column).agg(F.min("row_pos").alias("_p"))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", column))), lambda s: s[column]), separator).alias(column))


def article_differences(raw: DataFrame, aggregated: DataFrame, column: str) -> DataFrame:
    """Articles of one table that the other lacks, both ways."""
    a, b = raw.select(column).distinct(), aggregated.select(column).distinct()
    return a.subtract(b).withColumn("side", F.lit("raw only")).unionByName(b.subtract(a).withColumn("side", F.lit("aggregated only")))


def codes_in_codes(inner: DataFrame, outer: DataFrame, core: str) -> DataFrame:
    """Distinct (needle, text): codes of inner (needle) that hold a core and stand in a code of outer (text).

    Wherever a code stands in another, its first core stands there too, with the same characters after it. So a code is sought by its first core
    and up to CONTEXT characters after it, and a code that may hold it offers each of its cores, overlapping ones too, with every
    beginning of what follows. Codes that only share a core do not meet.
    """
    both = rf"(?s)(?={core}(.{{0,{CONTEXT}}}))"
    found = lambda c: F.arrays_zip(F.regexp_extract_all(c, F.lit(both), F.lit(1)).alias("core"), F.regexp_extract_all(c, F.lit(both), F.lit(2)).alias("after"))
    own = inner.select("needle").distinct().select("needle", F.get(found("needle"), F.lit(0)).alias("x")).where("x is not null").select("needle", "x.core", "x.after")
    all_of = outer.select("text").distinct().select("text", F.explode(found("text")).alias("x"))
    begins = all_of.select("text", "x.core", F.explode(F.expr("transform(sequence(0, length(x.after)), n -> substring(x.after, 1, n))")).alias("after"))
    # merged, as are all joins of codes: their sizes are guessed from compressed files and before the explosion, and a side that looks small would go whole through the driver
    return own.join(begins.hint("merge"), ["core", "after"]).where(F.col("text").contains(F.col("needle"))).select("needle", "text").distinct()


def hierarchical_match(base: DataFrame, comp: DataFrame, core: str = r"(\d[A-Z]{3}\d{2}[A-Z]{2}\d{3})") -> DataFrame:
    """Base rows (row_pos, code, article, qty, cut_length) against comp rows whose code contains theirs or is contained in it.

    Levels: NO_KKS_MATCH, ARTICLE_MISMATCH, QTY_MISMATCH, CUT_LENGTH_MISMATCH, EXACT, MULTIPLE. Null articles and quantities equal nothing, null cut
    lengths equal each other. Distinct codes meet, by cores (one group in the pattern) or, where the contained one has none, by their pieces;
    then each base code has a histogram of its partners' (article, qty, cut_length), and rows are judged by sums over it: no two rows meet.
    """
    own, others = (staged(df.select("code").where("code is not null").distinct(), "codes") for df in (base, comp))

    def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
        needles, texts = inner.select(F.col("code").alias("needle")), outer.select(F.col("code").alias("text"))
        bare = needles.where(~F.col("needle").rlike(core))
        found = codes_in_codes(needles, texts, core)
        return found if bare.isEmpty() else found.union(contained_pairs(bare, texts))

    up = contained(own, others).select(F.col("needle").alias("code"), F.col("text").alias("partner"))
    down = contained(others, own).select(F.col("text").alias("code"), F.col("needle").alias("partner"))
    cells = ["article", "qty", "cut_length"]
    weights = comp.groupBy(F.col("code").alias("partner"), *cells).agg(F.count("*").alias("w"))
    partners = up.union(down).distinct().join(weights.hint("merge"), "partner").groupBy("code", *cells).agg(F.sum("w").alias("w"))
    asked = base.where("code is not null").select("code", *cells).distinct().withColumn("w", F.lit(0).cast("long")).withColumn("asked", F.lit(True))
    every = partners.withColumn("asked", F.lit(False)).unionByName(asked)
    equal = F.when(F.col("article").isNotNull(), F.col("w"))
    full = F.when(F.col("article").isNotNull() & F.col("qty").isNotNull(), F.col("w"))
    n = [F.coalesce(F.sum(w).over(Window.partitionBy("code", *cells[:k])), F.lit(0)) for k, w in enumerate((F.col("w"), equal, full, full))]
    level = F.when(n[0] == 0, "NO_KKS_MATCH").when(n[1] == 0, "ARTICLE_MISMATCH").when(n[2] == 0, "QTY_MISMATCH").when(n[3] == 0, "CUT_LENGTH_MISMATCH").when(n[3] == 1, "EXACT").otherwise("MULTIPLE")
    judged = every.withColumn("level", level).where("asked").select(*(F.col(c).alias(f"j_{c}") for c in ("code", *cells)), "level")
    same = [F.col(c).eqNullSafe(F.col(f"j_{c}")) for c in ("code", *cells)]
    return base.join(judged.hint("merge"), reduce(and_, same), "left").select("row_pos", "code", F.coalesce("level", F.lit("NO_KKS_MATCH")).alias("level"))
