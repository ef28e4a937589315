"""Weight-balanced shipping batches. Weights are summed to working areas by Spark; the greedy steps work on a project's areas."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ranges import filled

NA_SECTION = "N/A"
#: Reasons for a batch (fixed texts).
BY_AREA, BY_ANCHOR, FIRST_ANCHOR, BY_SECTION, BY_WEIGHT = "Mapped by working area", "N/A anchored section batch", "N/A initial anchor on lightest batch", "Fallback by building section", "Fallback to overall lightest batch"


def _chunks(areas: list[tuple[str, str, float]], most: float) -> list[tuple[float, str, int, list[str]]]:
    """Chunks of sections, heavy ones first: a section is split so that none should pass the limit, areas going to the lightest chunk, heavy areas first."""
    out = []
    for section in sorted({s for _, s, _ in areas}):
        own = sorted(((w, a) for a, s, w in areas if s == section), key=lambda x: (-x[0], x[1]))
        bins: list[list] = [[0.0, []] for _ in range(max(1, math.ceil(sum(w for w, _ in own) / most) if most > 0 else 1))]
        for w, a in own:
            b = min(bins, key=lambda x: x[0])
            b[0] += w
            b[1].append(a)
        out += [(b[0], section, k, sorted(b[1])) for k, b in enumerate(bins, 1) if b[1]]
    return sorted(out, key=lambda c: (-c[0], c[1], c[2]))


def _assigned(areas: list[tuple[str, str, float]], n: int, tolerance: float) -> dict[str, int]:
    """The batch of each area. A chunk goes to the lightest batch that holds it, one of its section's first; numbers follow sections and areas."""
    most = sum(w for _, _, w in areas) / n * (1 + tolerance)
    weight = [0.0] * n
    held: list[list[str]] = [[] for _ in range(n)]
    sections: dict[str, set[int]] = {}
    for w, section, _, names in _chunks(areas, most):
        own = sorted(sections.get(section, ())) or list(range(n))
        fits = [b for b in own if weight[b] + w <= most] or ([b for b in range(n) if weight[b] + w <= most] if section in sections else []) or own
        b = min(fits, key=lambda k: (weight[k], k))
        weight[b] += w
        held[b] += names
        sections.setdefault(section, set()).add(b)
    of = {a: s for a, s, _ in areas}
    order = sorted((b for b in range(n) if held[b]), key=lambda b: (min(of[a] for a in held[b]), min(held[b]), b)) + [b for b in range(n) if not held[b]]
    return {a: k for k, b in enumerate(order, 1) for a in held[b]}


def split_batches(scope: DataFrame, n: int, tolerance: float = 0.1) -> DataFrame:
    """Scope (project_id, code, working_area, section, weight) with batch. Areas stay whole; a project's areas are one group."""
    areas = scope.groupBy("project_id", "working_area", "section").agg(F.sum("weight").alias("weight"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = _assigned([(a, s, float(w)) for a, s, w in zip(group["working_area"], group["section"], group["weight"].fillna(0.0), strict=True)], n, tolerance)
        return group.assign(batch=group["working_area"].map(found).astype("int64"))[["project_id", "working_area", "section", "weight", "batch"]]

    placed = areas.groupBy("project_id").applyInPandas(run, "project_id long, working_area string, section string, weight double, batch long")
    return scope.join(placed.select("project_id", "working_area", "section", "batch"), ["project_id", "working_area", "section"])


def overweight_areas(scope: DataFrame, n: int, tolerance: float = 0.1) -> DataFrame:
    """Areas that alone pass what a batch may weigh (total / n and the tolerance): project_id, working_area, weight, most."""
    areas = scope.groupBy("project_id", "working_area").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    most = areas.groupBy("project_id").agg((F.sum("weight") / n * (1 + tolerance)).alias("most"))
    return areas.join(most, "project_id").where("weight > most").select("project_id", "working_area", "weight", "most")


def area_summary(batched: DataFrame) -> DataFrame:
    """Weights by batch, section and working area, and the codes with and without a known weight."""
    known = F.col("weight").isNotNull()
    return batched.groupBy("project_id", "batch", "section", "working_area").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.count_if(known).alias("known"), F.count_if(~known).alias("missing"))


def in_area_order(rows: DataFrame, keys: Sequence[str] = ("project_id",), order: Sequence[str] = ("UHA", "UMA")) -> DataFrame:
    """Rows (section, working_area, code, ...) with their place (from 1) within keys: sections in the given order, then areas and codes in natural order."""
    by = [text.section_rank(F.col("section"), order), text.natural_key(F.col("working_area")), text.natural_key(F.col("code")), F.col("code")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def batch_summary(batched: DataFrame, n: int, tolerance: float = 0.1) -> DataFrame:
    """By batch: weight, areas, sections, codes, codes without weight, share of the target, and whether it keeps the tolerance."""
    g = batched.groupBy("project_id", "batch").agg(F.round(F.sum("weight"), 3).alias("weight"), F.countDistinct("working_area").alias("areas"), F.countDistinct("section").alias("sections"), F.countDistinct("code").alias("codes"), F.count_if(F.col("weight").isNull()).alias("no_weight"))
    total = batched.groupBy("project_id").agg((F.sum("weight") / n).alias("target"))
    return g.join(total, "project_id").withColumns({"target": F.round("target", 3), "within": F.col("weight") <= F.col("target") * (1 + tolerance)})


#: Rows that are left out of the batches, by words in any of their texts (fixed values), and the reason that is given.
DELETED, EXCLUDED_WORDS = "Deleted", {"BQ not exist": "bq not exist", "Solid handling not in GP": "solid handling support not in gp lot"}


def with_exclusions(missing: DataFrame, deleted: str | None = None, words: Mapping[str, str] = EXCLUDED_WORDS, but: Sequence[str] = ()) -> DataFrame:
    """Missing with exclusion: the reasons why a row stays out, joined by '; ', '' for none.

    A row is out if the boolean column `deleted` holds, or if any of its text columns has the words of a reason, in any case; reasons listed in `but` do not count.
    """
    texts = [f.name for f in missing.schema.fields if f.dataType.typeName() == "string"]
    masks = {DELETED: F.coalesce(F.col(deleted), F.lit(False))} if deleted else {}
    for reason, phrase in words.items():
        masks[reason] = reduce(or_, (F.coalesce(F.lower(c).contains(phrase.lower()), F.lit(False)) for c in texts), F.lit(False))
    return missing.withColumn("exclusion", F.concat_ws("; ", *(F.when(m, reason) for reason, m in masks.items() if reason not in but)))


def integrate_missing(missing: DataFrame, detail: DataFrame) -> DataFrame:
    """Missing codes (project_id, row_pos, code, working_area, section, weight) into the batches of detail (project_id, working_area, section, batch, weight).

    By working area, else the lightest batch of the section (for N/A the least one), else the lightest of all; weights run on in order of row_pos and compare to six
    places. Rows with a known area are placed by a join; only rows without one are placed one after another, and what the rows with an area add between
    two of them comes to the later one as sums by batch and section. Projects without batches get none.
    """
    area = detail.groupBy("project_id", "working_area").agg(F.min("batch").alias("area_batch"))
    weights = detail.groupBy("project_id", "batch").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"), F.collect_set("section").alias("sections"))
    lists = weights.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("batch", "w", "sections"))).alias("batches"))
    rows = missing.select("project_id", "row_pos", "code", "working_area", "section", "weight").join(area, ["project_id", "working_area"], "left")
    # each row with an area belongs to the next row without one
    open_row = F.when(F.col("area_batch").isNull(), F.col("row_pos"))
    rows = filled(rows, {"next": open_row}, [F.desc("row_pos"), F.col("area_batch").isNotNull()], ["project_id"])
    placed = rows.where("area_batch is not null")
    added = placed.where("next is not null").groupBy("project_id", "next", F.col("area_batch").alias("batch"), "section").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    added = added.groupBy("project_id", F.col("next").alias("row_pos")).agg(F.collect_list(F.struct("batch", "section", "w")).alias("added"))
    loose = rows.where("area_batch is null").join(added, ["project_id", "row_pos"], "left").join(lists, "project_id")
    schema = "project_id long, row_pos long, code string, batch long, reason string"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_pos")
        weight = {int(b["batch"]): float(b["w"]) for b in group["batches"].iloc[0]}
        sections: dict[str, set[int]] = {}
        for b in group["batches"].iloc[0]:
            for s in b["sections"]:
                sections.setdefault(s, set()).add(int(b["batch"]))
        light = lambda b: (round(weight[b], 6), b)
        out = []
        for r in group.itertuples():
            for x in r.added if r.added is not None else ():
                weight[int(x["batch"])] += float(x["w"])
                sections.setdefault(x["section"], set()).add(int(x["batch"]))
            own = sections.get(r.section, set())
            if r.section == NA_SECTION:
                batch, reason = (min(own), BY_ANCHOR) if own else (min(weight, key=light), FIRST_ANCHOR)
            elif own:
                batch, reason = min(own, key=light), BY_SECTION
            else:
                batch, reason = min(weight, key=light), BY_WEIGHT
            weight[batch] += 0.0 if pd.isna(r.weight) else float(r.weight)
            sections.setdefault(r.section, set()).add(batch)
            out.append((r.project_id, r.row_pos, r.code, batch, reason))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    by_area = placed.select("project_id", "row_pos", "code", F.col("area_batch").cast("long").alias("batch"), F.lit(BY_AREA).alias("reason"))
    return by_area.unionByName(loose.drop("next", "area_batch").groupBy("project_id").applyInPandas(run, schema))
