"""Fuzzy matching of names: candidates by rare q-grams, then the exact ratio.

The ratio of two texts is 100 * 2 * LCS / (la + lb), rounded. A threshold gives the least LCS c of two lengths, so at most la - c characters of one and lb - c of the other
are not common; each of them breaks two bigrams of its own text and one of the other, which gives the least number of bigrams that both texts
have. So the rarest (all - least + 1) bigrams of two such texts have one in common, and only texts that share one of these meet. Texts so short, or thresholds so low, that the
bound leaves nothing meet by their rarest characters in the same way, of which they share c.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged

#: Suffixes that a match must not swap, and the least ratio of the name that takes its place (fixed values).
SUFFIXES, LEAST_REPAIRED = (" (S)", " (T)"), 70


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of an integer for each place of a, so a character of b costs a few operations."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Rounded 100 * 2 * LCS / (la + lb), 100 for two empty texts, null for a null."""
    out = [None if x is None or y is None else 100.0 if not x and not y else float(round(200 * common_length(x, y) / (len(x) + len(y)))) for x, y in zip(a, b, strict=True)]
    return pd.Series(out, dtype="float64")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of one and of two characters of each text; the second and later ones of a kind carry their number."""

    def of(text: str, q: int) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for k in range(len(text) - q + 1):
            g = text[k : k + q]
            seen[g] = n = seen.get(g, 0) + 1
            out.append(g if n == 1 else f"{g}{n}")
        return out

    for batch in batches:
        texts = batch.column(1).to_pylist()
        lists = [pa.array([of(t, q) for t in texts], pa.list_(pa.string())) for q in (1, 2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["project_id", "text", "g1", "g2"])


def _with_bounds(texts: DataFrame, threshold: float) -> DataFrame:
    """Distinct texts with their grams and the least numbers of them that any text within the threshold shares."""
    low = threshold - 0.5
    n = F.length("text")
    first, last = F.ceil(n * low / (200 - low) - 1e-9), F.floor(n * (200 - low) / low + 1e-9)
    common = lambda m: F.ceil(low * (n + m) / 200 - 1e-9)

    def bigrams(m: Column) -> Column:
        c = common(m)
        return F.greatest(n - 1 - 2 * (n - c) - (m - c), m - 1 - 2 * (m - c) - (n - c))

    out = texts.where("text <> ''").mapInArrow(_grams, f"project_id {texts.schema['project_id'].dataType.simpleString()}, text string, g1 array<string>, g2 array<string>")
    return out.withColumns({"least1": F.greatest(common(first), F.lit(1)), "least2": F.array_min(F.transform(F.sequence(first, last), bigrams))})


def _rarest(texts: DataFrame, often: DataFrame, kind: str) -> DataFrame:
    """(project_id, text, weak, gram): of each text the rarest grams that one in common has to be among."""
    least = F.col(f"least{kind}")
    each = texts.select("project_id", "text", "weak", least.alias("least"), F.explode(f"g{kind}").alias("gram")).join(often, ["project_id", "gram"], "left")
    ranked = each.groupBy("project_id", "text", "weak", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    return ranked.select("project_id", "text", "weak", F.explode(F.expr("slice(g, 1, greatest(size(g) - cast(least as int) + 1, 0)).gram")).alias("gram"))


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (project_id, a, b): texts of left and of right (project_id, text) that could reach the threshold (1 at least), among them all that do."""
    if threshold < 1:
        raise ValueError("a threshold of 1 at least")
    sides = []
    for texts in (left, right):
        bounds = _with_bounds(texts.where("text is not null").distinct(), threshold)
        sides.append(staged(bounds.withColumn("weak", F.col("least2") < 1), "grams"))
    found = []
    for kind in ("1", "2"):
        often = sides[1].select("project_id", F.explode(f"g{kind}").alias("gram")).groupBy("project_id", "gram").agg(F.count("*").alias("n"))
        strong = F.lit(kind == "1") | ~F.col("weak")
        a, b = (_rarest(s.where(strong), often, kind).withColumnsRenamed({"text": c, "weak": f"weak_{c}"}) for s, c in zip(sides, "ab", strict=True))
        if kind == "1":  # only pairs with a text whose bigrams say nothing
            met = a.where("weak_a").join(b, ["project_id", "gram"]).select("project_id", "a", "b").union(a.where("not weak_a").join(b.where("weak_b"), ["project_id", "gram"]).select("project_id", "a", "b"))
        else:
            met = a.join(b, ["project_id", "gram"]).select("project_id", "a", "b")
        found.append(met)
    empty = left.where("text = ''").join(right.where("text = ''").select("project_id").distinct(), "project_id").select("project_id", F.lit("").alias("a"), F.lit("").alias("b"))
    la, lb = F.length("a"), F.length("b")
    return found[0].union(found[1]).union(empty).distinct().where(200.0 * F.least(la, lb) >= (threshold - 0.5) * (la + lb))


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def fuzzy_candidates(targets: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Pairs (project_id, target, row_pos, name, ratio) that reach the threshold (1 at least).

    targets: project_id, target. candidates: project_id, row_pos, name. Names compare trimmed and in lower case, null ones as ''. Distinct texts meet in candidate_pairs(), so
    a name that comes often, or a project of many names, costs no more than its texts.
    """
    t = targets.select("project_id", "target", _plain("target").alias("a")).distinct()
    c = candidates.select("project_id", "row_pos", "name", _plain("name").alias("b"))
    pairs = candidate_pairs(t.select("project_id", F.col("a").alias("text")), c.select("project_id", F.col("b").alias("text")), threshold)
    near = pairs.withColumn("ratio", indel_ratio("a", "b")).where(F.col("ratio") >= threshold)
    return t.join(near, ["project_id", "a"]).join(c, ["project_id", "b"]).select("project_id", "target", "row_pos", "name", "ratio")


def _best(found: DataFrame) -> DataFrame:
    best = F.struct("ratio", (-F.col("row_pos")).alias("p"))
    return found.groupBy("project_id", "target").agg(F.max_by(F.struct("row_pos", "name"), best).alias("m"), F.max("ratio").alias("ratio")).select("project_id", "target", "m.*", "ratio")


def fuzzy_best_match(targets: DataFrame, candidates: DataFrame, threshold: float = 95, repair: bool = False) -> DataFrame:
    """Each target's candidate of the best ratio, the first one on ties.

    With repair, a match that swaps the suffixes (S) and (T) gives way to the best name with the target's own suffix and without the other, if one reaches LEAST_REPAIRED.
    """
    best = _best(fuzzy_candidates(targets, candidates, threshold))
    if not repair:
        return best
    best = staged(best, "matches")
    swapped = F.lit(None).cast("string")
    for own, other in (SUFFIXES, SUFFIXES[::-1]):
        swapped = F.when(F.col("target").contains(own) & F.col("name").contains(other) & ~F.col("name").contains(own), own).otherwise(swapped)
    wrong = best.withColumn("own", swapped).where("own is not null")
    out = best
    for own, other in (SUFFIXES, SUFFIXES[::-1]):
        here = candidates.where(F.col("name").contains(own) & ~F.col("name").contains(other))
        better = _best(fuzzy_candidates(wrong.where(F.col("own") == own).select("project_id", "target"), here, LEAST_REPAIRED))
        better = better.select("project_id", "target", F.struct("row_pos", "name", "ratio").alias("new"))
        old = F.struct("row_pos", "name", "ratio")
        out = out.join(better, ["project_id", "target"], "left").select("project_id", "target", F.coalesce("new", old).alias("x")).select("project_id", "target", "x.*")
    return out
