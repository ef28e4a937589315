"""Quality rules: text statistics, and a decision list over them learned by sequential covering.

learn_rules() grows one conjunction of thresholds at a time on two thirds of the labelled rows (the literal with the best
FOIL gain is added until the rule covers no good row or is long enough), prunes it to the prefix that does best on the other
third, keeps it if it is precise enough there, and goes on with the rows that no rule covers yet. Counting is done by Spark
over all labelled rows: each step is one aggregation to (statistic, threshold) counts, whose size does not depend on the data.
The result is an ordered list of readable rules that become one CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import small_batches, staged
from .words import Words, codes, slices

MIN_WORDS = 50
#: Share of words in repeated three-word windows, in hundredths, above which a text fails.
MAX_REPEATED = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words")


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[edges])


def _counts(part: Words) -> np.ndarray:
    """One column of COUNTS for each row of the part."""
    data, edges = part.data, part.row_bytes
    rows = len(edges) - 1
    numbers = part.numbers()
    words = np.diff(part.row_words)
    row = np.repeat(np.arange(rows), words)
    heads = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, part.starts, 1)
    np.add.at(in_word, part.ends, -1)
    in_word = np.cumsum(in_word)[:-1] > 0
    lines = [[x for x in text.split(b"\n") if x.strip()] for text in part.rows()]  # strip() of bytes takes the same six characters
    n_lines = np.array([len(x) for x in lines], np.int64)
    n_dup = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    # words in three-word windows that the row holds twice
    repeated = np.zeros(len(numbers), bool)
    inside = np.flatnonzero(row[2:] == row[:-2])
    if len(inside):
        grams = codes(row[inside], numbers[inside], numbers[inside + 1], numbers[inside + 2])
        _, back, seen = np.unique(grams, return_inverse=True, return_counts=True)
        twice = inside[seen[back] > 1]
        for k in range(3):
            repeated[twice + k] = True
    first = np.unique(codes(row, numbers), return_index=True)[1]
    return np.stack([
        words, _per_row(heads & in_word, edges), _per_row(_SYMBOL[data], edges), n_dup, np.bincount(row[repeated], minlength=rows),
        n_lines, _per_row(_UPPER[data], edges), _per_row(_MARK[data], edges), np.bincount(row[first], minlength=rows),
    ])


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch with its first column, the text to count, replaced by a struct of counts."""
    for batch in batches:
        found = [_counts(part) for part in slices(batch.column(0))]
        counts = np.concatenate(found, axis=1) if found else np.zeros((len(COUNTS), 0), np.int64)
        struct = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in counts], list(COUNTS))
        yield pa.RecordBatch.from_arrays([struct, *batch.columns[1:]], ["counts", *batch.schema.names[1:]])


def with_statistics(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The struct `counts` of each row's text (null: empty), then the given columns of docs under c0, c1, ..."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(text).alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    schema = f"counts struct<{', '.join(f'{c}: long' for c in COUNTS)}>, " + ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(given.schema.fields[1:]))
    return given.mapInArrow(_with_counts, schema)


def features() -> dict[str, Column]:
    """The statistics that rules may test, as expressions over the struct `counts`."""
    c = {k: F.col(f"counts.{k}").cast("double") for k in COUNTS}
    part = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return {
        "n_words": c["n_words"], "mean_word_length": part(c["word_chars"], c["n_words"]), "symbol_share": part(c["n_symbols"], c["word_chars"]),
        "dup_line_share": part(c["n_dup_lines"], c["n_lines"]), "repeat_share": part(c["n_repeat_words"], c["n_words"]), "upper_share": part(c["n_upper"], c["word_chars"]),
        "mark_share": part(c["n_marks"], c["word_chars"]), "distinct_share": part(c["n_distinct_words"], c["n_words"]),
    }


def base_failed() -> Column:
    n = F.col("counts.n_words")
    return (n < MIN_WORDS) | (100 * F.col("counts.n_repeat_words") > MAX_REPEATED * n)


@dataclass(frozen=True)
class Literal:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.statistic]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row (from 1), null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(holds(rule), k).otherwise(out)
    return out


def learn_rules(labelled: DataFrame, max_rules: int = 8, max_literals: int = 3, thresholds: int = 24, min_precision: float = 0.97, min_covered: int = 10) -> list[Rule]:
    """Rules that reject bad rows. labelled: counts, good (boolean), key (any type, decides the split).

    No rows, or rows of one class only, give no rules. Ties between literals go to the first statistic and threshold.
    """
    names = list(features())
    rows = labelled.where("good is not null").select("counts", "good", (F.pmod(F.xxhash64("key"), F.lit(3)) > 0).alias("grow"), *(x.alias(f"f_{n}") for n, x in features().items()))
    rows = staged(rows, "labelled")
    cuts = [sorted(set(q)) for q in rows.approxQuantile([f"f_{n}" for n in names], [k / thresholds for k in range(thresholds)], 1 / (4 * thresholds))]
    if not any(cuts):
        return []
    # the number of thresholds that a value exceeds; literal "> cut k" holds from bin k + 1 on
    binned = [sum(((F.col(f"f_{n}") > c).cast("int") for c in cut), F.lit(0)) for n, cut in zip(names, cuts, strict=True)]
    rows = rows.withColumn("bins", F.array(*binned)).cache()
    counted = (F.sum((~F.col("good")).cast("long")).alias("bad"), F.sum(F.col("good").cast("long")).alias("good"))
    try:
        rules: list[Rule] = []
        while len(rules) < max_rules:
            left = rows.where(verdict(rules).isNull())
            rule: Rule = ()
            while len(rule) < max_literals:
                per = left.where(F.col("grow") & holds(rule)).select("good", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(*counted).collect()
                literal, pure = _best_literal([(r["f"], r["bin"], r["bad"], r["good"]) for r in per], names, cuts)
                if literal is None:
                    break
                rule = (*rule, literal)
                if pure:
                    break
            if not rule:
                break
            prefixes = [rule[: k + 1] for k in range(len(rule))]
            sums = [F.sum((holds(p) & (F.col("good") == g)).cast("long")).alias(f"{'good' if g else 'bad'}{k}") for k, p in enumerate(prefixes) for g in (False, True)]
            seen = left.where(~F.col("grow")).agg(*sums).first()
            value = [((seen[f"bad{k}"] or 0) - (seen[f"good{k}"] or 0)) / max(1, (seen[f"bad{k}"] or 0) + (seen[f"good{k}"] or 0)) for k in range(len(prefixes))]
            k = int(np.argmax(value))
            bad, good = seen[f"bad{k}"] or 0, seen[f"good{k}"] or 0
            if bad + good < min_covered or bad < min_precision * (bad + good):
                break
            rules.append(prefixes[k])
        return rules
    finally:
        rows.unpersist()


def _best_literal(counts: list[tuple[int, int, int, int]], names: list[str], cuts: list[list[float]]) -> tuple[Literal | None, bool]:
    """The literal of the best FOIL gain, and whether it leaves no good row."""
    best, found, pure = 1e-9, None, False
    for f, (name, cut) in enumerate(zip(names, cuts, strict=True)):
        bad, good = np.zeros(len(cut) + 1), np.zeros(len(cut) + 1)
        for g, b, x, y in counts:
            if g == f:
                bad[b], good[b] = x, y
        p, n = bad.sum(), good.sum()
        if not p or not n:
            return None, False
        below = np.cumsum(bad)[:-1], np.cumsum(good)[:-1]
        for above, (x, y) in ((True, (p - below[0], n - below[1])), (False, below)):
            for k in range(len(cut)):
                if x[k] > 0:
                    gain = x[k] * (math.log2(x[k] / (x[k] + y[k])) - math.log2(p / (p + n)))
                    if gain > best:
                        best, found, pure = gain, Literal(name, above, cut[k]), y[k] == 0
    return found, pure


def fitted_rules(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from statistics (counts, c0 = doc_id) and labels (doc_id, quality); rows that the base rejects teach nothing."""
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    known = statistics.where(~base_failed()).join(given, F.col("c0") == given["doc_id"])
    return learn_rules(known.select("counts", "good", F.col("doc_id").alias("key")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, rule (number of the rule that rejects it, or null), kept.

    docs: doc_id, text (null: no words). labels: doc_id, quality (0 bad), rows with nulls ignored, of contradicting rows the worst
    counts; no labels give no rules. Texts without words fail the base. Other columns are ignored; repeated rows come back as often.
    """
    statistics = staged(with_statistics(docs, ["doc_id"]), "statistics")
    rules = fitted_rules(statistics, labels)
    rule = F.when(~base_failed(), verdict(rules))
    out = statistics.select(F.col("c0").alias("doc_id"), *(F.col(f"counts.{c}").alias(c) for c in COUNTS), base_failed().alias("base_failed"), rule.alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base and the learned rules keep, with all their columns. The texts are not shuffled."""
    rules = fitted_rules(staged(with_statistics(docs, ["doc_id"]), "statistics"), labels)
    kept = with_statistics(docs, docs.columns).where(~base_failed() & verdict(rules).isNull())
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
