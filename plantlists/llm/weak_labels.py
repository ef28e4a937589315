"""Quality scores without hand-made labels: a weak-label model trains a hashed linear scorer.

1. Heuristic labellers vote good, bad or nothing on every document, from text statistics.
2. Spark counts the documents of each combination of votes; with LABELLERS labellers there are at most 3 ** LABELLERS
   combinations, whatever the corpus. Expectation-maximisation over these counts estimates the share of good documents and,
   for each labeller and class, how often it is right, and gives every combination a posterior.
3. The posteriors are the soft labels of a linear model over hashed byte trigrams and hashed votes. It is fitted by accelerated gradient descent on a sample of about
   TRAIN_ROWS documents, chosen by a hash of their ids; each step is one Spark pass that sums gradients by partition.
4. All documents are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import COUNTS, _counts
from .staging import small_batches, staged
from .words import Words, mix, slices

WIDTH = 1 << 13
#: Documents that the scorer is fitted on, about; the vote counts cover all.
TRAIN_ROWS = 8_000
STEPS = 40
RIDGE = 1e-5
#: The size of a vote's feature beside trigrams of length one.
VOTE = 0.5
#: Words below which shares say too little for a vote.
EVIDENCE = 20
#: (name, statistic, bad above or below, threshold of a bad vote, threshold of a good vote): fixed values of the heuristics.
LABELLERS = (
    ("symbols", "symbol_share", "above", 0.02, 0.002),
    ("repeats", "repeat_share", "above", 0.35, 0.1),
    ("capitals", "upper_share", "above", 0.3, 0.12),
    ("marks", "mark_share", "above", 0.12, 0.08),
    ("lines", "dup_line_share", "above", 0.25, 0.0),
    ("variety", "distinct_share", "below", 0.3, 0.5),
    ("length", "n_words", "below", 1, 50),
)


def _statistics(part: Words) -> dict[str, np.ndarray]:
    c = dict(zip(COUNTS, _counts(part).astype(np.float64), strict=True))
    share = lambda x, y: c[x] / np.maximum(c[y], 1)
    return {
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "distinct_share": share("n_distinct_words", "n_words"), "n_words": c["n_words"],
    }


def votes(part: Words) -> np.ndarray:
    """Votes of each row of the part as a number in base 3, first labeller first: 0 nothing, 1 good, 2 bad. No words: no votes but length's."""
    known = _statistics(part)
    out = np.zeros(len(part.row_words) - 1, np.int64)
    for _, statistic, side, bad, good in LABELLERS:
        x = known[statistic]
        is_bad, is_good = (x > bad, x <= good) if side == "above" else (x < bad, x >= good)
        told = (known["n_words"] >= EVIDENCE) | (statistic == "n_words")
        out = out * 3 + np.where(told, np.where(is_bad, 2, np.where(is_good, 1, 0)), 0)
    return out


def hashed(part: Words, codes: np.ndarray) -> np.ndarray:
    """Hashed features of each row: byte trigrams (square roots of counts, of length one together) and votes (VOTE each)."""
    rows = len(part.row_bytes) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    data = part.data.astype(np.uint64)
    if len(data) >= 3:
        slot = (mix(data[:-2] | (data[1:-1] << np.uint64(8)) | (data[2:] << np.uint64(16))) % np.uint64(WIDTH)).astype(np.int64)
        for r in range(rows):
            a, b = part.row_bytes[r], part.row_bytes[r + 1] - 2
            if b > a:
                x = np.sqrt(np.bincount(slot[a:b], minlength=WIDTH).astype(np.float32))
                out[r] = x / np.sqrt(np.float32(b - a))
    for k in range(len(LABELLERS)):
        vote = codes // 3**k % 3
        at = (mix((1 << 32) + k * 3 + vote.astype(np.uint64)) % np.uint64(WIDTH)).astype(np.int64)
        out[np.arange(rows), at] += VOTE
    return out


def fit_label_model(patterns: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """P(good) of each combination of votes, by expectation-maximisation from "bad if any labeller says so".

    Labellers vote independently given the class; one that votes is right with a probability that depends on the class, and
    whether it votes says nothing. Combinations without votes get the share of good documents.
    """
    if not patterns:
        return {}
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[c] for c in codes.tolist()], np.float64)
    digits = np.stack([codes // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], axis=1)
    good, bad = digits == 1, digits == 2
    lead = 3.0 - 4.0 * bad.sum(axis=1)  # at the start one bad vote outweighs all good ones: a text with one fault has no other as a rule
    posterior = 1 / (1 + np.exp(-lead))
    for _ in range(rounds):
        wg, wb = n * posterior, n * (1 - posterior)
        prior = (wg.sum() + 1) / (n.sum() + 2)
        right_good = ((wg @ good) + 2) / ((wg @ (good | bad)) + 3)  # says good of good ones
        right_bad = ((wb @ bad) + 2) / ((wb @ (good | bad)) + 3)
        odds = np.log(prior / (1 - prior)) + good @ np.log(right_good / (1 - right_bad)) + bad @ np.log((1 - right_good) / right_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return dict(zip(codes.tolist(), posterior.tolist(), strict=True))


def _votes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes(part) for part in slices(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["votes"])


def _with_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes(part) for part in slices(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["text", "votes"])


def fit_scorer(sample: DataFrame, posterior: dict[int, float]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on soft labels. sample: text, votes. A sample without rows gives zeros."""
    spark = sample.sparkSession
    w, ahead, b, ahead_b = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    texts = staged(sample.select("text", "votes"), "sample")

    def gradient(weights: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros(WIDTH), np.zeros(2)
            for batch in batches:
                for part in slices(batch.column(0)):
                    codes = batch.column(1).to_numpy()[part.first_row : part.first_row + len(part.row_bytes) - 1]
                    y = np.array([posterior.get(v, 0.5) for v in codes.tolist()])
                    x = hashed(part, codes)
                    p = 1 / (1 + np.exp(-(x @ weights.astype(np.float32) + bias)))
                    total += x.T @ (p - y).astype(np.float32)
                    sums += [(p - y).sum(), len(y)]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, sums]).tobytes()], pa.binary())], ["sums"])

        parts = [np.frombuffer(row["sums"]) for row in texts.mapInArrow(run, "sums binary").collect()]
        whole = np.sum(parts, axis=0) if parts else np.zeros(WIDTH + 2)
        return whole[:WIDTH], *whole[WIDTH:]

    small_batches(spark)
    rate = 4.0 / (2 + len(LABELLERS) * VOTE**2)  # the logistic loss bends by a quarter of the squared length of a row (and its bias) at most
    for k in range(STEPS):
        g, g_b, n = gradient(ahead, ahead_b)
        if not n:
            break
        new, new_b = ahead - rate * (g / n + RIDGE * ahead), ahead_b - rate * g_b / n
        momentum = k / (k + 3)
        ahead, ahead_b = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    return w, b


def scored(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, votes, posterior (of the label model), score (of the linear model), kept (score >= 0.5).

    votes is the combination of votes as a number in base 3. A null text is empty; texts without words are not kept. Rows with a null
    doc_id are scored like others. An empty table gives an empty table. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_votes_only, "votes long").groupBy("votes").agg(F.count("*").alias("n")).collect()
    posterior = fit_label_model({r["votes"]: r["n"] for r in counts})
    total = sum(r["n"] for r in counts)
    parts = 1 << 20
    take = parts if total <= train_rows else int(parts * train_rows / total)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < take).select("text").mapInArrow(_with_votes, "text string, votes long")
    weights, bias = fit_scorer(chosen.repartition(max(1, min(64, take * total // parts // 500))), posterior)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias, posterior))  # its size does not depend on the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, known = shared.value
        for batch in batches:
            code, score, some = [], [], []
            for part in slices(batch.column(1)):
                code.append(votes(part))
                score.append(1 / (1 + np.exp(-(hashed(part, code[-1]) @ w + b).astype(np.float64))))
                some.append(np.diff(part.row_words) > 0)
            code, score, some = (np.concatenate(x) if x else np.zeros(0) for x in (code, score, some))
            score = np.where(some.astype(bool), score, 0.0)
            columns = [batch.column(0).cast(pa.int64()), pa.array(code.astype(np.int64)), pa.array([known.get(int(c), 0.5) for c in code], pa.float64()), pa.array(score), pa.array(score >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "votes", "posterior", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes long, posterior double, score double, kept boolean")
