"""Grouping of spelling variants by an index of variable-length grams.

Two words are near if one code point inserted, deleted or replaced turns one into the other. Near words are found so:

* Gram dictionary. Words stand between two marks, so that their ends are told apart and have as many grams as their middle.
  Substrings of GRAM_MIN to GRAM_MAX code points are counted over all words, and a longer gram is in the dictionary only
  if the gram without its last code point is too frequent to be selective. "Too frequent" is a share of all gram places, so there are at
  most FREQUENT_SHARE such grams of each length, each with one extension for each letter of the alphabet: the dictionary's size has a bound that no
  corpus moves, and only it is collected and broadcast.
* Decomposition. At each place of a word the longest dictionary gram is taken (GRAM_MIN code points where there is none); grams that
  lie inside an earlier one are dropped.
* Affected grams. For each possible edit, affected() bounds how many of a word's grams the edit can destroy: those over the edited place,
  those to its left that a longer match across the place could swallow, and those to its right that a gram across the place could
  swallow. A near pair shares at least as many grams, in order, as either word has beyond its bound.
* List merging. If a word's bound leaves T grams, the least frequent (all - T + 1) grams of both words have one in common, so only these
  short lists are merged, and the frequent grams' lists are not read. A gram that the edit leaves whole lies left or right of it, and
  then the whole text on its outer side is equal too, so a list is keyed by the gram with that side's text. Two words whose
  bounds leave nothing (few long grams) are merged by the words less one code point instead; so nothing is lost.
* Verification by edit distance over code points.

Words of more than LONG_WORD code points meet by the digests of their halves, so that no work grows with the square of a word's length.
A word has at most about 90 * (2 * length + 1) near words, so the pairs grow with the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import small_batches, staged
from .words import text_column

#: Least length of a word in code points, least number of its occurrences, and how many times more frequent its form has to be.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: One (document, run) in DAMAGED loses a code point before words are counted.
DAMAGED = 199
GRAM_MIN, GRAM_MAX = 2, 4
#: A gram that takes more than one in FREQUENT_SHARE of all gram places of its length is extended.
FREQUENT_SHARE = 1024
#: Words of more code points than this meet by their halves: one edit leaves the first or the last half of a word as it is.
LONG_WORD = 64
#: Bytes of text looked at together, and bytes above which a run's checksum is made on its own.
_PIECE, _LONG_RUN = 1 << 20, 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _crc_table()


def _checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray, heads: list[bytes]) -> np.ndarray:
    """crc32 of heads[row] + data[start:stop] for each run, eight bits of all runs at a time."""
    state = ~np.array([crc32(h) for h in heads], np.uint32)[row]
    todo = np.flatnonzero(stop - start <= _LONG_RUN)
    at, end = start[todo], stop[todo]
    while len(todo):
        s = state[todo]
        state[todo] = _CRC[(s ^ data[at]) & 255] ^ (s >> np.uint32(8))
        at = at + 1
        more = at < end
        todo, at, end = todo[more], at[more], end[more]
    state = ~state
    for k in np.flatnonzero(stop - start > _LONG_RUN).tolist():
        state[k] = crc32(data[start[k] : stop[k]].tobytes(), crc32(heads[row[k]]))
    return state


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about _PIECE bytes each."""
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PIECE, "right")) - 1)
        yield row, stop
        row = stop


def _piece_words(data: np.ndarray, edges: np.ndarray, ids: list) -> tuple[pa.Array, list[bytes]]:
    """The undamaged words of some rows, and the damaged ones; of at least MIN_LENGTH code points."""
    lead = data == 0xC3  # with the byte after it the code points from U+00C0 to U+00FF
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    heads = edges[:-1][np.diff(edges) > 0]
    begin[heads] = letter[heads]
    end[heads[1:] - 1] = letter[heads[1:] - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    leads = np.append(0, np.cumsum(lead))
    size = (stop - start) - (leads[stop] - leads[start])
    some = size >= MIN_LENGTH
    start, stop, size = start[some], stop[some], size[some]
    data = _LOWER[data]
    row = np.searchsorted(edges, start, "right") - 1
    checks = _checksums(data, start, stop, row, [f"{'' if i is None else i}:".encode() for i in ids])
    hit = checks % DAMAGED == 0
    damaged = []
    for k in np.flatnonzero(hit & (size > MIN_LENGTH)).tolist():
        word = data[start[k] : stop[k]].tobytes().decode()
        place = int(checks[k]) % len(word)
        damaged.append((word[:place] + word[place + 1 :]).encode())
    start, stop = start[~hit], stop[~hit]
    length = stop - start
    edge = np.append(0, np.cumsum(length))
    raw = data[np.repeat(start - edge[:-1], length) + np.arange(edge[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)]), damaged


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), text_column(batch.column(1))
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        found = []
        for row, stop in _pieces(offsets):
            words, damaged = _piece_words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], ids[row:stop])
            found += [words, pa.array(damaged, pa.large_binary())]
        counts = pa.chunked_array(found, pa.large_binary()).value_counts()
        yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.large_string()), counts.field("counts")], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of docs (doc_id, text) of at least MIN_LENGTH code points that occur MIN_COUNT times or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. If the crc32 of "<doc_id>:<run>" (a null doc_id gives
    nothing before the colon) is a multiple of DAMAGED, the run loses the code point at crc32 % length.
    """
    small_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def gram_dictionary(words: DataFrame) -> list[str]:
    """The grams of more than GRAM_MIN code points whose parent (one code point shorter) is frequent among all words."""
    places = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - (GRAM_MIN - 1))).alias("p"))
    # at the end of a word the longer substrings are cut short; they are not grams of their length
    grams = places.select(F.explode(F.expr(f"transform(filter(sequence({GRAM_MIN}, {GRAM_MAX}), n -> p + n - 1 <= length(word)), n -> substring(word, p, n))")).alias("gram"))
    counts = staged(grams.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    total = counts.where(F.length("gram") == GRAM_MIN).agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") * FREQUENT_SHARE > total).select(F.col("gram").alias("parent"))
    longer = counts.where(F.length("gram") > GRAM_MIN).withColumn("parent", F.expr("substring(gram, 1, length(gram) - 1)"))
    return [r[0] for r in longer.join(F.broadcast(frequent), "parent", "left_semi").select("gram").collect()]


class Grams:
    """Decomposition of words into the variable-length grams of a dictionary, and bounds of what one edit can change."""

    def __init__(self, dictionary: list[str]):
        self.grams = frozenset(dictionary)
        self.prefixes = frozenset(g[:n] for g in self.grams for n in range(1, len(g)))  # proper ones
        self.inner = frozenset(g[a:b] for g in self.grams for a in range(1, len(g)) for b in range(a + GRAM_MIN, len(g) + 1))  # not from the start

    def of(self, word: str) -> list[tuple[int, int]]:
        """The grams of a word as (begin, stop), ascending in both."""
        out, reach, n = [], 0, len(word)
        for p in range(n - GRAM_MIN + 1):
            stop = p + GRAM_MIN
            for e in range(min(p + GRAM_MAX, n), stop, -1):
                if word[p:e] in self.grams:
                    stop = e
                    break
            if stop > reach:
                out.append((p, stop))
                reach = stop
        return out

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The greatest number of a marked word's grams that one edit can change or drop.

        An edit between left (what stands before it ends there) and right (what stands after it begins there) leaves a gram alone
        if it ends at left or before and no match that starts at its begin or before it can reach over left, or if it begins at
        right or later and no gram that starts before right can reach to its end.
        """
        n = len(word)
        low = []  # for each end of the left part the first place from which a dictionary gram could reach over it
        high = []  # for each begin of the right part the last end to which a gram from before it could reach
        for i in range(n + 1):
            p = max(0, i - GRAM_MAX + 1)
            while p < i and word[p:i] not in self.prefixes:
                p += 1
            low.append(p)
            e = i
            while e < min(n, i + GRAM_MAX - 1) and (e + 1 - i < GRAM_MIN or word[i : e + 1] in self.inner):
                e += 1
            high.append(e)
        most = 0
        for left in range(1, n):  # the marks at both ends stay
            for right in (left, left + 1):  # an insertion, then a deletion or replacement
                if right < n:
                    alone = sum((e <= left and p < low[left]) or (p >= right and e > high[right]) for p, e in grams)
                    most = max(most, len(grams) - alone)
        return most


def _keys(dictionary) -> callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dictionary.value)
        for batch in batches:
            words, texts, spans, spare = batch.column(0).to_pylist(), [], [], []
            for word in words:
                own = grams.of(word)
                texts.append([word[p:e] for p, e in own])
                spans.append([p for p, _ in own])
                spare.append(len(own) - grams.affected(word, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), pa.array(spare, pa.int32())], ["word", "grams", "begins", "spare"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a before b: all pairs of different words at edit distance one. words (word) holds no word twice."""
    spark = words.sparkSession
    long = words.where(F.length("word") >= LONG_WORD).select("word", F.explode(F.array_distinct(F.expr("transform(array(-1, 0, 1), k -> (length(word) + k) div 2)"))).alias("half"))
    halves = F.array(F.concat(F.lit("<"), F.expr("sha2(substring(word, 1, half), 256)")), F.concat(F.lit(">"), F.expr("sha2(substring(word, length(word) - half + 1), 256)")))
    long = long.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("word"), F.explode(halves).alias("key"), F.col("half").cast("string").alias("gram"))
    words = words.where(F.length("word") <= LONG_WORD).select(F.concat(F.lit("^"), "word", F.lit("$")).alias("word"))
    dictionary = spark.sparkContext.broadcast(gram_dictionary(words))
    split = staged(words.mapInArrow(_keys(dictionary), "word string, grams array<string>, begins array<int>, spare int"), "word-grams")
    counts = split.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    placed = split.select("word", "spare", F.explode(F.arrays_zip("grams", "begins")).alias("g")).select("word", "spare", F.col("g.grams").alias("gram"), F.col("g.begins").alias("p"))
    ranked = placed.join(counts, "gram").groupBy("word", "spare").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "p"))).alias("g"))
    short = ranked.select("word", F.explode(F.expr("slice(g, 1, size(g) - greatest(spare, 1) + 1)")).alias("g"))
    # text left of the gram's end, or right of its begin: equal in both words, as the only edit lies on the other side
    sides = F.array(F.concat(F.lit("<"), F.expr("substring(word, 1, g.p + length(g.gram))")), F.concat(F.lit(">"), F.expr("substring(word, g.p + 1)")))
    lists = short.select("word", F.explode(sides).alias("key"), F.col("g.gram").alias("gram"))
    # a bound that leaves nothing: these words meet by what is left after one code point is deleted
    bare = split.where("spare <= 0").select("word", F.explode(F.expr("array_append(transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))), word)")).alias("key"), F.lit("").alias("gram"))
    lists = staged(lists.union(bare).union(long).distinct(), "gram-lists")
    left, right = lists.withColumnRenamed("word", "a"), lists.withColumnRenamed("word", "b")
    pairs = left.join(right, ["key", "gram"]).where("a < b and abs(length(a) - length(b)) <= 1").where(F.levenshtein("a", "b", 1) == 1)
    return pairs.select(*(F.expr(f"substring({c}, 2, length({c}) - 2)").alias(c) for c in ("a", "b"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms followed to the last, in steps that double."""
    jump = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = staged(jump.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of word_counts(docs): word, form, root, n, n_near, form_n.

    form is the near word with the largest n (ties: the smallest in code-point order) if that is at least FORM_RATIO times the word's own, else null;
    form_n its n; root the end of the chain of forms, the word itself if it has none (n grows along a chain, so it ends); n_near
    the number of near words. Null, empty and letterless texts have no words; every row of docs counts, also a repeated one;
    texts and runs may have any length. An empty table gives an empty table. Other columns of docs are not looked at.
    """
    words = staged(word_counts(docs), "words")
    pairs = staged(near_words(words), "near-words")
    both = pairs.union(pairs.select("b", "a")).join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), F.col("b").alias("form"))).alias("best"))
    out = words.join(best, "word", "left")
    is_form = -F.col("best.low") >= FORM_RATIO * F.col("n")
    out = out.select("word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.low")).alias("form_n"))
    out = staged(out, "word-forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
