"""Text search: boolean queries, keyword screening with context and scores, cells, messages, subjects."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def _term(c: Column, term: str, case_sensitive: bool) -> Column:
    """term* is a substring, a bare term a whole word."""
    flag = "" if case_sensitive else "(?iu)"
    if term.endswith("*"):
        return c.rlike(f"{flag}{_literal(term[:-1])}")
    return c.rlike(rf"{flag}(?U)\b{_literal(term)}\b")


def _literal(s: str) -> str:
    return "".join(re.escape(ch) if not ch.isalnum() else ch for ch in s)


def query_terms(query: str) -> list[str]:
    """All terms of a query in order, operators and parentheses left out."""
    return [t for t in re.findall(r"\(|\)|[^\s()]+", query) if t not in ("(", ")", "AND", "OR", "NOT")]


def _over_terms(query: str, term: Callable[[str], Column]) -> Column:
    """The condition of a query over the conditions of its terms, by the rules of boolean_match()."""
    tokens = re.findall(r"\(|\)|[^\s()]+", query)
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = single()
        while at < len(tokens) and tokens[at] == "AND":
            at += 1
            out = out & single()
        return out

    def single() -> Column:
        nonlocal at
        if at >= len(tokens):
            return F.lit(False)
        token = tokens[at]
        at += 1
        if token == "NOT":
            return ~single()
        if token == "(":
            out = either()
            while at < len(tokens) and tokens[at] != ")":
                at += 1
            at += 1
            return out
        out = term(token)
        while at < len(tokens) and tokens[at] not in ("AND", "OR", "NOT", "(", ")"):
            at += 1  # terms that no operator joins
        return out

    return F.coalesce(either(), F.lit(False)) if tokens else F.lit(False)


def boolean_match(c: Column, query: str, case_sensitive: bool = False) -> Column:
    """Upper-case NOT before AND before OR, with parentheses. Of adjacent terms without an operator only the first counts. An empty query holds nowhere."""
    return _over_terms(query, lambda term: _term(c, term, case_sensitive))


def search_pages(pages: DataFrame, query: str, context: int = 50) -> DataFrame:
    """Documents (doc, page, text) whose whole text matches; on each of their pages the first hit of each term with its context.

    The query is read as C5 reads it, terms are sought on pages, and a term of the whole text is a term of some page. Pages of one document are
    gathered only as one flag for each term: whether some page has it. A query without terms gives no rows; a null text holds no term.
    """
    terms = query_terms(query)
    _over_terms(query, lambda term: terms.append(term) or F.lit(True))  # also operators that stand where a term is due
    flags = {t: f"_h{k}" for k, t in enumerate(dict.fromkeys(terms))}
    hits = pages.select("doc", "page", "text", *(F.coalesce(_term(F.col("text"), t, False), F.lit(False)).alias(h) for t, h in flags.items()))
    whole = hits.groupBy("doc").agg(F.count("*").alias("_pages"), *(F.bool_or(h).alias(h) for h in flags.values()))
    chosen = whole.where(_over_terms(query, lambda term: F.col(flags[term]))).select("doc")
    each = [F.struct(F.lit(t).alias("term"), F.col(h).alias("hit")) for t, h in flags.items()]
    each = F.array(*each).cast("array<struct<term: string, hit: boolean>>")
    found = hits.join(chosen, "doc", "left_semi").select("doc", "page", "text", F.explode(each).alias("x")).where("x.hit")
    bare = F.regexp_replace("x.term", r"\*$", "")
    start = F.instr(F.lower("text"), F.lower(bare))
    begin = F.greatest(start - context, F.lit(1))
    return found.select("doc", "page", F.col("x.term").alias("term"), F.col("text").substr(begin, start - begin + F.length(bare) + context).alias("context"))


def message_filter(messages: DataFrame, sender: str = "", recipient: str = "", terms: str = "", in_subject: bool = True, in_body: bool = True, date_from: str | None = None, date_to: str | None = None, attachment: str = "") -> DataFrame:
    """Messages (sender, recipient, subject, body, date, attachments) by filters where a comma is OR, a plus AND, and quotes hold a phrase together. Dates are inclusive."""

    def met(columns: Sequence[Column], asked: str) -> Column:
        out = F.lit(False)
        for group in re.findall(r'(?:"[^"]*"|[^,"])+', asked):
            all_of = F.lit(True)
            for word in re.findall(r'(?:"[^"]*"|[^+"])+', group):
                word = word.replace('"', "").strip().lower()
                if word:
                    any_of = F.lit(False)
                    for c in columns:
                        any_of = any_of | F.coalesce(F.lower(c).contains(word), F.lit(False))
                    all_of = all_of & any_of
            out = out | all_of
        return out

    keep = F.lit(True)
    if sender.strip():
        keep = keep & met([F.col("sender")], sender)
    if recipient.strip():
        keep = keep & met([F.col("recipient")], recipient)
    places = [F.col(c) for c, on in (("subject", in_subject), ("body", in_body)) if on]
    if terms.strip() and places:
        keep = keep & met(places, terms)
    if date_from:
        keep = keep & (F.to_date("date") >= F.lit(date_from).cast("date"))
    if date_to:
        keep = keep & (F.to_date("date") <= F.lit(date_to).cast("date"))
    if attachment.strip():
        wanted = [w.strip().lower() for w in attachment.split(",") if w.strip()]
        keep = keep & F.exists("attachments", lambda a: F.exists(F.array(*map(F.lit, wanted)), lambda w: F.lower(a).endswith(w)))
    return messages.where(keep)


def cell_hits(cells: DataFrame, term: str) -> DataFrame:
    """Cells (file, sheet, row, col, value) that hold the term, with their coordinates."""
    return cells.where(F.lower("value").contains(term.lower())).select("file", "sheet", text.coordinate(F.col("row"), F.col("col")).alias("coordinate"), "value")


def row_search(cells: DataFrame, term: str) -> DataFrame:
    """All cells of rows with a hit, each with the header (row 1) of its column."""
    rows = cells.where(F.lower("value").contains(term.lower())).select("file", "sheet", "row").distinct()
    header = cells.where("row = 1").select("file", "sheet", "col", F.col("value").alias("header"))
    return cells.join(rows, ["file", "sheet", "row"], "left_semi").join(header, ["file", "sheet", "col"], "left").select("file", "sheet", "row", "col", "header", "value")


def screen_documents(docs: DataFrame, required: Sequence[str], any_of: Sequence[str]) -> DataFrame:
    """Docs (doc, path, text) with a required word and at least one code: codes found, dates of path and text."""
    low = F.lower("text")
    word = F.lit(False)
    for w in required:
        word = word | low.contains(w.lower())
    codes = F.filter(F.array(*map(F.lit, any_of)), lambda x: F.col("text").contains(x))
    rows = docs.where(word).withColumn("codes", codes).where(F.size("codes") > 0)
    return rows.select("doc", F.array_join("codes", ", ").alias("codes"), F.array_join(F.array_distinct(F.concat(text.extract_dates(F.col("path")), text.extract_dates(F.col("text")))), ", ").alias("dates"))


_built: dict[tuple, tuple] = {}


def _automaton(rows: Sequence[tuple[str, str | None]], key: tuple) -> tuple:
    """The automaton of the keywords and each keyword's categories, built once in a worker."""
    if key not in _built:
        from ahocorasick import Automaton

        _built.clear()
        categories: dict[str, list] = {}
        for keyword, category in rows:
            categories.setdefault(keyword, []).append(category)
        automaton = Automaton()
        for keyword in categories:
            automaton.add_word(keyword, keyword)
        automaton.make_automaton()
        _built[key] = automaton, categories
    return _built[key]


def _screened(rows, key: tuple, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def page_hits(low: str, text: str) -> Iterator[tuple]:
        automaton, categories = _automaton(rows.value, key)
        free: dict[str, int] = {}
        tokens = starts = None
        for last, keyword in automaton.iter(low):
            position = last - len(keyword) + 1
            if position < free.get(keyword, 0):
                continue
            free[keyword] = last + 1
            if tokens is None:
                tokens = list(re.finditer(r"\S+", text, re.ASCII))
                starts = [t.start() for t in tokens]
            before = bisect_right(starts, position)
            context = " ".join(t.group() for t in tokens[max(before - words, 1) - 1 : before + words])
            for category in categories[keyword]:
                yield keyword, category, position, context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, (low, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                hits = list(page_hits(low, text)) if low else []
                row += [k] * len(hits)
                found += hits
            at = pa.array(row, pa.int32())
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            hits = [pa.array([h[c] for h in found], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *hits], ["doc", "page", "keyword", "category", "position", "context"])

    return run


def screen_keywords(pages: DataFrame, keywords: DataFrame, words: int = 10, most: int = 16_000_000) -> DataFrame:
    """One row per occurrence of a keyword (lower case) that does not overlap the one before of the same keyword: doc, page, keyword, category, position, context.

    One automaton of all keywords passes over a page once, however many there are. position counts characters from 0. The context is the word at
    the hit with `words` words on each side, from the page's own list of words. keywords: keyword, category; empty and null ones find nothing, a
    keyword of several categories gives a row for each. A task holds keywords of `most` characters at most; more are dealt into parts by a hash, and
    pages are read once for each part.
    """
    wanted = keywords.where("keyword <> ''").select("keyword", "category")
    size = wanted.agg(F.coalesce(F.sum(F.length("keyword") + 1), F.lit(0))).first()[0]
    parts = -(-size // most) or 1
    spark, low = pages.sparkSession, pages.select("doc", "page", F.lower("text").alias("low"), "text")
    types = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("doc", "page"))
    out = []
    for part in range(parts):
        here = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part)
        rows = spark.sparkContext.broadcast([tuple(r) for r in here.collect()])
        found = low.mapInArrow(_screened(rows, (spark.sparkContext.applicationId, rows._jbroadcast.id(), words), words), f"{types}, keyword string, category string, position long, context string")
        out.append(found)
    return reduce(DataFrame.union, out)


def page_keywords(matches: DataFrame) -> DataFrame:
    """All keywords found on a page (doc, page, keywords), sorted."""
    return matches.groupBy("doc", "page").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def page_statistics(matches: DataFrame) -> DataFrame:
    """By page: matches, distinct keywords, categories, score = matches + keywords / 2."""
    g = matches.groupBy("doc", "page").agg(F.count("*").alias("matches"), F.countDistinct("keyword").alias("unique_keywords"), F.array_join(F.sort_array(F.collect_set("category")), ", ").alias("categories"))
    return g.withColumn("score", F.col("matches") + F.col("unique_keywords") * 0.5)


def category_summary(matches: DataFrame) -> DataFrame:
    """By category: matches, distinct pages, matches a page."""
    g = matches.groupBy("category").agg(F.count("*").alias("matches"), F.countDistinct("doc", "page").alias("pages"))
    return g.withColumn("per_page", F.round(F.col("matches") / F.col("pages"), 2))


def top_keywords(matches: DataFrame, n: int = 10) -> DataFrame:
    """The n keywords of most matches, by name on ties."""
    return matches.groupBy("keyword").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "keyword").limit(n)


def high_scoring_pages(stats: DataFrame, least: float = 5.0) -> DataFrame:
    """Pages of score 5 or more that are among the best max(1, n // 5) of their document."""
    per = Window.partitionBy("doc")
    rank = F.row_number().over(per.orderBy(F.desc("score"), "page"))
    kept = stats.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(per)})
    return kept.where((F.col("score") >= least) & (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 5)))).drop("_r", "_n")


#: Kinds of subject prefixes (fixed patterns), in the order of the test.
SUBJECT_KINDS = (
    ("reply and gateway", r"(?i)^(?:FW|RE):\s*\[EXT\]\s*[^,]+,\s+[^/]+/[^/]+/\d+:"),
    ("reply", r"(?i)^(?:FW|RE):\s*[^,]+,\s+[^/]+/[^/]+/\d+:"),
    ("gateway", r"(?i)^\[EXT\]\s*[^,]+,\s+[^/]+/[^/]+/\d+:"),
    ("plain", r"^[^,]+,\s+[^/]+/[^/]+/\d+:"),
)


def subject_patterns(messages: DataFrame) -> DataFrame:
    """Subjects by kind of prefix, pair of codes and length of the number."""
    kind = F.lit("none")
    for name, pattern in reversed(SUBJECT_KINDS):
        kind = F.when(F.col("subject").rlike(pattern), name).otherwise(kind)
    part = lambda g: F.regexp_extract("subject", r",\s+([^/]+)/([^/]+)/(\d+):", g)
    return messages.groupBy(kind.alias("kind"), F.concat_ws("/", part(1), part(2)).alias("codes"), F.length(part(3)).alias("digits")).agg(F.count("*").alias("n"))
