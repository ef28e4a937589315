"""Secret spans in texts, and multipart credentials linked by an interval join within scopes.

Base spans are plain patterns (assign, access, hex). The method adds weak candidates, which no pattern would justify alone:
an address (endpoint), a name given to a login (login), or a long mixed string (opaque). A weak candidate becomes a span only
if complementary parts stand in the same scope, no more than REACH code points away: an access identifier or login next to
a secret, an endpoint next to an identifier and a secret. Parts are rows, scopes are paragraphs, and candidates and parts meet in an
interval join by (document, scope, cell).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import packed_texts, small_batches, staged, unpacked

KINDS = ("assign", "access", "hex", "linked_login", "linked_secret", "linked_endpoint")
#: The farthest gap between two parts of one credential, in code points.
REACH = 300
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the same as a run that is then measured
_STARTS = ("passw", "secret", "token", "api")
_LOGIN = re.compile(r"""(?:user(?:name|_?id)?|login|account|client_?id|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.IGNORECASE | re.ASCII)
_LOGIN_STARTS = ("user", "login", "account", "client", "access_key_id")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}""", re.ASCII)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_ROLES = pa.list_(pa.struct([("role", pa.string()), ("kind", pa.string()), ("scope", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())]))


def _from_starts(pattern: re.Pattern, text: str, low: str, starts: tuple[str, ...]) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches of a pattern that begins with one of starts; substring search finds where to try."""
    at = []
    for s in starts:
        i = low.find(s)
        while i >= 0:
            at.append(i)
            i = low.find(s, i + 1)
    end = 0
    for i in sorted(at):
        if i >= end and (m := pattern.match(text, i)):
            end = m.end()
            yield m


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)  # keeps every position


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    low = _lower(text)
    out = [(m.start(), m.end(), 0) for m in _from_starts(_ASSIGN, text, low, _STARTS) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _hex_run(text):
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


_IN_HEX = np.zeros(256, bool)
_IN_HEX[list(b"0123456789abcdef")] = True
_IN_OPAQUE = np.zeros(256, bool)
_IN_OPAQUE[[b for b in range(128) if chr(b).isalnum() or chr(b) in "+/_-"]] = True


def _run(text: str, member: np.ndarray, least: int) -> bool:
    """Whether some run of member bytes has the least length: runs cannot miss every least-th byte."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not member[raw[least - 1 :: least]].any():
        return False
    gaps = np.concatenate([[-1], np.flatnonzero(~member[raw]), [len(raw)]])
    return bool((np.diff(gaps) > least).any())


def _hex_run(text: str) -> bool:
    return _run(text, _IN_HEX, 24)


def _parts(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Parts of credentials: base spans with their roles, and weak candidates outside of base spans. None without a weak one."""
    low = _lower(text)
    weak = [("login", m.start(1), m.end(1)) for m in _from_starts(_LOGIN, text, low, _LOGIN_STARTS)]
    if "://" in text:
        weak += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    if _run(text, _IN_OPAQUE, 20):
        weak += [("secret", m.start(), m.end()) for m in _OPAQUE.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
    taken = _reach(base)
    weak = [w for w in weak if not _overlaps(taken, w[1], w[2])]
    if not weak:
        return []
    breaks = [m.end() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    scope = lambda at: int(np.searchsorted(breaks, at, "right"))
    out = [{"role": "login" if kind == "access" else "secret", "kind": None, "scope": scope(a), "begin": a, "stop": b} for a, b, kind in base]
    return out + [{"role": r, "kind": f"linked_{r}", "scope": scope(a), "begin": a, "stop": b} for r, a, b in weak]


def _reach(base: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts of the spans in order, and the farthest end of the spans up to each."""
    taken = sorted((a, b) for a, b, _ in base)
    return [a for a, _ in taken], list(accumulate((b for _, b in taken), max))


def _overlaps(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether some span of _reach() begins before b and ends after a; spans may nest to any depth."""
    starts, ends = taken
    k = bisect_left(starts, b)
    return k > 0 and ends[k - 1] > a


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256
    from zlib import crc32

    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(1)]
        base = [base_spans(t) for t in texts]
        count = lambda kind: pa.array([sum(k == kind for _, _, k in b) for b in base], pa.int64())  # noqa: E731,B023
        joined = [",".join(f"{k}:{a}:{e}" for a, e, k in b) for b in base]
        columns = [
            batch.column(0).cast(pa.int64()), pa.array([crc32(t.encode()) - (1 << 31) for t in texts], pa.int32()), count("assign"), count("access"), count("hex"),
            pa.array(joined, pa.string()), pa.array([sha256(j.encode()).hexdigest() for j in joined], pa.string()), pa.array([_parts(t, b) for t, b in zip(texts, base, strict=True)], _ROLES),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "check", "n_assign", "n_access", "n_hex", "base", "base_sha256", "parts"])


_SCANNED = "doc_id long, check int, n_assign long, n_access long, n_hex long, base string, base_sha256 string, parts array<struct<role: string, kind: string, scope: long, begin: long, stop: long>>"


def linked_parts(parts: DataFrame) -> DataFrame:
    """The weak candidates (kind not null) of parts (doc_id, check, scope, role, kind, begin, stop) with complementary parts near.

    An interval join: a candidate widened by REACH on both sides meets every part of another role that its interval touches, in the same document,
    paragraph and cell of REACH code points; an interval stands in each cell that it touches. A login needs a secret, a secret a login, an endpoint
    both. A cell holds a bounded number of parts, so the pairs grow with the text, also inside one paragraph. A null doc_id is a document of its own.
    """
    cells = lambda begin, stop: F.explode(F.sequence(F.floor(begin / REACH), F.floor(stop / REACH)))
    wide = parts.where("kind is not null").withColumns({"low": F.col("begin") - REACH, "high": F.col("stop") + REACH})
    wide = wide.withColumn("cell", cells(F.col("low"), F.col("high")))
    other = parts.select(*(F.col(c).alias(f"o_{c}") for c in ("doc_id", "check", "scope", "role", "begin", "stop")), cells(F.col("begin"), F.col("stop")).alias("o_cell"))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc_id"))
    for c in ("check", "scope", "cell"):
        same = same & (F.col(c) == F.col(f"o_{c}"))
    touch = (F.col("o_begin") <= F.col("high")) & (F.col("o_stop") >= F.col("low")) & (F.col("role") != F.col("o_role"))
    seen = wide.join(other, same & touch).groupBy("doc_id", "check", "kind", "begin", "stop", "role").agg(*(F.bool_or(F.col("o_role") == r).alias(r) for r in ("login", "secret")))
    return seen.where("case role when 'login' then secret when 'secret' then login else login and secret end").select("doc_id", "check", "kind", "begin", "stop")


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; null text: empty): doc_id, check, n_assign, n_access, n_hex, base_sha256, base, spans.

    base and spans hold kind:start:end in code points, end exclusive, by start and then kind in the order of KINDS; spans has
    the base spans and the linked ones. Texts without any have empty strings. Repeated rows come back as often as they
    came and rows that share a doc_id are told apart by the checksum of their text. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = staged(docs.select("doc_id", "text").mapInArrow(_scan, _SCANNED), "scanned")
    parts = found.where("size(parts) > 0").dropDuplicates(["doc_id", "check"]).select("doc_id", "check", F.inline("parts"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), "kind")
    added = linked_parts(parts).groupBy("doc_id", "check").agg(F.collect_list(F.struct("begin", order.alias("k"), F.concat_ws(":", "kind", "begin", "stop").alias("span"))).alias("added"))
    out = found.drop("parts").join(added.withColumns({"id": F.col("doc_id"), "c": F.col("check")}).drop("doc_id", "check"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("check") == F.col("c")), "left")
    cells = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    own = F.transform(cells, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("begin"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("k"), s.alias("span")))
    whole = F.transform(F.array_sort(F.concat(own, F.coalesce("added", F.array().cast(out.schema["added"].dataType)))), lambda x: x["span"])
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(whole, ","))
    return out.select("doc_id", "check", "n_assign", "n_access", "n_hex", "base_sha256", "base", spans.alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    return secret_spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(unpacked(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if spans:
                found = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in spans.split(",")))
                pieces, at = [], 0
                for a, b, kind in found:
                    if a >= at:
                        pieces += [text[at:a], f"[{kind}]"]
                    at = max(at, b)
                text = "".join([*pieces, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs, in all its columns, with every span of secret_spans() replaced by its kind in brackets; overlapping spans become one.

    A null text becomes empty; texts without spans stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    spans = secret_spans(docs).where("spans <> ''").select(F.col("doc_id").alias("id"), F.col("check").alias("c"), "spans").distinct()
    texts = packed_texts(docs, others=others)
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("check") == F.col("c")), "left")
    rest = [f"o{k}" for k in range(len(others))]
    schema = ", ".join(["text string", *(f"{c} {joined.schema[c].dataType.simpleString()}" for c in rest)])
    out = joined.select("packed", "spans", *rest).mapInArrow(_masked, schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"o{others.index(c)}").alias(c) for c in docs.columns))
