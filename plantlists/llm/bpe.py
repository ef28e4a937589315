"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For a word, let last[i] be the last token of the encoding of its first i symbols. It is unique, and it is the one vocabulary
entry ending at i which (a) is itself what the merges make of its text and (b) is compatible with last[] of what is left: merging
the pair's text gives exactly the pair. So every prefix takes one look at the entries that end there, and the ids follow from
back-pointers.

Entries that end at a position come from the suffix automaton of the vocabulary. Its states are the classes of substrings of entries
that end at the same places; a state's link leads to its longest suffix of another class. An entry begins where nothing stands
before it, so it is the longest string of its state, which is marked. Reading a text keeps the state of its longest suffix inside
the vocabulary and that suffix's length; the marked states on the links from there are the entries that end here.
Compatibility of a pair is tested by taking the two tokens apart along their merges, looking for a merge across the seam that
ranks before the merges which made the pair.

The vocabulary (word ends, lower case) has no entry across white space. A batch's new words go through the program together,
one position of all words at a time, in numpy; words and pieces met before are kept in bounded tables of each worker.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .staging import small_batches

#: Characters of words and of pieces that a worker keeps at most, each.
KEPT_CHARACTERS = 4_000_000
#: Words that go through the program together, and the longest of them; longer ones go alone.
TOGETHER = 8_192
LONG = 48
#: Places of the table of tested pairs.
PAIRS = 1 << 19
#: White space of the vocabulary's normaliser; str.split() also splits at the separators 0x1C-0x1F.
_SPACES = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SYMBOLS = 512


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed values: printable bytes stand for themselves, others follow from 256)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SuffixAutomaton:
    """The suffix automaton of several entries (sequences of symbols below 512), as arrays.

    length: of the longest string of a state; link: the state of its longest suffix of another class; mark: the entry that this
    string is, or -1; up: the nearest marked state along the links, 0 if there is none.
    """

    def __init__(self, entries: Iterable[tuple[int, list[int]]]) -> None:
        moves: list[dict[int, int]] = [{}]
        length, link, mark = [0], [-1], {}

        def copied(at: int, symbol: int, to: int) -> int:
            """A state for the strings of `to` that end with what `at` holds and the symbol."""
            moves.append(dict(moves[to]))
            length.append(length[at] + 1)
            link.append(link[to])
            link[to] = new = len(length) - 1
            while at >= 0 and moves[at].get(symbol) == to:
                moves[at][symbol] = new
                at = link[at]
            return new

        for entry, symbols in entries:
            state = 0
            for c in symbols:
                to = moves[state].get(c)
                if to is not None:
                    state = to if length[to] == length[state] + 1 else copied(state, c, to)
                    continue
                moves.append({})
                length.append(length[state] + 1)
                link.append(0)
                new, at = len(length) - 1, state
                while at >= 0 and c not in moves[at]:
                    moves[at][c] = new
                    at = link[at]
                if at >= 0:
                    to = moves[at][c]
                    link[new] = to if length[to] == length[at] + 1 else copied(at, c, to)
                state = new
            mark[state] = entry

        n = len(length)
        self.length, self.link = np.array(length, np.int32), np.array(link, np.int32)
        self.mark = np.full(n, -1, np.int32)
        self.mark[list(mark)] = list(mark.values())
        self.up = np.zeros(n, np.int32)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            self.up[s] = link[s] if link[s] in mark else self.up[link[s]]
        keys = np.array([s * _SYMBOLS + c for s, m in enumerate(moves) for c in m], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.to = np.append(np.array([to for m in moves for to in m.values()], np.int32)[order], 0)

    def moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where there is no move."""
        keys = state * np.int64(_SYMBOLS) + symbol
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.to[at], -1)

    def read(self, state: np.ndarray, have: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and lengths of the longest suffixes in the vocabulary after one more symbol of each text."""
        state, have, to = state.copy(), have.copy(), self.moved(state, symbol)
        lost = np.flatnonzero(to < 0)
        while len(lost):
            state[lost] = self.link[state[lost]]
            have[lost] = self.length[state[lost]]
            to[lost] = self.moved(state[lost], symbol[lost])
            lost = lost[to[lost] < 0]
        return to, have + 1

    def ending(self, state: np.ndarray, have: np.ndarray) -> np.ndarray:
        """The marked state of the longest entry that ends here."""
        return np.where((self.mark[state] >= 0) & (have == self.length[state]), state, self.up[state])


class _Kept(dict):
    """Results by text, forgotten when their texts have too many characters."""

    characters = 0

    def keep(self, new: dict) -> None:
        size = sum(map(len, new))
        if self.characters + size > KEPT_CHARACTERS:
            self.clear()
            self.characters = 0
        if size <= KEPT_CHARACTERS:
            self.update(new)
            self.characters += size


class PrefixEncoder:
    """Encoder and decoder of a byte-level vocabulary with word ends, from its description (vocab, merges, end_of_word_suffix)."""

    def __init__(self, description: str) -> None:
        given = json.loads(description)
        model = given["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        n = max(self.tokens) + 1
        # by id: the rank of the merge that makes a token (-1: none), and its two parts
        self.made, self.first, self.second = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys = np.array([self.ids[a] * n + self.ids[b] for a, b in pairs], np.int64)
        for k, (a, b) in enumerate(pairs):
            t = self.ids[a + b]
            if self.made[t] < 0:
                self.made[t], self.first[t], self.second[t] = k, self.ids[a], self.ids[b]
        self.rank = np.argsort(keys, kind="stable")
        self.pairs = np.append(keys[self.rank], np.iinfo(np.int64).max)
        self.rank = np.append(self.rank, 0)
        self.symbol = {c: b for b, c in byte_symbols().items()}
        entries = [(i, self._symbols(t)) for t, i in self.ids.items()]
        sound = self._sound([i for i, _ in entries], [len(s) for _, s in entries])
        self.automaton = SuffixAutomaton(e for e, s in zip(entries, sound.tolist(), strict=True) if s)
        self.size = np.zeros(n, np.int32)  # symbols of each entry
        some = self.automaton.mark >= 0
        self.size[self.automaton.mark[some]] = self.automaton.length[some]
        self.split = regex.compile(given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.tested = np.zeros(PAIRS, np.int64)
        self.words: dict[str, tuple[bytes, str]] = _Kept()
        self.kept: dict[str, tuple[bytes, str]] = _Kept()

    def _symbols(self, token: str) -> list[int]:
        """Bytes, the last one moved up by 256 where the word ends."""
        ends = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
        out = [self.symbol[c] for c in (token[: -len(self.end)] if ends else token)] if all(c in self.symbol for c in token) else []
        return [*out[:-1], out[-1] + 256] if ends and out else out

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, a large number where they do not merge."""
        keys = a * len(self.made) + b
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.rank[at], np.iinfo(np.int64).max)

    def pairs_stay(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Which pairs of ids come out again when the text of both is merged; with limits, which stay apart until merges of that rank.

        Undo the merges of both, the later one first: a merge that joins the symbols at the seam would have happened if it ranks
        before the merge that took one of them up. Merges run from left to right, so at an equal rank the seam comes after
        what lies to its left and before what lies to its right.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        stays = self._merge_rank(a, b) == np.iinfo(np.int64).max if limit is None else np.ones(len(a), bool)
        live = np.flatnonzero(stays)
        while len(live):
            x, y = a[live], b[live]
            ra, rb = self.made[x], self.made[y]
            if limit is not None:
                stays[live[np.maximum(ra, rb) > limit[live]]] = False
            of_left = ra > rb
            x, y = np.where(of_left, self.second[x], x), np.where(of_left, y, self.first[y])
            more = (ra >= 0) | (rb >= 0)
            met = self._merge_rank(x, y) < np.where(of_left, ra, rb + 1)
            stays[live[more & met]] = False
            a[live], b[live] = x, y
            live = live[more & stays[live]]
        return stays

    def _sound(self, ids: list[int], sizes: list[int]) -> np.ndarray:
        """Which entries the merges make of their own text; parts come before wholes."""
        known = np.zeros(len(self.made), bool)
        ids_, sizes_ = np.array(ids, np.int64), np.array(sizes)
        known[ids_[(sizes_ == 1) & (self.made[ids_] < 0)]] = True
        made = ids_[self.made[ids_] >= 0]
        apart = np.zeros(len(self.made), bool)
        apart[made] = self.pairs_stay(self.first[made], self.second[made], self.made[made])
        for t in made[np.argsort(self.made[made])].tolist():
            known[t] = apart[t] and known[self.first[t]] and known[self.second[t]]
        return known[ids_]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """pairs_stay() through a table of the pairs tested last."""
        keys = left.astype(np.int64) * len(self.made) + right + 1
        place = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % PAIRS
        found = self.tested[place]
        out = (found & 1) > 0
        new = np.flatnonzero(found >> 1 != keys)
        if len(new):
            own, back = np.unique(keys[new], return_inverse=True)
            stays = self.pairs_stay(*np.divmod(own - 1, len(self.made)))
            out[new] = stays[back]
            self.tested[place[new]] = keys[new] * 2 + out[new]
        return out

    def _together(self, words: list[bytes]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian) and tokens side by side of each word. Words come in order of falling length."""
        auto, n = self.automaton, len(words)
        sizes = np.array([len(w) for w in words])
        symbols = np.zeros((n, sizes.max()), np.int64)
        symbols[np.arange(sizes.max()) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        if self.end:
            symbols[np.arange(n), sizes - 1] += 256
        last = np.zeros((n, sizes.max() + 1), np.int32)
        state, have = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for i in range(1, sizes.max() + 1):
            k = int(np.searchsorted(-sizes, -i, "right"))
            state[:k], have[:k] = auto.read(state[:k], have[:k], symbols[:k, i - 1])
            todo, at = np.arange(k), auto.ending(state[:k], have[:k])
            while len(todo):
                if not at.all():
                    raise ValueError(f"no encoding for {words[int(todo[np.argmin(at)])]!r}")
                token, size = auto.mark[at], auto.length[at]
                fits = size == i
                part = np.flatnonzero(~fits)
                fits[part] = self._compatible(last[todo[part], i - size[part]], token[part])
                last[todo[fits], i] = token[fits]
                todo, at = todo[~fits], auto.up[at[~fits]]
        # back-pointers of all words, one token of each at a time
        steps, at = [], sizes.copy()
        while at.any():
            token = last[np.arange(n), at]
            steps.append(np.where(at > 0, token, -1))
            at -= np.where(at > 0, self.size[token], 0)
        ids = np.stack(steps[::-1], axis=1)
        edges = np.append(0, np.cumsum((ids >= 0).sum(axis=1))).tolist()
        ids = ids[ids >= 0]
        raw, names = ids.astype("<u4").tobytes(), [self.tokens[t] for t in ids.tolist()]
        return ((raw[4 * a : 4 * b], " ".join(names[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True))

    def _alone(self, word: bytes) -> tuple[bytes, str]:
        """The same of one word of any length, symbol by symbol, with the moves and pairs that it meets kept."""
        auto, n = self.automaton, len(self.made)
        moves: dict[int, int] = {}
        pairs: dict[int, bool] = {}
        length, link, mark, up = auto.length.tolist(), auto.link.tolist(), auto.mark.tolist(), auto.up.tolist()
        one = lambda x: np.array([x], np.int64)
        last = [0] * (len(word) + 1)
        state = have = 0
        for i, byte in enumerate(word, 1):
            symbol = byte + 256 if self.end and i == len(word) else byte
            while True:
                key = state * _SYMBOLS + symbol
                if (to := moves.get(key)) is None:
                    to = moves[key] = int(auto.moved(one(state), one(symbol))[0])
                if to >= 0:
                    break
                state = link[state]
                have = length[state]
            state, have = to, have + 1
            at = state if mark[state] >= 0 and have == length[state] else up[state]
            while at:
                token, size = mark[at], length[at]
                if size == i:
                    break
                key = last[i - size] * n + token
                if (stays := pairs.get(key)) is None:
                    stays = pairs[key] = bool(self.pairs_stay(one(last[i - size]), one(token))[0])
                if stays:
                    break
                at = up[at]
            if not at:
                raise ValueError(f"no encoding for a word of {len(word)} bytes")
            last[i] = mark[at]
        out, i = [], len(word)
        while i > 0:
            out.append(last[i])
            i -= int(self.size[last[i]])
        out.reverse()
        return np.array(out, "<u4").tobytes(), " ".join([self.tokens[t] for t in out])

    def _encode_words(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        order = sorted(((w.encode(), w) for w in words), key=lambda x: -len(x[0]))
        out = {w: self._alone(raw) for raw, w in order if len(raw) > LONG}
        order = order[len(out) :]
        for k in range(0, len(order), TOGETHER):
            part = order[k : k + TOGETHER]
            out.update(zip([w for _, w in part], self._together([raw for raw, _ in part]), strict=True))
        return out

    def _split(self, text: str) -> list[str]:
        """Runs without white space; special tokens stand by themselves."""
        out, at = [], 0
        for m in self.special_split.finditer(text) if "<|" in text else ():
            out += self._runs(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._runs(text[at:] if at else text)

    @staticmethod
    def _runs(text: str) -> list[str]:
        return list(filter(None, _SPACES.split(text))) if _SEPARATORS.search(text) else text.split()

    def _words_of(self, piece: str) -> list[str]:
        plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
        plain = plain.lower() if "\u03a3" not in plain else "".join([c.lower() for c in plain])  # lower() writes a last sigma differently
        return [plain] if plain.isascii() and plain.isalpha() else self.split.findall(plain)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Little-endian 32-bit ids of each text, and what they decode to."""
        split = [self._split(t) for t in texts]
        pieces = [p for own in split for p in own]
        parts = list(map(self.kept.get, pieces))
        new = {p: self._words_of(p) for p in {p for p, x in zip(pieces, parts, strict=True) if x is None} if p not in self.special}
        words = {w: self.words.get(w) for own in new.values() for w in own}
        fresh = self._encode_words([w for w, x in words.items() if x is None])
        words |= fresh
        found = {t: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        for piece, own in new.items():
            if len(own) == 1:
                found[piece] = words[own[0]]
            else:
                both = [words[w] for w in own]
                found[piece] = b"".join([x for x, _ in both]), " ".join([t for _, t in both])
        parts = [found[p] if x is None else x for p, x in zip(pieces, parts, strict=True)]
        out, at = [], 0
        for own in split:
            mine = parts[at : at + len(own)]
            at += len(own)
            out.append((b"".join([x for x, _ in mine]), " ".join([t for _, t in mine if t])))
        self.words.keep(fresh)
        self.kept.keep({p: found[p] for p in new})
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary's description, tokens stand side by side with a space between."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encoded(docs: DataFrame, description: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids (little-endian 32-bit integers), decoded.

    description: the text of a vocabulary file; what is made of it, of fixed size, travels once to each worker. Null and empty
    texts have no ids and decode to an empty text. A null or repeated doc_id is a row like others, and an empty table gives an
    empty table. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(PrefixEncoder(description))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value  # one for all tasks of a worker, and its tables with it
        for batch in batches:
            out = encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x, _ in out], pa.int64()), pa.array([x for x, _ in out], pa.binary()), pa.array([t for _, t in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
