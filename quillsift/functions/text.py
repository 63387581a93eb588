"""Tokens, n-grams, subsequence matches and their scores, for short texts on the driver and for columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NGRAM = 4
#: Below this a match is noise.
THRESHOLD = 0.1
_SYMBOLS = (">=", "<=", "!=", "==", "<>", "<", ">", "=", "~")
_BOUNDARY = " \t\r\n_-./\\"


@dataclass(frozen=True)
class Token:
    text: str
    begin: int
    end: int
    quoted: bool = False


@dataclass(frozen=True)
class Tokens:
    original: str
    tokens: tuple[Token, ...]
    complete: bool

    @property
    def texts(self) -> list[str]:
        return [t.text for t in self.tokens]


def tokenize(text: str) -> Tokens:
    """Words, quoted strings (with backslash escapes, an open one runs to the end) and operator symbols."""
    out: list[Token] = []
    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        if ch.isspace():
            i += 1
        elif ch in "\"'":
            begin, chars = i, []
            i += 1
            while i < n and text[i] != ch:
                i += text[i] == "\\" and i + 1 < n
                chars.append(text[i])
                i += 1
            i = min(n, i + 1)
            out.append(Token("".join(chars), begin, i, True))
        elif symbol := next((s for s in _SYMBOLS if text.startswith(s, i)), None):
            out.append(Token(symbol, i, i + len(symbol)))
            i += len(symbol)
        else:
            begin = i
            while i < n and not text[i].isspace() and text[i] not in "\"'<>=~":
                i += 1
            out.append(Token(text[begin:i], begin, i))
    return Tokens(text, tuple(out), bool(text.strip()) and text[-1].isspace())


@dataclass(frozen=True)
class Ngram:
    """Neighbouring tokens first to last, joined by a space."""

    text: str
    first: int
    last: int
    begin: int
    end: int

    @property
    def size(self) -> int:
        return self.last - self.first + 1


def ngrams(tokens: tuple[Token, ...]) -> list[Ngram]:
    """All single tokens, then runs of two to four."""
    out = []
    for size in range(1, min(MAX_NGRAM, len(tokens)) + 1):
        for i in range(len(tokens) - size + 1):
            some = tokens[i : i + size]
            out.append(Ngram(" ".join(t.text for t in some), i, i + size - 1, some[0].begin, some[-1].end))
    return out


def match(query: str, target: str) -> list[int] | None:
    """Where the query's characters stand in the target, in order and without regard to case: together if possible, then from word
    starts on, then leftmost. None if they don't."""
    q, t = query.lower(), target.lower()
    if not q or len(t) != len(target) and q not in t:
        return None
    places = [m.start() for m in re.finditer(f"(?={re.escape(q)})", t)]
    if places:
        best = next((p for p in places if p == 0 or t[p - 1] in _BOUNDARY), places[0])
        return list(range(best, best + len(q)))
    for starts_only in (True, False):
        out, at = [], 0
        for ch in q:
            near = t.find(ch, at)
            if starts_only and (not out or near != out[-1] + 1):
                while near >= 0 and not (near == 0 or t[near - 1] in _BOUNDARY):
                    near = t.find(ch, near + 1)
            if near < 0:
                break
            out.append(near)
            at = near + 1
        if len(out) == len(q):
            return out
    return None


def smart_score(indexes: list[int] | None, target: str, quality: float = 1.0) -> float:
    """Density, place and coverage of a match, between 0 and 1."""
    if not indexes or not target:
        return 0.0
    density = len(indexes) / (indexes[-1] - indexes[0] + 1)
    place = 1.0 if indexes[0] == 0 else 0.95 if target[indexes[0] - 1] in _BOUNDARY else 0.6
    return quality * density**2 * place * (0.8 + 0.2 * min(1.0, len(indexes) / len(target)))


def search(query: str, entries: list[tuple[str, object]], limit: int) -> list[tuple[float, object, str, list[int]]]:
    """The best `limit` entries (key, value) as (score, value, key, indexes); all at score 0 for an empty query."""
    if not query:
        return [(0.0, value, key, []) for key, value in entries[:limit]]
    found = [(smart_score(at, key), value, key, at) for key, value in entries if (at := match(query, key))]
    return sorted((f for f in found if f[0] >= THRESHOLD), key=lambda f: -f[0])[:limit]


def shorten(text: str, indexes: list[int] | None = None, most: int = 30, around: int = 5) -> tuple[str, list[int] | None] | None:
    """A long text cut to `most` characters about its match, with the match's places in it; None if it is short."""
    if len(text) <= most:
        return None
    first = max(0, (indexes[0] if indexes else 0) - around)
    begin = max(0, min(first, len(text) - most))
    head, tail = "…" * (begin > 0), "…" * (begin + most < len(text))
    moved = None if indexes is None else [i - begin + len(head) for i in indexes if begin <= i < begin + most]
    return head + text[begin : begin + most] + tail, moved


def subsequence_pattern(query: str) -> str:
    """A regular expression for texts that hold the query's characters in order; lower case on both sides."""
    return ".*?".join(re.escape(ch) for ch in query.lower())


def tokens_column(column: Column) -> Column:
    """Words and quoted strings of a column, like tokenize without escapes."""
    return F.regexp_extract_all(column, F.lit(r"""("[^"]*"|'[^']*'|>=|<=|!=|==|<>|[<>=~]|[^\s"'<>=~]+)"""), F.lit(1))


def ngrams_column(tokens: Column) -> Column:
    """All runs of one to four tokens of an array column, joined by spaces."""

    def runs(k: int) -> Column:
        size = F.size(tokens)
        starts = F.sequence(F.lit(1), size - (k - 1))
        return F.when(size >= k, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(runs, range(1, MAX_NGRAM + 1)))


def smart_score_column(first: Column, matched: Column, target: Column) -> Column:
    """smart_score of a contiguous match that starts at `first` (from 0)."""
    before = F.substring(target, first.cast("int"), F.lit(1))
    place = F.when(first == 0, 1.0).when(before.rlike(r"[\s_\-./\\]"), 0.95).otherwise(0.6)
    return place * (0.8 + 0.2 * F.least(F.lit(1.0), matched / F.length(target)))
