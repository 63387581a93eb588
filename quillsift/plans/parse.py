"""From free text to a filter: matching of n-grams with names and values, and the assignment of parts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.catalog import Catalog, DataType
from quillsift.functions.dates import ParsedDate, detect_dates, parse_date
from quillsift.functions.text import THRESHOLD, Ngram, Tokens, match, ngrams, smart_score, smart_score_column, subsequence_pattern, tokenize
from quillsift.operators.predicates import FilterSpec
from quillsift.operators.registry import OPERATORS, is_valid_for, search_terms

TOP_COLUMNS, TOP_OPERATORS, TOP_VALUES = 5, 5, 10
#: A longer operator phrase is preferred to a shorter one within it if it scores at least this share.
OVERLAP = 0.8
MAX_DATE_TOKENS = 5


@dataclass(frozen=True)
class Match:
    """A part of the text that stands for a column, an operator or a value."""

    kind: str
    key: Any
    text: str
    ngram: Ngram
    score: float
    indexes: tuple[int, ...] = ()
    column: str | None = None
    types: tuple[DataType, ...] = ()

    @property
    def tokens(self) -> range:
        return range(self.ngram.first, self.ngram.last + 1)


@dataclass
class Matches:
    tokens: Tokens
    columns: list[Match] = field(default_factory=list)
    operators: list[Match] = field(default_factory=list)
    values: list[Match] = field(default_factory=list)
    numbers: list[Match] = field(default_factory=list)
    dates: list[Match] = field(default_factory=list)


def _score(query: str, target: str) -> tuple[float, tuple[int, ...]]:
    at = match(query, target)
    return (smart_score(at, target), tuple(at)) if at else (0.0, ())


def _best(found: list[Match], key) -> list[Match]:
    """The best match of each key, the first one on ties, by score."""
    kept: dict = {}
    for m in found:
        if key(m) not in kept or m.score > kept[key(m)].score:
            kept[key(m)] = m
    return sorted(kept.values(), key=lambda m: -m.score)


def match_columns(grams: list[Ngram], catalog: Catalog, provider=None) -> list[Match]:
    found = []
    for g in grams:
        some = []
        for c in catalog.columns:
            names = dict.fromkeys([(c.key and provider and provider.translate(c.key)) or c.title, c.title, c.id, *c.aliases])
            score, text, at = max(((*(s := _score(g.text, n))[:1], n, s[1]) for n in names), key=lambda x: x[0])
            if score >= THRESHOLD:
                some.append(Match("column", c.id, text, g, score, at))
        found += sorted(some, key=lambda m: -m.score)[:TOP_COLUMNS]
    return _best(found, lambda m: m.key)


def match_operators(grams: list[Ngram], provider=None) -> list[Match]:
    """Operators by whole phrases, or by parts of them of three characters and more."""
    found = []
    for g in grams:
        some = []
        for o in OPERATORS.values():
            general = {t.lower(): t for t in search_terms(o.id, None, provider)}
            special = {t.lower(): (t, kind) for kind in o.type_aliases for t in o.type_aliases[kind]}
            low = g.text.lower()
            if low in general:
                some.append(Match("operator", o.id, general[low], g, 1.0, tuple(range(len(low)))))
            elif low in special:
                text, kind = special[low]
                some.append(Match("operator", o.id, text, g, 1.0, tuple(range(len(low))), types=(kind,)))
            elif len(low) >= 3:
                score, text, at = max(((*(s := _score(low, t))[:1], t, s[1]) for t in general.values()), key=lambda x: x[0])
                if at and at[-1] - at[0] + 1 == len(at) and at[0] == 0 and score >= THRESHOLD:
                    some.append(Match("operator", o.id, text, g, score * 0.9, at))
        found += sorted(some, key=lambda m: -m.score)[:TOP_OPERATORS]
    best = _best(found, lambda m: (m.key, m.types))

    def beaten(m: Match) -> bool:
        """By another operator that uses more of the same tokens about as well."""
        for o in best:
            shared = set(m.tokens) & set(o.tokens)
            if o.key != m.key and shared and (o.ngram.size > m.ngram.size and o.score >= OVERLAP * m.score or o.ngram.size == m.ngram.size and o.score > m.score):
                return True
        return False

    return [m for m in best if not beaten(m)]


def value_candidates(index: DataFrame, texts: list[str], limit: int = TOP_VALUES) -> DataFrame:
    """ngram, column_id, value, row_count, score: the best values for each text. One pass over the index: the texts are literals, and each
    value is scored by the first place that has the text, or else by the leftmost stretch that holds its characters in order (as `match` does)."""
    low = F.lower("value")
    each = []
    for i, text in enumerate(texts):
        q = text.lower()
        first = F.instr(low, F.lit(q)) - 1
        stretch = F.regexp_extract(low, f"({subsequence_pattern(q)})", 1)
        start = F.instr(low, stretch) - 1
        whole = smart_score_column(first, F.lit(len(q)), F.col("value"))
        loose = F.when(F.length(stretch) > 0, smart_score_column(start, F.lit(len(q)), F.col("value")) * F.pow(F.lit(len(q)) / F.length(stretch), F.lit(2)))
        each.append(F.struct(F.lit(i).alias("ngram"), F.when(first >= 0, whole).otherwise(loose).alias("score")))
    scored = index.select("column_id", "value", "row_count", F.explode(F.array(*each)).alias("m")).select("column_id", "value", "row_count", "m.ngram", "m.score").where(F.col("score") >= THRESHOLD)
    order = Window.partitionBy("ngram").orderBy(F.desc("score"), F.desc("row_count"), "column_id", "value")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def prefix_candidates(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.lower("value").startswith(prefix.lower()))


def subsequence_candidates(index: DataFrame, text: str) -> DataFrame:
    return index.where(F.lower("value").rlike(subsequence_pattern(text)))


def match_values(grams: list[Ngram], index: DataFrame, catalog: Catalog, provider=None) -> list[Match]:
    """Values of text, enum and boolean columns; at most TOP_VALUES rows for each n-gram come to the driver. Enum labels
    that a provider translates are matched too."""
    textual = [c.id for c in catalog.columns if c.type in (DataType.STRING, DataType.ENUM)]
    words = [g for g in grams if g.text.strip()]
    found = []
    if words and textual:
        rows = value_candidates(index.where(F.col("column_id").isin(textual)), [g.text for g in words]).collect()
        for r in sorted(rows, key=lambda r: (r["ngram"], -r["score"], -r["row_count"], r["column_id"], r["value"])):
            g = words[r["ngram"]]
            found.append(Match("value", r["value"], r["value"], g, r["score"], tuple(match(g.text, r["value"]) or ()), r["column_id"]))
    for c in catalog.columns:
        for v in c.values:
            label = (v.key and provider and provider.translate(v.key)) or v.label
            if label and label.lower() != v.value.lower():
                for g in words:
                    score, at = _score(g.text, label)
                    if score >= THRESHOLD:
                        found.append(Match("value", v.value, label, g, score, at, c.id))
    return _best(found, lambda m: (m.column, m.key, m.ngram.first))


def number(text: str) -> float | int | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return None if not math.isfinite(x) else int(x) if x.is_integer() else x


def match_literals(tokens: Tokens, now, locale: str) -> tuple[list[Match], list[Match]]:
    """Numbers, and dates over one to five tokens, the shortest stretch that is a date as a whole."""
    dates: list[Match] = []
    used: set[int] = set()
    for i in range(len(tokens.tokens)):
        for size in range(1, min(MAX_DATE_TOKENS, len(tokens.tokens) - i) + 1):
            some = tokens.tokens[i : i + size]
            if used & set(range(i, i + size)):
                break
            text = tokens.original[some[0].begin : some[-1].end]
            parsed = parse_date(text, now, locale)
            if parsed and (parsed.begin == 0 and parsed.finish == len(text) or parsed.text != text and len(detect_dates(text, now, locale.lower().split('-')[0])) == 0):
                dates.append(Match("date", parsed, text, Ngram(text, i, i + size - 1, some[0].begin, some[-1].end), 1.0))
                used |= set(range(i, i + size))
                break
    numbers = [
        Match("number", x, t.text, Ngram(t.text, i, i, t.begin, t.end), 1.0)
        for i, t in enumerate(tokens.tokens)
        if i not in used and (x := number(t.text)) is not None
    ]
    return numbers, dates


def find_matches(text: str, catalog: Catalog, index: DataFrame | None, now=None, locale: str = "en", provider=None) -> Matches:
    tokens = tokenize(text)
    grams = ngrams(tokens.tokens)
    out = Matches(tokens)
    out.columns = match_columns(grams, catalog, provider)
    out.numbers, out.dates = match_literals(tokens, now, locale)
    out.values = match_values(grams, index, catalog, provider) if index is not None and grams else []
    operators = match_operators(grams, provider)
    # a word of a longer value that is matched as a whole isn't an operator
    exact = [set(v.tokens) for v in out.values if v.score > 0.99 and v.ngram.size > 1]
    out.operators = [o for o in operators if not any(set(o.tokens) < e for e in exact)]
    return out


def without_overlap(found: list[Match], taken: set[int]) -> list[Match]:
    """The best matches that share no token with each other or with `taken`, in the text's order."""
    kept: list[Match] = []
    taken = set(taken)
    for m in sorted(found, key=lambda m: (-m.score * m.ngram.size, m.ngram.first)):
        if not taken & set(m.tokens):
            kept.append(m)
            taken |= set(m.tokens)
    return sorted(kept, key=lambda m: m.ngram.first)


@dataclass(frozen=True)
class Parsed:
    tokens: Tokens
    column: str | None
    operator: str | None
    args: tuple
    score: float

    @property
    def errors(self) -> list[str]:
        out = []
        if self.column is None:
            out.append("No column specified")
        if self.operator is None:
            out.append("No operator specified")
        elif OPERATORS[self.operator].takes_argument and not self.args:
            out.append(f"Operator '{OPERATORS[self.operator].label}' requires a value")
        return out

    @property
    def spec(self) -> FilterSpec | None:
        return None if self.errors else FilterSpec(self.column, self.operator, self.args)


def arguments(found: Matches, column, taken: set[int]) -> list[Match]:
    """Literals or values that the column's type can be compared with, outside the tokens taken."""
    pool = {
        DataType.NUMBER: found.numbers,
        DataType.DATE: found.dates,
        DataType.STRING: [v for v in found.values if v.column == column.id],
        DataType.ENUM: [v for v in found.values if v.column == column.id],
    }.get(column.type, [])
    return without_overlap(pool, taken)


def assign(found: Matches, catalog: Catalog) -> Parsed:
    """The best column, an operator that it allows, and the literals or values that are left; a lone operator or value stands alone."""
    best = Parsed(found.tokens, None, None, (), 0.0)
    total = max(1, len(found.tokens.tokens))
    for c in [*found.columns, None]:
        column = catalog.get(c.key) if c else None
        for o in [*found.operators, None]:
            if c and o and set(c.tokens) & set(o.tokens):
                continue
            if column and o and (not is_valid_for(o.key, column.type) or o.types and column.type not in o.types):
                continue
            taken = set(c.tokens if c else ()) | set(o.tokens if o else ())
            args = arguments(found, column, taken) if column and o and OPERATORS[o.key].takes_argument else []
            if o and not OPERATORS[o.key].variadic:
                args = args[:1]
            claimed = taken | {i for a in args for i in a.tokens}
            score = len(claimed) / total * ((c.score * 0.4 if c else 0) + (o.score * 0.2 if o else 0) + (0.4 * sum(a.score for a in args) / len(args) if args else 0))
            literal = tuple(a.key for a in args)
            if column and o and not literal and OPERATORS[o.key].takes_argument and column.type in (DataType.STRING, DataType.ENUM):
                free = [t.text for i, t in enumerate(found.tokens.tokens) if i not in taken]
                literal = tuple(free) if OPERATORS[o.key].variadic else (" ".join(free),) if free else ()
            if score > best.score:
                best = Parsed(found.tokens, c.key if c else None, o.key if o else None, literal, score)
    return best


def as_filter_args(args: tuple) -> tuple:
    """Arguments as literals: a date range becomes its two ends."""
    return tuple(x for a in args for x in ((a.start, a.end) if isinstance(a, ParsedDate) and a.is_range else (a,)))
