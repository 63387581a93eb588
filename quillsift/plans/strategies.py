"""How suggestions are made from what a text's parts match. Each strategy says whether it applies and generates suggestions; all that apply run, in
order, and of suggestions with one id the best counts, the earlier one on ties. A caller may add strategies of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.catalog import Catalog, Column, DataType
from quillsift.functions.dates import ParsedDate, date_suggestions, format_date, parse_date
from quillsift.functions.text import shorten
from quillsift.operators.predicates import FilterSpec
from quillsift.operators.registry import OPERATORS, Operator, is_valid_for, label_of, operators_for, spread_pairs
from quillsift.plans.parse import Match, Matches, arguments, number, without_overlap

#: Weights of a suggestion's parts in its score.
COLUMN, OPERATOR, VALUE = 0.4, 0.2, 0.4
#: Operators that are suggested for one literal, and for a column alone; values of a column without one; score of literals alone.
ONE_LITERAL, NO_LITERAL, TOP_OF_COLUMN, LITERALS_ALONE = 5, 3, 10, 0.5
_TEXTUAL = (DataType.STRING, DataType.ENUM)


@dataclass(frozen=True)
class Suggestion:
    id: str
    label: str
    column_id: str
    operator: str
    args: tuple
    score: float
    is_complete: bool
    completion_text: str
    category: str
    matches: tuple[Match, ...] = ()
    result_count: int | None = None

    @property
    def spec(self) -> FilterSpec:
        return FilterSpec(self.column_id, self.operator, self.args)


@dataclass(frozen=True)
class Literal:
    """An argument with its kind: string, number, boolean or date."""

    kind: str
    value: object

    @classmethod
    def of(cls, value: object) -> Literal:
        return cls("date" if isinstance(value, ParsedDate) else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string", value)


def value_text(value) -> str:
    if isinstance(value, ParsedDate):
        return f"{format_date(value.start)} - {format_date(value.end)}" if value.is_range else format_date(value.start)
    return str(value)


def _id(column: str, operator: str, args: tuple) -> str:
    if args and all(isinstance(a, ParsedDate) for a in args):
        ends = [x.isoformat() for a in args for x in (a.start, a.end) if x is not None]
        return f"{column}:{operator}:date:{'-'.join(ends)}"
    return f"{column}:{operator}:{','.join(map(str, args))}"


def explain_score(total: int, column: Match | None, operator: Match | None, values: list[Match]) -> float:
    """Share of the tokens that the parts explain, times their weighted quality. A part that explains no new token adds nothing."""
    claimed: set[int] = set()
    quality = 0.0
    for weight, parts in ((COLUMN, [column] if column else []), (OPERATOR, [operator] if operator else []), (VALUE, values)):
        scores = []
        for m in parts:
            new = set(m.tokens) - claimed
            if new:
                claimed |= new
                scores.append(m.score)
        quality += weight * sum(scores) / len(scores) if scores else 0.0
    return min(1.0, len(claimed) / total * quality) if total else 0.0


@dataclass(frozen=True)
class Query:
    """A text's matches with what suggestions are made from. `index` has the values of the context."""

    found: Matches
    catalog: Catalog
    index: DataFrame | None = None
    provider: object | None = None
    now: object | None = None
    locale: str = "en"

    @property
    def total(self) -> int:
        return len(self.found.tokens.tokens)

    def columns(self) -> Iterator[tuple[Match, Column]]:
        """Matched columns, the best first."""
        for m in sorted(self.found.columns, key=lambda m: -m.score):
            yield m, self.catalog.get(m.key)

    def operators(self, column: Column, taken: set[int] = frozenset()) -> list[Match]:
        """Matched operators that a column allows, outside the tokens taken."""
        return [o for o in self.found.operators if is_valid_for(o.key, column.type) and (not o.types or column.type in o.types) and not taken & set(o.tokens)]

    def make(self, column: Column, operator_id: str, args: tuple, score: float, matches: tuple[Match, ...] = ()) -> Suggestion:
        operator = OPERATORS[operator_id]
        title = (column.key and self.provider and self.provider.translate(column.key)) or column.title
        used = next((m.text for m in matches if m.kind == "operator" and m.text.lower() != operator.id.lower()), None)
        enough = len(args) >= (operator.min_arguments if operator.variadic else 1) or any(isinstance(a, ParsedDate) and a.is_range for a in args)
        texts = [self._label(column, a) for a in args]
        words = (" - " if operator_id == "between" else ", ").join((shorten(t) or (t,))[0] for t in texts)
        label = " ".join(x for x in (title, used or label_of(operator_id, self.provider), words) if x)
        completion = " ".join(x for x in (title, label_of(operator_id, self.provider), *(f'"{t}"' if " " in t else t for t in texts)) if x)
        return Suggestion(_id(column.id, operator_id, args), label, column.id, operator_id, args, score, enough or not operator.takes_argument, completion, str(operator.category), matches)

    def _label(self, column: Column, value) -> str:
        for v in column.values:
            if v.value == value:
                return (v.key and self.provider and self.provider.translate(v.key)) or v.label or v.value
        return value_text(value)

    def explained(self, column: Column, c: Match | None, o: Match | None, operator_id: str, values: list[Match]) -> Suggestion:
        """The suggestion of these parts, scored by how much of the text they explain."""
        args = tuple(v.key for v in values)
        if operator_id == "between" and column.type == DataType.NUMBER:
            args = tuple(sorted(args))
        return self.make(column, operator_id, args, explain_score(self.total, c, o, values), (*(m for m in (c, o) if m), *values))

    def fitted(self, column: Column, c: Match | None, o: Match | None, operator_id: str) -> Iterator[Suggestion]:
        """A column and an operator with as many of the text's literals or values as the operator takes; without any, if a part is matched."""
        operator = OPERATORS[operator_id]
        taken = set(c.tokens if c else ()) | set(o.tokens if o else ())
        values = arguments(self.found, column, taken) if operator.takes_argument else []
        if operator_id == "between":
            values = values[:1] if values and isinstance(values[0].key, ParsedDate) and values[0].key.is_range else values[:2]
        elif not operator.variadic:
            values = values[:1]
        if values or c or o:
            yield self.explained(column, c, o, operator_id, values)


class Strategy(Protocol):
    """name tells strategies apart; generate is called only where handles is true."""

    name: str

    def handles(self, query: Query) -> bool: ...

    def generate(self, query: Query) -> Iterator[Suggestion]: ...


def plan(operators: list[Operator], values: list[Match]) -> list[str]:
    """Operators for literals that belong to a column: ranges and lists for several, the first few that take one, lists of one."""
    lists = [o.id for o in operators if o.variadic and o.min_arguments == 1]
    out = []
    if len(values) > 1:
        out += [o.id for o in operators if o.variadic and o.min_arguments == 2] + lists
    elif isinstance(values[0].key, ParsedDate) and values[0].key.is_range:
        out += [o.id for o in operators if o.id == "between"]
    out += [o.id for o in operators if o.takes_argument and not o.variadic][:ONE_LITERAL]
    return list(dict.fromkeys(out + lists))


class EmptyText:
    """Each column with its first operator."""

    name = "empty"

    def handles(self, query: Query) -> bool:
        return not query.total

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for c in query.catalog.columns:
            yield query.make(c, operators_for(c.type)[0].id, (), 0.0)


class Spread:
    """from X to Y, between X and Y. Numbers are put in order, dates aren't."""

    name = "spread"

    def handles(self, query: Query) -> bool:
        return query.total >= 3

    def generate(self, query: Query) -> Iterator[Suggestion]:
        tokens = query.found.tokens.tokens
        words = [t.text.lower() for t in tokens]
        for start, separator in spread_pairs(query.provider.word_sets()) if query.provider else spread_pairs():
            if start not in words or separator not in words[words.index(start) + 1 :]:
                continue
            a = words.index(start)
            b = words.index(separator, a + 1)
            left, right = " ".join(t.text for t in tokens[a + 1 : b]), " ".join(t.text for t in tokens[b + 1 :])
            numbers = number(left), number(right)
            dates = parse_date(left, query.now, query.locale), parse_date(right, query.now, query.locale)
            named = {m.key: m for m in query.found.columns if m.score >= 0.3 and not set(m.tokens) & set(range(a, len(tokens)))}
            for c in query.catalog.columns:
                if named and c.id not in named:
                    continue
                ends = tuple(sorted(numbers)) if c.type == DataType.NUMBER and None not in numbers else dates if c.type == DataType.DATE and None not in dates else None
                if ends:
                    yield query.make(c, "between", ends, 0.95, (named[c.id],) if c.id in named else ())


class MatchedColumn:
    """A matched column with the literals or values beside it; without any, its matched operators without argument and its first ones."""

    name = "column"

    def handles(self, query: Query) -> bool:
        return bool(query.found.columns)

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for c, column in query.columns():
            fitting, values = operators_for(column.type), arguments(query.found, column, set(c.tokens))
            if values:
                for operator_id in plan(fitting, values):
                    yield from query.fitted(column, c, None, operator_id)
                continue
            for o in query.operators(column, set(c.tokens)):
                if not OPERATORS[o.key].takes_argument:
                    yield query.explained(column, c, o, o.key, [])
            always = ["isTrue", "isFalse"] if column.type == DataType.BOOLEAN else []
            for operator_id in dict.fromkeys([*(o.id for o in fitting[:NO_LITERAL]), *always]):
                yield query.explained(column, c, None, operator_id, [])


class MatchedOperator:
    """A matched operator with every column that allows it and has the literals it takes, and as it is, to be finished."""

    name = "operator"

    def handles(self, query: Query) -> bool:
        return bool(query.found.operators)

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for column in query.catalog.columns:
            for o in query.operators(column):
                yield from query.fitted(column, None, o, o.key)
                if OPERATORS[o.key].takes_argument:
                    yield query.explained(column, None, o, o.key, [])


class MatchedValue:
    """A matched value with the best matched operator that its column allows, else with equality."""

    name = "value"

    def handles(self, query: Query) -> bool:
        return bool(query.found.values)

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for v in query.found.values:
            column = query.catalog.get(v.column)
            usable = [o for o in query.operators(column, set(v.tokens)) if OPERATORS[o.key].takes_argument]
            best = max(usable, key=lambda o: o.score, default=None)
            operator_id = best.key if best else "eq"
            if is_valid_for(operator_id, column.type):
                yield query.explained(column, None, best, operator_id, [v])


class ColumnAndOperator:
    """A matched column and a matched operator, with what the text has for them; a date column is offered phrases, a text its frequent values."""

    name = "column and operator"

    def handles(self, query: Query) -> bool:
        return bool(query.found.columns and query.found.operators)

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for c, column in query.columns():
            for o in query.operators(column, set(c.tokens)):
                made = list(query.fitted(column, c, o, o.key))
                yield from made
                if not OPERATORS[o.key].takes_argument or any(s.args for s in made):
                    continue
                score = 0.9 * explain_score(query.total, c, o, [])
                if column.type == DataType.DATE:
                    for text, _ in date_suggestions(query.locale):
                        if parsed := parse_date(text, query.now, query.locale):
                            yield query.make(column, o.key, (parsed,), score, (c, o))
        yield from self._frequent(query)

    @staticmethod
    def _frequent(query: Query) -> Iterator[Suggestion]:
        """For the best column and its first operator, if they are the whole text. One small job."""
        for c, column in list(query.columns())[:1]:
            for o in query.operators(column, set(c.tokens)):
                if query.index is None or column.type not in _TEXTUAL or not OPERATORS[o.key].takes_argument or len({*c.tokens, *o.tokens}) < query.total:
                    continue
                for r in query.index.where(F.col("column_id") == column.id).orderBy(F.desc("row_count"), "value").limit(TOP_OF_COLUMN).collect():
                    yield query.make(column, o.key, (r["value"],), 0.9 * explain_score(query.total, c, o, []), (c, o))
                return


class _Alone:
    """For texts that name neither a column nor an operator."""

    def handles(self, query: Query) -> bool:
        return bool(query.total) and not query.found.columns and not query.found.operators


class Numbers(_Alone):
    """Numbers alone, for every number column: the more of them an operator uses, the better."""

    name = "numbers"

    def generate(self, query: Query) -> Iterator[Suggestion]:
        values = without_overlap(query.found.numbers, set())
        for column in query.catalog.columns if values else ():
            if column.type != DataType.NUMBER:
                continue
            operators = operators_for(column.type)
            for operator in operators if len(values) > 1 else operators[:ONE_LITERAL]:
                if not operator.takes_argument or operator.variadic and len(values) == 1:
                    continue
                used = values[: operator.min_arguments] if operator.min_arguments == 2 else values if operator.variadic else values[:1]
                args = tuple(sorted(v.key for v in used)) if operator.min_arguments == 2 else tuple(v.key for v in used)
                yield query.make(column, operator.id, args, LITERALS_ALONE * (0.7 + 0.3 * len(used) / len(values)), tuple(used))


class Dates(_Alone):
    """Dates alone, for every date column."""

    name = "dates"

    def generate(self, query: Query) -> Iterator[Suggestion]:
        values = without_overlap(query.found.dates, set())
        for column in query.catalog.columns if values else ():
            if column.type == DataType.DATE:
                for v in values:
                    if v.key.is_range:
                        yield query.explained(column, None, None, "between", [v])
                for operator_id in plan(operators_for(column.type), values):
                    yield from self._with(query, column, operator_id, values)

    @staticmethod
    def _with(query: Query, column: Column, operator_id: str, values: list[Match]) -> Iterator[Suggestion]:
        single = [v for v in values if not v.key.is_range]
        if operator_id == "between":
            if len(single) > 1:
                yield query.explained(column, None, None, operator_id, single[:2])
        elif values:
            yield query.explained(column, None, None, operator_id, values[:1])


def _lists(query: Query, column: Column, c: Match | None, o: Match | None, operator_ids: list[str]) -> Iterator[Suggestion]:
    """Two and more values of a column, outside the tokens of the other parts, as a list."""
    values = arguments(query.found, column, set(c.tokens if c else ()) | set(o.tokens if o else ()))
    different = list({v.key: v for v in reversed(values)}.values())[::-1]
    if len(different) > 1:
        for operator_id in operator_ids:
            yield query.explained(column, c, o, operator_id, different)


def _list_operators(column: Column) -> list[str]:
    return [o.id for o in operators_for(column.type) if o.variadic and o.min_arguments == 1]


class ManyValues(_Alone):
    """Several values of one column alone."""

    name = "values"

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for column in query.catalog.columns:
            if column.type in _TEXTUAL:
                yield from _lists(query, column, None, None, _list_operators(column))


class ColumnValues:
    """A matched column with several of its values, without an operator."""

    name = "column and values"

    def handles(self, query: Query) -> bool:
        return bool(query.found.columns and query.found.values and not query.found.operators)

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for c, column in query.columns():
            if column.type in _TEXTUAL:
                yield from _lists(query, column, c, None, _list_operators(column))


class OperatorValues:
    """A matched operator that takes a list, with several values of a column."""

    name = "operator and values"

    def handles(self, query: Query) -> bool:
        return bool(query.found.operators and query.found.values)

    def generate(self, query: Query) -> Iterator[Suggestion]:
        for column in query.catalog.columns:
            if column.type in _TEXTUAL:
                for o in query.operators(column):
                    if o.key in _list_operators(column):
                        yield from _lists(query, column, None, o, [o.key])


#: In the order in which they run.
STRATEGIES: tuple[Strategy, ...] = (EmptyText(), Spread(), MatchedColumn(), MatchedOperator(), MatchedValue(), ColumnAndOperator(), Numbers(), Dates(), ManyValues(), ColumnValues(), OperatorValues())
