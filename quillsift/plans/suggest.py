"""Ranked, counted filter suggestions for free text.

Candidates come from small driver-side tables; at most two Spark jobs run: one for values that match the text, one for all counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.catalog import Catalog
from quillsift.functions.text import THRESHOLD, tokenize
from quillsift.operators.predicates import Binder
from quillsift.plans.parse import Matches, find_matches, without_overlap
from quillsift.plans.strategies import STRATEGIES, Literal, Query, Strategy, Suggestion, explain_score, value_text

SCHEMA = (
    "rank int, id string, label string, column_id string, operator string, arguments array<struct<kind:string,value:string>>, result_count bigint, score double, is_complete boolean, "
    "completion_text string, category string, query_matches array<struct<start:int,end:int,text:string,type:string,target:string,indexes:array<int>,score:double>>"
)


@dataclass(frozen=True)
class Response:
    query: str
    suggestions: tuple[Suggestion, ...]
    total_count: int
    cursor: int | None = None

    def categories(self) -> dict[str, int]:
        return dict(Counter(s.category for s in self.suggestions))


class Suggester:
    def __init__(self, catalog: Catalog, provider=None, now=None, locale: str = "en", strategies: tuple[Strategy, ...] = STRATEGIES):
        self.catalog, self.provider, self.now, self.locale, self.strategies = catalog, provider, now, locale, strategies

    def suggest(self, text: str, index: DataFrame | None, context: DataFrame, bind: Binder, limit: int, filtered: bool = False, cursor: int | None = None) -> Response:
        tokens = tokenize(text)
        found = find_matches(text, self.catalog, index, self.now, self.locale, self.provider) if tokens.tokens else Matches(tokens)
        query = Query(found, self.catalog, index, self.provider, self.now, self.locale)
        made = [s for strategy in self.strategies if strategy.handles(query) for s in strategy.generate(query)]
        if tokens.tokens:
            made = [s for s in made if s.score >= THRESHOLD]
        unique: dict[str, Suggestion] = {}
        for s in sorted(made, key=lambda s: -s.score):
            unique.setdefault(s.id, s)
        ranked = list(unique.values())
        chosen = ranked[: 2 * limit if filtered else limit]
        counted = self._counted(chosen, context, bind)
        if filtered:  # values that the context doesn't have aren't suggested
            counted = [s for s in counted if not (s.args and s.operator in ("eq", "in") and s.result_count == 0)][:limit]
        return Response(text, tuple(counted), len(ranked), cursor)

    @staticmethod
    def _counted(chosen: list[Suggestion], context: DataFrame, bind: Binder) -> list[Suggestion]:
        """All counts in one aggregation; an unfinished filter counts the rows of its context."""
        if not chosen:
            return []
        row = context.agg(F.count("*").alias("n"), *(F.count_if(bind(s.spec)).alias(f"n{i}") for i, s in enumerate(chosen) if s.is_complete)).first()
        return [replace(s, result_count=row[f"n{i}"] if s.is_complete else row["n"]) for i, s in enumerate(chosen)]


def to_rows(response: Response) -> list[tuple]:
    return [
        (
            i, s.id, s.label, s.column_id, s.operator, [(Literal.of(a).kind, value_text(a)) for a in s.args], s.result_count, float(s.score), s.is_complete, s.completion_text, s.category,
            [(m.ngram.begin, m.ngram.end, m.ngram.text, m.kind, m.text, list(m.indexes), float(m.score)) for m in s.matches],
        )
        for i, s in enumerate(response.suggestions, 1)
    ]


__all__ = ["Response", "Suggester", "Suggestion", "explain_score", "to_rows", "without_overlap"]
