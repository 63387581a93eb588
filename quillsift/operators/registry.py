"""The 21 filter operators: what they apply to and the words they go by."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum
from itertools import product

from quillsift.catalog import DataType

_S, _N, _B, _D, _E, _A = DataType.STRING, DataType.NUMBER, DataType.BOOLEAN, DataType.DATE, DataType.ENUM, DataType.ARRAY


class Category(StrEnum):
    EQUALITY = "equality"
    COMPARISON = "comparison"
    SET_MEMBERSHIP = "set_membership"
    PATTERN_MATCHING = "pattern_matching"
    NULLABILITY = "nullability"
    BOOLEAN = "boolean"
    DATE = "date"


# Interchangeable words in operator names.
WORD_SETS: dict[str, tuple[str, ...]] = {
    "less": ("less", "smaller", "lower", "under"),
    "greater": ("greater", "bigger", "larger", "more", "over", "above"),
    "than": ("than",),
    "equal": ("equal", "equals", "eq"),
    "or": ("or",),
    "not": ("not",),
    "from": ("from",),
    "to": ("to", "till", "until"),
    "between": ("between",),
    "and": ("and",),
    "contains": ("contains", "has", "includes"),
    "starts": ("starts", "begins"),
    "ends": ("ends",),
    "with": ("with",),
    "is": ("is",),
    "empty": ("empty", "blank", "null", "missing"),
}


@dataclass(frozen=True)
class Operator:
    id: str
    category: Category
    label: str
    aliases: tuple[str, ...]
    types: tuple[DataType, ...]
    patterns: tuple[str, ...] = ()
    type_aliases: dict[DataType, tuple[str, ...]] = field(default_factory=dict)
    takes_argument: bool = True
    variadic: bool = False
    min_arguments: int = 1
    spreads: tuple[tuple[str, str], ...] = ()


# Labels, aliases and alias patterns (a part with ? may be left out) of the operators, in registry order.
_ALL = (
    Operator("eq", Category.EQUALITY, "equals", ("equal", "equals", "is", "=", "==", "==="), (_S, _N, _B, _D, _E), type_aliases={_D: ("at", "on")}),
    Operator("neq", Category.EQUALITY, "not equals", ("!=", "!==", "<>", "≠"), (_S, _N, _B, _D, _E), ("not equal", "is? not equal")),
    Operator("eqIgnoreCase", Category.EQUALITY, "equals (ignore case)", ("equalsIgnoreCase", "eqic", "equals ignore case", "~=", "≈"), (_S,)),
    Operator("neqIgnoreCase", Category.EQUALITY, "not equals (ignore case)", ("notEqualsIgnoreCase", "neqic", "not equals ignore case", "≉"), (_S,)),
    Operator("lt", Category.COMPARISON, "less than", ("<", "before", "under"), (_N, _D), ("less than?",)),
    Operator("lte", Category.COMPARISON, "less than or equal", ("<=", "max", "at most", "≤"), (_N, _D), ("less than? or? equal",)),
    Operator("gt", Category.COMPARISON, "greater than", (">", "after"), (_N, _D), ("greater than?",)),
    Operator("gte", Category.COMPARISON, "greater than or equal", (">=", "min", "at least", "≥"), (_N, _D), ("greater than? or? equal",)),
    Operator("in", Category.SET_MEMBERSHIP, "in", ("oneOf", "one of", "any of", "anyOf", "includes", "∈"), (_S, _N, _E), variadic=True),
    Operator("nin", Category.SET_MEMBERSHIP, "not in", ("notIn", "not one of", "none of", "noneOf", "excludes", "∉"), (_S, _N, _E), variadic=True),
    Operator("contains", Category.PATTERN_MATCHING, "contains", ("has", "includes", "like", "~", "⊃"), (_S, _A)),
    Operator("notContains", Category.PATTERN_MATCHING, "does not contain", ("doesNotContain", "notIncludes", "excludes", "!~", "⊅"), (_S, _A)),
    Operator("startsWith", Category.PATTERN_MATCHING, "starts with", ("prefix", "^", "^…"), (_S,), ("starts with?",)),
    Operator("endsWith", Category.PATTERN_MATCHING, "ends with", ("suffix", "$", "…$"), (_S,), ("ends with?",)),
    Operator("isEmpty", Category.NULLABILITY, "is empty", ("isNull", "null", "∅", "hasValue"), (_S, _N, _B, _D, _E, _A), ("is? empty",), takes_argument=False),
    Operator("isNotEmpty", Category.NULLABILITY, "is not empty", ("isNotNull", "notNull", "exists", "present", "≠∅"), (_S, _N, _B, _D, _E, _A), ("is? not empty",), takes_argument=False),
    Operator("isTrue", Category.BOOLEAN, "is true", ("true", "yes", "on", "enabled", "active", "✓"), (_B,), takes_argument=False),
    Operator("isFalse", Category.BOOLEAN, "is false", ("false", "no", "off", "disabled", "inactive", "✗"), (_B,), takes_argument=False),
    Operator("before", Category.DATE, "before", ("earlier", "prior to", "priorTo", "earlier than", "preceding", "until", "up to", "←"), (_D,)),
    Operator("after", Category.DATE, "after", ("later", "since", "later than", "following", "from", "starting", "→"), (_D,)),
    Operator("between", Category.DATE, "between", ("range", "within", "↔"), (_N, _D), variadic=True, min_arguments=2, spreads=(("from", "to"), ("between", "and"))),
)
OPERATORS: dict[str, Operator] = {o.id: o for o in _ALL}
_DEFAULT = {_S: "contains", _N: "eq", _B: "isTrue", _D: "eq", _E: "eq", _A: "contains"}


def expand_pattern(pattern: str, words: dict[str, tuple[str, ...]] = WORD_SETS) -> list[str]:
    """All phrases of a pattern, those with fewer optional parts first."""
    parts = [(p.rstrip("?"), p.endswith("?")) for p in pattern.split()]
    optional = [i for i, (_, may) in enumerate(parts) if may]
    out: list[str] = []
    for chosen in sorted(product((False, True), repeat=len(optional)), key=lambda c: c[::-1]):
        used = dict(zip(optional, chosen, strict=True))
        keys = [key for i, (key, _) in enumerate(parts) if used.get(i, True)]
        out += map(" ".join, product(*(words.get(k, (k,)) for k in keys)))
    return out


def expand_patterns(patterns: tuple[str, ...], words: dict[str, tuple[str, ...]] = WORD_SETS) -> list[str]:
    return list(dict.fromkeys(a for p in patterns for a in expand_pattern(p, words)))


def spread_pairs(words: dict[str, tuple[str, ...]] = WORD_SETS) -> list[tuple[str, str]]:
    """(start, separator) keywords of ranges such as from X to Y."""
    return [pair for a, b in OPERATORS["between"].spreads for pair in product(words[a], words[b])]


def spread_starts(words: dict[str, tuple[str, ...]] = WORD_SETS) -> set[str]:
    return {a.lower() for a, _ in spread_pairs(words)}


def spread_separators(words: dict[str, tuple[str, ...]] = WORD_SETS) -> set[str]:
    return {b.lower() for _, b in spread_pairs(words)}


def all_operators() -> list[Operator]:
    return list(_ALL)


def get_operator(operator_id: str) -> Operator:
    return OPERATORS[operator_id]


def is_operator(operator_id: str) -> bool:
    return operator_id in OPERATORS


def operators_for(kind: DataType) -> list[Operator]:
    return [o for o in _ALL if kind in o.types]


def operators_in(category: Category) -> list[Operator]:
    return [o for o in _ALL if o.category == category]


def categories() -> list[Category]:
    return list(Category)


def is_valid_for(operator_id: str, kind: DataType) -> bool:
    return operator_id in OPERATORS and kind in OPERATORS[operator_id].types


def default_operator(kind: DataType) -> str:
    return _DEFAULT[kind]


def aliases_of(operator_id: str, kind: DataType | None = None, provider=None) -> list[str]:
    """Aliases with those that patterns give, and those for one type."""
    o = OPERATORS[operator_id]
    given = provider.operator_aliases(operator_id) if provider else None
    words = provider.word_sets() if provider else WORD_SETS
    own = list(given if given is not None else o.aliases) + expand_patterns(o.patterns, {**WORD_SETS, **words})
    return list(dict.fromkeys([*own, *(o.type_aliases.get(kind, ()) if kind else ())]))


def label_of(operator_id: str, provider=None) -> str:
    return (provider and provider.operator_label(operator_id)) or OPERATORS[operator_id].label


def search_terms(operator_id: str, kind: DataType | None = None, provider=None) -> list[str]:
    return [operator_id, label_of(operator_id, provider), *aliases_of(operator_id, kind, provider)]


def is_alias(alias: str, operator_id: str, kind: DataType | None = None) -> bool:
    return alias.lower() in {a.lower() for a in aliases_of(operator_id, kind)}
