"""Labels, aliases and word sets by language."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from quillsift.operators.registry import OPERATORS, WORD_SETS


class Provider(Protocol):
    def locale(self) -> str: ...
    def translate(self, key: str) -> str | None: ...
    def operator_label(self, operator_id: str) -> str | None: ...
    def operator_aliases(self, operator_id: str) -> list[str] | None: ...
    def word_sets(self) -> dict[str, tuple[str, ...]]: ...
    def on_change(self, callback: Callable[[], None]) -> Callable[[], None]: ...


class DictProvider:
    """From plain dictionaries; what a language lacks is English."""

    def __init__(self, locale: str = "en", texts: dict[str, str] | None = None, labels: dict[str, str] | None = None, aliases: dict[str, list[str]] | None = None, words: dict[str, tuple[str, ...]] | None = None):
        self._locale, self._texts, self._labels, self._aliases, self._words = locale, texts or {}, labels or {}, aliases or {}, words or {}
        self._listeners: list[Callable[[], None]] = []

    def locale(self) -> str:
        return self._locale

    def translate(self, key: str) -> str | None:
        return self._texts.get(key)

    def operator_label(self, operator_id: str) -> str | None:
        return self._labels.get(operator_id) or (OPERATORS[operator_id].label if operator_id in OPERATORS else None)

    def operator_aliases(self, operator_id: str) -> list[str] | None:
        return self._aliases.get(operator_id)

    def word_sets(self) -> dict[str, tuple[str, ...]]:
        return {**WORD_SETS, **self._words}

    def on_change(self, callback: Callable[[], None]) -> Callable[[], None]:
        self._listeners.append(callback)
        return lambda: self._listeners.remove(callback)

    def switch(self, other: DictProvider) -> None:
        """Takes another language's tables; listeners hear of it."""
        self._locale, self._texts, self._labels, self._aliases, self._words = other._locale, other._texts, other._labels, other._aliases, other._words
        for callback in list(self._listeners):
            callback()


def _language(locale: str, labels: str, **words: str) -> DictProvider:
    pairs = dict(zip(OPERATORS, labels.split("|"), strict=True))
    return DictProvider(locale, labels=pairs, aliases={k: [v, *OPERATORS[k].aliases] for k, v in pairs.items()}, words={k: tuple(v.split("|")) for k, v in words.items()})


#: Labels in registry order.
LOCALES: dict[str, Callable[[], DictProvider]] = {
    "en": DictProvider,
    "de": lambda: _language("de", "ist gleich|ist nicht gleich|gleich (ohne Groß/klein)|nicht gleich (ohne Groß/klein)|kleiner als|höchstens|größer als|mindestens|in|nicht in|enthält|enthält nicht|beginnt mit|endet mit|ist leer|ist nicht leer|ist wahr|ist falsch|vor|nach|zwischen", **{"from": "von", "to": "bis", "between": "zwischen", "and": "und"}),
    "es": lambda: _language("es", "es igual a|no es igual a|igual (sin mayúsculas)|no igual (sin mayúsculas)|menor que|menor o igual que|mayor que|mayor o igual que|en|no en|contiene|no contiene|empieza por|termina en|está vacío|no está vacío|es verdadero|es falso|antes de|después de|entre", **{"from": "desde|de", "to": "hasta|a", "between": "entre", "and": "y"}),
    "fr": lambda: _language("fr", "égal à|différent de|égal (sans casse)|différent (sans casse)|inférieur à|inférieur ou égal à|supérieur à|supérieur ou égal à|dans|pas dans|contient|ne contient pas|commence par|finit par|est vide|n'est pas vide|est vrai|est faux|avant|après|entre", **{"from": "de|du", "to": "à|au", "between": "entre", "and": "et"}),
}


def provider_for(locale: str) -> DictProvider:
    return LOCALES.get(locale.lower().split("-")[0], DictProvider)()
