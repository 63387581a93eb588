"""A Spark-native engine for filters, facets and filter suggestions over DataFrames."""

from importlib import import_module

_PLACES = {
    "Catalog": "catalog", "Column": "catalog", "DataType": "catalog", "EnumValue": "catalog", "Engine": "engine", "EngineConfig": "engine", "FilterSpec": "operators.predicates",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Loads what is asked for, so that workers that need one module don't import the others."""
    if name in _PLACES:
        return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
    raise AttributeError(name)
