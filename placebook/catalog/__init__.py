"""One query per operator over the given tables, each with the SQL it must agree with.

The tables hold no business listings, so every query derives its input from all rows of a
table. Where both sides start from the same derivation, it is one SQL text run by both engines.
"""

from placebook.catalog import files, listings, plans, runs, shapes, streams, texts

_MODULES = (listings, texts, shapes, files, plans, runs, streams)


def _merged(name: str) -> dict:
    merged = {}
    for module in _MODULES:
        merged |= getattr(module.BOOK, name)
    return merged


def queries() -> dict:
    return _merged("queries")


def oracles() -> dict[str, str]:
    return _merged("oracles")
