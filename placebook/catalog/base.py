"""Registration of queries, and derivations both engines run."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from placebook.fixed_values import NAME_ENDINGS
from placebook.session import prepare
from placebook.sources.tables import read_table


class Book:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None) -> Callable:
        def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            name = run.__name__

            def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
                return run(prepare(spark), sf_dir)

            self.queries[name] = prepared
            if oracle is not None:
                self.oracles[name] = oracle
            return prepared

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derivation; ``{name}`` stands for a table, doubled braces for braces."""
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def plain(sql: str) -> str:
    """The same derivation for an engine that knows the tables by name."""
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return sql.format(**{name: name for name in names})


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(expression: str, values: list[str]) -> str:
    """SQL choosing a text by a number from 0; null beyond the list."""
    cases = " ".join(f"WHEN {i} THEN {quoted(value)}" for i, value in enumerate(values))
    return f"CASE {expression} {cases} END"


def name_key_sql(name: str) -> str:
    key = f"lower(trim(coalesce({name}, '')))"
    for ending in NAME_ENDINGS:
        key = f"replace({key}, {quoted(ending)}, '')"
    return key


def key_sql(name: str, city: str, state: str) -> str:
    return (
        f"{name_key_sql(name)} || '|' || lower(coalesce({city}, '')) || '|' || "
        f"upper(coalesce({state}, ''))"
    )


def filled_sql(columns: list[str]) -> str:
    """Number of texts that are neither null nor empty."""
    return " + ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END" for c in columns)
