"""Set algebra of keys, and filters by membership."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return keys(a, key).join(keys(b, key), key, "left_semi")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return keys(a, key).join(b.select(key), key, "left_anti")


def union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def complement(universe: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of the universe with a key in neither."""
    return universe.join(union(a, b, key), key, "left_anti")


def members(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    return rows.join(of.select(key), key, "left_semi")


def strangers(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there; null keys are strangers (``NOT IN`` would lose them)."""
    return rows.join(of.select(key), key, "left_anti")


def concat(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, in any order; other columns raise ValueError."""
    wanted = set(tables[0].columns)
    for t in tables[1:]:
        if set(t.columns) != wanted:
            raise ValueError(f"columns differ: {sorted(wanted)} and {sorted(t.columns)}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
