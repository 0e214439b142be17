"""Statistics of fallback tiers, each a set of keys, the finest first: all groups from one pass, one join back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place() -> Column:
    """A group's tier, for ranks."""
    return F.col("_group._tier")


def all_keys(tiers: list[list[str]]) -> list[str]:
    return list(dict.fromkeys(k for keys in tiers for k in keys))


def groups(tiers: list[list[str]], nulls: bool = False) -> Column:
    """A row for each tier: its place and its keys, the other keys null; unless null keys are groups, only tiers whose keys are all known."""
    each = []
    for i, own in enumerate(tiers):
        group = F.struct(F.lit(i).alias("_tier"), *[F.when(F.lit(k in own), F.col(k)).alias(k) for k in all_keys(tiers)])
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in own], F.lit(True))
        each.append(group if nulls else F.when(known, group))
    return F.explode(F.array_compact(F.array(*each))).alias("_group")


def counted(rows: DataFrame, tiers: list[list[str]], nulls: bool, **counts: Column) -> DataFrame:
    """(_group, _x, counts) of rows with keys and _x: equal values of equal keys are counted before they are given to every tier."""
    kept = rows.groupBy(*all_keys(tiers), "_x").agg(*[c.alias(name) for name, c in counts.items()])
    return kept.select(groups(tiers, nulls), "_x", *counts)


def first_served(rows: DataFrame, stats: DataFrame, tiers: list[list[str]], nulls: bool, found: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """For each combination of keys, the statistics of the tier of lowest rank: for each (rank, columns) of `found`, a struct of rank, `_tier` and columns.

    `stats` has a row for each `_group`; a tier whose rank is null is passed
    over.  Keys are renamed `_k_<key>`; a combination that no tier serves has no row.
    """
    names = all_keys(tiers)
    met = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).select(*[F.col(k).alias(f"_k_{k}") for k in names], groups(tiers, nulls)).join(stats, "_group")
    return met.groupBy(*[f"_k_{k}" for k in names]).agg(*[F.min(F.when(rank.isNotNull(), F.struct(rank.alias("_rank"), place().alias("_tier"), *columns))).alias(name) for name, (rank, columns) in found.items()])


def join_back(df: DataFrame, served: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """`df` with what first_served found, null where nothing was."""
    names = all_keys(tiers)
    if not names:
        return df.join(F.broadcast(served), F.lit(True), "left")  # one row
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in names])
    return df.join(served, same, "left").drop(*[f"_k_{k}" for k in names])
