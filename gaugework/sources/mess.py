"""Deterministic defects for a clean table: the test-data generator.

Every rule picks its rows by arithmetic on the row key, so the same table comes
out of every run, every partitioning and every engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.session import col


@dataclass(frozen=True)
class Rule:
    """Give ``column`` the value ``value`` on the rows where ``when`` holds.

    Rules are tried in order; the first that matches a row decides.
    """

    column: str
    when: Column
    value: Column


@dataclass(frozen=True)
class Copies:
    """Repeat the rows where ``when`` holds, moving the row key by ``offset``."""

    when: Column
    offset: int = 0
    changed: dict[str, Column] = field(default_factory=dict)


def every(key: str, step: int, remainder: int) -> Column:
    return F.pmod(col(key), F.lit(step)) == remainder


def about(key: str, share: float, seed: int) -> Column:
    """A scattered share of the rows, fixed by key and seed."""
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def gaps(column: str, when: Column) -> Rule:
    return Rule(column, when, F.lit(None))


def spellings(column: str, key: str, variants: list[Column]) -> list[Rule]:
    """One spelling per remainder of the key: date formats, label cases, yes/no words."""
    return [Rule(column, every(key, len(variants), i), v) for i, v in enumerate(variants)]


def date_spellings(column: str, key: str, source: Column) -> list[Rule]:
    formats = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy")
    return spellings(column, key, [F.date_format(source, f) for f in formats])


def boolean_spellings(column: str, key: str, words: list[str]) -> list[Rule]:
    return spellings(column, key, [F.lit(w) for w in words])


def currency(column: str, when: Column, amount: Column) -> Rule:
    return Rule(column, when, F.concat(F.lit("$"), amount.cast("decimal(18,2)").cast("string")))


def inject_mess(
    df: DataFrame, row_id: str, rules: list[Rule] = (), copies: list[Copies] = ()
) -> DataFrame:
    """``df`` with the rules applied and the copies appended.

    One projection and one extra filtered scan per ``Copies``; no shuffle.
    """
    by_column: dict[str, list[Rule]] = {}
    for rule in rules:
        by_column.setdefault(rule.column, []).append(rule)
    replaced = {}
    for name, its_rules in by_column.items():
        value = col(name)
        for rule in reversed(its_rules):
            value = F.when(rule.when, rule.value).otherwise(value)
        replaced[name] = value.cast(df.schema[name].dataType)
    base = df.withColumns(replaced) if replaced else df
    result = base
    for extra in copies:
        moved = base.filter(extra.when)
        changes = {row_id: (col(row_id) + extra.offset).cast(df.schema[row_id].dataType), **extra.changed}
        result = result.unionByName(moved.withColumns(changes))
    return result
