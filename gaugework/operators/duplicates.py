"""Exact duplicate rows, and rows that differ in a single column.

A row is known by its fingerprint, two 128-bit halves: one of its first columns
and one of its last.  Only ids and fingerprints are shuffled; a row's values
are read again only when they are part of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS
from gaugework.functions import scalars as S
from gaugework.operators.skew import join_on_counted_keys
from gaugework.session import col, cut_lineage, cut_wide_lineage

_FIRST, _LAST = ["_first_a", "_first_b"], ["_last_a", "_last_b"]
_PRINT = [*_FIRST, *_LAST]
_COPIES, _POSITION, _KEY = "_copies", "_position", ["_key_a", "_key_b"]
_SIDE, _ODD = "_side", ["_odd_a", "_odd_b"]
BROADCAST_IDS = 1_000_000  # ids of a side that is broadcast, at most
OWN_ID = "_own_id"


def _plain(df: DataFrame, name: str) -> Column:
    """The value with one spelling per number: no NaN, no negative zero."""
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return S.nan_to_null(col(name)) + F.lit(0.0)
    return col(name)


def _term(df: DataFrame, name: str, position: int, seed: int) -> Column:
    """Hash of one cell and its position; NULL differs from every value."""
    value = _plain(df, name)
    return F.xxhash64(F.lit(seed), F.lit(position), value.isNull(), value)


def _parts(columns: list[str]) -> tuple[range, range]:
    """Positions of the first and of the last columns."""
    middle = len(columns) // 2
    return range(middle), range(middle, len(columns))


def _halves(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """The fingerprint: per half and seed one hash over all cells; NULL differs from every value."""
    found = {}
    for names, part in zip((_FIRST, _LAST), _parts(columns)):
        values = [_plain(df, columns[i]) for i in part]
        cells = [x for value in values for x in (value.isNull(), value)]
        for seed, name in enumerate(names, 1):
            found[name] = F.xxhash64(F.lit(seed), *cells)
    return found


def fingerprints(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Row id and fingerprint of every row, written once for all that follows."""
    return cut_wide_lineage(df.select(col(row_id), *[v.alias(n) for n, v in _halves(df, columns).items()]))


def numbered(df: DataFrame) -> DataFrame:
    """The table with an id of its own, written so that the ids hold; for tables without one."""
    return cut_lineage(df.withColumn(OWN_ID, F.monotonically_increasing_id()))


def exact_duplicates(df: DataFrame, columns: list[str], prints: DataFrame | None = None) -> DataFrame:
    """rows, exact_count (droppable rows), exact_pct, rows_in_groups: one row.

    One scan and one exchange, of fingerprints counted by each task.
    """
    prints = df.select(*[v.alias(n) for n, v in _halves(df, columns).items()]) if prints is None else prints
    groups = prints.groupBy(*_PRINT).agg(F.count(F.lit(1)).alias(_COPIES))
    counted = groups.agg(
        F.coalesce(F.sum(_COPIES), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col(_COPIES) - 1), F.lit(0)).alias("exact_count"),
        F.coalesce(F.sum(F.when(F.col(_COPIES) > 1, F.col(_COPIES))), F.lit(0)).alias("rows_in_groups"),
    )
    share = F.bround(F.try_divide(F.col("exact_count") * 100, F.col("rows")), 2)
    return counted.select("rows", "exact_count", F.coalesce(share, F.lit(0.0)).alias("exact_pct"), "rows_in_groups")


def duplicate_ids(prints: DataFrame, row_id: str) -> DataFrame:
    """Ids of the rows that have an exact copy, the first of each group included."""
    repeated = prints.groupBy(*_PRINT).agg(F.count(F.lit(1)).alias(_COPIES)).filter(F.col(_COPIES) > 1)
    return join_on_counted_keys(prints, repeated, _PRINT, _COPIES, "left_semi", [row_id]).select(col(row_id))


def duplicate_rows(df: DataFrame, columns: list[str], row_id: str, prints: DataFrame | None = None) -> DataFrame:
    """Every row that has an exact copy, including the first of each group."""
    prints = fingerprints(df, columns, row_id) if prints is None else prints
    ids = cut_lineage(duplicate_ids(prints, row_id))
    return rows_with_ids(df, ids, row_id).select(col(row_id), *[_plain(df, c).alias(c) for c in columns])


def near_duplicate_ids(
    df: DataFrame, columns: list[str], row_id: str, unique_columns: list[str] = (), prints: DataFrame | None = None
) -> DataFrame:
    """Row ids equal to some other row on all columns but one, without the rows
    that have an exact copy.

    Two such rows agree on one half of their columns, so first the rows that
    share a half with a different row are found.  Each of these gives one key
    per column of the other half, its fingerprint without that column; a key
    counts when rows under it differ there.  ``unique_columns`` are columns known to repeat no value;
    two rows always differ there, so with one such column no other column can
    be the odd one out, and with two there are no near-duplicates.
    """
    if len(columns) < 2 or len(unique_columns) > 1:
        return df.select(col(row_id)).limit(0)
    prints = fingerprints(df, columns, row_id) if prints is None else prints
    shared = [
        _differing(prints, same, other, row_id).withColumn(_SIDE, F.lit(side))
        for side, (same, other) in enumerate(((_LAST, _FIRST), (_FIRST, _LAST)))
    ]
    sides = F.collect_set(_SIDE).alias(_SIDE)  # of the odd column: 0 among the first, 1 among the last
    thinned = cut_lineage(shared[0].unionByName(shared[1]).groupBy(col(row_id)).agg(sides))
    rows = rows_with_ids(df, thinned, row_id, "inner")
    whole, keys = _halves(rows, columns), []
    for side, (part, same) in enumerate(zip(_parts(columns), (_LAST, _FIRST))):
        terms = {i: [_term(rows, columns[i], i, seed) for seed in (1, 2)] for i in part}
        rest = [reduce(lambda a, b: a.bitwiseXOR(b), t, whole[name]) for t, name in zip(zip(*terms.values()), same)]
        rows = rows.withColumns({f"_rest{side}{s}": x for s, x in enumerate(rest)})
        for i in part:
            if unique_columns and columns[i] not in unique_columns:
                continue
            without = [F.col(f"_rest{side}{s}").bitwiseXOR(terms[i][s]).alias(_KEY[s]) for s in (0, 1)]
            own = [t.alias(name) for t, name in zip(terms[i], _ODD)]
            keys.append(F.when(F.array_contains(_SIDE, side), F.struct(F.lit(i).alias(_POSITION), *without, *own)))
    exploded = rows.select(col(row_id), F.explode(F.array_compact(F.array(*keys))).alias("k"))
    keyed = cut_wide_lineage(exploded.select(col(row_id), "k.*"))
    candidates = _differing(keyed, [_POSITION, *_KEY], _ODD, row_id).distinct()
    return candidates.join(duplicate_ids(prints, row_id), row_id, "left_anti")


def _differing(rows: DataFrame, on: list[str], told_by: list[str], row_id: str) -> DataFrame:
    """Ids of the rows that share a key with a row of another ``told_by``."""
    ends = [f(c).alias(f"{end}{c}") for c in told_by for f, end in ((F.min, "_low"), (F.max, "_high"))]
    differ = reduce(lambda a, b: a | b, [F.col(f"_low{c}") != F.col(f"_high{c}") for c in told_by])
    shared = rows.groupBy(*on).agg(F.count(F.lit(1)).alias(_COPIES), *ends).filter(differ).select(*on, _COPIES)
    return join_on_counted_keys(rows, shared, on, _COPIES, "left_semi", [row_id]).select(col(row_id))


def near_duplicates(
    df: DataFrame, columns: list[str], row_id: str | None = None, unique_columns: list[str] = ()
) -> DataFrame:
    """near_duplicate_count and near_duplicate_pct: one row.  Without ``row_id`` the rows get ids of their own."""
    if row_id is None:
        df, row_id = numbered(df), OWN_ID
    prints = fingerprints(df, columns, row_id)
    ids = near_duplicate_ids(df, columns, row_id, unique_columns, prints)
    counted = ids.agg(F.count(F.lit(1)).alias("near_duplicate_count"))
    share = F.bround(F.try_divide(F.col("near_duplicate_count") * 100, F.lit(prints.count())), 2)
    return counted.select("near_duplicate_count", F.coalesce(share, F.lit(0.0)).alias("near_duplicate_pct"))


def first_ids(ids: DataFrame, row_id: str, limit: int = DEFAULTS.sample_ids) -> DataFrame:
    """The smallest ids: the sample a report shows."""
    return ids.select(col(row_id)).orderBy(col(row_id)).limit(limit)


def rows_with_ids(df: DataFrame, ids: DataFrame, row_id: str, how: str = "left_semi") -> DataFrame:
    """The rows behind some ids; these are broadcast only when they have been counted and are few."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, row_id, how)
