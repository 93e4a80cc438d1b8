"""Missing values: counts, which gaps occur together, and what gaps go with.

The gaps of a row are one bitmap per block of eight columns. Rows are summed
per distinct bitmap, of which a block has 255 at most, and only these sums are
spread over the columns of the bitmap (its targets): what is shuffled is
bounded by the number of columns (and of labels), not by rows or gaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, Thresholds
from gaugework.functions import scalars as S
from gaugework.functions.tails import association_p_udf
from gaugework.operators.stats import rounded
from gaugework.operators.summary import finite_view, summarise
from gaugework.operators.types import CATEGORY_TYPES, NUMERIC_TYPES
from gaugework.session import chunks, col, cut_lineage, small_frame

PER_COLUMN_SCHEMA = "column string, missing_count bigint, missing_pct double"
OVERALL_SCHEMA = "total_missing_cells bigint, overall_missing_pct double"
MIXED_METHOD = "point_biserial"
BLOCK = 8  # columns in a bitmap of gaps: at most 255 bitmaps a block


def null_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    rows, counts = 0, {}
    for part in chunks(list(columns), 100):
        metrics = ["count(1)"] + [f"count_if(`{c}` IS NULL)" for c in (n.replace("`", "``") for n in part)]
        rows, *found = df.selectExpr(*metrics).first()
        counts |= dict(zip(part, found))
    return rows, counts


def missing_per_column(df: DataFrame, columns: list[str]) -> DataFrame:
    rows, counts = null_counts(df, columns)
    found = [
        {"column": c, "missing_count": n, "missing_pct": rounded(n / rows * 100, 2) if rows else 0.0}
        for c, n in counts.items()
    ]
    return small_frame(df.sparkSession, found, PER_COLUMN_SCHEMA)


def overall(rows: int, counts: dict[str, int]) -> dict:
    cells, missing = rows * len(counts), sum(counts.values())
    return {
        "total_missing_cells": missing,
        "overall_missing_pct": rounded(missing / cells * 100, 2) if cells else 0.0,
    }


def missing_overall(df: DataFrame, columns: list[str]) -> DataFrame:
    return small_frame(df.sparkSession, [overall(*null_counts(df, columns))], OVERALL_SCHEMA)


def _by_pattern(df: DataFrame, targets: list[str], kept: dict[str, Column], complete: bool = False) -> DataFrame:
    """``_block``, ``_gaps`` (bitmap) and the ``kept`` expressions of each row, once for each
    block of targets with a gap; with ``complete`` block 0 also has the rows without gaps."""
    bits = [
        reduce(Column.bitwiseOR, [F.when(col(t).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(part)])
        for part in chunks(targets, BLOCK)
    ]
    values = [c.alias(n) for n, c in kept.items()]
    if len(bits) == 1:
        rows = df.select(F.lit(0).alias("_block"), bits[0].alias("_gaps"), *values)
    else:
        entries = F.array(*[F.struct(F.lit(i).alias("_block"), b.alias("_gaps")) for i, b in enumerate(bits)])
        rows = df.select(F.explode(entries).alias("_e"), *values).select("_e.*", *kept)
    wanted = F.col("_gaps") > 0
    return rows.filter(wanted | (F.col("_block") == 0) if complete else wanted)


def _spread(patterns: DataFrame, targets: list[str], kept: list[Column], whole: bool = False) -> DataFrame:
    """One row per pattern and target in it; with ``whole`` also one of no target for each row of block 0."""
    bit, names = F.col("_bit"), F.array(*map(F.lit, targets))
    present = (bit >= 0) & (F.getbit("_gaps", F.greatest(bit, F.lit(0))) == 1)
    named = F.when(bit >= 0, F.get(names, F.col("_block") * BLOCK + bit))
    spread = patterns.withColumn("_bit", F.explode(F.array(*map(F.lit, range(-1 if whole else 0, BLOCK)))))
    wanted = present | ((bit < 0) & (F.col("_block") == 0)) if whole else present
    return spread.filter(wanted).select(named.alias("target"), *kept)


def gap_sums(df: DataFrame, targets: list[str], numbers: dict[str, Column], partners: list[str]) -> DataFrame:
    """target, column, numeric, k, s: over the rows where ``target`` is missing, how many values
    a number has (``k``) and their sum (``s``); for ``partners``, how many of their gaps are there."""
    kept = {f"x{i}": x for i, x in enumerate(numbers.values())}
    flags = {f"n{i}": col(c).isNull() for i, c in enumerate(partners)}
    counts = {**{f"k{i}": F.count(x) for i, x in enumerate(kept)}, **{n: F.count_if(F.col(n)) for n in flags}}
    totals = {f"s{i}": F.sum(x) for i, x in enumerate(kept)}
    patterns = _by_pattern(df, targets, kept | flags).groupBy("_block", "_gaps").agg(
        *[x.alias(n) for n, x in {**counts, **totals}.items()]
    )
    spread = _spread(patterns, targets, [F.col(n) for n in [*counts, *totals]])
    sums = spread.groupBy("target").agg(*[F.sum(n).alias(n) for n in [*counts, *totals]])

    def entry(name: str, numeric: bool, k: str, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column"), F.lit(numeric).alias("numeric"), F.col(k).alias("k"), s.alias("s")
        )

    entries = [entry(c, True, f"k{i}", F.col(f"s{i}")) for i, c in enumerate(numbers)]
    entries += [entry(c, False, f"n{i}", F.lit(None).cast("double")) for i, c in enumerate(partners)]
    return sums.select("target", F.explode(F.array(*entries)).alias("e")).select("target", "e.*")


def co_occurrence(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, rows: pairs of columns missing on the same rows."""
    if len(columns) < 2:
        return small_frame(df.sparkSession, [], "column_a string, column_b string, rows bigint")
    position = F.array(*map(F.lit, columns))
    later = F.array_position(position, F.col("column")) > F.array_position(position, F.col("target"))
    return gap_sums(df, columns, {}, columns).filter(later & (F.col("k") > 0)).select(
        F.col("target").alias("column_a"), F.col("column").alias("column_b"), F.col("k").alias("rows")
    )


def missing_phi(
    df: DataFrame,
    columns: list[str] | None = None,
    thresholds: Thresholds = DEFAULTS,
    known_counts: tuple[int, dict[str, int]] | None = None,
    sums: DataFrame | None = None,
) -> DataFrame:
    """target, column, n, value: correlation of the two missing indicators.

    Only columns with enough missing and enough present rows take part.
    ``known_counts`` are the rows and the gaps per column, and ``sums`` is the
    table of ``gap_sums``, when already made.
    """
    rows, counts = known_counts or null_counts(df, columns or df.columns)
    least = thresholds.pattern_min_rows
    tested = [c for c, n in counts.items() if n >= least and rows - n >= least]
    empty = small_frame(df.sparkSession, [], "target string, column string, n bigint, value double")
    if len(tested) < 2:
        return empty
    pairs = gap_sums(df, tested, {}, tested) if sums is None else sums.filter(
        ~F.col("numeric") & F.col("target").isin(tested) & F.col("column").isin(tested)
    )
    known = F.create_map(*[x for c in tested for x in (F.lit(c), F.lit(float(counts[c])))])
    n, n1, n2 = F.lit(float(rows)), known[F.col("target")], known[F.col("column")]
    phi = (n * F.col("k") - n1 * n2) / F.sqrt(n1 * (n - n1) * n2 * (n - n2))
    return pairs.filter(F.col("target") != F.col("column")).select(
        "target", "column", F.lit(rows).cast("bigint").alias("n"), phi.alias("value")
    )


def centred(df: DataFrame, numeric: list[str], summary: dict[str, dict]) -> dict[str, Column]:
    """Numbers that vary, less their known mean, so that sums do not suffer from a large common offset."""
    varied = [c for c in numeric if summary[c]["finite"] and summary[c]["min"] < summary[c]["max"]]
    return {c: finite_view(df, c) - F.lit(summary[c]["mean"]) for c in varied}


def point_biserial(
    df: DataFrame,
    targets: list[str],
    numeric: list[str],
    summary: dict[str, dict],
    thresholds: Thresholds = DEFAULTS,
    sums: DataFrame | None = None,
) -> DataFrame:
    """target, column, n, value: correlation of a missing indicator with a number,
    over the rows where the number is finite. ``sums`` is the table of
    ``gap_sums`` over the centred numbers, when already made."""
    empty = small_frame(df.sparkSession, [], "target string, column string, n bigint, value double")
    numbers = centred(df, numeric, summary)
    if not targets or not numbers:
        return empty
    pairs = (gap_sums(df, targets, numbers, []) if sums is None else sums).filter("numeric")
    known = F.create_map(
        *[
            x
            for c in numbers
            for x in (
                F.lit(c),
                F.struct(
                    F.lit(float(summary[c]["finite"])).alias("n"),
                    F.lit(summary[c]["std"] ** 2 * (summary[c]["finite"] - 1)).alias("sxx"),
                ),
            )
        ]
    )
    fact = known[F.col("column")]
    n, missing = fact["n"], F.col("k").cast("double")
    present = n - missing
    least = thresholds.pattern_min_rows
    r = F.col("s") / F.sqrt(fact["sxx"] * missing * present / n)
    return pairs.filter(
        (F.col("target") != F.col("column")) & (missing >= least) & (present >= least)
    ).select("target", "column", n.cast("bigint").alias("n"), r.alias("value"))


def missing_cramers(
    df: DataFrame, targets: list[str], categories: list[str], thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """target, column, n, levels, chi2, value: missing indicator against a category.

    One scan counts the rows per column, label and bitmap of gaps. A label's
    total is the sum over its bitmaps; rare labels are left out.
    """
    schema = "target string, column string, n bigint, levels bigint, chi2 double, value double"
    if not targets or not categories:
        return small_frame(df.sparkSession, [], schema)
    labels = {f"c{i}": col(c).cast("string") for i, c in enumerate(categories)}
    entries = [F.struct(F.lit(c).alias("column"), F.col(x).alias("value")) for c, x in zip(categories, labels)]
    counted = (
        _by_pattern(df, targets, labels, complete=True)
        .select("_block", "_gaps", F.explode(F.array(*entries)).alias("e"))
        .select("_block", "_gaps", "e.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value", "_block", "_gaps")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    total = F.sum(F.when(F.col("_block") == 0, F.col("rows"))).over(Window.partitionBy("column", "value"))
    common = counted.withColumn("total", total).filter(F.col("total") >= thresholds.pattern_category_rows)
    # no target: all rows of the label
    cells = (
        _spread(common, targets, [F.col(c) for c in ("column", "value", "total", "rows")], whole=True)
        .groupBy("column", "value", "target")
        .agg(F.sum("rows").cast("double").alias("m"), F.first("total").alias("t"))
    )
    per_pair = cells.filter(F.col("target").isNull() | (F.col("target") != F.col("column"))).groupBy("column", "target").agg(
        F.sum("m").alias("m"),
        F.count(F.lit(1)).alias("labels"),
        F.sum(F.col("m") * F.col("m") / F.col("t")).alias("mm"),
    )
    whole, of_column = F.col("target").isNull(), Window.partitionBy("column")
    facts = per_pair.withColumns({
        "n": F.max(F.when(whole, F.col("m"))).over(of_column),
        "levels": F.max(F.when(whole, F.col("labels"))).over(of_column),
    })
    least = thresholds.pattern_min_rows
    n, m = F.col("n"), F.col("m")
    usable = facts.filter(~whole & (F.col("levels") >= 2) & (m >= least) & (n - m >= least))
    chi2 = n * (n * F.col("mm") / m - m) / (n - m)
    return usable.withColumn("chi2", F.greatest(chi2, F.lit(0.0))).select(
        "target", "column", n.cast("bigint").alias("n"), "levels", "chi2",
        S.corrected_v(F.col("chi2"), n, F.lit(2), F.col("levels")).alias("value"),
    )


def eligible_columns(types: dict[str, dict], nulls: dict[str, int]) -> tuple[list[str], list[str], list[str]]:
    """Targets (columns with gaps), numeric and categorical comparison columns; a
    category's rare levels are left out when it is tested."""
    targets = [c for c, n in nulls.items() if n]
    numeric = [c for c in nulls if types[c]["inferred_type"] in NUMERIC_TYPES]
    return targets, numeric, [c for c in nulls if types[c]["inferred_type"] in CATEGORY_TYPES] if targets else []


def associations(
    df: DataFrame,
    types: dict[str, dict],
    summary: dict[str, dict],
    thresholds: Thresholds = DEFAULTS,
) -> DataFrame:
    """All tested pairs: target, column, method, value, p_value, tests (per target)."""
    nulls = {c: f["nulls"] for c, f in summary.items()}
    targets, numeric, categories = eligible_columns(types, nulls)
    rows = next((f["rows"] for f in summary.values()), 0)
    sums = None
    if targets:
        # written once for both tests that read it; it also keeps the plan short with many columns
        sums = cut_lineage(gap_sums(df, targets, centred(df, numeric, summary), targets))
    with_number = point_biserial(df, targets, numeric, summary, thresholds, sums)
    with_category = missing_cramers(df, targets, categories, thresholds)
    with_gap = missing_phi(df, targets, thresholds, (rows, {c: nulls[c] for c in targets}), sums)

    def tested(frame: DataFrame, method: str, size: Column, free: Column | None = None) -> DataFrame:
        freedom = F.lit(None).cast("double") if free is None else free.cast("double")
        return frame.select("target", "column", F.lit(method).alias("method"), "value",
                            size.cast("double").alias("size"), freedom.alias("free"))

    united = reduce(DataFrame.unionByName, [
        tested(with_number, MIXED_METHOD, F.col("n")),
        tested(with_category, "cramers_v", F.col("chi2"), F.col("levels") - 1),
        tested(with_gap, "missing_together", F.col("n")),
    ]).withColumn("p_value", association_p_udf(F.col("value"), F.col("size"), F.col("free")))
    united = united.drop("size", "free")
    return united.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy("target")))


def related(tests: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """target, rank, column, method, value of the pairs that pass, strongest first."""
    strong = (F.abs("value") >= thresholds.pattern_strength) & (
        F.col("p_value") < F.lit(thresholds.pattern_max_p) / F.col("tests")
    )
    signed = (F.col("method") == MIXED_METHOD) | (F.col("value") > 0)
    order = Window.partitionBy("target").orderBy(F.desc(F.abs("value")), F.asc("column"))
    return (
        tests.filter(strong & signed)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= thresholds.pattern_listed)
        .select("target", "rank", "column", "method", F.bround("value", 3).alias("value"))
    )


def pattern_label(missing: int, tested: bool, found: bool) -> str:
    """none, unknown (nothing could be tested), MAR, or MCAR."""
    if missing == 0:
        return "none"
    if not tested:
        return "unknown"
    return "MAR" if found else "MCAR"


def pattern_facts(
    df: DataFrame, types: dict[str, dict], summary: dict[str, dict], thresholds: Thresholds = DEFAULTS
) -> dict[str, dict]:
    """{column: missing_pattern, missing_related_to} (None when not tested)."""
    if not any(f["nulls"] for f in summary.values()):
        return {c: {"missing_pattern": "none", "missing_related_to": None} for c in summary}
    tests = cut_small(associations(df, types, summary, thresholds))
    tested = {r["target"] for r in tests.select("target").distinct().collect()}
    found: dict[str, list[dict]] = {}
    for r in related(tests, thresholds).orderBy("target", "rank").collect():
        found.setdefault(r["target"], []).append({k: r[k] for k in ("column", "method", "value")})
    return {
        c: {
            "missing_pattern": pattern_label(f["nulls"], c in tested, c in found),
            "missing_related_to": found.get(c, []) if c in tested else None,
        }
        for c, f in summary.items()
    }


def cut_small(tests: DataFrame) -> DataFrame:
    """The test table (one row per tested pair of columns) held as values, so it is computed once."""
    rows = [r.asDict() for r in tests.collect()]
    schema = "target string, column string, method string, value double, p_value double, tests bigint"
    return small_frame(tests.sparkSession, rows, schema)


def missing_pattern(
    df: DataFrame, columns: list[str], types: dict[str, dict], thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """column, missing_count, missing_pattern."""
    summary = summarise(df, columns)
    facts = pattern_facts(df, types, summary, thresholds)
    rows = [
        {"column": c, "missing_count": summary[c]["nulls"], "missing_pattern": facts[c]["missing_pattern"]}
        for c in columns
    ]
    return small_frame(df.sparkSession, rows, "column string, missing_count bigint, missing_pattern string")
