"""The tables behind the report's charts and panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, Thresholds
from gaugework.functions import scalars as S
from gaugework.operators.outliers import outlier_rules, rows_matching
from gaugework.operators.quantiles import exact_quantiles
from gaugework.operators.summary import finite_view, kinds, number_view
from gaugework.plans.profile import Profile, one_decimal
from gaugework.session import col, cut_lineage, round_small, small_frame

KDE_REACH = 9.0  # in bandwidths; beyond it a kernel adds less than 1e-17 of its peak


# -- over the column table ---------------------------------------------------


def type_distribution(table: DataFrame) -> DataFrame:
    return table.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("columns"))


def missing_ranking(table: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """column, missing_pct, band of the columns with gaps, worst first."""
    pct = F.col("missing_pct")
    band = F.when(pct >= thresholds.missing_red_flag * 100, "red").when(pct >= 10, "orange").otherwise("yellow")
    ranked = table.filter(F.col("missing_count") > 0).orderBy(F.desc(pct), F.asc("position"))
    return ranked.select("column", "missing_pct", band.alias("band"))


def with_warnings(profile: Profile, table: DataFrame) -> DataFrame:
    return table.join(profile.warnings(table).select("column", "warnings"), "column")


def column_summary(profile: Profile, table: DataFrame) -> DataFrame:
    """The eight-field overview row per column."""
    return with_warnings(profile, table).select(
        "column", "storage_type", "inferred_type",
        F.when(F.col("type_mismatch"), "Yes").otherwise("No").alias("type_mismatch"),
        "missing_count", F.concat(one_decimal(F.col("missing_pct")), F.lit("%")).alias("missing_pct"),
        F.col("missing_pattern").alias("pattern"), F.size("warnings").alias("warnings"),
    )


def headline(profile: Profile, table: DataFrame) -> DataFrame:
    """rows, columns, overall_missing_pct, type_mismatches, total_warnings: one row."""
    counted = with_warnings(profile, table).agg(
        F.count_if("type_mismatch").alias("type_mismatches"), F.sum(F.size("warnings")).alias("total_warnings")
    )
    data = profile.dataset_summary(table).first()
    return counted.select(
        F.lit(data["rows"]).cast("bigint").alias("rows"), F.lit(data["columns"]).cast("bigint").alias("columns"),
        F.lit(data["overall_missing_pct"]).alias("overall_missing_pct"), "type_mismatches", "total_warnings",
    )


def column_filter(
    profile: Profile,
    table: DataFrame,
    types: list[str] | None = None,
    issues_only: bool = False,
    sort_by: str = "column",
    first: str | None = None,
) -> DataFrame:
    """Columns of the wanted types, optionally only those with an issue, sorted
    by column, missing, warnings or type; ``first`` is moved to the front."""
    found = with_warnings(profile, table).withColumn("warning_count", F.size("warnings"))
    if types is not None:
        found = found.filter(F.col("inferred_type").isin(*types))
    if issues_only:
        found = found.filter(
            F.col("type_mismatch") | (F.col("missing_count") > 0) | (F.col("warning_count") > 0)
        )
    orders = {
        "column": [F.asc("column")],
        "missing": [F.desc("missing_pct"), F.asc("position")],
        "warnings": [F.desc("warning_count"), F.asc("position")],
        "type": [F.asc("inferred_type"), F.asc("position")],
    }
    ahead = [F.desc(F.col("column") == first)] if first else []
    return found.orderBy(*ahead, *orders[sort_by]).select(
        "column", "inferred_type", "type_mismatch", "missing_pct", "warning_count"
    )


def outlier_ranking(table: DataFrame, method: str = "iqr") -> DataFrame:
    """column, inferred_type, outliers, outlier_pct of the numeric columns, most first."""
    numeric = table.filter(F.col("inferred_type").isin("numeric", "mixed"))
    return numeric.orderBy(F.desc(f"{method}_count"), F.asc("position")).select(
        "column", "inferred_type", F.col(f"{method}_count").alias("outliers"), F.col(f"{method}_pct").alias("outlier_pct")
    )


def cramers_table(pairs: DataFrame) -> DataFrame:
    rounded = round_small(pairs.select("col_a", "col_b", F.col("value").alias("cramers_v")), 4, "cramers_v")
    return rounded.orderBy(F.desc_nulls_last("cramers_v"), "col_a", "col_b")


def recommendation_counts(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


# -- over the rows -----------------------------------------------------------


def preview(df: DataFrame, row_id: str, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(col(row_id)).limit(thresholds.preview_rows)


def null_matrix(df: DataFrame, row_id: str, columns: list[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """row id, column, missing (0/1) of every row, for the columns with a gap."""
    entries = [F.struct(F.lit(c).alias("column"), col(c).isNull().cast("int").alias("missing")) for c in columns]
    cells = df.select(col(row_id), F.explode(F.array(*entries)).alias("e")).select(row_id, "e.*")
    gappy = cells.groupBy("column").agg(F.max("missing").alias("any")).filter(F.col("any") == 1).select("column")
    return cells.join(gappy, "column", "left_semi").select(row_id, "column", "missing")


def _equal_bins(values: DataFrame, low: float, high: float, bins: int, rows: int) -> DataFrame:
    """bin, bin_start, bin_end, count, density of the non-empty bins of ``x``."""
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counted = values.select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        "count",
        (F.col("count") / F.lit(rows * width)).alias("density"),
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins over the finite numbers: min(40, max(5, n // 5)) of them."""
    values = df.select(finite_view(df, column).alias("x")).filter(F.col("x").isNotNull())
    rows, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not rows:
        return values.selectExpr("0 bin", "x bin_start", "x bin_end", "0L count", "x density").limit(0)
    return _equal_bins(values, low, high, min(40, max(5, rows // 5)), rows)


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, bin, bin_start, bin_end, count, density: ``histogram`` of every column, from two scans.

    The first finds each column's edges, one row a column; these are broadcast to the second, which
    counts by column and bin.  Nothing comes to the driver.  Columns without a finite number have no bins.
    """
    entries = [F.struct(F.lit(c).alias("column"), finite_view(df, c).alias("x")) for c in columns]
    cells = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(F.col("x").isNotNull())
    bins = F.least(F.lit(40), F.greatest(F.lit(5), F.floor(F.col("rows") / 5))).cast("int")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    edges = (
        cells.groupBy("column")
        .agg(F.count("x").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
        .withColumn("bins", bins)
        .withColumn("width", F.when(width == 0, 1.0).otherwise(width))
    )
    at = F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")).cast("int"), F.col("bins") - 1)
    counted = (
        cells.join(F.broadcast(edges), "column")
        .groupBy("column", at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), *[F.first(n).alias(n) for n in ("rows", "low", "width")])
    )
    return counted.select(
        "column", "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        "count", (F.col("count") / (F.col("rows") * F.col("width"))).alias("density"),
    )


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Bins over the text lengths: at most 30, at most one per distinct length."""
    lengths = df.select(F.length(col(column)).cast("double").alias("x")).filter(F.col("x").isNotNull())
    by_length = lengths.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rows, low, high, distinct = by_length.agg(F.sum("n"), F.min("x"), F.max("x"), F.count("x")).first()
    if not rows:
        return lengths.selectExpr("0 bin", "x bin_start", "x bin_end", "0L count", "x density").limit(0)
    return _equal_bins(lengths, low, high, min(30, distinct), rows)


def kde(df: DataFrame, column: str, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """point, x, density: Gaussian kernel density on 300 points, Scott bandwidth.

    A value only reaches the grid points within nine bandwidths, so it is handed
    to those alone; the bandwidth shrinks with the table, and so does the fan-out.
    """
    schema = "point int, x double, density double"
    values = df.select(finite_view(df, column).alias("v")).filter(F.col("v").isNotNull())
    rows, low, high, std = values.agg(F.count("v"), F.min("v"), F.max("v"), F.stddev_samp("v")).first()
    if rows < 5 or not std:
        return small_frame(df.sparkSession, [], schema)
    points = thresholds.kde_points
    bandwidth = std * rows ** (-1 / 5)
    step = (high - low) / (points - 1)
    place = (F.col("v") - F.lit(low)) / F.lit(step)
    reach = F.lit(KDE_REACH * bandwidth / step)
    first = F.greatest(F.ceil(place - reach).cast("int"), F.lit(0))
    last = F.least(F.floor(place + reach).cast("int"), F.lit(points - 1))
    near = values.filter(first <= last).select("v", F.explode(F.sequence(first, last)).alias("point"))
    distance = (F.lit(low) + F.col("point") * F.lit(step) - F.col("v")) / F.lit(bandwidth)
    summed = near.groupBy("point").agg(F.sum(F.exp(distance * distance / -2)).alias("s"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    scale = rows * bandwidth * (2 * 3.141592653589793) ** 0.5
    return grid.join(summed, "point", "left").select(
        "point",
        (F.lit(low) + F.col("point") * F.lit(step)).alias("x"),
        (F.coalesce("s", F.lit(0.0)) / F.lit(scale)).alias("density"),
    )


def period_counts(df: DataFrame, column: str) -> DataFrame:
    """period, period_start, count: years above 730 days of range, months above
    60, else weeks from Monday."""
    t = S.as_timestamp(col(column), kinds(df)[column])
    times = df.select(t.alias("t")).filter(F.col("t").isNotNull())
    low, high = times.agg(F.min("t"), F.max("t")).first()
    days = (high - low).days if low is not None else 0
    period = "year" if days > 730 else "month" if days > 60 else "week"
    start = F.date_trunc(period, "t").cast("timestamp")
    counted = times.groupBy(start.alias("period_start")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.lit(period).alias("period"), "period_start", "count").orderBy("period_start")


def five_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, q1, median, q3, max of the finite numbers."""
    found = exact_quantiles(df, {c: finite_view(df, c) for c in columns}, (0.0, 0.25, 0.5, 0.75, 1.0))
    rows = [{"column": c, **dict(zip(("min", "q1", "median", "q3", "max"), found[c]))} for c in columns]
    schema = "column string, min double, q1 double, median double, q3 double, max double"
    return small_frame(df.sparkSession, rows, schema)


def _draw_order(df: DataFrame, row_id: str, seed: int) -> Column:
    whole = df.schema[row_id].dataType.typeName() in ("byte", "short", "integer", "long")
    spread = F.pmod(col(row_id).cast("bigint"), F.lit(2**31 - 1)) * F.lit(2_654_435_761) + F.lit(seed)
    return F.pmod(spread, F.lit(2**32)) if whole else F.xxhash64(col(row_id), F.lit(seed))


def _strip(df: DataFrame, row_id: str, draw: Column) -> Column:
    """Strip of the draw order, rising with it: 4,096 of equal width."""
    whole = df.schema[row_id].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.shiftright(draw, 20 if whole else 52)


def boxplot_points(
    profile: Profile, column: str, method: str = "iqr", seed: int = 42, thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """kind, row id, value: every outlier, and 300 of the other values, picked by
    arithmetic on a whole-number row id or else by its hash."""
    df, row_id = profile.frame, profile.row_id
    rule: Column = profile.outlier_rules[column][method]
    marked = rows_matching(df, row_id, {column: {method: rule}}, (method,))
    outliers = marked.select(F.lit("outlier").alias("kind"), row_id, "value")
    values = df.select(col(row_id), finite_view(df, column).alias("value"), rule.alias("out"))
    normal = values.filter(F.col("value").isNotNull() & ~F.col("out"))
    shown = normal.orderBy(_draw_order(df, row_id, seed), col(row_id)).limit(thresholds.boxplot_sample)
    return outliers.unionByName(shown.select(F.lit("normal").alias("kind"), row_id, "value"))


def boxplot_points_all(
    profile: Profile, method: str = "iqr", seed: int = 42, thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """column, kind, row id, value: ``boxplot_points`` of every number column.  One scan gives the outliers; one counts
    the others by strips of the draw order, and one orders only those in the strips that hold the first 300 a column."""
    row_id, frame = profile.row_id, profile.frame
    # texts are read as numbers once, not in every rule of every scan
    df = cut_lineage(frame.select(col(row_id), *[number_view(frame, c).alias(c) for c in profile.numeric]))
    found = outlier_rules(df, profile.numeric, profile.summary, profile.quartiles, profile.thresholds)
    rules = {c: {method: found[c][method]} for c in profile.numeric}
    marked = rows_matching(df, row_id, rules, (method,))
    outliers = marked.select("column", F.lit("outlier").alias("kind"), row_id, "value")
    entries = [
        F.when(~rules[c][method], F.struct(F.lit(c).alias("column"), finite_view(df, c).alias("value")))
        for c in profile.numeric
    ]
    if not entries:
        return outliers
    draw = _draw_order(df, row_id, seed)
    cells = df.select(col(row_id), draw.alias("_draw"), _strip(df, row_id, draw).alias("_strip"), F.array_compact(F.array(*entries)).alias("e"))
    cells = cells.select(col(row_id), "_draw", "_strip", F.explode("e").alias("e")).select(col(row_id), "_draw", "_strip", "e.*")
    cells = cells.filter(F.col("value").isNotNull())
    counted = cells.groupBy("column", "_strip").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    needed = counted.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    needed = needed.filter(F.col("_before") < thresholds.boxplot_sample)
    last = {r["column"]: r["last"] for r in needed.groupBy("column").agg(F.max("_strip").alias("last")).collect()}
    reach = reduce(lambda a, b: a | b, [(F.col("column") == c) & (F.col("_strip") <= n) for c, n in last.items()], F.lit(False))
    order = Window.partitionBy("column").orderBy("_draw", col(row_id))
    shown = cells.filter(reach).withColumn("_drawn", F.row_number().over(order))
    shown = shown.filter(F.col("_drawn") <= thresholds.boxplot_sample)
    return outliers.unionByName(shown.select("column", F.lit("normal").alias("kind"), row_id, "value"))
