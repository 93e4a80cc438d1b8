"""Short texts that sum up a profile: the facts a written summary starts from.

They hold statistics only, never rows of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.plans.profile import Profile, one_decimal
from gaugework.plans.views import with_warnings

LISTED = 5


def _listing(table: DataFrame, when: Column, order: Column, text: Column, nothing: str) -> str:
    """The first five matching columns, joined; ``nothing`` when there are none."""
    found = table.filter(when).orderBy(F.desc(order), F.asc("position")).limit(LISTED)
    return ", ".join(r[0] for r in found.select(text).collect()) or nothing


def _missing_listing(table: DataFrame) -> str:
    text = F.concat("column", F.lit(" ("), one_decimal(F.col("missing_pct")), F.lit("%)"))
    return _listing(table, F.col("missing_count") > 0, F.col("missing_pct"), text, "none")


def _outlier_listing(table: DataFrame) -> str:
    text = F.concat("column", F.lit(" ("), F.col("iqr_count").cast("string"), F.lit(")"))
    return _listing(table, F.col("iqr_count") > 0, F.col("iqr_count"), text, "none detected")


def overview_facts(profile: Profile, table: DataFrame) -> DataFrame:
    """One row: size, score, grade, duplicates, mismatches, worst columns."""
    mismatches = F.col("mismatches")
    counted = table.agg(F.count_if("type_mismatch").alias("mismatches"))
    data = profile.dataset_summary(table).first()
    return counted.select(
        F.lit(data["rows"]).cast("bigint").alias("rows"),
        F.lit(data["columns"]).cast("bigint").alias("columns"),
        F.lit(data["quality_score"]).alias("quality_score"),
        F.lit(data["quality_grade"]).alias("quality_grade"),
        F.lit(_missing_listing(table)).alias("missing_summary"),
        F.lit(profile.exact_duplicates["exact_count"]).cast("bigint").alias("duplicate_count"),
        F.when(mismatches > 0, F.concat(mismatches.cast("string"), F.lit(" column(s)")))
        .otherwise("none")
        .alias("type_issues"),
        F.lit(_outlier_listing(table)).alias("outlier_summary"),
    )


def _plain_number(value: Column) -> Column:
    """The number with its significant decimals, at least one, never an exponent."""
    return F.regexp_replace(value.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0*$", "$1")


def column_facts(profile: Profile, table: DataFrame) -> DataFrame:
    """column, inferred_type, stats, missing, outliers, warnings as text."""
    shown = {n: _plain_number(F.col(n)) for n in ("mean", "median", "std", "min", "max")}
    shown["unique_count"] = F.col("unique_count").cast("string")
    present = [F.when(text.isNotNull(), F.concat(F.lit(f"{n}="), text)) for n, text in shown.items()]
    stats = F.concat_ws(", ", *present)
    return with_warnings(profile, table).select(
        "column",
        "inferred_type",
        F.when(stats == "", "n/a").otherwise(stats).alias("stats"),
        F.concat(one_decimal(F.col("missing_pct")), F.lit("%")).alias("missing"),
        F.col("iqr_count").alias("outliers"),
        F.when(F.size("warnings") == 0, "none").otherwise(F.concat_ws("; ", "warnings")).alias("warnings"),
    )


def column_digest(table: DataFrame) -> DataFrame:
    """position, digest: ``column (type, missing, outliers, mismatch)``."""
    tags = F.array_compact(
        F.array(
            F.col("inferred_type"),
            F.when(F.col("missing_count") > 0, F.concat(one_decimal(F.col("missing_pct")), F.lit("% missing"))),
            F.when(F.col("iqr_count") > 0, F.concat(F.col("iqr_count").cast("string"), F.lit(" outliers"))),
            F.when(F.col("type_mismatch"), F.lit("type mismatch")),
        )
    )
    text = F.concat("column", F.lit(" ("), F.concat_ws(", ", tags), F.lit(")"))
    return table.select("position", "column", text.alias("digest"))


def digest(profile: Profile, table: DataFrame) -> DataFrame:
    """One row: all columns in a line, worst columns, first recommendations."""
    entries = F.sort_array(F.collect_list(F.struct("position", "digest")))
    columns = column_digest(table).agg(F.concat_ws("; ", F.transform(entries, lambda e: e["digest"])).alias("columns"))
    recommended = profile.recommendations(table).limit(LISTED).collect()
    advice = "; ".join(f"{r['severity']} — {r['message']}" for r in recommended) or "none"
    return columns.select(
        "columns",
        F.lit(_missing_listing(table)).alias("missing_summary"),
        F.lit(profile.exact_duplicates["exact_count"]).cast("bigint").alias("duplicate_count"),
        F.lit(_outlier_listing(table)).alias("outlier_summary"),
        F.lit(advice).alias("recommendations"),
    )


def issue_list(profile: Profile, table: DataFrame) -> DataFrame:
    """rank, line: ``- [SEVERITY] [column] message``."""
    place = F.coalesce(F.concat(F.lit(" ["), "column", F.lit("]")), F.lit(""))
    line = F.concat(F.lit("- ["), F.upper("severity"), F.lit("]"), place, F.lit(" "), "message")
    return profile.recommendations(table).select("rank", line.alias("line"))


def issue_columns(table: DataFrame) -> DataFrame:
    """The columns with gaps, outliers or a type mismatch."""
    issue = (F.col("missing_count") > 0) | (F.col("iqr_count") > 0) | F.col("type_mismatch")
    return table.filter(issue).select("position", "column")
