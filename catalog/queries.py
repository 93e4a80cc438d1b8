"""One query per operator, on the given tables or on messy views of them.

Each takes (spark, folder of the tables) and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import (
    MESSY_COLUMNS, WIDE_LABELS, WIDE_NUMBERS, customer_messy, events_null, orders_blank, orders_gappy, orders_messy,
    orders_wide, table, wide_columns, wide_gaps, wide_labels, wide_numbers,
)
from gaugework.functions import scalars as S
from gaugework.operators import cleaning, correlation, distributions, duplicates, frequency, missing, outliers, stats
from gaugework.operators.summary import summarise
from gaugework.operators.types import detect_types, infer_types, label_counts, parse_shares
from gaugework.plans import advice, facts, views
from gaugework.plans.pipeline import CleaningPipeline
from gaugework.plans.profile import Profile
from gaugework.session import cut_lineage, cut_wide_lineage, scratch_path
from gaugework.sources import files, mess

ID = "row_id"
TEXTS = ["status", "price_text", "date_text", "priority_label", "flag_text"]
NUMBERS = ["o_custkey", "price", "price_text", "age", "rating"]
LABELS = ["status", "priority_label", "flag_text"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DAY = "yyyy-MM-dd HH:mm:ss"


def _profile(spark: SparkSession, sf: str) -> Profile:
    return Profile(orders_messy(spark, sf), "orders_messy", row_id=ID)


def _written_profile(spark: SparkSession, sf: str) -> Profile:
    """The same on a table written once, for queries that scan it many times."""
    return Profile(cut_wide_lineage(orders_messy(spark, sf)), "orders_messy", row_id=ID)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(F.col(n), DAY) for n in names})


# -- sources and sinks -------------------------------------------------------


def scan_csv(spark, sf):
    path = files.write_csv(orders_messy(spark, sf), scratch_path(spark, "orders") + ".csv", row_id=None)
    return files.load_table(spark, path)


def sniff_separator(spark, sf):
    path = scratch_path(spark, "semicolons")
    orders_messy(spark, sf).write.option("header", True).option("sep", ";").csv(path)
    form = files.csv_format(spark, path)
    rows = files.read_csv(spark, path).agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.lit(form.separator).alias("separator"), F.lit(len(form.header)).alias("columns"), "rows")


def sniff_encoding(spark, sf):
    texts = table(spark, sf, "documents").select(F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    found = []
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = scratch_path(spark, "encoded")
        texts.write.option("encoding", encoding).csv(path)
        found.append(F.struct(F.lit(encoding).alias("written"), F.lit(files.sniff_encoding(spark, path)).alias("encoding")))
    return spark.range(1).select(F.explode(F.array(*found)).alias("e")).select("e.*")


def _token_texts(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    words = {0: "N/A", 1: "", 2: "null", 3: "NaN", 4: "none", 5: "-nan", 6: "<NA>"}
    text = F.col("o_orderpriority")
    for remainder, word in words.items():
        text = F.when(F.pmod(key, F.lit(11)) == remainder, F.lit(word)).otherwise(text)
    return table(spark, sf, "orders").select(key.alias(ID), text.alias("text"))


def null_tokens(spark, sf):
    return files.map_null_tokens(_token_texts(spark, sf))


def bad_lines(spark, sf):
    key = F.col("o_orderkey")
    shape = F.pmod(key, F.lit(50))
    cells = [key.cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")]
    whole = F.concat_ws(",", *cells)
    line = F.when(shape == 1, F.concat(whole, F.lit(",surplus"))).when(shape == 2, F.concat_ws(",", *cells[:2]))
    lines = table(spark, sf, "orders").select(line.otherwise(whole).alias("value"))
    path = scratch_path(spark, "lines")
    # one raw line per row: a column whose name is the header line, with a
    # separator that never occurs, so the writer quotes nothing
    named = lines.select(F.col("value").alias("row_id,status,priority"))
    named.write.option("header", True).option("sep", "\u0001").csv(path)
    form = files.csv_format(spark, path)
    dropped = files.bad_lines(spark, path, form).count()
    kept = files.read_csv_text(spark, path, form)
    return kept.agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if(F.col("priority").isNull()).alias("padded"),
        F.lit(dropped).cast("bigint").alias("dropped"),
    )


def input_guards(spark, sf):
    return files.input_guards(orders_messy(spark, sf))


def preview(spark, sf):
    return views.preview(orders_messy(spark, sf), ID)


def write_csv(spark, sf):
    path = files.write_csv(table(spark, sf, "events"), f"{scratch_path(spark, 'out')}-{files.cleaned_name('events.csv')}")
    return _as_text(cleaning.fix_types(files.read_csv(spark, path), "ts", "datetime"), "ts")


def csv_text_roundtrip(spark, sf):
    """Texts full of line breaks, commas and quotes, written and read again."""
    path = files.write_csv(table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "texts") + ".csv")
    return files.read_csv(spark, path).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def csv_single_file(spark, sf):
    """The same texts in one file, which several tasks read as soon as it is larger than a split.

    Only one task can write a file, so texts of more than ``files.FILE_BYTES`` go on in further files of that size.
    """
    texts = table(spark, sf, "documents").select("doc_id", "text")
    path = files.write_csv(files.in_large_files(texts, F.octet_length("text")), scratch_path(spark, "texts") + ".csv")
    return files.read_csv(spark, path).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def write_parquet(spark, sf):
    path = files.write_parquet(events_null(spark, sf), scratch_path(spark, "out") + ".parquet")
    return _as_text(files.load_table(spark, path), "ts")


def row_numbers(spark, sf):
    customers = table(spark, sf, "customer").orderBy("c_custkey")
    path = files.write_csv(customers, scratch_path(spark, "numbered") + ".csv")
    numbered = files.read_csv(spark, path, row_ids=True)
    return numbered.select("_row_id", "c_custkey")


def load_named(spark, sf):
    return files.load_named(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"))


def inject_clean(spark, sf):
    return mess.inject_mess(table(spark, sf, "supplier"), "s_suppkey")


# -- types -------------------------------------------------------------------


def detect_types_query(spark, sf):
    return detect_types(orders_messy(spark, sf), MESSY_COLUMNS)


def _shares(*names):
    def query(spark, sf):
        found = parse_shares(orders_messy(spark, sf), TEXTS).select("column", *names)
        return _rounded(found, 6, *[n for n in names if n.endswith("share")])

    return query


def _labels(*names):
    def query(spark, sf):
        found = label_counts(orders_messy(spark, sf), TEXTS).select("column", *names)
        return _rounded(found, 6, *[n for n in names if n.endswith("ratio")])

    return query


def parse_dates(spark, sf):
    parsed = S.text_to_timestamp(F.col("date_text"))
    return _as_text(orders_messy(spark, sf).select(ID, "date_text", parsed.alias("parsed")), "parsed")


# -- statistics and distributions ---------------------------------------------


def _with_infinities(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    value = F.when(F.pmod(key, F.lit(101)) == 0, F.lit(float("inf")))
    value = value.when(F.pmod(key, F.lit(103)) == 0, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    few = F.when(key < 3, F.col("o_totalprice")).when(F.pmod(key, F.lit(100)) == 50, F.lit(float("inf")))
    return table(spark, sf, "orders").select(key.alias(ID), value.alias("price"), few.alias("few"))


def numeric_coerce(spark, sf):
    return stats.coerce_numbers(orders_messy(spark, sf).select(ID, "price_text"), ["price_text"])


def infinite_count(spark, sf):
    return stats.finite_counts(_with_infinities(spark, sf), ["price", "few"])


def numeric_stats(spark, sf):
    return stats.numeric_stats(table(spark, sf, "lineitem"), LINE_NUMBERS)


def numeric_stats_messy(spark, sf):
    return stats.numeric_stats(orders_messy(spark, sf), NUMBERS)


def _shape(*names):
    def query(spark, sf):
        return stats.shape_stats(table(spark, sf, "events"), ["value", "user_id"]).select("column", *names)

    return query


def categorical_stats(spark, sf):
    return stats.categorical_stats(orders_messy(spark, sf), LABELS)


def top_values(spark, sf):
    return frequency.top_values(orders_messy(spark, sf), LABELS)


def datetime_stats(spark, sf):
    return _as_text(stats.datetime_stats(orders_messy(spark, sf), ["date_text"]), "min_date", "max_date")


def datetime_stats_events(spark, sf):
    return _as_text(stats.datetime_stats(table(spark, sf, "events"), ["ts"]), "min_date", "max_date")


def text_stats(spark, sf):
    return stats.text_stats(table(spark, sf, "documents"), ["text", "source"])


def normality_small(spark, sf):
    """Whole columns of the small tables, by the same test as the large one's."""
    found = [
        distributions.normality(table(spark, sf, name), columns)
        for name, columns in (
            ("supplier", ["s_acctbal"]), ("customer", ["c_acctbal"]), ("part", ["p_retailprice", "p_size"]),
        )
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def normaltest(spark, sf):
    found = distributions.normality(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return found.select("column", "n", "test", "p_value", "is_normal")


def datetime_gaps(spark, sf):
    return distributions.datetime_gaps(orders_gappy(spark, sf), ["o_orderdate"])


def datetime_gaps_sparse(spark, sf):
    """The same on customers' first orders, where gaps between days are real."""
    first = orders_gappy(spark, sf).groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    return distributions.datetime_gaps(first, ["first_order"])


def high_cardinality(spark, sf):
    found = distributions.high_cardinality(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return found.unionByName(distributions.high_cardinality(table(spark, sf, "customer"), ["c_name"]))


# -- missing values ----------------------------------------------------------


def missing_overall(spark, sf):
    return missing.missing_overall(orders_messy(spark, sf), MESSY_COLUMNS)


def missing_per_column(spark, sf):
    return missing.missing_per_column(orders_messy(spark, sf), MESSY_COLUMNS)


def missing_cooccurrence(spark, sf):
    return missing.co_occurrence(orders_messy(spark, sf), MESSY_COLUMNS)


def point_biserial(spark, sf):
    messy = orders_messy(spark, sf)
    found = missing.point_biserial(messy, ["price", "price_text", "rating"], NUMBERS, summarise(messy, NUMBERS))
    return _rounded(found, 4, "value")


def missing_cramers(spark, sf):
    found = missing.missing_cramers(orders_messy(spark, sf), ["price", "price_text", "rating"], LABELS)
    return _rounded(found, 4, "chi2", "value")


def missing_phi(spark, sf):
    return _rounded(missing.missing_phi(orders_messy(spark, sf), MESSY_COLUMNS), 4, "value")


def _typed(spark, sf) -> tuple[DataFrame, dict, dict]:
    messy = orders_messy(spark, sf)
    summary = summarise(messy, MESSY_COLUMNS)
    return messy, infer_types(messy, summary), summary


def missing_tests(spark, sf):
    """Every tested pair, and how many tests its target has."""
    messy, types, summary = _typed(spark, sf)
    found = missing.associations(messy, types, summary).select("target", "column", "method", "value", "tests")
    return _rounded(found, 4, "value")


def missing_p_values(spark, sf):
    """The p-value of every tested pair, to six places."""
    messy, types, summary = _typed(spark, sf)
    p = F.round(F.col("p_value"), 6).alias("p_value")
    return missing.associations(messy, types, summary).select("target", "column", "method", p, "tests")


def patterns_wide(spark, sf):
    """Sixty columns with gaps, each tested against all others."""
    wide = wide_gaps(spark, sf)
    columns = [c for c in wide.columns if c != ID]
    summary = summarise(wide, columns)
    return missing.missing_pattern(wide, columns, infer_types(wide, summary))


def missing_related(spark, sf):
    messy, types, summary = _typed(spark, sf)
    return missing.related(missing.associations(messy, types, summary))


def missing_pattern(spark, sf):
    messy, types, _ = _typed(spark, sf)
    return missing.missing_pattern(messy, MESSY_COLUMNS, types)


# -- outliers ----------------------------------------------------------------


def iqr_fences(spark, sf):
    return _rounded(outliers.iqr_fences(orders_messy(spark, sf), NUMBERS), 4, "q1", "q3", "lower", "upper")


def _flagged(method):
    def query(spark, sf):
        return outliers.outlier_rows(orders_messy(spark, sf), NUMBERS, ID, (method,)).select("column", ID, "value")

    return query


def outliers_small(spark, sf):
    return outliers.outlier_rows(_with_infinities(spark, sf), ["few"], ID).select("column", "method", ID)


def outlier_rows(spark, sf):
    return outliers.outlier_rows(orders_messy(spark, sf), NUMBERS, ID)


def outlier_rows_infinite(spark, sf):
    return outliers.outlier_rows(_with_infinities(spark, sf), ["price"], ID).select("column", "method", ID)


def outlier_summary(spark, sf):
    return outliers.outlier_summary(orders_messy(spark, sf), NUMBERS)


# -- duplicates --------------------------------------------------------------


def exact_duplicates(spark, sf):
    return duplicates.exact_duplicates(orders_messy(spark, sf), MESSY_COLUMNS)


def duplicate_rows(spark, sf):
    return duplicates.duplicate_rows(orders_messy(spark, sf), MESSY_COLUMNS, ID)


def duplicate_texts(spark, sf):
    documents = table(spark, sf, "documents")
    return duplicates.duplicate_rows(documents, ["text"], "doc_id").select("doc_id")


def near_duplicates(spark, sf):
    return duplicates.near_duplicates(orders_messy(spark, sf), MESSY_COLUMNS, ID)


def near_without_id(spark, sf):
    """The same rows as a table without a key column."""
    return duplicates.near_duplicates(orders_messy(spark, sf).drop(ID), MESSY_COLUMNS)


def near_wide(spark, sf):
    """Sixty columns, of which any single one may differ."""
    return duplicates.near_duplicate_ids(orders_wide(spark, sf), wide_columns(), ID)


def near_duplicate_ids(spark, sf):
    return duplicates.near_duplicate_ids(orders_messy(spark, sf), MESSY_COLUMNS, ID)


def near_sample(spark, sf):
    return duplicates.first_ids(near_duplicate_ids(spark, sf), ID)


def duplicate_sample(spark, sf):
    sample = duplicates.first_ids(duplicate_rows(spark, sf), ID)
    return duplicates.rows_with_ids(orders_messy(spark, sf), sample, ID)


# -- correlation -------------------------------------------------------------


def pearson(spark, sf):
    lines = table(spark, sf, "lineitem")
    summary = summarise(lines, LINE_NUMBERS)
    pairs = correlation.pearson_pairs(lines, LINE_NUMBERS, summary)
    return correlation.pearson(pairs, LINE_NUMBERS, correlation.diagonal_of(LINE_NUMBERS, summary))


def pearson_messy(spark, sf):
    pairs = correlation.pearson_pairs(orders_messy(spark, sf), NUMBERS)
    return _rounded(pairs, 4, "value")


def pearson_wide(spark, sf):
    """Thirty columns: the numbers, and multiples of them with gaps of their own."""
    return _rounded(correlation.pearson_pairs(wide_numbers(spark, sf), [f"n{i}" for i in range(WIDE_NUMBERS)]), 4, "value")


def pearson_matrix(spark, sf):
    return correlation.pearson_matrix(pearson(spark, sf), LINE_NUMBERS)


def contingency(spark, sf):
    return correlation.contingency(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def chi2(spark, sf):
    pairs = correlation.cramers_pairs(orders_messy(spark, sf), LABELS)
    return _rounded(pairs.select("col_a", "col_b", "n", "rows_a", "rows_b", "chi2"), 4, "chi2")


def cramers_v(spark, sf):
    pairs = correlation.cramers_pairs(orders_messy(spark, sf), LABELS)
    return _rounded(pairs.select("col_a", "col_b", "value"), 4, "value")


def cramers_wide(spark, sf):
    """Twenty label columns: all 190 pairs."""
    pairs = correlation.cramers_pairs(wide_labels(spark, sf), [f"g{i}" for i in range(WIDE_LABELS)])
    return _rounded(pairs.select("col_a", "col_b", "n", "value"), 4, "value")


def cramers_table(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("ship_mode", F.lower("l_returnflag"))
    return views.cramers_table(correlation.cramers_pairs(lines, ["l_returnflag", "l_linestatus", "ship_mode"]))


def high_pairs(spark, sf):
    lines = table(spark, sf, "lineitem")
    lines = lines.withColumns({"gross": F.col("l_extendedprice") * 2, "flag": F.lower("l_returnflag")})
    numbers = correlation.pearson_pairs(lines, [*LINE_NUMBERS, "gross"])
    labels = correlation.cramers_pairs(lines, ["l_returnflag", "l_linestatus", "flag"])
    return correlation.high_pairs(numbers, labels, columns=lines.columns)


def align_inner(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    return correlation.align_inner(orders, customers, "o_orderkey", "c_custkey", "o_totalprice", "c_acctbal")


# -- report ------------------------------------------------------------------


def dataset_summary(spark, sf):
    with _profile(spark, sf) as profile:
        return profile.dataset_summary().drop("name")


def quality_score(spark, sf):
    return dataset_summary(spark, sf).select("quality_score")


def quality_grade(spark, sf):
    return dataset_summary(spark, sf).select("quality_grade")


def column_warnings(spark, sf):
    with _profile(spark, sf) as profile:
        return profile.warnings().select("column", F.explode("warnings").alias("warning"))


def recommendations(spark, sf):
    with _profile(spark, sf) as profile:
        return profile.recommendations().select("severity", "category", "column", "message")


def column_report(spark, sf):
    """The whole column table, nested parts as text."""
    with _profile(spark, sf) as profile:
        found = _as_text(profile.column_table(), "min_date", "max_date")
    related = F.transform("missing_related_to", lambda r: F.concat_ws(":", r["column"], r["method"], F.format_string("%.3f", r["value"])))
    top = F.transform("top_values", lambda r: F.concat_ws(":", r["value"], r["count"].cast("string")))
    return found.withColumns({"missing_related_to": F.array_join(related, ";"), "top_values": F.array_join(top, ";")})


# -- cleaning ----------------------------------------------------------------


def _missing(strategy, column, value=None):
    def query(spark, sf):
        messy = orders_messy(spark, sf)
        cleaned = cleaning.handle_missing(messy, strategy, column, value, order_by=ID)
        if strategy == "drop_column":
            return cleaned
        return cleaned.select(ID, F.col(column))

    return query


def fill_mean(spark, sf):
    return _rounded(_missing("fill_mean", "price")(spark, sf), 4, "price")


def fill_mean_text(spark, sf):
    """The filled column read as numbers; a cell that is none stays without."""
    filled = _missing("fill_mean", "price_text")(spark, sf)
    return filled.select(ID, F.round(S.text_to_number(F.col("price_text")), 4).alias("price_text"))


def _filled_events(strategy):
    def query(spark, sf):
        cleaned = cleaning.handle_missing(events_null(spark, sf), strategy, "value", order_by="event_id")
        return cleaned.select("event_id", "value")

    return query


def _deduplicated(keep):
    def query(spark, sf):
        return cleaning.remove_duplicates(orders_messy(spark, sf), keep, row_id=ID)

    return query


def convert_blanks(spark, sf):
    """Numbers, words and labels with tabs, line breaks and wide blanks around them."""
    rows = orders_blank(spark, sf)
    for column, target in (("number_text", "numeric"), ("flag_text", "boolean"), ("label", "lowercase")):
        rows = cleaning.fix_types(rows, column, target)
    return rows


def dedup_labels(spark, sf):
    """Copies that keep their key, as a table without row ids has them."""
    return cleaning.remove_duplicates(customer_messy(spark, sf), "first")


def _converted(source, key, column, target):
    def query(spark, sf):
        cleaned = cleaning.fix_types(source(spark, sf), column, target).select(key, F.col(column))
        return _as_text(cleaned, column) if target == "datetime" else cleaned

    return query


def _price_ids(spark, sf) -> tuple[DataFrame, DataFrame]:
    messy = orders_messy(spark, sf)
    return messy, outliers.outlier_rows(messy, ["price"], ID, ("iqr",)).select(ID)


def _outliers(strategy):
    def query(spark, sf):
        messy, ids = _price_ids(spark, sf)
        return cleaning.handle_outliers(messy, "price", ids, strategy, row_id=ID).select(ID, "price")

    return query


def _pipeline(spark, sf) -> tuple[DataFrame, CleaningPipeline]:
    messy, ids = _price_ids(spark, sf)
    pipeline = CleaningPipeline(row_id=ID)
    pipeline.add_step({"action": "handle_missing", "column": "rating", "strategy": "drop_rows"})
    pipeline.add_step({"action": "remove_duplicates", "keep": "first"})
    pipeline.add_step({"action": "handle_missing", "column": "price", "strategy": "fill_median"})
    pipeline.add_step({"action": "fix_type", "column": "priority_label", "target_type": "lowercase"})
    pipeline.add_step({"action": "handle_outliers", "column": "price", "strategy": "remove", "ids": ids})
    return messy, pipeline


def clean_pipeline(spark, sf):
    messy, pipeline = _pipeline(spark, sf)
    return pipeline.execute(messy, tiered=True)


def clean_in_given_order(spark, sf):
    messy, pipeline = _pipeline(spark, sf)
    return pipeline.execute(messy)


def clean_log(spark, sf):
    messy, pipeline = _pipeline(spark, sf)
    cleaned = pipeline.execute(messy, tiered=True)
    return pipeline.log_frame(cleaned).select(
        "step", "action", "column", "strategy", "rows_before", "rows_after", "rows_removed",
        "missing_before", "missing_after", "outliers_treated",
    )


def strategy_options(spark, sf):
    with _profile(spark, sf) as profile:
        report = profile.column_table(with_patterns=False, with_distributions=False)
    options = advice.strategy_options(report)
    return options.select("column", *[F.concat_ws(",", c).alias(c) for c in options.columns[1:]])


CHOICES = {
    "missing": {"price": "fill_median", "rating": "drop_rows", "price_text": "fill_constant"},
    "constants": {"price_text": "0.00"},
    "duplicates": "first",
    "types": {"priority_label": "lowercase", "flag_text": "boolean", "price_text": "lowercase"},
    "outliers": {"*": "cap_iqr"},
}


def _suggested(spark, sf) -> tuple[Profile, list[dict]]:
    profile = _written_profile(spark, sf)
    return profile, advice.suggest_plan(profile, CHOICES)


def suggest_plan(spark, sf):
    _, steps = _suggested(spark, sf)
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(s["action"]).alias("action"),
            F.lit(s.get("column")).cast("string").alias("column"),
            F.lit(s.get("strategy") or s.get("target_type") or s.get("keep")).alias("choice"),
        )
        for i, s in enumerate(steps, 1)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def before_after(spark, sf):
    profile, steps = _suggested(spark, sf)
    pipeline = CleaningPipeline(row_id=ID)
    for step in steps:
        pipeline.add_step(step)
    cleaned = cut_lineage(pipeline.execute(profile.frame))  # else each analysis would clean the table again
    return advice.before_after(profile, Profile(cleaned, "cleaned", row_id=ID))


# -- views and facts ---------------------------------------------------------


def _light(view):
    def query(spark, sf):
        with _profile(spark, sf) as profile:
            return view(profile, profile.light_table)

    return query


def column_summary(spark, sf):
    with _profile(spark, sf) as profile:
        return views.column_summary(profile, profile.column_table(with_stats=False, with_distributions=False))


def column_facts(spark, sf):
    with _profile(spark, sf) as profile:
        return facts.column_facts(profile, profile.column_table(with_patterns=False, with_distributions=False))


def missing_matrix(spark, sf):
    return views.null_matrix(orders_messy(spark, sf), ID, MESSY_COLUMNS)


def histogram(spark, sf):
    found = views.histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return _rounded(_rounded(found, 4, "bin_start", "bin_end"), 12, "density")


def length_histogram(spark, sf):
    found = views.length_histogram(table(spark, sf, "documents"), "text")
    return _rounded(_rounded(found, 4, "bin_start", "bin_end"), 12, "density")


def kde(spark, sf):
    found = views.kde(table(spark, sf, "lineitem"), "l_extendedprice")
    return _rounded(_rounded(found, 4, "x"), 12, "density")


def _periods(name, column):
    def query(spark, sf):
        return _as_text(views.period_counts(table(spark, sf, name), column), "period_start")

    return query


def boxplot(spark, sf):
    names = ("min", "q1", "median", "q3", "max")
    return _rounded(views.five_numbers(orders_messy(spark, sf), NUMBERS), 4, *names)


def boxplot_points(spark, sf):
    return views.boxplot_points(_profile(spark, sf), "price")


def histograms_all(spark, sf):
    found = views.histograms(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return _rounded(_rounded(found, 4, "bin_start", "bin_end"), 12, "density")


def boxplot_points_all(spark, sf):
    return views.boxplot_points_all(_written_profile(spark, sf))


def queries() -> dict:
    return {
        # sources and sinks
        "scan_csv": scan_csv,
        "sniff_separator": sniff_separator,
        "sniff_encoding": sniff_encoding,
        "null_tokens": null_tokens,
        "bad_lines": bad_lines,
        "input_guards": input_guards,
        "preview": preview,
        "write_csv": write_csv,
        "csv_text_roundtrip": csv_text_roundtrip, "csv_single_file": csv_single_file,
        "write_parquet": write_parquet,
        "row_numbers": row_numbers,
        "load_named": load_named,
        "inject_mess": orders_messy,
        "inject_mess_labels": customer_messy,
        "inject_clean": inject_clean,
        # types
        "detect_types": detect_types_query,
        "bool_like": _shares("is_boolean"),
        "numeric_ratio": _shares("present", "numeric_share"),
        "datetime_ratio": _shares("datetime_share"),
        "all_iso": _shares("all_iso"),
        "parse_dates": parse_dates,
        "cardinality_ratio": _labels("present", "cardinality_ratio"),
        "case_inconsistent": _labels("distinct_raw", "distinct_normal", "case_inconsistent"),
        # statistics and distributions
        "numeric_coerce": numeric_coerce,
        "infinite_count": infinite_count,
        "numeric_stats": numeric_stats,
        "numeric_stats_messy": numeric_stats_messy,
        "skewness": _shape("skewness"),
        "kurtosis": _shape("kurtosis"),
        "skew_label": _shape("skew_label"),
        "kurtosis_label": _shape("kurtosis_label"),
        "categorical_stats": categorical_stats,
        "top_values": top_values,
        "datetime_stats": datetime_stats,
        "datetime_stats_events": datetime_stats_events,
        "text_stats": text_stats,
        "normality_small": normality_small,
        "normaltest": normaltest,
        "datetime_gaps": datetime_gaps,
        "datetime_gaps_sparse": datetime_gaps_sparse,
        "high_cardinality": high_cardinality,
        # missing values
        "missing_overall": missing_overall,
        "missing_per_column": missing_per_column,
        "missing_cooccurrence": missing_cooccurrence,
        "point_biserial": point_biserial,
        "missing_cramers": missing_cramers,
        "missing_phi": missing_phi,
        "missing_tests": missing_tests,
        "missing_p_values": missing_p_values,
        "missing_related": missing_related,
        "missing_pattern": missing_pattern,
        "patterns_wide": patterns_wide,
        # outliers
        "iqr_fences": iqr_fences,
        "iqr_outliers": _flagged("iqr"),
        "zscore_outliers": _flagged("zscore"),
        "outliers_small": outliers_small,
        "outlier_rows": outlier_rows,
        "outlier_rows_infinite": outlier_rows_infinite,
        "outlier_summary": outlier_summary,
        # duplicates
        "exact_duplicates": exact_duplicates,
        "duplicate_rows": duplicate_rows,
        "duplicate_texts": duplicate_texts,
        "near_duplicates": near_duplicates,
        "near_without_id": near_without_id,
        "near_wide": near_wide,
        "near_duplicate_ids": near_duplicate_ids,
        "near_sample": near_sample,
        "duplicate_sample": duplicate_sample,
        # correlation
        "pearson": pearson,
        "pearson_messy": pearson_messy,
        "pearson_wide": pearson_wide,
        "pearson_matrix": pearson_matrix,
        "contingency": contingency,
        "chi2": chi2,
        "cramers_v": cramers_v,
        "cramers_table": cramers_table,
        "cramers_wide": cramers_wide,
        "high_pairs": high_pairs,
        "align_inner": align_inner,
        # report
        "dataset_summary": dataset_summary,
        "quality_score": quality_score,
        "quality_grade": quality_grade,
        "column_warnings": column_warnings,
        "recommendations": recommendations,
        "column_report": column_report,
        # cleaning
        "drop_rows": _missing("drop_rows", "rating"),
        "drop_column": _missing("drop_column", "rating"),
        "fill_mean": fill_mean,
        "fill_median": _missing("fill_median", "price"),
        "fill_mean_text": fill_mean_text,
        "convert_blanks": convert_blanks,
        "fill_mode": _missing("fill_mode", "rating"),
        "fill_constant": _missing("fill_constant", "price_text", "0.00"),
        "ffill": _filled_events("ffill"),
        "bfill": _filled_events("bfill"),
        "dedup_first": _deduplicated("first"),
        "dedup_last": _deduplicated("last"),
        "dedup_none": _deduplicated("none"),
        "dedup_labels": dedup_labels,
        "to_numeric": _converted(orders_messy, ID, "price_text", "numeric"),
        "to_numeric_currency": _converted(customer_messy, "c_custkey", "balance_text", "numeric"),
        "to_datetime": _converted(orders_messy, ID, "date_text", "datetime"),
        "to_categorical": _converted(orders_messy, ID, "status", "categorical"),
        "to_string": _converted(orders_messy, ID, "age", "string"),
        "to_boolean": _converted(orders_messy, ID, "flag_text", "boolean"),
        "to_lowercase": _converted(orders_messy, ID, "priority_label", "lowercase"),
        "outlier_remove": _outliers("remove"),
        "outlier_cap": _outliers("cap_iqr"),
        "outlier_null": _outliers("replace_nan"),
        "clean_pipeline": clean_pipeline,
        "clean_in_given_order": clean_in_given_order,
        "clean_log": clean_log,
        "strategy_options": strategy_options,
        "suggest_plan": suggest_plan,
        "before_after": before_after,
        # views
        "type_distribution": _light(lambda p, t: views.type_distribution(t)),
        "missing_ranking": _light(lambda p, t: views.missing_ranking(t)),
        "missing_matrix": missing_matrix,
        "column_summary": column_summary,
        "headline": _light(views.headline),
        "column_filter": _light(lambda p, t: views.column_filter(p, t, issues_only=True, sort_by="missing")),
        "histogram": histogram,
        "kde": kde,
        "period_counts": _periods("events", "ts"),
        "period_counts_years": _periods("orders", "o_orderdate"),
        "length_histogram": length_histogram,
        "outlier_ranking": _light(lambda p, t: views.outlier_ranking(t)),
        "boxplot": boxplot,
        "boxplot_points": boxplot_points,
        "histograms_all": histograms_all,
        "boxplot_points_all": boxplot_points_all,
        "rec_counts": _light(lambda p, t: views.recommendation_counts(p.recommendations(t))),
        # facts
        "overview_facts": _light(facts.overview_facts),
        "column_facts": column_facts,
        "digest": _light(facts.digest),
        "issue_list": _light(lambda p, t: facts.issue_list(p, t).select("line")),
        "issue_columns": _light(lambda p, t: facts.issue_columns(t).select("column")),
    }


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the dataset's quality, with its columns and what to do about them."""
    with _profile(spark, sf) as profile:
        report = profile.column_table()
        advised = profile.recommendations(report).groupBy("column").agg(F.count(F.lit(1)).alias("recommendations"))
        score = profile.dataset_summary(report).first()
    return report.join(advised, "column", "left").select(
        "column", "storage_type", "inferred_type", "type_mismatch", "missing_count", "missing_pct", "missing_pattern",
        "mean", "median", "std", "skew_label", "unique_count", "iqr_count", "zscore_count",
        F.coalesce("recommendations", F.lit(0)).alias("recommendations"),
        F.lit(score["quality_score"]).alias("quality_score"), F.lit(score["quality_grade"]).alias("quality_grade"),
    )
