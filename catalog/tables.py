"""The tables the catalogue queries run on: the given ones, and messy views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources import mess

MESSY_COLUMNS = [
    "o_custkey", "status", "price", "price_text", "date_text", "priority_label", "flag_text", "age", "rating",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with gaps, stray text, extreme prices, mixed spellings and copies."""
    key = "row_id"
    clean = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(key),
        "o_custkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price_text"),
        F.col("o_orderdate").cast("string").alias("date_text"),
        F.col("o_orderpriority").alias("priority_label"),
        F.lit("").alias("flag_text"),
        (F.col("o_custkey") % 100).alias("age"),
        (F.col("o_orderkey") % 97 / F.lit(10.0)).alias("rating"),
    )
    label, date = F.col("priority_label"), F.col("date_text").cast("timestamp")
    rules = [
        mess.Rule("price", mess.every(key, 997, 5), F.lit(9999999.0)),
        mess.Rule("price", mess.every(key, 1009, 7), F.lit(-1000.0)),
        mess.gaps("price", mess.every(key, 13, 0)),
        mess.Rule("price_text", mess.every(key, 40, 1), F.lit("TBD")),
        mess.gaps("price_text", mess.every(key, 40, 2)),
        *mess.date_spellings("date_text", key, date),
        *mess.spellings(
            "priority_label", key, [F.upper(label), F.lower(label), F.concat(F.lit(" "), label), label, label]
        ),
        *mess.boolean_spellings("flag_text", key, ["Yes", "no", "Y", "N", "TRUE", "False"]),
        mess.gaps("rating", F.col("age") > 75),
    ]
    copies = [
        mess.Copies(mess.every(key, 250, 0), offset=1_000_000_000),
        mess.Copies(mess.every(key, 333, 0), offset=2_000_000_000, changed={"status": F.lit("Z")}),
    ]
    return mess.inject_mess(clean, key, rules, copies)


def customer_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` with label variants, currency text, heavy gaps and true copies."""
    key = "c_custkey"
    clean = table(spark, sf_dir, "customer").withColumn(
        "balance_text", F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    )
    segment = F.lower(F.col("c_mktsegment"))
    rules = [
        *mess.spellings(
            "c_mktsegment",
            key,
            [F.upper(segment), F.upper(F.substring(segment, 1, 1)), F.initcap(segment), segment, segment],
        ),
        mess.currency("balance_text", mess.every(key, 36, 0), F.col("c_acctbal")),
        mess.gaps("c_nationkey", mess.every(key, 5, 2)),
        mess.gaps("c_name", F.pmod(F.col(key), F.lit(100)) < 77),
        mess.Rule("c_acctbal", mess.every(key, 400, 9), F.lit(512330.0)),
        mess.gaps("c_acctbal", mess.every(key, 50, 1)),
    ]
    return mess.inject_mess(clean, key, rules, [mess.Copies(mess.every(key, 45, 0))])


def events_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with two gaps in every seven values."""
    return mess.inject_mess(
        table(spark, sf_dir, "events"),
        "event_id",
        [mess.gaps("value", F.pmod(F.col("event_id"), F.lit(7)) < 2)],
    )


def orders_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the dates from March to August 1996 moved a year ahead."""
    day = F.col("o_orderdate").cast("date")
    hole = day.between(F.lit("1996-03-01").cast("date"), F.lit("1996-08-31").cast("date"))
    later = F.timestamp_add("DAY", F.lit(365), F.col("o_orderdate"))
    rule = mess.Rule("o_orderdate", hole, later)
    return mess.inject_mess(table(spark, sf_dir, "orders"), "o_orderkey", [rule])


def orders_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, words and labels of ``orders`` with blanks of all kinds around them."""
    key = F.col("o_orderkey")
    blanks = F.array(*map(F.lit, ("", " ", "\t", "\u00a0", " \n", "\u2003", "\u3000", "\r")))
    blank = F.element_at(blanks, F.pmod(key, F.lit(8)).cast("int") + 1)
    word = F.element_at(F.array(*map(F.lit, ("yes", "No", "TRUE", "f"))), F.pmod(key, F.lit(4)).cast("int") + 1)
    return table(spark, sf_dir, "orders").select(
        key.alias("row_id"),
        F.concat(blank, F.pmod(key, F.lit(1000)).cast("string"), blank).alias("number_text"),
        F.concat(blank, word, blank).alias("flag_text"),
        F.concat(blank, "o_orderpriority", blank).alias("label"),
    )


WIDE_NUMBERS, WIDE_LABELS, WIDE_GAPS, WIDE_COLUMNS = 30, 20, 60, 60


def wide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty number columns of ``orders``; column i has a gap in every (i + 7)th row."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    held = [price * int(i % 3 == 0) + F.pmod(key * (i + 3), F.lit(97 + i)) * 1000.0 for i in range(WIDE_NUMBERS)]
    return table(spark, sf_dir, "orders").select(
        *[F.when(F.pmod(key, F.lit(i + 7)) != 0, x).alias(f"n{i}") for i, x in enumerate(held)]
    )


def wide_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty label columns of ``orders`` with 2 to 6 levels."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        *[F.pmod(F.floor(key / (i + 1)) + customer % 2, F.lit(2 + i % 5)).cast("string").alias(f"g{i}") for i in range(WIDE_LABELS)]
    )


def wide_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of ``orders`` and sixty columns with gaps: in dear rows for every tenth column, else in every (i + 11)th row."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    gap = [price > 300_000 if i % 10 == 9 else F.pmod(key, F.lit(i + 11)) == 0 for i in range(WIDE_GAPS)]
    return table(spark, sf_dir, "orders").select(
        key.alias("row_id"), price.alias("price"), *[F.when(~g, F.lit(1.0) * F.pmod(key * 7 + i, F.lit(50))).alias(f"t{i}") for i, g in enumerate(gap)]
    )


def wide_columns() -> list[str]:
    return [f"w{i}" for i in range(WIDE_COLUMNS)]


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty columns of ``orders``; every 40th row comes again with one column changed, every 60th unchanged."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("row_id"), *[F.pmod(key * (i + 1) + F.col("o_custkey"), F.lit(50 + i)).alias(c) for i, c in enumerate(wide_columns())]
    )
    again = rows.filter("row_id % 40 = 0")
    odd = F.pmod(F.floor(F.col("row_id") / 40), F.lit(WIDE_COLUMNS))
    changed = again.select(
        (F.col("row_id") + 1_000_000_000).alias("row_id"),
        *[F.when(odd == i, F.lit(-1)).otherwise(F.col(c)).alias(c) for i, c in enumerate(wide_columns())],
    )
    copies = rows.filter("row_id % 60 = 0").withColumn("row_id", F.col("row_id") + 2_000_000_000)
    return rows.unionByName(changed).unionByName(copies)
