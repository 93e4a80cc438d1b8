"""The wide pass: every fact about every column that needs no order.

Columns of one storage kind are unpivoted into (column, value) rows and
aggregated by column.  Partial aggregation leaves one small row per task and
column; the generated code stays the same size for a table of ten or a thousand
columns, and each scan reads only its own columns.

Texts are first counted by value: what a text is read as is worked out once for
each distinct text, not for each cell.  Long texts that can be neither number nor
date take part as digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import scalars as S
from gaugework.session import col

# what a long text must look like to be a number: the characters of numbers, maybe between blanks
_NUMBER_LIKE = f"^[{S.BLANKS}]*[-+.0-9eEinftyINFTY]+[{S.BLANKS}]*$"
_KIND_TYPE = {"number": "double", "string": "string", "datetime": "timestamp"}

_NUMBER_METRICS = [
    "count(number) AS numbers",
    "count_if(abs(number) = double('infinity')) AS infinite",
    "count(fin) AS finite",
    "avg(fin) AS mean",
    "stddev_samp(fin) AS std",
    "min(fin) AS min",
    "max(fin) AS max",
    "skewness(fin) AS g1",
    "kurtosis(fin) AS g2",
    "count_if(fin = 0) AS zeros",
    "bool_and(fin % 1 = 0) AS whole",
]
_TIME_METRICS = ["count(time) AS dates", "min(time) AS date_low", "max(time) AS date_high"]
_METRICS = {"number": _NUMBER_METRICS, "datetime": _TIME_METRICS}
# What a distinct text counts for, as often as it occurs (n).
_TEXT_TESTS = {
    "nulls": "missing", "present": "NOT missing", "numbers": "number IS NOT NULL", "infinite": "abs(number) = double('infinity')",
    "finite": "fin IS NOT NULL", "dates": "time IS NOT NULL", "words": "word IS NOT NULL", "iso": "iso", "zoned": "zoned",
}
_TEXT_METRICS = [
    "sum(n) AS rows",
    "count_if(NOT missing) AS distinct",
    *(f"sum({name}) AS {name}" for name in _TEXT_TESTS),
    "min(time) AS date_low",
    "max(time) AS date_high",
    "min(word) AS word_low",
    "max(word) AS word_high",
    "sum(length) AS length",
    "min(shortest) AS length_min",
    "max(longest) AS length_max",
]
_TEXT_COUNTS = ("rows", "distinct", *_TEXT_TESTS)
_MOMENTS = [m for m in _NUMBER_METRICS if m.rsplit(" AS ", 1)[1] not in _TEXT_COUNTS]


def kinds(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    return {f.name: S.storage_kind(f.dataType) for f in df.schema if columns is None or f.name in columns}


def number_view(df: DataFrame, name: str) -> Column:
    return S.as_number(col(name), S.storage_kind(df.schema[name].dataType))


def finite_view(df: DataFrame, name: str) -> Column:
    return S.finite(number_view(df, name))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so a missing number has one spelling."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({c: S.nan_to_null(col(c)) for c in floats}) if floats else df


def long_form(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, value) rows of same-typed expressions: one Expand, no shuffle."""
    wide = df.select(*[v.alias(n) for n, v in values.items()])
    return wide.unpivot([], [col(n) for n in values], "column", "value")


def _read_numbers(cells: DataFrame, kind: str) -> DataFrame:
    read = cells.withColumn("number", S.as_number(F.col("value"), kind))
    return read.withColumn("fin", S.finite(F.col("number")))


def _read_texts(values: DataFrame) -> DataFrame:
    """What distinct texts are read as.

    A text that is a number is no date, and only dates are tested for ISO form,
    so most texts meet one or two patterns.
    """
    value = F.col("value")
    # the position of the yes/no word: a number, so the aggregation stays hash-based
    word = F.array_position(F.array(*map(F.lit, S.BOOLEAN_TOKENS)), F.col("normal"))
    # every spelling of a date has a year of four digits
    time = F.when(F.col("number").isNull() & value.rlike(r"\d{4}"), S.text_to_timestamp(value))
    read = _read_numbers(values, "string").withColumns({"time": time, "word": F.nullif(word, F.lit(0))})
    dated = F.col("time").isNotNull()
    read = read.withColumns(
        {"iso": F.when(dated, S.is_iso_text(value)), "zoned": F.when(dated, S.has_zone(value))}
    )
    counts = {name: F.when(F.expr(test), F.col("n")).otherwise(0) for name, test in _TEXT_TESTS.items()}
    kept = [c for c in (*values.columns, "time", "word") if c not in counts]
    return read.select(*kept, *[c.alias(n) for n, c in counts.items()])


def text_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, normal, missing, n, length, shortest, longest: the distinct texts of each column, combined in the
    tasks before they are shuffled.

    ``normal`` is the text without blanks around, in lower case.  Texts longer than any date that cannot be numbers have
    no value: they are told apart by digests, and ``normal`` is that of their normal form.
    """
    value = F.col("value")
    # one key expression, used once: shared parts of expressions over unpivoted cells do not always compile
    readable = (F.length(value) <= S.LONGEST_DATE) | (F.length(S.strip(value)) <= S.LONGEST_DATE) | value.rlike(_NUMBER_LIKE)
    digests = F.concat(F.lit("#"), F.sha2(value, 256), F.sha2(S.normal_label(value), 256))
    key = F.when(value.isNotNull(), F.when(readable, F.concat(F.lit("="), value)).otherwise(digests))
    cells = long_form(df, {c: col(c) for c in columns}).select("column", key.alias("key"), F.length(value).alias("length"))
    counted = cells.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"),
        F.min("length").alias("shortest"), F.max("length").alias("longest"),
    )
    key = F.col("key")
    own = F.when(key.startswith("="), key.substr(F.lit(2), F.length(key)))
    return counted.select(
        "column", own.alias("value"), F.coalesce(S.normal_label(own), key.substr(66, 64)).alias("normal"),
        key.isNull().alias("missing"), "n", "length", "shortest", "longest",
    )


def summarise(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """Facts per column name; ``kind``, ``rows`` and ``nulls`` are always there."""
    of_kind = {f.name: S.storage_kind(f.dataType) for f in df.schema if columns is None or f.name in columns}
    result: dict[str, dict] = {}
    for kind, stored_as in _KIND_TYPE.items():
        names = [n for n, k in of_kind.items() if k == kind]
        if names:
            result |= _summarise_texts(df, names) if kind == "string" else _summarise_kind(df, names, kind, stored_as)
    rest = [n for n, k in of_kind.items() if k not in _KIND_TYPE]
    if rest:
        found = df.agg(F.count(F.lit(1)), *[F.count(col(n)) for n in rest]).first()
        result |= {n: {"kind": of_kind[n], "rows": found[0], "nulls": found[0] - c} for n, c in zip(rest, found[1:])}
    return {n: result[n] for n in of_kind}


def _with_shape(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {
            "skewness": S.unbiased_skewness(F.col("g1"), F.col("finite")),
            "kurtosis": S.unbiased_kurtosis(F.col("g2"), F.col("finite")),
        }
    )


def _nothing(kind: str, metrics: list[str]) -> dict:
    """Facts of a column of a table without rows."""
    nothing = {"kind": kind, "rows": 0, "nulls": 0} | {m.rsplit(" AS ", 1)[1]: None for m in metrics}
    if kind != "datetime":
        nothing |= {"skewness": None, "kurtosis": None}
    return nothing | {zero: 0 for zero in (*_TEXT_COUNTS, "zeros") if zero in nothing}


def _summarise_kind(df: DataFrame, names: list[str], kind: str, stored_as: str) -> dict[str, dict]:
    cells = long_form(df, {n: col(n).cast(stored_as) for n in names})
    read = _read_numbers(cells, kind) if kind == "number" else cells.withColumn("time", F.col("value"))
    present = "number" if kind == "number" else "value"
    metrics = ["count(1) AS rows", f"count(1) - count({present}) AS nulls", *_METRICS[kind]]
    counted = read.groupBy("column").agg(*map(F.expr, metrics))
    counted = _with_shape(counted) if kind == "number" else counted
    found = {r["column"]: {"kind": kind, **r.asDict()} for r in counted.collect()}
    return {n: found.get(n, _nothing(kind, _METRICS[kind])) for n in names}


def _summarise_texts(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Counts from distinct texts; then the moments of the columns that hold numbers, from their cells."""
    counted = _read_texts(text_values(df, names)).groupBy("column").agg(*map(F.expr, _TEXT_METRICS))
    found = {}
    for r in counted.collect():
        present, length = r["present"], r["length"]
        found[r["column"]] = {"kind": "string", **r.asDict(), "length_mean": length / present if present else None}
    numeric = [n for n in names if n in found and found[n]["finite"]]
    if numeric:
        cells = _read_numbers(long_form(df, {n: col(n) for n in numeric}), "string")
        moments = cells.groupBy("column").agg(*map(F.expr, _NUMBER_METRICS))
        for r in _with_shape(moments).collect():
            found[r["column"]] |= r.asDict()
    nothing = _nothing("string", [*_TEXT_METRICS, *_MOMENTS])
    return {n: nothing | found.get(n, {}) for n in names}
