"""Reading and writing tables: CSV with the reader's rules, and Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.config import DEFAULTS, ROW_ID, Thresholds
from gaugework.functions import scalars as S
from gaugework.operators.summary import long_form
from gaugework.session import col, cut_lineage, small_frame
from gaugework.sources.records import PLACE, csv_records

_MALFORMED = "_malformed_line"
FILE_BYTES = 256 << 20  # a file of in_large_files; two splits of the usual size
# Texts a CSV reader takes for a boolean.
_BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")


@dataclass(frozen=True)
class CsvFormat:
    """How to read some files; ``broken`` are those with quoted values that run over lines, ``plain`` the others."""

    separator: str
    encoding: str
    header: list[str]
    broken: tuple[str, ...] = ()
    plain: tuple[str, ...] = ()


# -- finding out the format --------------------------------------------------


def look_at_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, semicolons, commas (both outside quotes), valid_utf8, breaks: one scan of the raw lines.

    ``breaks`` says that some line has an odd number of quotes, as where a quoted value runs over it.  The text source
    hands lines over as raw bytes, and no line break can fall inside a UTF-8 sequence, so files are checked split by split.
    """
    value = F.col("value")
    marked = value.contains('"')
    bare = F.when(marked, F.regexp_replace(value, r'"[^"]*"', "")).otherwise(value)

    def held(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.groupBy("file").agg(
        F.sum(held(bare, ";")).alias("semicolons"),
        F.sum(held(bare, ",")).alias("commas"),
        F.bool_and(F.is_valid_utf8(value)).alias("valid_utf8"),
        F.max(marked & (held(value, '"') % 2 == 1)).alias("breaks"),
    )


def _separator(looks: list[Row]) -> str:
    """``;`` when the lines, outside quotes, hold more of them than commas."""
    return ";" if sum(r["semicolons"] for r in looks) > sum(r["commas"] for r in looks) else ","


def _encoding(looks: list[Row]) -> str:
    """One encoding for all files: windows-1252, in which every byte is a character, as soon as one is not UTF-8."""
    return "UTF-8" if all(r["valid_utf8"] for r in looks) else "windows-1252"


def sniff_separator(spark: SparkSession, path: str) -> str:
    return _separator(look_at_files(spark, path).collect())


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding: UTF-8 when every line of the file is valid, else windows-1252."""
    encoding = F.when(F.col("valid_utf8"), "UTF-8").otherwise("windows-1252").alias("encoding")
    return look_at_files(spark, path).select(F.substring_index("file", "/", -1).alias("file"), encoding)


def sniff_encoding(spark: SparkSession, path: str) -> str:
    return _encoding(look_at_files(spark, path).collect())


def csv_format(
    spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None
) -> CsvFormat:
    looks = look_at_files(spark, path).collect()
    separator, encoding = separator or _separator(looks), encoding or _encoding(looks)
    broken = tuple(sorted(r["file"] for r in looks if r["breaks"]))
    header = _reader(spark, separator, encoding).option("multiLine", bool(broken)).csv(path).columns
    return CsvFormat(separator, encoding, header, broken, tuple(sorted(r["file"] for r in looks if not r["breaks"])))


def _with_files(spark: SparkSession, path: str, form: CsvFormat) -> CsvFormat:
    """A format with its files, which one made by hand may lack."""
    if form.broken or form.plain:
        return form
    looks = look_at_files(spark, path).collect()
    files = (tuple(sorted(r["file"] for r in looks if r["breaks"] == breaks)) for breaks in (True, False))
    return CsvFormat(form.separator, form.encoding, form.header, *files)


def _readable(encoding: str) -> str:
    # Spark reads no windows-1252; ISO-8859-1 is the same but for 0x80 to 0x9F,
    # which is put right after reading.
    return "ISO-8859-1" if encoding == "windows-1252" else encoding


def _reader(spark: SparkSession, separator: str, encoding: str):
    return (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", _readable(encoding))
        .option("escape", '"')
        .option("inferSchema", False)
    )


# -- reading -----------------------------------------------------------------


def _fields(line: Column, separator: str) -> Column:
    """Number of fields of a record; separators inside quotes do not count."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def read_csv_text(spark: SparkSession, path: str, form: CsvFormat) -> DataFrame:
    """All columns as text.  Records with too many fields are left out, short ones
    are padded with NULL.  Files are cut into splits, also those whose quoted values run over lines.
    """
    return _placed_records(spark, path, form).select(*map(col, form.header))


def _placed_records(spark: SparkSession, path: str, form: CsvFormat) -> DataFrame:
    """The columns, and where each record stands: _file, _start of its split and _at, ascending within it."""
    form = _with_files(spark, path, form)
    if form.broken:
        joined = _joined_records(spark, form)
        return joined.unionByName(_read_records(spark, list(form.plain), form)) if form.plain else joined
    return _read_records(spark, path, form)


def _schema(form: CsvFormat) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*form.header, _MALFORMED]])


def _read_records(spark: SparkSession, path: str | list[str], form: CsvFormat) -> DataFrame:
    """Records that are lines."""
    lines = (
        _reader(spark, form.separator, form.encoding)
        .schema(_schema(form))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _MALFORMED)
        .option("columnPruning", False)  # a pruned parse does not see surplus fields
        .csv(path)
    )
    malformed = F.col(_MALFORMED)
    # A scan of the malformed-line column alone is refused, so the filter always
    # reads a data column as well.
    with_data = F.length(F.concat_ws("", col(form.header[0]), malformed)) >= 0
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    placed = [x.alias(n) for x, n in zip(place, PLACE)]
    return lines.filter(~_too_long(malformed, form) & with_data).select(*_columns(form), *placed)


def _too_long(malformed: Column, form: CsvFormat) -> Column:
    return malformed.isNotNull() & (_fields(malformed, form.separator) > len(form.header))


def _columns(form: CsvFormat, source: Column | None = None) -> list[Column]:
    cells = [col(c) if source is None else source[c] for c in form.header]
    if form.encoding == "windows-1252":
        cells = [F.translate(c, *_upper_windows()) for c in cells]
    return [c.alias(n) for c, n in zip(cells, form.header)]


def _record_texts(spark: SparkSession, form: CsvFormat) -> DataFrame:
    """_file, _start, _at and text of the records of files whose quoted values run over lines."""
    records = csv_records(spark, list(form.broken), form.separator)
    text = F.col("text").cast("string") if form.encoding == "UTF-8" else F.decode("text", _readable(form.encoding))
    return records.withColumn("text", text)


def _joined_records(spark: SparkSession, form: CsvFormat) -> DataFrame:
    options = {"sep": form.separator, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*form.header, _MALFORMED])
    parsed = _record_texts(spark, form).withColumn("record", F.from_csv("text", schema, options))
    record = F.col("record")
    return parsed.where(~_too_long(record[_MALFORMED], form)).select(*_columns(form, record), *PLACE)


def _upper_windows() -> tuple[str, str]:
    """Characters 0x80 to 0x9F as ISO-8859-1 reads them, and as windows-1252 means them."""
    codes = [bytes([b]) for b in range(0x80, 0xA0)]
    known = [c for c in codes if c.decode("cp1252", "ignore")]
    return b"".join(known).decode("latin-1"), b"".join(known).decode("cp1252")


def bad_lines(spark: SparkSession, path: str, form: CsvFormat) -> DataFrame:
    """The records with too many fields: file, line (several lines where a quoted value runs over them)."""
    form = _with_files(spark, path, form)
    name = F.substring_index(F.col("_file"), "/", -1).alias("file")
    found = _record_texts(spark, form).select(name, F.col("text").alias("line")) if form.broken else None
    if form.plain or found is None:
        lines = spark.read.text(list(form.plain) or path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
        found = lines if found is None else found.unionByName(lines)
    return found.filter(_fields(F.col("line"), form.separator) > len(form.header))


def map_null_tokens(df: DataFrame) -> DataFrame:
    """Null-token text becomes NULL in every text column: one projection."""
    texts = [f.name for f in df.schema if S.storage_kind(f.dataType) == "string"]
    return df.withColumns({c: S.blank_to_null(col(c)) for c in texts}) if texts else df


def infer_storage(df: DataFrame) -> dict[str, str]:
    """Storage type per text column: bigint, double, boolean or string, from all
    its values; a column without values is double.  Dates stay text."""
    texts = [f.name for f in df.schema if S.storage_kind(f.dataType) == "string"]
    if not texts:
        return {}
    cells = long_form(df, {c: col(c) for c in texts}).filter(F.col("value").isNotNull())
    value = F.col("value")
    whole = F.when(S.strip(value).rlike(r"^[+-]?\d{1,19}$"), S.strip(value).try_cast("bigint"))
    counted = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(whole).alias("bigint"),
        F.count(S.text_to_number(value)).alias("double"),
        F.count_if(value.isin(*_BOOLEAN_TEXTS)).alias("boolean"),
    )
    found = {r["column"]: r for r in counted.collect()}
    result = {}
    for c in texts:
        facts = found.get(c)
        fitting = [t for t in ("bigint", "double", "boolean") if facts and facts[t] == facts["n"]]
        result[c] = "double" if facts is None else (fitting or ["string"])[0]
    return result


def apply_storage(df: DataFrame, storage: dict[str, str]) -> DataFrame:
    def view(name: str, target: str) -> Column:
        if target == "double":
            return S.text_to_number(col(name))
        if target == "string":
            return col(name)
        return S.strip(col(name)).try_cast(target)

    return df.withColumns({c: view(c, t) for c, t in storage.items()}) if storage else df


def read_csv(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    encoding: str | None = None,
    row_ids: bool = False,
) -> DataFrame:
    """A CSV file or folder as a typed table; quoted values may hold line breaks."""
    form = csv_format(spark, path, separator, encoding)
    placed = _placed_records(spark, path, form)
    table = map_null_tokens(placed.select(*map(col, form.header)))
    storage = infer_storage(table)
    if not row_ids:
        return apply_storage(table, storage)
    typed = apply_storage(map_null_tokens(placed.select(*map(col, form.header), *PLACE)), storage)
    return _numbered(typed, form.header, ROW_ID)


def load_table(spark: SparkSession, path: str, row_ids: bool = False) -> DataFrame:
    """Read by suffix: .csv or .parquet."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, row_ids=row_ids)
    if name.endswith(".parquet"):
        table = spark.read.parquet(path)
        return with_row_id(table) if row_ids else table
    raise ValueError(f"Unsupported file type: '{path}'. Expected .csv or .parquet")


def load_named(spark: SparkSession, folder: str, name: str, suffix: str = "parquet") -> DataFrame:
    """A built-in data set by its name."""
    return load_table(spark, f"{folder.rstrip('/')}/{name}.{suffix}")


def with_row_id(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Number the rows of a file-backed table 0, 1, 2 ... in file order."""
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return _numbered(df.select("*", *[x.alias(n) for x, n in zip(place, PLACE)]), df.columns, row_id)


def _numbered(placed: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Rows by file, split and place in the split; numbers in a split may have gaps.

    Rows are written once; each split then gets the number of rows before it.  A split's rows are ordered by one task,
    and only the table of splits is ordered in one place.
    """
    file, start, at = PLACE
    tagged = cut_lineage(placed)
    splits = tagged.groupBy(file, start).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    within = F.row_number().over(Window.partitionBy(file, start).orderBy(at)) - 1
    number = F.col("_offset") + F.col("_within")
    placed_in = tagged.withColumn("_within", within)
    return placed_in.join(offsets, [file, start]).select(number.alias(row_id), *map(col, columns))


# -- guards and sinks --------------------------------------------------------


def input_guards(df: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """rows, columns, is_empty, has_columns, is_large: one row."""
    rows = df.count()
    facts = {
        "rows": rows,
        "columns": len(df.columns),
        "is_empty": rows == 0,
        "has_columns": bool(df.columns),
        "is_large": rows > thresholds.large_table_rows,
    }
    schema = "rows bigint, columns int, is_empty boolean, has_columns boolean, is_large boolean"
    return small_frame(df.sparkSession, [facts], schema)


def cleaned_name(file_name: str, suffix: str = "csv") -> str:
    """``data.csv`` becomes ``data_cleaned.csv``."""
    stem = file_name.rsplit(".", 1)[0] if "." in file_name else file_name
    return f"{stem}_cleaned.{suffix}"


def in_large_files(df: DataFrame, size: Column) -> DataFrame:
    """The rows in as few parts as hold about ``FILE_BYTES`` each, by the size of a row: one scan more, and a shuffle only if
    the table has fewer parts than that.  A file is written by one task, so a whole table in one file would go through one.
    """
    sized = df.select(size.alias("size"), F.spark_partition_id().alias("part"))
    total, now = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("part")).first()
    files = max(1, -(-total // FILE_BYTES))
    return df.coalesce(files) if files <= now or files == 1 else df.repartition(files)


def write_csv(df: DataFrame, path: str, row_id: str | None = ROW_ID) -> str:
    """Write with a header and without the row ids; returns the path."""
    kept = df.drop(row_id) if row_id else df
    writer = kept.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, row_id: str | None = ROW_ID) -> str:
    (df.drop(row_id) if row_id else df).write.parquet(path)
    return path
