"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(app: str = "gaugework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the analyses rely on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder; on a cluster a machine-local folder would lose data with its host.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="gaugework-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs whose expressions grow with the number of columns.

    The virtual machine compiles no method above 8,000 bytes but interprets it, several times slower.  Spark's generated
    code for a wide table goes beyond that unless this limit makes it use many short methods.
    """
    before = spark.conf.get(_METHOD_LIMIT)
    spark.conf.set(_METHOD_LIMIT, "8000")
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What follows restarts from that table instead of from the source, also after
    losing an executor, and plans with its real size.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_wide_lineage(df: DataFrame) -> DataFrame:
    """``cut_lineage`` where one expression takes many columns."""
    with compiled_methods(df.sparkSession):
        return cut_lineage(df)


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A DataFrame of per-column facts (at most a few rows per table column).

    Goes through Arrow, so it plans as a local relation without Python workers.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = pa.Table.from_pylist(rows, schema=to_arrow_schema(struct))
    return spark.createDataFrame(arrow, schema=struct)


def exact_round(value: Column, digits: int) -> Column:
    """A double with so many decimals, rounded as Python rounds: half to even on the exact binary value,
    which SQL rounding is not.

    Only where twice the scaled value is close to an odd number is it close to a middle; the distance to that
    number, with the product's rounding error (found by splitting the value into halves of 26 bits), tells the side.
    """
    scale = 2.0 * 10.0**digits
    split = value * 134217729.0  # 2 ** 27 + 1
    upper = split - (split - value)
    double = value * scale
    odd = F.rint(double)
    side = (double - odd) + ((upper * scale - double) + (value - upper) * scale)
    below = (odd - 1) / 2
    up = (side > 0) | ((side == 0) & (F.pmod(below, F.lit(2.0)) == 1))
    middle = (F.pmod(odd, F.lit(2.0)) == 1) & (F.abs(double - odd) < 0.001)
    return F.when(middle, (below + up.cast("int")) / F.lit(10.0**digits)).otherwise(F.bround(value, digits))


def round_small(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    """Columns of doubles rounded by ``exact_round``."""
    return frame.withColumns({n: exact_round(col(n), digits) for n in names})


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
