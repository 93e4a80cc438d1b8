import pytest
from pyspark.sql import functions as F

#: All columns of documents and some that operators use themselves.
CLASH = (
    "doc_id long, text string, lang string, source string, n_chars long, ord long, row_key long, starts string, spans string, "
    "random string, ids string, score string, quality string, shard string, slot string, bucket string, number string, "
    "fingerprint string, kept string, n_words string, sequence_id string, host string, verdict string, _row string, _text string"
)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """(doc_id, text) of the smallest documents table, for brute-force versions."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty, blank and very long texts, ties and repeated rows, among columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \t\n "), (6, long), (7, long),
        (None, "a b c d e f"), (None, None), (8, "é ü\x0bß\n\nç"), (9, "one"), (10, "<|endoftext|> x  \n y"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in [x.split()[0] for x in CLASH.split(", ")][2:]:
        kind = "long" if f"{name} long" in CLASH else "string"
        frame = frame.withColumn(name, F.lit(None).cast(kind) if name in ("lang", "n_chars") else F.lit(7).cast(kind))
    return frame


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], CLASH)
