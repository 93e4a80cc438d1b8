"""Bottom-k sketches of word shingles: document fingerprints that can be merged.

A sketch is the ``k`` smallest 64-bit hashes of a text's shingles, ascending.  The union's sketch is the ``k`` smallest of two
sketches, so parts can be sketched apart.  A text with at most ``k`` shingles is held exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugework.llm.common import WordHasher, as_bytes, distinct_sorted, shingles

SIZE = 256
WORDS = 5
ROWS = 5_000  # documents of a range, about
FIRST = -(1 << 63)  # a null doc_id is ordered below any other


def sketch(text: bytes, known: WordHasher, k: int = SIZE, words: int = WORDS) -> np.ndarray:
    return distinct_sorted(shingles(known.of(text), words))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated intersection by union; 1 for two empty sets, 0 if one is empty."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    own = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / own) if own else 1.0


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = SIZE, words: int = WORDS, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the sketch of text as hex digits.  Null and empty texts have the empty sketch; a text of fewer words
    than a shingle is one shingle.  All rows and columns stay; a column of that name is replaced."""

    known = WordHasher()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([to_text(sketch(text, known, k, words)) for text in as_bytes(texts)], pa.string())

    return docs.withColumn(into, F.arrow_udf(run, "string")("text"))


def merged_fingerprints(parts: DataFrame, key: str, k: int = SIZE, column: str = "fingerprint") -> DataFrame:
    """(key, fingerprint): the sketch of all parts with that key.  Each task merges its parts first, so a key's group has
    one row per task at most.  Null sketches are skipped; a null key is a key."""
    kind = parts.schema[key].dataType.simpleString()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    own = from_text(text)
                    held[name] = merge(held[name], own, k) if name in held else own[:k]
            if len(held) > 50_000:
                yield rows(held, batch.schema)
                held = {}
        if held:
            yield rows(held, batch.schema)

    def rows(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), schema.field(0).type), pa.array([to_text(x) for x in held.values()], pa.string())],
            names=[key, "fingerprint"],
        )

    def final(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(combine(iter(table.combine_chunks().to_batches()))))

    schema = f"`{key}` {kind}, fingerprint string"
    return parts.select(key, column).mapInArrow(combine, schema).groupBy(key).applyInArrow(final, schema)


def with_next(docs: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """Rows that ``judge`` makes of each document and the next one in descending order of doc_id; the last is followed by
    the first.  ``judge()`` is called once a task and returns a function of (doc_id, text, text of the next, state of
    this, which the previous call returned) giving (row, state of the next).

    The order is cut into ranges.  The first document of a range is sent to the range before it as well, so each task has
    the followers it needs and reads its rows one after another.  Rows of one doc_id follow each other by their text.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("ord"), "doc_id", "text")
    ids = own.select("ord")
    parts = max(1, -(-ids.count() // ROWS))
    tops = ids.repartitionByRange(parts, "ord").groupBy(F.spark_partition_id().alias("part")).agg(F.max("ord").alias("top"))
    cuts = np.array(sorted(r["top"] for r in tops.collect()), np.int64)  # one number for each range
    if not len(cuts):
        return docs.sparkSession.createDataFrame([], schema)

    def places(ords: pa.Array) -> pa.Array:
        at = np.searchsorted(cuts, ords.to_numpy())
        return pa.array([[i, (i + 1) % len(cuts)] if top else [i] for i, top in zip(at.tolist(), cuts[at] == ords.to_numpy())],
                        pa.list_(pa.int32()))

    dealt = own.select("ord", "doc_id", "text", F.posexplode(F.arrow_udf(places, "array<int>")("ord")).alias("follower", "range"))
    dealt = dealt.repartition(min(len(cuts), 10_000), "range")
    dealt = dealt.sortWithinPartitions("range", "follower", F.desc("ord"), "text")
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act, waiting, state, made = judge(), None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "follower", "doc_id", "text")]
            for part, follower, doc_id, text in zip(*columns):
                text = text or ""
                if waiting is not None and waiting[0] == part:
                    row, state = act(waiting[1], waiting[2], text, state)
                    made.append(row)
                else:
                    state = None
                waiting = None if follower else (part, doc_id, text)
                if len(made) >= 1000:
                    yield table(made)
                    made = []
        if made:
            yield table(made)

    return dealt.mapInArrow(run, schema)


def edited_fingerprints(docs: DataFrame, k: int = SIZE, words: int = WORDS) -> DataFrame:
    """Fingerprint of each text and of the text whose last third is replaced by the next document's beginning.

    Columns doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.  Null texts count as
    empty; two empty texts are alike (1).  One row for each row of ``docs``; an empty table gives an empty result.
    """

    def judge():
        known = WordHasher()

        def act(doc_id, text, following, state):
            mine = sketch(text.encode(), known, k, words) if state is None else state
            third = len(text) // 3
            edited = text[: len(text) - third] + following[:third]
            changed = sketch(edited.encode(), known, k, words)
            after = sketch(following.encode(), known, k, words)
            row = (doc_id, len(text), edited, to_text(mine), to_text(changed), resemblance(mine, changed, k),
                   resemblance(mine, after, k))
            return row, after

        return act

    schema = (
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double"
    )
    return with_next(docs, judge, schema)
