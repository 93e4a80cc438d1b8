"""Vector codes: each part of a vector becomes the number of the nearest entry of the part's codebook.

Codebooks are learnt by rounds of assigning and averaging in whole numbers.  Nearest entries are found with LAESA pivots: a
few fixed points per part, whose distances to every vector's part are worked out once and kept.  In each round only the
distances between pivots and entries are new; by the triangle inequality the differences to a pivot bound the distance
from below.  Entries are tried in order of that bound, each by its exact squared distance, until the next
bound exceeds the best one found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm.common import BROADCAST_ROWS
from gaugework.operators.skew import join_on_counted_keys
from gaugework.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 16, 64, 2, 256, 4
BLOCK = 4096  # vectors looked at together
MADE = ("code", "error", "label_error")
#: Pivot distances are kept as 32-bit floats: bounds give way by a share that exceeds their rounding.
_SLACK = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry]: whole numbers, ``scale`` times the values they stand for."""

    entries: np.ndarray
    scale: int = SCALE

    def decimals(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def values(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        at = np.frombuffer(bytes.fromhex(code), np.uint8)
        return (self.entries[np.arange(len(at)), at].ravel() / self.scale).tolist()


def whole_parts(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, by vector and part.  Numbers whose squared distances need more than 63 bits are refused."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    width = vectors.shape[1] // parts
    if len(scaled) and np.abs(scaled).max(initial=0) > np.sqrt(2.0**60 / max(width * parts, 1)):
        raise ArithmeticError("vector components are too large for squared distances in 63 bits")
    return scaled.astype(np.int64).reshape(len(vectors), parts, width)


def pick_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` entries of each part's first codebook, each the one farthest from those before it."""
    chosen = []
    for own in entries:
        at, near = [0], ((own - own[0]) ** 2).sum(axis=1)
        while len(at) < count:
            at.append(int(near.argmax()))
            near = np.minimum(near, ((own - own[at[-1]]) ** 2).sum(axis=1))
        chosen.append(own[at])
    return np.stack(chosen)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - others[None, :, :]) ** 2).sum(axis=2).astype(np.float64))


def nearest(points: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, squared distance) of each point; ties go to the lower number.

    ``to_pivots`` holds the distances from points to pivots.
    """
    bound = np.zeros((len(points), len(entries)))
    for own, new in zip(to_pivots.T.astype(np.float64), _distances(pivots, entries)):
        np.maximum(bound, np.abs(own[:, None] - new) - _SLACK * (own[:, None] + new), out=bound)
    bound *= bound
    best = np.full(len(points), np.iinfo(np.int64).max)
    which = np.zeros(len(points), np.int64)
    open_rows = np.arange(len(points))
    while len(open_rows):
        tried = bound.argmin(axis=1)
        at = np.arange(len(open_rows))
        hopeful = bound[at, tried] <= best[open_rows]
        if not hopeful.all():
            open_rows, bound, tried = open_rows[hopeful], bound[hopeful], tried[hopeful]
            at = at[: len(open_rows)]
        bound[at, tried] = np.inf
        exact = ((points[open_rows] - entries[tried]) ** 2).sum(axis=1)
        better = (exact < best[open_rows]) | ((exact == best[open_rows]) & (tried < which[open_rows]))
        best[open_rows[better]], which[open_rows[better]] = exact[better], tried[better]
    return which, best


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), length)


def _assigned(batch: pa.RecordBatch, books: Codebooks, pivots: np.ndarray) -> Iterator[tuple]:
    """Blocks of a batch: first row, whole-number parts, entry numbers and squared distances by part."""
    parts, _, width = books.entries.shape
    vectors = _matrix(batch.column("_vector"), parts * width)
    kept = np.frombuffer(b"".join(batch.column("_pivots").to_pylist()), np.float32).reshape(len(vectors), parts, -1)
    for low in range(0, len(vectors), BLOCK):
        points = whole_parts(vectors[low : low + BLOCK], parts, books.scale)
        found = [
            nearest(points[:, p], books.entries[p], kept[low : low + BLOCK, p], pivots[p]) for p in range(parts)
        ]
        yield low, points, *(np.stack([f[i] for f in found], axis=1) for i in (0, 1))


def _to_pivots(pivots: np.ndarray, scale: int):
    """Distances of each part to its pivots: the step that is done once."""

    def run(vectors: pa.Array) -> pa.Array:
        parts, _, width = pivots.shape
        whole = whole_parts(_matrix(vectors, parts * width), parts, scale)
        found = np.stack([_distances(whole[:, p], pivots[p]) for p in range(parts)], axis=1).astype(np.float32)
        return pa.array([row.tobytes() for row in found], pa.binary())

    return run


def _sums(books: Codebooks, pivots: np.ndarray):
    """(part, entry, position, n, total) of each entry's points: at most one row per codebook component and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            for _, points, which, _ in _assigned(batch, books, pivots):
                for p in range(len(totals)):
                    np.add.at(totals[p], which[:, p], points[:, p])
                    counts[p] += np.bincount(which[:, p], minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        width = books.entries.shape[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width).astype(np.int32)), pa.array(np.repeat(entry, width).astype(np.int32)),
             pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))), pa.array(np.repeat(counts[part, entry], width)),
             pa.array(totals[part, entry].ravel())], names=["part", "entry", "position", "n", "total"],
        )

    return run


def _codes(books: Codebooks, pivots: np.ndarray, schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, _, which, squares in _assigned(batch, books, pivots):
                codes += [row.tobytes().hex() for row in which.astype(np.uint8)]
                errors.append(squares.sum(axis=1))
            made = {"code": pa.array(codes, pa.string()), "error": pa.array(np.concatenate([*errors, np.zeros(0, np.int64)]))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def compress(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS
) -> tuple[DataFrame, Codebooks]:
    """``rows`` (vec_id, embedding, label) with ``code`` (two hex digits for each part), ``error`` (squared distances to the
    entries) and ``label_error`` (errors summed over equal labels, nulls together) in place of the embedding; and the codebooks.

    A codebook starts as the parts of the ``entries`` (256 at most) smallest vec_ids, equal ids by vector, null ids last; fewer
    vectors give fewer entries.  Dropped are vectors that are null, hold a null or non-finite component or, since
    parts must be alike, have another length than most (of equally common lengths the larger stays).  Other rows and columns
    stay, repeated rows too; columns named like the results are replaced.  An empty table gives an empty result.  Raises
    ValueError if the vectors cannot be cut into equal parts and ArithmeticError if squared distances exceed a long.
    """
    kept = rows.where(_usable(F.col("embedding")))
    common = kept.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("embedding") == length)
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    seeds: list[Row] = kept.select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    books = Codebooks(_first_entries([r["embedding"] for r in seeds], parts, length, scale), scale)
    fixed = pick_pivots(books.entries, pivots) if seeds else np.zeros((parts, pivots, length // parts), np.int64)
    others = [c for c in rows.columns if c not in (*MADE, "embedding")]
    whole = kept.select(F.struct(*others).alias("_row"), F.struct("label").alias("_label"), F.col("embedding").alias("_vector"))
    once = cut_lineage(whole.withColumn("_pivots", F.arrow_udf(_to_pivots(fixed, scale), "binary")("_vector")))
    for _ in range(rounds if seeds else 0):
        books = Codebooks(_averaged(once, books, fixed), scale)
    schema = T.StructType(once.select("_row", "_label").schema.fields + T.StructType.fromDDL("code string, error long").fields)
    coded = cut_lineage(once.mapInArrow(_codes(books, fixed, schema), schema))
    totals = coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    totals = cut_lineage(totals)
    if totals.count() <= BROADCAST_ROWS:
        joined = coded.join(F.broadcast(totals), "_label")
    else:
        coded = coded.withColumn("_at", F.monotonically_increasing_id())
        joined = join_on_counted_keys(coded, totals, ["_label"], "_rows", "inner", ["_at"])
    return joined.select(*[F.col("_row")[c].alias(c) for c in others], *MADE), books


def _first_entries(vectors: list[list[float]], parts: int, length: int, scale: int) -> np.ndarray:
    table = np.array(vectors, np.float64).reshape(len(vectors), length)
    return whole_parts(table, parts, scale).transpose(1, 0, 2).copy()


def _averaged(once: DataFrame, books: Codebooks, pivots: np.ndarray) -> np.ndarray:
    """The next codebooks: the floored mean of each entry's points.  What is collected is one number per component."""
    found = once.select("_vector", "_pivots").mapInArrow(
        _sums(books, pivots), "part int, entry int, position int, n long, total long"
    )
    entries = books.entries.copy()
    for r in found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        entries[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return entries
