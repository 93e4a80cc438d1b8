"""Counts of label pairs for all pairs of many columns, from one scan.

Tasks replace labels by codes and count pairs of codes in arrays, one pair of columns after the
other; only (column, column, code, code, count) goes to the shuffle.  A label's text is sent once by
each task that meets it, as a row of its own column's dictionary.

A code is a keyed hash of the label, so tasks agree on it without a table sent to them.  The
dictionary shows whether two labels of a column share a code; if so, all is counted again with
another key.  Counts are therefore exact, and neither labels nor pairs have a size limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import col, cut_lineage

CELLS = 1_000_000  # counted pairs that a task holds before it hands them on
LABEL_BYTES = 64 << 20  # bytes of labels that a task holds

_FIELDS = {"i": pa.int32(), "j": pa.int32(), "code_a": pa.int64(), "code_b": pa.int64(), "count": pa.int64(), "label": pa.binary()}
_DDL = "i int, j int, code_a bigint, code_b bigint, count bigint, label binary"


class _Labels:
    """Labels of one column in order of appearance: place 0 is a gap, label n has place n + 1."""

    def __init__(self, seed: int, code_bytes: int):
        self.key, self.code_bytes = seed.to_bytes(8, "little"), code_bytes
        self.places: dict[bytes, int] = {}
        self.codes = [0]
        self.bytes = 0

    def place(self, label: bytes) -> int:
        found = self.places.get(label)
        if found is None:
            found = self.places[label] = len(self.codes)
            digest = blake2b(label, digest_size=self.code_bytes, key=self.key).digest()
            self.codes.append(int.from_bytes(digest, "little", signed=True))
            self.bytes += len(label) + 100
        return found

    def place_all(self, values: pa.Array) -> np.ndarray:
        coded = values.dictionary_encode()
        lookup = np.array([*map(self.place, coded.dictionary.to_pylist()), 0], dtype=np.int64)
        return lookup[coded.indices.fill_null(len(lookup) - 1).to_numpy(zero_copy_only=False)]


class _Cells:
    """Counts by (pair of columns, place, place), in pieces that are merged when they become many."""

    def __init__(self, limit: int):
        self.limit, self.pieces, self.size = limit, [], 0

    def add(self, pair: int, a: np.ndarray, b: np.ndarray) -> None:
        width = int(b.max()) + 1
        span = (int(a.max()) + 1) * width
        joined = a * width + b
        if span <= 4 * len(joined):
            counts = np.bincount(joined, minlength=span)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(joined, return_counts=True)
        at_a, at_b = np.divmod(found, width)
        both = (at_a > 0) & (at_b > 0)
        places = at_a[both] << 31 | at_b[both]
        self.pieces.append((np.full(len(places), pair), places, counts[both]))
        self.size += len(places)

    def merge(self) -> None:
        pair, places, counts = map(np.concatenate, zip(*self.pieces))
        order = np.lexsort((places, pair))
        pair, places, counts = pair[order], places[order], counts[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (places[1:] != places[:-1])
        first = np.flatnonzero(new)
        merged = np.add.reduceat(counts, first) if len(first) else counts
        self.pieces, self.size = [(pair[first], places[first], merged)], len(first)

    def full(self) -> bool:
        if self.size > self.limit:
            self.merge()
        return self.size > self.limit // 2

    def take(self, labels: list[_Labels], left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.pieces:
            self.merge()
            pair, places, counts = self.pieces[0]
            codes = np.concatenate([np.array(one.codes, dtype=np.int64) for one in labels])
            start = np.cumsum([0, *(len(one.codes) for one in labels)])
            i, j = left[pair], right[pair]
            yield _batch(i, j, codes[start[i] + (places >> 31)], codes[start[j] + (places & (1 << 31) - 1)], counts, None)
        self.pieces, self.size = [], 0


def _batch(i, j, code_a, code_b, counts, label) -> pa.RecordBatch:
    rows = len(code_a)
    parts = [pa.nulls(rows, t) if p is None else pa.array(p, t) for p, t in zip((i, j, code_a, code_b, counts, label), _FIELDS.values())]
    return pa.RecordBatch.from_arrays(parts, names=list(_FIELDS))


def _dictionary(labels: list[_Labels]) -> Iterator[pa.RecordBatch]:
    for at, one in enumerate(labels):
        if one.places:
            yield _batch(np.full(len(one.places), at), None, one.codes[1:], None, None, list(one.places))


def coded_cells(
    df: DataFrame, columns: list[str], cells: int = CELLS, label_bytes: int = LABEL_BYTES, code_bytes: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(i, j, code_a, code_b, count) over the rows holding both labels, i < j being places in ``columns``,
    and (i, code, label) of all labels.  Written once to the shared folder; a lost task counts its rows again."""
    k = len(columns)
    left, right = np.triu_indices(k, 1)
    texts = df.select(*[col(c).cast("string").cast("binary").alias(f"c{i}") for i, c in enumerate(columns)])

    def counter(seed: int):
        def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels = [_Labels(seed, code_bytes) for _ in range(k)]
            held = _Cells(cells)
            for batch in batches:
                if not batch.num_rows:
                    continue
                places = [one.place_all(values) for one, values in zip(labels, batch.columns)]
                for pair, (a, b) in enumerate(zip(left, right)):
                    held.add(pair, places[a], places[b])
                    if held.full():
                        yield from held.take(labels, left, right)
                if sum(one.bytes for one in labels) > label_bytes:
                    yield from held.take(labels, left, right)
                    yield from _dictionary(labels)
                    labels = [_Labels(seed, code_bytes) for _ in range(k)]
            yield from held.take(labels, left, right)
            yield from _dictionary(labels)

        return count_pairs

    for seed in count():
        partial = texts.mapInArrow(counter(seed), _DDL)
        whole = cut_lineage(partial.groupBy("i", "j", "code_a", "code_b", "label").agg(F.sum("count").alias("count")))
        entries = whole.filter(F.col("j").isNull())
        shared = entries.groupBy("i", "code_a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if shared.isEmpty():
            return (
                whole.filter(F.col("j").isNotNull()).drop("label"),
                entries.select("i", F.col("code_a").alias("code"), F.col("label").cast("string").alias("label")),
            )
