"""Benchmark passages in documents: one Aho-Corasick automaton over all questions and answers.

Texts are normalised to lower-case words with one blank around each.  An item gives a window at each of its words (``window``
consecutive ones), a shorter item one window.  The automaton holds all windows, so a document is read once, whatever
the number of items; where it matches, words are mapped back to places in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import as_bytes
from gaugework.session import cut_lineage

WINDOW = 10
#: Characters of windows in an automaton (about 150 bytes each in a worker).  A larger benchmark is cut into so many
#: automata by a hash of the window; then documents are read once for each.
AUTOMATON_CHARACTERS = 1_500_000

MADE = ("n_words", "n_hit", "items", "spans")
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SCHEMA = "n_words long, n_hit long, ranges array<int>, items array<string>, spans array<struct<start:long,end:long>>"


def _normal_bytes() -> bytes:
    """A byte for each byte: letters in lower case, digits and bytes from 0x80 on as they are, else a blank."""
    kept = {b: b for b in [*range(0x80, 0x100), *b"0123456789abcdefghijklmnopqrstuvwxyz"]}
    kept |= {b: b + 32 for b in range(ord("A"), ord("Z") + 1)}
    return bytes(kept.get(b, 0x20) for b in range(256))


_NORMAL = _normal_bytes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _windows(window: int):
    """(item, phrase) for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                last = max(len(words) - window, 0 if words else -1)
                phrases = {b" ".join(words[i : i + window]) for i in range(last + 1)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(phrases), pa.string()), pa.array(list(phrases), pa.binary()).cast(pa.string())],
                    names=["item", "phrase"],
                )

    return run


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (begin, end) as few as cover the same words."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.r_[True, ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[first, 0], np.r_[reach[first[1:] - 1], reach[-1]]], axis=1)


def _scan(phrases: list[str], items: list[list[str]]):
    """Word count, ranges of hit words, items found and hit places of each text, added to what was found before."""
    sizes = np.array([p.count(" ") + 1 for p in phrases], np.int64)
    automaton = None

    def run(texts: pa.Array, ranges: pa.Array, found: pa.Array) -> pa.Array:
        nonlocal automaton
        if automaton is None:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, phrase in enumerate(phrases):
                automaton.add_word(f" {phrase} ", i)
            automaton.make_automaton()
        counts, n_hit, out_ranges, out_items, out_spans = [], [], [], [], []
        for text, known, known_items in zip(texts.to_pylist(), ranges.to_pylist(), found.to_pylist()):
            words = words_of((text or "").encode())
            line = f" {b' '.join(words).decode()} "
            hits = np.array(list(automaton.iter(line)) if phrases else [], np.int64).reshape(-1, 2)
            own = np.array(known or [], np.int64).reshape(-1, 2)
            if len(hits):
                blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)  # blank i precedes word i
                ends = np.searchsorted(blanks, hits[:, 0])
                own = _merged(np.concatenate([own, np.stack([ends - sizes[hits[:, 1]], ends], axis=1)]))
                known_items = {*(known_items or ()), *(x for i in set(hits[:, 1].tolist()) for x in items[i])}
            counts.append(len(words))
            n_hit.append(int((own[:, 1] - own[:, 0]).sum()))
            out_ranges.append(own.ravel().tolist())
            out_items.append(sorted(known_items or ()))
            out_spans.append(_places(text, own) if len(own) else [])
        spans = pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(out_ranges, pa.list_(pa.int32())),
             pa.array(out_items, pa.list_(pa.string())), spans], names=["n_words", "n_hit", "ranges", "items", "spans"],
        )

    return run


def _places(text: str, ranges: np.ndarray) -> list[dict[str, int]]:
    """Where ranges of words lie in the original text: code points, end exclusive."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[low][0], "end": at[high - 1][1]} for low, high in ranges.tolist()]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window), items (ids of the items found, as text, ascending)
    and spans (start, end of each run of hit words in the text: code points, end exclusive).

    ``benchmark`` has item_id and text.  A null or wordless text has no words, as a document and as an item; a null item_id
    counts as an empty one, items that share an id are one.  All rows and columns of ``docs`` stay, repeated rows too; columns
    named like the four results are replaced.  Empty tables give an empty result or no finds.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string"))
    windows = items.mapInArrow(_windows(window), "item string, phrase string")
    held = cut_lineage(windows.groupBy("phrase").agg(F.collect_set("item").alias("items")))
    parts = -(-(held.agg(F.sum(F.length("phrase") + 2)).first()[0] or 0) // AUTOMATON_CHARACTERS)
    nothing = (F.array().cast("array<int>").alias("ranges"), F.array().cast("array<string>").alias("items"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"), F.struct(*nothing).alias("_found"))
    for part in range(max(parts, 1)):
        own = held.where(F.pmod(F.xxhash64("phrase"), F.lit(max(parts, 1))) == part).collect()
        scan = F.arrow_udf(_scan([r["phrase"] for r in own], [r["items"] for r in own]), _SCHEMA)
        rows = cut_lineage(rows) if part else rows
        rows = rows.withColumn("_found", scan("text", "_found.ranges", "_found.items"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in MADE], *[f"_found.{c}" for c in MADE])
