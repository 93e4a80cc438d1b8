"""Removal of repeated passages, located with Aho-Corasick automata.

A window is ``window`` consecutive words.  Words covered by a window that also starts in a document with a smaller doc_id
are removed.

1. *Survey.*  Documents with the same words are one; of those the smallest doc_id stands for all, later copies lose all
   words.  From each window the phrase (a few words) of the smallest hash is taken, so equal windows give equal phrases.
2. *Confirm.*  Phrases that only one document has are dropped: no window around them can recur.
3. *Locate.*  Each task compiles the recurring phrases of its documents into automata of a bounded number of phrases, and
   streams its documents through them.  Documents without a recurring phrase hold no recurring window.  Automata of all
   phrases over all documents would find the same places: equal windows choose equal phrases, so a document's own
   phrases already say which of the recurring ones it can hold.
4. *Decide.*  Windows around a located phrase are keyed by 96 bits of their words; the smallest doc_id of each key decides.

Rows that travel are hashes; texts are scanned where they lie, or shuffled once per join when the other side is too
large for a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import WordHasher, as_bytes, distinct_sorted, each_shingles, mixed, shingles
from gaugework.session import cut_lineage

PHRASE = 8  # words of a phrase
SHARD_PHRASES = 20_000  # phrases of one automaton
BROADCAST_VALUES = 4_000_000  # largest number of 8-byte values in a side that is broadcast (32 MB)
LAST = (1 << 63) - 1  # a null doc_id counts as larger than any other

_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


def _window_keys(hashes: np.ndarray, window: int, which: int) -> np.ndarray:
    """A key of each run of ``window`` words, from prefix sums of a polynomial."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(hashes + np.uint64(which)) * _powers(_BASES[which], n), out=sums[1:])
    return mixed((sums[window:] - sums[:-window]) * _powers(_INVERSES[which], n - window + 1))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _survey(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            keys, phrases, keep, row = [], [], [], 0
            for hashes, ends in hasher.blocks(batch.column("text")):
                for i, found in enumerate(each_shingles(hashes, ends, PHRASE)):
                    if ends[i + 1] - ends[i] >= window:
                        keep.append(row + i)
                        keys.append(xxhash.xxh3_128_digest(hashes[ends[i] : ends[i + 1]].tobytes()))
                        phrases.append(distinct_sorted(_sliding_min(found, window - PHRASE + 1)).view(np.int64))
                row += len(ends) - 1
            at = pa.array(keep, pa.int64())
            bounds = np.cumsum([0, *map(len, phrases)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(bounds, np.concatenate([*phrases, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ord").take(at), batch.column("row_key").take(at), pa.array(keys, pa.binary()), lists],
                names=["ord", "row_key", "words_key", "phrases"],
            )

    return run


def _automata(phrases: list[str]) -> Iterator[ahocorasick.Automaton]:
    """Automata over all phrases, each over a bounded number of them."""
    for low in range(0, len(phrases), SHARD_PHRASES):
        shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases[low : low + SHARD_PHRASES]:
            shard.add_word(phrase)
        shard.make_automaton()
        yield shard


def _locate(window: int):
    """(ord, row_key, start, k1, k2): the windows around each occurrence of a recurring phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            words = [text.split() for text in as_bytes(batch.column("text"))]
            recurring: set[str] = set()
            hashed = [hasher.of(b" ".join(own)) for own in words]
            for own, whole, wanted in zip(words, hashed, batch.column("phrases")):
                hashes = shingles(whole, PHRASE)
                wanted = wanted.values.to_numpy().view(np.uint64)
                _, at = np.unique(hashes, return_index=True)
                at = at[np.isin(hashes[at], wanted, kind="sort")].tolist()
                recurring.update(" " + b" ".join(own[i : i + PHRASE]).decode() + " " for i in at)
            lines = [" " + b" ".join(own).decode() + " " for own in words]
            found: list[list[int]] = [[] for _ in lines]
            for shard in _automata(sorted(recurring)):
                for line, ends in zip(lines, found):
                    ends += [end for end, _ in shard.iter(line)]  # the blank after the phrase's last word
            parts = [_windows(own, line, ends, window) for own, line, ends in zip(hashed, lines, found)]
            rows = np.array([len(p[0]) for p in parts])
            at = pa.array(np.repeat(np.arange(len(parts)), rows))
            columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            step = 1 << 17
            for low in range(0, len(at), step):
                here = at.slice(low, step)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ord").take(here), batch.column("row_key").take(here),
                     *(pa.array(c[low : low + step]) for c in columns)], names=["ord", "row_key", "start", "k1", "k2"]
                )

    return run


def _windows(hashes: np.ndarray, line: str, ends: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(hashes) - window + 1
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)  # blank i precedes word i
    last = np.searchsorted(blanks, np.array(ends, np.int64)) - 1  # the phrase's last word
    low = np.clip(last - window + 1, 0, n)
    high = np.clip(last - PHRASE + 1, -1, n - 1) + 1
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, np.maximum(low, high), -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    keys = [_window_keys(hashes, window, which)[starts] for which in (0, 1)]
    return starts.astype(np.int32), keys[0].view(np.int64), (keys[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _covered(window: int):
    """Word ranges (begin, end, begin, end ...) that windows with some starts cover together."""

    def run(starts: pa.Array) -> pa.Array:
        found, ends = [], [0]
        offsets, flat = starts.offsets.to_numpy(), starts.values.to_numpy()
        for low, high in zip(offsets[:-1], offsets[1:]):
            own = np.sort(flat[low:high])
            breaks = np.flatnonzero(np.diff(own) > window) + 1
            begins, last = own[np.r_[0, breaks]], own[np.r_[breaks - 1, len(own) - 1]] + window
            found.append(np.stack([begins, last], axis=1).ravel())
            ends.append(ends[-1] + len(found[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)))

    return run


def _without(joined: bool):
    """Struct of word count, words removed and the text left, from a text, its covered ranges and a flag for all."""

    def run(texts: pa.Array, ranges: pa.Array, whole: pa.Array) -> pa.Array:
        counts, gone, kept = [], [], []
        offsets, flat = ranges.offsets.to_numpy(), ranges.values.to_numpy()
        for i, (text, all_gone) in enumerate(zip(as_bytes(texts), whole.to_pylist())):
            words = text.split()
            left = np.full(len(words), not all_gone)
            if offsets[i + 1] > offsets[i]:
                for low, high in flat[offsets[i] : offsets[i + 1]].reshape(-1, 2):
                    left[low:high] = False
            counts.append(len(words))
            gone.append(len(words) - int(left.sum()))
            if joined:
                kept.append(b" ".join(words if left.all() else [words[j] for j in np.flatnonzero(left)]))
            else:
                kept.append(text if left.all() else _cut(text, words, left.tolist()))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["n_words", "n_removed", "kept"],
        )

    return run


def _cut(text: bytes, words: list[bytes], left: list[bool]) -> bytes:
    """The words left, each with the blanks that followed it."""
    begins, at = [], 0
    for word in words:
        at = text.index(word, at)
        begins.append(at)
        at += len(word)
    ends = [*begins[1:], len(text)]
    return b"".join(text[i:j] for i, j, kept in zip(begins, ends, left) if kept).rstrip()


def _sized(side: DataFrame, values: int) -> DataFrame:
    return F.broadcast(side) if values <= BROADCAST_VALUES else side


def remove_repeats(docs: DataFrame, window: int = 50, joined: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and kept, the text without repeated passages; all rows and columns stay.

    kept has the remaining words with the blanks that followed them, or (``joined``) one blank between words.  A null text
    has no words.  A null doc_id counts as larger than any other; rows of one doc_id are never compared with each other.
    A text with fewer words than a window is left as it is.  An empty table gives an empty result.  Columns named like the
    three results are replaced.
    """
    own = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64("text").alias("row_key"), F.col("text").cast("string"),
    )
    slim = own.select("ord", "row_key", "text")
    survey = cut_lineage(
        slim.mapInArrow(_survey(window), "ord long, row_key long, words_key binary, phrases array<long>")
    )
    first = survey.groupBy("words_key").agg(F.min("ord").alias("first"))
    keys = cut_lineage(survey.select("ord", "row_key", "words_key").join(first, "words_key"))
    copies = keys.where("ord > first").select("ord", "row_key").distinct()
    firsts = keys.where("ord = first").select("ord", "row_key").distinct()

    held = survey.select("ord", "row_key", F.explode("phrases").alias("phrase"))
    spread = held.groupBy("phrase").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high")
    wanted = cut_lineage(
        held.join(spread.select("phrase"), "phrase").groupBy("ord", "row_key")
        .agg(F.collect_set("phrase").alias("phrases")).join(firsts, ["ord", "row_key"])
    )
    values = wanted.agg(F.sum(F.size("phrases") + 4)).first()[0] or 0
    searched = slim.join(_sized(wanted, values), ["ord", "row_key"])
    schema = "ord long, row_key long, start int, k1 long, k2 int"
    windows = cut_lineage(searched.mapInArrow(_locate(window), schema))
    owner = windows.groupBy("k1", "k2").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high")
    repeated = windows.join(owner.select("k1", "k2", "low"), ["k1", "k2"]).where("ord > low")
    starts = repeated.groupBy("ord", "row_key").agg(F.collect_set("start").alias("starts"))
    covered = F.arrow_udf(_covered(window), "array<int>")
    gone = cut_lineage(
        starts.select("ord", "row_key", covered("starts").alias("ranges"), F.lit(False).alias("whole"))
        .unionByName(copies.select("ord", "row_key", F.array().cast("array<int>").alias("ranges"), F.lit(True).alias("whole")))
    )
    values = gone.agg(F.sum(F.size("ranges") + 4)).first()[0] or 0
    cut = F.arrow_udf(_without(joined), "n_words long, n_removed long, kept string")
    none, made = F.array().cast("array<int>"), ("n_words", "n_removed", "kept")
    return (
        own.join(_sized(gone, values), ["ord", "row_key"], "left")
        .withColumn("_done", cut("text", F.coalesce("ranges", none), F.coalesce("whole", F.lit(False))))
        .select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in made], *[f"_done.{c}" for c in made])
    )
