"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document is its tokens and an end token; one longer than a sequence is cut, the first piece takes the remainder.  What
is left to place is one piece of at most ``capacity`` tokens per document, and pieces of one length are alike, so the
packing is planned on counts by length, of which there are ``capacity`` at most:

* *Dominance* (Martello and Toth): while some small set holding the longest piece is at least as good as any other set that
  holds it, that set becomes a sequence, as often as the counts allow.  The instance shrinks.
* *Best fit* for what is left, longest first, each piece into the fullest sequence that has room.

The plan says how many sequences of each make-up there are.  Spark numbers the pieces of each length, in buckets
of a bounded number of rows, and each number leads to a sequence and an offset.
"""

from __future__ import annotations

import base64
import os
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.session import cut_lineage

CAPACITY = 1024
END = 2  # id added after each document
BUCKET = 50_000  # rows of one length that are numbered in one group, about


class TokenIds:
    """Ids of a text as little-endian 32-bit numbers.

    ``path`` is a tokenizers file.  ``ranks``, if given, is the same byte-level vocabulary as a list of ranks, with which
    texts are encoded several times faster; texts with a special token's mark always go through the tokenizers file.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.plain = self.exact
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
            ).encode_ordinary

    def exact(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        return array("I", self.exact(text) if "<|" in text else self.plain(text)).tobytes()


def _cut_pieces(path: str, ranks: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = TokenIds(path, ranks), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, pieces, starts, buffers = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = ids_of.of(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [i] * (len(cuts) - 1)
                pieces += range(len(cuts) - 1)
                starts += cuts[:-1]
                buffers += [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
            for low in range(0, len(rows), 4096):
                here = slice(low, low + 4096)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows[here], pa.int64())), pa.array(pieces[here], pa.int32()),
                     pa.array(starts[here], pa.int64()), pa.array(buffers[here], pa.binary())],
                    names=["doc_id", "piece", "start", "ids"],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, ids): ids as little-endian 32-bit numbers.  A null text is empty and gives the end token
    alone; a null doc_id is kept; repeated rows give repeated pieces.  tokenizer and ranks: see TokenIds."""
    schema = "doc_id long, piece int, start long, ids binary"
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(_cut_pieces(tokenizer, ranks, capacity), schema)


def written(pieces: DataFrame) -> DataFrame:
    """``pieces`` written to the shared folder, as planning and placing both read them."""
    return cut_lineage(pieces)


# -- the plan -----------------------------------------------------------------


def reduce_by_dominance(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes sets that dominate out of ``counts``; returns them as (lengths, how often).

    For the longest piece j with room r beside it, let k be the longest that fits.  {j} alone dominates if nothing fits;
    {j, k} if k fills the room or no two pieces fit beside j.  If at most two fit, {j, k, b} dominates when b is the
    longest that fits beside both and no other pair has a shorter member longer than b, as then each member of
    any other set is at most as long as one of these.  The conditions stay true while pieces are taken away.
    """
    made = []
    lengths = sorted(n for n, c in counts.items() if c)
    blocked: set[int] = set()
    while lengths:
        open_lengths = [n for n in reversed(lengths) if n not in blocked]
        if not open_lengths:
            break
        found = _dominating(counts, lengths, open_lengths[0], capacity)
        if found is None:
            blocked.add(open_lengths[0])
            continue
        need = Counter(found)
        times = min(counts[n] // c for n, c in need.items())
        made.append((found, times))
        for n, c in need.items():
            counts[n] -= c * times
            if not counts[n]:
                lengths.remove(n)
                blocked.clear()  # a smaller instance: try the others again
    return made


def _dominating(counts: Counter, lengths: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    left = counts.copy()
    left[j] -= 1

    def fitting(limit: int, most: int | None = None) -> int | None:
        at = bisect_right(lengths, limit if most is None else min(limit, most))
        while at and left[lengths[at - 1]] <= 0:
            at -= 1
        return lengths[at - 1] if at else None

    k = fitting(room)
    if k is None:
        return (j,)
    if k == room:
        return (j, k)
    small = []
    for n in lengths:
        small += [n] * min(left[n], 3 - len(small))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return (j, k)
    if len(small) == 3 and sum(small) <= room:
        return None  # three may fit beside j
    left[k] -= 1
    b = fitting(room - k)
    if b is None:
        return None
    left[k] += 1
    # the longest shorter member of any pair that fits
    second = fitting(room // 2)
    if second is not None and left[second] < 2 and fitting(room - second) == second:
        second = fitting(second - 1)  # one piece only: it is the longer member of its pairs
    return (j, k, b) if second is None or second <= b else None


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room; alike sequences are filled together."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    keys: list[int] = []

    def add(room: int, made: tuple[int, ...], times: int) -> None:
        if not times:
            return
        if not rooms[room]:
            keys.insert(bisect_left(keys, room), room)
        rooms[room].append((made, times))

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(keys, n)
            if at == len(keys):
                each = capacity // n
                add(capacity - each * n, (n,) * each, left // each)
                add(capacity - left % each * n, (n,) * (left % each), int(left % each > 0))
                break
            room = keys[at]
            made, times = rooms[room].pop()
            if not rooms[room]:
                keys.pop(at)
            each = room // n
            full = min(times, left // each)
            rest = left - full * each if full < times and left - full * each < each else 0
            add(room - each * n, made + (n,) * each, full)
            add(room - rest * n, made + (n,) * rest, int(rest > 0))
            add(room, made, times - full - int(rest > 0))
            left -= full * each + rest
    return [x for room in keys for x in rooms[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Make-up of the sequences as (lengths, how many), for so many pieces of each length."""
    left = Counter(counts)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, pieces in a sequence, first sequence, offset), by first number."""
    found, used, sequence = defaultdict(list), Counter(), 0
    for lengths, times in made:
        at = 0
        for n, each in sorted(Counter(lengths).items(), reverse=True):
            found[n].append((used[n], each, sequence, at))
            used[n] += each * times
            at += each * n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


def _place(slots):
    def run(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        lengths, numbers = lengths.to_numpy(), numbers.to_numpy()
        sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == n)
            table, own = slots.value[n], numbers[here]
            first, each, sequence, offset = table[np.searchsorted(table[:, 0], own, "right") - 1].T
            sequences[here] = sequence + (own - first) // each
            offsets[here] = offset + (own - first) % each * n
        return pa.StructArray.from_arrays([pa.array(sequences), pa.array(offsets)], names=["sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.  It needs length (1 to ``capacity``); equal rows are told apart by
    their place in a bucket.  Other columns stay (those two names and number, bucket, before, parts are replaced)."""
    helpers = ("sequence_id", "offset", "number", "bucket", "before", "parts")
    spark = pieces.sparkSession
    pieces = pieces.drop(*helpers)
    counts = {int(n): c for n, c in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # ``capacity`` rows at most
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    parts = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for n, c in counts.items() if c > BUCKET for x in (n, -(-c // BUCKET))]), F.col("length").cast("int"))
        if any(c > BUCKET for c in counts.values()) else F.lit(None), F.lit(1)
    )
    keys = [c for c in pieces.columns if c != "length"]
    dealt = cut_lineage(pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), parts)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("before"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("before").over(earlier), F.lit(0)))
    own = Window.partitionBy("length", "bucket").orderBy(*keys)
    place = F.arrow_udf(_place(slots), "sequence_id long, offset long")
    numbered = dealt.withColumn("number", F.row_number().over(own) - 1).join(sizes, ["length", "bucket"])
    placed = numbered.withColumn("number", place(F.col("length").cast("long"), F.col("number") + F.col("before")))
    return placed.select(*pieces.columns, "number.sequence_id", "number.offset")
