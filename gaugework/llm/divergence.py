"""Source divergence audit: how the terms of each source of a language differ from those of the others.

A (lang, source) group gives a term with ``n`` occurrences the share p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N its count over
all V kept terms.  Two shares p and q differ by floor((p - q)^2 / (p + q)); a pair of sources by the sum over all kept terms.

Sums over pairs are taken on segment trees.  The kept terms of a language are dealt to blocks of consecutive term ids, and
a group's counts in a block are the leaves of a tree.  Trees are hash-consed: equal subtrees of any groups are one node.
Two trees are walked together from their roots, and each pair of nodes is followed once, with the number of places where
it occurs; only pairs of leaves are priced.  A task holds one block of terms for two bounded sets of groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import as_bytes, small_side
from gaugework.session import cut_lineage

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
BLOCK_TERMS = 4096  # term ids of a tree, on average
GROUPS = 128  # groups of a language that a task compares with as many others
HELD_TERMS = 300_000  # distinct terms that a task counts before it passes them on


def _term_bytes() -> bytes:
    """A byte for each byte: letters in lower case and bytes from 0x80 on as they are, else a blank."""
    kept = {b: b for b in [*range(0x80, 0x100), *b"abcdefghijklmnopqrstuvwxyz"]}
    kept |= {b: b + 32 for b in range(ord("A"), ord("Z") + 1)}
    return bytes(kept.get(b, 0x20) for b in range(256))


_TERMS = _term_bytes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): counts of a task's documents, passed on whenever many are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, as_bytes(batch.column("text"))):
            terms = text.translate(_TERMS).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size > HELD_TERMS:
                yield from _rows(held)
                held, size = {}, 0
    yield from _rows(held)


def _rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
             pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
             pa.array(list(map(docs.__getitem__, terms)), pa.int64())], names=["lang", "source", "term", "n", "docs"],
        )


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT (n + 2) / whole), by long division in three steps of 1000, so that nothing exceeds 63 bits."""
    left, found = n + 2, np.zeros(np.broadcast(n, whole).shape, np.int64)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, whole)
        found = found * 1000 + digit
    return found + 1


def difference(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers, arrays of them or columns."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, p + q) if isinstance(p, Column) else square // (p + q)


def _share(n: str, whole: str) -> Column:
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(18, 0)) * ({n} + 2)) DIV {whole}")


# -- trees --------------------------------------------------------------------


def consed_trees(counts: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hash-consed trees over the rows of ``counts`` (groups x leaves; columns from ``size`` on are no terms).

    Returns the root node of each row, (left, right) children of the nodes from the root's level downwards, and the
    counts that leaf nodes stand for (-1: no term).
    """
    width = 1 << max(size - 1, 0).bit_length()
    leaves = np.full((len(counts), width), -1, np.int64)
    leaves[:, :size] = counts[:, :size]
    values, nodes = np.unique(leaves, return_inverse=True)
    nodes, levels, known = nodes.reshape(leaves.shape), [], len(values)
    while nodes.shape[1] > 1:
        pairs, nodes_above = np.unique(nodes[:, 0::2] * known + nodes[:, 1::2], return_inverse=True)
        levels.append((pairs // known, pairs % known))
        nodes, known = nodes_above.reshape(len(counts), -1), len(pairs)
    return nodes[:, 0], levels[::-1], values


def _once(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times[order], first)


def pair_values(
    one: int, others: np.ndarray, wholes: np.ndarray, trees: tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]
) -> np.ndarray:
    """Sum of differences between row ``one`` and each of the rows ``others``; ``wholes`` is N + 2 V by row."""
    roots, levels, counts = trees
    which, mine, theirs = np.arange(len(others)), np.full(len(others), roots[one]), roots[others]
    times = np.ones(len(others), np.int64)
    for left, right in levels:
        known = int(max(left.max(), right.max())) + 1
        which = np.concatenate([which, which])
        mine = np.concatenate([left[mine], right[mine]])
        theirs = np.concatenate([left[theirs], right[theirs]])
        keys, times = _once((which * known + mine) * known + theirs, np.concatenate([times, times]))
        which, keys = np.divmod(keys, known * known)
        mine, theirs = np.divmod(keys, known)
    present = counts[mine] >= 0
    which, mine, theirs, times = which[present], counts[mine[present]], counts[theirs[present]], times[present]
    priced = difference(shares(mine, wholes[one]), shares(theirs, wholes[others[which]])) * times
    values = np.zeros(len(others), np.int64)
    np.add.at(values, which, priced)
    return values


def _compare(table: pa.Table) -> pa.Table:
    """Values of the pairs of two sets of groups in one block.

    Rows with a negative ``term`` stand for groups: -term is the number of terms in the block and n the group's N + 2 V.
    """
    at, term, n = (table.column(c).to_numpy() for c in ("at", "term", "n"))
    low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
    marks = term < 0
    groups, first = np.unique(at[marks], return_index=True)
    size, wholes = int(-term[marks][0]), n[marks][first]
    counts = np.zeros((len(groups), size), np.int64)
    counts[np.searchsorted(groups, at[~marks]), term[~marks]] = n[~marks]
    trees = consed_trees(counts, size)
    found = []
    for one in np.flatnonzero(groups // GROUPS == low):
        others = np.flatnonzero((groups // GROUPS == high) & (groups > groups[one]))
        if len(others):
            found.append((np.full(len(others), groups[one]), groups[others], pair_values(one, others, wholes, trees)))
    columns = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3)]
    lang = pa.array([table.column("lang")[0].as_py()] * len(columns[0]), pa.string())
    return pa.table([lang, *map(pa.array, columns)], names=["lang", "a", "b", "value"])


# -- the audit ----------------------------------------------------------------


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for the table ``docs`` (lang, source, text).

    Part ``pair``: each other source of the language with the summed difference.  Part ``term``: the ``top`` terms that a
    group has more often than its language, with the difference.  Ranks go by value descending, then item ascending.
    Terms are runs of letters A-Z (in lower case) and characters above ASCII; those in at least ``least_docs`` rows of
    their language are kept.  Null lang, source and text are empty texts, repeated rows count each time, other columns are
    not looked at.  A group without kept terms has a share of every term as well; where a language keeps none, its pairs
    have value 0.  An empty table gives an empty result.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = cut_lineage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = cut_lineage(kept.drop("docs"))
    langs = cut_lineage(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n")))
    blocks = F.ceil(F.col("terms") / BLOCK_TERMS)
    dealt = kept.join(small_side(langs), "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    # frequent terms first: rare ones side by side share subtrees
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("total"), "term")) - 1
    dealt = cut_lineage(dealt.select("lang", "term", "total", "block", place.cast("long").alias("id")))
    cells = cut_lineage(counted.drop("docs").join(dealt, ["lang", "term"]))
    groups = own.select("lang", "source").distinct()
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    whole = F.coalesce("group_n", F.lit(0)) + 2 * F.col("terms")
    groups = cut_lineage(
        groups.join(small_side(langs), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
        .select("lang", "source", number.cast("long").alias("at"), "terms", whole.alias("whole"),
                (F.col("lang_n") + 2 * F.col("terms")).alias("lang_whole"))
    )
    return _pairs(dealt, cells, groups).unionByName(_terms(cells, groups, top))


def _terms(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    priced = cells.join(small_side(groups), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share("n", "whole").alias("p"), _share("total", "lang_whole").alias("q")
    )
    value = difference(F.col("p"), F.col("q"))
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value"))
    return _ranked(over).where(F.col("rank") <= top)


def _pairs(dealt: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    sizes = cut_lineage(dealt.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("size")))
    chunks = groups.groupBy("lang").agg(F.ceil((F.max("at") + 1) / GROUPS).alias("chunks"))
    known = small_side(cut_lineage(groups.join(chunks, "lang")))
    marks = known.join(small_side(sizes), "lang").select(
        "lang", "block", "at", (-F.col("size")).alias("term"), F.col("whole").alias("n"), "chunks"
    )
    leaves = cells.join(known, ["lang", "source"]).select("lang", "block", "at", F.col("id").alias("term"), "n", "chunks")
    mine = F.floor(F.col("at") / GROUPS)
    units = marks.unionByName(leaves).select(
        "lang", "block", "at", "term", "n", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    units = units.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("mine", "other")
    priced = units.groupBy("lang", "block", "low", "high").applyInArrow(_compare, "lang string, a long, b long, value long")
    summed = cut_lineage(priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    # languages without kept terms have no trees
    bare = groups.where("terms = 0").select("lang", "at")
    bare = bare.join(bare.withColumnRenamed("at", "b"), "lang").where("at < b").select("lang", F.col("at").alias("a"), "b", F.lit(0).cast("long").alias("value"))
    half = summed.unionByName(bare)
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = small_side(groups.select("lang", F.col("at").alias("a"), "source"))
    items = small_side(groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item")))
    named = both.join(names, ["lang", "a"]).join(items, ["lang", "b"])
    return _ranked(named.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
