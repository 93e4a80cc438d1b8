"""N-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles.  Two documents are linked when their sets' Jaccard similarity is at least
``num / den``.  Equal sets are one class from the start.  The exact join of the classes:

1. *Thinning.*  Linked sets share tokens among the first ones in hash order (prefix rule with a margin), so a class
   whose first tokens are mostly its own is out.  Tokens that a fixed share of all documents holds are known
   beforehand; they count as shared without being shuffled.
2. *Groups.*  Similar classes get the same anchor, the smallest token that others hold too.  An
   anchor's classes are cut into groups of a bounded number of tokens.
3. *Matrix.*  One row for each token and group that has it in a member's prefix, rarest tokens first.  Groups
   that meet in no row cannot hold linked members.
4. *Opening.*  For each pair of groups that meet, a member is compared with the other group's token union; only if that
   overlap can reach the bound is the group opened and the member compared with its members.

Every rule is a bound, so no link is lost.  Tasks report links as counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.llm.common import WordHasher, distinct_sorted, each_shingles, small_side
from gaugework.llm.components import components
from gaugework.session import cut_lineage


@dataclass(frozen=True)
class JaccardJoin:
    """Parameters of the join.

    words: words of a shingle.  num, den: linked if intersection * den >= num * union.
    margin: percent of a set that its prefix is longer than it must be (more rows, fewer false candidates).
    common: tokens that this share of the documents holds are resolved before the shuffle, so there are at
    most 2 * mean set size / common of them.  flush: tokens counted at a time by a task.  group_tokens: tokens of a group.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    margin: int = 10
    common: float = 1 / 256
    flush: int = 1_000_000
    group_tokens: int = 1 << 16

    def least(self, n):
        """Tokens that a set of ``n`` must share with any set it is linked with."""
        return -(-n * self.num // self.den)

    def extra(self, n):
        return np.maximum(1, n * self.margin // 100)

    def sets(self, texts: pa.Array, hasher: WordHasher) -> Iterator[np.ndarray]:
        for hashes, ends in hasher.blocks(texts):
            for found in each_shingles(hashes, ends, self.words):
                yield distinct_sorted(found)


def _keys(tokens: np.ndarray) -> tuple[bytes, int]:
    key = xxhash.xxh3_128_digest(tokens.tobytes())
    return key, int.from_bytes(key[:8], "little", signed=True)


def _survey(spec: JaccardJoin):
    """Documents with their set's size and key; and tokens that many documents of a part hold."""

    def common(parts: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        tokens, hits = np.unique(np.concatenate(parts), return_counts=True)
        often = hits >= max(2, spec.common * len(parts) / 2)
        none = [pa.nulls(int(often.sum()), f.type) for f in schema][:4]
        return pa.RecordBatch.from_arrays(
            [*none, pa.array(tokens[often].view(np.int64)), pa.array(hits[often].astype(np.int64))], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()),
                            ("set_key", pa.binary()), ("token", pa.int64()), ("hits", pa.int64())])
        hasher, parts, held = WordHasher(lower=True), [], 0
        for batch in batches:
            sizes, keys, short = [], [], []
            for tokens in spec.sets(batch.column("text"), hasher):
                key, cls = _keys(tokens) if len(tokens) else (None, None)
                sizes.append(len(tokens)), keys.append(key), short.append(cls)
                parts.append(tokens)
                held += len(tokens)
                if held >= spec.flush:
                    yield common(parts, schema)
                    parts, held = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(short, pa.int64()),
                 pa.array(keys, pa.binary()), none, none], schema=schema
            )
        if held:
            yield common(parts, schema)

    return run


def _first_tokens(spec: JaccardJoin, heavy):
    """(token, cls, weight): a set's first tokens; the common ones among them as one row of that weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            tokens, owners, weights = [], [], []
            for own in spec.sets(batch.column("text"), hasher):
                n = len(own)
                if not n:
                    continue
                _, cls = _keys(own)
                first = own[: n - spec.least(n) + spec.extra(n)]
                first = first[~(often := _within(first, heavy.value))]
                if shared := int(often.sum()):
                    tokens.append(np.array([cls], np.int64).view(np.uint64))
                    owners.append(np.array([cls], np.int64))
                    weights.append(np.array([shared], np.int64))
                tokens.append(first)
                owners.append(np.full(len(first), cls, np.int64))
                weights.append(np.zeros(len(first), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)),
                     pa.array(np.concatenate(weights))], names=["token", "cls", "weight"]
                )

    return run


def _within(tokens: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(sorted_set, tokens), len(sorted_set) - 1)
    return sorted_set[at] == tokens


def _whole_sets(spec: JaccardJoin, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            owners, light, often = [], [], []
            for own in spec.sets(batch.column("text"), hasher):
                if len(own):
                    owners.append(_keys(own)[1])
                    hot = _within(own, heavy.value)
                    light.append(own[~hot].view(np.int64))
                    often.append(own[hot].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), _lists(light), _lists(often)], names=["cls", "light", "often"]
            )

    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.zeros(0, np.int64)]))


def _members(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners, copies, ends and tokens of a group's members."""
    rows = lists.flatten() if isinstance(lists, pa.ListArray) else lists
    tokens = rows.field("tokens")
    ends = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
    return rows.field("cls").to_numpy(), rows.field("copies").to_numpy(), ends, tokens.flatten().to_numpy()


class _Forest(dict):
    def root(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def _compare(spec: JaccardJoin, left, right, itself: bool) -> tuple[list, list]:
    """Links between the members of two groups: edges of a spanning forest, and links by class."""
    a_cls, a_copies, a_ends, a_tokens = left
    b_cls, b_copies, b_ends, b_tokens = right
    union, coded = np.unique(b_tokens, return_inverse=True)
    sizes, held = np.diff(b_ends), np.zeros(len(union), bool)
    forest, edges, links = _Forest(), [], {}
    for i, cls in enumerate(a_cls.tolist()):
        own = a_tokens[a_ends[i] : a_ends[i + 1]]
        n, least = len(own), spec.least(len(own))
        inside = _within(own, union)
        if inside.sum() < least or itself and i + 1 == len(a_cls):
            continue  # the other group's union cannot reach the bound: stays closed
        at = np.searchsorted(union, own[inside])
        held[at] = True
        overlap = np.add.reduceat(held[coded].astype(np.int64), b_ends[:-1]) if len(coded) else np.zeros(0, np.int64)
        held[at] = False
        linked = overlap * spec.den >= spec.num * (n + sizes - overlap)
        if itself:
            linked[: i + 1] = False
        for j in np.flatnonzero(linked).tolist():
            other = int(b_cls[j])
            links[cls] = links.get(cls, 0) + int(b_copies[j])
            links[other] = links.get(other, 0) + int(a_copies[i])
            if (x := forest.root(cls)) != (y := forest.root(other)):
                forest[x] = y
                edges.append((cls, other))
    return edges, list(links.items())


def _open_groups(spec: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                itself = not right.is_valid
                mine = _members(left.values)
                edges, links = _compare(spec, mine, mine if itself else _members(right.values), itself)
                rows = [(a, b, None) for a, b in edges] + [(c, None, n) for c, n in links]
                columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "links"])

    return run


def jaccard_join(docs: DataFrame, spec: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text; others are ignored).

    component_id is the smallest doc_id that links reach, n_links the number of other rows linked directly (equal sets
    included).  A null, empty or blank text has 0 shingles, no links, and its own doc_id as component.  A text
    of fewer words than a shingle is one shingle.  Repeated rows are rows of one class.  A null doc_id is kept and takes the
    component's smallest id, null if no row has one.  An empty table gives an empty result.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = "doc_id long, n_shingles long, cls long, set_key binary, token long, hits long"
    survey = cut_lineage(docs.mapInArrow(_survey(spec), seen))
    own = survey.where("token IS NULL").select("doc_id", "n_shingles", "cls", "set_key")
    bar = max(2.0, spec.common * own.count() / 2)
    often = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= bar)
    heavy = sc.broadcast(np.sort(np.array([r[0] for r in often.select("token").collect()], np.int64).view(np.uint64)))
    classes = cut_lineage(
        own.where("cls IS NOT NULL").groupBy("cls", "set_key", "n_shingles")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    )

    by_token = Window.partitionBy("token")
    first = docs.mapInArrow(_first_tokens(spec, heavy), "token long, cls long, weight long")
    shared = (
        first.withColumns({"lo": F.min("cls").over(by_token), "hi": F.max("cls").over(by_token)})
        .where("weight > 0 OR lo < hi").groupBy("cls").agg(F.sum(F.greatest("weight", F.lit(1))).alias("shared"))
    )
    least = F.ceil(F.col("n_shingles") * spec.num / spec.den)
    need = F.greatest(F.lit(1), F.floor(least * spec.margin / 100))
    left = cut_lineage(classes.join(shared, "cls").where(F.col("shared") >= need * F.col("copies")).select("cls", "copies"))

    whole = docs.mapInArrow(_whole_sets(spec, heavy), "cls long, light array<long>, often array<long>")
    sets = cut_lineage(whole.join(small_side(left), "cls").dropDuplicates(["cls"]))
    matrix, grouped = _matrix(sets, spec)
    links = _links(sets, matrix, grouped, spec)
    found = components(links.where("b IS NOT NULL"))
    return _answer(own, classes, links, found)


def _ceil_of(n: Column, num: int, den: int) -> Column:
    return F.floor((n * num + den - 1) / den)


def _matrix(sets: DataFrame, spec: JaccardJoin) -> tuple[DataFrame, DataFrame]:
    """The matrix (token, grp) and the groups' members (cls, grp)."""
    n = (F.size("light") + F.size("often")).cast("long").alias("n")
    by_token, by_class = Window.partitionBy("token"), Window.partitionBy("cls")
    light = sets.select("cls", n, F.explode("light").alias("token"))
    light = light.withColumn("df", F.count(F.lit(1)).over(by_token)).where("df > 1")
    often = sets.select("cls", n, F.explode("often").alias("token")).withColumn("df", F.lit(1 << 40))
    rows = light.unionByName(often).withColumns(
        {"rank": F.row_number().over(by_class.orderBy("df", "token")), "held": F.count(F.lit(1)).over(by_class),
         "anchor": F.min("token").over(by_class)}
    )
    # tokens that no other set holds come first in the order, so they use up the prefix
    place = F.col("n") - F.col("held") + F.col("rank")
    prefix = cut_lineage(
        rows.where(place <= F.col("n") - _ceil_of(F.col("n"), spec.num, spec.den) + 1).select("cls", "n", "token", "anchor")
    )
    alive = prefix.select("cls", "n", "anchor").distinct()
    parts = alive.groupBy("anchor").agg(F.ceil(F.sum("n") / spec.group_tokens).alias("parts"))
    grp = F.xxhash64("anchor", F.pmod(F.xxhash64("cls"), "parts")).alias("grp")
    grouped = cut_lineage(alive.join(parts, "anchor").select("cls", grp))
    return prefix.join(grouped, "cls").select("token", "grp").distinct(), grouped


def _links(sets: DataFrame, matrix: DataFrame, grouped: DataFrame, spec: JaccardJoin) -> DataFrame:
    """Rows (a, b, null) for edges and (a, null, links) for counts, from all pairs of groups that meet in the matrix."""
    matrix = cut_lineage(matrix)
    other = matrix.select("token", F.col("grp").alias("with"))
    pairs = matrix.join(other, "token").where("grp < `with`").select("grp", "with").distinct()
    member = F.struct("cls", "copies", F.array_sort(F.concat("light", "often")).alias("tokens"))
    groups = cut_lineage(sets.join(grouped, "cls").groupBy("grp").agg(F.collect_list(member).alias("left")))
    right = groups.select(F.col("grp").alias("with"), F.col("left").alias("right"))
    inside = groups.where(F.size("left") > 1).select("left", F.lit(None).cast(right.schema["right"].dataType).alias("right"))
    across = pairs.join(groups, "grp").join(right, "with").select("left", "right")
    schema = "a long, b long, links long"
    return cut_lineage(inside.unionByName(across).mapInArrow(_open_groups(spec), schema))


def _answer(own: DataFrame, classes: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    counts = links.where("links IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    known = (
        classes.join(counts, "cls", "left")
        .join(found.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("label", F.coalesce("label", "cls"))
        .withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    )
    smallest = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = known.join(smallest, "label").select("set_key", "component_id", "n_links")
    alone = own.where("set_key IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    return own.join(known, "set_key").select("doc_id", "n_shingles", "component_id", "n_links").unionByName(alone)
