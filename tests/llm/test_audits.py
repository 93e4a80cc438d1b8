"""Divergence audit, vector codes and benchmark passages against brute-force versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import decontamination, divergence, vector_codes
from gaugework.llm.decontamination import find_benchmark
from gaugework.llm.divergence import audit
from gaugework.llm.vector_codes import compress

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- divergence audit -----------------------------------------------------------


def expected_audit(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(ASCII_LOWER)) for _, _, text in rows]
    found = []
    for lang in {r[0] for r in rows}:
        own = [(source, t) for (here, source, _), t in zip(rows, terms) if here == lang]
        in_docs = Counter(x for _, t in own for x in set(t))
        kept = [x for x, n in in_docs.items() if n >= least]
        counts = {s: Counter(x for source, t in own if source == s for x in t if in_docs[x] >= least) for s, _ in own}
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def share(c, x):
            return 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept))

        def price(p, q):
            return (p - q) ** 2 // (p + q)

        for s in counts:
            pairs = [(t, sum(price(share(counts[s], x), share(counts[t], x)) for x in kept)) for t in counts if t != s]
            over = [(x, share(counts[s], x), share(whole, x)) for x in kept if counts[s][x]]
            special = [(x, price(p, q)) for x, p, q in over if p > q]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", special, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                found += [(lang, s, part, x, v, rank) for rank, (x, v) in enumerate(items[:most], 1)]
    return sorted(found)


def audited(frame, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit(frame, **options).collect())


def many_groups(groups=40, docs=400):
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghijklmn" for b in ("ä", "B", "c", "Dd", "日")]
    rows = []
    for i in range(docs):
        lang = draw.choice(["x", "y", None])
        source = "hot" if i % 3 == 0 else draw.choice([f"s{j}" for j in range(groups)] + [None])
        low = draw.randint(0, 30)
        rows.append((lang, source, draw.choice([" ", "1", "\x00", "\n"]).join(draw.choices(words[low : low + 40], k=draw.randint(0, 60)))))
    return rows + [("empty", "a", None), ("empty", "b", ""), ("empty", None, "12 [] \x7f"), ("rare", "a", "one"), ("", "", None)]


def test_audit_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text")
    assert audited(docs) == expected_audit([tuple(r) for r in docs.collect()])


def test_audit_in_many_blocks_and_sets_of_groups(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 8)
    monkeypatch.setattr(divergence, "GROUPS", 7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    rows = many_groups()
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(frame, least_docs=4, top=3) == expected_audit(rows, 4, 3)


def test_audit_ignores_other_columns_and_bears_empty_tables(spark, odd, none):
    rows = [(r["lang"], str(r["source"]), r["text"]) for r in odd.collect()]
    wider = odd.withColumns({c: F.lit("z") for c in ("term", "n", "docs", "at", "block", "value", "part", "item", "rank")})
    assert audited(wider, least_docs=2) == expected_audit(rows, 2)
    assert audit(none).collect() == []


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 2, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0]])
    roots, levels, leaves = divergence.consed_trees(counts, 7)
    assert roots[0] == roots[1] != roots[2]
    # roots, halves, quarters: the last leaf is no term, so the right half differs from the left one
    assert [len(left) for left, _ in levels] == [2, 4, 3] and sorted(leaves) == [-1, 0, 1, 2]


def test_shares_of_huge_counts_are_exact():
    n, whole = 7 * 10**14 + 3, 9 * 10**14 + 11
    assert divergence.shares(np.array([n]), np.array([whole])).tolist() == [1 + 10**9 * (n + 2) // whole]
    assert divergence.shares(np.array([3]), np.array([5])).tolist() == [1 + 10**9]


# -- vector codes -----------------------------------------------------------------


def expected_codes(rows, parts, entries, rounds, scale=256):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    points = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in points[:entries]] for p in range(parts)]

    def assign(v):
        found = []
        for p in range(parts):
            squares = [sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in books[p]]
            found.append((squares.index(min(squares)), min(squares)))
        return found

    for _ in range(rounds):
        given = [assign(v) for v in points]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, g in zip(points, given) if g[p][0] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    given = [assign(v) for v in points]
    errors = [sum(d for _, d in g) for g in given]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    decimals = ",".join(str(x) for own in books for e in own for x in e)
    rows = [(r[0], "".join(f"{e:02x}" for e, _ in g), x, by_label[r[2]]) for r, g, x in zip(kept, given, errors)]
    return sorted(rows, key=str), decimals


def coded(frame, **options):
    found, books = compress(frame, **options)
    return sorted([tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()], key=str), books.decimals()


VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(n, width, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [draw.choice([-1.5, -0.25, 0.0, 0.125, draw.gauss(0, 1)]) for _ in range(width)]
        vector = [float(np.float32(x)) for x in vector]
        if i % 11 == 0:
            vector[draw.randrange(width)] = draw.choice([None, float("nan"), float("inf"), float("-inf")])
        rows.append((draw.choice([i, i, i - 1, None]), None if i % 13 == 0 else vector, draw.choice([0, 0, 1, None])))
    return rows + rows[40:44] * 6


def test_codes_of_embeddings(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.select("vec_id", "embedding", "label").collect()]
    assert coded(frame) == expected_codes(rows, 16, 64, 2)


@pytest.mark.parametrize("width, parts, entries, rounds", [(8, 4, 6, 2), (4, 4, 5, 3), (6, 1, 40, 1), (4, 2, 256, 0)])
def test_codes_of_odd_vectors(spark, monkeypatch, width, parts, entries, rounds):
    monkeypatch.setattr(vector_codes, "BLOCK", 17)
    rows = odd_vectors(120, width)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert coded(frame, parts=parts, entries=entries, rounds=rounds) == expected_codes(rows, parts, entries, rounds)


def test_many_labels_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", -1)
    rows = odd_vectors(60, 4)
    assert coded(spark.createDataFrame(rows, VECTORS), parts=2, entries=8) == expected_codes(rows, 2, 8, 2)


def test_bounds_prune_and_never_lose_the_nearest():
    draw = np.random.default_rng(1)
    points, entries = draw.integers(-400, 400, (500, 4)), draw.integers(-400, 400, (64, 4))
    entries[10] = entries[40] = points[7]
    pivots = vector_codes.pick_pivots(entries[None])[0]
    which, best = vector_codes.nearest(points, entries, vector_codes._distances(points, pivots).astype(np.float32), pivots)
    squares = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert which.tolist() == squares.argmin(axis=1).tolist() and best.tolist() == squares.min(axis=1).tolist()
    assert which[7] == 10 and best[7] == 0


def test_vectors_without_a_code(spark):
    def frame(rows):
        return spark.createDataFrame(rows, VECTORS + ", code string, _row string, _label string")

    none, books = compress(frame([]))
    assert none.collect() == [] and none.columns == ["vec_id", "label", "_row", "_label", "code", "error", "label_error"]
    assert books.decimals() == ""
    assert compress(frame([(1, None, 1, "a", "b", "c")]))[0].collect() == []
    mixed = frame([(1, [1.0, 2.0], None, "a", "b", "c"), (2, [1.0], 1, "a", "b", "c"), (3, [3.0, 2.0], None, "a", "b", "c")])
    found, books = compress(mixed, parts=2, entries=1, rounds=0)
    assert sorted(map(tuple, found.collect())) == [(1, None, "b", "c", "0000", 0, 262144), (3, None, "b", "c", "0000", 262144, 262144)]
    assert books.values("0000") == [1.0, 2.0]
    with pytest.raises(ValueError):
        compress(mixed, parts=3)
    with pytest.raises(Exception, match="too large"):
        compress(frame([(1, [1e30, 0.0], 1, "a", "b", "c")]), parts=2)[0].collect()


# -- benchmark passages -------------------------------------------------------------


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def expected_finds(docs, items, window=10):
    held = {}
    for item, text in items:
        own = words_of(text)
        for i in range(max(len(own) - window + 1, 1) if own else 0):
            held.setdefault(tuple(own[i : i + window]), set()).add("" if item is None else str(item))
    found = []
    for doc_id, text in docs:
        own, hit, ids = words_of(text), set(), set()
        for size in {len(k) for k in held}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in held:
                    hit.update(range(i, i + size))
                    ids |= held[tuple(own[i : i + size])]
        found.append((doc_id, len(own), len(hit), sorted(ids)))
    return sorted(found, key=str)


def finds(docs, items, **options):
    rows = find_benchmark(docs, items, **options).select("doc_id", "n_words", "n_hit", "items").collect()
    return sorted(map(tuple, rows), key=str)


def test_benchmark_in_documents(spark, sf, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = finds(spark.read.parquet(f"{sf}/documents.parquet"), items)
    assert found == expected_finds(texts, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(r[2] for r in found)


@pytest.mark.parametrize("characters", [10**6, 60])
def test_windows_of_every_length_in_one_or_many_automata(spark, monkeypatch, characters):
    monkeypatch.setattr(decontamination, "AUTOMATON_CHARACTERS", characters)
    draw = random.Random(2)
    words = ["a", "b", "AB", "é", "日本", "7", "ab"]

    def text(most):
        return draw.choice([" ", ", ", "\n"]).join(draw.choices(words, k=draw.randint(0, most)))

    items = [(draw.choice([i, i - 1, None]), draw.choice([text(9), text(9), None])) for i in range(12)]
    docs = [(draw.choice([i, i - 1, None]), draw.choice([text(60), text(3), None])) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = finds(frame, spark.createDataFrame(items, "item_id long, text string"), window=4)
    assert got == expected_finds(docs, items, 4)


def test_spans_are_places_in_the_original_text(spark):
    items = spark.createDataFrame([("q", "What IS the 1st é-mail?"), ("r", "two words")], "item_id string, text string")
    text = "🙂 Say: what is -- the\n1ST é, mail... or two\twords; two!"
    got = find_benchmark(spark.createDataFrame([(1, text)], "doc_id long, text string"), items, window=6).first()
    assert [text[s["start"] : s["end"]] for s in got["spans"]] == ["what is -- the\n1ST é, mail", "two\twords"]
    assert got["items"] == ["q", "r"] and got["n_hit"] == 8 and got["n_words"] == 12


def test_odd_documents_and_items(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f"), (None, "one"), (2, None), (3, "?!"), (4, "ß ç")], "item_id long, text string")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    clashing = odd.withColumns({c: F.lit(1) for c in ("items", "n_hit", "_found", "ranges", "phrase")})
    assert finds(clashing, items) == expected_finds(rows, [tuple(r) for r in items.collect()])
    assert set(clashing.columns) <= set(find_benchmark(clashing, items).columns)
    assert [tuple(r) for r in find_benchmark(clashing, items).select("_row", "_found", "phrase").distinct().collect()] == [("7", 1, 1)]
    assert find_benchmark(none, items).collect() == []
    assert all(r[2] == 0 and r[3] == [] for r in finds(odd, items.where("false")))


def test_many_copies_and_long_texts(spark):
    passage = " ".join(f"Q{i}" for i in range(30))
    docs = [(i, f"{'x ' * (40_000 if i == 7 else 3)}{passage} y") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert {(r[2], tuple(r[3])) for r in finds(frame, items)} == {(30, ("5",))}


