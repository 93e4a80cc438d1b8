"""N-gram Jaccard join, components and fingerprints against brute force."""

import random

import numpy as np
import pytest

from gaugework.llm.common import WordHasher
from gaugework.llm.components import components
from gaugework.llm.fingerprints import (
    containment, distinct, edited_fingerprints, fingerprints, from_text, merge, merged_fingerprints, resemblance, sketch, to_text,
)
from gaugework.llm.ngram_join import JaccardJoin, jaccard_join


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected(rows, spec):
    """(doc_id, size, component, links) of every row, by comparing all pairs."""
    sets = [shingle_set(text, spec.words) for _, text in rows]
    near = [
        [j for j, b in enumerate(sets) if j != i and a and b and spec.den * len(a & b) >= spec.num * len(a | b)]
        for i, a in enumerate(sets)
    ]
    found = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = set(near[todo.pop()]) - seen
            seen |= fresh
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        found.append((doc_id, len(sets[i]), min(ids) if ids else None, len(near[i])))
    return sorted(found, key=str)


def test_join_of_documents(spark, sf, texts):
    spec = JaccardJoin(words=4, num=85, den=100)
    got = jaccard_join(spark.read.parquet(f"{sf}/documents.parquet"), spec)
    assert sorted(map(tuple, got.collect()), key=str) == expected(texts, spec)


@pytest.mark.parametrize("spec", [JaccardJoin(), JaccardJoin(words=2, num=1, den=2, group_tokens=40, common=0.05, flush=100)])
def test_join_finds_chains_hubs_and_hot_tokens(spark, spec):
    """Edited copies of a few texts around the bound, a passage that most rows share, and groups of one row's tokens."""
    draw = random.Random(5)
    bases = [[f"b{k}w{i}" for i in range(40)] for k in range(4)]
    rows = []
    for i in range(160):
        words = list(bases[i % 4]) if i % 3 else [f"own{i}w{j}" for j in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 4)):
            if words:
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 9)}"
        rows.append((i, " ".join(words + ["every", "row", "has", "this", "same", "tail"] * (i % 5 > 0))))
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spec)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, spec)


def test_join_of_odd_rows(odd, none):
    spec = JaccardJoin()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_join(odd, spec).collect()), key=str) == expected(rows, spec)
    assert jaccard_join(none, spec).collect() == []


def test_components_of_a_chain_a_star_and_nulls(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1050)]
    edges = spark.createDataFrame([*chain, *star, (3, 3), (None, 5), (4, None)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {3: 3} | {i: 100 for i in range(100, 141)} | {i: 7 for i in (7, *range(1000, 1050))}
    assert components(edges.limit(0)).collect() == []


def test_sketches_estimate_and_merge():
    known = WordHasher()
    a, b = (" ".join(f"w{i}" for i in range(low, low + 3000)).encode() for low in (0, 1000))
    x, y = sketch(a, known), sketch(b, known)
    assert abs(resemblance(x, y) - 1992 / 4000) < 0.12
    assert abs(containment(x, y) - 1996 / 2996) < 0.15
    assert abs(distinct(x) / 2996 - 1) < 0.2
    whole = sketch(a + b" " + b, known)
    assert len(np.setdiff1d(whole, merge(x, y))) <= 1  # the shingles across the seam
    assert (from_text(to_text(x)) == x).all()
    assert distinct(sketch(b"a b c", known)) == 1 and distinct(sketch(b"", known)) == 0
    assert resemblance(x[:0], x[:0]) == 1 and resemblance(x[:0], x) == 0


def test_edited_fingerprints(spark, sf, texts):
    got = {r["doc_id"]: r for r in edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(order)
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        row = got[doc_id]
        assert row["edited"] == edited and row["n_chars"] == len(text)
        for other, name in ((edited, "near_edited"), (following, "near_next")):
            a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (text.encode().split(), other.encode().split()))
            true, size = len(a & b) / len(a | b), len(a | b)
            assert abs(row[name] - true) <= (1e-9 if size <= 256 else 0.16)


def test_next_document_across_ranges(spark, monkeypatch):
    from gaugework.llm import fingerprints as module

    monkeypatch.setattr(module, "ROWS", 7)
    rows = [(i * 3, f"text number {i} é" * (i % 4)) for i in range(100)]
    got = {r["doc_id"]: r["edited"] for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = rows[::-1]
    assert got == {
        d: t[: len(t) - len(t) // 3] + f[: len(t) // 3] for (d, t), (_, f) in zip(order, order[1:] + order[:1])
    }


def test_fingerprints_of_odd_rows(odd, none):
    assert len(edited_fingerprints(odd).collect()) == odd.count()
    assert edited_fingerprints(none).collect() == [] and fingerprints(none).collect() == []
    rows = fingerprints(odd).collect()
    assert {r["fingerprint"] for r in rows if not (r["text"] or "").split()} == {""}
    parts = merged_fingerprints(fingerprints(odd), "doc_id").collect()
    assert {r["doc_id"] for r in parts} == {r["doc_id"] for r in rows}
