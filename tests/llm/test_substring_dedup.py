"""Repeated passages against a brute-force version."""

import random

from gaugework.llm import substring_dedup
from gaugework.llm.substring_dedup import remove_repeats

FIRST_NULL = float("inf")


def expected(rows, window):
    """(n_words, n_removed, kept words) of every row, from all windows of all rows."""
    words = [(text or "").encode().split() for _, text in rows]
    order = [FIRST_NULL if doc_id is None else doc_id for doc_id, _ in rows]
    first = {}
    for at, own in zip(order, words):
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, at), at)
    found = []
    for (doc_id, _), at, own in zip(rows, order, words):
        gone = set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < at:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(own) if i not in gone]
        found.append((doc_id, len(own), len(gone), b" ".join(kept).decode()))
    return sorted(found, key=str)


def results(frame, **options):
    rows = remove_repeats(frame, joined=True, **options).select("doc_id", "n_words", "n_removed", "kept").collect()
    return sorted(map(tuple, rows), key=str)


def test_documents(spark, sf, texts):
    assert results(spark.read.parquet(f"{sf}/documents.parquet")) == expected(texts, 50)


def test_passages_of_every_length_in_many_places(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 3)
    draw = random.Random(11)
    passages = [[f"p{k}n{i}" for i in range(15 + k)] for k in range(12)]
    rows = []
    for i in range(120):
        parts = [[f"d{i}x{j}" for j in range(draw.randint(0, 12))]]
        for _ in range(draw.randint(0, 3)):
            passage = draw.choice(passages)
            parts += [passage[draw.randint(0, 3) :], [draw.choice(["and", "ä", "a b"])] * draw.randint(0, 30)]
        rows.append((draw.choice([i, i, i - 1, None]), " \n".join(w for p in parts for w in p)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert results(frame, window=20) == expected(rows, 20)


def test_joins_without_a_broadcast_give_the_same(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_VALUES", -1)
    assert results(spark.read.parquet(f"{sf}/documents.parquet")) == expected(texts, 50)


def test_one_passage_in_nine_of_ten_documents(spark):
    common = " ".join(f"c{j}" for j in range(23))
    rows = [(300 - i, f"d{i} e{i} {common if i % 10 else 'f'} g{i}") for i in range(200)] + [(None, common)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = results(frame, window=20)
    assert found == expected(rows, 20)
    assert sum(r[2] > 0 for r in found) == 180


def test_blanks_between_kept_words_stay(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"a\n\nb {passage} c"), (2, f"x\ty  {passage}\n\nz\nlast  ")]
    got = {r["doc_id"]: r["kept"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x\ty  z\nlast"}


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert results(odd) == expected(rows, 50)
    assert remove_repeats(none).collect() == []
    assert set(odd.columns) <= set(remove_repeats(odd).columns)
