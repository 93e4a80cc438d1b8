"""SentencePiece codec, packing and shards."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gaugework.llm import packing, queries, sentencepiece_codec, sharding
from gaugework.llm.sentencepiece_codec import PieceModel

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
ODD_TEXTS = ["", " ", "  a", "a  b ", "a \n b", "a\n b", "\n\n x  ", "don't", " a", "a ", " \n", "x \t y", "é　漢字 😀", "x\0y z", "a" * 300]


def test_texts_are_encoded_once(spark, sf, texts):
    found = queries.op1_sentencepiece(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(") == 1, plan
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "")
        assert (rows[doc_id]["ids"], rows[doc_id]["n_tokens"]) == (ids, len(ids)), doc_id
        assert rows[doc_id]["round_trip"] == (library.decode(ids) == text), doc_id


def test_words_are_remembered_in_two_halves(monkeypatch, texts):
    monkeypatch.setattr(sentencepiece_codec, "WORDS", 50)
    model, library = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [t for _, t in texts[:40]]:
        assert np.frombuffer(model.encode(text), np.int32).tolist() == library.encode(text)
        assert len(model) <= 50 and len(model.older) <= 50


def test_a_word_is_searched_once_whatever_it_touches():
    model, library, seen = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), []
    search = model.segment
    model.segment = lambda word: seen.append(word) or search(word)
    text = "Ththreor1 Ththreor2 Ththreor34\nTorent5 Ththreor6"
    assert np.frombuffer(model.encode(text), np.int32).tolist() == library.encode(text)
    assert sorted(seen) == ["\n", *"123456", "Torent", "▁Ththreor"]


def odd_strings():
    draw = random.Random(8)
    marks = ["a", "the", "zqxj", " ", "  ", "▁", "\n", "\t", "\0", ",", "1", "é", "漢", "😀", "\u0600", "\x7f", "\x80", "\u2581x"]
    return ["".join(draw.choices(marks, k=draw.randint(0, 12))) for _ in range(600)]


@pytest.mark.parametrize("size", [1, 25, 1 << 22])
def test_texts_in_slices_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(sentencepiece_codec, "BYTES", size)
    model, library = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [None, *ODD_TEXTS, None, *odd_strings(), "", None]
    for array in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string())[1:], pa.array([], pa.string())):
        ids, decoded = [], []
        for part in sentencepiece_codec._text_slices(array):
            found, bounds = model.encode_all(part)
            ids += [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            decoded += model.decode_all(found, bounds).to_pylist()
        assert ids == [library.encode(x or "") for x in array.to_pylist()]
        assert decoded == [(x or "").replace("▁", " ") for x in array.to_pylist()]


def test_decoding_of_any_ids(spark):
    """Bytes that are no UTF-8, control and unknown pieces, gaps, ids out of range."""
    model, draw = PieceModel(PIECES), random.Random(9)
    kinds = [0, 1, 2, -1, 10**6, None, *model.bytes.values(), *[model.pieces[x][1] for x in ("▁", "▁the", "a")]]
    rows = [None, [], *[[draw.choice(kinds) for _ in range(draw.randint(0, 6))] for _ in range(400)]]
    parts = model.decoded.to_pylist()

    def slow(ids):
        text = b"".join(parts[i] for i in ids or [] if i is not None and 0 <= i < len(parts)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    frame = spark.createDataFrame(list(enumerate(rows)), "k int, ids array<int>")
    found = {r["k"]: r["text"] for r in sentencepiece_codec.decode(frame, PIECES).collect()}
    assert found == {k: slow(ids) for k, ids in enumerate(rows)}


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The library's own best-score search over the same pieces: the model file with its type set to unigram."""

    def varint(at):
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    raw = bytearray(open(PIECES, "rb").read())
    at = 0
    while at < len(raw):  # top-level fields; 2 holds the trainer's settings, whose field 3 is the type
        key, at = varint(at)
        size, at = varint(at)
        if key >> 3 == 2:
            inside = at
            while inside < at + size:
                key, begin = varint(inside)
                value, inside = varint(begin)
                if key & 7 == 2:
                    inside += value
                elif key & 7 == 5:
                    inside = begin + 4
                elif key >> 3 == 3:
                    raw[begin] = 1
        at += size
    path = os.path.join(tmp_path_factory.mktemp("pieces"), "unigram.model")
    with open(path, "wb") as out:
        out.write(raw)
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_are_the_library_s(texts):
    model, library = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sentencepiece_codec.model_kind(PIECES) == sentencepiece_codec.BPE
    for text in [t for _, t in texts] + ODD_TEXTS + ["   lots    of      blanks", "aaaa b▁c ▁▁ d", "def f(x):\n    return  x\n\n"]:
        assert np.frombuffer(model.encode(text), np.int32).tolist() == library.encode(text), text


def test_unigram_search_is_as_good_as_the_library_s(unigram, texts):
    """The library adds in single precision, so texts with a very bad piece are left out."""
    path, library = unigram
    model, compared = PieceModel(path), 0
    assert sentencepiece_codec.model_kind(path) == sentencepiece_codec.UNIGRAM
    for text in (t[:120].replace("\n", " ") for _, t in texts):
        ids = np.frombuffer(model.encode(text), np.int32).tolist()
        first, second = library.nbest_encode_as_ids(text, 2)
        best, next_best, own = (sum(library.get_score(i) for i in x) for x in (first, second, ids))
        if not any(library.is_byte(i) for i in first) and best > -1e8:
            compared += 1
            assert own == best and (ids == first or best == next_best), text
    assert compared > 100


def test_best_score_by_brute_force(unigram):
    model = PieceModel(unigram[0])

    def best(text):
        if not text:
            return 0.0
        rest = [model.pieces[text[:n]][0] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in model.pieces]
        return max(rest + ([model.cost + best(text[1:])] if text[0] not in model.pieces else []))

    spelled = set(model.bytes.values())
    for text in ("▁hello", "▁a\u0600\u0601b", "▁unthinkable", "▁\u0600x"):
        ids = model.segment(text)
        unknown = [c for c in text if c not in model.pieces]
        assert sum(model.scores[i] for i in ids if i not in spelled) + model.cost * len(unknown) == best(text)
        assert sum(i in spelled for i in ids) == sum(len(c.encode()) for c in unknown)


def test_sentencepiece_round_trip(spark, sf, odd, none):
    rows = queries.op1_sentencepiece(spark, sf).collect()
    assert rows and all(r["round_trip"] for r in rows)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(frame, PIECES), PIECES, into="back").collect()
    assert all(r["back"] == r["text"] for r in back)
    found = sentencepiece_codec.encode(odd, PIECES)
    assert all((r["ids"] == []) == (not r["text"]) for r in found.collect()) and found.columns == odd.columns
    assert sentencepiece_codec.encode(none, PIECES).collect() == []
    ids = spark.createDataFrame([(None,), ([],), ([-1, 10**6, None, 200],)], "ids array<int>")
    assert sentencepiece_codec.decode(ids, PIECES).count() == 3


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for held in {*bins}:
            if held + items[i] <= capacity:
                at = bins.index(held)
                place(i + 1, [*bins[:at], held + items[i], *bins[at + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_dominance_keeps_the_optimum_and_the_plan_is_whole():
    draw, more = random.Random(3), 0
    for _ in range(300):
        capacity = draw.choice([10, 17, 30])
        items = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 10))), reverse=True)
        left = Counter(items)
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = sorted(left.elements(), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        made = packing.plan(Counter(items), capacity)
        assert all(sum(lengths) <= capacity for lengths, _ in made)
        assert Counter(n for lengths, times in made for n in lengths * times) == Counter(items)
        more += sum(n for _, n in made) - fewest(items, capacity)
    assert more <= 3


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_packing_of_documents(spark, sf, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    rows = queries.op3_best_fit_packing(spark, sf).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 1024) <= -(-total // 1024) * 1.02 + 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert len(by_doc) == len(texts)
    for doc_id, text in texts:
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own, at = sorted(by_doc[doc_id], key=lambda r: r["piece"]), 0
        for i, r in enumerate(own):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or i == 0
            at += r["length"]
        assert at == len(ids)


def test_ranks_give_the_tokenizer_s_ids():
    with_ranks, exact = packing.TokenIds(BPE, RANKS), packing.TokenIds(BPE)
    for text in [*ODD_TEXTS, "a <|endoftext|> b", "x  y\u2003 z", "\u3000 \u3000"]:
        whole = np.array(exact.exact(text), "<u4").tobytes()
        assert with_ranks.of(text) == whole and exact.of(text) == whole, text


def test_packing_hot_lengths_ties_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 20)
    rows = [(i % 50, 7 if i % 3 else 1 + i % 10) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, length long")
    packed = packing.pack(frame, 10).collect()
    assert sorted((r["doc_id"], r["length"]) for r in packed) == sorted(rows)
    check_packing(packed, 10)
    pieces = packing.token_pieces(odd, BPE, RANKS, capacity=64)
    sized = packing.written(pieces.withColumn("length", (F.octet_length("ids") / 4).cast("long")).drop("ids"))
    packed = packing.pack(sized, 64).collect()
    check_packing(packed, 64)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    assert packing.pack(sized.limit(0), 64).collect() == []
    assert packing.token_pieces(none, BPE).collect() == []


def test_shards(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 13)
    rows = sorted(queries.op5_sharding(spark, sf).collect(), key=lambda r: r["doc_id"])
    sizes = {d: len(t.encode()) + 1 for d, t in texts}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert all(r["text_crc32"] == zlib.crc32(t.encode()) for r, (_, t) in zip(rows, sorted(texts)))
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)  # contiguous
    held = Counter()
    for r in rows:
        assert r["slot"] == sum(1 for x in rows if x["shard"] == r["shard"] and x["doc_id"] < r["doc_id"])
        held[r["shard"]] += r["size"]
    assert max(held.values()) - min(held.values()) <= 2 * max(sizes.values()) and len(held) == 8


def test_shards_of_odd_rows(odd, none, spark):
    sized = odd.withColumn("size", F.octet_length("text"))
    rows = sharding.shard_by_bytes(sized, 3).collect()
    assert len(rows) == odd.count()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(none.withColumn("size", F.lit(1)), 3).collect() == []
    even = sharding.shard_by_bytes(spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, size long"), 3).collect()
    assert Counter(r["shard"] for r in even) == {0: 3, 1: 3, 2: 3}
    one = sharding.shard_by_bytes(spark.createDataFrame([(1, -5)], "doc_id long, size long")).collect()
    assert one[0]["slot"] == 0
