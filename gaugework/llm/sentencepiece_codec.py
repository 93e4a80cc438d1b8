"""SentencePiece encoding and decoding by a Viterbi search over an Aho-Corasick automaton.

The automaton holds the model's pieces.  Reading a text once, it reports at each position all pieces that end there, longest
first (its output links), and each of them relaxes the best way to reach the position:

* A unigram model's way is the one with the highest sum of scores; ties keep the longer last piece.
* A BPE model's pieces are merged by rank, and its ids are those pieces of which no two neighbours would merge otherwise.
  So a piece may follow the best way to its beginning only if merging the two pieces' text gives just these two; all other
  steps score minus infinity.  One way is left at each position, and it is what merging gives.

Characters without a piece cost the lowest score less ``UNKNOWN``, merge with nothing, and become their bytes' pieces.

Two neighbouring bytes that stand together in no piece can be parted: no piece covers both, and no merge joins them.  So a
text's ids are those of its words one after another, where a word goes on as long as its neighbours may share a piece (blanks
are cut from what is before them, digits and marks from letters, as far as the model's pieces allow).  The words of many texts
are found, told apart and looked up as Arrow arrays; each distinct word that a worker does not remember is searched once.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a blank
UNKNOWN = 10.0
UNIGRAM, BPE = 1, 2
WORDS = 200_000  # words whose ids a worker remembers, and as many that it used before these
PAIRS = 500_000  # pairs of pieces of which a worker remembers whether they may be neighbours
BYTES = 1 << 22  # bytes of texts (or as many ids) whose words are told apart at a time; a longer row is taken alone


def model_kind(path: str) -> int:
    """The model type that a file's trainer settings name (field 3 of the file's field 2); unigram if none is named."""
    with open(path, "rb") as file:
        raw = file.read()

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            key, at = number(at)
            kind, begin = key & 7, at
            size = {1: 8, 5: 4}.get(kind, 0)
            value = None
            if kind in (0, 2):
                value, at = number(at)
                begin, size = at, value if kind == 2 else 0
            at += size
            yield key >> 3, value, begin, at

    for name, _, begin, end in fields(0, len(raw)):
        if name == 2:
            return next((value for inner, value, _, _ in fields(begin, end) if inner == 3), UNIGRAM)
    return UNIGRAM


class PieceModel(dict):
    """Ids of words by the pieces of a model file, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.texts: dict[int, str] = {}
        self.scores: dict[int, float] = {}
        self.ranks: dict[int, float] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.follows: list[dict[int, bool]] = []  # of each piece: the pieces that it may follow, as far as looked up
        self.pairs = 0
        self.bytes: dict[int, int] = {}
        self.unknown, lowest, decoded = model.unk_id(), 0.0, []
        # whether a byte goes on with the next in some piece or in a character, by 256 * byte + next
        together = np.zeros((256, 256), bool)
        together[:, 0x80:0xC0] = True
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            decoded.append(b"" if model.is_control(i) else piece.replace(MARK, " ").encode())
            if model.is_unknown(i):
                decoded[i] = b" \xe2\x81\x87 "
            elif model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                decoded[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unused(i):
                score = model.get_score(i)
                lowest = min(lowest, score)
                self.follows.append({})
                self.automaton.add_word(piece, (len(piece), i, self.follows[-1]))
                self.pieces[piece] = (score, i)
                self.texts[i], self.scores[i] = piece, score
                self.ranks[i] = -score if len(piece) > 1 else -1.0  # a character is merged from nothing
                if len(piece) == 1:
                    self.single.add(piece)
                raw = np.frombuffer(decoded[i], np.uint8)
                together[raw[:-1], raw[1:]] = True
        self.automaton.make_automaton()
        self.cost = lowest - UNKNOWN
        self.merging = model_kind(path) == BPE
        self.decoded, self.together = pa.array(decoded, pa.large_binary()), together.ravel()

    def merged(self, text: str, last: bool = False) -> list[str]:
        """Symbols of a short text after all merges (or all but the last), best score first and leftmost among equals."""
        symbols = list(text)
        while not (last and len(symbols) == 2):
            ranks = [self.pieces.get(a + b, (float("-inf"),))[0] for a, b in zip(symbols, symbols[1:])]
            best = max(ranks, default=float("-inf"))
            if best == float("-inf"):
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def halves(self, piece: int) -> tuple[int, int]:
        """The two pieces that a piece is merged from in the end."""
        known = self.split.get(piece)
        if known is None:
            text = self.texts[piece]
            left, right = self.merged(text, last=True)
            known = self.split[piece] = self.pieces[left][1], self.pieces[right][1]
        return known

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether merging the text of two pieces gives these two.

        Merges are undone from the last one on, of the piece whose merge came later (of equal ones the right one's).  If the
        pieces that then face each other would have merged across before that, the two would not have come about.
        """
        ranks, texts, pieces = self.ranks, self.texts, self.pieces
        limit = float("inf")
        while True:
            across = pieces.get(texts[before] + texts[piece])
            if across is not None and -across[0] < limit:
                return False
            left, right = ranks[before], ranks[piece]
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, before = left, self.halves(before)[1]
            else:
                limit, piece = right + 0.5, self.halves(piece)[0]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text with marks; back[i] is the last piece of the best way to i."""
        back = (self.by_merges if self.merging else self.by_scores)(text)
        ids, at = [], len(text)
        while at:
            length, piece = back[at][:2]
            ids += [piece] if piece >= 0 else self.spelled(text[at - 1])
            at -= length
        return ids[::-1]

    def by_scores(self, text: str) -> list[tuple[int, int]]:
        best, back = [0.0] + [float("-inf")] * len(text), [(0, 0)] * (len(text) + 1)
        done = 0

        def lone(upto: int) -> None:
            for i in range(done, upto):
                if text[i] not in self.single and best[i] + self.cost > best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + self.cost, (1, -1)

        for end, (length, piece, _) in self.automaton.iter(text):
            if end > done:
                lone(end)
                done = end
            found = best[end + 1 - length] + self.scores[piece]
            if found > best[end + 1]:
                best[end + 1], back[end + 1] = found, (length, piece)
        lone(len(text))
        return back

    def by_merges(self, text: str) -> list[tuple]:
        """As by_scores, with steps that score 0 or minus infinity: a position without a way has no entry."""
        if self.pairs > PAIRS:
            self.pairs = 0
            for known in self.follows:
                known.clear()
        back: list[tuple | None] = [(0, -1)] + [None] * len(text)
        if not self.single.issuperset(text):
            for i, c in enumerate(text):
                if c not in self.single:
                    back[i + 1] = (1, -1)
        for end, match in self.automaton.iter(text):
            end += 1
            if back[end] is None:
                length, piece, follows = match
                way = back[end - length]
                if way is not None:
                    before = way[1]
                    known = follows.get(before)
                    if known is None:
                        known = follows[before] = self.may_follow(before, piece) if before >= 0 else self.whole(piece)
                        self.pairs += 1
                    if known:
                        back[end] = match
        return back

    def whole(self, piece: int) -> bool:
        """Whether merging a piece's text gives the piece."""
        return self.merged(self.texts[piece]) == [self.texts[piece]]

    def spelled(self, character: str) -> list[int]:
        """Ids of a character's bytes, last first."""
        raw = character.encode()
        return [self.bytes[b] for b in reversed(raw)] if len(self.bytes) == 256 else [self.unknown]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = array("i", self.segment(word)).tobytes()
        self[word] = found
        return found

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of texts that begin with a blank or are empty, and where each text's begin among them."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        size, begins = int(offsets[-1]), np.zeros(offsets[-1] + 1, bool)
        if data is not None:
            raw = np.frombuffer(data, np.uint8, size)
            begins[1:size] = ~self.together[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        begins[: offsets[0]] = False
        begins[offsets] = True
        begins[size] = False
        starts = np.flatnonzero(begins).astype(np.int32)
        ends = pa.py_buffer(np.append(starts, np.int32(size)))
        return pa.StringArray.from_buffers(len(starts), ends, data), np.searchsorted(starts, offsets)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and where each text's begin; null and empty texts have none."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        words, bounds = self.words(pc.binary_join_element_wise(lead, texts, ""))
        told = words.dictionary_encode()
        distinct = pc.replace_substring(told.dictionary, " ", MARK).to_pylist()
        found = pa.array([self[word] for word in distinct], pa.large_binary()).take(told.indices)
        offsets, raw = _parts(found)
        return raw.view(np.int32), (offsets // 4)[bounds]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of ids that stand one after another; bytes that are no UTF-8 become the replacement character, ids out
        of range are skipped."""
        known = (ids >= 0) & (ids < len(self.decoded))
        if not known.all():
            bounds = np.append(0, np.cumsum(known))[bounds]
            ids = ids[known]
        offsets, raw = _parts(self.decoded.take(pa.array(ids)))
        offsets = offsets[bounds]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        blank = first[raw[first] == ord(" ")]  # the one that encoding put before the text
        raw, offsets = np.delete(raw, blank), offsets - np.searchsorted(blank, offsets)
        try:
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
            return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            whole, at = raw.tobytes(), offsets.tolist()
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())


def _parts(values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, and the bytes of all."""
    _, offsets, raw = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def _loaded(path: str) -> PieceModel:
    """The model of a worker process, with the words it has met: functions that travel to the executors have globals of
    their own in each task, so it is kept beside the modules."""
    held = sys.modules.setdefault("_piece_models", SimpleNamespace(models={})).models
    key = (path, os.path.getmtime(path))
    if key not in held:
        held.clear()
        held[key] = PieceModel(path)
    return held[key]


def _slices(rows: pa.Array, sizes: np.ndarray) -> Iterator[pa.Array]:
    """The rows in parts of about BYTES, by the size of each."""
    borders = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BYTES)) + 1
    for low, high in zip([0, *borders.tolist()], [*borders.tolist(), len(rows)]):
        yield rows.slice(low, high - low)


def _text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    return _slices(texts, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column.  Null and empty texts have no ids.  All rows and columns stay; a column
    of that name is replaced.  A literal blank mark is read as a blank, as the format has it."""

    def run(texts: pa.Array) -> pa.Array:
        known = _loaded(model)
        return pa.concat_arrays([_lists(*known.encode_all(part)) for part in _text_slices(texts)])

    return docs.withColumn(into, F.arrow_udf(run, "array<int>")(text))


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of an array of ids; null and empty arrays give the empty text, null ids are skipped."""

    def run(lists: pa.Array) -> pa.Array:
        known, sizes = _loaded(model), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        done = []
        for part in _slices(lists, sizes):
            bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)))
            flat = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False)
            done.append(known.decode_all(flat, bounds))
        return pa.concat_arrays(done)

    return rows.withColumn(into, F.arrow_udf(run, "string")(ids))


def round_trip(docs: DataFrame, model: str, text: str = "text", into: str = "coded") -> DataFrame:
    """``docs`` with a struct of ids, as encode gives them, and decoded, the text that decode makes of these ids.

    Both in one step: a decoder that follows the encoder in the same plan would call it once more.
    """

    def run(texts: pa.Array) -> pa.Array:
        known, lists, decoded = _loaded(model), [], []
        for part in _text_slices(texts):
            found = known.encode_all(part)
            lists.append(_lists(*found))
            decoded.append(known.decode_all(*found))
        return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.concat_arrays(decoded)], names=["ids", "decoded"])

    return docs.withColumn(into, F.arrow_udf(run, "ids array<int>, decoded string")(text))
