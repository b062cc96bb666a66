"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Words carry their space marks in front. The distinct words of a stretch of texts are
sorted, which lays them out as a trie in depth-first order: neighbours
share a prefix, and what the forward pass has found for its positions is kept
from one word to the next. Only the new characters of a word are searched.

Unigram models: the forward score of a position is the best sum of piece scores.
BPE models: their encodings are no best sums, but a position still has one
best last piece: a piece may follow another exactly if the two, written
together, are encoded as those two, and every prefix of an encoding is the
encoding of its own text. So the same forward pass, with a test of
neighbours in place of a sum, gives what merging gives. Merges happen in the
order of their ranks, so the test follows, by rank, the pieces that touch the
boundary from both sides, and asks whether two of them would merge across it.

The model file is read from a path and never copied here.
"""

from __future__ import annotations

import os
import pickle
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, pieces

MARK = "▁"
TOKENIZERS = "/opt/tokenizers"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Distinct words of a stretch of texts; when there are more, a new stretch begins.
STRETCH_BYTES = 4 << 20
#: Pairs of pieces of which a task remembers whether one may follow the other.
PAIRS = 1 << 18


# --- the model file ---------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Vocabulary:
    """What a model file says: pieces with scores and types, and how texts become marked words."""

    pieces: list
    scores: list
    types: list
    kind: int
    dummy_prefix: bool
    squeeze: bool
    byte_fallback: bool

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        v = cls([], [], [], UNIGRAM, True, True, False)
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, x in _fields(value):
                    if n == 1:
                        piece = x.decode()
                    elif n == 2:
                        score = float(np.frombuffer(x, "<f4")[0])
                    elif n == 3:
                        kind = x
                v.pieces.append(piece)
                v.scores.append(score)
                v.types.append(kind)
            elif number == 2:
                for n, x in _fields(value):
                    if n == 3:
                        v.kind = x
                    elif n == 35:
                        v.byte_fallback = bool(x)
            elif number == 3:
                for n, x in _fields(value):
                    if n == 2 and x:
                        raise ValueError("models with a character map for normalisation are not supported")
                    if n == 3:
                        v.dummy_prefix = bool(x)
                    elif n == 4:
                        v.squeeze = bool(x)
        if v.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model kind {v.kind}")
        if any(MARK in p.lstrip(MARK) for p, t in zip(v.pieces, v.types, strict=True) if t == NORMAL):
            raise ValueError("pieces that span words are not supported")
        if any(t == USER for t in v.types):
            raise ValueError("user-defined pieces are not supported")
        return v


class Decoder:
    """The bytes of each piece, one after another."""

    def __init__(self, v: Vocabulary):
        text = []
        for p, t in zip(v.pieces, v.types, strict=True):
            text.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode())
        self.dummy_prefix = v.dummy_prefix
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(x) for x in text], np.int64)
        self.place = np.concatenate(([0], np.cumsum(self.size)))[:-1]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """UTF-8 of each text (bytes that are no UTF-8 stay as they are)."""
        data = ragged(self.blob, self.place, self.size, ids)
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))[begins]
        raw, out = data.tobytes(), []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            t = raw[a:b]
            out.append(t[1:] if self.dummy_prefix and t[:1] == b" " else t)
        return out


class Codec:
    """Encodes by one vocabulary; its decoder decodes."""

    def __init__(self, v: Vocabulary):
        self.v = v
        usable = {p: i for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t == NORMAL}
        self.unknown = v.types.index(UNKNOWN)
        self.bytes = [v.pieces.index(f"<0x{b:02X}>") for b in range(256)] if v.byte_fallback else None
        self.rank = {p: (-v.scores[i], i) for p, i in usable.items()}
        if v.kind == BPE:
            # a piece that merging never makes ends no prefix
            self.halves: dict = {}
            usable = {p: i for p, i in usable.items() if self.merge(p) == [p]}
            by_id = {i: p for p, i in usable.items()}
            self.left = {i: self._spine(p, 0) for i, p in by_id.items()}
            self.right = {i: self._spine(p, 1) for i, p in by_id.items()}
        self.usable = usable
        self.longest = max(map(len, usable), default=1)
        self.low = min(v.scores) - 10.0
        #: Each end of a usable piece: the piece's id, or -1 if it is none itself.
        self.ends = {p[k:]: -1 for p in usable for k in range(len(p))} | usable
        self.follows: dict = {}
        self.decoder = Decoder(v)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best pair first, the leftmost of equals. Remembers the halves of what it makes."""
        parts, none = list(text), (np.inf, 0)
        ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) is not none:
            i = ranks.index(best)
            made = parts[i] + parts[i + 1]
            self.halves.setdefault(made, (parts[i], parts[i + 1]))
            parts[i : i + 2] = [made]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = self.rank.get(made + parts[i + 1], none)
            if i:
                ranks[i - 1] = self.rank.get(parts[i - 1] + made, none)
        return parts

    def _spine(self, piece: str, side: int) -> list[tuple[str, tuple]]:
        """The pieces at one side (0 left, 1 right) while the piece is being merged, each with the rank at which the next one takes its place."""
        out, after = [], (np.inf, 1)
        while True:
            out.append((piece, after))
            if len(piece) == 1:
                return out[::-1]
            after = self.rank[piece]
            piece = self.halves[piece][side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging never crosses the boundary of two pieces, given by id."""
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while True:
            x, next_x = left[i]
            y, next_y = right[j]
            across = self.rank.get(x + y)
            # of equal ranks the leftmost merges first
            if across is not None and across < next_x and across <= next_y:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def _prefix(self, last: str, word: str) -> int:
        same = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            same += 1
        return same

    def encode_bpe(self, words: list[str]):
        """Ids of each word of a sorted list: for each position the one piece that can end there."""
        last = ""
        ids, starts = [-1], [0]  # by position: the last piece's id (-1: a character that is no piece), and where it starts
        ends, follows = self.ends.get, self.follows
        for word in words:
            same = self._prefix(last, word)
            del ids[same + 1 :], starts[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                at, found = end - 1, -1
                while at >= 0:
                    i = ends(word[at:end])
                    if i is None:
                        break
                    if i >= 0:
                        before = ids[at]
                        if not at or before < 0:
                            found = i
                            break
                        pair = before << 20 | i
                        ok = follows.get(pair)
                        if ok is None:
                            if len(follows) >= PAIRS:
                                follows.clear()
                            ok = follows[pair] = self.may_follow(before, i)
                        if ok:
                            found = i
                            break
                    at -= 1
                ids.append(found)
                starts.append(at if found >= 0 else end - 1)
            last = word
            got, end = [], len(word)
            while end:
                if ids[end] >= 0:
                    got.append(ids[end])
                else:
                    self._missing(got, word[end - 1])
                end = starts[end]
            got.reverse()
            yield got

    def _missing(self, got: list[int], char: str) -> None:
        """Ids, last first, of a character that is no piece."""
        if self.bytes:
            got += [self.bytes[b] for b in reversed(char.encode())]
        elif not (got and got[-1] == self.unknown):
            got.append(self.unknown)

    def encode_unigram(self, words: list[str]):
        """Ids of each word of a sorted list: for each position the best sum of scores up to it."""
        last = ""
        path = [(0.0, 0, -1)]  # by position: score, where the last piece starts, its id (-1: a character that is no piece)
        for word in words:
            same = self._prefix(last, word)
            del path[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best, at = (path[end - 1][0] + self.low, end - 1, -1), end - 1
                while at >= 0:
                    i = self.ends.get(word[at:end])
                    if i is None:
                        break
                    if i >= 0 and (score := path[at][0] + self.v.scores[i]) > best[0]:
                        best = (score, at, i)
                    at -= 1
                path.append(best)
            last = word
            got, end = [], len(word)
            while end:
                _, start, i = path[end]
                if i >= 0:
                    got.append(i)
                else:
                    self._missing(got, word[start:end])
                end = start
            got.reverse()
            yield got

    def encode_words(self, words: list[str]):
        """Ids of each word; positions of a prefix that sorted neighbours share are searched once."""
        return self.encode_bpe(words) if self.v.kind == BPE else self.encode_unigram(words)

    def words(self, text: str) -> list[str]:
        """Marked words, which joined give the marked text."""
        if self.v.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if self.v.dummy_prefix and "  " not in text and text[0] != " " and text[-1] != " ":
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        text = (" " if self.v.dummy_prefix else "") + text
        parts, out = text.split(" "), []
        if parts[0]:
            out.append(parts[0])
        marks = 0
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(MARK * marks + p)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (and the end)."""
        known: dict[str, int] = {}
        where, counts = [], []
        for t in texts:
            w = self.words(t)
            counts.append(len(w))
            where += [known.setdefault(x, len(known)) for x in w]
        order = sorted(known)
        at = np.array([known[x] for x in order], np.int64)
        del known
        flat, sizes = array("i"), array("i")
        for ids in self.encode_words(order):
            flat.extend(ids)
            sizes.append(len(ids))
        del order
        # words are numbered as they come, but were encoded in order
        size, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[at] = np.frombuffer(sizes, np.int32) if len(at) else 0
        begin[at] = np.concatenate(([0], np.cumsum(size[at])))[:-1]
        rows = np.array(where, np.int64)
        del where
        return ragged(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), begin, size, rows), np.concatenate(([0], np.cumsum(_sums(size, rows, counts))))


def _sums(size: np.ndarray, rows: np.ndarray, counts: list) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(size[rows])))
    return np.diff(total[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)])


def ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The runs flat[begin[r] : begin[r] + size[r]] for all rows, one after another."""
    n = size[rows]
    total = np.cumsum(n)
    if not len(total) or not total[-1]:
        return flat[:0]
    return flat[np.repeat(begin[rows] - np.concatenate(([0], total[:-1])), n) + np.arange(total[-1])]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def prepared(path: str | None) -> bytes:
    """A codec made ready, to be sent to executors; its size is that of the vocabulary."""
    return pickle.dumps(Codec(Vocabulary.parse(load(path or os.path.join(TOKENIZERS, DEFAULT_MODEL)))), protocol=5)


ENCODED = "ids array<int>"


def regrouped(batches, size: int):
    """The rows of Arrow batches in batches of about so many bytes, or of one given batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encode(sent):
    def run(batches):
        codec = pickle.loads(sent.value)
        for batch in regrouped(batches, STRETCH_BYTES):
            texts = as_bytes(batch.column("text"))
            for first, last in pieces(texts, STRETCH_BYTES):
                ids, begins = codec.encode([t.decode("utf-8", "replace") for t in texts[first:last]])
                texts[first:last] = [b""] * (last - first)
                own = batch.slice(first, last - first)
                at = own.schema.get_field_index("text")
                columns = [c for i, c in enumerate(own.columns) if i != at]
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, lists], [*(n for n in own.schema.names if n != "text"), "ids"])

    return run


def _round_trip(sent):
    def run(batches):
        codec = pickle.loads(sent.value)
        for batch in regrouped(batches, STRETCH_BYTES):
            texts = as_bytes(batch.column("text"))
            for first, last in pieces(texts, STRETCH_BYTES):
                ids, begins = codec.encode([t.decode("utf-8", "replace") for t in texts[first:last]])
                back = codec.decoder.decode(ids, begins)
                restored = [a == b for a, b in zip(texts[first:last], back, strict=True)]
                texts[first:last] = [b""] * (last - first)
                del back
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists, pa.array(np.diff(begins), pa.int32()), pa.array(restored, pa.bool_())], ["doc_id", "ids", "n_ids", "restored"])

    return run


def _decode(sent):
    def run(batches):
        decoder = pickle.loads(sent.value)
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.fill_null([]) if lists.null_count else lists
            sizes = np.diff(lists.offsets.to_numpy())
            for first, last in pieces([range(4 * n) for n in sizes], STRETCH_BYTES // 3) if len(sizes) else ():
                begins = np.concatenate(([0], np.cumsum(sizes[first:last])))
                ids = lists.slice(first, last - first).flatten().to_numpy()
                texts = decoder.decode(ids, begins)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [*own.schema.names, "decoded"])

    return run


def _schema(df: DataFrame, leave: str, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != leave), more])


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """`docs` with its column text replaced by ids, the text's piece ids.

    Nulls are encoded as empty texts: no ids. All other columns, repeated
    rows and null doc_ids pass unchanged; an empty table gives none. A text is encoded whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(prepared(model_path))
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.drop("ids").mapInArrow(_encode(sent), _schema(docs.drop("ids"), "text", ENCODED))


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """`encoded` with a column decoded, the text of ids; null ids give an empty text."""
    decoder = Decoder(Vocabulary.parse(load(model_path or os.path.join(TOKENIZERS, DEFAULT_MODEL))))
    sent = encoded.sparkSession.sparkContext.broadcast(pickle.dumps(decoder, protocol=5))
    plain = encoded.drop("decoded")
    return plain.mapInArrow(_decode(sent), _schema(plain, "", "decoded string"))


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids and restored for each row of `docs` (doc_id, text; other columns are ignored).

    restored: decoding gives the text back (null: empty). A row comes for each input row: repeated and null
    doc_ids stay, equal texts get equal ids, an empty table gives none. A text is encoded whole, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(prepared(model_path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One Python process encodes and decodes: two would hold a stretch of texts each.
    return rows.mapInArrow(_round_trip(sent), f"doc_id long, {ENCODED}, n_ids int, restored boolean")
