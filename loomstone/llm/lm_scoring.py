"""Language-model scores by prediction by partial matching (PPM) over bytes.

A trie of byte contexts up to `ORDER` bytes long is counted over the training
texts. A symbol is predicted by the longest context that is in the trie; where it has
not followed that context, an escape leads to the context one byte shorter,
at which the symbols of the longer context are excluded, and so on down to a uniform
choice. Escapes are estimated by method D: each distinct symbol of a context gives
DISCOUNT of its count to the escape. Texts begin after ORDER pad symbols and end in an end
symbol, so that the probabilities of all texts sum to one.

The trie keeps every gram of the training texts. It is never in one place: its
orders above LOCAL lie in BUCKETS by the last bytes of the context, which all the
contexts that a symbol can escape to share, so each bucket has all counts that its
symbols need. Orders up to LOCAL are bounded by the alphabet and are broadcast. Texts
go in chunks of about CHUNK bytes. A chunk asks each bucket once for each of its
distinct grams and words; a bucket's rows are streamed twice, first to sum them to its part of the
trie, then to answer each chunk from it, so a task holds one bucket's distinct grams or one chunk.

The adaptive mode learns from nothing but the text's own past.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import WordHasher, as_bytes, cut, joined, mix, pieces, scratch, small_batches

ORDER = 5
BITS = 9  # of a symbol: 256 bytes, END and PAD
END, PAD = 256, 257
SYMBOLS = 257  # that can be predicted
DISCOUNT = 0.5
#: Bytes of context up to which counts are broadcast, and one less than those that name a bucket.
LOCAL = 2
#: Parts of the grams, and as many more of the words.
BUCKETS = 1024
#: Bytes of text that ask together.
CHUNK = 1 << 24
#: Rows of packed arrays to an Arrow batch.
PACKED = 256


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """One key for each byte and end of the texts: the symbol in the lowest BITS bits, the bytes before it above; and where each text begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + order + 1)))
    symbols = np.full(begins[-1] + order, PAD, np.uint64)
    body = np.frombuffer(b"".join(texts), np.uint8)
    place = np.repeat(begins[:-1] + order - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(body))
    symbols[place] = body
    symbols[begins[1:] - 1] = END
    key = symbols[order : begins[-1]].copy()
    for back in range(1, order + 1):
        key |= symbols[order - back : begins[-1] - back] << np.uint64(BITS * back)
    key = key[(key & np.uint64((1 << BITS) - 1)) != PAD]
    return key, np.concatenate(([0], np.cumsum(lengths + 1)))


class Counter:
    """Sums of counts by key, kept sorted; merged whenever much has come."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.size, self.held = most, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Counts each key once, or distinct keys as often as given."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most:
            self.held = [self.total()]
            self.size = len(self.held[0][0])
            self.most = max(self.most, 2 * self.size)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.held])
        counts = np.concatenate([c for _, c in self.held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n by the grams of `order` bytes of context in which keys end."""
    found, at = np.unique(keys & np.uint64((1 << (BITS * (order + 1))) - 1), return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    context = (keys >> np.uint64(BITS)) & np.uint64((1 << (BITS * (LOCAL + 1))) - 1)
    return (mix(context) % np.uint64(BUCKETS)).astype(np.int64)


def word_bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Compressed: first bytes of all values, then second ones, and so on."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def from_planes(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def pack(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(data, dtype), dtype=dtype)


ASKED, TEXTS_READ, TEXTS = range(3)
COUNTED = "kind int, chunk long, bucket int, n long, keys binary, counts binary, texts binary"
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def _filled(schema: str, size: int, **columns):
    """A batch with nulls in the columns that are not given."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(size, TYPES[t]) if columns.get(c) is None else pa.array(columns[c], TYPES[t]) for c, t in fields], [c for c, _ in fields])


def by_bucket(keys: np.ndarray, buckets) -> tuple[np.ndarray, np.ndarray]:
    """The order in which sorted keys lie by bucket, and where each bucket begins in it (and the end)."""
    bucket = buckets(keys)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


class Chunk:
    """Texts that ask together: their rows, and their grams and words in training and in held-out rows."""

    def __init__(self, number: int):
        self.number, self.size, self.rows = number, 0, []
        self.grams, self.words = [(Counter(), Counter()) for _ in range(2)]

    def count(self, texts: list[bytes], held: int, hasher: WordHasher) -> None:
        for a, b in pieces(texts):
            self.grams[held].add(grams(texts[a:b])[0])
            self.words[held].add(hasher.hashes(joined(texts[a:b])[0])[0])

    def add(self, batch: pa.RecordBatch, texts: list[bytes], held: np.ndarray, hasher: WordHasher) -> None:
        for wanted in (0, 1):
            self.count([t for t, x in zip(texts, held, strict=True) if x == wanted], wanted, hasher)
        codec = pa.Codec("zstd", compression_level=6)
        for a, b in pieces(texts, 1 << 21):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
                out.write_batch(batch.slice(a, b - a))
            self.rows.append(sink.getvalue().to_pybytes())

    def keys(self):
        """Distinct grams and then words of all rows, sorted, with their counts in training rows."""
        for train, held in (self.grams, self.words):
            own, n = train.total()
            keys = np.union1d(own, held.total()[0])
            counts = np.zeros(len(keys), np.int64)
            counts[np.searchsorted(keys, own)] = n
            yield keys, counts

    def asked(self):
        """Its rows, and its distinct grams and words by bucket."""
        for first in range(0, len(self.rows), 4):
            part = self.rows[first : first + 4]
            yield _filled(COUNTED, len(part), kind=[TEXTS] * len(part), chunk=[self.number] * len(part), texts=part)
        for (keys, counts), buckets, offset in zip(self.keys(), (bucket_of, word_bucket), (0, BUCKETS), strict=True):
            order, edges = by_bucket(keys, buckets)
            keys, counts = keys[order], counts[order]
            for first in range(0, BUCKETS, PACKED):
                full = [b for b in range(first, first + PACKED) if edges[b] < edges[b + 1]]
                parts = [slice(edges[b], edges[b + 1]) for b in full]
                yield _filled(COUNTED, len(full), kind=[ASKED] * len(full), chunk=[self.number] * len(full), bucket=[b + offset for b in full], keys=[pack(keys[x]) for x in parts], counts=[pack(counts[x]) for x in parts])

    def tables(self, answers: pa.Table) -> tuple[Table, Table]:
        """Log probabilities of its grams and counts of its words, from what all buckets answer: in the order asked."""
        found = dict(zip(answers.column("bucket").to_pylist(), answers.column("found").to_pylist(), strict=True))
        out = []
        for (keys, _), buckets, offset, kind in zip(self.keys(), (bucket_of, word_bucket), (0, BUCKETS), (np.float32, np.int64), strict=True):
            order, edges = by_bucket(keys, buckets)
            got = [from_planes(found[b + offset], kind) for b in range(BUCKETS) if edges[b] < edges[b + 1]]
            out.append(Table(keys[order], np.concatenate([np.zeros(0, kind), *got])))
        return out[0], out[1]


def _count(batches):
    """What each chunk of a task's texts asks, its rows, and how many training rows the task reads."""
    hasher, texts = WordHasher(), 0
    chunk = Chunk(TaskContext.get().partitionId() << 32)
    for batch in batches:
        own, held = as_bytes(batch.column("text")), np.array(batch.column("held_out").to_pylist(), bool)
        texts += int((~held).sum())
        first = 0
        while first < len(own):
            last = first
            while last < len(own) and chunk.size < CHUNK:
                chunk.size += len(own[last]) + 1
                last += 1
            chunk.add(batch.slice(first, last - first), own[first:last], held[first:last], hasher)
            first = last
            if chunk.size >= CHUNK:
                yield from chunk.asked()
                chunk = Chunk(chunk.number + 1)
    if chunk.size:
        yield from chunk.asked()
    yield _filled(COUNTED, 1, kind=[TEXTS_READ], n=[texts])


SUMMED = "bucket int, keys binary, counts binary, n long, distinct long"
SHORT = "key long, n long"


def _sum(batches):
    """For each bucket of a task, whose rows come together, its keys that training rows have, and their counts."""

    def whole():
        keys, n = counter.total()
        own, n = keys[n > 0], n[n > 0]
        return _filled(SUMMED, 1, bucket=[bucket], keys=[pack(own)], counts=[pack(n)], n=[int(n.sum())], distinct=[len(own)])

    bucket, counter = None, Counter()
    for batch in batches:
        for b, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
            if b != bucket:
                if bucket is not None:
                    yield whole()
                bucket, counter = b, Counter()
            counter.add(unpack(k, np.uint64), unpack(n, np.int64))
    if bucket is not None:
        yield whole()


def _short(batches):
    """Counts of the grams of order LOCAL."""
    counter = Counter()
    for batch in batches:
        for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counter.add(*summed(unpack(k, np.uint64), unpack(n, np.int64), LOCAL))
    keys, n = counter.total()
    for at in range(0, len(keys), 1 << 17):
        yield _filled(SHORT, len(keys[at : at + (1 << 17)]), key=keys[at : at + (1 << 17)].view(np.int64), n=n[at : at + (1 << 17)])


class Table:
    """Values by 64-bit key, in hash order with an index of buckets."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        hashed = mix(keys)
        order = np.argsort(hashed, kind="stable")
        self.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.values = [np.append(v[order], v[:1] if len(v) else v.dtype.type(0)) for v in values]
        bucket = (hashed[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(bucket, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        bucket = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.where((at < end) & (self.keys[at] == keys), at, -1)
        open_ = np.flatnonzero((out < 0) & (at + 1 < end))
        step = 1
        while len(open_):
            here = at[open_] + step
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = here[hit]
            step += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


class Model:
    """A trie, or those parts of it that some symbols need, as tables; entries[k] and contexts[k] for contexts of k bytes."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], totals: list[dict] | None = None, below: Model | None = None):
        """counts: for each order, keys of (context, symbol) and their counts, all of them or some (then totals holds (keys, counts) of contexts). Those of `below` are taken over."""
        per, q, self.entries, self.contexts = (list(x) for x in ((below.per, below.q, below.entries, below.contexts) if below else ((), (), (), ())))
        shift, start = np.uint64(BITS), len(per)
        self.order = start + len(counts) - 1
        for k, (keys, n) in enumerate(counts, start):
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order].astype(np.float64) - DISCOUNT
            context = keys >> shift
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            kept = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(keys))).astype(float)
            given = DISCOUNT * distinct
            names = context[first]
            lost = np.zeros(len(first))
            if totals is not None and len(first):
                tk, tn = totals[k]
                o = np.argsort(tk)
                at = o[np.searchsorted(tk[o], names)]
                lost = tn[at] - kept - given
            per.append({"keys": keys, "n": n, "node": node, "names": names, "kept": kept, "escape": given + lost, "given": given, "distinct": distinct})
        if not len(per[0]["names"]):
            per[0] |= {"names": np.zeros(1, np.uint64), "kept": np.zeros(1), "escape": np.ones(1), "given": np.zeros(1), "distinct": np.zeros(1)}
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        self.uniform = -math.log10(max(1, SYMBOLS - int(per[0]["distinct"][0])))
        self.per, self.q = per, q  # q: escapes from the context's suffixes, in sum
        for k, p in enumerate(per[start:], start):
            density, lows = log(p["kept"] + p["escape"]), np.zeros(len(p["names"]))
            if not k:
                q.append(np.zeros(len(p["names"])))
            else:
                s = per[k - 1]
                mask = np.uint64((1 << (BITS * (k - 1))) - 1)
                suffix = np.searchsorted(s["names"], p["names"] & mask)
                # what the shorter context has left of counts and escape weight once this one's symbols are excluded
                below = np.searchsorted(s["keys"], p["keys"] & np.uint64((1 << (BITS * k)) - 1))
                left = s["kept"][suffix] - np.bincount(p["node"], s["n"][below], len(p["names"]))
                weight = s["escape"][suffix] - p["given"]
                weight = np.where(weight < 1e-9, np.where(left < 1e-9, 1.0, 0.0), weight)
                full = log(left + weight)
                q.append(q[k - 1][suffix] + log(weight) - full)
                lows = full + q[k]
            tops = log(p["escape"]) - density + q[k]
            self.entries.append(Table(p["keys"], (log(p["n"]) - density[p["node"]] if len(p["keys"]) else p["n"]).astype(np.float32), log(p["n"]).astype(np.float32)))
            self.contexts.append(Table(p["names"], tops.astype(np.float32), lows.astype(np.float32)))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context, for keys of grams()."""
        out = np.zeros(len(keys), np.float32)
        rest, k = np.arange(len(keys)), self.order
        base = np.zeros(len(keys), np.float32)  # TOP of the longest context less LOW of the last one escaped from
        low = np.zeros(len(keys), np.float32)
        escaped = np.zeros(len(keys), bool)
        while len(rest):
            part = keys[rest] & np.uint64((1 << (BITS * (k + 1))) - 1)
            at = self.entries[k].find(part)
            hit = at >= 0
            got, where = at[hit], rest[hit]
            first, counts = self.entries[k].values
            out[where] = np.where(escaped[where], base[where] + counts[got] - low[where], first[got])
            rest, part = rest[~hit], part[~hit]
            if not len(rest):
                break
            node = self.contexts[k].find(part >> np.uint64(BITS))
            there = node >= 0
            who, node = rest[there], node[there]
            top, lows = self.contexts[k].values
            base[who] = np.where(escaped[who], base[who], top[node])
            low[who] = lows[node]
            escaped[who] = True
            if not k:
                # TOP sums the escapes down to and with the root's own
                out[rest] = base[rest] + self.uniform
                break
            k -= 1
        return out


def adaptive(text: bytes, order: int = ORDER, seen: dict | None = None, learn: bool = True) -> float:
    """log10 probability of a text and its end, by plain loops over a trie of dictionaries that learns as it goes (or only predicts from `seen`)."""
    seen = defaultdict(dict) if seen is None else seen
    history, total = (PAD,) * order, 0.0
    for symbol in [*text, END]:
        excluded: set = set()
        for k in range(order, -1, -1):
            context = history[order - k :]
            found = seen.get(context)
            if not found:
                continue
            left = {s: n - DISCOUNT for s, n in found.items() if s not in excluded}
            if not left:
                continue
            weight = DISCOUNT * len(left)
            full = sum(left.values()) + weight
            if symbol in left:
                total += math.log10(left[symbol] / full)
                break
            total += math.log10(weight / full)
            excluded |= set(left)
        else:
            total -= math.log10(max(1, SYMBOLS - len(excluded)))
        if learn:
            for k in range(order + 1):
                own = seen.setdefault(history[order - k :], {})
                own[symbol] = own.get(symbol, 0) + 1
        history = (*history[1:], symbol) if order else ()
    return total


def train_rule(doc_id: str = "doc_id"):
    """True for held-out rows; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


ANSWERED = "chunk long, bucket int, found binary"


def _answer(sent):
    """For rows sorted by bucket, each bucket's sums first: log10 probabilities of the grams that a chunk asks for, or counts of its words."""

    def run(batches):
        keys, counts = pickle.loads(sent.value)
        short = Model([summed(keys, counts, k) for k in range(LOCAL + 1)])
        bucket = model = None
        for batch in batches:
            out = []
            for b, chunk, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "counts")), strict=True):
                own = unpack(k, np.uint64)
                if chunk is None:
                    bucket, n = b, unpack(n, np.int64)
                    model = Model([summed(own, n, order) for order in range(LOCAL + 1, ORDER + 1)], below=short) if b < BUCKETS else Table(own, n)
                    continue
                assert b == bucket
                if b < BUCKETS:
                    found = np.concatenate([model.log10(own[a : a + (1 << 19)]) for a in range(0, len(own), 1 << 19)])
                else:
                    at = model.find(own)
                    found = np.where(at < 0, 0, model.values[0][at])
                out.append((chunk, b, planes(found)))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield _filled(ANSWERED, len(out), **dict(zip(("chunk", "bucket", "found"), map(list, columns), strict=True)))

    return run


def _score(n: int, v: int, n_texts: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    z = math.log10(n + v + 1)
    end = math.log10(n_texts + 1) - z

    def run(rows, answers):
        hasher, chunk, held = WordHasher(), Chunk(0), []
        for packed in rows.column("texts").to_pylist():
            batch = pa.ipc.open_stream(packed).read_next_batch()
            chunk.count(as_bytes(batch.column("text")), 0, hasher)
            held.append(batch)
        logs, counts = chunk.tables(answers)
        out = []
        for batch, texts in ((x, as_bytes(x.column("text"))) for x in held):
            keys, begins = grams(texts)
            at = logs.find(keys)
            assert (at >= 0).all()
            scores = np.add.reduceat(logs.values[0][at].astype(np.float64), begins[:-1])
            buf, starts = joined(texts)
            h, start, _ = hasher.hashes(buf)
            at = np.searchsorted(start, starts)
            c = counts.values[0][counts.find(h)] if len(h) else np.zeros(0, np.int64)
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])  # noqa: E731, B023
            size = len(texts)
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at) + 1, pa.int64()), pa.array(sums(c > 0) + int(n_texts > 0), pa.int64()),
                        pa.array(np.full(size, n), pa.int64()), pa.array(sums(np.log10(c + 1.0) - z) + end), pa.array(scores),
                    ],
                    names,
                )
            )
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores each row of `docs` (doc_id, text; other columns are ignored) by a model of its training rows.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out of training (a null
    doc_id is not). Null texts count as empty: they have their end and no more.
    Returned for each row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (an add-one unigram model of words and ends) and score (log10 of the
    text's probability by PPM, its end included). Rows that repeat count
    each time, and get the same scores. Without training rows the model is uniform; an empty table
    gives no rows. Texts are scored whole: a text longer than CHUNK is a chunk of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train_rule().alias("held_out"))
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "lm")
    small_batches(spark)
    rows.mapInArrow(_count, COUNTED).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(COUNTED).parquet(path)
    n_texts = stored.where(F.col("kind") == TEXTS_READ).agg(F.sum("n")).first()[0] or 0
    asked = stored.where(F.col("kind") == ASKED).select("bucket", "chunk", "keys", "counts")
    parts = cut(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sum, SUMMED), PACKED)
    n_words, distinct = parts.where(F.col("bucket") >= BUCKETS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = n_words + n_texts, distinct + bool(n_texts)
    short = parts.where(F.col("bucket") < BUCKETS).select("keys", "counts").mapInArrow(_short, SHORT).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    sent = spark.sparkContext.broadcast(pickle.dumps((short.column("key").to_numpy().view(np.uint64), short.column("n").to_numpy()), protocol=5))
    both = parts.select("bucket", F.lit(None).cast("long").alias("chunk"), "keys", "counts").union(asked)
    answers = both.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first()).mapInArrow(_answer(sent), ANSWERED)
    texts = stored.where(F.col("kind") == TEXTS).select("chunk", "texts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(n, v, n_texts), schema)
