"""A convolutional text classifier in numpy, with thresholds calibrated by language.

A word (A-Z lower-cased) is embedded as the sum of hashed table rows for itself and
for its first 4, 5 and 6 bytes; filters of several widths run over the words, each
filter's maximum over the text is kept, and a logistic layer turns the maxima
into a score. Training is by Adam on labelled
texts; scoring keeps only running maxima, so a text of any length is scored
whole in bounded memory.

All labelled rows are learnt from. They are dealt into shards by hash; in each round every
shard is trained on from the same weights in a task of its own, and the changes are
averaged, those of a table row over the steps that touched it. Calibration counts all rows kept for it.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import WordHasher, as_bytes, cut, joined, pieces

#: Labels of at most so many rows (about 90 bytes each) are broadcast to find their texts; more are joined by shuffling.
BROADCAST = 500_000
#: Words whose vectors are held at once in training.
WORDS = 1 << 17
#: Table rows to a block of averages.
BLOCK = 1024
#: Logits are counted by steps of 1 / STEPS for calibration.
STEPS = 256
GAP = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class Settings:
    """A shard holds about shard_rows texts or shard_bytes, whichever is less; there are as many shards as all labelled texts need."""

    bits: int = 16
    dim: int = 8
    filters: int = 8
    widths: tuple = (1, 2, 3)
    shard_rows: int = 4_096
    shard_bytes: int = 1 << 24
    #: Prefix lengths in bytes whose rows are added to the word's own.
    prefixes: tuple = (4, 5, 6)
    #: Rounds of averaging where there are several shards.
    rounds: int = 4
    #: Passes over the training texts, or more until there are least_steps to a shard or it was passed over for so many bytes.
    epochs: int = 4
    least_steps: int = 800
    most_bytes: int = 1 << 26
    #: Power of the inverse share of a label as the weight of its rows in the loss.
    balance: float = 0.5
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


class TextCNN:
    """Weights: emb (2**bits, dim), for each width a (width * dim, filters) matrix and a bias, and the output layer."""

    def __init__(self, s: Settings = Settings()):
        rng = np.random.default_rng(s.seed)
        self.s, n = s, s.filters * len(s.widths)
        self.w = {"emb": rng.normal(0, 0.1, (1 << s.bits, s.dim)).astype(np.float32), "out": np.full(n, 0.3, np.float32), "bias": np.zeros(1, np.float32)}
        for k in s.widths:
            self.w[f"f{k}"] = rng.normal(0, (k * s.dim) ** -0.5, (k * s.dim, s.filters)).astype(np.float32)
            self.w[f"b{k}"] = np.zeros(s.filters, np.float32)
        #: Score is sigmoid(scale * logit + shift), set by calibrate().
        self.scale, self.shift = 1.0, 0.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """Word vectors from table rows (rows of each word, words)."""
        out = self.w["emb"][ids[0]]
        for more in ids[1:]:
            out += self.w["emb"][more]
        return out

    def _conv(self, e: np.ndarray, k: int) -> np.ndarray:
        """Filter outputs at each place where k words begin."""
        n, d = len(e) - k + 1, self.s.dim
        out = e[:n] @ self.w[f"f{k}"][:d]
        for j in range(1, k):
            out += e[j : j + n] @ self.w[f"f{k}"][j * d : (j + 1) * d]
        return out

    def logits(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One logit for each text; text i is ids[:, begins[i]:begins[i + 1]]."""
        n_texts, parts = len(begins) - 1, []
        e = self.embed(ids)
        lengths = np.diff(begins)
        for k in self.s.widths:
            top = np.zeros((n_texts, self.s.filters), np.float32)
            long_ = np.flatnonzero(lengths >= k)
            if len(long_):
                v = self._conv(e, k)
                # places at which the k words belong to two texts must not count
                if k > 1:
                    for j in range(1, k):
                        cross = begins[1:-1] - j
                        v[cross[(cross >= 0) & (cross < len(v))]] = -np.inf
                got = np.maximum.reduceat(v, begins[long_], axis=0)
                top[long_] = np.maximum(got + self.w[f"b{k}"], 0)
            parts.append(top)
        return np.concatenate(parts, axis=1) @ self.w["out"] + self.w["bias"]

    def scores(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, begins).astype(np.float64) + self.shift, -60, 60)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, p: Plan, turn: int = 0, shard: int = 0) -> dict:
        """Adam on the logistic loss, passes of one round; texts are arrays of table rows as in embed().

        Gives the number of steps, and of those that touched each table row.
        """
        s, rng = self.s, np.random.default_rng([self.s.seed + 1, turn, shard])
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        q = {k: np.zeros_like(v) for k, v in self.w.items()}
        t, touched = 0, np.zeros(1 << s.bits, np.int32)
        for epoch in range(p.passes):
            order = rng.permutation(len(texts))
            rate = s.rate * (1 - (turn + epoch / p.passes) / p.rounds) ** 0.5
            for first in range(0, len(order), s.batch):
                part = order[first : first + s.batch]
                g = self._gradient([texts[i] for i in part], labels[part], np.where(labels[part] > 0, *p.weights[::-1]))
                t += 1
                fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k, x in g.items():
                    if k == "emb":
                        r, x = x
                        touched[r] += 1
                        m[k][r] = 0.9 * m[k][r] + 0.1 * x
                        q[k][r] = 0.999 * q[k][r] + 0.001 * x * x
                        self.w[k][r] -= rate * fix * m[k][r] / (np.sqrt(q[k][r]) + 1e-8)
                    else:
                        m[k] = 0.9 * m[k] + 0.1 * x
                        q[k] = 0.999 * q[k] + 0.001 * x * x
                        self.w[k] -= rate * fix * m[k] / (np.sqrt(q[k]) + 1e-8)
        return {"steps": t, "touched": touched}

    def _maxima(self, ids: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width the greatest output of each filter over each text and the word where it begins; -inf and -1 for shorter texts.

        Only the vectors of about WORDS words are held at once.
        """
        n, f = len(begins) - 1, np.arange(self.s.filters)
        found = [(np.full((n, len(f)), -np.inf, np.float32), np.full((n, len(f)), -1)) for _ in self.s.widths]
        for a in range(0, ids.shape[1], WORDS):
            e = self.embed(ids[:, a : a + WORDS + max(self.s.widths) - 1])
            first, last = np.searchsorted(begins, a, "right") - 1, min(n, np.searchsorted(begins, a + WORDS))
            for k, (top, where) in zip(self.s.widths, found, strict=True):
                if len(e) < k:
                    continue
                v = self._conv(e, k)[:WORDS]
                for i in range(first, last):
                    low, high = max(begins[i], a), min(begins[i + 1] - k + 1, a + len(v))
                    if low < high:
                        part = v[low - a : high - a]
                        best = part.argmax(axis=0)
                        value = part[best, f]
                        where[i] = np.where(value > top[i], best + low, where[i])
                        top[i] = np.maximum(value, top[i])
        return found

    def logit(self, ids: np.ndarray) -> float:
        """The logit of one text, however long."""
        tops = [np.maximum(top + self.w[f"b{k}"], 0) for k, (top, _) in zip(self.s.widths, self._maxima(ids, np.array([0, ids.shape[1]])), strict=True)]
        return float((np.concatenate(tops, axis=1) @ self.w["out"] + self.w["bias"])[0])

    def _gradient(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | float = 1.0) -> dict:
        s, d = self.s, self.s.dim
        begins = np.concatenate(([0], np.cumsum([x.shape[1] for x in texts])))
        ids = np.concatenate(texts, axis=1)
        tops, where = [], []
        for k, (top, arg) in zip(s.widths, self._maxima(ids, begins), strict=True):
            value = top + self.w[f"b{k}"]
            tops.append(np.maximum(value, 0))
            where.append(np.where(value > 0, arg, -1))
        pooled = np.concatenate(tops, axis=1)
        z = pooled @ self.w["out"] + self.w["bias"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / max(1, len(texts))).astype(np.float32)
        g = {"out": pooled.T @ dz, "bias": np.array([dz.sum()], np.float32)}
        rows, grads = [], []
        for j, k in enumerate(s.widths):
            arg = where[j]
            hit = arg >= 0
            dv = dz[:, None] * self.w["out"][None, j * s.filters : (j + 1) * s.filters] * hit
            g[f"b{k}"] = dv.sum(axis=0)
            fw = np.zeros_like(self.w[f"f{k}"])
            _, f = np.nonzero(hit)
            place, value = arg[hit], dv[hit]
            for o in range(k):
                np.add.at(fw[o * d : (o + 1) * d].T, f, value[:, None] * self.embed(ids[:, place + o]))
                back = value[:, None] * self.w[f"f{k}"][o * d : (o + 1) * d].T[f]
                for own in ids:
                    rows.append(own[place + o])
                    grads.append(back)
            g[f"f{k}"] = fw
        rows_, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(rows_), d), np.float32)
        np.add.at(total, inverse, np.concatenate(grads))
        g["emb"] = (rows_, total)
        return g

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> TextCNN:
        """Fits scale and shift by Newton's method on texts that were not trained on."""
        a, b, x, y = 1.0, 0.0, logits.astype(float), labels.astype(float)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) * weights
            h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, np.array([(weights * (p - y) * x).sum() + 1e-2 * (a - 1), (weights * (p - y)).sum() + 1e-2 * b]))
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
            if abs(step).max() < 1e-6:
                break
        self.scale, self.shift = max(float(a), 1e-3), float(b)
        return self


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: np.ndarray, weights: np.ndarray, least_precision: float = 0.97) -> dict:
    """For each language the lowest threshold of at least 0.5 whose weighted precision on the given texts is enough; "" is for languages not seen."""
    found = {}
    for lang in ["", *sorted({x for x in langs if x})]:
        at = np.ones(len(langs), bool) if not lang else langs == lang
        order = np.argsort(-scores[at], kind="stable")
        s, y, w = scores[at][order], labels[at][order], weights[at][order]
        if not y.any():
            found[lang] = found.get("", 0.7)
            continue
        precision = np.cumsum(y * w) / np.cumsum(w)
        last = np.append(s[1:] != s[:-1], True)
        good = np.flatnonzero((precision >= least_precision) & last)
        if not len(good):
            found[lang] = found.get("", 0.7)
            continue
        k = good[-1]
        below = s[k + 1] if k + 1 < len(s) else 0.0
        found[lang] = float(max(0.5, (s[k] + below) / 2))
    return found


@dataclass
class Model:
    net: TextCNN
    thresholds: dict


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, n_bytes (of the text, known before the join), toxic and held (kept for calibration) of all rows to learn from."""
    rule = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = labels.where(rule & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.where(rule).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    known = F.broadcast(known) if known.count() <= BROADCAST else known
    return rows.join(known, "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4)


@dataclass
class Plan:
    """How all labelled rows are passed over: of `shards` shards, each `passes` times in each of `rounds` rounds.

    weights: of rows of label 0 and of label 1 in the loss.
    """

    shards: int
    rounds: int
    passes: int
    weights: tuple = (1.0, 1.0)


def plan(s: Settings, of_label: tuple[int, int], n_bytes: int) -> Plan:
    n = sum(of_label)
    shards = max(1, -(-n // s.shard_rows), -(-n_bytes // s.shard_bytes))
    rounds = 1 if shards == 1 else s.rounds
    more = min(-(-s.least_steps * s.batch * shards // max(1, n)), s.most_bytes * shards // max(1, n_bytes))
    return Plan(shards, rounds, max(-(-s.epochs // rounds), -(-more // rounds)), tuple((n / (2 * max(1, x))) ** s.balance for x in of_label))


def table_rows(texts: list[bytes], hasher: WordHasher, s: Settings):
    """Table rows of words (kinds, words) and where each text begins among them."""
    buf, begins = joined(texts)
    h, start, _ = hasher.hashes(buf, s.prefixes)
    # a hash of a word and one of an equal prefix differ: kinds are told apart
    kinds = np.arange(len(h), dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return ((h + kinds) >> np.uint64(64 - s.bits)).astype(np.int32), np.searchsorted(start, begins)


def slices(text: bytes, most: int = 1 << 19):
    """A text in parts of about `most` bytes, cut at white space."""
    at = 0
    while len(text) - at > most and (gap := GAP.search(text, at + most)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def rows_of(column, hasher: WordHasher, s: Settings):
    """Table rows of each text of an Arrow column, hashed in pieces."""
    texts = as_bytes(column)
    for first, last in pieces(texts):
        if last - first == 1:
            yield np.concatenate([table_rows([x], hasher, s)[0] for x in slices(texts[first])], axis=1)
            continue
        ids, at = table_rows(texts[first:last], hasher, s)
        for i in range(last - first):
            yield ids[:, at[i] : at[i + 1]].copy()


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Trains on all labelled rows but a fifth, all of which calibrates score and thresholds.

    docs: doc_id, text, lang; labels: doc_id, toxic (only 0 and 1 count; of labels that
    disagree, 1 holds). Rows whose crc32(doc_id as text) mod 3 is 1 are never
    learnt from. The fifth is chosen by the hash of doc_id; where the others lack a label, all rows are trained on
    and none is kept. Without labelled rows of both kinds all texts score alike, by
    the share of the one kind. lang is used for the thresholds alone. Null and empty texts are learnt from as texts
    of no words, long ones whole; rows of documents that repeat a labelled doc_id are each learnt from; a null doc_id has no label;
    tables without rows are as tables without labels. The order of rows does not matter.

    A task holds the words of one shard; rows equal in doc_id and text share it. The driver holds the model, and counts by language, label and step of the logit.
    """
    rows, net = labelled(docs, labels), TextCNN(s)
    sizes = {(r["held"], r["toxic"]): (r["n"], r["b"]) for r in rows.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")).collect()}
    n = [sum(x for (_, y), (x, _) in sizes.items() if y == label) for label in (0, 1)]
    if not all(n):
        net.w["out"][:] = 0
        net.shift = float(np.log((n[1] + 1) / (n[0] + 1))) if any(n) else 0.0
        return Model(net, {"": 0.7})
    keep = all((False, y) in sizes for y in (0, 1))
    trained = [(y, *x) for (held, y), x in sizes.items() if not (keep and held)]
    p = plan(s, tuple(sum(x for y, x, _ in trained if y == label) for label in (0, 1)), sum(b for *_, b in trained))
    rows = rows.drop("n_bytes").withColumn("held", F.col("held") & F.lit(keep)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(p.shards)).cast("int"))
    rows = cut(rows.repartitionById(p.shards, "shard").sortWithinPartitions("shard", "doc_id", "text"))
    for i in range(p.rounds):
        _round(rows.where(~F.col("held")).select("shard", "text", "toxic"), net, p, i)
    if not keep:
        return Model(net, {"": 0.7})
    return _calibrated(rows.where("held").select("text", "lang", "toxic"), net)


def _dense(net: TextCNN) -> list[str]:
    """The weights that every step changes."""
    return [k for k in sorted(net.w) if k != "emb"]


def _round(rows: DataFrame, net: TextCNN, p: Plan, i: int) -> None:
    """Trains on each shard from the weights of net, and adds the mean change to them."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(net.w, protocol=5))
    changes = rows.mapInArrow(_train(net.s, sent, p, i), "block int, shard int, at binary, n binary, change binary")
    means = changes.repartition(8, "block").sortWithinPartitions("block", "shard").mapInArrow(_mean, "block int, at binary, change binary").collect()
    sent.destroy()
    for r in means:
        at, change = np.frombuffer(r["at"], np.int32), np.frombuffer(r["change"], np.float32)
        if r["block"] >= 0:
            net.w["emb"][r["block"] * BLOCK + at] += change.reshape(len(at), -1)
            continue
        begin = 0
        for k in _dense(net):
            net.w[k] += change[begin : begin + net.w[k].size].reshape(net.w[k].shape)
            begin += net.w[k].size


def _train(s: Settings, sent, p: Plan, i: int):
    """For each shard of a task, whose rows stand together, the changes of weights in blocks and how many steps made them."""

    def trained(shard, texts, labels):
        before, net = pickle.loads(sent.value), TextCNN(s)
        net.w = {k: v.copy() for k, v in before.items()}
        made = net.train(texts, np.array(labels, np.float32), p, i, shard)
        flat = np.concatenate([(net.w[k] - before[k]).ravel() for k in _dense(net)])
        out = [(-1, np.arange(len(flat), dtype=np.int32), np.full(len(flat), made["steps"], np.int32), flat)]
        for first in range(0, 1 << s.bits, BLOCK):
            at = np.flatnonzero(made["touched"][first : first + BLOCK]).astype(np.int32)
            if len(at):
                out.append((first // BLOCK, at, made["touched"][first + at], net.w["emb"][first + at] - before["emb"][first + at]))
        columns = [pa.array([x[0] for x in out], pa.int32()), pa.array([shard] * len(out), pa.int32())]
        columns += [pa.array([x[j].tobytes() for x in out], pa.binary()) for j in (1, 2, 3)]
        return pa.RecordBatch.from_arrays(columns, ["block", "shard", "at", "n", "change"])

    def run(batches):
        hasher, shard, texts, labels = WordHasher(), None, [], []
        for batch in batches:
            for of, ids, y in zip(batch.column("shard").to_pylist(), rows_of(batch.column("text"), hasher, s), batch.column("toxic").to_pylist(), strict=True):
                if of != shard and texts:
                    yield trained(shard, texts, labels)
                    texts, labels = [], []
                shard = of
                texts.append(ids)
                labels.append(y)
        if texts:
            yield trained(shard, texts, labels)

    return run


def _mean(batches):
    """The mean change of each block, whose rows stand together, weighted by steps."""

    def made(block, n, total):
        at = np.flatnonzero(n).astype(np.int32)
        mean = (total[at] / n[at, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["block", "at", "change"])

    block = n = total = None
    for batch in batches:
        for of, *values in zip(*(batch.column(k).to_pylist() for k in ("block", "at", "n", "change")), strict=True):
            at, steps, change = (np.frombuffer(x, t) for x, t in zip(values, (np.int32, np.int32, np.float32), strict=True))
            if of != block:
                if n is not None:
                    yield made(block, n, total)
                size = len(at) if of < 0 else BLOCK
                block, n, total = of, np.zeros(size, np.int64), np.zeros((size, len(change) // len(at)))
            n[at] += steps
            total[at] += steps[:, None] * change.reshape(len(at), -1).astype(float)
    if n is not None:
        yield made(block, n, total)


def _calibrated(held: DataFrame, net: TextCNN) -> Model:
    """Calibration and thresholds from counts of all kept rows, by steps of the logit."""
    sent = held.sparkSession.sparkContext.broadcast(pickle.dumps(net.w, protocol=5))
    steps = held.mapInArrow(_logit_steps(net.s, sent), "lang string, toxic int, step int")
    found = sorted(tuple(r) for r in steps.groupBy("lang", "toxic", "step").count().collect())
    sent.destroy()
    if not found:
        return Model(net, {"": 0.7})
    langs, y, x, n = (np.array([r[j] for r in found], t) for j, t in enumerate((object, np.float32, float, float)))
    net.calibrate(x / STEPS, y, n)
    p = 1 / (1 + np.exp(-np.clip(net.scale * x / STEPS + net.shift, -60, 60)))
    return Model(net, thresholds(p, y, langs, n))


def _logit_steps(s: Settings, sent):
    def run(batches):
        hasher, net = WordHasher(), TextCNN(s)
        net.w = pickle.loads(sent.value)
        for batch in batches:
            got = [round(min(max(net.logit(ids), -64.0), 64.0) * STEPS) for ids in rows_of(batch.column("text"), hasher, s)]
            langs = [x or "" for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), batch.column("toxic"), pa.array(got, pa.int32())], ["lang", "toxic", "step"])

    return run


def _score(model):
    def run(batches):
        net = pickle.loads(model.value)
        hasher = WordHasher()
        for batch in batches:
            texts, out = as_bytes(batch.column("text")), []
            for first, last in pieces(texts):
                out.append(net.scores(*table_rows(texts[first:last], hasher, net.s)))
            got = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id long, text string and any other columns) with a score from 0 to 1 for each row, in place of a column of that name.

    Null and blank texts get the score of no words, equal texts equal scores (but for rounding, as texts share a matrix product); rows that repeat are each scored, an
    empty table gives none. Texts are scored whole, however long.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model.net))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(_score(sent), schema)


def threshold_of(lang, model: Model):
    """The threshold column for a language column."""
    out = F.lit(model.thresholds[""])
    for k, v in model.thresholds.items():
        if k:
            out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out
