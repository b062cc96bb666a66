"""The ten operators against brute force, exact round trips or held-out accuracy, on small and hostile inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import chat, decontamination, licenses, lm_scoring, media, minhash_dedup, queries, sentencepiece_codec, sharding, toxicity, warc
from loomstone.llm.common import scratch
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
# Columns beside doc_id, text and lang have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, key string, n long"


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty, blank, very long, tied and repeated rows, near copies, and columns with clashing names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    w = base.split()
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "ONE two Three"), (7, base), (8, base), (8, base), (None, base), (None, None),
        (9, " ".join([*w[:60], "changed", *w[61:]])), (10, " ".join(w[:-8])), (11, prose(rng, 20000)), (12, "é ü   🎉 x\x00y <s> \\ [INST]"), (13, "one two three four five six"),
        (14, "x" * 70000), (15, "one two three four five six"), (16, base.upper()), (17, " ".join(["a"] * 400)), (18, " ".join(["a"] * 300)),
    ]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", "k", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 -----------------------------------------------------------------------


def held_out(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def ppm_counts(texts):
    seen = {}
    for t in texts:
        history = (lm_scoring.PAD,) * lm_scoring.ORDER
        for s in [*t, lm_scoring.END]:
            for k in range(lm_scoring.ORDER + 1):
                own = seen.setdefault(history[lm_scoring.ORDER - k :], {})
                own[s] = own.get(s, 0) + 1
            history = (*history[1:], s)
    return seen


def test_lm_scores_equal_plain_loops(spark, hostile):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in hostile.collect()]
    train = [t for i, t in rows if not held_out(i, 7, 2)]
    seen = ppm_counts(train)
    c = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = sorted(
        (i is None, i or 0, len(t.lower().split()) + 1, round(lm_scoring.adaptive(t, seen=seen, learn=False), 2), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t.lower().split(), None]), 4), held_out(i, 7, 2), n, sum(c[w] > 0 for w in [*t.lower().split(), None]))
        for i, t in rows
    )
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 2), round(r["base_score"], 4), r["held_out"], r["train_tokens"], r["n_known"]) for r in lm_scoring.score(hostile).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.02 + 1e-4 * abs(b[3]) and abs(a[4] - b[4]) < 1e-3 and a[5:] == b[5:]


def test_lm_probabilities_sum_to_one_also_when_pruned():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcde ", k=60)) for _ in range(200)]
    keys, _ = lm_scoring.grams(texts)
    entries, totals = [], []
    for k in range(lm_scoring.ORDER + 1):
        u, n = np.unique(keys & np.uint64((1 << (lm_scoring.BITS * (k + 1))) - 1), return_counts=True)
        names, inverse = np.unique(u >> np.uint64(lm_scoring.BITS), return_inverse=True)
        totals.append((names, np.bincount(inverse, n).astype(np.int64)))
        entries.append((u[n >= 5], n[n >= 5]))
    model = lm_scoring.Model(entries, totals)
    for context in (b"abcde", b"zzzzz", b"  abc", b"a b c"):
        high = sum(int(x) << (lm_scoring.BITS * (i + 1)) for i, x in enumerate(reversed(context)))
        p = 10.0 ** model.log10(np.array([high | s for s in range(lm_scoring.SYMBOLS)], np.uint64)).astype(float)
        assert abs(p.sum() - 1) < 1e-4


def test_lm_without_training_rows(empty):
    assert lm_scoring.score(empty).collect() == []


def test_lm_scores_use_every_gram_of_more_symbols_than_were_once_kept_whole(spark):
    rng = random.Random(8)
    bulk = [("abcdefgh " * 40000, i) for i in range(12)]  # above 2.5 million symbols, single grams were dropped
    odd = [(prose(rng, 30), 100 + i) for i in range(20)]
    rows = [(i, t) for t, i in bulk + odd]
    counts = Counter()
    for i, t in rows:
        if not held_out(i, 7, 2):
            keys, n = np.unique(lm_scoring.grams([t.encode()])[0], return_counts=True)
            counts.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert sum(counts.values()) > 2_500_000
    keys, n = np.array(list(counts), np.uint64), np.array(list(counts.values()))
    order = np.argsort(keys)
    model = lm_scoring.Model([lm_scoring.summed(keys[order], n[order], k) for k in range(lm_scoring.ORDER + 1)])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for t, i in odd:
        assert abs(got[i] - float(model.log10(lm_scoring.grams([t.encode()])[0]).astype(float).sum())) < 0.01



def test_adaptive_mode_learns_from_the_text_itself():
    assert lm_scoring.adaptive(b"abcabcabcabcabc" * 10) > 10 * lm_scoring.adaptive(b"abcabcabcabcabc") * 0.6


# --- 2 -----------------------------------------------------------------------

MODEL = f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.DEFAULT_MODEL}"


def hard_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab theTHE  éß日🎉\n\t.,-0123") for _ in range(rng.randrange(40))) for _ in range(300)]
    return ["", "  ", " a", "a ", "a  b", "\n\n x", "日本語 テスト", "▁x ▁", "▁", "  lead   many    spaces ", "x" * 3000, "é" * 500, " " * 40, "the the the", "\x00a", *made]


def test_bpe_ids_equal_the_library():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.parse(sentencepiece_codec.load(MODEL)))
    texts = hard_texts()
    ids, begins = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == library.encode(texts)
    assert [x.decode("utf-8", "replace") for x in codec.decoder.decode(ids, begins)] == [library.decode(x) for x in library.encode(texts)]


def test_unigram_ids_equal_the_library():
    """The same pieces, with the model's kind set to unigram: scores are summed."""
    spm = pytest.importorskip("sentencepiece")
    data = sentencepiece_codec.load(MODEL)
    at = data.index(b"\x18\x02", data.index(b"\x12", len(data) - 400) if b"\x12" in data[-400:] else 0)
    changed = data[: at + 1] + b"\x01" + data[at + 2 :]
    v = sentencepiece_codec.Vocabulary.parse(changed)
    if v.kind != sentencepiece_codec.UNIGRAM:
        pytest.skip("the kind's place was not found")
    library = spm.SentencePieceProcessor(model_proto=changed)
    codec = sentencepiece_codec.Codec(v)
    texts = [t for t in hard_texts() if len(t) < 200]
    ids, begins = codec.encode(texts)
    total = lambda found: sum(v.scores[i] for i in found)
    same = 0
    for t, a, b in zip(texts, begins[:-1], begins[1:], strict=True):
        want, got = library.encode(t), ids[a:b].tolist()
        assert got == want or total(got) >= total(want) - 1e-3
        same += got == want
    assert same > 0.5 * len(texts)


def test_pairs_are_forgotten_without_a_change_of_ids(monkeypatch):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.parse(sentencepiece_codec.load(MODEL)))
    want = [x.tolist() for x in codec.encode(hard_texts())]
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 3)
    codec.follows.clear()
    assert [x.tolist() for x in codec.encode(hard_texts())] == want and len(codec.follows) <= 3


def test_round_trip_restores_texts(hostile, empty):
    rows = sentencepiece_codec.round_trip(hostile).collect()
    assert len(rows) == 21 and all(r["restored"] for r in rows)
    assert all(len(r["ids"]) == r["n_ids"] for r in rows)
    assert sentencepiece_codec.round_trip(empty).collect() == []
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(hostile)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in back) == Counter((r["doc_id"], tuple(r["ids"])) for r in rows)
    assert Counter((r["doc_id"], r["decoded"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in hostile.collect())


# --- 3 -----------------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark):
    long_ = "<p>é</p>" * 40
    big = "".join(random.Random(2).choices("abcdefgh", k=300_000))
    rows = [(1, "http://a/1", long_), (2, "http://a/2\r\nX: y", long_), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (0, "u", long_), (0, "u", long_), (None, "u", long_), (None, "u", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc")
    warc.write_archives(pages.repartition(2), path)
    for split in (997, 8 << 20):
        got = warc.read_archives(spark, path, split).collect()
        assert len(got) == len(rows)
        seen = defaultdict(list)
        for r in got:
            seen[r["page_id"]].append(r)
        assert sorted(r["record_type"] for r in seen[0]) == ["response", "revisit"]
        for i in (1, 2):
            assert (seen[i][0]["record_type"], seen[i][0]["refers_to"]) == ("revisit", 0)
        assert all(seen[i][0]["record_type"] == "response" and seen[i][0]["refers_to"] is None for i in (3, 4, 5, 6, 7))
        assert sorted(r["record_type"] for r in seen[None]) == ["response", "revisit"]
        for i, _, html in rows:
            data = (html or "").encode()
            assert any(r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest() and (r["payload"] in (None, data)) for r in seen[i])


def test_warc_reader_passes_damage_and_false_magic(tmp_path):
    one, two = warc.record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest()), warc.record(2, "u", b"y", hashlib.sha256(b"y").hexdigest())
    path = tmp_path / "a.warc.gz"
    path.write_bytes(one + b"\x1f\x8b\x08junk" + two)
    source = warc.Source(f"file://{path}")
    assert [h["warc-record-id"] for _, h, _ in warc.records(source, 0, source.size)] == ["<urn:x-page:1>", "<urn:x-page:2>"]
    assert [o for o, _, _ in warc.records(source, 1, source.size)] == [len(one) + 7]
    path.write_bytes(one[:-5])
    source, told = warc.Source(f"file://{path}"), []
    assert list(warc.records(source, 0, source.size, lambda at, why: told.append((at, why)))) == []
    assert told == [(0, "gzip member cut short or with a wrong checksum")]


def test_warc_damage_is_an_error_or_a_row(spark, tmp_path):
    make = lambda i, data: warc.record(i, "u", data, hashlib.sha256(data).hexdigest())
    rng = random.Random(19)
    sound = [make(i, rng.randbytes(600)) for i in range(6)]
    flipped = bytearray(sound[2])
    flipped[-4] ^= 1  # in the checksum's tail
    wrong = warc.record(9, "u", b"x" * 300, hashlib.sha256(b"y").hexdigest())
    (tmp_path / "a.warc.gz").write_bytes(sound[0] + sound[1] + bytes(flipped) + sound[3] + b"rubbish" + sound[4] + wrong + warc._gzip(b"no record") + warc._gzip(b"") + sound[5][:-30])
    path = f"file://{tmp_path}"
    for split in (211, 8 << 20):
        with pytest.raises(Exception, match="byte"):
            warc.read_archives(spark, path, split).collect()
        rows = warc.read_archives(spark, path, split, keep_damage=True).collect()
        # 3 stands between damage on both sides: nothing tells it from a record within a record
        assert sorted(r["page_id"] for r in rows if r["record_type"] == "response") == [0, 1, 4]
        lost = [r for r in rows if r["record_type"] == "damaged"]
        places = {r["payload_bytes"] for r in lost}
        assert len(sound[0] + sound[1]) in places and all(r["payload"] and r["url"].endswith("a.warc.gz") for r in lost)
        assert sum(b"match" in bytes(r["payload"]) for r in lost) == 1 and max(places) == (tmp_path / "a.warc.gz").stat().st_size - len(sound[5]) + 30


def test_warc_members_of_16_mib(spark):
    """Longer members have an empty one behind them, which ends in a zero byte."""
    data = random.Random(18).randbytes(9 << 20).hex()
    made = warc.record(1, "u", data.encode(), "")
    assert made.endswith(b"\0") and warc._gzip(b"x" * 100).endswith(b"\0")
    pages = spark.createDataFrame([(1, "u", data), (2, "u", "z")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    got = {r["page_id"]: r["payload_digest"] for r in warc.read_archives(spark, path, 1 << 20).drop("payload").collect()}
    assert got == {1: hashlib.sha256(data.encode()).hexdigest(), 2: hashlib.sha256(b"z").hexdigest()}


def test_warc_of_no_pages(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


# --- 4 -----------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = f"nasty{rng.randrange(20)}"
        docs.append((i, " ".join(w), rng.choice(["en", "fr"])))
        labels.append((i, int(bad)))
    docs += [(None, None, None), (901, "", "en"), (902, "w1 " * 50_000 + "nasty1 nasty2", "en")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels_df = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels_df)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 903 and all(0 <= x <= 1 for x in got.values()) and got[None] == got[901]
    test = [(got[i], y) for i, y in labels if held_out(i, 3, 1)]
    assert sum((s >= 0.7) == bool(y) for s, y in test) >= 0.95 * len(test)
    assert set(model.thresholds) == {"", "en", "fr"}


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.TextCNN(toxicity.Settings(bits=6, dim=3, filters=2))
    texts = [rng.integers(0, 64, (4, n)).astype(np.int32) for n in (5, 1, 9)]
    y = np.array([1, 0, 1], np.float32)

    def loss():
        z = np.concatenate([net.logits(t, np.array([0, t.shape[1]])) for t in texts]).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net._gradient(texts, y)
    for name, index in (("out", (1,)), ("bias", (0,)), ("f2", (3, 1)), ("b1", (0,))):
        kept = float(net.w[name][index])
        net.w[name][index] = kept + 1e-2
        up = loss()
        net.w[name][index] = kept - 1e-2
        down = loss()
        net.w[name][index] = kept
        assert abs((up - down) / 2e-2 - g[name][index]) < 2e-3
    assert len(net.logits(np.zeros((4, 0), np.int32), np.array([0, 0, 0]))) == 2


def test_toxicity_scores_equal_plain_loops():
    """Embedding sums, filters at each place, maxima and the logistic layer, one number after another."""
    s = toxicity.Settings(bits=8, dim=3, filters=2)
    net = toxicity.TextCNN(s)
    net.w["bias"][:], net.scale, net.shift = 0.2, 1.7, -0.4
    for k in s.widths:
        net.w[f"b{k}"][:] = 0.05 * k
    hasher = toxicity.WordHasher()
    texts = [b"", b" ", b"one", b"One TWO", b"a few words that are longer than a filter", b"repeated " * 50, "é ü 🎉 x".encode()]
    got = net.scores(*toxicity.table_rows(texts, hasher, s))
    for text, score_ in zip(texts, got, strict=True):
        rows = [toxicity.table_rows([w[:n] if n else w], hasher, s)[0] for w in text.lower().split() for n in (0,)]
        e = [[sum(float(net.w["emb"][r[kind, 0]][d]) for kind in range(r.shape[0])) for d in range(s.dim)] for r in rows]
        logit = float(net.w["bias"][0])
        for j, k in enumerate(s.widths):
            for f in range(s.filters):
                values = [sum(e[i + o][d] * float(net.w[f"f{k}"][o * s.dim + d][f]) for o in range(k) for d in range(s.dim)) for i in range(len(e) - k + 1)]
                top = max(0.0, max(values) + float(net.w[f"b{k}"][f])) if values else 0.0
                logit += top * float(net.w["out"][j * s.filters + f])
        assert abs(score_ - 1 / (1 + math.exp(-(net.scale * logit + net.shift)))) < 1e-5


def test_toxicity_gradient_of_embeddings():
    rng = np.random.default_rng(3)
    net = toxicity.TextCNN(toxicity.Settings(bits=5, dim=3, filters=2))
    texts, y = [rng.integers(0, 32, (4, n)).astype(np.int32) for n in (5, 2, 9)], np.array([1, 0, 1], np.float32)

    def loss():
        z = np.concatenate([net.logits(t, np.array([0, t.shape[1]])) for t in texts]).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    rows, g = net._gradient(texts, y)["emb"]
    for i in range(0, len(rows), 5):
        for d in range(3):
            kept = float(net.w["emb"][rows[i], d])
            net.w["emb"][rows[i], d] = kept + 1e-3
            up = loss()
            net.w["emb"][rows[i], d] = kept - 1e-3
            down = loss()
            net.w["emb"][rows[i], d] = kept
            assert abs((up - down) / 2e-3 - g[i, d]) < 5e-3


def test_toxicity_of_odd_tables(spark, hostile, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)] + [(7, 1), (None, 1), (4, None), (5, 9)], "doc_id long, toxic int")
    docs = hostile.withColumn("score", hostile["n"])
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == docs.count()
    by_text = defaultdict(set)
    for r in got.collect():
        by_text[(r["text"] or "").lower().split().__repr__()].add(r["score"])
    assert all(max(x) - min(x) < 1e-6 and 0 <= min(x) <= 1 for x in by_text.values())
    again = toxicity.fit(docs.repartition(7), labels)
    assert all((model.net.w[k] == again.net.w[k]).all() for k in model.net.w) and model.thresholds == again.thresholds
    assert toxicity.score(empty, model).collect() == [] and toxicity.fit(empty, labels).thresholds == {"": 0.7}


def test_toxicity_without_labels(hostile, spark):
    model = toxicity.fit(hostile, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r["score"] for r in toxicity.score(hostile, model).collect()}) == 1


def caught(spark, docs, labels, of, s=toxicity.Settings()):
    """Of held-out rows: the share of toxic ones with ids in `of` that are found, and of the others that are not."""
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), s)
    got = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score(docs, model).collect()}
    test = [(got[i], y) for i, y in labels if held_out(i, 3, 1) and (not y or i in of)]
    return [sum(g == y for g, y in test if y == label) / sum(y == label for _, y in test) for label in (1, 0)]


def test_toxicity_is_learnt_from_all_labelled_rows(spark):
    """One kind of toxic word is only in rows that do not have the 3000 least hashes of their label."""
    rng = random.Random(11)
    labels = [(i, i % 2) for i in range(16_000)]
    ids = [r["i"] for r in spark.range(16_000).orderBy(F.xxhash64("id"), "id").select(F.col("id").alias("i")).collect()]
    first = {i for i in [i for i in ids if i % 2 and not held_out(i, 3, 1)][:3000]}
    late = {i for i in ids if i % 2 and i not in first and (not held_out(i, 3, 1) or rng.random() < 0.5)}
    docs = []
    for i, y in labels:
        w = [f"w{rng.randrange(300)}" for _ in range(8)]
        if y:
            w[rng.randrange(8)] = f"{'zzlate' if i in late else 'early'}{rng.randrange(5)}"
        docs.append((i, " ".join(w), rng.choice(["en", "fr"])))
    toxic, clean = caught(spark, docs, labels, late)
    assert toxic >= 0.98 and clean >= 0.98


def test_toxicity_is_learnt_from_long_texts(spark):
    """One kind of toxic word is only in texts of more than 64 KiB, the last of them in the last part."""
    rng = random.Random(12)
    labels, docs, long_ = [(i, i % 2) for i in range(240)], [], set()
    for i, y in labels:
        w = [f"w{rng.randrange(300)}" for _ in range(17_000 if i % 4 >= 2 else 12)]
        if y:
            w[-1 - rng.randrange(5)] = "lengthy" if i % 4 >= 2 else "early"
        if i % 4 >= 2:
            long_.add(i)
        docs.append((i, " ".join(w), "en"))
    assert min(len(docs[i][1]) for i in long_) > 1 << 16
    toxic, clean = caught(spark, docs, labels, long_)
    assert toxic >= 0.9 and clean >= 0.9


def test_toxicity_of_several_shards(spark, monkeypatch):
    """Neither the order of rows nor the way labels are joined matters."""
    rng = random.Random(13)
    docs = [(i, " ".join(["nasty" if i % 3 == 0 and k == 2 else f"w{rng.randrange(100)}" for k in range(12)]), "en") for i in range(420)]
    labels, s = [(i, int(i % 3 == 0)) for i in range(420)], toxicity.Settings(bits=10, shard_rows=64, least_steps=300)
    assert toxicity.plan(s, (150, 74), 9000).shards == 4 and toxicity.plan(toxicity.Settings(), (9, 1), 10 << 24).shards == 10
    assert caught(spark, docs, labels, {i for i, y in labels if y}, s) == [1, 1]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = toxicity.fit(docs, labels, s)
    monkeypatch.setattr(toxicity, "BROADCAST", 0)
    two = toxicity.fit(docs.repartition(7), labels, s)
    assert all((one.net.w[k] == two.net.w[k]).all() for k in one.net.w) and one.thresholds == two.thresholds


def test_toxicity_of_few_labels(spark):
    """Where the rows that are not kept lack a label, all are trained on."""
    for n in (1, 2, 4, 7):
        docs = spark.createDataFrame([(i, f"nasty word{i}" if i % 2 else f"word{i}", None) for i in range(n)], "doc_id long, text string, lang string")
        model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int"), toxicity.Settings(bits=8, least_steps=20))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect()) and "" in model.thresholds


def test_toxicity_maxima_and_rows_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    net = toxicity.TextCNN(toxicity.Settings(bits=5, dim=3, filters=2))
    texts = [rng.integers(0, 32, (4, n)).astype(np.int32) for n in (0, 9, 2, 0, 31, 1, 0)]
    ids, begins = np.concatenate(texts, axis=1), np.concatenate(([0], np.cumsum([x.shape[1] for x in texts])))
    whole = net._maxima(ids, begins)
    for words_ in (1, 2, 3, 7, 43):
        monkeypatch.setattr(toxicity, "WORDS", words_)
        for (top, at), (top_, at_) in zip(whole, net._maxima(ids, begins), strict=True):
            assert np.allclose(top, top_) and (at == at_).all()
    assert np.allclose([net.logit(x) for x in texts], net.logits(ids, begins), atol=1e-5)
    text = b"a few words\tand  more, " * 40 + b"x" * 100
    parts = list(toxicity.slices(text, 50))
    assert len(parts) > 10 and b"".join(parts) == text and sum((p.split() for p in parts), []) == text.split()


def test_toxicity_changes_are_averaged_over_the_steps_that_made_them():
    f4, i4 = (lambda *x: np.array(x, np.float32).tobytes()), (lambda *x: np.array(x, np.int32).tobytes())
    rows = [(-1, 0, i4(0, 1), i4(2, 2), f4(1, 2)), (-1, 1, i4(0, 1), i4(6, 6), f4(5, 2)), (3, 0, i4(7, 9), i4(1, 4), f4(1, 2, 3, 4)), (3, 1, i4(9), i4(12), f4(7, 8))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("block", "shard", "at", "n", "change"), r, strict=True)) for r in part]) for part in (rows[:3], rows[3:])]
    got = {r["block"]: (np.frombuffer(r["at"], np.int32).tolist(), np.frombuffer(r["change"], np.float32).tolist()) for b in toxicity._mean(batches) for r in b.to_pylist()}
    assert got == {-1: ([0, 1], [4, 2]), 3: ([7, 9], [1, 2, 6, 7])}


# --- 5 -----------------------------------------------------------------------


def test_licenses_are_found_and_confirmed(spark, hostile, empty):
    text = licenses.TEMPLATES[3][1]
    rows = [(i, f"some prose here.\n\n{t}\n\nmore prose") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100, text.replace("free of charge", "free of any charge")), (101, "we need permission to sell licensed goods in the public domain today"), (102, "word " * 5000 + "\nReleased under the MIT license\n" + "word " * 5000), (103, None)]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert [r["license"] for r in got[i]] == [name] and got[i][0]["n_differences"] == 0 and got[i][0]["saved"] > 0.5
    assert got[100][0]["license"] == "MIT" and got[100][0]["n_differences"] == 1 and "any" in got[100][0]["differences"][0]
    assert 101 not in got and [r["license"] for r in got[102]] == ["MIT"]
    assert rows[-2][1][got[102][0]["start"] : got[102][0]["stop"]] == "Released under the MIT license"
    assert licenses.scan(hostile).collect() == [] and licenses.scan(empty).collect() == []


def test_licenses_are_found_in_long_lines_of_many_notices():
    rng, scanner = random.Random(5), licenses.Scanner()
    for name, template in licenses.TEMPLATES:
        flat = " ".join(template.split())
        for n in (50, 1000, 10000):
            before = prose(rng, n)
            got = scanner.scan(f"{before} {flat} {prose(rng, n)}")
            assert [(x[0], x[1], x[4]) for x in got] == [(name, len(before) + 1, 1.0)] and got[0][3] > 0
    # more licenses in a line than were once compared
    short = [t for t in licenses.TEMPLATES if len(t[1].split()) < 20]
    got = scanner.scan(" ".join(f"{prose(rng, 30)} {' '.join(t.split())}" for _, t in short))
    assert len(short) > 4 and [x[0] for x in got] == [name for name, _ in short]


def test_licenses_are_found_each_time_a_line_states_them():
    rng, scanner = random.Random(6), licenses.Scanner()
    for name, template in licenses.TEMPLATES:
        flat = " ".join(template.split())
        for gap in (0, 1, 40, 400):
            text, starts = prose(rng, 3), []
            for _ in range(4):
                starts.append(len(text) + 1)
                text += f" {flat} {prose(rng, gap)}".rstrip()
            got = scanner.scan(text)
            assert [(x[0], x[1], x[4], x[5]) for x in got] == [(name, at, 1.0, []) for at in starts]
    # beside a verbatim notice, one with a changed word, and scattered words that are no notice
    flat = " ".join(licenses.TEMPLATES[3][1].split())
    changed = flat.replace("free of charge", "free of any charge")
    got = scanner.scan(f"{' '.join(sorted(flat.split()))} {prose(rng, 300)} {changed} {flat} {prose(rng, 9)} {changed}")
    assert [(x[0], len(x[5])) for x in got] == [("MIT", 1), ("MIT", 0), ("MIT", 1)]


def brute_runs(template, w):
    """All runs of words whose longest common subsequence with the template is long enough, by plain loops."""
    out = []
    for first in range(len(w)):
        row = [0] * (len(template) + 1)
        for last in range(first + 1, min(len(w), first + 3 * len(template)) + 1):
            new = [0]
            for j, x in enumerate(template):
                new.append(row[j] + 1 if x == w[last - 1] else max(row[j + 1], new[j]))
            row = new
            if 2 * row[-1] >= licenses.LEAST * (len(template) + last - first) - 1e-9:
                out.append((first, last, row[-1]))
    return out


def test_licenses_equal_brute_force():
    """Of texts with notices that are cut, changed and mixed: a template is found just if some run is similar enough, and the best run of each place is among those found."""
    rng, scanner = random.Random(7), licenses.Scanner()
    short = [i for i, (_, w) in enumerate(scanner.templates) if len(w) <= 30]
    pool = [x for i in short for x in scanner.templates[i][1]]
    hits = 0
    for _ in range(120):
        w = []
        for _ in range(rng.randrange(1, 4)):
            own = list(scanner.templates[rng.choice(short)][1])
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(0, 2)] = rng.choices([*pool, "zz"], k=rng.randrange(0, 2))
                own = own or ["zz"]
            w += own + rng.choices([*pool, "zz"], k=rng.randrange(0, 6))
        block = np.array([scanner.number.get(x, len(scanner.number)) for x in w], np.int32)
        found = set()
        for i in short:
            template = scanner.templates[i][1]
            want, got = brute_runs(template, w), scanner.runs(block, i)
            points = {(a, b): licenses.SAME * own - licenses.EACH * (b - a) for a, b, own in want}
            assert bool(want) == bool(got) and all(points[a, b] == p for p, a, b in got)
            # no run that is left over lies outside all of those found, and none found is worse than all that it overlaps
            assert all(any(a < y and x < b for _, x, y in got) for a, b in points)
            if got:
                assert max(p for p, _, _ in got) == max(points.values())
            found |= {i} if want else set()
            hits += bool(want)
        assert bool(scanner.scan(" ".join(w))) == bool(found)
    assert hits > 100


def test_licenses_gate_passes_every_match():
    """Templates with as many words gone as a match allows, whichever they are."""
    import re

    rng, scanner, holds = random.Random(8), licenses.Scanner(), re.compile(licenses.gate(), re.IGNORECASE)
    for i, (name, template) in enumerate(scanner.templates):
        for trial in range(60):
            keep = list(range(len(template)))
            if trial == 0:  # the words of the gate go first
                keep.sort(key=lambda k: bool(holds.search(template[k])))
            else:
                rng.shuffle(keep)
            keep = sorted(keep[: -(-len(template) * licenses.EACH // (licenses.SAME - licenses.EACH))])
            w = [template[k] for k in keep]
            assert scanner.runs(np.array([scanner.number[x] for x in w], np.int32), i) and holds.search(" ".join(w)), name


def test_licenses_across_paragraphs_and_in_very_long_texts(spark):
    flat = licenses.TEMPLATES[3][1].replace("conditions: The", "conditions:\n\nThe").replace("Software.\nTHE", "Software.\n\nTHE")
    rng = random.Random(9)
    rows = [(1, f"Copyright (c) some one\n\n{flat}\n"), (2, prose(rng, 120_000) + " Released under CC BY-NC 4.0. " + prose(rng, 120_000)), (2, "Released under CC BY-NC 4.0."), (2, "Released under CC BY-NC 4.0."), (None, "\u212aey. LICENSED UNDER THE APACHE LICENSE, VERSION 2.0")]
    got = sorted((r["doc_id"] or 0, r["license"], r["n_differences"]) for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).collect())
    assert got == [(0, "Apache-2.0", 0), (1, "MIT", 0), (2, "CC-BY-NC-4.0", 1), (2, "CC-BY-NC-4.0", 1), (2, "CC-BY-NC-4.0", 1)]


# --- 6 -----------------------------------------------------------------------


def multiset(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_leaks(docs, items, threshold=0.8):
    out = {}
    for i, d in docs:
        w = (d or "").lower().split()
        for j, t in items:
            x = (t or "").lower().split()
            k = min(5, len(x))
            if not x or len(w) < k:
                continue
            own = multiset(x, k)
            best = max(sum((own & (a := multiset(w[s : s + len(x)], k))).values()) / sum((own | a).values()) for s in range(max(1, len(w) - len(x) + 1)))
            if best >= threshold:
                out[i, j] = round(best, 6)
    return out


def test_leaks_equal_brute_force(spark, empty):
    rng = random.Random(6)
    items = [(j, prose(rng, n, 60)) for j, n in enumerate((15, 20, 33, 59, 8, 5, 3, 1))] + [(90, None), (91, " "), (None, prose(rng, 25, 60)), (92, " ".join(["a"] * 30))]
    docs = [(0, None), (1, ""), (2, "a " * 100), (3, " ".join(["a"] * 28))]
    for i in range(10, 70):
        w = prose(rng, rng.randrange(0, 80), 400).split()
        t = rng.choice(items[:4])[1].split()
        kind = i % 5
        if kind == 1:
            del t[rng.randrange(len(t))]
        elif kind == 2:
            t[rng.randrange(len(t))] = "new"
        elif kind == 3:
            t = t[len(t) // 2 :] + t[: len(t) // 2]
        elif kind == 4:
            t = t[: max(1, int(len(t) * 0.9))]
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + t + w[at:]).upper()))
    docs.append((docs[-1][0], docs[-1][1]))
    want = brute_leaks(docs, items)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    items_df = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, digest string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontamination.leaks(df, items_df).collect()}
    assert got == want and len(want) > 20
    left = decontamination.decontaminate(df, items_df)
    bad = {i for i, _ in want}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in docs if i not in bad) and left.columns == df.columns
    assert decontamination.leaks(empty, items_df).collect() == [] and decontamination.leaks(df, items_df.limit(0)).collect() == []


def test_leaks_of_a_large_benchmark_are_joined_by_hash(spark, monkeypatch):
    rng = random.Random(16)
    items = [(j, prose(rng, rng.randrange(3, 60), 80)) for j in range(12)]
    docs = [(None, items[5][1])]
    for i in range(60):
        w = prose(rng, 40, 500).split()
        t = rng.choice(items)[1].split()
        t[rng.choice((0, -1))] = "new"
        docs.append((i % 50, " ".join(w[:20] + t + w[20:])))
    df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for small in (decontamination.SMALL, 0):
        monkeypatch.setattr(decontamination, "SMALL", small)
        found.append(sorted(map(str, decontamination.leaks(df, items_df).collect())))
    assert found[0] == found[1] and len(found[0]) > 20


def test_fingerprints_of_similar_windows_are_within_the_radius(spark):
    """Recall of the Hamming blocks on planted windows with similarities just over 0.8 and 0.9: all are found."""
    rng = random.Random(17)
    items, docs, want = [], [], set()
    for j in range(150):
        w = prose(rng, rng.randrange(30, 90), 10**6).split()
        items.append((j, " ".join(w)))
        for least in (0.8, 0.9):
            best = None
            for n in range(1, 12):  # words cut off the end, as far as the similarity allows
                if (len(w) - n - 4) / (len(w) - 4) >= least:
                    best = w[:-n]
            if best:
                # the window is as long as the item: what follows differs
                both = len(best) - 4
                if both / (2 * (len(w) - 4) - both) >= 0.8:
                    want.add((len(docs), j))
                docs.append((len(docs), f"{prose(rng, 30, 10**6)} {' '.join(best)} {prose(rng, 30, 10**6)}"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 100


def test_stride_keeps_every_window():
    for least in range(1, 60):
        m = decontamination.stride_for(least, 0.2)
        assert all(x // m - math.floor(0.2 * x + 1e-9) >= 1 for x in range(least, 2000)) or m == 1


# --- 7 -----------------------------------------------------------------------


def brute_components(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    lows = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            lows[find(a)] = min(i, lows.get(find(a), i))
    return Counter((i, len(s), lows.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(hostile, percent):
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    got = minhash_dedup.near_duplicates(hostile, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None) for r in got if r["doc_id"] is not None)


def test_profiles_drop_no_link():
    rng = np.random.default_rng(2)
    profile = lambda x: np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8)[None]
    dropped = 0
    for n in (1, 20, 150, 3000, 70_000):
        for share in (0.0, 0.5, 0.84, 0.86, 0.95, 1.0):
            both = rng.integers(0, 1 << 64, max(1, int(n * 2 * share / (1 + share))), dtype=np.uint64)
            a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 64, max(0, n - len(both)), dtype=np.uint64)))) for _ in "ab")
            shared = len(np.intersect1d(a, b))
            linked = 100 * shared >= 85 * (len(a) + len(b) - shared)
            may = minhash_dedup.may_link(profile(a), profile(b), np.array([len(a)]), np.array([len(b)]), 85)[0]
            assert may or not linked
            dropped += not may
    assert dropped >= 8


def test_near_duplicates_of_a_large_cloud(spark, monkeypatch):
    """Copies around one text with many or few edits: links run between some of them only."""
    monkeypatch.setattr(minhash_dedup, "SPLIT_AT", 3)
    rng = random.Random(8)
    base = prose(rng, 100).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(1, 3)] = [f"n{rng.randrange(10**6)}"] * rng.randrange(0, 3)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 85)


def test_keep_one_leaves_clean_rows(hostile, empty):
    kept = minhash_dedup.keep_one(hostile, 80)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == hostile.columns
    assert ids[1] == ids[2] == ids[3] == ids[4] == ids[11] == ids[14] == 1 and ids[7] == 1 and not ids[8] and not ids[16] and ids[13] == 1 and not ids[15]
    assert minhash_dedup.near_duplicates(empty).collect() == []


# --- 8 -----------------------------------------------------------------------


def plain_cosine_hash(rows):
    """The low-frequency cosine hash by the transform's definition, in plain loops."""
    def shrink(v):
        n = len(v)
        if n < 32:
            return [v[i * n // 32] for i in range(32)]
        edges = [i * n // 32 for i in range(33)]
        return [sum(v[a:b]) / (b - a) for a, b in zip(edges, edges[1:], strict=False)]

    small = [shrink(list(map(float, c))) for c in zip(*rows, strict=True)]  # by column: rows shrunk
    small = [shrink([c[r] for c in small]) for r in range(32)]
    flat = [sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    flat = [round(x, 6) for x in flat]
    rest = sorted(flat[1:])
    bits = "".join("1" if x > rest[31] else "0" for x in flat)
    return f"{int(bits, 2):016x}"


def test_images_restore_payloads(spark, hostile, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in hostile.collect()]
    images = media.encode_texts(hostile)
    want, plain = Counter(), {}
    for i, data in rows:
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        form = media.store(data)
        assert media.decode_png(form).tobytes() == padded
        want[i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(form), hashlib.sha256(form).hexdigest()] += 1
        plain[hashlib.sha256(form).hexdigest()] = [padded[k : k + 64] for k in range(0, len(padded), 64)]
    got = media.describe(images).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    close = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    # coefficients that tie with the median by rounding may fall on either side
    assert all(close(r["feature"], plain_cosine_hash(plain[r["media_sha256"]])) <= 1 for r in got)
    assert media.describe(media.encode_texts(empty)).collect() == []
    odd = spark.createDataFrame([(1, 5, None, "x")], media.STORED + ", feature string")
    assert tuple(media.describe(odd).first()) == (1, 5, None, None, None, None, None, None)
    bad = spark.createDataFrame([(1, 5, bytearray(media.store(b"hello")[:-3]))], media.STORED)
    with pytest.raises(Exception, match="cut short"):
        media.describe(bad).collect()


def test_png_filters_and_checksums():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (17, 9), dtype=np.uint8)
    for kind in (0, 1, 2, 3, 4, (0, 1, 2), (0, 1, 2, 3, 4)):
        assert (media.decode_png(media.encode_png(rows, kind)) == rows).all()
    smooth = np.cumsum(rng.integers(-2, 3, (40, 64)), axis=1).astype(np.uint8)
    assert len(media.encode_png(smooth, (0, 1, 2, 3, 4))) < len(media.encode_png(smooth))
    for height in (1, 3, 40):
        types = rng.integers(0, 5, height).astype(np.uint8)
        image = rng.integers(0, 256, (height, 12), dtype=np.uint8)
        lines = np.zeros_like(image)
        for bpp in (1, 3):
            for r, kind in enumerate(types):
                for i in range(12):
                    a = int(image[r, i - bpp]) if i >= bpp else 0
                    b = int(image[r - 1, i]) if r else 0
                    c = int(image[r - 1, i - bpp]) if r and i >= bpp else 0
                    p = a + b - c
                    paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    lines[r, i] = (int(image[r, i]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
            assert (media.unfilter(lines, types, bpp) == image).all()
            assert (media.filtered(image, bpp)[types, np.arange(height)] == lines).all()
    with pytest.raises(ValueError):
        media.unfilter(lines, np.full(len(lines), 5, np.uint8), 1)
    good = media.encode_png(rows)
    for at in (20, len(good) // 2, len(good) - 3):
        with pytest.raises(ValueError):
            media.decode_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(good[:-12])


def test_cosine_hash_holds_for_like_images():
    rng = np.random.default_rng(1)
    a = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    c = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    apart = lambda x, y: bin(int(media.cosine_hash(x), 16) ^ int(media.cosine_hash(y), 16)).count("1")
    assert apart(a, b) <= 4 < apart(a, c)


# --- 9 -----------------------------------------------------------------------


def test_chats_read_back_exactly(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\[INST]", "[\\INST]", "\\\\</s>", "", None, "é🎉", "[ROLE]x[TEXT]", "<s", "[", "<end>", "\\", "\n\n"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "[INST]"]), rng.choice(nasty)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "null id"), (50, None, "user", "a"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, string string")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode()))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    segments = chat.format_chats(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(segments).collect()}
    assert got == want
    size = {r[0]: r[1] for r in segments.groupBy("conv_id").agg({"string": "max"}).collect()}
    assert set(size) == set(want)


def test_order_of_turns(spark):
    def ok(*roles):
        df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return chat.read_back(chat.format_chats(df)).first()["in_order"]

    assert ok("user", "assistant") and ok("system", "user", "assistant", "user")
    assert not ok("assistant") and not ok("user", "user") and not ok("user", "system") and not ok("system", "assistant")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(empty)).collect() == []


# --- 10 ----------------------------------------------------------------------


def brute_capacity(sizes, shards):
    def need(c):
        n, fill = 1, 0
        for s in sizes:
            if s > c:
                return shards + 1
            if fill + s > c:
                n, fill = n + 1, 0
            fill += s
        return n

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_equal_brute_force(spark, hostile, shards):
    rng = random.Random(10)
    more = spark.createDataFrame([(100 + i, prose(rng, rng.randrange(1, 60), 50), "en", "k", 1) for i in range(400)], SCHEMA)
    docs = hostile.union(more)
    rows = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r["h"] % (1 << 64)] += len((r["text"] or "").encode()) + 16
    best = brute_capacity([groups[h] for h in sorted(groups)], shards)
    got = sharding.shard(docs, shards).collect()
    fill, slots = Counter(), defaultdict(list)
    for r in got:
        fill[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    even = brute_even([groups[h] for h in sorted(groups)], shards, best)
    assert len(got) == len(rows) and max(fill.values()) == best and [fill[k] for k in range(shards)] == even
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in rows)
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == crc
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def brute_even(sizes, shards, capacity):
    """Sizes of shards by trying, for each cut, all places that leave a feasible rest."""

    def fits(rest, n):
        if len(rest) < n:
            return False
        k, fill = 1, 0
        for s in rest:
            if s > capacity:
                return False
            if fill + s > capacity:
                k, fill = k + 1, 0
            fill += s
        return k <= n

    out = []
    for left in range(min(shards, len(sizes)), 1, -1):
        goal, best = sum(sizes) / left, None
        for k in range(1, len(sizes)):
            if sum(sizes[:k]) <= capacity and fits(sizes[k:], left - 1) and (best is None or abs(sum(sizes[:k]) - goal) < abs(sum(sizes[:best]) - goal)):
                best = k
        out.append(sum(sizes[:best]))
        sizes = sizes[best:]
    return [*out, sum(sizes)]


def test_even_cuts_equal_brute_force():
    rng = random.Random(11)
    for trial in range(60):
        n, shards = rng.randrange(1, 40), rng.randrange(1, 12)
        sizes = [rng.choice((1, 5, rng.randrange(1, 30), rng.randrange(1, 200 if trial % 3 else 20))) for _ in range(n)]
        capacity = brute_capacity(sizes, shards)
        ranges = sharding.Ranges([(i << 32, 32, s, 1) for i, s in enumerate(sizes)])
        assert ranges.least(shards, False) == capacity
        cuts = [0, *(k for k, _ in ranges.even(shards, capacity)), n]
        assert [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] == brute_even(sizes, shards, capacity)


def test_shards_of_many_texts_are_even(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', CAST(id % 50000 AS STRING)) AS text")
    fill = [r[0] for r in sharding.shard(docs, 40).groupBy("shard").agg({"size": "sum"}).collect()]
    assert len(fill) == 40 and max(fill) - min(fill) <= 120


def test_no_rows_no_shards(empty):
    assert sharding.shard(empty).collect() == []


# --- all ---------------------------------------------------------------------


def test_queries_run_on_the_smallest_tables(spark):
    for name, f in queries.QUERIES.items():
        table_ = {"op3": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
        rows = spark.read.parquet(f"{SMALL}/{table_}.parquet")
        got = f(spark, SMALL).count()
        if name.split("_")[0] not in ("op5", "op6"):
            assert got == (rows.select("conv_id").distinct().count() + 1 if table_ == "conversations" else rows.count()), name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE_SQL[name]) is None
