"""The pipeline on a small corpus with planted toxic texts, near copies and leaks, against plain Python."""

import random
from collections import defaultdict

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def corpus():
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [(j, " ".join(prose(rng.randrange(15, 40)))) for j in range(8)]
    docs, labels, toxic, leaks = [], [], set(), set()
    for i in range(700):
        w = prose(rng.randrange(8, 90))
        if rng.random() < 0.15:
            toxic.add(i)
            for _ in range(3):
                w[rng.randrange(len(w))] = f"nasty{rng.randrange(10)}"
        elif rng.random() < 0.06:
            leaks.add(i)
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(items)[1].split()
        elif docs and rng.random() < 0.1:
            j = rng.choice([d for d in docs if len(d[1].split()) > 60 and d[0] not in toxic | leaks] or [(0, "a b c d e f g")])
            w = j[1].split()
            w[rng.randrange(len(w))] = "edited"
        docs.append((i, " ".join(w)))
        labels.append((i, int(i in toxic)))
    docs += [(700, ""), (701, None)]
    return items, docs, labels, toxic, leaks


def test_stages_against_brute_force(spark, tmp_path):
    items, docs, labels, toxic, leaks = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = frame.columns
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        assert name == "sentencepiece" or frame.columns == before
    clean = {i for i, _ in docs} - toxic
    assert len(toxic & kept[0]) <= 0.05 * len(toxic) and len(clean - kept[0]) <= 0.01 * len(clean)
    texts = {i: t or "" for i, t in docs}
    sets = {i: shingles(texts[i]) for i in kept[0]}
    parent = {i: i for i in kept[0]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(where[x] for x in s)) if s else ():
            if i < j and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert kept[1] == {i for i in kept[0] if find(i) == i} and len(kept[1]) < len(kept[0])
    own = [shingles(t) for _, t in items]
    assert kept[2] == {i for i in kept[1] if not any(len(x & shingles(texts[i])) >= 0.8 * len(x) for x in own)} and len(leaks & kept[1]) > 10
    rows = frame.collect()
    assert kept[3] == kept[2] and all(r["restored"] and len(r["ids"]) == r["n_ids"] for r in rows)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[3]


def test_stages_on_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, very long texts, columns with clashing names, and tables without rows."""
    rng = random.Random(13)
    long_ = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    twin = " ".join(f"v{rng.randrange(900)}" for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, twin), (4, twin), (5, twin), (None, "alone and without an id"), (None, None), (6, long_), (7, "short \u2581 text")]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", "s", 0, "k", 1) for i, t in rows], f"{COLUMNS}, key string, digest long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        counts.append(frame.count())
        assert name == "sentencepiece" or frame.columns == docs.columns
    assert counts == [10, 8, 8, 8]
    assert {r["doc_id"]: r["restored"] for r in frame.collect()} == {1: True, 2: True, 3: True, 4: True, None: True, 6: True, 7: False}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
