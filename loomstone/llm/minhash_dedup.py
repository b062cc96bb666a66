"""MinHash near-duplicate detection by a multi-index Hamming join.

A text's set holds its distinct 5-word shingles. Texts with equal sets form one
class; classes are compared by b-bit MinHash signatures: `CHUNKS` chunks of
`WIDTH` values of 16 bits. Two signatures that differ in at most
``2 * CHUNKS - 1`` values have, by the pigeonhole principle, a chunk with at
most one wrong value, so each chunk is written out once with each of its values
left open ("enumerating" the allowed error), and equal keys meet. At
a similarity of 0.85, 40 values differ in more than 19 places about once in a
million pairs.

Of the classes that share a key, no list of all pairs is made. Each is first
held against its key's leader, the class that meets the most others over all of its keys and so lies in
the midst of them; the links confirmed join most of them.
Only classes of one key that are then still in different components are
held against each other. Where a key has many of those, its classes are compared by
their rarest shingles instead: sets as similar as asked share one of their first
shingles in any fixed order, at places that leave room for the overlap needed.
Candidates are dropped unread only where counts of shingles by hash range show that
the sets cannot share enough. Every link counts only once confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import WordHasher, as_bytes, cut, joined, mix, pieces, removed, stored

WORDS = 5
CHUNKS, WIDTH = 10, 4
#: Members of a key outside its largest component beyond which rare shingles take the key's place.
SPLIT_AT = 8
#: Rows of a key that are joined in one place, and parts of a key of which it is not known yet how many rows it has.
TOGETHER, PARTS = 128, 8
#: Shingles whose frequency orders the rest; the order decides only how many candidates there are.
ORDERED = 1 << 16

SIGNED = "n_shingles long, set_id binary, signature binary"
#: Ids of at most so many rows (16 bytes each) are broadcast to fetch their texts; more are joined by shuffling.
BROADCAST = 2_000_000
#: Texts to an Arrow batch.
TEXTS = 1000


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; of a shorter text, one hash of all its words."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def sets_of(texts: list[bytes], hasher: WordHasher):
    """The shingle set of each text, in order."""
    for first, last in pieces(texts):
        buf, begins = joined(texts[first:last])
        words, start, _ = hasher.hashes(buf)
        at = np.searchsorted(start, begins)
        for i in range(last - first):
            yield shingles(words[at[i] : at[i + 1]])


def multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1))[:, None]


def signature(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of the set under each hash function."""
    low = np.full(len(by), (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(low, (by * found[None, i : i + 4096]).min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype("<u2")


def _sign(batches):
    hasher, by = WordHasher(), multipliers(CHUNKS * WIDTH)
    for batch in batches:
        sizes, ids, signs = [], [], []
        for found in sets_of(as_bytes(batch.column("text")), hasher):
            sizes.append(len(found))
            ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signs.append(signature(found, by).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())],
            ["doc_id", "digest", "n_shingles", "set_id", "signature"],
        )


def chunk_keys(signs: np.ndarray, chunk: int) -> np.ndarray:
    """(rows, WIDTH) keys of one chunk: one for each value that may be wrong."""
    part = signs[:, chunk * WIDTH : (chunk + 1) * WIDTH].astype(np.uint64)
    keys = np.empty(part.shape, np.uint64)
    for open_ in range(WIDTH):
        x = np.full(len(part), chunk * WIDTH + open_ + 1, np.uint64)
        for j in range(WIDTH):
            if j != open_:
                x = (x << np.uint64(16)) ^ part[:, j]
        keys[:, open_] = x
    return mix(keys)


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, CHUNKS * WIDTH)


def _keys(batches):
    for batch in batches:
        if batch.num_rows:
            keys = np.concatenate([chunk_keys(_signs(batch.column("signature")), c) for c in range(CHUNKS)], axis=1)
            row = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column("class").take(row)], ["key", "class"])


def _frequent(batches):
    """Counts of the shingles that a task sees in several sets, the ORDERED most frequent at most."""
    hasher, seen = WordHasher(), [np.zeros(0, np.uint64)]
    for batch in batches:
        for found in sets_of(as_bytes(batch.column("text")), hasher):
            seen.append(found)
    values, counts = np.unique(np.concatenate(seen), return_counts=True)
    top = np.argsort(-counts, kind="stable")[:ORDERED]
    top = top[counts[top] > 1]
    yield pa.RecordBatch.from_arrays([pa.array(values[top].view(np.int64)), pa.array(counts[top])], ["shingle", "n"])


def _rarest(order, percent: int):
    """The first shingles of each set, rare ones before frequent ones: as many as cannot all be missing from a similar set."""

    def run(batches):
        hasher = WordHasher()
        known, counts = (np.frombuffer(x, t) for x, t in zip(order.value, (np.uint64, np.int64), strict=True))
        for batch in batches:
            rows, token, place, size = [], [], [], []
            for i, found in enumerate(sets_of(as_bytes(batch.column("text")), hasher)):
                at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                often = np.where(known[at] == found, counts[at], 0) if len(known) else np.zeros(len(found), np.int64)
                n = len(found) - -(-percent * len(found) // 100) + 1
                first = np.lexsort((found, often))[:n]
                rows += [i] * len(first)
                token.append(found[first])
                place.append(np.arange(len(first)))
                size += [len(found)] * len(first)
            take = pa.array(rows, pa.int64())
            token = np.concatenate(token) if token else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), batch.column("class").take(take), batch.column("component").take(take), pa.array(np.concatenate(place) if place else [], pa.int64()), pa.array(size, pa.int64())],
                ["key", "class", "component", "place", "size"],
            )

    return run


def _profile(batches):
    """How many shingles of each set lie in each of 256 ranges of hashes; 255 stands for that many or more."""
    hasher = WordHasher()
    for batch in batches:
        rows = [np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for x in sets_of(as_bytes(batch.column("text")), hasher)]
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(rows, pa.binary())], ["class", "profile"])


def _ranges(batches):
    """Profiles over 128 ranges as arrays of whole counts."""
    hasher = WordHasher()
    for batch in batches:
        rows = [np.bincount((x >> np.uint64(57)).astype(np.int64), minlength=128).astype(np.int32) for x in sets_of(as_bytes(batch.column("text")), hasher)]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 128, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("class"), lists], ["class", "ranges"])


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n_a and n_b with these profiles (rows) can be similar enough: they share at most the lesser count of each range."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    full = ((a == 255) | (b == 255)).any(axis=1)
    most = np.where(full, np.minimum(n_a, n_b), most)
    return 100 * most >= percent * (n_a + n_b - most)


def _close(percent: int):
    """Pairs whose signatures differ in at most 2 * CHUNKS - 1 values, or that shingles brought together (exact), and whose profiles allow a link."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (_signs(batch.column("sign_a")) != _signs(batch.column("sign_b"))).sum(axis=1) < 2 * CHUNKS
                near |= np.array(batch.column("exact").to_pylist(), bool)
                a, b = (np.frombuffer(b"".join(batch.column(f"profile_{x}").to_pylist()), np.uint8).reshape(-1, 256) for x in "ab")
                near &= may_link(a, b, *(batch.column(f"n_{x}").to_numpy() for x in "ab"), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return run


def _confirm(percent: int):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            a, b = as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))
            keep, last, own = [], None, None
            for x, y in zip(a, b, strict=True):
                if x != last:
                    last, own = x, next(sets_of([x], hasher))
                other = next(sets_of([y], hasher))
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for all nodes of `links` (a, b).

    Labels are passed along links and then along labels (pointer jumping), so
    the number of rounds grows with the logarithm of a path's length. All tables
    stay distributed; each round ends in a written table.
    """
    spark = links.sparkSession
    both, _ = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels, last = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        step = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("component", "heard").alias("now"), F.col("component").alias("was"))
        ahead = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        step, path = stored(step.join(ahead, step["now"] == ahead["via"]).select("node", F.least("now", "far").alias("component"), "was"), "labels")
        removed(spark, last)
        labels, last = step.select("node", "component"), path
        if step.where(F.col("component") != F.col("was")).isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _texts(source: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text) for the classes in `wanted`. The corpus itself is not shuffled where few are."""
    ids = cut(classes.join(wanted.select("class").distinct(), "class").select("class", F.col("digest").alias("of")))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    found = source.join(ids, digest() == F.col("of")).select("class", "text")
    return cut(found.groupBy("class").agg(F.first("text").alias("text")))


def _links(pairs: DataFrame, classes: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that full sets confirm. Those not marked exact must have near signatures."""
    held = _texts(source, classes, pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))))
    facts = cut(held.select("class", "text").mapInArrow(_profile, "class long, profile binary").join(classes.select("class", "n_shingles", "signature"), "class"), TEXTS)
    a, b = (facts.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"sign_{x}"), F.col("profile").alias(f"profile_{x}")) for x in "ab")
    near = cut(pairs.join(a, "a").join(b, "b").mapInArrow(_close(percent), "a long, b long"), 2 * TEXTS)
    left, right = held.select(F.col("class").alias("a"), F.col("text").alias("text_a")), held.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return cut(near.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"), TEXTS // 4)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and digest (a hash of the text) for each row of `docs` (doc_id, text; other columns are ignored).

    Texts are linked if 100 * |A & B| >= percent * |A | B| of their sets of
    5-word shingles (A-Z lower-cased; words `[^\\x20\\x09-\\x0D]+`); component_id
    is the least doc_id reachable. Null and blank texts have no shingles, link
    with nothing and keep their own doc_id. Rows that repeat a doc_id are
    rows of their own. A null doc_id counts for no minimum: if a component has
    no other, component_id is null and kept is true. An empty table gives none.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(source.withColumn("digest", digest()).mapInArrow(_sign, "doc_id long, digest long, " + SIGNED), TEXTS)
    sets = signed.where("set_id is not null").groupBy("set_id")
    sets = sets.agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min("doc_id").alias("least"), F.min("digest").alias("digest"))
    classes = cut(sets.withColumn("class", F.monotonically_increasing_id()))
    keys = cut(_shared(classes.select("class", "signature").mapInArrow(_keys, "key long, class long")))
    met = keys.groupBy("class").agg(F.sum("n").alias("met"))
    leaders = keys.join(met, "class").groupBy("key").agg(F.max_by("class", F.struct("met", "class")).alias("a"), F.first("n").alias("n"))
    pairs = _by_key(keys, leaders).where(F.col("a") != F.col("class"))
    pairs = cut(pairs.select("a", F.col("class").alias("b"), F.lit(False).alias("exact")).distinct())
    links = _links(pairs, classes, source, percent)
    found = components(links)
    more = _links(cut(_rest(keys, found, classes, source, percent)), classes, source, percent)
    if not more.isEmpty():
        found = components(links.union(more))
    named = classes.join(found, classes["class"] == found["node"], "left").select("set_id", "least", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("linked"))
    # A class without links stands for itself; the classes of a component meet its least doc_id in PARTS places.
    lows = named.where("linked").groupBy("component").agg(F.min("least").alias("low")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = named.withColumn("part", F.pmod(F.xxhash64("set_id"), F.lit(PARTS)).cast("int"))
    by_class = named.join(lows, ["component", "part"], "left").select("set_id", F.coalesce("low", "least").alias("component_id"))
    return (
        signed.join(by_class, "set_id", "left")
        .withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "digest")
    )


def digest():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stands for each group of near duplicates; blank texts all stay.

    Of rows that repeat the doc_id kept, those of the text that is kept count as one.
    """
    found = near_duplicates(docs, percent)
    rows = cut(found.groupBy("doc_id", "digest").agg(F.first("kept").alias("kept"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")))
    named = lambda df: df.select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (digest() == F.col("_gone"))
    left = docs.join(named(rows.where(~F.col("kept"))), same, "left_anti")
    several = rows.where("kept and n > 1 and n_shingles > 0")
    if several.isEmpty():
        return left
    once = docs.join(named(several), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(named(several), same, "left_anti").unionByName(once)


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key another row has too, with how many have it (n)."""
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return keys.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(PARTS)).cast("int")).join(counts, ["key", "part"]).drop("part")


def _by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (key, class, n and more) joined with a table of one row for each key (key, n and more); about TOGETHER rows of a key meet in a place."""
    parts = F.floor(F.col("n") / TOGETHER).cast("int")
    table = table.withColumn("part", F.explode(F.sequence(F.lit(0), parts))).drop("n")
    return rows.withColumn("part", F.pmod(F.xxhash64("class"), parts + 1).cast("int")).join(table, ["key", "part"]).drop("part")


def _rest(keys: DataFrame, found: DataFrame, classes: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a key and are not in one component yet; exact are those of crowded keys that share a rare shingle, too."""
    labelled = cut(keys.join(found, keys["class"] == found["node"], "left").select("key", "class", "n", F.coalesce("component", "class").alias("component")))
    open_ = cut(_open(labelled))
    plain = open_.where(F.col("others") <= SPLIT_AT)
    crowded = open_.where(F.col("others") > SPLIT_AT).select("class", "component").distinct()
    held = cut(_texts(source, classes, crowded).join(crowded, "class"))
    many = held.count()
    near = _met(plain).withColumn("exact", F.lit(False))
    if not many:
        return near
    # At most ORDERED rows come to the driver and go out again.
    often = held.select("text").repartition(max(1, many // 4096)).mapInArrow(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "shingle").limit(ORDERED).collect()
    known, counts = np.array([r["shingle"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)
    order = np.argsort(known)
    sent = keys.sparkSession.sparkContext.broadcast((known[order].tobytes(), counts[order].tobytes()))
    rare = held.select("text", "class", "component").repartition(2 + many // 512).mapInArrow(_rarest(sent, percent), "key long, class long, component long, place long, size long")
    profiles = cut(held.select("class", "text").mapInArrow(_ranges, "class long, ranges array<int>"), TEXTS)
    rare = cut(_open(cut(_shared(cut(rare, TEXTS)))).join(profiles, "class"))
    sizes = F.col("size_x") + F.col("size_y")
    room = (100 + percent) * F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= percent * sizes
    most = F.aggregate(F.zip_with("ranges_x", "ranges_y", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    more = _met(rare, ("place", "size", "ranges"), room & ((100 + percent) * most >= percent * sizes)).withColumn("exact", F.lit(True))
    return near.union(more).groupBy("a", "b").agg(F.max("exact").alias("exact"))


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of keys that meet several components, with the largest one (top) and the number of rows outside it (others)."""
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("key").agg(F.max_by("component", "n").alias("top"), (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("n")).where("others > 0")
    return _by_key(labelled, top)


def _met(open_: DataFrame, more: tuple = (), room=None) -> DataFrame:
    """Pairs (a, b) of one key and two components: one class at least is outside the key's largest component."""
    # The rows of a key meet in parts of about TOGETHER rows (see _by_key); those outside its largest component go to all parts.
    parts = F.floor(F.col("n") / TOGETHER).cast("int")
    few = open_.where(F.col("component") != F.col("top")).select("key", F.explode(F.sequence(F.lit(0), parts)).alias("part"), F.col("class").alias("x"), F.col("component").alias("cx"), *(F.col(c).alias(f"{c}_x") for c in more))
    all_ = open_.select("key", F.pmod(F.xxhash64("class"), parts + 1).cast("int").alias("part"), "top", F.col("class").alias("y"), F.col("component").alias("cy"), *(F.col(c).alias(f"{c}_y") for c in more))
    # of two that both are outside, one holds the other against itself
    once = (F.col("cy") == F.col("top")) | (F.col("x") < F.col("y"))
    met = few.join(all_, (few["key"] == all_["key"]) & (few["part"] == all_["part"]) & (F.col("cx") != F.col("cy")) & once & (F.lit(True) if room is None else room))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
