"""Benchmark decontamination with DataFrame operations only.

An item leaks into a document if an item-sized window of the document's words is
similar to it: the weighted Jaccard similarity of their 5-word shingles (weights:
how often a shingle occurs) is at least the threshold.

1. Probes. A window that similar has at most a share of 1 - threshold of its
   shingles outside the item. So of the document's shingle positions only every
   `stride`-th is looked up among the items' shingles, with the stride chosen so
   that each such window still has probes that match; windows with too few
   matches cannot be similar.
2. Windows that are left get a SimHash of 64 bits, weighted by occurrences.
3. A multi-index join finds all fingerprints within RADIUS: of RADIUS + 1 blocks
   of bits, two such fingerprints share one. A window is joined with the items that
   its probes met, no others: none of those can be similar.
4. The exact similarity decides.

The corpus is read once for each size of shingle. The shingles of a benchmark of up to SMALL
of them travel with the plan; those of a larger one are joined by hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import cut

WORDS = 5
#: Two windows of similarity 0.8 differ in about 10 of 64 bits, in over 23 about once in a million.
RADIUS = 23
#: Shingles of a benchmark (8 bytes each) that are held by the driver and sent with a plan; and rows that are broadcast.
SMALL = 200_000
FIELDS, FIELD_BITS = 3, 21  # counters of SimHash bits packed in a long


def once(column):
    """The column, computed once for each row: a generator keeps the optimizer from copying it into each place that uses it."""
    return F.explode(F.array(column))


def words_of(text):
    """Lower-cased words of a text column."""
    return F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), "")


def shingle_at(words: str, i, k: int):
    """Hash of the k words from position i (from 0)."""
    return F.xxhash64(*(F.get(F.col(words), i + j) for j in range(k)))


def shingles_of(words: str, k: int, stride: int = 1):
    """Hashes at every stride-th position; none if there are fewer than k words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k, F.lit(stride)), lambda i: shingle_at(words, i, k))).otherwise(F.array().cast("array<bigint>"))


def stride_for(least: int, missing: float) -> int:
    """The largest stride at which each run of x >= least positions has more probes than missing * x."""
    # floor(x / m) >= (x - m + 1) / m, and beyond x = 4 * m / (1 - missing * m) the bound always holds
    best = 1
    for m in range(2, 9):
        if missing * m < 1 and all(x // m > missing * x for x in range(max(1, least), least + int(8 * m / (1 - missing * m)) + 2)):
            best = m
    return best


def simhash(hs: str):
    """The fingerprint of a column of shingle hashes; each of them votes once for each bit."""
    zero = F.lit(0).cast("long")

    def votes(j):
        def add(total, h):
            fields = [F.shiftleft(F.shiftrightunsigned(h, j * FIELDS + f).bitwiseAND(F.lit(1).cast("long")), FIELD_BITS * f) for f in range(FIELDS) if j * FIELDS + f < 64]
            return total + reduce(lambda x, y: x.bitwiseOR(y), fields)

        return F.aggregate(hs, zero, add)

    counted = F.array(*(votes(j) for j in range(-(-64 // FIELDS))))

    def bits(counts, size):
        each = [
            F.shiftleft((2 * F.shiftrightunsigned(F.get(counts, j // FIELDS), FIELD_BITS * (j % FIELDS)).bitwiseAND(F.lit((1 << FIELD_BITS) - 1)) > size).cast("long"), j) for j in range(64)
        ]
        return F.aggregate(F.array(*each), zero, lambda x, y: x.bitwiseOR(y))

    # a lambda's variable is computed once, however often it is used
    return F.get(F.transform(F.array(counted), lambda c: bits(c, F.size(hs))), 0)


def numbered(hs: str):
    """Hashes that tell the occurrences of a shingle apart: sets of them intersect as the multisets do."""
    apart = F.get(F.transform(F.array(F.array_sort(hs)), lambda a: F.transform(a, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(a, x)))), 0)
    # where no shingle occurs twice, which is the rule, nothing need be counted
    return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.transform(hs, lambda x: F.xxhash64(x, F.lit(1).cast("long")))).otherwise(apart)


def blocks(fp: str):
    """(number, value) of RADIUS + 1 blocks of a fingerprint's bits, as an array."""
    n, out, at = RADIUS + 1, [], 0
    for b in range(n):
        width = 64 // n + (b < 64 % n)
        out.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) * n + b).cast("int"))
        at += width
    return F.array(*out)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, digest, item_id, start, n_words, distance and similarity for each pair of a document and an item that leaks into it.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are
    lower-cased runs of non-space characters; items of fewer than 5 words are one
    shingle; a document shorter than an item is one window. The best window of a
    pair is given, the first of equals. digest is a hash of the text: rows that
    repeat doc_id and text give one row together. Null and blank texts and items
    leak nothing; null ids stay null; empty tables give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), once(words_of(text)).alias("words"))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0).distinct()
    own = own.withColumn("k", F.least(F.size("words"), F.lit(WORDS))).withColumn("item", F.xxhash64("item_id", "words"))
    found = None
    for k in range(1, WORDS + 1):
        part = cut(own.where(F.col("k") == k).select("item", "item_id", "words", shingles_of("words", k).alias("hs"), (F.size("words") - k + 1).alias("n")))
        total, least = part.agg(F.sum("n"), F.min("n")).first()
        if total:
            got = _leaks(w, part, k, stride_for(max(1, -int(-least * threshold // 1)), 1 - threshold), threshold, total <= SMALL)
            found = got if found is None else found.union(got)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, digest long, item_id long, start int, n_words int, distance int, similarity double")
    return found


def _leaks(w: DataFrame, items: DataFrame, k: int, stride: int, threshold: float, small: bool) -> DataFrame:
    sent = F.broadcast if small else lambda df: df
    by_doc = ["doc_id", "digest"]
    same_doc = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    probes = F.zip_with(shingles_of("words", k, stride), F.sequence(F.lit(0), F.greatest(F.size("words") - k, F.lit(0)), F.lit(stride)), lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    shingles = items.select("item", "n", F.explode("hs").alias("h")).distinct()
    w = w.where(F.size("words") >= k)
    whole = [*by_doc, shingles_of("words", k).alias("hs")]
    if small:
        known = [r[0] for r in shingles.select("h").distinct().collect()]
        hit = w.withColumn("probes", once(F.filter(probes, lambda x: x["h"].isin(known)))).where(F.size("probes") > 0)
        hit = cut(hit.select(*whole, "probes").dropDuplicates(by_doc))
        matches = hit.select(*by_doc, F.size("hs").alias("all"), F.explode("probes").alias("probe")).select(*by_doc, "all", "probe.h", "probe.p").join(F.broadcast(shingles), "h")
    else:
        met = w.select(*by_doc, (F.size("words") - k + 1).alias("all"), F.explode(probes).alias("probe")).select(*by_doc, "all", "probe.h", "probe.p")
        matches = cut(met.join(shingles, "h").distinct())
        docs = matches.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
        hit = cut(w.select(*whole).join(docs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi").dropDuplicates(by_doc))
    # A group is at most the probes of one document.
    groups = matches.groupBy("doc_id", "digest", "item", "n", "all").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    size = F.least("n", "all")
    need = F.greatest(F.lit(1), F.floor(size / stride).cast("int") - F.floor(size * F.lit(1 - threshold) + 1e-9).cast("int"))
    groups = groups.withColumn("size", size).withColumn("need", need).where(F.size("ps") >= F.col("need"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("ps") - F.col("need")),
        lambda i: F.struct(F.greatest(F.lit(0), F.get("ps", i + F.col("need") - 1) - F.col("size") + 1).alias("first"), F.least(F.get("ps", i), F.col("all") - F.col("size")).alias("last")),
    )
    starts = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["first"] <= s["last"]), lambda s: F.sequence(s["first"], s["last"]))))
    asked = groups.select(*by_doc, "item", "n", "size", F.explode(starts).alias("start"))
    windows = asked.groupBy(*by_doc, "n", "size", "start").agg(F.collect_set("item").alias("items"))
    hs = hit.select("doc_id", "digest", "hs")
    parts = windows.join(hs, same_doc(windows, hs)).select(windows["doc_id"], windows["digest"], "items", "n", "start", F.slice("hs", F.col("start") + 1, F.col("size")).alias("hs"))
    # Few bytes but much work: dealt to as many tasks as a shuffle has.
    parts = parts.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by_doc, "start")
    a = parts.select(*by_doc, "items", "n", "start", once(simhash("hs")).alias("fp"), numbered("hs").alias("own"))
    a = a.select(*by_doc, "items", "n", "start", "fp", "own", once(blocks("fp")).alias("blocks")).select("*", F.explode("items").alias("item")).drop("items").select("*", F.explode("blocks").alias("block"))
    b = items.select(F.col("item").alias("item_b"), simhash("hs").alias("fp_item"), numbered("hs").alias("own_item"))
    b = cut(b.select("*", blocks("fp_item").alias("blocks_item")).select("*", F.explode("blocks_item").alias("block_item")))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_item")))
    near = a.join(sent(b), (a["item"] == b["item_b"]) & (a["block"] == b["block_item"])).where(distance <= RADIUS)
    # A pair meets in each block that it shares, and counts in the first.
    first = F.get("blocks", F.array_position(F.zip_with("blocks", "blocks_item", lambda x, y: x == y), True).cast("int") - 1)
    near = near.where(F.col("block") == first).select(*by_doc, "n", "start", "item", distance.alias("distance"), F.size("own").alias("size"), F.size(F.array_intersect("own", "own_item")).alias("shared"))
    exact = near.withColumn("similarity", F.col("shared") / (F.col("n") + F.col("size") - F.col("shared"))).where(F.col("similarity") >= threshold)
    best = exact.groupBy(*by_doc, "item").agg(F.min_by(F.struct("start", "n", "distance", "similarity"), F.struct(-F.col("similarity"), F.col("start"))).alias("best"))
    names = items.select(F.col("item").alias("i"), "item_id")
    return best.join(sent(names), F.col("item") == F.col("i")).select(
        *by_doc, "item_id", "best.start", (F.col("best.n") + k - 1).alias("n_words"), "best.distance", "best.similarity"
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns, into which no item leaks."""
    bad = leaks(docs, items, threshold).select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct()
    bad = cut(bad)
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (digest == F.col("_bad_digest")), "left_anti")
