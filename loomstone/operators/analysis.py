"""Reports over block tables: inspection, differences, lineage, copy plans and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import columns as C
from loomstone.functions import codecs
from loomstone.operators import chunking
from loomstone.operators.archive import Archive
from loomstone.operators.lineage import cut, running_sums


def inspect(archive: Archive, streams: tuple = ("main",)) -> DataFrame:
    """One row of counts and sizes by kind of block. Payloads are only read where they are compressed or sealed."""
    b = archive.blocks.where(F.col("stream").isin(*streams))
    data = F.col("kind") == "data"
    per = b.groupBy("kind", "store_id").agg(F.count(F.lit(1)).alias("n"), F.sum("logical_len").alias("bytes"), F.max("logical_len").alias("most"), F.min("logical_len").alias("least"))
    if archive.config.compression or archive.config.key:
        lengths = archive.store.select(F.col("store_id").alias("_id"), "stored_len")
        per = per.where(data).join(lengths, F.col("store_id") == F.col("_id")).drop("_id").unionByName(per.where(~data).withColumn("stored_len", F.lit(None).cast("long")))
    else:
        per = per.withColumn("stored_len", F.when(data, F.col("most")))
    total = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return per.agg(
        total(F.sum("n")).alias("total_blocks"),
        total(F.sum(F.when(data, F.col("n")))).alias("data_blocks"),
        total(F.sum(F.when(F.col("kind") == "zero", F.col("n")))).alias("zero_blocks"),
        total(F.sum(F.when(F.col("kind") == "parent", F.col("n")))).alias("parent_blocks"),
        total(F.sum(F.when(data, F.lit(1)))).alias("unique_blocks"),
        total(F.sum("bytes")).alias("logical_bytes"),
        total(F.sum(F.when(data, F.col("bytes") - F.col("most")))).alias("duplicate_bytes"),
        total(F.sum(F.when(data, F.col("n") * F.col("stored_len")))).alias("stored_bytes_by_reference"),
        total(F.sum(F.when(data, F.col("stored_len")))).alias("stored_bytes"),
        total(F.min(F.when(data, F.col("least")))).alias("min_block"),
        total(F.max(F.when(data, F.col("most")))).alias("max_block"),
        total(F.floor(F.sum(F.when(data, F.col("bytes"))) / F.sum(F.when(data, F.col("n"))))).alias("avg_block"),
    )


def compression_ratio(logical, stored):
    """Logical bytes for each stored one; 0 where nothing is stored."""
    return F.when(stored == 0, F.lit(0.0)).otherwise(logical / stored)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks and bytes that two archives share, and that are new in b or gone from a: by hash, zero blocks aside. share: of b's bytes, at least 1, in percent."""
    hashes = lambda x, name: x.where("hash is not null and kind <> 'zero'").groupBy("hash").agg(F.min("logical_len").alias(name))
    both = hashes(a, "a").join(hashes(b, "b"), "hash", "full_outer")
    label = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").otherwise("shared")
    per = both.groupBy(label.alias("state")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.coalesce("b", "a")).cast("long").alias("bytes"))
    # Three rows at most.
    of_b = per.where("state <> 'removed'").agg(F.greatest(F.lit(1), F.coalesce(F.sum("bytes"), F.lit(0))).alias("of_b"))
    return per.join(F.broadcast(of_b)).select("state", "blocks", "bytes", F.when(F.col("state") != "removed", 100.0 * F.col("bytes") / F.col("of_b")).alias("share"))


def _known(archives: DataFrame, name: str) -> int:
    """Names archives (archive_id, parent_id) for SQL, and tells how many there are at most."""
    kept = cut(archives.select("archive_id", "parent_id"))
    kept.createOrReplaceTempView(name)
    return kept.count() + 2


def lineage(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """archive_id, depth and path of archives (archive_id, parent_id) below their roots; a parent that is not listed makes a root. A cycle is an error."""
    most = _known(archives, "loomstone_archives")
    tree = cut(spark.sql(f"""
        WITH RECURSIVE tree(archive_id, depth, path) MAX RECURSION LEVEL {most} AS (
            SELECT a.archive_id, 0, a.archive_id FROM loomstone_archives a LEFT ANTI JOIN loomstone_archives p ON a.parent_id = p.archive_id
            UNION ALL
            SELECT a.archive_id, t.depth + 1, concat(t.path, '/', a.archive_id) FROM tree t JOIN loomstone_archives a ON a.parent_id = t.archive_id
        )
        SELECT archive_id, depth, path FROM tree
    """))
    lost = spark.table("loomstone_archives").join(tree, "archive_id", "left_anti").select("archive_id").limit(1).collect()
    if lost:
        raise ValueError(f"archive {lost[0][0]} is its own ancestor, or builds on one that is")
    return tree


def closure(spark: SparkSession, archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """archive_id and depth of the wanted archives and all they build on; depth is the greatest distance from a wanted one. A cycle exceeds the recursion level, which is an error."""
    most = _known(archives, "loomstone_archives")
    wanted.select("archive_id").createOrReplaceTempView("loomstone_wanted")
    return spark.sql(f"""
        WITH RECURSIVE need(archive_id, depth) MAX RECURSION LEVEL {most} AS (
            SELECT archive_id, 0 FROM loomstone_wanted
            UNION ALL
            SELECT DISTINCT a.parent_id, n.depth + 1 FROM need n JOIN loomstone_archives a ON a.archive_id = n.archive_id WHERE a.parent_id IS NOT NULL
        )
        SELECT archive_id, max(depth) AS depth FROM need GROUP BY archive_id
    """)


def copy_plan(spark: SparkSession, archives: DataFrame, wanted: DataFrame, there: DataFrame) -> DataFrame:
    """What to send, in which order (parents first): the closure without what `there` lists."""
    need = closure(spark, archives, wanted).join(there.select("archive_id"), "archive_id", "left_anti")
    order = need.select("archive_id", (-F.col("depth")).alias("order"))
    return running_sums(order, ["order", "archive_id"], {"before": F.lit(1)}).select("archive_id", (F.col("before") + 1).cast("int").alias("step"))


def predict(files: DataFrame, block: int, params: chunking.ChunkParams, samples: int | None = None) -> DataFrame:
    """For each file (path, content): shares of zero and repeated blocks, entropy and codec ratios, and the savings they promise.

    samples bounds the blocks looked at in a file, evenly spaced; all by default.
    """
    step = F.greatest(F.lit(block), F.floor(F.octet_length("content") / samples)) if samples else F.lit(block)
    at = files.where(F.octet_length("content") > 0).select("path", "content", F.octet_length("content").cast("long").alias("size"), step.cast("int").alias("step"))
    at = at.select("path", "size", F.explode(F.expr("transform(sequence(0, CAST(size - 1 AS INT), step), p -> substring(content, p + 1, " + str(block) + "))")).alias("b"))
    zero = C.is_zero(F.col("b"))
    seen = at.select("path", "size", F.octet_length("b").cast("long").alias("n"), zero.alias("zero"), C.hash_expr(F.col("b")).alias("h"), F.when(~zero, codecs.entropy("b")).alias("e"), *(F.when(zero, 20).otherwise(F.octet_length(codecs.compress(c)("b"))).alias(c) for c in ("lz4", "zstd")))
    per = seen.groupBy("path", "size", "h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.sum("n").alias("bytes"), F.sum(F.col("zero").cast("int")).alias("zeros"), F.sum("e").alias("e"), F.sum((F.col("e") > 6).cast("int")).alias("high"), F.sum("lz4").alias("lz4"), F.sum("zstd").alias("zstd"))
    fixed = per.groupBy("path", "size").agg(
        F.sum("k").alias("blocks"), (F.sum("zeros") / F.sum("k")).alias("zero_share"), F.coalesce(F.sum("e") / (F.sum("k") - F.sum("zeros")), F.lit(0.0)).alias("mean_entropy"), F.coalesce(F.sum("high") / F.sum("k"), F.lit(0.0)).alias("high_entropy_share"),
        (F.sum("n") / F.sum("bytes")).alias("fixed_dedup_ratio"), (F.sum("lz4") / F.sum("bytes")).alias("lz4_ratio"), (F.sum("zstd") / F.sum("bytes")).alias("zstd_ratio"),
    )
    chunks = chunking.content_blocks(files.select("path", "content"), params).groupBy("path", C.hash_expr(F.col("content")).alias("h")).agg(F.count(F.lit(1)).alias("k"))
    cdc = chunks.groupBy("path").agg((F.count(F.lit(1)) / F.sum("k")).alias("cdc_dedup_ratio"))
    joined = fixed.join(cdc, "path")
    best = F.least(F.col("fixed_dedup_ratio"), F.col("cdc_dedup_ratio")) * F.least("lz4_ratio", "zstd_ratio")
    return joined.withColumn("estimated_bytes", F.floor(F.col("size") * best)).withColumn("best_savings_pct", 100 * (1 - best))


def optimize_params(spark: SparkSession, totals: DataFrame, wide: bool = False) -> DataFrame:
    """For each row (name, total, unique) the parameters with the least predicted ratio; of equals the smallest f."""
    top, shift, factor, cap = (24, 8, 16, 1 << 26) if wide else (18, 4, 8, 1 << 20)
    g = spark.range(10, top + 1).select(F.col("id").cast("double").alias("f"))
    g = g.select("f", F.greatest(F.lit(1024.0), F.floor(F.pow(F.lit(2.0), "f") / shift).cast("double")).alias("m"), F.least(F.lit(float(cap)), F.pow(F.lit(2.0), "f") * factor).alias("z"))
    base = {k: F.lit(float(v)) for k, v in C.BASELINE.items()}
    rated = totals.withColumn("c", C.change_rate(F.col("total"), F.col("unique"), base["f"], base["m"], base["z"])).join(F.broadcast(g))
    rated = rated.withColumn("ratio", C.predicted_ratio(F.col("total"), F.col("f"), F.col("m"), F.col("z"), base["w"], base["v"], F.col("c")))
    best = rated.groupBy("name").agg(F.min_by(F.struct("f", "m", "z", "ratio"), F.struct("ratio", "f")).alias("x"))
    return best.select("name", F.col("x.f").cast("int").alias("f"), F.col("x.m").cast("long").alias("m"), F.col("x.z").cast("long").alias("z"), F.col("x.ratio").alias("ratio"))


def delta_tensors(metadata: DataFrame) -> DataFrame:
    """archive_id, number and bytes of tensors that are stored as differences, from metadata (archive_id, metadata_json)."""
    kind = "struct<tensors: map<string, struct<storage: string, base_length: bigint>>>"
    t = metadata.select("archive_id", F.explode(F.map_values(F.from_json("metadata_json", kind)["tensors"])).alias("t")).where("t.storage = 'xor_delta'")
    return t.groupBy("archive_id").agg(F.count(F.lit(1)).alias("tensors"), F.sum("t.base_length").alias("bytes"))
