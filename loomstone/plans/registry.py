"""Named queries over the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import codecs
from loomstone.functions import columns as C
from loomstone.operators import analysis, archive, chunking, tree, workspace
from loomstone.operators.catalog import Catalog
from loomstone.operators.lineage import cut, running_sums, shared_dir
from loomstone.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BLOCK = 512


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path is their number, padded, so that order by path is order by doc_id."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.lit("main").alias("stream"), F.encode("text", "UTF-8").alias("content"), F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("mtime"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"), F.lit("main").alias("stream"), F.encode("html", "UTF-8").alias("content"), F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("mtime"))


def next_version(files: DataFrame) -> DataFrame:
    """The documents after an edit: every file ends in a line more."""
    return files.withColumn("content", F.concat("content", F.encode(F.lit("\nedited\n"), "UTF-8")))


# SQL for blocks of documents, and of the edited version: (doc_id, i, off, len, h).
DOCS = "SELECT doc_id AS id, encode(text) AS b FROM documents"
EDITED = "SELECT doc_id AS id, encode(text || chr(10) || 'edited' || chr(10)) AS b FROM documents"
PAGES = "SELECT page_id AS id, encode(html) AS b FROM pages"


def cut_sql(source: str, block: int = BLOCK) -> str:
    return f"""(SELECT id, i, i * {block} AS off, least({block}, n - i * {block}) AS len, x AS content, sha256(x) AS h FROM
        (SELECT id, n, i, b[i * {block} + 1 : least((i + 1) * {block}, n)] AS x FROM
        (SELECT id, b, octet_length(b) AS n, unnest(range(0, (octet_length(b) + {block - 1}) // {block})) AS i FROM ({source}))))"""


# --- blocks -------------------------------------------------------------------


@register(f"""
    WITH c AS {cut_sql(DOCS)}
    SELECT count(*) AS chunks, count(DISTINCT h) AS unique_chunks, CAST(sum(len) AS BIGINT) AS total_bytes,
           (SELECT CAST(sum(len) AS BIGINT) FROM (SELECT min(len) AS len FROM c GROUP BY h)) AS unique_bytes FROM c
""")
def block_dedup_stats(spark, sf_dir):
    return chunking.stream_stats(chunking.fixed_blocks(documents(spark, sf_dir), BLOCK))


@register(f"SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS path, CAST(i AS INT) AS seq, CAST(off AS BIGINT) AS start, CAST(len AS BIGINT) AS len, h AS hash FROM {cut_sql(DOCS)}")
def fixed_blocks(spark, sf_dir):
    b = chunking.fixed_blocks(documents(spark, sf_dir), BLOCK)
    return b.select("path", "seq", "start", F.octet_length("content").cast("long").alias("len"), C.hash_expr(F.col("content")).alias("hash"))


@register(f"""
    WITH c AS {cut_sql(DOCS)}
    SELECT h AS hash, count(*) AS refs, arg_min(lpad(CAST(id AS VARCHAR), 12, '0'), id * 1000000 + i) AS path, CAST(arg_min(i, id * 1000000 + i) AS INT) AS seq FROM c GROUP BY h
""")
def first_wins_dedup(spark, sf_dir):
    b = chunking.fixed_blocks(documents(spark, sf_dir), BLOCK).select("path", "seq", C.hash_expr(F.col("content")).alias("hash"))
    g = b.groupBy("hash").agg(F.count(F.lit(1)).alias("refs"), F.min(F.struct("path", "seq")).alias("x"))
    return g.select("hash", "refs", "x.path", "x.seq")


@register(f"""
    SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS path, CAST(octet_length(b) AS BIGINT) AS size,
           CAST(coalesce(sum(octet_length(b)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ({DOCS})
""")
def file_offsets(spark, sf_dir):
    return archive.file_offsets(documents(spark, sf_dir)).select("path", "size", "offset")


@register(f"""
    WITH c AS {cut_sql(DOCS)}, f AS (SELECT h, min(id * 1000000 + i) AS place, min(len) AS len FROM c GROUP BY h)
    SELECT h AS hash, CAST(len AS BIGINT) AS stored, CAST(coalesce(sum(len) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS physical FROM f
""")
def physical_offsets(spark, sf_dir):
    b = chunking.fixed_blocks(documents(spark, sf_dir), BLOCK).select("path", "seq", C.hash_expr(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("stored"))
    first = b.groupBy("hash").agg(F.min(F.struct("path", "seq", "stored")).alias("x")).select("hash", "x.*")
    return running_sums(first, ["path", "seq"], {"physical": F.col("stored")}).select("hash", "stored", "physical")


@register(f"""
    WITH c AS (SELECT *, row_number() OVER (ORDER BY id, i) - 1 AS k, coalesce(sum(len) OVER (ORDER BY id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM {cut_sql(DOCS)})
    SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS path, CAST(i // 8 AS BIGINT) AS page_in_file, CAST(min(k) AS BIGINT) AS start_block, CAST(min(place) AS BIGINT) AS start_logical, count(*) AS n_blocks FROM c GROUP BY id, i // 8
""")
def index_pages(spark, sf_dir):
    a = archive.pack(documents(spark, sf_dir), archive.PackConfig(block=BLOCK, page_blocks=8))
    return archive.pages(a.blocks).select("path", "page_in_file", "start_block", "start_logical", "n_blocks")


@register("""
    SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, lang || '/' || source AS folder FROM documents
""")
def manifest(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), F.concat_ws("/", "lang", "source").alias("folder"))


@register("SELECT lang, source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang, source")
def directory_totals(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(F.encode("text", "UTF-8")).cast("long")).alias("bytes"))


# --- archives -----------------------------------------------------------------


@register(f"""
    WITH c AS {cut_sql(DOCS)}, u AS (SELECT h, count(*) AS n, min(len) AS len FROM c GROUP BY h)
    SELECT count(*) AS total_blocks, count(*) AS data_blocks, CAST(0 AS BIGINT) AS zero_blocks, CAST(0 AS BIGINT) AS parent_blocks, count(DISTINCT h) AS unique_blocks,
           CAST(sum(len) AS BIGINT) AS logical_bytes, (SELECT CAST(sum((n - 1) * len) AS BIGINT) FROM u) AS duplicate_bytes, CAST(sum(len) AS BIGINT) AS stored_bytes_by_reference, (SELECT CAST(sum(len) AS BIGINT) FROM u) AS stored_bytes,
           CAST(min(len) AS BIGINT) AS min_block, CAST(max(len) AS BIGINT) AS max_block, CAST(sum(len) // count(*) AS BIGINT) AS avg_block FROM c
""")
def inspect_archive(spark, sf_dir):
    return analysis.inspect(archive.pack(documents(spark, sf_dir), archive.PackConfig(block=BLOCK)))


@register(f"""
    WITH c AS {cut_sql("SELECT doc_id AS id, encode(text || repeat(chr(0), 1500)) AS b FROM documents")},
    k AS (SELECT *, lower(hex(content)) = repeat('0', CAST(2 * len AS INT)) AS zero FROM c)
    SELECT CASE WHEN zero THEN 'zero' ELSE 'data' END AS kind, count(*) AS blocks, CAST(sum(len) AS BIGINT) AS bytes FROM k GROUP BY 1
""")
def zero_blocks(spark, sf_dir):
    padded = documents(spark, sf_dir).withColumn("content", F.concat("content", F.unhex(F.repeat(F.lit("00"), 1500))))
    b = archive.pack(padded, archive.PackConfig(block=BLOCK)).blocks
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum("logical_len").alias("bytes"))


@register(f"""
    WITH a AS (SELECT h, min(len) AS len FROM {cut_sql(DOCS)} GROUP BY h), b AS (SELECT h, min(len) AS len FROM {cut_sql(EDITED)} GROUP BY h)
    SELECT state, blocks, bytes, CASE WHEN state <> 'removed' THEN round(100.0 * bytes / (SELECT sum(len) FROM b), 6) END AS share FROM
    (SELECT CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' ELSE 'shared' END AS state, count(*) AS blocks, CAST(sum(coalesce(b.len, a.len)) AS BIGINT) AS bytes
    FROM a FULL JOIN b ON a.h = b.h GROUP BY 1)
""")
def diff_versions(spark, sf_dir):
    files = documents(spark, sf_dir)
    one, two = archive.pack(files, archive.PackConfig("one", BLOCK)), archive.pack(next_version(files), archive.PackConfig("two", BLOCK))
    return analysis.diff(one.blocks, two.blocks).withColumn("share", F.round("share", 6))


@register(f"""
    WITH b AS {cut_sql(EDITED)}, k AS (SELECT b.*, b.h IN (SELECT h FROM {cut_sql(DOCS)}) AS old FROM b)
    SELECT CASE WHEN old THEN 'parent' ELSE 'data' END AS kind, count(*) AS blocks, count(DISTINCT h) AS hashes, CAST(sum(len) AS BIGINT) AS bytes FROM k GROUP BY 1
""")
def thin_pack(spark, sf_dir):
    files = documents(spark, sf_dir)
    base = archive.pack(files, archive.PackConfig("one", BLOCK))
    b = archive.pack(next_version(files), archive.PackConfig("two", BLOCK), base).blocks
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("hash").alias("hashes"), F.sum("logical_len").alias("bytes"))


@register(f"""
    WITH o AS (SELECT DISTINCT h FROM {cut_sql(DOCS)}), e AS (SELECT DISTINCT h FROM {cut_sql(EDITED)} WHERE h NOT IN (SELECT h FROM o)),
    t AS {cut_sql(EDITED)}
    SELECT CASE WHEN h IN (SELECT h FROM e) THEN 'two' ELSE 'one' END AS owner, count(*) AS blocks, CAST(sum(len) AS BIGINT) AS bytes FROM t GROUP BY 1
""")
def parent_chain(spark, sf_dir):
    """Three versions, each on the one before: the third one's blocks lead to the first two."""
    files = documents(spark, sf_dir)
    one, two, three = versions(files)
    parents = spark.createDataFrame([("two", "one", 0), ("three", "two", 0)], "archive_id string, parent_id string, ordinal int")
    found = archive.resolve(three.blocks, one.blocks.unionByName(two.blocks).unionByName(three.blocks), parents).where(F.col("found") == F.col("owner"))
    return found.groupBy("owner").agg(F.count(F.lit(1)).alias("blocks"), F.sum("logical_len").alias("bytes"))


def versions(files: DataFrame, **more) -> tuple:
    """Three versions, each on the one before; the third is as the second."""
    one = archive.pack(files, archive.PackConfig("one", BLOCK, **more))
    two = archive.pack(next_version(files), archive.PackConfig("two", BLOCK, **more), one)
    return one, two, archive.pack(next_version(files), archive.PackConfig("three", BLOCK, **more), two)


def whole_files(a: archive.Archive) -> DataFrame:
    """path and digest of each file, put together from its blocks."""
    return archive.file_digests(a).select("path", "digest")


@register("""
    SELECT 'two' AS version, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(encode(text || chr(10) || 'edited' || chr(10))) AS digest FROM documents
    UNION ALL SELECT 'three', lpad(CAST(doc_id AS VARCHAR), 12, '0'), sha256(encode(text || chr(10) || 'edited' || chr(10))) FROM documents
""")
def restore_thin(spark, sf_dir):
    """Files of thin, compressed versions, whose blocks are read from the versions that store them."""
    _, two, three = versions(documents(spark, sf_dir), compression="zstd")
    return whole_files(two).withColumn("version", F.lit("two")).union(whole_files(three).withColumn("version", F.lit("three")))


#: Three ranges in each document, spread over its whole size.
RANGES_SQL = "(SELECT doc_id, k, x, least(length(x) // 2, (length(x) // 2) * k // 3 + doc_id % 97) AS first FROM (SELECT doc_id, hex(encode({text})) AS x, unnest(range(0, 3)) AS k FROM documents))"


def spread_ranges(a: archive.Archive) -> DataFrame:
    ask = a.files.select(F.col("path").cast("long").alias("doc_id"), "path", "size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    first = F.least(F.col("size"), F.floor(F.col("size") * F.col("k") / 3) + F.pmod("doc_id", F.lit(97)))
    return ask.select((F.col("doc_id") * 3 + F.col("k")).alias("request_id"), "path", first.alias("first"), F.lit(1000).cast("long").alias("n"))


@register(f"SELECT doc_id, CAST(k AS INT) AS k, sha256(substr(x, CAST(1 + first * 2 AS BIGINT), 2000)) AS digest FROM {RANGES_SQL.format(text='text')}")
def read_ranges(spark, sf_dir):
    """1000 bytes from three places of each document, read through the blocks; the digest is over their hex digits."""
    a = archive.pack(documents(spark, sf_dir), archive.PackConfig(block=BLOCK))
    got = archive.read_files(a, spread_ranges(a))
    return got.select(F.floor(F.col("request_id") / 3).alias("doc_id"), F.pmod("request_id", F.lit(3)).cast("int").alias("k"), F.sha2(F.hex("bytes"), 256).alias("digest"))


@register(f"SELECT doc_id, CAST(k AS INT) AS k, sha256(substr(x, CAST(1 + first * 2 AS BIGINT), 2000)) AS digest FROM {RANGES_SQL.format(text="text || chr(10) || 'edited' || chr(10)")}")
def read_thin_ranges(spark, sf_dir):
    """The same of a thin version: most bytes come from its parents."""
    _, _, a = versions(documents(spark, sf_dir))
    got = archive.read_files(a, spread_ranges(a))
    return got.select(F.floor(F.col("request_id") / 3).alias("doc_id"), F.pmod("request_id", F.lit(3)).cast("int").alias("k"), F.sha2(F.hex("bytes"), 256).alias("digest"))


@register("SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(encode(text)) AS digest FROM documents")
def restore_files(spark, sf_dir):
    """Files put together again from compressed, deduplicated blocks of variable size."""
    c = archive.PackConfig(params=chunking.ChunkParams(256, 1024, 4096), block=None, compression="zstd")
    return whole_files(archive.pack(documents(spark, sf_dir), c))


@register("SELECT count(DISTINCT h) AS stored, count(DISTINCT h) FILTER (h LIKE '0%') AS corrupt FROM (SELECT sha256(encode(text)) AS h FROM documents WHERE text <> '')")
def audit_store(spark, sf_dir):
    """Of stored payloads those are damaged whose hash begins with 0."""
    a = archive.pack(documents(spark, sf_dir), archive.PackConfig(block=1 << 26, compression="lz4"))
    damaged = F.when(F.col("store_id").startswith("0"), F.concat("payload", F.unhex(F.lit("00")))).otherwise(F.col("payload"))
    a.store = cut(a.store.withColumn("payload", damaged))
    bad = archive.audit(a).agg(F.count(F.lit(1)).alias("corrupt"))
    return a.store.agg(F.count(F.lit(1)).alias("stored")).join(F.broadcast(bad))


@register("SELECT doc_id, sha256(encode(text)) AS restored, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS sealed, FALSE AS plain FROM documents")
def encrypted_blocks(spark, sf_dir):
    key = F.lit(bytes(range(32)))
    d = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    sealed = C.encrypt(F.col("b"), key, F.col("doc_id"))
    both = d.select("doc_id", F.col("b"), sealed.alias("s"))
    plain = (F.octet_length("b") > 16) & (F.expr("substring(s, 1, 16)") == F.expr("substring(b, 1, 16)"))
    return both.select("doc_id", F.sha2(C.decrypt(F.col("s"), key, F.col("doc_id")), 256).alias("restored"), F.octet_length("s").cast("long").alias("sealed"), plain.alias("plain"))


@register(f"""
    WITH d AS (SELECT DISTINCT h FROM {cut_sql(DOCS)}), p AS (SELECT DISTINCT h FROM {cut_sql(PAGES)})
    SELECT 'intersect' AS op, count(*) AS hashes FROM (SELECT h FROM d INTERSECT SELECT h FROM p)
    UNION ALL SELECT 'except', count(*) FROM (SELECT h FROM d EXCEPT SELECT h FROM p)
    UNION ALL SELECT 'union', count(*) FROM (SELECT h FROM d UNION SELECT h FROM p)
""")
def hash_sets(spark, sf_dir):
    hashes = lambda files: chunking.fixed_blocks(files, BLOCK).select(C.hash_expr(F.col("content")).alias("h")).distinct()
    d, p = hashes(documents(spark, sf_dir)), hashes(web_pages(spark, sf_dir))
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("hashes")).select(F.lit(op).alias("op"), "hashes")
    return n(d.intersect(p), "intersect").union(n(d.subtract(p), "except")).union(n(d.union(p).distinct(), "union"))


@register(f"SELECT doc_id, CASE WHEN text <> '' THEN CAST((octet_length(encode(text)) // 2) // {BLOCK} AS INT) END AS seq, CASE WHEN text <> '' THEN CAST((octet_length(encode(text)) // 2) % {BLOCK} AS BIGINT) END AS skip FROM documents")
def block_lookup(spark, sf_dir):
    """The block that holds the middle byte of each document; none of an empty one."""
    a = archive.pack(documents(spark, sf_dir), archive.PackConfig(block=BLOCK))
    middle = F.col("offset") + F.floor(F.col("size") / 2)
    ask = cut(a.files.select(F.col("path").cast("long").alias("request_id"), "stream", middle.alias("first"), F.least(F.lit(1), F.col("size")).alias("n")))
    return ask.select("request_id").join(archive.overlaps(ask, a.blocks), "request_id", "left").select(F.col("request_id").alias("doc_id"), "seq", "skip")


@register(f"""
    WITH c AS {cut_sql(DOCS)}, n AS (SELECT h, count(*) AS places FROM c GROUP BY h) SELECT id AS doc_id, CAST(i AS INT) AS seq, places FROM c JOIN n USING (h)
""")
def blocks_by_hash(spark, sf_dir):
    """In how many places each block of each document is."""
    b = archive.pack(documents(spark, sf_dir), archive.PackConfig(block=BLOCK)).blocks
    return b.select(F.col("path").cast("long").alias("doc_id"), "seq", "hash").join(b.groupBy("hash").agg(F.count(F.lit(1)).alias("places")), "hash").select("doc_id", "seq", "places")


@register("""
    SELECT (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents) AS main_size, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM conversations) AS aux_size
""")
def stream_sizes(spark, sf_dir):
    """Documents in stream main and conversations in stream aux of one archive."""
    c = read(spark, sf_dir, "conversations")
    aux = c.select(F.concat_ws("/", F.lit("chat"), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("path"), F.lit("aux").alias("stream"), F.encode("text", "UTF-8").alias("content"), F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("mtime"))
    a = archive.pack(documents(spark, sf_dir).unionByName(aux), archive.PackConfig(block=BLOCK))
    end = a.blocks.groupBy("stream").agg(F.max(F.col("logical_start") + F.col("logical_len")).alias("n"))
    return end.agg(F.max(F.when(F.col("stream") == "main", F.col("n"))).alias("main_size"), F.max(F.when(F.col("stream") == "aux", F.col("n"))).alias("aux_size"))


@register("SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(encode(text)) AS digest FROM documents")
def restore_encrypted(spark, sf_dir):
    """Files of an encrypted and compressed archive."""
    return whole_files(archive.pack(documents(spark, sf_dir), archive.PackConfig(block=1 << 16, compression="lz4", key=bytes(range(32)))))


@register("SELECT lang AS archive_id, count(*) AS tensors, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE source IN (SELECT max(source) FROM documents UNION ALL SELECT min(source) FROM documents) GROUP BY lang")
def delta_tensors(spark, sf_dir):
    """Documents of the first and last source as tensors stored as differences, all others as whole ones."""
    d = read(spark, sf_dir, "documents")
    ends = d.agg(F.min("source").alias("a"), F.max("source").alias("b"))
    kind = F.when((F.col("source") == F.col("a")) | (F.col("source") == F.col("b")), "xor_delta").otherwise("full")
    entry = F.map_from_arrays(F.array(F.col("doc_id").cast("string")), F.array(F.struct(kind.alias("storage"), F.col("n_chars").alias("base_length"))))
    return analysis.delta_tensors(d.join(F.broadcast(ends)).select(F.col("lang").alias("archive_id"), F.to_json(F.struct(entry.alias("tensors"))).alias("metadata_json")))


# --- stored archives and workspaces ------------------------------------------------


def new_catalog(spark: SparkSession, what: str) -> Catalog:
    from uuid import uuid4

    return Catalog(spark, f"{shared_dir(spark).rstrip('/')}/loomstone/{what}-{uuid4().hex}")


def stored_versions(spark: SparkSession, sf_dir: str, what: str, **more) -> Catalog:
    """Two versions of the documents in a new catalog."""
    catalog, files = new_catalog(spark, what), documents(spark, sf_dir)
    one = catalog.save(archive.pack(files, archive.PackConfig("one", BLOCK, **more)))
    catalog.save(archive.pack(next_version(files), archive.PackConfig("two", BLOCK, **more), one))
    return catalog


@register("SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(encode(text || chr(10) || 'edited' || chr(10))) AS digest FROM documents")
def reopened_archive(spark, sf_dir):
    """Files of a thin archive that was saved and opened again, in a catalog that it was sent to."""
    catalog, other = stored_versions(spark, sf_dir, "reopened", compression="lz4"), new_catalog(spark, "sent")
    assert catalog.send(other, ["two"]) == ["one", "two"] and catalog.send(other, ["two"]) == []
    return whole_files(other.open("two"))


@register(f"""
    WITH a AS {cut_sql(DOCS)}, b AS (SELECT *, h IN (SELECT h FROM a) AS old FROM {cut_sql(EDITED)}), u AS (SELECT h, min(len) AS len FROM a GROUP BY h), v AS (SELECT h, min(len) AS len FROM b WHERE NOT old GROUP BY h)
    SELECT 'one' AS archive_id, 0 AS depth, 'one' AS path, count(*) AS data_blocks, CAST(0 AS BIGINT) AS parent_blocks, CAST(0 AS BIGINT) AS zero_blocks, (SELECT CAST(sum(len) AS BIGINT) FROM u) AS stored_bytes FROM a
    UNION ALL SELECT 'two', 1, 'one/two', count(*) FILTER (NOT old), count(*) FILTER (old), 0, (SELECT CAST(sum(len) AS BIGINT) FROM v) FROM b
""")
def catalog_log(spark, sf_dir):
    return stored_versions(spark, sf_dir, "log").log()


@register(f"""
    WITH a AS {cut_sql(DOCS)}, u AS (SELECT h, min(len) AS len FROM a GROUP BY h)
    SELECT 'one' AS archive_id, 1 AS version, count(*) AS n_blocks, count(DISTINCT h) AS unique_blocks, CAST(sum(len) AS BIGINT) AS total_uncompressed, round(sum(len) / (SELECT sum(len) FROM u), 9) AS compression_ratio FROM a
""")
def show_archive(spark, sf_dir):
    row = stored_versions(spark, sf_dir, "show").show("one")
    return row.select("archive_id", "version", "n_blocks", "unique_blocks", "total_uncompressed", F.round("compression_ratio", 9).alias("compression_ratio"))


@register(f"""
    WITH a AS (SELECT *, sum(len) OVER (ORDER BY id, i) - len AS place FROM {cut_sql(DOCS)}), m AS (SELECT sum(len) // 2 AS middle FROM a), hit AS (SELECT id, i // 4096 AS page FROM a, m WHERE place <= middle AND middle < place + len)
    SELECT lpad(CAST(a.id AS VARCHAR), 12, '0') AS path, CAST(i AS INT) AS seq, CAST(place AS BIGINT) AS logical_start FROM a JOIN hit ON a.id = hit.id AND a.i // 4096 = page
""")
def stored_page(spark, sf_dir):
    """The blocks of the page that holds the middle byte of a stored archive."""
    catalog = new_catalog(spark, "page")
    a = catalog.save(archive.pack(documents(spark, sf_dir), archive.PackConfig("one", BLOCK)))
    return catalog.page(a.id, "main", catalog.header(a.id)["main_size"] // 2).select("path", "seq", "logical_start")


# Of the documents, those of number 0 mod 5 are removed, 1 mod 5 written anew, 2 mod 5 moved, and 3 mod 5 changed at byte 3 and cut to 40.
CHANGED_SQL = """(SELECT CASE WHEN doc_id % 5 = 2 THEN 'moved/' ELSE '' END || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path,
    CASE doc_id % 5 WHEN 1 THEN 'new ' || CAST(doc_id AS VARCHAR) WHEN 3 THEN 'ab' || chr(10) || 'new' || chr(10) || repeat('.', 33) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), (F.col("doc_id") % 5).alias("k"))
    row = lambda seq, k, op, path="path", content=None, at=None, size=None, target=None: d.where(F.col("k") == k).select(
        F.lit(seq).cast("long").alias("seq"), F.expr(path).alias("path"), F.lit(op).alias("op"), F.expr(content or "CAST(NULL AS BINARY)").cast("binary").alias("content"), F.lit(at).cast("long").alias("at"),
        F.lit(size).cast("long").alias("size"), F.lit(None).cast("int").alias("mode"), F.lit(1).cast("long").alias("mtime"), F.expr(target or "CAST(NULL AS STRING)").alias("target"),
    )
    parts = [
        row(1, 0, "whiteout"), row(2, 1, "put", content="concat('new ', doc_id)"), row(3, 2, "whiteout"), row(4, 2, "link", "concat('moved/', path)", target="path"),
        row(5, 3, "put", content=r"'ab\n'"), row(6, 3, "write", content="repeat('.', 100)", at=7), row(7, 3, "write", content=r"'new\n'", at=3), row(8, 3, "truncate", size=40),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register(f"SELECT path, sha256(encode(text)) AS digest FROM {CHANGED_SQL}")
def committed_files(spark, sf_dir):
    """Files of a version that was committed from changes to the one before."""
    catalog = new_catalog(spark, "commit")
    base = catalog.save(archive.pack(documents(spark, sf_dir), archive.PackConfig("one", BLOCK)))
    return whole_files(catalog.save(workspace.commit(base, cut(workspace.overlay(changes(spark, sf_dir))), "two")))


@register(f"SELECT path, sha256(substr(hex(encode(text)), 21, 60)) AS digest FROM {CHANGED_SQL}")
def overlay_reads(spark, sf_dir):
    """30 bytes from byte 10 on of each file that is seen through changes; the digest is over their hex digits."""
    base = archive.pack(documents(spark, sf_dir), archive.PackConfig("one", BLOCK))
    over = cut(workspace.overlay(changes(spark, sf_dir)))
    names = cut(workspace.view(base.files, over).select("path").withColumn("request_id", F.monotonically_increasing_id()))
    got = workspace.read(base, over, names.select("request_id", "path", F.lit(10).cast("long").alias("first"), F.lit(30).cast("long").alias("n")))
    return names.join(got, "request_id").select("path", F.sha2(F.hex("bytes"), 256).alias("digest"))


# --- codecs, transforms and content-defined blocks --------------------------------


@register("""
    WITH x AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS v FROM documents),
    u AS (SELECT doc_id, len(v) AS n, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM x),
    w AS (SELECT doc_id, string_agg(v, '' ORDER BY CASE WHEN n // 4 <= 1 THEN 0 WHEN i < n // 4 * 4 THEN i % 4 ELSE 4 END, i) AS s FROM u GROUP BY doc_id)
    SELECT doc_id, sha256(encode(text)) AS lz4, sha256(encode(text)) AS zstd, sha256(encode(text)) AS unshuffled, sha256(coalesce(s, '')) AS shuffled, CAST(octet_length(encode(text)) AS INT) AS lz4_length, '28B52FFD' AS zstd_magic
    FROM documents LEFT JOIN w USING (doc_id)
""")
def codec_round_trip(spark, sf_dir):
    """Digests of what comes back, of the shuffled bytes (as hex digits), and what the packed forms begin with."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    packed = d.select("doc_id", codecs.compress("lz4")("b").alias("l"), codecs.compress("zstd")("b").alias("z"), codecs.byte_shuffle(4)("b").alias("s"))
    digest = lambda x: F.sha2(x, 256)
    length = sum(F.conv(F.hex(F.expr(f"substring(l, {i + 1}, 1)")), 16, 10).cast("int") * (1 << (8 * i)) for i in range(4))
    return packed.select("doc_id", digest(codecs.decompress("lz4")("l")).alias("lz4"), digest(codecs.decompress("zstd")("z")).alias("zstd"), digest(codecs.byte_unshuffle(4)("s")).alias("unshuffled"), digest(F.hex("s")).alias("shuffled"), length.cast("int").alias("lz4_length"), F.hex(F.expr("substring(z, 1, 4)")).alias("zstd_magic"))


@register("SELECT doc_id, sha256(encode(text)) AS restored FROM documents")
def dictionary_round_trip(spark, sf_dir):
    """Zstandard with a dictionary trained on sampled blocks."""
    files = documents(spark, sf_dir)
    given = archive.train_dictionary(files, BLOCK, 1 << 20, 16 << 10)
    d = files.select(F.col("path").cast("long").alias("doc_id"), codecs.compress("zstd", 3, given)("content").alias("z"))
    return d.select("doc_id", F.sha2(codecs.decompress("zstd", 3, given)("z"), 256).alias("restored"))


@register("""
    WITH x AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, h[2 * i + 1 : 2 * i + 2] AS v FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM x)),
    c AS (SELECT doc_id, v, count(*) AS n FROM b GROUP BY doc_id, v), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id)
    SELECT doc_id, round(coalesce(-sum(n / t.t * log2(n / t.t)), 0), 5) + 0.0 AS entropy FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) GROUP BY doc_id
""")
def entropy(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(codecs.entropy(F.encode("text", "UTF-8")), 5).alias("entropy"))


CDC = chunking.ChunkParams(256, 1024, 4096)


def cdc_sql(source: str, p: chunking.ChunkParams = CDC) -> str:
    """Steps of SQL that cut by content: the rolling hash by window functions, the cuts by recursion; ends in ch(id, seq, start, stop)."""
    two = lambda k: str(1 << k)
    steps, last = [], "cdc_0 AS (SELECT id, i, g AS h FROM cdc_b JOIN cdc_g USING (v))"
    for k, shift in enumerate((1, 2, 4, 8, 16, 32), 1):
        steps.append(last)
        last = f"cdc_{k} AS (SELECT id, i, (h + (coalesce(lag(h, {shift}) OVER (PARTITION BY id ORDER BY i), 0::UHUGEINT) % {two(64 - shift)}::UHUGEINT) * {two(shift)}::UHUGEINT) % {two(64)}::UHUGEINT AS h FROM cdc_{k - 1})"
    table = ", ".join(f"('{i:02X}', {int(g)}::UHUGEINT)" for i, g in enumerate(chunking.GEAR))
    strict, lax = two(64 - (p.bits + 2)), two(64 - (p.bits - 2))
    middle, end = f"least(r.stop + {p.mean}, n)", f"least(r.stop + {p.most}, n)"
    return f"""
    cdc_f AS (SELECT id, octet_length(b) AS n, regexp_extract_all(hex(b), '..') AS x FROM ({source})),
    cdc_b AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM cdc_f),
    cdc_g(v, g) AS (VALUES {table}),
    {", ".join([*steps, last])},
    cdc_e AS MATERIALIZED (SELECT id, n, coalesce(strict, []) AS strict, coalesce(lax, []) AS lax FROM cdc_f LEFT JOIN
        (SELECT id, list(i + 1) FILTER (h < {strict}::UHUGEINT) AS strict, list(i + 1) AS lax FROM cdc_6 WHERE h < {lax}::UHUGEINT GROUP BY id) USING (id)),
    cdc_r AS (SELECT id, -1 AS seq, 0::BIGINT AS start, 0::BIGINT AS stop FROM cdc_e UNION ALL
        SELECT r.id, seq + 1, r.stop, CASE WHEN n - r.stop <= {p.least} THEN n ELSE coalesce(list_min(list_filter(strict, lambda e: e >= r.stop + {p.least} AND e <= {middle})),
        list_min(list_filter(lax, lambda e: e >= greatest({middle}, r.stop + {p.least}) AND e <= {end})), {end}) END FROM cdc_r r JOIN cdc_e USING (id) WHERE r.stop < n),
    ch AS (SELECT * FROM cdc_r WHERE seq >= 0), chb AS (SELECT id, seq, start, stop, b[start + 1 : stop] AS content FROM ch JOIN ({source}) USING (id))
    """


@register(f"WITH RECURSIVE {cdc_sql(DOCS)} SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS path, CAST(seq AS INT) AS seq, start, CAST(octet_length(content) AS BIGINT) AS len, sha256(content) AS hash FROM chb")
def content_defined_blocks(spark, sf_dir):
    b = chunking.content_blocks(documents(spark, sf_dir), CDC)
    return b.select("path", "seq", "start", F.octet_length("content").cast("long").alias("len"), C.hash_expr(F.col("content")).alias("hash"))


@register(f"""
    WITH RECURSIVE {cdc_sql(DOCS)}, h AS (SELECT sha256(content) AS h, octet_length(content) AS n FROM chb)
    SELECT count(*) AS chunks, count(DISTINCT h) AS unique_chunks, CAST(sum(n) AS BIGINT) AS total_bytes, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT min(n) AS n FROM h GROUP BY h)) AS unique_bytes FROM h
""")
def content_dedup_stats(spark, sf_dir):
    return chunking.stream_stats(chunking.content_blocks(documents(spark, sf_dir), CDC))


@register(f"""
    WITH RECURSIVE {cdc_sql(DOCS)}, c AS {cut_sql(DOCS)}, z AS (SELECT id, h, len, lower(hex(content)) = repeat('0', CAST(2 * len AS INT)) AS zero, content FROM c),
    e AS (SELECT id, h, v, count(*) AS n FROM (SELECT DISTINCT id, h, content FROM z), unnest(regexp_extract_all(hex(content), '..')) t(v) GROUP BY id, h, v),
    en AS (SELECT id, h, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY id, h) AS t FROM e) GROUP BY id, h),
    f AS (SELECT id, count(*) AS blocks, sum(len) AS bytes, avg(zero::INT) AS zero_share, coalesce(avg(e) FILTER (NOT zero), 0) AS mean_entropy, avg((NOT zero AND e > 6)::INT) AS high FROM z JOIN en USING (id, h) GROUP BY id),
    u AS (SELECT id, sum(len) AS u FROM (SELECT id, h, min(len) AS len FROM z GROUP BY id, h) GROUP BY id),
    k AS (SELECT id, count(DISTINCT sha256(content)) / count(*) AS cdc FROM chb GROUP BY id)
    SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS path, CAST(blocks AS BIGINT) AS blocks, round(zero_share, 9) AS zero_share, round(mean_entropy, 5) AS mean_entropy, round(high, 9) AS high_entropy_share, round(u / bytes, 9) AS fixed_dedup_ratio, round(cdc, 9) AS cdc_dedup_ratio,
           TRUE AS codecs_add_up FROM f JOIN u USING (id) JOIN k USING (id)
""")
def predict_savings(spark, sf_dir):
    """What a prediction rests on; codecs_add_up tells whether its savings follow from its ratios, and the codecs' ratios lie where they must."""
    p = analysis.predict(documents(spark, sf_dir), BLOCK, CDC)
    best = F.least("fixed_dedup_ratio", "cdc_dedup_ratio") * F.least("lz4_ratio", "zstd_ratio")
    sound = (F.abs(F.col("best_savings_pct") - 100 * (1 - best)) < 1e-9) & (F.col("estimated_bytes") == F.floor(F.col("size") * best)) & (F.col("zstd_ratio") > 0) & (F.col("lz4_ratio") < 2 + 20 / F.col("size"))
    rounded = [F.round(c, 9).alias(c) for c in ("zero_share", "high_entropy_share", "fixed_dedup_ratio", "cdc_dedup_ratio")]
    return p.select("path", "blocks", *rounded, F.round("mean_entropy", 5).alias("mean_entropy"), sound.alias("codecs_add_up"))


GRID = "SELECT CAST(f AS DOUBLE) AS f, greatest(1024.0, floor(pow(2, f) / 4)) AS m, least(1048576.0, pow(2, f) * 8) AS z FROM range(10, 19) t(f)"
LENGTH = "(m + (1 - pow(2, -f)) / pow(2, -f) * (1 - pow(1 - pow(2, -f), z - m)))"


@register(f"SELECT CAST(f AS INT) AS f, round({LENGTH}, 4) AS mean_length FROM ({GRID})")
def chunk_length_model(spark, sf_dir):
    g = spark.range(10, 19).select(F.col("id").cast("double").alias("f"))
    g = g.select("f", F.greatest(F.lit(1024.0), F.floor(F.pow(F.lit(2.0), "f") / 4).cast("double")).alias("m"), F.least(F.lit(1048576.0), F.pow(F.lit(2.0), "f") * 8).alias("z"))
    return g.select(F.col("f").cast("int").alias("f"), F.round(C.expected_length(F.col("f"), F.col("m"), F.col("z")), 4).alias("mean_length"))


@register(f"""
    WITH blocks AS {cut_sql(DOCS, 4096)}, uniq AS (SELECT lang, sum(len) AS u FROM (SELECT lang, h, min(len) AS len FROM blocks JOIN documents ON id = doc_id GROUP BY lang, h) GROUP BY lang),
    t AS (SELECT lang AS name, CAST(sum(octet_length(encode(text))) AS DOUBLE) AS total, CAST(any_value(u) AS DOUBLE) AS uniq FROM documents JOIN uniq USING (lang) GROUP BY lang),
    c AS (SELECT name, total, CASE WHEN uniq >= total THEN 1.0 ELSE least(1.0, uniq / (total * (2048 + (1 - pow(2, -13)) / pow(2, -13) * (1 - pow(1 - pow(2, -13), 63488))))) END AS c FROM t),
    g AS ({GRID}), x AS (SELECT name, total, c, f, m, z, pow(2, -f) AS p, {LENGTH} AS l FROM c, g),
    y AS (SELECT *, (1 - p) * (1 - c) AS r, z - m AS n FROM x),
    d AS (SELECT *, pow(1 - c, m + 48) * p * (m * (1 - pow(r, n)) / (1 - r) + r * (1 - n * pow(r, n - 1) + (n - 1) * pow(r, n)) / pow(1 - r, 2)) + pow(1 - p, n) * z * pow(1 - c, z + 48) AS dup FROM y),
    s AS (SELECT *, total - (total * dup / l - 52 * (total / l + 1)) AS kept, 52 * (total / l + 1) AS over FROM d),
    e AS (SELECT name, f, CASE WHEN kept < 0 THEN (total + over) / total ELSE kept / total END AS ratio FROM s)
    SELECT name, CAST(arg_min(f, ratio) AS INT) AS f, round(min(ratio), 6) AS ratio FROM e GROUP BY name
""")
def optimal_parameters(spark, sf_dir):
    """For each language, from its bytes in all and in different blocks."""
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("path"), F.lit("main").alias("stream"), F.encode("text", "UTF-8").alias("content"))
    per = chunking.fixed_blocks(d, 4096).select(F.col("path").alias("name"), C.hash_expr(F.col("content")).alias("h"), F.octet_length("content").cast("long").alias("n")).groupBy("name", "h").agg(F.sum("n").alias("all"), F.min("n").alias("n"))
    totals = per.groupBy("name").agg(F.sum("all").cast("double").alias("total"), F.sum("n").cast("double").alias("unique"))
    return analysis.optimize_params(spark, totals).select("name", "f", F.round("ratio", 6).alias("ratio"))


MAC_KEY = b"a key for digests"


@register(f"""
    SELECT doc_id, sha256(unhex('{bytes(x ^ 0x5C for x in MAC_KEY.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(x ^ 0x36 for x in MAC_KEY.ljust(64, bytes(1))).hex()}') || encode(text)))) AS mac FROM documents
""")
def keyed_digests(spark, sf_dir):
    """Digests of documents under a key; the SQL makes them from two plain ones."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower(F.hex(codecs.keyed_hash(MAC_KEY)(F.encode("text", "UTF-8")))).alias("mac"))


@register("""
    WITH x AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
    SELECT doc_id, CASE WHEN h = '' THEN sha256('') ELSE sha256(CAST(xor(CAST(unhex(h) AS BIT), CAST(unhex(substr(h, 3) || substr(h, 1, 2)) AS BIT)) AS BLOB)) END AS delta, sha256(unhex(h)) AS restored FROM x
""")
def xor_deltas(spark, sf_dir):
    """Documents stored as differences from their bytes moved by one place, and restored."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    d = d.select("doc_id", "b", F.concat(F.expr("substring(b, 2)"), F.expr("substring(b, 1, 1)")).alias("base"))
    d = d.select("doc_id", "base", codecs.xor_bytes("b", "base").alias("delta"))
    return d.select("doc_id", F.sha2("delta", 256).alias("delta"), F.sha2(codecs.xor_bytes("delta", "base"), 256).alias("restored"))


# --- requests, sizes and places -----------------------------------------------------

HEADERS = [("a", None, 100), ("b", "bytes=0-9", 100), ("c", "bytes=50-", 100), ("d", "bytes=99-99", 100), ("e", "bytes=100-", 100), ("f", "bytes=9-5", 100), ("g", "bytes=-5", 100), ("h", "bytes=x-1", 100), ("i", "bytes=0-99,1-2", 100), ("j", None, 0), ("k", None, 100_000_000), ("l", "bytes=5-99999998", 100_000_000)]


@register("""
    SELECT * FROM (VALUES ('a', 206, 0, 99), ('b', 206, 0, 9), ('c', 206, 50, 99), ('d', 206, 99, 99), ('e', 416, NULL, NULL), ('f', 416, NULL, NULL), ('g', 416, NULL, NULL), ('h', 416, NULL, NULL),
    ('i', 416, NULL, NULL), ('j', 416, NULL, NULL), ('k', 206, 0, 33554431), ('l', 206, 5, 33554436)) t(id, status, first, last)
""")
def http_ranges(spark, sf_dir):
    df = spark.createDataFrame(HEADERS, "id string, header string, size long")
    x = df.select("id", C.http_plan(F.col("header"), F.col("size")).alias("x"))
    return x.select("id", "x.status", F.col("x.first").cast("int").alias("first"), F.col("x.last").cast("int").alias("last"))


@register("""
    WITH r AS (SELECT doc_id, octet_length(encode(text)) AS size, doc_id % 1000 AS a, doc_id * 7 % 2000 AS b, doc_id % 4 AS kind FROM documents),
    p AS (SELECT doc_id, size, CASE WHEN kind IN (1, 2) THEN a ELSE 0 END AS first, CASE WHEN kind = 1 THEN b ELSE size - 1 END AS last, kind FROM r)
    SELECT doc_id, CASE WHEN good THEN 206 ELSE 416 END AS status, CASE WHEN good THEN CAST(first AS BIGINT) END AS first, CASE WHEN good THEN CAST(least(last, first + 33554431) AS BIGINT) END AS last
    FROM (SELECT *, kind <> 3 AND size > 0 AND first <= last AND last < size AS good FROM p)
""")
def document_requests(spark, sf_dir):
    """Answers to requests for parts of each document: whole, from one place to another, from a place on, and its last bytes, which are not served."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), (F.col("doc_id") % 1000).cast("string").alias("a"), (F.col("doc_id") * 7 % 2000).cast("string").alias("b"))
    ask = F.element_at(F.array(F.lit(None).cast("string"), F.concat(F.lit("bytes="), "a", F.lit("-"), "b"), F.concat(F.lit("bytes="), "a", F.lit("-")), F.concat(F.lit("bytes=-"), "a")), (F.col("doc_id") % 4 + 1).cast("int"))
    x = d.select("doc_id", C.http_plan(ask, F.col("size")).alias("x"))
    return x.select("doc_id", "x.status", "x.first", "x.last")


@register("""
    SELECT l_returnflag AS flag, u AS unit, count(*) AS rows, CAST(sum(CAST(trunc(CAST(n AS DOUBLE) * f) AS BIGINT)) AS BIGINT) AS bytes
    FROM (SELECT l_returnflag, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.' || CAST(l_partkey % 10 AS VARCHAR) AS n, [' KB', 'mb', 'G', ''][l_orderkey % 4 + 1] AS u, [1024, 1048576, 1073741824, 1][l_orderkey % 4 + 1] AS f FROM lineitem) GROUP BY ALL
""")
def quantity_sizes(spark, sf_dir):
    """Sums over sizes written with units, one in each order line."""
    n = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("."), (F.col("l_partkey") % 10).cast("string"))
    unit = F.element_at(F.array(F.lit(" KB"), F.lit("mb"), F.lit("G"), F.lit("")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), unit.alias("unit"), C.parse_size(F.concat(n, unit)).alias("size"))
    return rows.groupBy("flag", "unit").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


@register("""
    WITH x AS (SELECT page_id, split_part(url, '://', 1) AS scheme, substr(url, length(split_part(url, '://', 1)) + 4) AS rest FROM pages),
    y AS (SELECT page_id, split_part(rest, '/', 1) AS bucket, rtrim(substr(rest, length(split_part(rest, '/', 1)) + 2), '/') AS prefix FROM x)
    SELECT page_id, bucket, CASE WHEN prefix = '' THEN '' ELSE prefix || '/' END AS prefix FROM y
""")
def page_locations(spark, sf_dir):
    """Bucket and prefix of each page's place, were it in a store."""
    p = read(spark, sf_dir, "pages").select("page_id", C.parse_s3_url(F.regexp_replace("url", "^[^:]*://", "s3://")).alias("x"))
    return p.select("page_id", "x.bucket", "x.prefix")


@register("SELECT * FROM (VALUES ('64K', 65536), ('1.5MB', 1572864), ('2g', 2147483648), ('10', 10), ('1T', 1099511627776), ('x', NULL), ('', NULL), ('5 kb', 5120)) t(text, size)")
def parse_sizes(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("64K", "1.5MB", "2g", "10", "1T", "x", "", "5 kb")], "text string")
    return df.select("text", C.parse_size(F.col("text")).alias("size"))


@register("SELECT * FROM (VALUES ('s3://b', 'b', ''), ('s3://b/', 'b', ''), ('s3://b/p/q', 'b', 'p/q/'), ('s3://b/p//', 'b', 'p/'), ('s3:///p', NULL, NULL), ('http://b/p', NULL, NULL)) t(url, bucket, prefix)")
def parse_locations(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("s3://b", "s3://b/", "s3://b/p/q", "s3://b/p//", "s3:///p", "http://b/p")], "url string")
    x = df.select("url", C.parse_s3_url(F.col("url")).alias("x"))
    return x.select("url", "x.bucket", "x.prefix")


@register("SELECT user_id, count(*) AS entries, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def metadata_totals(spark, sf_dir):
    """Sums over JSON documents."""
    e = read(spark, sf_dir, "events").select("user_id", F.from_json("props", "struct<k: bigint>").alias("x"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("x.k").alias("total"))


@register("SELECT * FROM (VALUES (0, 'too_old'), (1, 'full'), (2, 'too_new')) t(version, status)")
def format_versions(spark, sf_dir):
    df = spark.createDataFrame([(0,), (1,), (2,)], "version int")
    return df.select("version", C.version_status(F.col("version")).alias("status"))


# --- lineage --------------------------------------------------------------------

# Regions, nations and customers as archives that build on each other.
CHAIN_SQL = """(SELECT 'c' || c_custkey AS archive_id, 'n' || c_nationkey AS parent_id FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"""


def chain(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("archive_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit(None).cast("string"))
    return c.union(n).union(r)


@register(f"""
    WITH RECURSIVE a AS {CHAIN_SQL}, t AS (SELECT archive_id, 0 AS depth, archive_id AS path FROM a WHERE parent_id IS NULL
    UNION ALL SELECT a.archive_id, t.depth + 1, t.path || '/' || a.archive_id FROM t JOIN a ON a.parent_id = t.archive_id) SELECT * FROM t
""")
def archive_log(spark, sf_dir):
    return analysis.lineage(spark, chain(spark, sf_dir))


@register(f"""
    WITH RECURSIVE a AS {CHAIN_SQL}, t AS (SELECT archive_id, 0 AS depth FROM a WHERE archive_id LIKE 'c%' UNION ALL SELECT a.parent_id, t.depth + 1 FROM t JOIN a ON a.archive_id = t.archive_id WHERE a.parent_id IS NOT NULL),
    n AS (SELECT archive_id, max(depth) AS depth FROM t GROUP BY 1)
    SELECT archive_id, CAST(row_number() OVER (ORDER BY depth DESC, archive_id) AS INT) AS step FROM n WHERE archive_id NOT LIKE 'r%'
""")
def push_plan(spark, sf_dir):
    a = cut(chain(spark, sf_dir))
    return analysis.copy_plan(spark, a, a.where("archive_id like 'c%'"), a.where("archive_id like 'r%'"))


# --- trees -----------------------------------------------------------------------

FILES_SQL = "(SELECT regexp_replace(url, '^[a-z]+://', '') AS path, CAST(max(octet_length(encode(html))) AS BIGINT) AS size FROM pages GROUP BY 1)"
TREE_SQL = f"""
    f AS {FILES_SQL}, p AS (SELECT string_split(path, '/') AS p FROM f), d AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, unnest(range(0, len(p))) AS i FROM p)),
    tree AS (SELECT path, 'dir' AS kind, CAST(4096 AS BIGINT) AS size FROM d UNION ALL SELECT path, 'file', size FROM f WHERE path NOT IN (SELECT path FROM d))
"""


def page_tree(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return cut(tree.nodes(p.select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length(F.encode("html", "UTF-8")).alias("size"))))


@register(f"""
    WITH {TREE_SQL} SELECT path, kind, size, CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, string_split(path, '/')[-1] AS name,
    CASE kind WHEN 'dir' THEN 493 ELSE 420 END AS mode, CAST(ceil(size / 512.0) AS BIGINT) AS blocks FROM tree
""")
def tree_attributes(spark, sf_dir):
    return tree.attributes(page_tree(spark, sf_dir))


@register(f"WITH {{TREE_SQL}}, n AS (SELECT path, row_number() OVER (ORDER BY path) AS inode FROM tree) SELECT n.path, n.inode, p.inode AS parent_inode FROM n LEFT JOIN n p ON n.path <> '' AND p.path = CASE WHEN strpos(n.path, '/') > 0 THEN regexp_replace(n.path, '/[^/]*$', '') ELSE '' END".format(TREE_SQL=TREE_SQL))
def inodes(spark, sf_dir):
    return tree.inodes(page_tree(spark, sf_dir)).select("path", "inode", "parent_inode")


@register(f"""
    WITH {TREE_SQL}, c AS (SELECT CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, string_split(path, '/')[-1] AS name FROM tree WHERE path <> '')
    SELECT parent, string_agg(name, chr(10) ORDER BY name) AS names FROM c GROUP BY parent
""")
def directory_listings(spark, sf_dir):
    return tree.children(page_tree(spark, sf_dir)).select("parent", F.array_join("names", "\n").alias("names"))


@register(f"""
    WITH {TREE_SQL}, h AS (SELECT min(path) AS old FROM tree WHERE path <> '' AND kind = 'dir')
    SELECT CASE WHEN path = old OR starts_with(path, old || '/') THEN 'moved' || substr(path, length(old) + 1) ELSE path END AS path, kind, size FROM tree, h
""")
def renamed_tree(spark, sf_dir):
    """The tree with its first folder under another name."""
    t = page_tree(spark, sf_dir)
    return tree.rename(t, t.where("path <> '' and kind = 'dir'").agg(F.min("path")).first()[0], "moved")


@register("SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, event_id) AS op, CAST(round(arg_max(value, event_id)) AS BIGINT) AS size FROM events GROUP BY user_id")
def overlay_log(spark, sf_dir):
    """The last event of each user, as the last change of a path."""
    e = read(spark, sf_dir, "events")
    return tree.latest(e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), F.round("value").cast("long").alias("size")))


# Changes over the tree: pages with a table or a form are put anew, those with none of the two but a list are removed, and each gets a note.
OVERLAY_SQL = f"""
    o AS (SELECT path, max(op) AS op, max(size) AS size FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, CASE WHEN html LIKE '%<table%' OR html LIKE '%<img%' THEN 'put' ELSE 'whiteout' END AS op, CAST(1 AS BIGINT) AS size FROM pages) GROUP BY path
    UNION ALL SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') || '.note', 'put', CAST(7 AS BIGINT) FROM pages)
"""


def page_overlay(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.when(F.col("html").contains("<table") | F.col("html").contains("<img"), "put").otherwise("whiteout").alias("op"))
    own = p.groupBy("path").agg(F.max("op").alias("op")).withColumn("size", F.lit(1).cast("long"))
    return cut(own.union(p.select(F.concat("path", F.lit(".note")), F.lit("put"), F.lit(7).cast("long")).distinct()))


@register(f"""
    WITH {TREE_SQL}, {OVERLAY_SQL}, w AS (SELECT path FROM o WHERE op = 'whiteout'), u AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM tree),
    gone AS (SELECT DISTINCT path FROM u WHERE array_to_string(string_split(path, '/')[1:i], '/') IN (SELECT path FROM w))
    SELECT * FROM tree WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM o WHERE op <> 'whiteout') UNION ALL SELECT path, 'file', size FROM o WHERE op <> 'whiteout'
""")
def merged_tree(spark, sf_dir):
    return tree.merged(page_tree(spark, sf_dir), page_overlay(spark, sf_dir))


@register(f"""
    WITH {TREE_SQL}, {OVERLAY_SQL} SELECT path, state FROM (SELECT o.path, CASE WHEN op = 'whiteout' AND t.kind IS NOT NULL THEN 'deleted' WHEN op <> 'whiteout' AND t.kind IS NULL THEN 'added'
    WHEN op <> 'whiteout' AND t.kind = 'file' THEN 'modified' END AS state FROM o LEFT JOIN tree t ON t.path = o.path) WHERE state IS NOT NULL
""")
def workspace_status(spark, sf_dir):
    return tree.status(page_tree(spark, sf_dir), page_overlay(spark, sf_dir))


# --- streaming ------------------------------------------------------------------


@register("SELECT sha256(props) AS hash, CAST(octet_length(encode(props)) AS BIGINT) AS n FROM (SELECT DISTINCT props FROM events)")
def streamed_blocks(spark, sf_dir):
    """Blocks that streaming ingestion keeps of the events' properties."""
    root = new_catalog(spark, "ingest").root
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    ingest.ingest(stream.select(F.encode("props", "UTF-8").alias("content")), f"{root}/store", f"{root}/checkpoint")
    return spark.read.option("basePath", f"{root}/store").parquet(f"{root}/store/batch=*").select("hash", F.octet_length("content").cast("long").alias("n"))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
