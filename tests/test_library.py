"""Operators over blocks and trees: properties on generated bytes, and edge cases. SQL comparisons are in test_oracle.py."""

import hashlib
import io
import random
import tarfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import codecs
from loomstone.functions import columns as C
from loomstone import api
from loomstone.operators import analysis, archive, chunking, tree, workspace
from loomstone.operators import catalog as catalogs
from loomstone.operators.lineage import running_sums
from loomstone.sources import files as sources
from loomstone.streaming import ingest

P = chunking.ChunkParams(64, 256, 1024)
FILES = "path string, stream string, content binary, mode int, mtime long"


def noise(n, seed=42):
    return random.Random(seed).randbytes(n)


@pytest.fixture(scope="module")
def files(spark):
    zeros, same = bytes(5000), noise(3000, 1)
    rows = [("a/zeros", zeros), ("a/one", same), ("b/two", same), ("b/empty", b""), ("b/mixed", noise(700, 2) + zeros[:2048] + noise(10, 3)), ("c/ones", b"\xff" * 4096), ("c/tiny", b"x")]
    rows = [(p, "main", c, 0o644, 0) for p, c in rows] + [("memory", "aux", noise(1500, 4), 0o600, 1)]
    return spark.createDataFrame(rows, FILES)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20000) | st.integers(0, 40).map(lambda s: noise(s * 500, s)))
def test_chunks_make_up_the_content(data):
    ends = chunking.cut_points(data, P)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert (ends[-1] if ends else 0) == len(data) and all(n <= P.most for n in sizes) and all(n >= P.least for n in sizes[:-1])


def test_chunks_survive_a_shift():
    data = noise(200_000)
    chunks = lambda d: {d[a:b] for a, b in zip([0, *chunking.cut_points(d, P)], chunking.cut_points(d, P), strict=False)}
    one, two = chunks(data), chunks(noise(100, 9) + data)
    assert len(one & two) > 0.95 * len(one)
    mean = 200_000 / len(one)
    assert 150 < mean < 500


def test_parameters():
    assert chunking.resolve_params() == chunking.ChunkParams()
    assert chunking.resolve_params((None, 4096, None), chunking.ChunkParams(1024, 2048, 65536)) == chunking.ChunkParams(1024, 4096, 65536)
    assert chunking.resolve_params(None, None, (13, 2048, 65536)).mean == 8192
    with pytest.raises(ValueError):
        chunking.ChunkParams(5, 4, 3)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 60).map(lambda s: noise(s * 400, s)) | st.binary(max_size=3000), st.integers(1, 3000))
def test_streamed_chunks_are_those_of_the_whole_file(data, step):
    source = io.BytesIO(data)
    got = list(chunking.stream_chunks(lambda n: source.read(min(n, step)), P, buffer=1500))
    ends = chunking.cut_points(data, P)
    assert got == [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def contents_of(files):
    return {r["path"]: bytes(r["content"] or b"") for r in files.collect()}


def restored(a, out):
    done = {r["path"]: r["size"] for r in archive.extract(a, f"file://{out}").collect()}
    got = {p: (out / p).read_bytes() for p in done}
    assert {p: len(c) for p, c in got.items()} == done
    return got


@pytest.mark.parametrize("config", [{"block": 512}, {"block": None, "params": P}, {"block": 512, "compression": "zstd"}, {"block": 512, "compression": "lz4"}, {"block": 512, "compression": "zstd", "key": bytes(32)}])
def test_archives_restore_and_read_back(spark, files, config, tmp_path):
    a = archive.pack(files, archive.PackConfig(**config))
    originals = contents_of(files)
    assert restored(a, tmp_path / "out") == originals and "b/empty" in originals
    assert (tmp_path / "out/memory").stat().st_mode & 0o777 == 0o600 and (tmp_path / "out/b/empty").stat().st_mode & 0o777 == 0o644
    main = b"".join(originals[r["path"]] for r in a.files.where("stream = 'main'").orderBy("offset").collect())
    rng = random.Random(5)
    ask = [(i, "main", rng.randrange(len(main)), rng.randrange(3000)) for i in range(30)] + [(90, "main", len(main) + 5, 10), (91, "main", 0, 0), (92, "aux", 10, 10**6)]
    requests = spark.createDataFrame(ask, "request_id int, stream string, first long, n long")
    want = {i: (main if s == "main" else originals["memory"])[f : f + n] for i, s, f, n in ask}
    assert {r["request_id"]: bytes(r["bytes"]) for r in archive.read_ranges(a, requests).collect()} == want
    if config == {"block": 512}:
        padded = {r["request_id"]: bytes(r["bytes"]) for r in archive.read_ranges(a, requests.where("n < 5000"), pad=True).collect()}
        assert padded == {i: want[i].ljust(n, b"\0") for i, _, _, n in ask if n < 5000}
        slices = spark.createDataFrame([(1, "b/mixed", 690, 100), (2, "b/empty", 0, 9), (3, "none", 0, 1), (4, "b/mixed", 9999, 5)], "request_id int, path string, first long, n long")
        got = {r["request_id"]: r["bytes"] and bytes(r["bytes"]) for r in archive.read_files(a, slices).collect()}
        assert got[1] == originals["b/mixed"][690:790] and not got[2] and got[3] is None and not got[4]
    digests = {r["path"]: (r["size"], r["digest"]) for r in archive.file_digests(a).collect()}
    assert digests == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in originals.items()}
    assert archive.audit(a).count() == 0
    n = a.blocks.count()
    assert sorted(r[0] for r in a.blocks.select("block_idx").collect()) == list(range(n))
    if config.get("key"):
        assert a.blocks.where("hash is not null").count() == 0
        other = archive.pack(files, archive.PackConfig(**config))
        assert other.config.salt != a.config.salt and other.store.join(a.store, "payload").count() == 0
    else:
        assert a.store.count() == a.blocks.where("kind = 'data'").select("hash").distinct().count()


def test_no_files_make_an_archive(spark, tmp_path):
    a = archive.pack(spark.createDataFrame([], FILES), archive.PackConfig(block=512))
    assert archive.file_digests(a).count() == 0
    assert a.blocks.count() == a.store.count() == a.files.count() == 0 and archive.extract(a, f"file://{tmp_path}/none").count() == 0
    assert catalogs.Catalog(spark, f"file://{tmp_path}/c").save(a).files.count() == 0


def test_thin_versions_read_through_their_parents(spark, files, tmp_path):
    """A chain of versions, each with a file more: blocks come from the version that stores them, however far below it is."""
    originals = contents_of(files)
    one = archive.pack(files, archive.PackConfig("v0", 512, compression="zstd"))
    chain = [one]
    for k in range(1, 5):
        more = spark.createDataFrame([(f"more/{i}", "main", noise(1500, 100 + i), 0o644, 0) for i in range(k)], FILES)
        chain.append(archive.pack(files.unionByName(more), archive.PackConfig(f"v{k}", 512, compression="lz4" if k % 2 else None), chain[-1]))
    last = chain[-1]
    assert {r[0] for r in last.blocks.select("owner").distinct().collect()} == {"v0", "v1", "v2", "v3", "v4", None}
    want = originals | {f"more/{i}": noise(1500, 100 + i) for i in range(4)}
    assert restored(last, tmp_path / "out") == want
    assert {r["path"]: r["digest"] for r in archive.file_digests(last).collect()} == {p: hashlib.sha256(c).hexdigest() for p, c in want.items()}
    torn = archive.Archive(last.config, last.blocks.where("path <> 'c/ones' or seq <> 1"), last.store, last.files, last.owners)
    with pytest.raises(Exception, match="c/ones: 3584 bytes of 4096"):
        archive.file_digests(torn).collect()
    first = spark.createDataFrame([(0, "c/ones", 0, 16)], "request_id int, path string, first long, n long")
    assert bytes(archive.read_files(last, first).first()["bytes"]) == b"\xff" * 16
    alone = archive.Archive(last.config, last.blocks, last.store, last.files)
    with pytest.raises(LookupError, match="v[0-3] is not there"):
        archive.payloads(alone)
    assert archive.payloads(alone, missing="zero").where("kind = 'parent' and content is not null").count() == 0
    lost = archive.Archive(one.config, one.blocks, one.store.limit(0), one.files)
    with pytest.raises(Exception, match="no bytes of block"):
        archive.payloads(lost).collect()


def test_long_chains_and_cycles(spark):
    n = 90
    parents = spark.createDataFrame([(f"a{i}", f"a{i - 1}", 0) for i in range(1, n)] + [("a0", None, 0)], "archive_id string, parent_id string, ordinal int")
    tree = {r["archive_id"]: r["depth"] for r in analysis.lineage(spark, parents).collect()}
    assert tree == {f"a{i}": i for i in range(n)}
    wanted = spark.createDataFrame([(f"a{n - 1}",)], "archive_id string")
    plan = analysis.copy_plan(spark, parents, wanted, wanted.limit(0)).orderBy("step").collect()
    assert [r["archive_id"] for r in plan] == [f"a{i}" for i in range(n)]
    blocks = spark.createDataFrame([("a0", "data", "h"), (f"a{n - 1}", "parent", "h"), (f"a{n - 1}", "parent", "x")], "archive_id string, kind string, hash string")
    found = archive.resolve(blocks.where("archive_id <> 'a0'"), blocks, parents.where("parent_id is not null"))
    assert {r["hash"]: r["found"] for r in found.collect()} == {"h": "a0", "x": None}
    circle = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("c", "b", 0)], "archive_id string, parent_id string, ordinal int")
    with pytest.raises(ValueError, match="own ancestor"):
        analysis.lineage(spark, circle)
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        analysis.closure(spark, circle, circle.select("archive_id")).collect()
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        archive.resolve(blocks, blocks, circle).collect()


def test_catalogs_keep_archives(spark, files, tmp_path):
    c = catalogs.Catalog(spark, f"file://{tmp_path}/archives")
    assert c.ids() == [] and c.headers().count() == 0
    a = c.save(archive.pack(files, archive.PackConfig("one", 512, compression="zstd", page_blocks=3)), metadata="{}")
    b = c.save(archive.pack(files.where("path <> 'c/tiny'"), archive.PackConfig("two", 512), a))
    assert c.ids() == ["one", "two"] and restored(c.open("two"), tmp_path / "two") == {p: x for p, x in contents_of(files).items() if p != "c/tiny"}
    with pytest.raises(FileExistsError):
        c.save(b)
    with pytest.raises(FileNotFoundError):
        c.open("three")
    with pytest.raises(ValueError):
        c.has("../one")
    page = c.page("one", "main", 5100).collect()
    assert len(page) <= 3 and any(r["logical_start"] <= 5100 < r["logical_start"] + r["logical_len"] for r in page)
    shown = c.show("one").first()
    assert shown["total_blocks"] == a.blocks.count() and shown["compression_ratio"] > 1 and not shown["encrypted"]
    assert [(r["archive_id"], r["depth"]) for r in c.log().collect()] == [("one", 0), ("two", 1)]
    for bad in (b"", b"[1]", b'{"magic": "LOOM", "version": 2}', b'{"magic": "x", "version": 1}'):
        with pytest.raises(ValueError):
            catalogs.parse_header(bad)
    other = catalogs.Catalog(spark, f"file://{tmp_path}/other")
    assert c.send(other, ["two"]) == ["one", "two"] and c.send(other, ["two"]) == [] and restored(other.open("two"), tmp_path / "again")


def test_encrypted_archives_need_their_key(spark, files, tmp_path):
    c = catalogs.Catalog(spark, f"file://{tmp_path}/archives")
    config = archive.PackConfig("sealed", 512, compression="lz4").with_password("secret", iterations=100_000)
    c.save(archive.pack(files, config))
    assert restored(c.open("sealed", password="secret"), tmp_path / "out") == contents_of(files)
    with pytest.raises(PermissionError):
        c.open("sealed")
    with pytest.raises(Exception, match="wrong key"):
        archive.payloads(c.open("sealed", password="other")).collect()


def test_signatures_of_archives(spark, files, tmp_path):
    c = catalogs.Catalog(spark, f"file://{tmp_path}/archives")
    c.save(archive.pack(files, archive.PackConfig("one", 512)))
    private, public = codecs.keypair(spark)
    with pytest.raises(FileNotFoundError):
        c.verify("one", public)
    c.sign("one", private)
    assert c.verify("one", public) and not c.verify("one", codecs.keypair(spark)[1])
    store = next((tmp_path / "archives/one").glob("tables-*/store"))
    changed = spark.read.parquet(f"file://{store}").withColumn("payload", F.when(F.length("payload") == 1, F.unhex(F.lit("79"))).otherwise(F.col("payload"))).toPandas()
    for f in [*store.glob("*.parquet"), *store.glob(".*.crc")]:
        f.unlink()
    spark.createDataFrame(changed, "archive_id string, store_id string, payload binary, stored_len long, crc32 long").write.mode("append").parquet(f"file://{store}")
    assert not c.verify("one", public)


def test_python_archives(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_bytes(b"hello world" * 1000)
    (tmp_path / "d/sub/b").write_bytes(b"")
    api.pack(str(tmp_path / "d"), f"file://{tmp_path}/c/v1", compression="zstd", block=1024)
    (tmp_path / "d/sub/b").write_bytes(b"now")
    api.pack(str(tmp_path / "d"), f"file://{tmp_path}/c/v2", base=f"file://{tmp_path}/c/v1", block=1024)
    with api.Archive(f"file://{tmp_path}/c/v2") as a:
        assert a.namelist() == ["a.txt", "sub/b"] and a.read("sub/b") == b"now"
        f = a.open("a.txt")
        assert f.seek(-5, io.SEEK_END) == 10995 and f.read() == b"world" and f.read(3) == b"" and f.seek(6) == 6 and f.read(5) == b"world" and f.tell() == 11
        assert f.seek(2, io.SEEK_CUR) == 13 and io.BufferedReader(f).read(3) == b"llo"
        with pytest.raises(ValueError):
            f.seek(-1)
        with pytest.raises(KeyError):
            a.open("none")
    assert api.Archive(f"file://{tmp_path}/c/v1").read("sub/b") == b"" and api.version


def test_workspaces(spark, files, tmp_path):
    c = catalogs.Catalog(spark, f"file://{tmp_path}/archives")
    c.save(archive.pack(files, archive.PackConfig("one", 512)))
    w = workspace.Workspace.checkout(c, "one", f"file://{tmp_path}/w")
    with pytest.raises(FileExistsError):
        workspace.Workspace.init(spark, w.root)
    assert workspace.Workspace.find(spark, f"{w.root}/x/y").base == "one"
    with pytest.raises(FileNotFoundError):
        workspace.Workspace.find(spark, f"file://{tmp_path}/elsewhere")
    want = contents_of(files)
    w.put("new/x", b"fresh")
    w.write("c/ones", b"AB", at=1)
    w.truncate("a/one", 7)
    w.remove("b")
    w.put("b/back", b"again")
    w.rename("a", "z")
    w.chmod("c/tiny", 0o755)
    w.mkdir("folder")
    w.symlink("link", "new/x")
    ones = want["c/ones"]
    seen = {"new/x": b"fresh", "c/ones": ones[:1] + b"AB" + ones[3:], "z/one": want["a/one"][:7], "z/zeros": want["a/zeros"], "b/back": b"again", "c/tiny": b"x", "memory": want["memory"]}
    assert {r["path"] for r in workspace.view(w.archive().files, w.overlay()).collect()} == set(seen)
    states = {r["path"]: r["state"] for r in w.status().collect()}
    assert states["new/x"] == "added" and states["c/ones"] == "modified" and states["b/two"] == states["a/zeros"] == "deleted"
    ask = spark.createDataFrame([(i, p, 0, 3) for i, p in enumerate(sorted(seen))] + [(99, "b/two", 0, 3)], "request_id int, path string, first long, n long")
    got = {r["request_id"]: r["bytes"] and bytes(r["bytes"]) for r in workspace.read(w.archive(), w.overlay(), ask).collect()}
    assert got == {i: seen[p][:3] for i, p in enumerate(sorted(seen))} | {99: None}
    made = w.commit("two")
    assert restored(made, tmp_path / "out") == seen and (tmp_path / "out/c/tiny").stat().st_mode & 0o777 == 0o755
    assert made.blocks.where("kind = 'parent'").count() > 0 and w.events().count() == 0 and workspace.Workspace.find(spark, w.root).base == "two"
    w.add_remote("far", f"file://{tmp_path}/far")
    with pytest.raises(ValueError):
        w.add_remote("far", "x")
    assert w.push("far") == ["one", "two"] and w.push("far") == []
    here = workspace.Workspace.init(spark, f"file://{tmp_path}/w2", f"file://{tmp_path}/near")
    here.add_remote("far", f"file://{tmp_path}/far")
    assert here.pull("far", "two") == ["one", "two"]
    here.put("only", b"1")
    assert restored(here.commit("three"), tmp_path / "three") == {"only": b"1"}
    here.remove_remote("far")
    assert workspace.Workspace.find(spark, here.root).remotes == {}


def test_corrupt_blocks_are_found(files):
    a = archive.pack(files, archive.PackConfig(block=512))
    bad = archive.Archive(a.config, a.blocks, a.store.withColumn("payload", F.when(F.length("payload") == 1, F.unhex(F.lit("79"))).otherwise(F.col("payload"))), a.files)
    assert archive.audit(bad).count() == 1
    with pytest.raises(Exception, match="corrupt block"):
        archive.payloads(bad).collect()
    with pytest.raises(ValueError):
        archive.pack(files, archive.PackConfig(block=512, key=bytes(32)), a)
    with pytest.raises(ValueError):
        archive.pack(files, archive.PackConfig(block=512), archive.pack(files, archive.PackConfig(block=512, key=bytes(32))))


def test_versions_add_up(files):
    one = archive.pack(files, archive.PackConfig("one", 512))
    two = archive.pack(files.withColumn("content", F.concat("content", F.encode(F.lit("more"), "UTF-8"))), archive.PackConfig("two", 512), one)
    d = {r["state"]: r["blocks"] for r in analysis.diff(one.blocks, two.blocks).collect()}
    assert d["shared"] + d["new"] == two.blocks.where("hash is not null").select("hash").distinct().count()
    i = analysis.inspect(two, ("main", "aux")).first()
    assert i["total_blocks"] == two.blocks.count() == i["data_blocks"] + i["zero_blocks"] + i["parent_blocks"] and i["parent_blocks"] > 0
    assert analysis.inspect(archive.Archive(two.config, two.blocks.limit(0), two.store, two.files)).first()["total_blocks"] == 0


def test_digest_and_signature(spark, files):
    h = [bytes.fromhex(archive.digest(archive.pack(f, archive.PackConfig(block=512)).blocks).first()[0]) for f in (files, files.repartition(3), files.where("path <> 'c/tiny'"))]
    assert h[0] == h[1] != h[2]
    private, public = codecs.keypair(spark)
    s = codecs.sign(spark, private, h[0])
    assert codecs.verify(spark, public, h[0], s) and not codecs.verify(spark, public, h[2], s) and not codecs.verify(spark, public, h[0], b"no")


def test_unsafe_paths():
    for p in ("/etc/x", "a/../../x", ""):
        with pytest.raises(ValueError):
            archive.safe_path(p)
    assert archive.safe_path("a/b") == "a/b"


def test_running_sums_over_parts(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as v").repartition(5)
    total, want = 0, {}
    for i in range(1000):
        want[i] = total
        total += i % 7
    assert {r["id"]: r["before"] for r in running_sums(df, ["id"], {"before": F.col("v")}, 6).collect()} == want
    assert running_sums(df.limit(0), ["id"], {"before": F.col("v")}).count() == 0


def test_codecs(spark):
    data = [b"", b"a", bytes(1000), noise(5000), b"abc" * 4000, None]
    df = spark.createDataFrame([(x,) for x in data], "b binary")
    dictionary = codecs.train_dictionary([f"record number {i} of the kind {i % 7}".encode() * 3 for i in range(2000)], 2048)
    assert dictionary and codecs.train_dictionary([b"x"]) == b""
    for pack, unpack in ((codecs.compress("lz4"), codecs.decompress("lz4")), (codecs.compress("zstd", 9, dictionary), codecs.decompress("zstd", 9, dictionary)), (codecs.byte_shuffle(4), codecs.byte_unshuffle(4)), (codecs.byte_shuffle(1), codecs.byte_unshuffle(1))):
        assert [r[0] and bytes(r[0]) for r in df.select(unpack(pack("b"))).collect()] == [x or (x if x is None else b"") for x in data]
    assert [round(r[0], 3) if r[0] is not None else None for r in df.select(codecs.entropy("b")).collect()][:3] == [0.0, 0.0, 0.0]
    assert len(df.select(codecs.keyed_hash(b"key")("b")).first()[0]) == 32
    pairs = spark.createDataFrame([(b"", b""), (b"abc", b"bca"), (None, b"x")], "a binary, b binary")
    assert [r[0] and bytes(r[0]) for r in pairs.select(codecs.xor_bytes("a", "b")).collect()] == [b"", b"\x03\x01\x02", None]
    with pytest.raises(Exception, match="lengths differ"):
        df.select(codecs.xor_bytes("b", F.lit(b"ab"))).collect()
    with pytest.raises(ValueError):
        codecs.compress("brotli")
    key, salt = codecs.derive_key("secret", b"12345678", 100_000)
    assert len(key) == 32 and codecs.derive_key("secret", salt, 100_000)[0] == key
    with pytest.raises(ValueError):
        codecs.derive_key("secret", b"12", 100_000)


def test_encryption_rejects_changes(spark):
    df = spark.createDataFrame([(3, b"content")], "n long, b binary").select("n", C.encrypt(F.col("b"), F.lit(bytes(32)), F.col("n")).alias("s"))
    got = df.select(
        C.decrypt(F.col("s"), F.lit(bytes(32)), F.col("n")), C.decrypt(F.col("s"), F.lit(bytes(32)), F.col("n") + 1), C.decrypt(F.col("s"), F.lit(b"1" * 32), F.col("n")), C.decrypt(F.concat(F.col("s"), F.unhex(F.lit("00"))), F.lit(bytes(32)), F.col("n"))
    ).first()
    assert bytes(got[0]) == b"content" and got[1] is got[2] is got[3] is None
    x = spark.createDataFrame([([1, 2], [3, 2])], "a array<int>, b array<int>").select(C.xor(F.col("a"), F.col("b"))).first()[0]
    assert x == [2, 0]


def test_model_equals_sums(spark):
    for f, m, z, c in ((8, 100, 2000, 0.001), (10, 256, 4096, 0.01), (6, 10, 500, 0.2)):
        p, w = 2.0**-f, 48
        length = sum((1 - p) ** i * p * (m + i) for i in range(z - m)) + (1 - p) ** (z - m) * z
        dup = sum((1 - p) ** i * p * (m + i) * (1 - c) ** (i + m + w) for i in range(z - m)) + (1 - p) ** (z - m) * z * (1 - c) ** (z + w)
        args = [F.lit(float(x)) for x in (f, m, z)]
        got = spark.range(1).select(C.expected_length(*args), C.expected_duplicate(*args, F.lit(48.0), F.lit(c))).first()
        assert abs(got[0] - length) < 1e-6 * length and abs(got[1] - dup) < 1e-6 * max(dup, 1)


def test_predictions(files):
    rows = {r["path"]: r for r in analysis.predict(files, 512, P).collect()}
    assert rows["a/zeros"]["zero_share"] == 1 and rows["c/ones"]["mean_entropy"] == 0 and rows["a/one"]["high_entropy_share"] > 0.5
    assert "b/empty" not in rows and analysis.predict(files, 512, P, samples=2).where("path = 'a/one'").first()["blocks"] <= 3


def test_tree_edits(spark):
    t = tree.nodes(spark.createDataFrame([("a/b/c", 10), ("a/d", 600), ("e", 0)], "path string, size long"))
    assert [r[0] for r in tree.readdir(t, "a").collect()] == [".", "..", "b", "d"]
    assert [r[0] for r in tree.readdir(t, "", 2, 1).collect()] == ["a"]
    moved = {r["path"] for r in tree.rename(t, "a", "z").collect()}
    assert moved == {"", "z", "z/b", "z/b/c", "z/d", "e"}
    assert {r["path"] for r in tree.remove(t, "a/b").collect()} == {"", "a", "a/d", "e"}
    log = spark.createDataFrame([(1, "a/d", "put", 5), (2, "a/d", "whiteout", None), (3, "n", "put", 7), (4, "a/b", "whiteout", None)], "seq int, path string, op string, size long")
    over = tree.latest(log)
    assert {r["path"]: r["size"] for r in tree.merged(t, over).where("kind = 'file'").collect()} == {"e": 0, "n": 7}
    assert {r["path"]: r["state"] for r in tree.status(t, over).collect()} == {"a/d": "deleted", "a/b": "deleted", "n": "added"}
    assert tree.lookup(t, "e").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "d/.loom").mkdir(parents=True)
    (tmp_path / "d/x.txt").write_bytes(b"one")
    (tmp_path / "d/memory").write_bytes(b"two")
    (tmp_path / "d/.loom/state").write_bytes(b"no")
    (tmp_path / "d/empty").write_bytes(b"")
    (tmp_path / "d/.hidden").write_bytes(b"h")
    (tmp_path / "d/x.txt").chmod(0o640)
    for name in ("a.tmp", "keep.tmp", "out/log", "d/out"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"no")
    (tmp_path / ".loomignore").write_text("# left out\n*.tmp\n!keep.tmp\n/out/\n.loomignore\n")
    rows = sources.folder(spark, str(tmp_path), ["d/o?t"]).collect()
    got = {r["path"]: (r["stream"], bytes(r["content"])) for r in rows}
    assert got == {"d/x.txt": ("main", b"one"), "d/memory": ("aux", b"two"), "d/empty": ("main", b""), "d/.hidden": ("main", b"h"), "keep.tmp": ("main", b"no")}
    assert {r["path"]: r["mode"] for r in rows}["d/x.txt"] == 0o640
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name, data in (("p/a", b"aa"), ("b", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert {r["path"]: bytes(r["content"]) for r in sources.tar(spark, str(tmp_path / "t.tar")).collect()} == {"t.tar/p/a": b"aa", "t.tar/b": b""}
    assert [(r["name"], r["size"]) for r in sources.remote_listing(spark, str(tmp_path), "*.tar").collect()] == [("t.tar", (tmp_path / "t.tar").stat().st_size)]


def test_locations_are_checked():
    public = lambda host: ["93.184.216.34"]
    assert sources.checked_url("https://example.org/x", public)
    for url in ("ftp://example.org", "http://127.0.0.1/", "http://[::1]/", "http://10.1.2.3/", "http://169.254.1.1/", "http://[::ffff:10.0.0.1]/", "http:///x"):
        with pytest.raises(ValueError):
            sources.checked_url(url, public)
    with pytest.raises(ValueError):
        sources.checked_url("http://example.org/", lambda host: ["192.168.0.1"])


@pytest.fixture
def server():
    import http.server
    import threading

    body = noise(50_000, 77)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.answer(False)

        def do_GET(self):
            self.answer(True)

        def answer(self, send):
            if self.path.startswith("/away"):
                self.send_response(302)
                self.send_header("Location", {"/away": "/data", "/away-far": "http://10.0.0.1/data", "/away-on": "/away-on"}[self.path])
                self.end_headers()
                return
            found = (self.headers.get("Range") or "").removeprefix("bytes=").split("-")
            data = body
            if len(found) == 2 and self.path != "/whole":
                data = body[int(found[0]) : int(found[1]) + 1]
                self.send_response(206)
            else:
                self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if send:
                self.wfile.write(data)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://files.test:{s.server_port}", body
    s.shutdown()


def test_ranges_over_http(spark, server, tmp_path):
    url, body = server
    here = {"lookup": lambda host: ["127.0.0.1"], "allowed": lambda address: address == "127.0.0.1", "timeout": 5}
    f = sources.HttpFile(f"{url}/data", **here)
    assert f.size() == len(body) and not f.is_empty() and f.read_exact(100, 50) == body[100:150] and f.read_exact(5, 0) == b""
    with pytest.raises(ValueError):
        f.read_exact(len(body) - 5, 10)
    assert sources.HttpFile(f"{url}/away", **here).read_exact(0, 9) == body[:9]
    for path, words in (("away-far", "not a public host"), ("away-on", "too many redirects"), ("whole", "status 200")):
        with pytest.raises(ValueError, match=words):
            sources.HttpFile(f"{url}/{path}", **here).read_exact(0, 9)
    with pytest.raises(ValueError, match="not a public host"):
        sources.HttpFile(f"{url}/data", lookup=lambda host: ["127.0.0.1"]).size()
    opener = lambda uri: sources.HttpFile(uri, lookup=lambda host: ["127.0.0.1"], allowed=lambda address: True)
    ask = spark.createDataFrame([(1, f"{url}/data", 10, 20), (2, f"{url}/data", 0, 1)], "request_id long, uri string, first long, n long")
    assert {r[0]: bytes(r[1]) for r in sources.read_uris(ask, opener).collect()} == {1: body[10:30], 2: body[:1]}
    (tmp_path / "big").write_bytes(body)
    (tmp_path / "none").write_bytes(b"")
    for mapped in (False, True):
        g = sources.StoreFile(f"file://{tmp_path}/big", mapped)
        assert g.read_exact(7, 9) == body[7:16] and g.size() == len(body)
        with pytest.raises(ValueError):
            g.read_exact(len(body), 1)
    names = spark.createDataFrame([("big", "main", f"file://{tmp_path}/big"), ("none", "main", f"file://{tmp_path}/none")], "path string, stream string, uri string")
    ends = chunking.cut_points(body, P)
    got = sorted((r["seq"], r["start"], bytes(r["content"])) for r in sources.content_blocks_of(names, P).collect())
    assert got == [(i, a, body[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


def test_remote_folders(spark, tmp_path):
    (tmp_path / "local").write_bytes(b"content")
    r = sources.connect(spark, f"file://{tmp_path}/far")
    assert r.list() == [] and not r.exists("x")
    r.upload(str(tmp_path / "local"), "x")
    r.download("x", str(tmp_path / "back"))
    assert r.list() == [("x", 7)] and r.exists("x") and (tmp_path / "back").read_bytes() == b"content"
    for bad in ("http://h/x", "s3:///x"):
        with pytest.raises(ValueError):
            sources.connect(spark, bad)
    with pytest.raises(ValueError):
        r.exists("../x")


def test_known_vector_of_encryption(spark):
    """The published vector of AES-256-GCM for a key, nonce and block of zeros."""
    row = spark.createDataFrame([(0, bytes(16))], "n long, b binary").select(F.hex(C.encrypt(F.col("b"), F.lit(bytes(32)), F.col("n")))).first()[0]
    assert row == "CEA7403D4D606B6E074EC5D3BAF39D18D0D1C8A799996BF0265B98B5D48AB919"


def test_dictionaries_from_samples(spark):
    rows = [(f"f{i}", "main", f"record number {i} of the kind {i % 7} and no other, ".encode() * 40, 0o644, 0) for i in range(300)] + [("z", "main", bytes(10**5), 0, 0), ("n", "main", noise(10**5), 0, 0)]
    df = spark.createDataFrame(rows, FILES)
    assert archive.train_dictionary(df, 512, 1 << 20, 4096) and archive.train_dictionary(df.where("path = 'z'"), 512, 1 << 20) == b""
    assert archive.PackConfig.trains("eda") and archive.PackConfig.profile("eda").block == 16 << 10


def test_inodes(spark):
    t = tree.nodes(spark.createDataFrame([("a/b/c", 10), ("a/d", 600), ("e", 0)], "path string, size long"))
    assert {r["path"]: (r["inode"], r["parent_inode"]) for r in tree.inodes(t).collect()} == {"": (1, None), "a": (2, 1), "a/b": (3, 2), "a/b/c": (4, 3), "a/d": (5, 2), "e": (6, 1)}


def test_ingestion_keeps_each_block_once(spark, tmp_path):
    source = tmp_path / "in"
    for part in ([b"a", b"b", b"a"], [b"b", b"c"]):
        spark.createDataFrame([(x,) for x in part], "content binary").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("content binary").parquet(str(source))
        ingest.ingest(stream, f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint")
    got = [bytes(r["content"]) for r in spark.read.parquet(f"file://{tmp_path}/store").collect()]
    assert sorted(got) == [b"a", b"b", b"c"]


def batch_bytes(spark):
    """The most bytes of an Arrow batch of 64 values of 100 kB in one partition."""
    df = spark.range(64).select(F.expr("cast(repeat('x', 100000) as binary)").alias("content")).coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.column("content").nbytes]}) for b in batches)
    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.fixture
def wide_batches(spark):
    before = spark.conf.get(codecs.BATCH)
    spark.conf.set(codecs.BATCH, "64m")
    yield
    spark.conf.set(codecs.BATCH, before)


def test_contents_come_to_python_in_small_batches(spark, files, wide_batches):
    assert batch_bytes(spark) > 6_000_000
    chunking.content_blocks(files)
    assert batch_bytes(spark) < 2 * codecs.BATCH_BYTES
    spark.conf.set(codecs.BATCH, "64m")
    archive.file_digests(archive.pack(files, archive.PackConfig(block=512)))
    assert batch_bytes(spark) < 2 * codecs.BATCH_BYTES
    # A smaller bound of the session stays.
    spark.conf.set(codecs.BATCH, "128k")
    chunking.content_blocks(files)
    assert spark.conf.get(codecs.BATCH) == "128k" and batch_bytes(spark) < 300_000


@pytest.mark.parametrize("column", [lambda: codecs.compress("lz4")("b"), lambda: codecs.decompress("zstd")("b"), lambda: codecs.byte_shuffle(4)("b"), lambda: codecs.xor_bytes("b", "b"), lambda: codecs.entropy("b"), lambda: codecs.keyed_hash(b"key")("b")])
def test_codecs_are_given_small_batches(spark, wide_batches, column):
    column()
    assert batch_bytes(spark) < 2 * codecs.BATCH_BYTES


def test_changes_of_many_paths_are_taken_in_one_stream(spark):
    """Changes are folded in order of seq, whatever order they come in, and not by a call for each path; values of one path may be larger than a batch."""
    rows = [(s, f"p/{i}", op, content, at, size, None, 1, None) for i in range(300) for s, op, content, at, size in ((4, "truncate", None, None, 5), (1, "put", b"abcdef", None, None), (3, "write", b"XY", 1, None), (2, "write", b"?", 4, None))]
    rows += [(1, "big", "put", bytes(3 << 20), None, None, None, 1, None), (2, "big", "write", b"end", 3 << 20, None, None, 1, None), (3, "gone", "whiteout", None, None, None, None, 1, None), (2, "gone", "put", b"x", None, None, None, 1, None)]
    events = spark.createDataFrame(rows, workspace.EVENTS).repartition(5)
    over = workspace.overlay(events)
    assert "FlatMapGroups" not in over._jdf.queryExecution().executedPlan().toString()
    got = {r["path"]: r for r in over.collect()}
    assert len(got) == 302 and {(bytes(got[f"p/{i}"]["content"]), got[f"p/{i}"]["size"], got[f"p/{i}"]["op"], got[f"p/{i}"]["mode"]) for i in range(300)} == {(b"aXYd?", 5, "put", 0o644)}
    assert bytes(got["big"]["content"]) == bytes(3 << 20) + b"end" and got["gone"]["op"] == "whiteout" and got["gone"]["content"] is None
    assert workspace.overlay(events.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown change"):
        workspace.overlay(spark.createDataFrame([(1, "a", "shout", None, None, None, None, 1, None)], workspace.EVENTS)).collect()


@pytest.mark.parametrize("compression", [None, "lz4"])
def test_payloads_are_dealt_once(spark, files, compression):
    """Contents move to where their hash is, and the blocks that refer to them go there: neither is dealt anew by place."""
    one = archive.pack(files, archive.PackConfig("one", 512, compression=compression))
    read = archive.decoded(one.blocks.where("kind = 'data'"), one, True)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3, plan
    assert {(r["hash"], hashlib.sha256(r["content"]).hexdigest()) for r in read.collect()} == {(r["hash"],) * 2 for r in one.blocks.where("kind = 'data'").collect()}
    # A thin archive stores what its parent lacks, each hash once.
    two = archive.pack(files.withColumn("content", F.concat("content", F.encode(F.lit("more"), "UTF-8"))), archive.PackConfig("two", 512, compression=compression), one)
    own = [r["hash"] for r in two.blocks.where("kind = 'data'").select("hash").distinct().collect()]
    assert sorted(r["store_id"] for r in two.store.collect()) == sorted(own) and not set(own) & {r["hash"] for r in one.blocks.collect()}
