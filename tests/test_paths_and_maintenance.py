"""Small cases of the write and read paths, the store, maintenance and what stands around a catalog."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import sources, streaming
from tidemark.functions import preview
from tidemark.operators import catalog as op
from tidemark.operators import kv, maintenance, named, payload, reads, stack, store, views, writes


def one(df):
    return df.first()[0]


def test_orphans_in_their_grace_are_live(spark):
    """A blob without live edges that the catalog still knows is no orphan file."""
    blobs = spark.createDataFrame([("abcd01", 0), ("abcd02", 2)], "blob_ref string, ref_count long")
    manifests = spark.createDataFrame([("beef01",)], "manifest_digest string")
    c = sources.Catalog(None, manifests, None, blobs, None)
    files = spark.createDataFrame([(p,) for p in ("blobs/ab/cd/abcd01", "blobs/ab/cd/abcd02", "blobs/ab/cd/abcd03", "manifests/be/ef/beef01", "manifests/be/ef/abcd01", "blobs/x/notes.txt", "staging/1")], "path string")
    got = {r.path: r["class"] for r in op.scan_files(c, files).collect()}
    assert got == {"blobs/ab/cd/abcd01": "live", "blobs/ab/cd/abcd02": "live", "blobs/ab/cd/abcd03": "orphan_blob", "manifests/be/ef/beef01": "live", "manifests/be/ef/abcd01": "orphan_manifest", "blobs/x/notes.txt": "unparseable", "staging/1": "staging"}
    assert op.orphan_report(op.scan_files(c, files)).first().asDict() == {"staging_removed": 1, "blobs_removed": 1, "manifests_removed": 1, "errors": 1}


def test_user_fields_by_text_number_and_hash(spark):
    rows = spark.createDataFrame([("m1", "a", "f", "7", None, None), ("m2", "b", "f", None, 7, None), ("m3", "b", "f", None, 7, None), ("m4", "c", "f", None, None, "7"), ("m5", None, "f", "7", None, None), ("m6", "d", "g", "7", None, None)], "manifest_digest string, artifact_id string, field string, value_text string, value_number long, value_hash string")
    ids = lambda v, **k: sorted(r[0] for r in op.usr_query(rows, "f", v, **k).collect())
    assert ids("7") == ["a", "b", "c"] and ids("+7") == ["b"] and ids(" 7 ") == [] and ids("7", indexing=False) == [] and ids("99999999999999999999") == []


def test_display_forms(spark):
    s = spark.range(1)
    size = lambda n: one(s.select(fn.human_bytes(F.lit(n).cast("long"))))
    assert [size(n) for n in (500, -1536, 1 << 20, 3 << 40, 5 << 50)] == ["500 B", "1.5 KiB", "1.0 MiB", "3.0 TiB", "5120.0 TiB"]
    up = lambda n: one(s.select(preview.uptime(F.lit(n).cast("long"))))
    assert [up(n) for n in (42, 242, 11820, 5 * 86400 + 7200, -42)] == ["42s", "4m2s", "3h17m", "5d2h0m", "42s"]
    assert one(s.select(fn.merged_ext(F.lit('{"b":{"z":[1,2.50,null]},"a":1}'), F.lit("n"), F.lit("true")))) == '{"a":1,"b":{"z":[1,2.5,null]},"n":true}'
    assert one(s.select(fn.merged_ext(F.lit("[1]"), F.lit("n"), F.lit("1")))) is None and one(s.select(fn.merged_ext(F.lit(None).cast("string"), F.lit("n"), F.lit("1")))) == '{"n":1}'
    moments = [one(s.select(fn.parsed_rfc3339(F.lit(t)))) for t in ("1970-01-01T00:01:00Z", "1970-01-01T01:00:00+01:00", "", "1970-13-01T00:00:00Z", "1970-01-01 00:00:00")]
    assert moments == [60, 0, None, None, None]
    assert one(s.select(fn.is_under(F.lit(""), ""))) is False


def test_upsert_keeps_one_row_a_key(spark):
    rows = spark.createDataFrame([("t", "a", "1")], "table_name string, key string, value string")
    new = spark.createDataFrame([("t", "b", "2"), ("t", "b", "3"), ("t", "a", "9")], rows.schema)
    assert sorted(map(tuple, kv.put(rows, new).collect())) == [("t", "a", "9"), ("t", "b", "3")]


def test_store_listing_and_publishing(spark):
    f = spark.createDataFrame([("a/b/x", 1, 10), ("a/y", 2, 20), ("a/.tmp-1", 3, 30), ("a/b/x.tombstone", 0, 5)], "path string, length long, mtime long")
    assert [(r.name, r.is_dir, r.length) for r in store.children(f, "a").collect()] == [("b", True, 0), ("y", False, 2)]
    with pytest.raises(FileNotFoundError):
        store.children(f, "none")
    assert store.below(f, "none").count() == 0 and store.below(f, "a", 20).count() == 2 and one(store.count_objects(f)) == 2
    after, refused = store.put(f, spark.createDataFrame([("a/y", 9, 40), ("a/z", 8, 40)], f.schema), exclusive=True)
    assert refused.first().path == "a/y" and after.count() == 5
    assert {r.path: r.length for r in store.renamed(f, spark.createDataFrame([("a/b/x", "a/y"), ("gone", "new")], "path string, target string")).collect()} == {"a/y": 1, "a/.tmp-1": 3, "a/b/x.tombstone": 0}
    dirs = spark.createDataFrame([("a",), ("a/b",), ("c",), ("c/d",)], "path string")
    assert sorted(r[0] for r in store.empty_dirs(dirs, f).collect()) == ["c", "c/d"]


def test_backends_and_configuration(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert store.dial(spark, str(tmp_path / "t")).count() == 3 == store.dial(spark, f"parquet://{tmp_path}/t").count()
    with pytest.raises(ValueError):
        store.dial(spark, "nowhere://x")
    with pytest.raises(ValueError):
        store.register("json", None)
    (tmp_path / "c.yaml").write_text("# a comment\nuri: 'x'\ninline_limit: 100\n")
    c = store.Config.load(str(tmp_path / "c.yaml"))
    assert (c.uri, c.inline_limit) == ("x", 100) and "inline_limit = 100" in c.explain()
    for bad in ('{"inline_limit": "a"}', '{"other": 1}', '{"topology": "round"}', '{"inline_limit": 70000}'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(ValueError):
            store.Config.load(str(tmp_path / "c.json"))


def test_checkpoint_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "cp")
    sources.save_checkpoint({"a": spark.range(2), "b": spark.range(3)}, path)
    assert sorted(os.listdir(path)) == ["a", "b"]
    with pytest.raises(FileExistsError):
        sources.save_checkpoint({"a": spark.range(2)}, path)
    broken = spark.range(1).select(F.raise_error(F.lit("x")).alias("x"))
    with pytest.raises(Exception):
        sources.save_checkpoint({"a": spark.range(2), "b": broken}, str(tmp_path / "cp2"))
    assert not (tmp_path / "cp2").exists()


def test_put_batch_and_stages(spark):
    blobs = spark.createDataFrame([], "blob_ref string, content_hash string, original_size long, crypto_identity string, ref_count long")
    c = sources.Catalog(None, None, None, blobs, None)
    rows = spark.createDataFrame([(1, bytearray(b"x" * 5000), "s", "{}", None), (2, bytearray(b"x" * 5000), "t", "{}", None), (3, bytearray(b"small"), "s", "{}", 9), (4, bytearray(b""), "", "{}", None)], "id long, payload binary, session_id string, ext string, retention_until long")
    got = {r.id: r for r in writes.put_batch(rows, c, 0, stages=("zstd",)).collect()}
    assert [got[k].action for k in (1, 2, 3, 4)] == ["stored", "deduplicated", "inline", "inline"] and got[1].blob_ref == got[2].blob_ref != got[1].content_hash
    assert bytes(got[3].inline) == b"small" and got[3].stored is None and got[1].manifest_digest != got[2].manifest_digest
    with pytest.raises(ValueError):
        payload.run_stages(rows, ["rot13"])
    back = payload.undo_stages(spark.createDataFrame([(bytearray(got[1].stored),), (bytearray(b"junk"),)], "stored binary"), ["zstd", "unknown"]).collect()
    assert bytes(back[0].payload) == b"x" * 5000 and back[1].payload is None


def test_put_batch_leaves_no_ties(spark):
    blobs = spark.createDataFrame([], "blob_ref string, content_hash string, original_size long, crypto_identity string, ref_count long")
    c = sources.Catalog(None, None, None, blobs, None)
    text = bytearray(b"x" * 5000)
    rows = [({"k": i}, i, text, "s", "{}", None) for i in range(9, 1, -1)] + [({}, 1, text, None, "{}", None), ({}, 0, text, "s", None, None)]
    put = spark.createDataFrame(rows, "tags map<string,int>, id long, payload binary, session_id string, ext string, retention_until long").coalesce(1)
    assert [r.id for r in writes.put_batch(put, c, 0).where("action = 'stored'").collect()] == [2]
    dated = put.where("id > 1").select(F.lit(1).alias("id"), "payload", "session_id", "ext", F.col("id").alias("retention_until"))
    assert [r.retention_until for r in writes.put_batch(dated, c, 0).where("action = 'stored'").collect()] == [2]


def test_put_batch_query_gives_ties_to_the_smallest_document(spark, tmp_path):
    import duckdb

    from tidemark.plans import more_queries  # noqa: F401  (registers)
    from tidemark.plans.catalog_queries import ORACLES, QUERIES

    same = 2 * 11 * 13 * 37  # documents so far apart have the same metadata and the same parity
    docs = [(first + k * same, letter * 5000, "en", "src0") for first, letter in ((1, "a"), (3, "b"), (5, "c"), (2, "d")) for k in range(5, -1, -1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "error")], "event_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["put_batch"](spark, str(tmp_path)).select("doc_id", "artifact_id", "action", "blob_ref").collect()
    assert sorted(r.doc_id for r in got if r.action == "stored") == [1, 3, 5]
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLES["put_batch"]).fetchall())


def test_random_access_needs_plain_bytes(spark):
    rows = spark.createDataFrame([("inline", bytearray(b"0123456789")), ("target", bytearray(b"0123")), ("corrupt", None)], "state string, payload binary")
    assert [r.part_state for r in reads.read_at(rows, 2, 4).collect()] == ["ok", "end", "corrupt"]
    assert [r.part_state for r in reads.read_at(rows, 2, 4, ("zstd",)).collect()] == ["not_supported", "not_supported", "corrupt"]
    errors = [one(rows.limit(1).select(payload.fragment_error(F.col("payload"), *x))) for x in ((-1, 2), (3, 3), (0, 11), (0, 10))]
    assert errors == ["negative_start", "empty_range", "beyond_end", None]


def test_rollback_needs_a_session_and_is_whole(spark):
    m = spark.createDataFrame([("a", "s", None), ("b", "s", 50), ("c", "t", 1)], "manifest_digest string, session_id string, retention_until long")
    c = sources.Catalog(None, m, None, None, None)
    with pytest.raises(ValueError):
        writes.rollback(c, "", 0)
    assert writes.rollback(c, "s", 10).count() == 0 and writes.rollback(c, "s", 60).count() == 2 and writes.rollback(c, "t", 10).count() == 1


def test_rebuild_skips_containers_and_damaged_documents(spark):
    good = '{"ext":{},"sys":{"artifact_id":"sha256-01","blob_refs":["abcd"],"content_hash":"abcd","created_at":"1970-01-01T00:00:05Z","layout_header":{"blob_storage":"Target"},"original_size":9,"schema_version":1,"session_id":"s"}}'
    docs = [good, good.replace("sha256-01", ""), good.replace('"ext":{}', '"ext":{"composite":true}'), good.replace('"session_id"', '"other":1,"session_id"'), "no json"]
    rows = spark.createDataFrame([(d, 5) for d in docs], "document string, mtime long").withColumn("path", F.concat(F.lit("manifests/"), F.sha2("document", 256)))
    rows = rows.unionByName(spark.createDataFrame([(good, 9, "manifests/abcdef")], "document string, mtime long, path string"))
    assert [r.state for r in maintenance.rebuilt(rows).collect()] == ["indexed", "skipped", "skipped", "damaged", "damaged", "damaged"]
    assert maintenance.rebuilt(rows, 6).count() == 1 and maintenance.rebuilt(rows).first().created_at == 5


def test_leases_and_liveness(spark):
    none = spark.createDataFrame([], "name string, holder string, expires long")
    a, ok = maintenance.lease(none, "gc", "me", 0, 10)
    assert ok and not maintenance.lease(a, "gc", "you", 5, 10)[1] and maintenance.lease(a, "gc", "me", 5, 10)[1]
    b, ok = maintenance.lease(a, "gc", "you", 10, 10)
    assert ok and b.first().holder == "you" and maintenance.released_lease(b, "gc", "me").count() == 1 and maintenance.released_lease(b, "gc", "you").count() == 0
    assert maintenance.live(lambda: 1) == (True, "") and maintenance.live(lambda: 1 / 0)[0] is False


def test_wrappers_extensions_bus_and_scheduler(spark):
    rows = spark.range(10)
    gate = stack.Wrapper("gate", "gate", lambda d: d.where("id > 1"), False)
    scope = stack.Wrapper("scope", "scope", lambda d: d.where("id < 5"), False)
    assert stack.stacked([gate, scope])(rows).count() == 3
    for bad in ([scope, gate], [gate, gate], [stack.Wrapper("x", "odd", lambda d: d)]):
        with pytest.raises(ValueError):
            stack.stacked(bad)
    with pytest.raises(ValueError):
        stack.stacked([stack.Wrapper("w", "observe", lambda d: d.withColumn("y", F.lit(1)))])(rows)
    assert stack.installed([stack.Extension("a", jobs={"j": print}), stack.Extension("b", wrapper=gate)])["wrappers"] == [gate]
    with pytest.raises(ValueError):
        stack.installed([stack.Extension("a", jobs={"j": print}), stack.Extension("b", jobs={"j": print})])
    seen, bus = [], stack.Bus()
    off = bus.subscribe("one", lambda k, p: seen.append((1, k)))
    bus.subscribe("bad", lambda k, p: 1 / 0)
    bus.subscribe("two", lambda k, p: seen.append((2, k)))
    bus.publish("saved", {})
    off()
    bus.publish("gone", {})
    assert seen == [(1, "saved"), (2, "saved"), (2, "gone")] and [f[0] for f in bus.failures] == ["bad", "bad"]
    start, ran = datetime(2024, 1, 1), []
    job = stack.Job("j", lambda: ran.append(1), start, every=timedelta(hours=1))
    assert stack.tick([job], start + timedelta(hours=5, minutes=7)) == ["j"] and ran == [1] and job.due == start + timedelta(hours=6)
    cron = stack.Job("c", lambda: None, start, rule="30 4 * * *")
    stack.tick([cron], start + timedelta(days=3))
    assert cron.due == start + timedelta(days=3, hours=4, minutes=30)


def test_indexes_projections_and_named_scopes(spark):
    ix = writes.Indexes({"old": 3})
    ix.register("lang", 1, lambda m: m)
    for name, version in (("lang", 2), ("old", 2)):
        with pytest.raises(ValueError):
            ix.register(name, version, lambda m: m)
    assert ix.listed() == [("lang", 1), ("old", 3)]
    m = spark.createDataFrame([("d1", "en")], "manifest_digest string, lang string")
    twice = {"x": lambda t: t.select("manifest_digest", F.lit("f").alias("field"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("value"))}
    assert [r.value for r in writes.projections(m, twice).collect()] == ["b"] and writes.projections(m, twice, indexing=False).count() == 0
    empty = spark.createDataFrame([], "name string, seq long, payload string")
    new = spark.createDataFrame([("a", "ok")], "name string, payload string")
    assert named.scoped_put(empty, new, "s").first().name == "s/a"
    with pytest.raises(ValueError):
        named.scoped_put(empty, new, "s", veto=F.col("payload") == "ok")


def test_view_listing_errors_and_wait(spark):
    t = spark.createDataFrame([("r", "d", "d", "", True, 0, None), ("r", "d/f", "f", "d", False, 5, 7)], "root string, path string, name string, parent string, is_dir boolean, size long, mtime long")
    assert [r.name for r in views.listed(t, "r", "d").collect()] == ["f"] == [r.name for r in views.page(views.listed(t, "r", "d"), 9).collect()]
    for path, error in (("x", FileNotFoundError), ("d/f", NotADirectoryError)):
        with pytest.raises(error):
            views.listed(t, "r", path)
    with pytest.raises(ValueError):
        views.removed_tree(t, "r", "")
    clock = iter([1, 1, 2])
    assert streaming.wait(lambda: next(clock), 1, 0.01) == 2 and streaming.wait(lambda: 0, 1, 0.01, 0.05) is None
    assert [r.id for r in op.first_rows(spark.range(100), lambda r: r.id < 7, 5)] == [0, 1, 2, 3, 4]


def test_eviction_takes_equal_moments_whole_or_by_hash(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(1, 50), 100 if k % 3 else rng.randrange(100), k % 7 == 0) for k in range(300)]
    df = spark.createDataFrame([(i, s, t, int(h)) for i, s, t, h in rows], "entry long, size long, last_access long, holders int")
    total, cap = sum(r[1] for r in rows), 2000
    gone = {r.entry: r.size for r in op.evict(df, cap).collect()}
    kept_idle = [r for r in rows if r[0] not in gone and not r[3]]
    last = max(r[2] for r in rows if r[0] in gone)
    assert total - sum(gone.values()) <= cap or not kept_idle
    assert all(r[2] >= last for r in kept_idle) and not any(r[3] and r[0] in gone for r in rows)
    assert total - sum(gone.values()) + max(gone.values()) > cap


def test_stream_hooks(spark, tmp_path):
    log = spark.createDataFrame([(1, "put", "d1"), (2, "delete", "d1"), (3, "put", "d2")], "csn long, op string, manifest_digest string")
    log.write.parquet(str(tmp_path / "log"))
    feed = lambda: streaming.feed(spark, str(tmp_path / "log"), "csn long, op string, manifest_digest string")
    streaming.audited(feed(), str(tmp_path / "audit"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 3
    got = []
    streaming.indexed(feed(), {"x": lambda d: d.select("manifest_digest")}, lambda rows, n: got.extend(map(tuple, rows.collect())), str(tmp_path / "c2")).awaitTermination()
    assert sorted(got) == [("d1", "x"), ("d2", "x")]
    assert time.time() > 0
