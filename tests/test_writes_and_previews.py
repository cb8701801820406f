"""Key-value tables, logged writes, previews, the faulty source and a converging view, on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import preview
from tidemark.operators import kv, writes
from tidemark.sources import table
from tidemark.sources.faulty import Faulty
from tidemark.streaming import converge


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)


def test_kv_tables(spark):
    t = spark.createDataFrame([("t", "a", "1"), ("t", "ab", "2"), ("t", "b", "3"), ("u", "a", "4")], "table_name string, key string, value string")
    k = spark.createDataFrame([("t", "a"), ("t", "zz")], "table_name string, key string")
    assert rows(kv.put(t, k.withColumn("value", F.lit("9"))), "value") == [("2",), ("3",), ("4",), ("9",), ("9",)]
    assert {r.key: r.value for r in kv.get(t, k).collect()} == {"a": "1", "zz": None}
    assert kv.delete(t, k).count() == 3 and kv.delete_prefix(t, "t", "a").count() == 2
    assert [r.key for r in kv.prefix_scan(t, "t").collect()] == ["a", "ab", "b"] and [r.key for r in kv.range_scan(t, "t", "ab", "b").collect()] == ["ab"]
    with pytest.raises(ValueError):
        kv.delete_prefix(t, "t", "")
    assert (kv.prefix_bound(b"ab"), kv.prefix_bound(b"a\xff"), kv.prefix_bound(b"\xff"), kv.prefix_bound(b"")) == (b"ac", b"b", None, None)


def test_log_snapshot_takes_the_newest_state(spark):
    log = spark.createDataFrame([(1, "put", "a", None), (2, "put", "b", None), (3, "verify", "a", 70), (4, "delete", "b", None), (5, "delete", "nobody", None), (6, "put", "c", None), (7, "delete", "c", None), (8, "put", "c", None), (2, "verify", "c", 5)], "csn long, op string, manifest_digest string, at long")
    assert rows(writes.snapshot(log)) == [("a", 1, 70, 7), ("c", 8, None, 7)]
    assert writes.snapshot(log.limit(0)).count() == 0
    allowed, denied = writes.gated(log)
    assert (allowed.count(), denied.count()) == (2, 7)


def test_guards_claims_marks_and_packs(spark):
    p = spark.createDataFrame([(1, b"abc"), (2, b""), (3, None)], "id long, payload binary")
    assert [x.count() for x in writes.size_guard(p, 2)] == [2, 1] and [x.count() for x in writes.size_guard(p, 0)] == [3, 0]
    t = spark.createDataFrame([("n", 1), ("n", 2)], "name string, seq long")
    claims = spark.createDataFrame([("n", 3, "y"), ("n", 3, "x"), ("n", 2, "w"), ("new", 1, "z")], "name string, seq long, claimant string")
    won, lost = writes.claim_versions(t, claims)
    assert rows(won) == [("n", 3, "x"), ("new", 1, "z")] and rows(lost, "claimant") == [("w",), ("y",)]
    refs = lambda *x: spark.createDataFrame([(r,) for r in x], "blob_ref string")
    marks = writes.mark(writes.mark(refs().withColumn("marked_at", F.lit(0).cast("long")), refs("a"), 5), refs("a", "b", "b"), 9)
    assert rows(marks) == [("a", 5), ("b", 9)] and rows(writes.unmark(marks, refs("a"))) == [("b", 9)]
    none = spark.createDataFrame([], "blob_ref string, pack_ref string, offset long, length long")
    placed = writes.pack(writes.pack(none, spark.createDataFrame([("a", 0, 4), ("b", 4, 2)], "blob_ref string, offset long, length long"), "p1"), spark.createDataFrame([("b", 0, 2)], "blob_ref string, offset long, length long"), "p2")
    assert rows(placed) == [("a", "p1", 0, 4), ("b", "p2", 0, 2)] and rows(writes.unpack(placed, "p2"), "blob_ref") == [("a",)]


def test_namespaces(spark):
    reg = writes.registered(spark.createDataFrame([("one", "n1")], "name string, nsid string"), "two", "n2")
    with pytest.raises(ValueError):
        writes.registered(reg, "one", "n3")
    d = spark.createDataFrame([("a", "one"), ("b", "gone"), ("c", None), ("d", "two")], "manifest_digest string, namespace string")
    taken, rejected = writes.namespaced(d, reg)
    assert rows(taken, "manifest_digest", "nsid") == [("a", "n1"), ("d", "n2")] and rows(rejected, "manifest_digest") == [("b",), ("c",)]
    assert rows(writes.scoped_view(taken, "n1"), "manifest_digest") == [("a",)]
    assert rows(writes.scoped_delete(taken, "n1", d), "manifest_digest") == [("d",)]
    assert rows(writes.unregistered(reg, "one"), "name") == [("two",)]


def test_config_versions(spark):
    h = spark.createDataFrame([], "seq long, field string, value string")
    classes = {"id": "immutable", "token": "session"}
    h = writes.config_change(h, {"id": "x", "limit": "1", "token": "t"}, classes)
    h = writes.config_change(h, {"limit": "2"}, classes)
    assert rows(h.where("seq = 2"), "field", "value") == [("id", "x"), ("limit", "2")]
    with pytest.raises(ValueError):
        writes.config_change(h, {"id": "y"}, classes)
    assert rows(writes.config_rollback(h, 1).where("seq = 3"), "value") == [("1",), ("x",)]
    assert [writes.consensus(x) for x in (["a", "a"], ["a", None], ["a", "b"], [None, None])] == ["a", "a", None, None]


def test_previews(spark):
    data = [bytes(range(256)), b"", None, b"exactly 16 bytes", b"seventeen bytes.."]
    for r in spark.createDataFrame([(b,) for b in data], "b binary").select("b", preview.hex_dump(F.col("b")).alias("x")).collect():
        if r.b is None:
            assert r.x is None
            continue
        want = []
        for i in range(0, len(r.b), 16):
            p = bytes(r.b[i : i + 16])
            half = lambda q: "".join(f"{c:02x} " for c in q).ljust(24)
            want.append(f"{i:08x}  {half(p[:8])} {half(p[8:])} |{''.join(chr(c) if 32 <= c < 127 else '.' for c in p)}|")
        assert r.x == "\n".join(want)
    texts = ['{"a":[1,2]}', "<a><b>x</b></a>", 'a,"b,c"\nd,e', "", None, "[" * 100000, "<a", 'x,"y']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", preview.json_preview("t").alias("j"), preview.xml_preview("t").alias("x"), preview.csv_preview("t").alias("c")).orderBy("i").collect()
    assert json.loads(got[0].j) == {"a": [1, 2]} and "\n  " in got[0].j and "  <b>x</b>" in got[1].x
    assert [json.loads(r) for r in got[2].c] == [["a", "b,c"], ["d", "e"]]
    assert [r.j for r in got[3:]] == [None] * 5 and [r.x for r in got[3:]] == [None] * 5 and got[4].c is None and got[7].c is None
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(preview.media_type(F.lit("a.b/c"))) == "" and one(preview.media_type(F.lit("x/y.JSON"))) == "application/json" and one(preview.media_type(F.lit("y.png"), F.lit("own/type"))) == "own/type"
    assert [one(preview.uptime(F.lit(n))) for n in (0, 61, 3661, 90000)] == ["0s", "1m1s", "1h1m", "1d1h0m"]
    assert one(preview.checkpoint_id(F.expr("timestamp'2024-01-02 03:04:05.000006'"))) == "20240102T030405.000006000Z"


def test_faulty_source(spark):
    read = Faulty(table, on=(2,))
    assert read(spark, "/root/testdata/sf0.001", "region").count() == 5
    with pytest.raises(OSError):
        read(spark, "/root/testdata/sf0.001", "region")
    assert read(spark, "/root/testdata/sf0.001", "region").count() == 5
    with pytest.raises(OSError):
        Faulty(table, rate=1.0)(spark, "/root/testdata/sf0.001", "region")


def test_view_converges_by_delta_and_rebuilds_on_deletes(spark, tmp_path):
    schema, view, did = "op string, k long", set(), []

    def apply(batch, number):
        view.update(r.k for r in batch.collect())
        did.append("delta")

    def rebuild(number):
        log = spark.read.schema(schema).parquet(str(tmp_path / "log"))
        view.clear()
        view.update(r.k for r in log.groupBy("k").agg(F.max(F.col("op") == "delete").alias("gone")).where("NOT gone").collect())
        did.append("rebuild")

    for ops in ([("put", 1), ("put", 2)], [("put", 3)], [("delete", 2), ("put", 4)]):
        spark.createDataFrame(ops, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        converge(stream, apply, rebuild, str(tmp_path / "ck")).awaitTermination()
    assert did == ["delta", "delta", "rebuild"] and view == {1, 3, 4}
