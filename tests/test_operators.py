"""Catalog operators on small rows: paths, metadata states, payload stages, checkpoints, streams."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import payload, views
from tidemark.operators.catalog import every_nth
from tidemark.sources import listing, restore, save_checkpoint
from tidemark.streaming import fire_every


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab/.\0", max_size=8), min_size=1, max_size=8))
def test_path_validity(spark, paths):
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fn.valid_path(F.col("p")).alias("v")).collect()
    for r in rows:
        assert r.v == (r.p != "" and "\0" not in r.p and not any(s in ("", ".", "..") for s in r.p.split("/")))


def test_metadata_states(spark):
    cases = {"": "absent", "[1]": "absent", "nonsense": "absent", '{"a":1}': "absent", '{"vfsmeta":{"version":2,"path":"a"}}': "absent", '{"vfsmeta":{"version":1,"path":"a/b"}}': "ok", '{"vfsmeta":{"version":1,"path":"/a"}}': "error", '{"vfsmeta":{"version":1}}': "error"}
    for ext, want in cases.items():
        assert one(spark, fn.vfs_status(F.lit(ext))) == want, ext


def test_walk_is_in_pre_order(spark):
    tree = spark.createDataFrame([("r", p) for p in ("a", "a/b", "a-b", "a.b/c", "a/b/c")], "root string, path string")
    assert [r.path for r in views.walk(tree, "r", "").collect()] == ["a", "a/b", "a/b/c", "a-b", "a.b/c"]


def test_cipher_last_and_tampering_shows(spark):
    payload.validate(["zstd", "aes-gcm"])
    for stages in (["aes-gcm", "zstd"], ["rot13"]):
        with pytest.raises(ValueError):
            payload.validate(stages)
    key, aad = F.lit(b"0123456789abcdef"), F.lit(b"x")
    frame = payload.seal(F.lit(b"secret"), key, F.lit(b"0" * 12), aad)
    assert bytes(one(spark, payload.unseal(frame, key, aad))) == b"secret"
    assert one(spark, payload.unseal(F.concat(F.substring(frame, 1, 20), F.lit(b"zz")), key, aad)) is None


def test_checkpoint_refuses_to_overwrite_and_restores(spark, tmp_path):
    df = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    save_checkpoint({"t": df}, str(tmp_path / "c"))
    with pytest.raises(Exception):
        save_checkpoint({"t": df}, str(tmp_path / "c"))
    now = spark.createDataFrame([(2, "new"), (3, "new")], "k long, v string")
    assert sorted(map(tuple, restore(spark, str(tmp_path / "c"), now, "t", ["k"]).collect())) == [(1, "old"), (2, "old"), (3, "new")]
    assert listing(spark, str(tmp_path)).count() > 0


def test_counter_stream_fires_every_n(spark, tmp_path):
    spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(12)], "event_id long, event_type string").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("event_id long, event_type string").parquet(str(tmp_path / "log"))
    q = fire_every(stream, 3).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.firings) for r in spark.table("fired").collect()} == {("a", 2), ("b", 1)}


def test_every_nth_over_many_ranges(spark):
    events = spark.createDataFrame([("a" if i % 3 else "b", i * 7) for i in range(500)], "event_type string, event_id long")
    got = sorted(map(tuple, every_nth(events, 10, span=64).collect()))
    want = []
    for t in "ab":
        own = sorted(i * 7 for i in range(500) if ("a" if i % 3 else "b") == t)
        want += [(t, e, (k + 1) // 10) for k, e in enumerate(own) if (k + 1) % 10 == 0]
    assert got == sorted(want)
