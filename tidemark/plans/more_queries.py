"""Registered queries over the write and read paths, the store, maintenance and the views, with the SQL that checks each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.functions import preview
from tidemark.operators import catalog as op
from tidemark.operators import kv, maintenance, named, payload, reads, stack, store, views, writes
from tidemark.plans.catalog_queries import FILES, GC, NOW, files, index_rows, query, registry, simple, tombstones, tree
from tidemark.sources import DAY, EPOCH, catalog, table, union_all, versions

DOC_PATH = "'manifests/' || substr(manifest_digest, 1, 2) || '/' || substr(manifest_digest, 3, 2) || '/' || manifest_digest"
LAYOUT = "CASE WHEN blob_ref IS NULL THEN 'inline' ELSE 'target' END"


def payloads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))


def store_files(c) -> DataFrame:
    """The store's files with length and modification time; a few are temporary or marked."""
    rows = files(c).withColumn("length", F.length("path").cast("long")).withColumn("mtime", (EPOCH + F.ascii(F.substring_index("path", "/", -1)) * 60).cast("long"))
    odd = c.puts.where("doc_id % 23 = 0").select(F.concat(F.lit("blobs/.tmp-"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).cast("long").alias("length"), F.lit(EPOCH).cast("long").alias("mtime"))
    return rows.unionByName(odd)


STORE = f"(SELECT path, CAST(length(path) AS BIGINT) AS length, {EPOCH} + ascii(string_split(path, '/')[-1]) * 60 AS mtime FROM {FILES} UNION ALL SELECT 'blobs/.tmp-' || doc_id, 1, {EPOCH} FROM p WHERE doc_id % 23 = 0)"
VISIBLE = "path NOT LIKE '%/.tmp-%' AND path NOT LIKE '%.tombstone'"

# store
simple("store_children", lambda c: store.children(store_files(c), "blobs"), f"SELECT name, is_dir, CAST(sum(CASE WHEN is_dir THEN 0 ELSE length END) AS BIGINT) AS length FROM (SELECT string_split(substr(path, 7), '/')[1] AS name, contains(substr(path, 7), '/') AS is_dir, length FROM {STORE} WHERE starts_with(path, 'blobs/') AND {VISIBLE}) GROUP BY 1, 2")
simple("store_since", lambda c: store.below(store_files(c), "blobs", EPOCH + 100 * 60), f"SELECT path, length, mtime FROM {STORE} WHERE starts_with(path, 'blobs/') AND mtime >= {EPOCH + 6000}")
simple("store_count", lambda c: store.count_objects(store_files(c), "manifests").withColumn("prefix", F.lit("manifests")).unionByName(store.count_objects(store_files(c)).withColumn("prefix", F.lit(""))), f"SELECT 'manifests' AS prefix, count(*) AS n FROM {STORE} WHERE starts_with(path, 'manifests/') UNION ALL SELECT '', count(*) FROM {STORE} WHERE {VISIBLE}")
simple("store_stat", lambda c: store.stat(store_files(c), c.puts.select(fn.blob_path(F.col("content_hash"), "packs").alias("path")).distinct().unionByName(c.manifests.select(fn.blob_path(F.col("manifest_digest"), "manifests").alias("path")))), f"SELECT w.path, s.path IS NOT NULL AS found, length, mtime FROM (SELECT DISTINCT 'packs/' || substr(content_hash, 1, 2) || '/' || substr(content_hash, 3, 2) || '/' || content_hash AS path FROM p UNION ALL SELECT {DOC_PATH} FROM m) w LEFT JOIN {STORE} s ON s.path = w.path")


def moves(c) -> DataFrame:
    return c.puts.where("doc_id % 19 = 0").select(F.concat(F.lit("staging/put-"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("done/"), F.col("doc_id").cast("string")).alias("target"))


simple("store_renamed", lambda c: store.renamed(store_files(c), moves(c)).select("path", "length"), f"SELECT CASE WHEN starts_with(path, 'staging/put-') THEN 'done/' || substr(path, 13) ELSE path END AS path, length FROM {STORE}")
simple("store_cloned", lambda c: store.cloned(store_files(c), moves(c), NOW).where("path LIKE 'staging/%' OR path LIKE 'done/%'"), f"SELECT path, length, mtime FROM {STORE} WHERE starts_with(path, 'staging/') UNION ALL SELECT 'done/' || substr(path, 13), length, {NOW} FROM {STORE} WHERE starts_with(path, 'staging/put-')")
simple("store_exclusive", lambda c: store.put(store_files(c), store_files(c).where("path LIKE 'staging/%'").unionByName(moves(c).select(F.col("target").alias("path"), F.lit(0).cast("long").alias("length"), F.lit(NOW).cast("long").alias("mtime"))), True)[1].select("path"), f"SELECT path FROM {STORE} WHERE starts_with(path, 'staging/')")
simple("store_removed", lambda c: store.removed(store_files(c), moves(c)).agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM {STORE} WHERE NOT starts_with(path, 'staging/')")
simple("tombstone_info", lambda c: store.tombstone_info(c.blobs.select(F.col("blob_ref").alias("path"), F.col("original_size").alias("length")), tombstones(c).select(F.col("blob_ref").alias("path"), "marked_at")), f"SELECT blob_ref AS path, original_size AS length, ascii(blob_ref) % 3 <> 0 AS marked, CASE WHEN ascii(blob_ref) % 3 <> 0 THEN {EPOCH} + (ascii(blob_ref) % 40) * {DAY} END AS marked_at FROM blobs")
simple("empty_dirs", lambda c: store.empty_dirs(store.parents(files(c)), files(c).where("path NOT LIKE 'blobs/%'")), f"SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM {FILES} WHERE starts_with(path, 'blobs/')")

# write path
simple("walk_order", lambda c: op.walk(c).orderBy("created_at", "manifest_digest").select("manifest_digest", "created_at"), "SELECT manifest_digest, created_at FROM m ORDER BY created_at, manifest_digest")


@query(f"""SELECT doc_id, artifact_id, CASE WHEN original_size <= 4096 THEN 'inline' WHEN content_hash IN (SELECT blob_ref FROM blobs WHERE blob_ref IN (SELECT blob_ref FROM p WHERE doc_id % 2 = 0)) THEN 'deduplicated' WHEN rn > 1 THEN 'deduplicated' ELSE 'stored' END AS action, blob_ref
FROM (SELECT *, row_number() OVER (PARTITION BY content_hash, original_size ORDER BY session_id, ext, doc_id) AS rn FROM p)""")
def put_batch(spark, sf_dir):
    """Every document put again into a catalog that knows the blobs of every second one."""
    c = catalog(spark, sf_dir)
    half = c.puts.where("doc_id % 2 = 0 AND blob_ref IS NOT NULL").select("blob_ref").distinct()
    known = type(c)(c.puts, c.manifests, c.edges, c.blobs.join(half, "blob_ref", "left_semi"), c.gone)
    rows = payloads(spark, sf_dir).join(c.puts.select("doc_id", "session_id", "ext", F.lit(None).cast("long").alias("retention_until")), "doc_id")
    put = writes.put_batch(rows, known, NOW)
    return put.select("doc_id", "artifact_id", "action", "blob_ref")


@query(f"SELECT manifest_digest, sha256('{{\"ext\":{{}},\"sys\":{{\"artifact_id\":\"\",\"blob_refs\":[\"' || content_hash || '\"],\"content_hash\":\"' || content_hash || '\",\"created_at\":\"' || strftime(make_timestamp(CAST({NOW} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '\",\"layout_header\":{{\"blob_storage\":\"Target\"}},\"original_size\":' || original_size || ',\"schema_version\":1,\"session_id\":\"\"}}}}') = manifest_digest AS same FROM (SELECT DISTINCT content_hash, original_size, sha256('{{\"ext\":{{}},\"sys\":{{\"artifact_id\":\"\",\"blob_refs\":[\"' || content_hash || '\"],\"content_hash\":\"' || content_hash || '\",\"created_at\":\"' || strftime(make_timestamp(CAST({NOW} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '\",\"layout_header\":{{\"blob_storage\":\"Target\"}},\"original_size\":' || original_size || ',\"schema_version\":1,\"session_id\":\"\"}}}}') AS manifest_digest FROM p)")
def headless_put(spark, sf_dir):
    return writes.headless(payloads(spark, sf_dir).select("payload"), NOW).select("manifest_digest", F.lit(True).alias("same")).distinct()


simple("delete_checked", lambda c: writes.delete_checked(c.puts.select("artifact_id").unionByName(c.puts.limit(1).select(F.lit("sha256-none").alias("artifact_id"))), c, NOW), f"SELECT artifact_id, arg_max(manifest_digest, csn) FILTER (WHERE live) AS manifest_digest, CASE WHEN count(*) FILTER (WHERE live) = 0 THEN 'not_found' WHEN arg_max(coalesce(retention_until, 0), csn) FILTER (WHERE live) > {NOW} THEN 'retention' ELSE 'deleted' END AS outcome FROM (SELECT *, doc_id NOT IN (SELECT doc_id FROM gone) AS live FROM p) GROUP BY 1 UNION ALL SELECT 'sha256-none', NULL, 'not_found'")
simple("delete_forbidden", lambda c: writes.delete_checked(c.puts.select("artifact_id"), c, NOW, True).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN count(*) FILTER (WHERE live) = 0 THEN 'not_found' WHEN arg_max(coalesce(retention_until, 0), csn) FILTER (WHERE live) > {NOW} THEN 'retention' ELSE 'forbidden' END AS outcome FROM (SELECT *, doc_id NOT IN (SELECT doc_id FROM gone) AS live FROM p) GROUP BY artifact_id) GROUP BY 1")
simple("rollback_session", lambda c: writes.rollback(c, "src3", EPOCH + 80 * DAY), "SELECT manifest_digest FROM m WHERE session_id = 'src3'")
simple("rollback_held", lambda c: writes.rollback(c, "src3", EPOCH), "SELECT manifest_digest FROM m WHERE session_id = 'src3' AND (SELECT count(retention_until) FROM m WHERE session_id = 'src3') = 0")


def whole_log(c) -> DataFrame:
    """The history of the catalog as a log of whole put rows, stamps and deletes."""
    put = c.puts.select(*writes.MANIFEST_COLUMNS, "csn", F.lit("put").alias("op"), F.lit(None).cast("long").alias("at"))
    stamp = c.puts.where("last_verified_at IS NOT NULL").select("manifest_digest", (F.col("csn") + 500_000_000).alias("csn"), F.lit("verify").alias("op"), F.col("last_verified_at").alias("at"))
    gone = c.gone.select("manifest_digest", F.col("delete_csn").alias("csn"), F.lit("delete").alias("op"))
    again = put.where("csn % 10 = 0")  # a digest put twice is one manifest
    return put.unionByName(again).unionByName(stamp, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


simple("log_manifests", lambda c: writes.catalog_of(whole_log(c))[0].select("manifest_digest", "artifact_id", "session_id", "blob_ref", "original_size", "created_at", "csn", "last_verified_at"), "SELECT manifest_digest, artifact_id, session_id, blob_ref, original_size, created_at, csn, last_verified_at FROM m")
simple("log_edges", lambda c: writes.catalog_of(whole_log(c))[1].select("manifest_digest", "blob_ref", F.col("position").cast("long").alias("position")), "SELECT manifest_digest, blob_ref, CAST(position AS BIGINT) AS position FROM edges")
simple("log_blobs", lambda c: writes.catalog_of(whole_log(c))[2].select("blob_ref", "original_size", "ref_count"), "SELECT blob_ref, original_size, ref_count FROM blobs")
simple("log_numbers", lambda c: writes.log_of_puts(c.puts.select("manifest_digest"), 7).select("manifest_digest", "csn"), "SELECT manifest_digest, 6 + row_number() OVER (ORDER BY manifest_digest) AS csn FROM p")
simple("usr_projections", lambda c: writes.projections(c.manifests, {"size": lambda m: m.select("manifest_digest", F.lit("class").alias("field"), F.expr("CAST(length(CAST(original_size AS string)) AS string)").alias("value")), "lang": lambda m: m.select("manifest_digest", F.lit("lang").alias("field"), F.col("lang").alias("value"))}), "SELECT manifest_digest, 'lang' AS index, 'lang' AS field, lang AS value FROM m UNION ALL SELECT manifest_digest, 'size', 'class', CAST(length(CAST(original_size AS VARCHAR)) AS VARCHAR) FROM m")
simple("orphan_guard", lambda c: op.gc_plan(c, tombstones(c), NOW, 7 * DAY).where("action = 'sweep'").join(c.edges.select("blob_ref"), "blob_ref", "left_anti").select("blob_ref"), f"SELECT blob_ref FROM {GC} WHERE action = 'sweep'")

# read path
@query("SELECT artifact_id, arg_max(content_hash, csn) AS content_hash, CASE WHEN arg_max(original_size, csn) <= 4096 THEN 'inline' WHEN arg_max(content_hash, csn) IN (SELECT content_hash FROM p WHERE doc_id % 5 = 0) THEN 'corrupt' ELSE 'target' END AS state, CASE WHEN arg_max(original_size, csn) > 4096 AND arg_max(content_hash, csn) IN (SELECT content_hash FROM p WHERE doc_id % 5 = 0) THEN NULL ELSE arg_max(content_hash, csn) END AS read_hash FROM m GROUP BY 1 UNION ALL SELECT 'sha256-none', NULL, 'not_found', NULL")
def open_payload(spark, sf_dir):
    return opened_rows(spark, sf_dir).select("artifact_id", "content_hash", "state", F.sha2("payload", 256).alias("read_hash"))


def opened_rows(spark, sf_dir) -> DataFrame:
    """Every live handle and one unknown, opened; blobs lie compressed, and those of every fifth document are lost."""
    c, docs = catalog(spark, sf_dir), payloads(spark, sf_dir)
    lost = c.puts.where("doc_id % 5 = 0").select("content_hash")
    one = c.puts.where("blob_ref IS NOT NULL").join(lost, "content_hash", "left_anti").groupBy("blob_ref").agg(F.min("doc_id").alias("doc_id"))
    stored = payload.run_stages(one.join(docs, "doc_id").select(F.col("blob_ref").alias("ref"), "payload"), ["zstd"]).select(F.col("ref").alias("blob_ref"), "stored")
    inline = c.manifests.where("blob_ref IS NULL").select("doc_id", "manifest_digest").join(docs, "doc_id").select("manifest_digest", F.col("payload").alias("inline"))
    wanted = c.manifests.select("artifact_id").distinct().unionByName(spark.range(1).select(F.lit("sha256-none").alias("artifact_id")))
    return reads.opened(wanted, c, stored, inline, ("zstd",))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN arg_max(original_size, csn) > 4096 AND arg_max(content_hash, csn) IN (SELECT content_hash FROM p WHERE doc_id % 5 = 0) THEN 'corrupt' ELSE 'ok' END AS verdict FROM m GROUP BY artifact_id UNION ALL SELECT 'not_found') GROUP BY 1")
def verify_artifact(spark, sf_dir):
    return reads.verified(opened_rows(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT blob_ref, consumer, CASE WHEN consumer IS NULL THEN 'not_found' WHEN blob_ref IN (SELECT content_hash FROM p WHERE doc_id % 5 = 0) THEN 'corrupt' ELSE 'ok' END AS verdict FROM blobs LEFT JOIN (SELECT blob_ref, min(manifest_digest) AS consumer FROM edges GROUP BY 1) e USING (blob_ref)")
def verify_by_blob(spark, sf_dir):
    c = catalog(spark, sf_dir)
    lost = c.puts.where("doc_id % 5 = 0").select("content_hash")
    one = c.puts.where("blob_ref IS NOT NULL").join(lost, "content_hash", "left_anti").groupBy("blob_ref").agg(F.min("doc_id").alias("doc_id"))
    stored = one.join(payloads(spark, sf_dir), "doc_id").select("blob_ref", F.col("payload").alias("stored"))
    return reads.verified_blobs(c.blobs, c, stored)


@query("SELECT artifact_id, CASE WHEN state NOT IN ('inline', 'target') THEN state WHEN size < 4050 THEN 'end' ELSE 'ok' END AS part_state, CASE WHEN state IN ('inline', 'target') THEN greatest(0, least(50, size - 4000)) END AS part_size FROM (SELECT artifact_id, arg_max(original_size, csn) AS size, CASE WHEN arg_max(original_size, csn) <= 4096 THEN 'inline' WHEN arg_max(content_hash, csn) IN (SELECT content_hash FROM p WHERE doc_id % 5 = 0) THEN 'corrupt' ELSE 'target' END AS state FROM m GROUP BY 1 UNION ALL SELECT 'sha256-none', NULL, 'not_found')")
def random_access(spark, sf_dir):
    return reads.read_at(opened_rows(spark, sf_dir), 4000, 50).select("artifact_id", "part_state", F.octet_length("part").cast("long").alias("part_size"))


@query("SELECT policy, native, sealed, CASE policy WHEN 'ForceEnabled' THEN true WHEN 'Disabled' THEN false ELSE NOT native AND NOT sealed END AS verify FROM (SELECT unnest(['ForceEnabled', 'Disabled', 'Auto', '']) AS policy) CROSS JOIN (SELECT unnest([true, false]) AS native) CROSS JOIN (SELECT unnest([true, false]) AS sealed)")
def verify_policy(spark, sf_dir):
    flags = [(p, n, s) for p in ("ForceEnabled", "Disabled", "Auto", "") for n in (True, False) for s in (True, False)]
    rows = spark.createDataFrame(flags, "policy string, native boolean, sealed boolean")
    return rows.withColumn("verify", reads.verify_on_read(F.col("policy"), F.col("native"), F.col("sealed")))


@query("SELECT doc_id, content_hash, sha256(hex(encode(text))) AS first_hash, sha256(to_base64(encode(hex(encode(text))))) AS blob_ref, content_hash AS back_hash FROM p")
def stage_chain(spark, sf_dir):
    stages = ["hex", "base64"]
    rows = payload.run_stages(payloads(spark, sf_dir), stages)
    back = payload.undo_stages(rows.drop("payload"), stages)
    return back.select("doc_id", "content_hash", F.col("hashes")[0].alias("first_hash"), "blob_ref", F.sha2("payload", 256).alias("back_hash"))


@query("SELECT doc_id, content_hash AS back_hash, CAST(greatest(1, ceil(original_size / 4096.0)) AS BIGINT) AS frames FROM p")
def sealed_format(spark, sf_dir):
    key, aad = F.lit(b"0123456789abcdef"), F.lit(b"tidemark")
    part = payloads(spark, sf_dir).select("doc_id", F.sha2("payload", 256).alias("h"), F.explode(payload.segments(F.col("payload"), 4096)).alias("s"))
    sealed = part.select("doc_id", "s.index", "s.part", payload.convergent_iv(b"0123456789abcdef", "k1")("h", "s.index").alias("iv"))
    # the frame keeps its iv apart, so it is cut from what the cipher gives
    sealed = sealed.withColumn("sealed", F.expr("substring(aes_encrypt(part, unhex('30313233343536373839616263646566'), 'GCM', 'DEFAULT', iv, unhex('746964656d61726b')), 13)"))
    whole = sealed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "iv", "sealed"))).alias("f")).select("doc_id", payload.sealed_frames(F.col("f"), 4096).alias("raw"))
    frames = whole.select("doc_id", F.posexplode(payload.parsed_frames("raw")).alias("index", "f"))
    opened = frames.select("doc_id", "index", F.hex(payload.unseal(F.concat("f.iv", "f.sealed"), key, aad)).alias("x"))
    back = opened.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "x"))), lambda s: s["x"]), "").alias("x"), F.count(F.lit(1)).alias("frames"))
    return back.select("doc_id", F.sha2(F.unhex("x"), 256).alias("back_hash"), "frames")


simple("overlay", lambda c: reads.overlaid(c.blobs.select("blob_ref"), c.blobs.where("ascii(blob_ref) % 2 = 0").select("blob_ref", F.lit("pack").alias("pack_ref"), F.lit(0).cast("long").alias("offset"), F.col("original_size").alias("length"))), "SELECT blob_ref, CASE WHEN ascii(blob_ref) % 2 = 0 THEN 'pack' END AS pack_ref, CASE WHEN ascii(blob_ref) % 2 = 0 THEN 0 END AS offset, CASE WHEN ascii(blob_ref) % 2 = 0 THEN original_size END AS length FROM blobs")
simple("enriched", lambda c: reads.enriched(c.manifests.select("doc_id"), c.manifests.where("doc_id % 2 = 0").select("doc_id", "lang"), c.manifests.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang")), "doc_id", "lang"), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN upper(lang) END AS lang FROM m")
simple("found_in_stores", lambda c: reads.found_in({"b": c.manifests.select("content_hash"), "a": c.puts.where("doc_id % 2 = 0").select("content_hash")}, "content_hash").select("content_hash", F.array_join("stores", ",").alias("stores"), "n"), "SELECT content_hash, string_agg(store, ',' ORDER BY store) AS stores, count(*) AS n FROM (SELECT DISTINCT content_hash, 'b' AS store FROM m UNION SELECT content_hash, 'a' FROM p WHERE doc_id % 2 = 0) GROUP BY 1")

# functions
simple("path_functions", lambda c: c.puts.select("doc_id", F.coalesce(fn.vfs_path(F.col("ext")), F.lit("top")).alias("p")).select("doc_id", fn.split_first(F.col("p"))["first"].alias("first"), fn.split_first(F.col("p"))["rest"].alias("rest"), fn.join_path(fn.split_first(F.col("p"))["first"], fn.split_first(F.col("p"))["rest"]).alias("joined"), fn.is_strict_under(F.col("p"), "en").alias("strict"), fn.is_under(F.col("p"), "").alias("any")), "SELECT doc_id, string_split(q, '/')[1] AS first, CASE WHEN contains(q, '/') THEN substr(q, strpos(q, '/') + 1) ELSE '' END AS rest, q AS joined, starts_with(q, 'en/') AS strict, true AS any FROM (SELECT doc_id, coalesce(vfs, 'top') AS q FROM p)")
simple("ext_merged", lambda c: c.puts.select("doc_id", fn.merged_ext(F.col("ext"), F.lit("nsid"), F.lit('"own"')).alias("ext"), F.array_join(fn.ext_keys(F.col("ext")), ",").alias("keys")), "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '{\"nsid\":\"own\"}' ELSE '{\"nsid\":\"own\",\"vfsmeta\":{\"path\":\"' || CASE WHEN doc_id % 13 = 0 THEN '/abs' ELSE vfs END || '\",\"version\":1}}' END AS ext, CASE WHEN doc_id % 11 = 0 THEN 'nsid' ELSE 'nsid,vfsmeta' END AS keys FROM p")
simple("presented", lambda c: stack.presented(c.puts, {"$.vfsmeta.path": "Path", "$.nsid": "Namespace"}).select("doc_id", "label", "value"), "SELECT doc_id, 'Namespace' AS label, lang AS value FROM p UNION ALL SELECT doc_id, 'Path', CASE WHEN doc_id % 13 = 0 THEN '/abs' ELSE vfs END FROM p WHERE doc_id % 11 <> 0")
simple("parsed_moments", lambda c: c.puts.select("doc_id", fn.parsed_rfc3339(F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, fn.rfc3339(F.col("created_at"))).otherwise(F.regexp_replace(fn.rfc3339(F.col("created_at")), "Z$", "+01:00"))).alias("seconds")), "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN created_at WHEN 2 THEN created_at - 3600 END AS seconds FROM p")
simple("parsed_ids", lambda c: c.puts.select("doc_id", fn.parsed_id(F.when(F.col("doc_id") % 4 == 0, F.col("content_hash")).otherwise(F.col("artifact_id"))).alias("i")).select("doc_id", "i.algorithm", F.base64("i.raw").alias("raw")), "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'sha256' END AS algorithm, CASE WHEN doc_id % 4 <> 0 THEN to_base64(unhex(substr(artifact_id, 8))) END AS raw FROM p")
simple("identity_hashes", lambda c: c.puts.select("doc_id", fn.identity_hash().alias("md"), fn.handle(F.col("content_hash"), F.unhex(F.lpad(F.hex(F.col("doc_id")), 32, "0"))).alias("unique_id")), "SELECT doc_id, 'sha256-' || sha256('tidemark/identity/1:{}') AS md, 'sha256-' || sha256(encode('tidemark/handle/1:') || unhex(content_hash) || unhex(sha256('tidemark/identity/1:{}')) || unhex(lpad(to_hex(doc_id), 32, '0'))) AS unique_id FROM p")
simple("checkpoint_ids", lambda c: c.puts.select("doc_id", preview.checkpoint_id(F.timestamp_seconds("created_at")).alias("id")), "SELECT doc_id, strftime(make_timestamp(created_at * 1000000), '%Y%m%dT%H%M%S.000000000Z') AS id FROM p")
simple("hex_dumps", lambda c: c.puts.select("doc_id", F.substring(preview.hex_dump(F.encode(F.substring("manifest_digest", 1, 16), "utf-8")), 1, 10).alias("head"), F.length(preview.hex_dump(F.encode(F.col("manifest_digest"), "utf-8"))).cast("long").alias("size")), "SELECT doc_id, '00000000  ' AS head, CAST(4 * length('00000000  ' || repeat('xx ', 8) || ' ' || repeat('xx ', 8) || ' |' || repeat('x', 16) || '|') + 3 AS BIGINT) AS size FROM p")
simple("json_previews", lambda c: c.puts.select("doc_id", F.size(F.split(preview.json_preview("ext"), "\n")).cast("long").alias("lines"), F.get_json_object(preview.json_preview("ext"), "$.nsid").alias("nsid")), "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 7 END AS lines, lang AS nsid FROM p")

# views
simple("synthetic_paths", lambda c: c.manifests.select("doc_id", views.synthetic_path(F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 == 1, "ab").otherwise(F.col("session_id")), F.col("artifact_id")).alias("path")), "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '_anonymous' WHEN doc_id % 9 = 1 THEN '_short/ab' WHEN length(session_id) < 4 THEN '_short/' || session_id ELSE substr(session_id, 1, 2) || '/' || substr(session_id, 3, 2) || '/' || session_id END || '/' || substr(artifact_id, 8, 16) || '.bin' AS path FROM m")
simple("labelled", lambda c: views.labelled(c.manifests.select("doc_id", F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("lang")).alias("nsid")), registry(c.puts.sparkSession)).select("doc_id", "label"), "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '_default' WHEN lang = 'en' THEN 'english' WHEN lang = 'fr' THEN 'french' WHEN lang = 'de' THEN 'german' ELSE lang END AS label FROM m")
simple("path_groups", lambda c: c.manifests.withColumn("path", fn.vfs_path(F.col("ext"))).where("path IS NOT NULL").groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("artifact_id")), ",").alias("ids")), "SELECT vfs AS path, string_agg(DISTINCT artifact_id, ',' ORDER BY artifact_id) AS ids FROM m WHERE vfs IS NOT NULL GROUP BY 1")
simple("path_metadata", lambda c: c.manifests.withColumn("path", fn.vfs_path(F.col("ext"))).where("path IS NOT NULL").select("artifact_id", "path", F.get_json_object("ext", "$.vfsmeta").alias("document")), "SELECT artifact_id, vfs AS path, '{\"version\":1,\"path\":\"' || vfs || '\"}' AS document FROM m WHERE vfs IS NOT NULL")
simple("view_get", lambda c: views.got(tree(c), c.manifests.select(F.lit("by-path").alias("root"), F.coalesce(fn.vfs_path(F.col("ext")), F.concat(F.lit("none/"), F.col("doc_id").cast("string"))).alias("path")).distinct()).select("path", "found", "size"), "SELECT w.path, n.path IS NOT NULL AS found, size FROM (SELECT DISTINCT coalesce(vfs, 'none/' || doc_id) AS path FROM m) w LEFT JOIN (SELECT * FROM named WHERE root = 'by-path') n USING (path)")
simple("view_attributes", lambda c: views.attributes(tree(c).where("root = 'by-path'"), c.manifests.select(F.lit("by-path").alias("root"), fn.vfs_path(F.col("ext")).alias("path"), F.lit('{"vfsmeta":{"mode":384}}').alias("ext")).where("path LIKE 'de/%'").distinct()).select("path", "mode", "uid", "gid", "size"), "SELECT path, CASE WHEN is_dir THEN 493 WHEN starts_with(path, 'de/') THEN 384 ELSE 420 END AS mode, 0 AS uid, 0 AS gid, size FROM named WHERE root = 'by-path'")


def by_path(c) -> DataFrame:
    return views.placed(c.manifests).where("root = 'by-path'")


simple("view_changed", lambda c: views.changed(by_path(c), by_path(c).join(c.manifests.where("doc_id % 2 = 0").select("manifest_digest"), "manifest_digest", "left_semi"), by_path(c).limit(0))[1].select("path", "manifest_digest"), "SELECT path, arg_max(manifest_digest, (created_at, artifact_id, manifest_digest)) AS manifest_digest FROM (SELECT vfs AS path, * FROM m WHERE vfs IS NOT NULL) WHERE doc_id % 2 <> 0 AND path IN (SELECT vfs FROM m WHERE doc_id % 2 = 0) GROUP BY 1")
simple("view_moved", lambda c: views.moved(by_path(c), "by-path", "en/src1/1.txt", "en/new.txt").select("path", "manifest_digest"), "SELECT CASE WHEN vfs = 'en/src1/1.txt' THEN 'en/new.txt' ELSE vfs END AS path, manifest_digest FROM m WHERE vfs IS NOT NULL")
simple("removed_tree", lambda c: views.removed_tree(tree(c).where("root = 'by-path'"), "by-path", "de").select("path", "is_dir"), "SELECT path, is_dir FROM named WHERE root = 'by-path' AND path <> 'de' AND NOT starts_with(path, 'de/')")
simple("view_totals", lambda c: views.stats(c, views.placed(c.manifests)), "SELECT count(*) AS nodes, CAST(sum(original_size) AS BIGINT) AS bytes, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE vfs IS NULL) AS orphaned, (SELECT CAST(sum(claims - 1) AS BIGINT) FROM files) AS collisions FROM m")
simple("listing_by_size", lambda c: views.page(tree(c).where("root = 'by-path' AND parent = 'en/src2'"), 1, 10, "size", True).select("name", "is_dir", "size"), "SELECT name, is_dir, size FROM named WHERE root = 'by-path' AND parent = 'en/src2' ORDER BY is_dir DESC, size DESC, name LIMIT 10")
simple("listing_last_page", lambda c: views.page(tree(c).where("root = 'by-path' AND parent = 'en'"), 999, 3).select("name"), "SELECT name FROM (SELECT name, row_number() OVER (ORDER BY is_dir DESC, name) AS rn, count(*) OVER () AS n FROM named WHERE root = 'by-path' AND parent = 'en') WHERE rn > (n - 1) // 3 * 3")
simple("search_by_id", lambda c: views.search(views.winners(by_path(c)), c.manifests.where("ext LIKE '%vfsmeta%'").agg(F.min("artifact_id").alias("a")).first().a or "none", 5).select("artifact_id"), "SELECT artifact_id FROM files WHERE root = 'by-path' AND artifact_id = (SELECT min(artifact_id) FROM m WHERE doc_id % 11 <> 0) LIMIT 5")
simple("search_truncated", lambda c: c.puts.sparkSession.createDataFrame([(views.truncated(views.search(views.winners(by_path(c)), "en/"), 20)[1],)], "more boolean"), "SELECT count(*) > 20 AS more FROM files WHERE root = 'by-path' AND contains(lower(path), 'en/')")
simple("provided_roots", lambda c: views.placed(c.manifests).select("root").distinct(), "SELECT DISTINCT root FROM places")
simple("since_head", lambda c: union_all([op.since_head(c, k).withColumn("cursor", F.lit(k).cast("long")) for k in (0, 500, 2_000_000_000)]), "SELECT k AS cursor, coalesce((SELECT max(csn) FROM m WHERE csn > k), k) AS next, k < (SELECT coalesce(max(delete_csn), 0) FROM gone) AS gapped FROM (SELECT unnest([0, 500, 2000000000]) AS k)")
simple("delta_rows", lambda c: union_all([op.delta(c, k).select("manifest_digest", "layout", "csn") for k in (500, 2_000_000_000)]), f"SELECT manifest_digest, {LAYOUT} AS layout, csn FROM m WHERE csn > 500 AND 500 >= (SELECT coalesce(max(delete_csn), 0) FROM gone)")

# maintenance
def manifest_files(c) -> DataFrame:
    """Manifest files of all live artifacts; every 29th is damaged, and one is a composite."""
    d = F.col("doc_id")
    text = F.when(d % 29 == 0, F.concat("document", F.lit(" "))).otherwise(F.col("document"))
    return c.manifests.select(fn.blob_path(F.col("manifest_digest"), "manifests").alias("path"), text.alias("document"), F.col("created_at").alias("mtime"))


REBUILT = "SELECT manifest_digest, artifact_id, session_id, blob_ref, content_hash, original_size, created_at FROM m WHERE doc_id % 29 <> 0"
ROWS = ("manifest_digest", "artifact_id", "session_id", "blob_ref", "content_hash", "original_size", "created_at")
simple("rebuild_full", lambda c: maintenance.rebuilt(manifest_files(c)).where("state = 'indexed'").select(*ROWS), REBUILT)
simple("rebuild_tail", lambda c: maintenance.rebuilt(manifest_files(c), EPOCH + 100).where("state = 'indexed'").select(*ROWS), REBUILT + f" AND created_at >= {EPOCH + 100}")
simple("rebuild_stats", lambda c: maintenance.rebuild_stats(maintenance.rebuilt(manifest_files(c))), "SELECT count(*) AS scanned, count(*) FILTER (WHERE doc_id % 29 <> 0) AS indexed, count(*) FILTER (WHERE doc_id % 29 <> 0 AND blob_ref IS NOT NULL) AS target, 0 AS skipped, count(*) FILTER (WHERE doc_id % 29 = 0) AS damaged FROM m")
simple("replayed_log", lambda c: writes.catalog_of(writes.replay_tail(whole_log(c).where("csn <= 100 OR op <> 'put'"), maintenance.rebuilt(manifest_files(c)), 3_000_000_000))[2].select("blob_ref", "ref_count"), "SELECT blob_ref, coalesce(n, 0) AS ref_count FROM (SELECT DISTINCT blob_ref FROM p WHERE blob_ref IS NOT NULL AND (csn <= 100 OR (doc_id % 29 <> 0 AND doc_id NOT IN (SELECT doc_id FROM gone)))) LEFT JOIN (SELECT e.blob_ref, count(*) AS n FROM edges e JOIN m USING (manifest_digest) WHERE csn <= 100 OR doc_id % 29 <> 0 GROUP BY 1) USING (blob_ref)")


def checkpoint_names(c) -> DataFrame:
    moment = preview.checkpoint_id(F.timestamp_seconds(F.col("created_at") - F.col("created_at") % 60))
    return c.puts.select(F.when(F.col("doc_id") % 50 == 1, "checkpoint/lease").otherwise(F.concat(F.lit("checkpoint/"), moment)).alias("name")).distinct()


NAMES = "(SELECT DISTINCT 'checkpoint/' || strftime(make_timestamp((created_at - created_at % 60) * 1000000), '%Y%m%dT%H%M%S.000000000Z') AS name FROM p WHERE doc_id % 50 <> 1)"
simple("latest_checkpoint", lambda c: maintenance.latest_checkpoint(checkpoint_names(c)), f"SELECT max(name) AS name FROM {NAMES}")
simple("checkpoint_prune", lambda c: maintenance.pruned_checkpoints(checkpoint_names(c), 2), f"SELECT name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS rn FROM {NAMES}) WHERE rn > 2")
simple("reclaim_counts", lambda c: maintenance.reclaim_counts(op.gc_plan(c, tombstones(c), NOW, 7 * DAY).select(F.col("action").alias("reason"), F.col("original_size").alias("size"))), f"SELECT action AS reason, count(*) AS n, CAST(sum(original_size) AS BIGINT) AS bytes FROM {GC} GROUP BY 1")
simple("scratch_total", lambda c: c.manifests.agg(F.sum("original_size").alias("total"), (F.sum("original_size") > 1_000_000).alias("over")), "SELECT CAST(sum(original_size) AS BIGINT) AS total, sum(original_size) > 1000000 AS over FROM m")
simple("kv_prefix_deleted", lambda c: kv.delete_prefix(index_rows(c), "paths", "fr/").select("key"), "SELECT vfs || '#' || manifest_digest AS key FROM m WHERE vfs IS NOT NULL AND NOT starts_with(vfs, 'fr/')")
simple("kv_put_twice", lambda c: kv.put(index_rows(c), index_rows(c).where("key LIKE 'de/%'").withColumn("value", F.lit("z")).unionByName(index_rows(c).where("key LIKE 'de/%'").withColumn("value", F.lit("a")))).select("key", "value"), "SELECT vfs || '#' || manifest_digest AS key, CASE WHEN starts_with(vfs, 'de/') THEN 'z' ELSE artifact_id END AS value FROM m WHERE vfs IS NOT NULL")
simple("packed", lambda c: writes.unpack(writes.pack(c.blobs.limit(0).select("blob_ref", F.lit("").alias("pack_ref"), F.col("original_size").alias("offset"), F.col("original_size").alias("length")), c.blobs.where("ascii(blob_ref) % 2 = 1").select("blob_ref", F.lit(0).cast("long").alias("offset"), F.col("original_size").alias("length")), "one"), "other").select("blob_ref", "pack_ref", "length"), "SELECT blob_ref, 'one' AS pack_ref, original_size AS length FROM blobs WHERE ascii(blob_ref) % 2 = 1")
simple("scoped_rows", lambda c: writes.scoped_delete(c.manifests.withColumn("nsid", F.col("lang")), "fr", c.manifests.select("manifest_digest")).select("manifest_digest", "nsid"), "SELECT manifest_digest, lang AS nsid FROM m WHERE lang <> 'fr'")


@query("SELECT name, CAST(max(seq) AS BIGINT) + 1 AS seq, 'new' AS payload FROM v GROUP BY 1")
def named_put(spark, sf_dir):
    t = versions(spark, sf_dir).select("name", "seq", F.col("event_type").alias("payload"))
    return named.get(named.put(t, t.select("name", F.lit("new").alias("payload")).distinct(), 3))


@query("SELECT 'own/' || name AS name, CAST(1 AS BIGINT) AS seq, 'x' AS payload FROM (SELECT DISTINCT name FROM v) UNION ALL SELECT name, 0, 'cell' FROM (SELECT DISTINCT name FROM v WHERE name LIKE '%7')")
def named_merged(spark, sf_dir):
    t = versions(spark, sf_dir).select("name", "seq", F.col("event_type").alias("payload"))
    names = t.select("name", F.lit("x").alias("payload")).distinct()
    return named.merged(named.scoped_put(t.limit(0), names, "own"), names.where("name LIKE '%7'").withColumn("payload", F.lit("cell")))


@query("SELECT name, nsid FROM (SELECT unnest(['english', 'french', 'german', 'spanish']) AS name, unnest(['en', 'fr', 'de', 'es']) AS nsid) WHERE name <> 'french'")
def namespace_registry(spark, sf_dir):
    return writes.unregistered(writes.registered(registry(spark), "spanish", "es"), "french").orderBy("name")


@query("SELECT 'session' AS field, CAST(NULL AS VARCHAR) AS value WHERE false UNION ALL SELECT 'topology', 'flat' UNION ALL SELECT 'verify', 'Auto'")
def config_history(spark, sf_dir):
    h = spark.createDataFrame([(1, "topology", "flat"), (1, "verify", "Disabled")], "seq long, field string, value string")
    h = writes.config_change(h, {"verify": "Auto", "session": "x"}, {"topology": "immutable", "session": "session"})
    return h.where(F.col("seq") == h.agg(F.max("seq")).first()[0]).select("field", "value")


@query("SELECT max(version) AS version FROM (SELECT unnest([1, 2, 3]) AS version)")
def schema_version(spark, sf_dir):
    return maintenance.schema_version(spark.createDataFrame([(1,), (3,), (2,)], "version int"))
