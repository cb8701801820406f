"""Registered catalog queries and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark import functions as fn
from tidemark.operators import catalog as op
from tidemark.functions import preview
from tidemark.operators import kv, payload, views, writes
from tidemark.sources import DAY, EPOCH, catalog, puts, table, union_all, upsert, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The fixed "now" of plans and cut-offs.
NOW = EPOCH + 25 * DAY

BASE = f"""WITH p0 AS (SELECT doc_id, lang, source AS session_id, text, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS original_size FROM documents),
p1 AS (SELECT *, 'sha256-' || sha256(encode('tidemark/handle/1:') || unhex(content_hash) || unhex(sha256('tidemark/identity/1:{{}}'))) AS artifact_id, CASE WHEN original_size > 4096 THEN content_hash END AS blob_ref, {EPOCH} + doc_id AS created_at, doc_id + 1 AS csn,
  '{{' || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '"vfsmeta":{{"version":1,"path":"' || CASE WHEN doc_id % 13 = 0 THEN '/abs' ELSE lang || '/' || session_id || '/' || (doc_id % 37) || '.txt' END || '"}},' END || '"nsid":"' || lang || '"}}' AS ext FROM p0),
p AS (SELECT *, sha256(document) AS manifest_digest,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN NULL ELSE lang || '/' || session_id || '/' || (doc_id % 37) || '.txt' END AS vfs,
  CASE WHEN doc_id % 11 = 0 THEN 'absent' WHEN doc_id % 13 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 3 <> 0 THEN {EPOCH} + doc_id + (doc_id % 40) * {DAY} END AS last_verified_at, CASE WHEN doc_id % 5 <> 0 THEN {EPOCH} + doc_id + (doc_id % 50) * {DAY} END AS retention_until FROM (SELECT *, '{{"ext":' || ext || ',"sys":{{"artifact_id":"' || artifact_id || '","blob_refs":[' || CASE WHEN blob_ref IS NULL THEN '' WHEN doc_id % 17 = 0 THEN '"' || blob_ref || '","' || blob_ref || '"' ELSE '"' || blob_ref || '"' END || '],"content_hash":"' || content_hash || '","created_at":"' || strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","layout_header":{{"blob_storage":"' || CASE WHEN blob_ref IS NULL THEN 'Inline' ELSE 'Target' END || '"}},"original_size":' || original_size || ',"schema_version":1,"session_id":"' || session_id || '"}}}}' AS document FROM p1)),
gone AS (SELECT p.doc_id, event_id + 1000000000 AS delete_csn FROM p JOIN events ON event_id = p.doc_id AND event_type = 'error'),
m AS (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
edges AS (SELECT manifest_digest, blob_ref, 0 AS position, artifact_id FROM m WHERE blob_ref IS NOT NULL UNION ALL SELECT manifest_digest, blob_ref, 1, artifact_id FROM m WHERE blob_ref IS NOT NULL AND doc_id % 17 = 0),
blobs AS (SELECT q.blob_ref, q.original_size, coalesce(n, 0) AS ref_count, lv AS last_verified_at FROM (SELECT blob_ref, any_value(original_size) AS original_size, max(last_verified_at) AS lv FROM p WHERE blob_ref IS NOT NULL GROUP BY 1) q LEFT JOIN (SELECT blob_ref, count(*) AS n FROM edges GROUP BY 1) e USING (blob_ref)),
hp AS (SELECT *, substr(artifact_id, 8, 2) || '/' || substr(artifact_id, 10, 2) || '/' || artifact_id AS sh FROM m),
places AS (SELECT 'by-artifact' AS root, sh AS path, artifact_id, manifest_digest, created_at, original_size FROM hp
  UNION ALL SELECT 'by-date', strftime(make_timestamp(created_at * 1000000), '%Y/%m/%d/%H-%M-%S-') || CASE WHEN vfs IS NULL THEN substr(artifact_id, 8, 16) || '.bin' ELSE (doc_id % 37) || '.txt' END, artifact_id, manifest_digest, created_at, original_size FROM hp
  UNION ALL SELECT 'by-session', session_id || '/' || artifact_id, artifact_id, manifest_digest, created_at, original_size FROM hp
  UNION ALL SELECT 'by-orphaned', sh, artifact_id, manifest_digest, created_at, original_size FROM hp WHERE vfs IS NULL
  UNION ALL SELECT 'by-path', vfs, artifact_id, manifest_digest, created_at, original_size FROM hp WHERE vfs IS NOT NULL
  UNION ALL SELECT 'by-namespace', CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE lang END || '/' || sh, artifact_id, manifest_digest, created_at, original_size FROM hp),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY created_at DESC, artifact_id DESC, manifest_digest DESC) AS rn, count(*) OVER (PARTITION BY root, path) AS claims FROM places),
files AS (SELECT * FROM ranked WHERE rn = 1),
dirs AS (SELECT DISTINCT root, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM (SELECT root, path, unnest(range(1, CAST(len(string_split(path, '/')) AS BIGINT))) AS i FROM files)),
nodes AS (SELECT root, path, false AS is_dir, original_size AS size, created_at AS mtime FROM files UNION ALL SELECT root, path, true, 0, NULL FROM dirs),
named AS (SELECT *, string_split(path, '/')[-1] AS name, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM nodes),
v AS (SELECT 'user-' || user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id, event_type FROM events)
"""


def query(sql: str | None):
    """Register a query with its SQL, which reads the derived tables of BASE."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return note


def simple(name: str, build: Callable, sql: str) -> None:
    """A query over the catalog (and, for those that want it, the session and folder)."""
    QUERIES[name] = lambda spark, sf_dir: build(catalog(spark, sf_dir))
    ORACLES[name] = BASE + sql


def wanted_digest(c) -> str:
    return c.manifests.agg(F.min("manifest_digest").alias("d")).first().d or ""


def tree(c) -> DataFrame:
    return views.nodes(views.winners(views.placed(c.manifests)))


@query("SELECT content_hash AS blob_ref, count(*) AS ref_count, min(original_size) AS size, CASE WHEN count(*) > 1 THEN 'shared' ELSE 'single' END AS kind FROM p GROUP BY 1")
def dedup_report(spark, sf_dir):
    g = puts(spark, sf_dir).groupBy(F.col("content_hash").alias("blob_ref")).agg(F.count(F.lit(1)).alias("ref_count"), F.min("original_size").alias("size"))
    return g.withColumn("kind", F.when(F.col("ref_count") > 1, "shared").otherwise("single"))


@query("SELECT count(*) AS artifacts, count(DISTINCT content_hash) AS blobs, CAST(sum(original_size) AS BIGINT) AS bytes, printf('%.2fx', count(*) / count(DISTINCT content_hash)) AS dedup FROM p")
def capacity(spark, sf_dir):
    d = puts(spark, sf_dir).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("original_size").alias("b"))
    return d.agg(F.sum("n").alias("artifacts"), F.count(F.lit(1)).alias("blobs"), F.sum("b").alias("bytes")).withColumn("dedup", fn.ratio(F.col("artifacts"), F.col("blobs")))


simple("walk_manifests", op.walk, "SELECT manifest_digest, artifact_id, session_id, coalesce(m.blob_ref, '') AS blob_ref, CASE WHEN m.blob_ref IS NULL THEN 'inline' ELSE 'target' END AS layout, created_at, m.original_size AS size, csn FROM m")
simple("manifest_by_digest", lambda c: op.walk(c).where(F.col("manifest_digest") == wanted_digest(c)).limit(1), "SELECT manifest_digest, artifact_id, session_id, coalesce(blob_ref, '') AS blob_ref, CASE WHEN blob_ref IS NULL THEN 'inline' ELSE 'target' END AS layout, created_at, original_size AS size, csn FROM m WHERE manifest_digest = (SELECT min(manifest_digest) FROM m)")
simple("resolve_blobs", lambda c: op.resolve(c.puts.select(F.col("content_hash").alias("blob_ref")).distinct(), c.blobs), "SELECT h AS blob_ref, CASE WHEN b.blob_ref IS NOT NULL THEN 'blobs/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h END AS path, b.blob_ref IS NOT NULL AS found, ref_count FROM (SELECT DISTINCT content_hash AS h FROM p) LEFT JOIN blobs b ON h = b.blob_ref")
simple("resolve_digest", lambda c: op.newest_by_handle(c.manifests), "SELECT artifact_id, arg_max(manifest_digest, csn) AS manifest_digest, max(csn) AS csn FROM m GROUP BY 1")
simple("manifest_exists", lambda c: c.puts.select("manifest_digest").join(c.manifests.select("manifest_digest", F.lit(True).alias("e")), "manifest_digest", "left").select("manifest_digest", F.coalesce("e", F.lit(False)).alias("present")), "SELECT manifest_digest, manifest_digest IN (SELECT manifest_digest FROM m) AS present FROM p")
simple("exists_by_content", lambda c: op.by_content(c.puts.select("doc_id", "content_hash", "original_size", F.lit("").alias("crypto_identity")), c.blobs).select("doc_id", "blob_ref", "status"), "SELECT doc_id, b.blob_ref, CASE WHEN b.blob_ref IS NULL THEN 0 ELSE 1 END AS status FROM p LEFT JOIN blobs b ON p.content_hash = b.blob_ref AND p.original_size = b.original_size")
simple("ref_counts", lambda c: c.blobs.select("blob_ref", "ref_count"), "SELECT blob_ref, ref_count FROM blobs")
simple("session_members", lambda c: c.manifests.where("session_id = 'src1' AND artifact_id IS NOT NULL").select("artifact_id"), "SELECT artifact_id FROM m WHERE session_id = 'src1'")
simple("orphan_blobs", lambda c: op.orphans(c).select("blob_ref", "original_size"), "SELECT blob_ref, original_size FROM blobs WHERE ref_count = 0")
simple("unverified_blobs", lambda c: op.unverified(c.blobs, NOW).orderBy(F.asc_nulls_first("last_verified_at"), "blob_ref").select("blob_ref", "last_verified_at"), f"SELECT blob_ref, last_verified_at FROM blobs WHERE last_verified_at IS NULL OR last_verified_at < {NOW}")
simple("unverified_manifests", lambda c: op.unverified_manifests(c, op.scrub_cutoff(NOW + DAY, DAY, 9 * DAY)).select("manifest_digest", "layout", "size", "last_verified_at"), f"SELECT manifest_digest, CASE WHEN blob_ref IS NULL THEN 'inline' ELSE 'target' END AS layout, original_size AS size, last_verified_at FROM m WHERE last_verified_at IS NULL OR last_verified_at < {NOW}")
simple("view_filter", lambda c: c.manifests.withColumn("path", fn.vfs_path(F.col("ext"))).where((F.col("session_id") == "src3") & F.col("path").startswith("en/")).select("doc_id", "path"), "SELECT doc_id, vfs AS path FROM m WHERE session_id = 'src3' AND starts_with(vfs, 'en/')")
simple("retention_blocked", lambda c: c.manifests.where(F.col("retention_until") > NOW).select("manifest_digest", "retention_until"), f"SELECT manifest_digest, retention_until FROM m WHERE retention_until > {NOW}")
simple("ext_decode", lambda c: c.manifests.select("doc_id", fn.vfs_status(F.col("ext")).alias("status"), fn.vfs_path(F.col("ext")).alias("path")), "SELECT doc_id, status, vfs AS path FROM m")
simple("blob_paths", lambda c: c.blobs.select("blob_ref", fn.blob_path(F.col("blob_ref")).alias("sharded"), fn.blob_path(F.col("blob_ref"), "packs", False).alias("flat")).withColumn("back", fn.path_ref(F.col("sharded"))), "SELECT blob_ref, 'blobs/' || substr(blob_ref, 1, 2) || '/' || substr(blob_ref, 3, 2) || '/' || blob_ref AS sharded, 'packs/' || blob_ref AS flat, blob_ref AS back FROM blobs")
simple("manifests_by_blob", lambda c: op.by_blob(c).select("blob_ref", "manifest_digest", F.col("position").cast("long").alias("position"), "artifact_id"), "SELECT blob_ref, manifest_digest, CAST(position AS BIGINT) AS position, artifact_id FROM edges")
simple("list_by_ext", lambda c: op.projection(op.ext_query(c, "tidemark.namespace", "nsid", "fr"), c.blobs).select("manifest_digest", "layout", "size", "created_at"), "SELECT manifest_digest, CASE WHEN blob_ref IS NULL THEN 'inline' ELSE 'target' END AS layout, original_size AS size, created_at FROM m WHERE lang = 'fr'")
simple("ext_query", lambda c: op.ext_query(c, "tidemark.namespace", "nsid", "de").select("artifact_id").distinct(), "SELECT DISTINCT artifact_id FROM m WHERE lang = 'de'")
simple("related_artifacts", lambda c: op.related(c, c.manifests.where("blob_ref IS NOT NULL").select("blob_ref", F.col("manifest_digest").alias("exclude"))).select("exclude", "manifest_digest"), "SELECT a.manifest_digest AS exclude, b.manifest_digest FROM m a JOIN m b ON a.blob_ref = b.blob_ref AND a.manifest_digest <> b.manifest_digest")
simple("scrub_cascade", lambda c: c.manifests.join(c.edges.join(op.unverified(c.blobs, NOW).select("blob_ref"), "blob_ref", "left_semi").select("manifest_digest"), "manifest_digest", "left_semi").select("manifest_digest"), f"SELECT DISTINCT manifest_digest FROM edges JOIN blobs USING (blob_ref) WHERE last_verified_at IS NULL OR last_verified_at < {NOW}")
simple("count_manifests", lambda c: c.manifests.where("artifact_id IS NOT NULL").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM m")
simple("duplicate_handles", lambda c: c.manifests.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT artifact_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1")
simple("view_stats", lambda c: views.placed(c.manifests).groupBy("root").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("path").alias("paths"), F.sum("original_size").alias("bytes")).withColumn("collisions", F.col("claims") - F.col("paths")), "SELECT root, count(*) AS claims, count(DISTINCT path) AS paths, CAST(sum(original_size) AS BIGINT) AS bytes, count(*) - count(DISTINCT path) AS collisions FROM places GROUP BY 1")
simple("tree_views", lambda c: views.placed(c.manifests).select("root", "path", "manifest_digest"), "SELECT root, path, manifest_digest FROM places")
simple("path_winner", lambda c: views.winners(views.placed(c.manifests)).select("root", "path", "artifact_id", "created_at", "claims"), "SELECT root, path, artifact_id, created_at, claims FROM files")
simple("path_losers", lambda c: views.ranked(views.placed(c.manifests).where("root = 'by-path'")).where("rn > 1").select("path", "manifest_digest", F.col("rn").cast("long").alias("rn")), "SELECT path, manifest_digest, rn FROM ranked WHERE rn > 1 AND root = 'by-path'")
simple("virtual_dirs", lambda c: views.virtual_dirs(views.winners(views.placed(c.manifests))), "SELECT root, path FROM dirs")
simple("list_children", lambda c: views.children(tree(c), "by-path", "en/src1").select("name", "is_dir", "size"), "SELECT name, is_dir, size FROM named WHERE root = 'by-path' AND parent = 'en/src1'")
simple("listing_page", lambda c: views.page(tree(c).where("root = 'by-session' AND parent = 'src1'"), 1, 20).select("name", "is_dir", "size"), "SELECT name, is_dir, size FROM named WHERE root = 'by-session' AND parent = 'src1' ORDER BY is_dir DESC, name LIMIT 20")
simple("subtree_walk", lambda c: views.walk(tree(c), "by-path", "de").select("path", "is_dir", "name"), "SELECT path, is_dir, name FROM named WHERE root = 'by-path' AND (path = 'de' OR starts_with(path, 'de/'))")
simple("search_paths", lambda c: views.search(views.winners(views.placed(c.manifests).where("root = 'by-path'")), " SRC1/", 50).select("path", "artifact_id"), "SELECT path, artifact_id FROM files WHERE root = 'by-path' AND contains(lower(path), 'src1/') ORDER BY created_at DESC, artifact_id, path LIMIT 50")
simple("locations", lambda c: views.placed(c.manifests).groupBy("manifest_digest").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "root", "path"))), ",").alias("at")), "SELECT manifest_digest, string_agg(DISTINCT root || '=' || path, ',' ORDER BY root || '=' || path) AS at FROM places GROUP BY 1")
simple("renamed_tree", lambda c: views.renamed(tree(c).where("root = 'by-path'"), "fr", "archive/fr").select("path", "is_dir"), "SELECT CASE WHEN path = 'fr' OR starts_with(path, 'fr/') THEN 'archive/fr' || substr(path, 3) ELSE path END AS path, is_dir FROM named WHERE root = 'by-path'")
simple("path_index", lambda c: c.manifests.withColumn("path", fn.vfs_path(F.col("ext"))).where("path IS NOT NULL").groupBy("path").agg(F.min("artifact_id").alias("first_id"), F.countDistinct("artifact_id").alias("ids")), "SELECT vfs AS path, min(artifact_id) AS first_id, count(DISTINCT artifact_id) AS ids FROM m WHERE vfs IS NOT NULL GROUP BY 1")
FILES = """(SELECT DISTINCT 'blobs/' || substr(content_hash, 1, 2) || '/' || substr(content_hash, 3, 2) || '/' || content_hash AS path, CASE WHEN content_hash IN (SELECT blob_ref FROM blobs) THEN 'live' ELSE 'orphan_blob' END AS class FROM p
  UNION ALL SELECT 'manifests/' || substr(manifest_digest, 1, 2) || '/' || substr(manifest_digest, 3, 2) || '/' || manifest_digest, CASE WHEN doc_id IN (SELECT doc_id FROM gone) THEN 'orphan_manifest' ELSE 'live' END FROM p
  UNION ALL SELECT 'blobs/tmp-' || doc_id, 'unparseable' FROM p WHERE doc_id % 7 = 0 UNION ALL SELECT 'staging/put-' || doc_id, 'staging' FROM p WHERE doc_id % 19 = 0)"""


def files(c) -> DataFrame:
    """What lies in a store: blobs (those of inline payloads left by crashed writes), manifests (deleted ones too), staging and foreign files."""
    d = F.col("doc_id").cast("string")
    paths = [c.puts.select(fn.blob_path(F.col("content_hash")).alias("path")).distinct(), c.puts.select(fn.blob_path(F.col("manifest_digest"), "manifests").alias("path")), c.puts.where("doc_id % 7 = 0").select(F.concat(F.lit("blobs/tmp-"), d).alias("path")), c.puts.where("doc_id % 19 = 0").select(F.concat(F.lit("staging/put-"), d).alias("path"))]
    return union_all(paths)


simple("orphan_files", lambda c: op.scan_files(c, files(c)), f"SELECT path, class FROM {FILES}")
simple("orphan_report", lambda c: op.orphan_report(op.scan_files(c, files(c))), f"SELECT count(*) FILTER (WHERE class = 'staging') AS staging_removed, count(*) FILTER (WHERE class = 'orphan_blob') AS blobs_removed, count(*) FILTER (WHERE class = 'orphan_manifest') AS manifests_removed, count(*) FILTER (WHERE class = 'unparseable') AS errors FROM {FILES}")
TOMBS = f"SELECT blob_ref, {EPOCH} + (ascii(blob_ref) % 40) * {DAY} AS marked_at FROM blobs WHERE ascii(blob_ref) % 3 <> 0"


def tombstones(c) -> DataFrame:
    return c.blobs.where(F.ascii("blob_ref") % 3 != 0).select("blob_ref", (EPOCH + (F.ascii("blob_ref") % 40) * DAY).cast("long").alias("marked_at"))


GC = f"(SELECT b.blob_ref, original_size, CASE WHEN marked_at IS NULL THEN 'mark' WHEN {NOW} - marked_at >= {7 * DAY} THEN 'sweep' ELSE 'wait' END AS action FROM blobs b LEFT JOIN ({TOMBS}) t USING (blob_ref) WHERE ref_count = 0)"
simple("gc_plan", lambda c: op.gc_plan(c, tombstones(c), NOW, 7 * DAY), f"SELECT * FROM {GC}")
simple("gc_stats", lambda c: op.gc_plan(c, tombstones(c), NOW, 7 * DAY).groupBy("action").agg(F.count(F.lit(1)).alias("blobs"), F.sum("original_size").alias("bytes")), f"SELECT action, count(*) AS blobs, CAST(sum(original_size) AS BIGINT) AS bytes FROM {GC} GROUP BY 1")
simple("rollback_plan", lambda c: op.rollback_plan(c.manifests, NOW), f"SELECT session_id, count(*) AS artifacts, CAST(sum(CASE WHEN retention_until > {NOW} THEN 1 ELSE 0 END) AS BIGINT) AS held, CASE WHEN sum(CASE WHEN retention_until > {NOW} THEN 1 ELSE 0 END) > 0 THEN 0 ELSE count(*) END AS deletes FROM m GROUP BY 1")
simple("change_token", op.token, "SELECT greatest((SELECT max(csn) FROM p), (SELECT max(delete_csn) FROM gone)) AS token")
simple("since_delta", lambda c: op.since(c, 500), "SELECT manifest_digest, csn FROM m WHERE csn > 500")
simple("upsert_restore", lambda c: upsert(c.manifests.select("manifest_digest", "csn", F.lit("current").alias("origin")), c.puts.where("lang = 'de'").select("manifest_digest", "csn", F.lit("saved").alias("origin")), ["manifest_digest"]), "SELECT manifest_digest, csn, 'saved' AS origin FROM p WHERE lang = 'de' UNION ALL SELECT manifest_digest, csn, 'current' FROM m WHERE lang <> 'de'")
simple("inline_decision", lambda c: c.puts.select("doc_id", F.when(F.col("original_size") <= 4096, "inline").otherwise("target").alias("layout")), "SELECT doc_id, CASE WHEN original_size <= 4096 THEN 'inline' ELSE 'target' END AS layout FROM p")
simple("presented_sizes", lambda c: c.manifests.select("doc_id", fn.human_bytes(F.col("original_size")).alias("size"), fn.rfc3339(F.col("created_at")).alias("created")), "SELECT doc_id, CASE WHEN original_size >= 1073741824 THEN printf('%.1f GiB', original_size / 1073741824.0) WHEN original_size >= 1048576 THEN printf('%.1f MiB', original_size / 1048576.0) WHEN original_size >= 1024 THEN printf('%.1f KiB', original_size / 1024.0) ELSE original_size || ' B' END AS size, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created FROM m")


@query("SELECT DISTINCT 'quality' AS field, m.artifact_id FROM m JOIN labels l ON l.doc_id = m.doc_id WHERE l.quality = 1 UNION ALL SELECT DISTINCT 'lang', m.artifact_id FROM m JOIN labels l ON l.doc_id = m.doc_id WHERE m.lang = 'de' UNION ALL SELECT DISTINCT 'content', m.artifact_id FROM m JOIN labels l ON l.doc_id = m.doc_id WHERE m.content_hash = (SELECT min(m.content_hash) FROM m JOIN labels l ON l.doc_id = m.doc_id)")
def usr_query(spark, sf_dir):
    rows = op.usr_rows(catalog(spark, sf_dir).manifests, table(spark, sf_dir, "labels"))
    least = rows.agg(F.min("value_hash").alias("h")).first().h
    return union_all([op.usr_query(rows, field, value).select(F.lit(field).alias("field"), "artifact_id") for field, value in (("quality", "+1"), ("lang", "de"), ("content", least or ""))])


@query("SELECT CASE WHEN blob_ref IN (SELECT content_hash FROM p WHERE doc_id % 5 = 0) THEN 'missing' WHEN blob_ref IN (SELECT content_hash FROM p WHERE doc_id % 5 = 1) THEN 'corrupt' ELSE 'ok' END AS state, count(*) AS blobs FROM blobs GROUP BY 1")
def scrub_report(spark, sf_dir):
    """Payloads of every fifth document are lost, and those of the next one damaged."""
    c = catalog(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    refs = c.puts.where("blob_ref IS NOT NULL").groupBy("blob_ref").agg(F.min("doc_id").alias("doc_id"), F.max(F.expr("doc_id % 5 = 0")).alias("lost"), F.max(F.expr("doc_id % 5 = 1")).alias("hurt"))
    kept = refs.where("NOT lost").join(docs, "doc_id").select("blob_ref", F.when(F.col("hurt"), F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload")).alias("payload"))
    return op.scrub(c, kept).groupBy("state").agg(F.count(F.lit(1)).alias("blobs"))


@query("SELECT name, max(seq) AS active, arg_max(event_type, seq) AS payload FROM v GROUP BY 1")
def active_versions(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("name").agg(F.max("seq").alias("active"), F.max_by("event_type", "seq").alias("payload"))


@query("SELECT name, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM v) WHERE rn > 5")
def pruned_versions(spark, sf_dir):
    return op.keep_newest(versions(spark, sf_dir), "name", "seq", 5).select("name", "seq", "event_id")


@query("SELECT event_type, event_id, rn // 100 AS firing FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn % 100 = 0")
def every_nth(spark, sf_dir):
    return op.every_nth(table(spark, sf_dir, "events"), 100)


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT entry, size FROM (SELECT doc_id AS entry, original_size AS size, sum(original_size) OVER (ORDER BY created_at, doc_id) - original_size AS freed, (SELECT sum(original_size) FROM m) AS total FROM m WHERE doc_id % 6 <> 0) WHERE freed < total - 1000000")
def idle_eviction(spark, sf_dir):
    m = catalog(spark, sf_dir).manifests
    return op.evict(m.select(F.col("doc_id").alias("entry"), F.col("original_size").alias("size"), F.col("created_at").alias("last_access"), F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0).alias("holders")), 1_000_000)


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, 'part-' || l_partkey AS blob_ref FROM lineitem")
def composite_edges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return l.select("l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("position"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("blob_ref"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def orphan_parts(spark, sf_dir):
    live = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey")
    return part.join(live, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("SELECT doc_id, content_hash AS back_hash, original_size AS back_size FROM p")
def payload_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    back = d.select("doc_id", payload.decompress(payload.compress("payload")).alias("back"))
    return back.select("doc_id", F.sha2("back", 256).alias("back_hash"), F.octet_length("back").cast("long").alias("back_size"))


@query("SELECT doc_id, content_hash AS back_hash, CAST(greatest(1, ceil(original_size / 1024.0)) AS BIGINT) AS frames FROM p")
def sealed_segments(spark, sf_dir):
    key, aad = F.lit(b"0123456789abcdef"), F.lit(b"tidemark")
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    part = d.select("doc_id", F.sha2("payload", 256).alias("h"), F.explode(payload.segments(F.col("payload"), 1024)).alias("s"))
    sealed = part.select("doc_id", "s.index", payload.seal(F.col("s.part"), key, payload.convergent_iv(b"0123456789abcdef", "k1")("h", "s.index"), aad).alias("frame"))
    opened = sealed.select("doc_id", "index", F.hex(payload.unseal(F.col("frame"), key, aad)).alias("x"))
    joined = opened.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "x"))), lambda s: s["x"]), "").alias("x"), F.count(F.lit(1)).alias("frames"))
    return joined.select("doc_id", F.sha2(F.unhex("x"), 256).alias("back_hash"), "frames")


@query("SELECT doc_id, CASE WHEN original_size >= 90 THEN sha256(encode(text)[11:90]) END AS fragment_hash FROM p")
def fragments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    return d.select("doc_id", F.sha2(payload.fragment(F.col("payload"), 10, 90), 256).alias("fragment_hash"))


@query("SELECT edge, count(*) AS n FROM (SELECT 'order-customer' AS edge FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'customer-nation' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'nation-region' FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def handle_edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    links = [("order-customer", t("orders"), t("customer"), "o_custkey", "c_custkey"), ("customer-nation", t("customer"), t("nation"), "c_nationkey", "n_nationkey"), ("nation-region", t("nation"), t("region"), "n_regionkey", "r_regionkey")]
    out = None
    for name, a, b, x, y in links:
        one = a.join(b.select(y), F.col(x) == F.col(y), "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("edge"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def index_rows(c) -> DataFrame:
    """The path index as key-value rows."""
    return c.manifests.withColumn("path", fn.vfs_path(F.col("ext"))).where("path IS NOT NULL").select(F.lit("paths").alias("table_name"), F.concat_ws("#", "path", "manifest_digest").alias("key"), F.col("artifact_id").alias("value"))


simple("kv_prefix_scan", lambda c: kv.prefix_scan(index_rows(c), "paths", "en/").select("key", "value"), "SELECT vfs || '#' || manifest_digest AS key, artifact_id AS value FROM m WHERE starts_with(vfs, 'en/')")
simple("kv_range_scan", lambda c: kv.range_scan(index_rows(c), "paths", "de/src1", "es/").select("key", "value"), "SELECT vfs || '#' || manifest_digest AS key, artifact_id AS value FROM m WHERE vfs || '#' || manifest_digest >= 'de/src1' AND vfs || '#' || manifest_digest < 'es/'")
simple("media_types", lambda c: c.manifests.select("doc_id", preview.media_type(F.coalesce(fn.vfs_path(F.col("ext")), F.lit("")), F.when(F.col("lang") == "es", "application/x-own")).alias("type")), "SELECT doc_id, CASE WHEN lang = 'es' THEN 'application/x-own' WHEN vfs IS NULL THEN '' ELSE 'text/plain; charset=utf-8' END AS type FROM m")
simple("encoded_names", lambda c: c.manifests.select("doc_id", preview.encoded_name(F.concat_ws("/", "session_id", "artifact_id")).alias("name"), preview.uptime(EPOCH - F.col("created_at") * 1 - F.col("doc_id") * 3600).alias("age")), f"SELECT doc_id, session_id || '_' || artifact_id AS name, CASE WHEN t >= 86400 THEN (t // 86400) || 'd' || (t // 3600 % 24) || 'h' || (t // 60 % 60) || 'm' WHEN t >= 3600 THEN (t // 3600) || 'h' || (t // 60 % 60) || 'm' WHEN t >= 60 THEN (t // 60) || 'm' || (t % 60) || 's' ELSE t || 's' END AS age FROM (SELECT *, created_at - {EPOCH} + doc_id * 3600 AS t FROM m)")


def operations(c) -> DataFrame:
    """The catalog's history as a log: puts, stamps after them, deletes."""
    put = c.puts.select("csn", F.lit("put").alias("op"), "manifest_digest", F.lit(None).cast("long").alias("at"))
    stamp = c.puts.where("last_verified_at IS NOT NULL").select((F.col("csn") + 500_000_000).alias("csn"), F.lit("verify").alias("op"), "manifest_digest", F.col("last_verified_at").alias("at"))
    gone = c.gone.select(F.col("delete_csn").alias("csn"), F.lit("delete").alias("op"), "manifest_digest", F.lit(None).cast("long").alias("at"))
    return put.unionByName(stamp).unionByName(gone)


simple("log_snapshot", lambda c: writes.snapshot(operations(c)), "SELECT manifest_digest, csn, last_verified_at, (SELECT max(delete_csn) FROM gone) AS prune_csn FROM m")
simple("write_gate", lambda c: writes.gated(operations(c), ("delete",))[1].select("op", "manifest_digest"), "SELECT 'delete' AS op, manifest_digest FROM p JOIN gone USING (doc_id)")


def registry(spark) -> DataFrame:
    return spark.createDataFrame([("english", "en"), ("french", "fr"), ("german", "de")], "name string, nsid string")


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang END AS nsid FROM p")
def namespace_put(spark, sf_dir):
    known = F.element_at(F.create_map(F.lit("en"), F.lit("english"), F.lit("fr"), F.lit("french"), F.lit("de"), F.lit("german"), F.lit("es"), F.lit("spanish")), F.col("lang"))
    taken, rejected = writes.namespaced(puts(spark, sf_dir).select("doc_id", known.alias("namespace")), registry(spark))
    return taken.select("doc_id", "nsid").unionByName(rejected.select("doc_id", F.lit(None).cast("string").alias("nsid")))


@query("SELECT doc_id, original_size AS rejected_size FROM p WHERE original_size > 8192")
def size_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    return writes.size_guard(d, 8192)[1].select("doc_id", "rejected_size")


@query("SELECT name, CAST(max(seq) + 1 AS BIGINT) AS seq, 'a' AS claimant FROM v GROUP BY 1")
def claimed_versions(spark, sf_dir):
    t = versions(spark, sf_dir)
    due = t.groupBy("name").agg((F.max("seq") + 1).alias("seq"))
    late = t.select("name", "seq").distinct().withColumn("claimant", F.lit("late"))
    claims = due.select("name", "seq", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("claimant")).unionByName(late)
    return writes.claim_versions(t, claims)[0]


@query("SELECT blob_ref, 'pack-' || left(blob_ref, 4) AS pack_ref, CAST(coalesce(sum(original_size) OVER (PARTITION BY left(blob_ref, 4) ORDER BY blob_ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, original_size AS length FROM blobs")
def pack_placement(spark, sf_dir):
    """Blobs laid end to end in packs by their first four digits: up to 65,536 packs, each ordered in its own task."""
    b = catalog(spark, sf_dir).blobs.select("blob_ref", F.concat(F.lit("pack-"), F.substring("blob_ref", 1, 4)).alias("pack_ref"), F.col("original_size").alias("length"))
    before = F.sum("length").over(Window.partitionBy("pack_ref").orderBy("blob_ref").rowsBetween(Window.unboundedPreceding, -1))
    return b.select("blob_ref", "pack_ref", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length")
