"""Operators over the catalog tables: lookups, joins, aggregates, lifecycle plans and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import blob_path, path_ref
from tidemark.sources import Catalog, union_all


def projection(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """The eight columns every manifest read returns; a missing blob reference is an inline payload."""
    b = blobs.select("blob_ref", F.col("original_size").alias("blob_size"))
    size = F.coalesce("blob_size", "original_size")
    return manifests.join(b, "blob_ref", "left").select("manifest_digest", "artifact_id", "session_id", F.coalesce("blob_ref", F.lit("")).alias("blob_ref"), F.when(F.col("blob_ref").isNull(), "inline").otherwise("target").alias("layout"), "created_at", size.alias("size"), "csn")


def walk(c: Catalog) -> DataFrame:
    return projection(c.manifests.where("artifact_id IS NOT NULL"), c.blobs)


def resolve(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Physical paths of wanted references; found tells whether the catalog has them."""
    known = blobs.select("blob_ref", F.lit(True).alias("known"), "ref_count")
    return refs.join(known, "blob_ref", "left").select("blob_ref", F.when(F.col("known"), blob_path(F.col("blob_ref"))).alias("path"), F.coalesce("known", F.lit(False)).alias("found"), "ref_count")


def newest_by_handle(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("artifact_id").agg(F.max_by("manifest_digest", "csn").alias("manifest_digest"), F.max("csn").alias("csn"))


def by_content(keys: DataFrame, blobs: DataFrame) -> DataFrame:
    """The smallest blob with each wanted (content_hash, original_size, crypto_identity), status 0 or 1."""
    on = ["content_hash", "original_size", "crypto_identity"]
    return keys.join(blobs.groupBy(*on).agg(F.min("blob_ref").alias("blob_ref")), on, "left").withColumn("status", F.when(F.col("blob_ref").isNull(), 0).otherwise(1))


def orphans(c: Catalog) -> DataFrame:
    return c.blobs.join(c.edges.select("blob_ref"), "blob_ref", "left_anti")


def unverified(rows: DataFrame, cutoff: int) -> DataFrame:
    return rows.where(F.col("last_verified_at").isNull() | (F.col("last_verified_at") < cutoff))


def by_blob(c: Catalog) -> DataFrame:
    """Consumers of every blob, one row for each position."""
    return c.edges.join(c.manifests.select("manifest_digest", "artifact_id", "created_at"), "manifest_digest")


def ext_rows(manifests: DataFrame) -> DataFrame:
    return manifests.select("manifest_digest", F.lit("tidemark.namespace").alias("ext_name"), F.lit("nsid").alias("field"), F.get_json_object("ext", "$.nsid").alias("value"))


def ext_query(c: Catalog, ext: str, field: str, value: str) -> DataFrame:
    """User manifests whose projected field has the value; a filter, as the field is a function of the manifest's own row."""
    if (ext, field) != ("tidemark.namespace", "nsid"):
        return c.manifests.limit(0)
    return c.manifests.where(F.col("artifact_id").isNotNull() & (F.get_json_object("ext", "$.nsid") == value))


def usr_rows(manifests: DataFrame, labels: DataFrame) -> DataFrame:
    """User fields as rows (field, value_text, value_number, value_hash): a number for each label, the language as text, the content as hash."""
    both = manifests.select("manifest_digest", "artifact_id", "doc_id", "lang", "content_hash").join(labels, "doc_id")
    none = lambda t: F.lit(None).cast(t)
    row = lambda f, t, n, h: F.struct(F.lit(f).alias("field"), t.alias("value_text"), n.alias("value_number"), h.alias("value_hash"))
    fields = [row(f, none("string"), F.col(f).cast("long"), none("string")) for f in ("quality", "toxic")] + [row("lang", F.col("lang"), none("long"), none("string")), row("content", none("string"), none("long"), F.col("content_hash"))]
    return both.select("manifest_digest", "artifact_id", F.inline(F.array(*fields)))


def usr_query(rows: DataFrame, field: str, value: str, indexing: bool = True) -> DataFrame:
    """Handles whose field equals the value as text, as hash, or as the number it spells in base 10; none while indexing is off."""
    if not indexing:
        return rows.select("artifact_id").limit(0)
    number = F.when(F.lit(value).rlike("^[+-]?[0-9]+$"), F.lit(value).try_cast("bigint"))
    same = (F.col("value_text") == value) | (F.col("value_hash") == value) | (F.col("value_number") == number)
    return rows.where((F.col("field") == field) & same & F.col("artifact_id").isNotNull()).select("artifact_id").distinct()


def related(c: Catalog, wanted: DataFrame) -> DataFrame:
    """For every wanted (blob_ref, exclude): the other user manifests whose primary blob it is."""
    m = c.manifests.where("artifact_id IS NOT NULL").select("blob_ref", "manifest_digest", "artifact_id")
    return wanted.join(m, "blob_ref").where(F.col("manifest_digest") != F.col("exclude")).select("exclude", "blob_ref", "manifest_digest", "artifact_id")


def scan_files(c: Catalog, files: DataFrame) -> DataFrame:
    """Class of every physical file: staging (always swept), live, orphan blob, orphan manifest, or unparseable (reported, never removed).

    A blob file is live if the catalog resolves its reference at all: one without live edges waits for the
    collection and is no orphan.
    """
    kind = F.substring_index("path", "/", 1)
    ref = path_ref(F.col("path"))
    known = c.blobs.select(F.lit("blobs").alias("kind"), F.col("blob_ref").alias("ref")).unionByName(c.manifests.select(F.lit("manifests").alias("kind"), F.col("manifest_digest").alias("ref")))
    rows = files.select("path", kind.alias("kind"), ref.alias("ref")).join(known.withColumn("known", F.lit(True)), ["kind", "ref"], "left")
    state = F.when(F.col("kind") == "staging", "staging").when(F.col("ref").isNull(), "unparseable").when(F.col("known"), "live").when(F.col("kind") == "blobs", "orphan_blob").otherwise("orphan_manifest")
    return rows.select("path", state.alias("class"))


def orphan_report(scanned: DataFrame) -> DataFrame:
    """One row of counts: what a sweep removes, and what it cannot read."""
    n = lambda x: F.sum(F.when(F.col("class") == x, 1).otherwise(0)).cast("long")
    return scanned.agg(n("staging").alias("staging_removed"), n("orphan_blob").alias("blobs_removed"), n("orphan_manifest").alias("manifests_removed"), n("unparseable").alias("errors"))


def gc_plan(c: Catalog, tombstones: DataFrame, now: int, grace: int) -> DataFrame:
    """What a collection does with every orphan: mark it, wait, or sweep it when the mark is old enough."""
    age = now - F.col("marked_at")
    action = F.when(F.col("marked_at").isNull(), "mark").when((F.lit(grace) == 0) | (age >= grace), "sweep").otherwise("wait")
    return orphans(c).join(tombstones, "blob_ref", "left").select("blob_ref", "original_size", action.alias("action"))


def rollback_plan(manifests: DataFrame, now: int) -> DataFrame:
    """Per session: how many artifacts a rollback deletes, all or nothing under retention."""
    held = F.sum(F.when(F.col("retention_until") > now, 1).otherwise(0))
    n = F.count(F.lit(1))
    return manifests.where("session_id != ''").groupBy("session_id").agg(n.alias("artifacts"), held.alias("held")).withColumn("deletes", F.when(F.col("held") > 0, 0).otherwise(F.col("artifacts")))


def scrub(c: Catalog, payloads: DataFrame) -> DataFrame:
    """Recomputed hashes against the catalog: ok, corrupt, or missing payload; payloads are one row a reference."""
    seen = payloads.select("blob_ref", F.sha2("payload", 256).alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("content_hash"), "ok").otherwise("corrupt")
    return c.blobs.join(seen, "blob_ref", "left").select("blob_ref", state.alias("state"))


def keep_newest(rows: DataFrame, name: str, seq: str, keep: int) -> DataFrame:
    """Versions that pruning drops: all but the newest ``keep`` of each name."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(seq)))).where(F.col("rn") > keep).drop("rn")


def evict(entries: DataFrame, cap: int, ident: str = "entry", buckets: int = 1024) -> DataFrame:
    """Idle entries to evict, oldest first, until the total is at most ``cap``; held ones stay.

    Entries of one moment go in the order of a hash, then of the entry.  The running sum goes by time
    buckets, moments and hashes, so no task orders more than what shares all three.
    """
    total = entries.agg(F.sum("size").alias("total"), F.min("last_access").alias("lo"), F.max("last_access").alias("hi"))
    idle = entries.where("holders = 0").join(F.broadcast(total))
    # equal times are told apart by a hash of the entry, so a burst of them is no single bucket
    idle = idle.withColumn("bucket", F.expr(f"CAST((last_access - lo) * {buckets} div (hi - lo + 1) AS long)")).withColumn("tie", F.pmod(F.xxhash64(ident), F.lit(buckets)))
    key = ["bucket", "last_access", "tie"]
    first = idle.groupBy("bucket").agg(F.sum("size").alias("s")).withColumn("b0", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("s")).drop("s")
    times = idle.groupBy("bucket", "last_access").agg(F.sum("size").alias("s")).withColumn("b1", F.sum("s").over(Window.partitionBy("bucket").orderBy("last_access")) - F.col("s")).drop("s")
    ties = idle.groupBy(*key).agg(F.sum("size").alias("s")).withColumn("b2", F.sum("s").over(Window.partitionBy("bucket", "last_access").orderBy("tie")) - F.col("s")).drop("s")
    inside = F.sum("size").over(Window.partitionBy(*key).orderBy(ident)) - F.col("size")
    rows = idle.join(ties, key).join(times, ["bucket", "last_access"]).join(first, "bucket").withColumn("freed", F.col("b0") + F.col("b1") + F.col("b2") + inside)
    return rows.where(F.col("freed") < F.col("total") - cap).select(ident, "size")


def every_nth(events: DataFrame, n: int, span: int = 1 << 16) -> DataFrame:
    """Every n-th event of each type in the order of event_id, which is unique.

    There are few types, so the numbering goes by ranges of ``span`` identifiers: counts of the ranges
    first, then inside each range.
    """
    rows = events.select("event_type", "event_id").withColumn("range", F.floor(F.col("event_id") / span).cast("long"))
    key = ["event_type", "range"]
    before = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    before = before.select(*key, (F.sum("c").over(Window.partitionBy("event_type").orderBy("range")) - F.col("c")).alias("before"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("event_id"))).join(before, key)
    rn = F.col("before") + F.col("rn")
    return rows.where(rn % n == 0).select("event_type", "event_id", (rn / n).cast("long").alias("firing"))


def token(c: Catalog) -> DataFrame:
    """The last issued csn; deletes count, and one that found nothing does not."""
    return union_all([c.puts.select("csn"), c.gone.select(F.col("delete_csn").alias("csn"))]).agg(F.max("csn").alias("token"))


def since(c: Catalog, cursor: int) -> DataFrame:
    """Live rows after a cursor."""
    return c.manifests.where(F.col("csn") > cursor).select("manifest_digest", "csn")


def since_head(c: Catalog, cursor: int) -> DataFrame:
    """One row, also when nothing is new: the next cursor (the last row's, or the old one) and whether history was pruned past the cursor."""
    last = c.manifests.where(F.col("csn") > cursor).agg(F.coalesce(F.max("csn"), F.lit(cursor)).alias("next"))
    pruned = c.gone.agg(F.coalesce(F.max("delete_csn"), F.lit(0)).alias("pruned"))
    return last.crossJoin(F.broadcast(pruned)).select(F.col("next").cast("long").alias("next"), (F.lit(cursor) < F.col("pruned")).alias("gapped"))


def delta(c: Catalog, cursor: int) -> DataFrame:
    """What a view needs to catch up: the new rows resolved, or none for a gapped reader, who rebuilds."""
    gapped = since_head(c, cursor).select("gapped")
    return projection(c.manifests.where((F.col("csn") > cursor) & F.col("artifact_id").isNotNull()), c.blobs).crossJoin(F.broadcast(gapped)).where("NOT gapped").drop("gapped")


def unverified_manifests(c: Catalog, cutoff: int) -> DataFrame:
    """The projection of user manifests never verified or last verified before the cutoff."""
    due = unverified(c.manifests.where("artifact_id IS NOT NULL"), cutoff)
    return projection(due, c.blobs).join(due.select("manifest_digest", "last_verified_at"), "manifest_digest")


def scrub_cutoff(now: int, max_age: int, native_age: int, force: bool = False, native: bool = False) -> int:
    """The moment before which a verification is stale: now when forced, a laxer age on media that check themselves."""
    return now if force else now - (native_age if native else max_age)


def first_rows(rows: DataFrame, wanted, most: int | None = None) -> list:
    """Rows taken one by one until ``wanted`` says stop; partitions behind that are not read."""
    out = []
    for r in rows.toLocalIterator():
        if most is not None and len(out) >= most or not wanted(r):
            break
        out.append(r)
    return out
