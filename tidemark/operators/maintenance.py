"""Maintenance as plans: rebuilding the catalog from manifest documents, checkpoints, reclaim counts, leases, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import parsed_manifest, parsed_rfc3339, path_ref

#: Checkpoint names: a prefix and a moment of fixed width, so that they sort by time.
PREFIX, MOMENT = "checkpoint/", r"^checkpoint/\d{8}T\d{6}\.\d{9}Z$"


def rebuilt(files: DataFrame, since: int | None = None) -> DataFrame:
    """Catalog rows of manifest files (path, document, mtime), all or those modified at or after a moment.

    state is indexed, damaged (the document does not have the hash its path states, or is no manifest) or
    skipped (containers without a handle, composites); a damaged file does not stop the others.
    """
    rows = files if since is None else files.where(F.col("mtime") >= since)
    rows = rows.select("path", "document", path_ref(F.col("path")).alias("manifest_digest"), parsed_manifest(F.col("document")).alias("m"))
    whole = F.coalesce(F.col("m").isNotNull() & (F.sha2("document", 256) == F.col("manifest_digest")), F.lit(False))
    skipped = (F.coalesce(F.col("m.sys.artifact_id"), F.lit("")) == "") | F.coalesce(F.get_json_object("m.ext", "$.composite") == "true", F.lit(False))
    rows = rows.withColumn("state", F.when(~whole, "damaged").when(skipped, "skipped").otherwise("indexed"))
    s = F.col("m.sys")
    return rows.select("path", "state", "manifest_digest", s["artifact_id"].alias("artifact_id"), s["session_id"].alias("session_id"), F.get(s["blob_refs"], F.lit(0)).alias("blob_ref"), s["blob_refs"].alias("blob_refs"), s["content_hash"].alias("content_hash"), s["original_size"].alias("original_size"), parsed_rfc3339(s["created_at"]).alias("created_at"), F.col("m.ext").alias("ext"))


def rebuild_stats(rows: DataFrame) -> DataFrame:
    """One row of counts of a rebuild."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    indexed = F.col("state") == "indexed"
    return rows.agg(F.count(F.lit(1)).alias("scanned"), n(indexed).alias("indexed"), n(indexed & F.col("blob_ref").isNotNull()).alias("target"), n(F.col("state") == "skipped").alias("skipped"), n(F.col("state") == "damaged").alias("damaged"))


def checkpoints(names: DataFrame) -> DataFrame:
    """Names that are checkpoints; others under the prefix, such as leases, are passed over."""
    return names.where(F.col("name").rlike(MOMENT))


def latest_checkpoint(names: DataFrame) -> DataFrame:
    return checkpoints(names).agg(F.max("name").alias("name")).where("name IS NOT NULL")


def pruned_checkpoints(names: DataFrame, keep: int) -> DataFrame:
    """Checkpoints that retention drops: all but the newest ``keep``.  There are few of them, one window orders them."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("name"))
    return checkpoints(names).select("name").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") > keep).select("name")


def reclaim_counts(removals: DataFrame) -> DataFrame:
    """How many were reclaimed for each reason, and their bytes."""
    return removals.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def schema_version(applied: DataFrame) -> DataFrame:
    """The version a catalog is at; 0 before any."""
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def lease(leases: DataFrame, name: str, holder: str, now: int, ttl: int) -> tuple[DataFrame, bool]:
    """(leases after, granted): a lease (name, holder, expires) is granted when it is free, expired or one's own, which renews it."""
    held = leases.where((F.col("name") == name) & (F.col("holder") != holder) & (F.col("expires") > now)).isEmpty()
    if not held:
        return leases, False
    mine = leases.sparkSession.createDataFrame([(name, holder, now + ttl)], leases.select("name", "holder", "expires").schema)
    return leases.where(F.col("name") != name).unionByName(mine), True


def released_lease(leases: DataFrame, name: str, holder: str) -> DataFrame:
    """Leases after one's own is given back; another's stays."""
    return leases.where(~((F.col("name") == name) & (F.col("holder") == holder)))


def live(probe) -> tuple[bool, str]:
    """Whether a store answers a probe, and what it said when it does not."""
    try:
        probe()
    except Exception as e:  # noqa: BLE001
        return False, str(e)
    return True, ""
