"""Reading payloads back: open, range reads, verification, and what the read policy asks for.

Payload rows are (blob_ref, stored): the bytes as they lie in the store; inline payloads are rows
(manifest_digest, inline).  Stages are those of the payload transforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.payload import undo_stages
from tidemark.sources import Catalog


def opened(wanted: DataFrame, c: Catalog, stored: DataFrame, inline: DataFrame, stages: tuple[str, ...] = ()) -> DataFrame:
    """For every wanted artifact_id: state and payload.

    not_found without a user manifest; inline payloads come from the manifest; others from their blob, undone
    through the stages; corrupt when the catalog has the blob and its bytes are gone or cannot be read.  The
    freshest form of a handle is read.
    """
    newest = c.manifests.groupBy("artifact_id").agg(F.max(F.struct("csn", "manifest_digest", "blob_ref", "content_hash")).alias("m")).select("artifact_id", "m.*")
    rows = wanted.select("artifact_id").join(newest, "artifact_id", "left").join(inline, "manifest_digest", "left")
    back = undo_stages(stored, list(stages)).select("blob_ref", F.col("payload").alias("decoded"))
    rows = rows.join(back, "blob_ref", "left").withColumn("payload", F.when(F.col("blob_ref").isNull(), F.col("inline")).otherwise(F.col("decoded")))
    state = F.when(F.col("manifest_digest").isNull(), "not_found").when(F.col("payload").isNull(), "corrupt").when(F.col("blob_ref").isNull(), "inline").otherwise("target")
    return rows.select("artifact_id", "manifest_digest", "blob_ref", "content_hash", state.alias("state"), "payload")


def read_at(rows: DataFrame, offset: int, size: int, stages: tuple[str, ...] = ()) -> DataFrame:
    """Adds part and part_state of opened rows: only bytes stored as they are can be entered at an offset; a read past the end is short."""
    if stages:
        state = F.when(F.col("state").isin("inline", "target"), "not_supported").otherwise(F.col("state"))
        return rows.withColumn("part_state", state).withColumn("part", F.lit(None).cast("binary"))
    part = F.substring("payload", offset + 1, size)
    state = F.when(~F.col("state").isin("inline", "target"), F.col("state")).when(F.octet_length(part) < size, "end").otherwise("ok")
    return rows.withColumn("part_state", state).withColumn("part", part)


def verified(rows: DataFrame) -> DataFrame:
    """Adds verdict to opened rows: ok, corrupt (other bytes, or none), or not_found."""
    same = F.sha2("payload", 256) == F.col("content_hash")
    return rows.withColumn("verdict", F.when(F.col("state").isin("not_found", "corrupt"), F.col("state")).when(same, "ok").otherwise("corrupt"))


def verified_blobs(refs: DataFrame, c: Catalog, stored: DataFrame, stages: tuple[str, ...] = ()) -> DataFrame:
    """(blob_ref, consumer, verdict): each blob through the smallest live user manifest that lists it; not_found without one, which a scrub skips."""
    edges = c.edges.join(c.manifests.where("artifact_id IS NOT NULL").select("manifest_digest", "content_hash"), "manifest_digest")
    one = edges.groupBy("blob_ref").agg(F.min(F.struct("manifest_digest", "content_hash")).alias("m")).select("blob_ref", F.col("m.manifest_digest").alias("consumer"), "m.content_hash")
    back = undo_stages(stored, list(stages)).select("blob_ref", F.sha2("payload", 256).alias("actual"))
    rows = refs.select("blob_ref").distinct().join(one, "blob_ref", "left").join(back, "blob_ref", "left")
    return rows.select("blob_ref", "consumer", F.when(F.col("consumer").isNull(), "not_found").when(F.col("actual") == F.col("content_hash"), "ok").otherwise("corrupt").alias("verdict"))


def verify_on_read(policy: Column, native: Column, sealed: Column) -> Column:
    """Whether a read checks its hash: as forced or disabled; else not on media that check themselves, nor for payloads that a cipher guards."""
    return F.when(policy == "ForceEnabled", True).when(policy == "Disabled", False).otherwise(~native & ~sealed)


def overlaid(rows: DataFrame, placements: DataFrame) -> DataFrame:
    """Rows (blob_ref, ...) with pack_ref, offset, length where a pack holds the blob; plain rows have none."""
    return rows.join(placements.select("blob_ref", "pack_ref", "offset", "length"), "blob_ref", "left")


def enriched(rows: DataFrame, bulk: DataFrame, single: DataFrame, key: str, field: str) -> DataFrame:
    """Rows with a field from the bulk lookup, else from the one row at a time, else null."""
    a, b = bulk.select(key, F.col(field).alias("__a")), single.select(key, F.col(field).alias("__b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(field, F.coalesce("__a", "__b")).drop("__a", "__b")


def found_in(stores: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, stores, n): which of several stores have each key, names in order."""
    out = None
    for name, rows in sorted(stores.items()):
        one = rows.select(key).distinct().withColumn("store", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.sort_array(F.collect_set("store")).alias("stores"), F.count(F.lit(1)).alias("n"))
