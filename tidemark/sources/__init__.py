"""The catalog's tables: derived from payload rows and an append-only log, written and restored as Parquet."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import content_hash, handle, manifest_document

#: First second of the derived clock, days in seconds, inline limit in bytes.
EPOCH, DAY, INLINE = 1704067200, 86400, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artifact a document, with every derived column of its manifest; no text beyond what is hashed."""
    d = F.col("doc_id")
    path = F.when(d % 13 == 0, F.lit("/abs")).otherwise(F.concat_ws("/", "lang", "source", F.concat((d % 37).cast("string"), F.lit(".txt"))))
    vfs = F.when(d % 11 == 0, F.lit("")).otherwise(F.concat(F.lit('"vfsmeta":{"version":1,"path":"'), path, F.lit('"},')))
    cd = content_hash(F.col("text"))
    size = F.octet_length("text").cast("long")
    ref = F.when(size > INLINE, cd)
    refs = F.when(ref.isNull(), F.array().cast("array<string>")).when(d % 17 == 0, F.array(ref, ref)).otherwise(F.array(ref))
    rows = table(spark, sf_dir, "documents").select(
        d, F.col("lang"), F.col("source").alias("session_id"), cd.alias("content_hash"), size.alias("original_size"), handle(cd).alias("artifact_id"),
        ref.alias("blob_ref"), refs.alias("blob_refs"), (EPOCH + d).alias("created_at"), (d + 1).alias("csn"),
        F.concat(F.lit("{"), vfs, F.lit('"nsid":"'), F.col("lang"), F.lit('"}')).alias("ext"),
        F.when(d % 3 != 0, EPOCH + d + (d % 40) * DAY).alias("last_verified_at"), F.when(d % 5 != 0, EPOCH + d + (d % 50) * DAY).alias("retention_until"),
    )
    document = manifest_document("ext", "artifact_id", "blob_refs", "content_hash", "created_at", "original_size", "session_id")
    return rows.withColumn("document", document).withColumn("manifest_digest", F.sha2("document", 256))


def puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).puts


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents: error events name them by number. The delete's csn follows all puts of the log."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("doc_id"), (F.col("event_id") + 1_000_000_000).alias("delete_csn"))


@dataclass(frozen=True)
class Catalog:
    """Manifests are live puts; blobs keep every blob ever put (a blob without live edges is an orphan)."""

    puts: DataFrame
    manifests: DataFrame
    edges: DataFrame
    blobs: DataFrame
    gone: DataFrame


def edges_of(manifests: DataFrame) -> DataFrame:
    """One row for each blob a manifest lists; every 17th document lists its blob twice."""
    return manifests.select("manifest_digest", F.posexplode("blob_refs").alias("position", "blob_ref"))


def derived(spark: SparkSession, sf_dir: str) -> Catalog:
    p = derived_puts(spark, sf_dir)
    gone = p.join(deletes(spark, sf_dir), "doc_id").select("doc_id", "manifest_digest", "delete_csn")
    live = p.join(gone.select("doc_id"), "doc_id", "left_anti")
    return Catalog(p, live, edges_of(live), blobs_of(p, edges_of(live)), gone)


def blobs_of(put: DataFrame, edges: DataFrame) -> DataFrame:
    """Every blob ever put, with the number of live edges to it."""
    first = put.where("blob_ref IS NOT NULL").groupBy("blob_ref").agg(F.min("csn").alias("csn"), F.first("original_size").alias("original_size"), F.max("last_verified_at").alias("last_verified_at"))
    counts = edges.groupBy("blob_ref").agg(F.count(F.lit(1)).alias("refs"))
    return first.join(counts, "blob_ref", "left").select("blob_ref", F.col("blob_ref").alias("content_hash"), "original_size", F.lit("").alias("crypto_identity"), F.coalesce("refs", F.lit(0)).alias("ref_count"), "last_verified_at", F.col("csn").alias("first_csn"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read; a local one only where none is configured and there are no other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str, refresh: bool = False) -> Catalog:
    """The catalog of a folder, derived once for an application and written as Parquet: lookups read its columns, never the texts.

    The files go when the driver ends.  ``refresh`` derives it anew after the folder has changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _CATALOGS:
        path = f"{shared_folder(spark)}/tidemark-catalog-{key[0]}/{uuid.uuid4().hex}"
        made = derived(spark, sf_dir)
        out = {}
        for name in ("puts", "gone", "manifests", "edges", "blobs"):
            rows = made.__dict__[name]
            if name in ("manifests", "edges", "blobs"):  # from what is written already
                live = out["puts"].join(out["gone"].select("doc_id"), "doc_id", "left_anti")
                rows = live if name == "manifests" else edges_of(out["manifests"]) if name == "edges" else blobs_of(out["puts"], out["edges"])
            rows.write.parquet(f"{path}/{name}")
            out[name] = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _CATALOGS[key] = Catalog(**out)
    return _CATALOGS[key]


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned names: each user's events in order are the versions of one name."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), seq.cast("long").alias("seq"), "event_id", "event_type")


def save_checkpoint(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet; refuses a destination that exists.  The folder gets its name when all tables are there, so a crash leaves no half one under it."""
    spark = next(iter(tables.values())).sparkSession
    name = spark._jvm.org.apache.hadoop.fs.Path
    fs = name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(name(path)):
        raise FileExistsError(path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    for table_name, df in tables.items():
        df.write.parquet(f"{part}/{table_name}")
    if not fs.rename(name(part), name(path)):
        raise FileExistsError(path)


def restore(spark: SparkSession, path: str, current: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Upsert of a checkpointed table into the current rows: the checkpoint's row wins for each key."""
    saved = spark.read.parquet(f"{path}/{name}")
    return upsert(current, saved, key)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace those under their key; of incoming rows that share a key the greatest one stays."""
    rest = [c for c in incoming.columns if c not in key]
    one = incoming.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else incoming.distinct()
    return current.join(one.select(*key), key, "left_anti").unionByName(one.select(*incoming.columns))


def listing(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Files below a folder (path, length, modification time), with ``since`` (UTC) inclusive."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return df.where(F.col("modificationTime") >= F.to_timestamp(F.lit(since))) if since else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
