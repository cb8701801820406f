"""Writes as rows of an append-only log, and the snapshot that a log stands for.

A log row is (csn, op, manifest_digest, ...): ``put`` indexes a manifest, ``delete`` removes it, ``verify``
stamps it.  Writers append; readers take the newest state of every digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import content_hash, handle, manifest_document
from tidemark.operators.payload import run_stages
from tidemark.sources import Catalog, blobs_of, edges_of, union_all


def snapshot(log: DataFrame) -> DataFrame:
    """Live manifests of a log: (manifest_digest, csn of its last put, last_verified_at, prune_csn).

    A manifest lives if its last put comes after its last delete; a stamp counts if it comes after that put.
    prune_csn is the last delete that found something, null while there was none.  One aggregate, which
    combines before its shuffle; the single prune row is broadcast.
    """
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("csn")))
    stamp = F.max(F.when(F.col("op") == "verify", F.struct("csn", "at")))
    state = log.groupBy("manifest_digest").agg(last("put").alias("csn"), last("delete").alias("gone"), stamp.alias("stamp"))
    prune = state.where("csn IS NOT NULL").agg(F.max("gone").alias("prune_csn"))
    live = state.where("csn IS NOT NULL AND (gone IS NULL OR gone < csn)")
    seen = F.when(F.col("stamp.csn") > F.col("csn"), F.col("stamp.at"))
    return live.select("manifest_digest", "csn", seen.alias("last_verified_at")).join(F.broadcast(prune))


def size_guard(payloads: DataFrame, limit: int, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): payloads over the limit are rejected with their size; a limit of 0 accepts all."""
    over = F.coalesce(F.octet_length(payload) > limit, F.lit(False)) if limit else F.lit(False)
    return payloads.where(~over), payloads.where(over).withColumn("rejected_size", F.octet_length(payload).cast("long"))


def claim_versions(table: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(won, lost) of claims (name, seq, claimant): only the next number of a name can be claimed, the smallest claimant gets it."""
    last = table.groupBy("name").agg(F.max("seq").alias("last"))
    due = claims.join(last, "name", "left").withColumn("due", F.coalesce("last", F.lit(0)) + 1)
    won = due.where("seq = due").groupBy("name", "seq").agg(F.min("claimant").alias("claimant"))
    return won, claims.join(won, ["name", "seq", "claimant"], "left_anti")


def mark(tombstones: DataFrame, refs: DataFrame, now: int) -> DataFrame:
    """Tombstones after marking refs (blob_ref): an existing mark keeps its time."""
    new = refs.select("blob_ref").distinct().join(tombstones, "blob_ref", "left_anti").withColumn("marked_at", F.lit(now).cast("long"))
    return tombstones.select("blob_ref", "marked_at").unionByName(new)


def unmark(tombstones: DataFrame, refs: DataFrame) -> DataFrame:
    return tombstones.join(refs.select("blob_ref"), "blob_ref", "left_anti")


def pack(placements: DataFrame, members: DataFrame, pack_ref: str) -> DataFrame:
    """Placements (blob_ref, pack_ref, offset, length) after recording the members (blob_ref, offset, length) of a pack."""
    new = members.select("blob_ref", F.lit(pack_ref).alias("pack_ref"), "offset", "length")
    return placements.join(new.select("blob_ref"), "blob_ref", "left_anti").select(*new.columns).unionByName(new)


def unpack(placements: DataFrame, pack_ref: str) -> DataFrame:
    return placements.where(F.col("pack_ref") != pack_ref)


def registered(registry: DataFrame, name: str, nsid: str) -> DataFrame:
    """The registry (name, nsid) with one more namespace; refused if the name or the id is taken."""
    if not registry.where((F.col("name") == name) | (F.col("nsid") == nsid)).isEmpty():
        raise ValueError(f"namespace {name} or its id exists")
    return registry.unionByName(registry.sparkSession.createDataFrame([(name, nsid)], registry.select("name", "nsid").schema))


def unregistered(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") != name)


def namespaced(rows: DataFrame, registry: DataFrame, name: str = "namespace") -> tuple[DataFrame, DataFrame]:
    """(accepted with nsid, rejected): every row names its namespace; unknown and null names are rejected."""
    r = registry.select(F.col("name").alias(name), "nsid")
    return rows.join(r, name), rows.join(r, name, "left_anti")


def scoped_view(rows: DataFrame, nsid: str) -> DataFrame:
    """What one namespace sees: its own rows and no other."""
    return rows.where(F.col("nsid") == nsid)


def scoped_delete(rows: DataFrame, nsid: str, digests: DataFrame) -> DataFrame:
    """Rows after a namespace deletes digests: rows of other namespaces stay even if they are named."""
    gone = digests.select("manifest_digest", F.lit(nsid).alias("nsid"))
    return rows.join(gone, ["manifest_digest", "nsid"], "left_anti")


def gated(log: DataFrame, denied: tuple[str, ...] = ("put", "delete")) -> tuple[DataFrame, DataFrame]:
    """(allowed, denied) rows of a log under a policy that refuses some operations."""
    no = F.coalesce(F.col("op").isin(*denied), F.lit(False))
    return log.where(~no), log.where(no)


def config_change(history: DataFrame, change: dict[str, str], classes: dict[str, str]) -> DataFrame:
    """History (seq, field, value) after a change: one new whole version.  Immutable fields are refused once set,
    session fields never persist."""
    last = history.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first().s
    current = {r.field: r.value for r in history.where(F.col("seq") == last).collect()}
    if stuck := [f for f, v in change.items() if classes.get(f) == "immutable" and current.get(f, v) != v]:
        raise ValueError(f"{stuck[0]} cannot change")
    new = {**current, **{f: v for f, v in change.items() if classes.get(f) != "session"}}
    rows = [(last + 1, f, v) for f, v in sorted(new.items())]
    return union_all([history, history.sparkSession.createDataFrame(rows, history.schema)]) if rows else history


def config_rollback(history: DataFrame, seq: int) -> DataFrame:
    """A rollback is a new version with the fields of an old one."""
    last = history.agg(F.max("seq").alias("s")).first().s
    return history.unionByName(history.where(F.col("seq") == seq).withColumn("seq", F.lit(last + 1).cast(history.schema["seq"].dataType)))


def consensus(replicas: list[str | None]) -> str | None:
    """The descriptor that two replicas vote for: both the same, or the one that is left; None when they differ or are gone."""
    seen = {r for r in replicas if r is not None}
    return seen.pop() if len(seen) == 1 else None


#: Columns of a manifest that a put carries in the log.
MANIFEST_COLUMNS = "manifest_digest artifact_id session_id blob_ref blob_refs content_hash original_size created_at retention_until ext".split()


def put_batch(incoming: DataFrame, c: Catalog, now: int, inline_limit: int = 4096, stages: tuple[str, ...] = ()) -> DataFrame:
    """Artifacts (payload, session_id, ext, retention_until) as put rows: MANIFEST_COLUMNS, action, stored and inline.

    action tells where the payload goes: inline (at most the limit), deduplicated (a blob with the same content and
    size is there, or comes earlier in the batch), stored (new bytes, in column stored).  A batch is in the order of
    session and ext, nulls last; ties go by the other columns that it carries, as far as their types have an order, so
    no tie is left between rows that differ in them.  One aggregate and one join by content; nothing is looked up row by row.
    """
    rows = incoming.withColumn("original_size", F.octet_length("payload").cast("long"))
    rows = run_stages(rows, list(stages)).withColumn("artifact_id", handle(F.col("content_hash"))).withColumn("created_at", F.lit(now).cast("long"))
    inline = F.col("original_size") <= inline_limit
    known = c.blobs.where("crypto_identity = ''").groupBy("content_hash", "original_size").agg(F.min("blob_ref").alias("known"))
    rows = rows.join(known, ["content_hash", "original_size"], "left")
    carried = [x for x in incoming.columns if x not in ("payload", *MANIFEST_COLUMNS)]
    ordered = [x for x, kind in incoming.dtypes if x in carried and "map<" not in kind and "variant" not in kind]
    order = [F.asc_nulls_last(x) for x in ("session_id", "ext", *ordered, "retention_until")]
    first = F.row_number().over(Window.partitionBy("content_hash", "original_size").orderBy(*order))
    rows = rows.withColumn("action", F.when(inline, "inline").when(F.col("known").isNotNull() | (first > 1), "deduplicated").otherwise("stored"))
    rows = rows.withColumn("blob_ref", F.when(~inline, F.coalesce("known", "blob_ref"))).withColumn("blob_refs", F.when(inline, F.array().cast("array<string>")).otherwise(F.array("blob_ref")))
    rows = rows.withColumn("document", manifest_document("ext", "artifact_id", "blob_refs", "content_hash", "created_at", "original_size", "session_id")).withColumn("manifest_digest", F.sha2("document", 256))
    rows = rows.withColumn("stored", F.when(F.col("action") == "stored", F.col("stored"))).withColumn("inline", F.when(inline, F.col("payload")))
    return rows.select(*carried, *MANIFEST_COLUMNS, "document", "action", "stored", "inline")


def headless(payloads: DataFrame, now: int) -> DataFrame:
    """Container manifests of payloads (payload): no handle, one blob, addressed by the digest, never inline."""
    rows = payloads.withColumn("content_hash", content_hash(F.col("payload"))).withColumn("blob_ref", F.col("content_hash")).withColumn("blob_refs", F.array("blob_ref"))
    rows = rows.withColumns({"artifact_id": F.lit(None).cast("string"), "slot": F.lit(""), "session_id": F.lit(""), "ext": F.lit("{}"), "created_at": F.lit(now).cast("long"), "original_size": F.octet_length("payload").cast("long"), "retention_until": F.lit(None).cast("long")})
    document = manifest_document("ext", "slot", "blob_refs", "content_hash", "created_at", "original_size", "session_id")
    return rows.withColumn("manifest_digest", F.sha2(document, 256)).select(*MANIFEST_COLUMNS)


def delete_checked(wanted: DataFrame, c: Catalog, now: int, no_delete: bool = False) -> DataFrame:
    """(artifact_id, manifest_digest, outcome) of deletes: not_found, retention (which comes before the policy), forbidden, deleted.

    A handle stands for its freshest manifest; manifests without a handle are not visible.
    """
    newest = c.manifests.where("artifact_id IS NOT NULL").groupBy("artifact_id").agg(F.max(F.struct("csn", "manifest_digest", "retention_until")).alias("m"))
    rows = wanted.select("artifact_id").distinct().join(newest, "artifact_id", "left").select("artifact_id", "m.manifest_digest", "m.retention_until")
    outcome = F.when(F.col("manifest_digest").isNull(), "not_found").when(F.col("retention_until") > now, "retention").when(F.lit(no_delete), "forbidden").otherwise("deleted")
    return rows.select("artifact_id", "manifest_digest", outcome.alias("outcome"))


def rollback(c: Catalog, session: str, now: int) -> DataFrame:
    """Digests that rolling a session back deletes: all of them, or none if any is under retention; an empty session is refused."""
    if not session:
        raise ValueError("a rollback needs a session")
    own = c.manifests.where(F.col("session_id") == session)
    held = F.max(F.when(F.col("retention_until") > now, 1).otherwise(0)).over(Window.partitionBy("session_id"))
    return own.withColumn("held", held).where("held = 0").select("manifest_digest")


def log_of_puts(put: DataFrame, first_csn: int, span: int = 1 << 16) -> DataFrame:
    """Put rows as log rows: csn counts on from ``first_csn`` in the order of digests; ranges of digests are counted first, so no task numbers all."""
    rows = put.withColumn("__b", F.conv(F.substring("manifest_digest", 1, 4), 16, 10).cast("long"))
    sums = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("__b", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("n")).alias("before"))
    rn = F.row_number().over(Window.partitionBy("__b").orderBy("manifest_digest"))
    rows = rows.withColumn("rn", rn).join(F.broadcast(before), "__b")
    return rows.withColumn("csn", F.lit(first_csn).cast("long") + F.col("before") + F.col("rn") - 1).withColumn("op", F.lit("put")).drop("__b", "rn", "before")


def catalog_of(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, edges, blobs) that a log of whole put rows, deletes and stamps stands for.

    Writers only append; indexing a digest twice is one row, and reference counts are counts of live edges.
    """
    live = snapshot(log)
    carried = [x for x in MANIFEST_COLUMNS if x != "manifest_digest"]
    put = log.where("op = 'put'").groupBy("manifest_digest").agg(F.max_by(F.struct(*carried), "csn").alias("r"), F.min("csn").alias("first"))
    put = put.select("manifest_digest", "r.*", F.col("first").alias("csn"))
    manifests = put.drop("csn").join(live.select("manifest_digest", "csn", "last_verified_at"), "manifest_digest")
    edges = edges_of(manifests)
    return manifests, edges, blobs_of(put.withColumn("last_verified_at", F.lit(None).cast("long")), edges)


def projections(manifests: DataFrame, indexers: dict[str, Callable[[DataFrame], DataFrame]], indexing: bool = True) -> DataFrame:
    """Rows (manifest_digest, index, field, value) that user indexers derive, one for each key; the greatest of several values stays.  None while indexing is off."""
    out = None
    for name, f in sorted(indexers.items()):
        one = f(manifests).select("manifest_digest", F.lit(name).alias("index"), "field", F.col("value").cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("manifest_digest", "index", "field").agg(F.max("value").alias("value"))
    return out if indexing else out.limit(0)


class Indexes:
    """Registered indexes with their schema versions: a name comes once, and a version never goes back."""

    def __init__(self, stored: dict[str, int] | None = None):
        self.stored, self.open = dict(stored or {}), {}

    def register(self, name: str, version: int, indexer: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.open:
            raise ValueError(f"index {name} is registered")
        if version < self.stored.get(name, version):
            raise ValueError(f"index {name} is stored at version {self.stored[name]}")
        self.stored[name], self.open[name] = version, indexer

    def listed(self) -> list[tuple[str, int]]:
        return sorted(self.stored.items())


def replay_tail(log: DataFrame, files: DataFrame, first_csn: int) -> DataFrame:
    """The log after the manifests of files (rebuilt rows, state indexed) are put again; digests that it holds are left."""
    new = files.where("state = 'indexed'").withColumn("retention_until", F.lit(None).cast("long")).join(log.where("op = 'put'").select("manifest_digest"), "manifest_digest", "left_anti")
    return log.unionByName(log_of_puts(new.select(*MANIFEST_COLUMNS), first_csn), allowMissingColumns=True)
