"""Tree views: placement under several roots, collisions, directories, search, listing, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import date_path, hash_part, is_under, last_segment, parent, shard, vfs_path
from tidemark.sources import union_all

NAMES = {"en": "english", "de": "german", "fr": "french"}


def synthetic_path(session: Column, artifact: Column) -> Column:
    """Where an artifact without a path of its own stands: by its session's first digits and short id."""
    short = F.concat(F.substring(hash_part(artifact), 1, 16), F.lit(".bin"))
    at = F.when(F.length(session) < 4, F.concat(F.lit("_short/"), session)).otherwise(F.concat_ws("/", F.substring(session, 1, 2), F.substring(session, 3, 2), session))
    return F.concat_ws("/", F.when(F.coalesce(session, F.lit("")) == "", F.lit("_anonymous")).otherwise(at), short)


def labelled(rows: DataFrame, registry: DataFrame, nsid: str = "nsid") -> DataFrame:
    """Rows with the namespace's name from the registry (name, nsid), else its id, else _default."""
    known = registry.select(F.col("nsid").alias(nsid), F.col("name").alias("__name"))
    return rows.join(known, nsid, "left").withColumn("label", F.coalesce("__name", F.when(F.col(nsid) != "", F.col(nsid)), F.lit("_default"))).drop("__name")


def placed(manifests: DataFrame) -> DataFrame:
    """(root, path, artifact_id, created_at, original_size): each artifact under every root it has a place in."""
    a = F.col("artifact_id")
    base = manifests.withColumn("vfs", vfs_path(F.col("ext"))).withColumn("nsid", F.get_json_object("ext", "$.nsid"))
    # by-date shows the path's last segment where there is one
    label = F.coalesce(last_segment(F.col("vfs")), F.concat(F.substring(hash_part(a), 1, 16), F.lit(".bin")))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("nsid")), "nsid", F.lit("_default"))
    rules = [("by-artifact", shard(a), F.lit(True)), ("by-date", date_path(F.col("created_at"), label), F.lit(True)), ("by-session", F.concat_ws("/", "session_id", a), F.col("session_id") != ""), ("by-orphaned", shard(a), F.col("vfs").isNull()), ("by-path", F.col("vfs"), F.col("vfs").isNotNull()), ("by-namespace", F.concat_ws("/", name, shard(a)), F.lit(True))]
    places = F.array(*[F.when(keep, F.struct(F.lit(root).alias("root"), path.alias("path"))) for root, path, keep in rules])
    rows = base.select("artifact_id", "manifest_digest", "created_at", "original_size", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("at"))
    return rows.select("at.root", "at.path", "artifact_id", "manifest_digest", "created_at", "original_size")


def ranked(places: DataFrame) -> DataFrame:
    """Claims of every path in the order of election: rn 1 wins, the rest are the queue behind it."""
    rank = Window.partitionBy("root", "path").orderBy(F.desc("created_at"), F.desc("artifact_id"), F.desc("manifest_digest"))
    return places.withColumn("rn", F.row_number().over(rank))


def winners(places: DataFrame) -> DataFrame:
    """The newest claim of every path (ties by the larger id): one max over structs, which combines before the shuffle."""
    best = F.max(F.struct("created_at", "artifact_id", "manifest_digest", "original_size")).alias("w")
    return places.groupBy("root", "path").agg(best, F.count(F.lit(1)).alias("claims")).select("root", "path", "w.*", "claims")


def virtual_dirs(files: DataFrame) -> DataFrame:
    """(root, path) of every ancestor of a file."""
    segs = F.split("path", "/")
    ups = F.expr("CASE WHEN size(split(path, '/')) > 1 THEN transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/')) ELSE array() END")
    return files.where(F.size(segs) > 1).select("root", F.explode(ups).alias("path")).distinct()


def nodes(files: DataFrame) -> DataFrame:
    """Files and directories as (root, path, name, parent, is_dir, size, mtime)."""
    f = files.select("root", "path", F.lit(False).alias("is_dir"), F.col("original_size").alias("size"), F.col("created_at").alias("mtime"))
    d = virtual_dirs(files).select("root", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))
    return union_all([f, d]).withColumn("name", last_segment(F.col("path"))).withColumn("parent", parent(F.col("path")))


def children(tree: DataFrame, root: str, path: str) -> DataFrame:
    return tree.where((F.col("root") == root) & (F.col("parent") == path)).orderBy("name")


def listed(tree: DataFrame, root: str, path: str) -> DataFrame:
    """Children of a directory; FileNotFoundError for a path that is not there, NotADirectoryError for a file.  The root is always there."""
    if path:
        at = tree.where((F.col("root") == root) & (F.col("path") == path)).select("is_dir").first()
        if at is None:
            raise FileNotFoundError(path)
        if not at.is_dir:
            raise NotADirectoryError(path)
    return children(tree, root, path)


def got(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted (root, path) with its node, found or not."""
    return wanted.select("root", "path").join(tree.withColumn("found", F.lit(True)), ["root", "path"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def attributes(tree: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with the mode, owner and time a file system shows: of the path document where it states them, else defaults."""
    doc = lambda key: F.get_json_object("ext", f"$.vfsmeta.{key}")
    stated = files.select("root", "path", doc("mode").cast("int").alias("m"), doc("uid").cast("int").alias("u"), doc("gid").cast("int").alias("g"), doc("mtime").cast("long").alias("t"))
    rows = tree.join(stated, ["root", "path"], "left")
    mode = F.coalesce("m", F.when(F.col("is_dir"), F.lit(0o755)).otherwise(F.lit(0o644)))
    return rows.select("root", "path", "is_dir", "size", mode.alias("mode"), F.coalesce("u", F.lit(0)).alias("uid"), F.coalesce("g", F.lit(0)).alias("gid"), F.coalesce("t", "mtime").alias("mtime"))


def changed(places: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, winners of the touched paths) after claims (root, path, manifest_digest) go and others come.

    Only paths that a change names elect anew; the next claim in line takes a path whose winner goes.
    """
    after = places.join(removed.select("root", "path", "manifest_digest"), ["root", "path", "manifest_digest"], "left_anti").unionByName(added.select(*places.columns))
    touched = removed.select("root", "path").unionByName(added.select("root", "path")).distinct()
    return after, winners(after.join(touched, ["root", "path"], "left_semi"))


def moved(places: DataFrame, root: str, old: str, new: str) -> DataFrame:
    """Places after one path is moved: all its claims go with it."""
    return places.withColumn("path", F.when((F.col("root") == root) & (F.col("path") == old), F.lit(new)).otherwise(F.col("path")))


def removed_tree(tree: DataFrame, root: str, path: str) -> DataFrame:
    """Rows after a directory and all below it are removed; the root itself cannot be."""
    if not path:
        raise ValueError("the root cannot be removed")
    return tree.where(~((F.col("root") == root) & is_under(F.col("path"), path)))


def stats(c, places: DataFrame) -> DataFrame:
    """One row: artifacts, bytes, sessions, artifacts without a path of their own, and claims that lost their path."""
    m = c.manifests.where("artifact_id IS NOT NULL").withColumn("vfs", vfs_path(F.col("ext")))
    base = m.agg(F.count(F.lit(1)).alias("nodes"), F.sum("original_size").alias("bytes"), F.countDistinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"), F.sum(F.when(F.col("vfs").isNull(), 1).otherwise(0)).alias("orphaned"))
    lost = winners(places).agg(F.sum(F.col("claims") - 1).alias("collisions"))
    return base.crossJoin(F.broadcast(lost))


def walk(tree: DataFrame, root: str, path: str) -> DataFrame:
    """Pre-order: siblings in name order, compared by segments."""
    return tree.where((F.col("root") == root) & is_under(F.col("path"), path)).orderBy(F.split("path", "/"))


def search(files: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """An exact id, or a part of the path in any case; id matches first, then newest; no limit when 0."""
    q = query.strip().lower()
    if not q:
        return files.limit(0)
    exact = F.col("artifact_id") == query
    hits = files.where(exact | F.contains(F.lower("path"), F.lit(q))).orderBy(exact.desc(), F.desc("created_at"), "artifact_id", "path")
    return hits.limit(limit) if limit else hits


def truncated(hits: DataFrame, cap: int = 200) -> tuple[DataFrame, bool]:
    """(at most ``cap`` hits, whether there are more): one more is asked for than shown."""
    probe = hits.limit(cap + 1)
    return probe.limit(cap), probe.count() > cap


def sorted_listing(rows: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """Directories first, then by name, size or mtime either way; ties by name."""
    if key not in ("name", "size", "mtime"):
        raise ValueError(f"no order by {key}")
    return rows.orderBy(F.desc("is_dir"), F.desc(key) if descending else F.asc(key), "name")


def page(rows: DataFrame, number: int, size: int = 200, key: str = "name", descending: bool = False) -> DataFrame:
    """One page of a listing; page numbers start at 1, and one out of range is the nearest there is."""
    last = max(1, -(-rows.count() // size)) if number > 1 else 1
    return sorted_listing(rows, key, descending).offset((min(max(number, 1), last) - 1) * size).limit(size)


def renamed(tree: DataFrame, old: str, new: str) -> DataFrame:
    below = is_under(F.col("path"), old)
    return tree.withColumn("path", F.when(below, F.concat(F.lit(new), F.substring(F.col("path"), len(old) + 1, 1 << 30))).otherwise(F.col("path")))
