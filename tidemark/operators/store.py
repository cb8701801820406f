"""Physical listings as tables (path, length, mtime): scans, stat, publishing, tombstones, and backends by scheme."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import is_strict_under, parent

#: Names that a listing never shows.
HIDDEN = r"(^|/)\.tmp-|\.tombstone$"


def children(files: DataFrame, prefix: str = "") -> DataFrame:
    """(name, is_dir, length) of what lies immediately below a prefix, in name order; temporary files and tombstones are hidden.

    A prefix that holds nothing does not exist: FileNotFoundError.
    """
    below = files.where(is_strict_under(F.col("path"), prefix) & ~F.col("path").rlike(HIDDEN))
    rest = F.substring("path", len(prefix) + 2 if prefix else 1, 1 << 30)
    rows = below.select(F.substring_index(rest, "/", 1).alias("name"), (F.instr(rest, "/") > 0).alias("is_dir"), "length")
    out = rows.groupBy("name", "is_dir").agg(F.sum(F.when(~F.col("is_dir"), F.col("length")).otherwise(0)).alias("length"))
    if prefix and out.isEmpty():
        raise FileNotFoundError(prefix)
    return out.orderBy("name")


def below(files: DataFrame, prefix: str, since: int | None = None) -> DataFrame:
    """Everything below a prefix, modified at or after a moment; nothing for a missing prefix."""
    rows = files.where(is_strict_under(F.col("path"), prefix))
    return rows.where(F.col("mtime") >= since) if since is not None else rows


def count_objects(files: DataFrame, prefix: str = "") -> DataFrame:
    return below(files, prefix).where(~F.col("path").rlike(HIDDEN)).agg(F.count(F.lit(1)).alias("n"))


def stat(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, found, length, mtime) of wanted paths."""
    return wanted.select("path").join(files.withColumn("found", F.lit(True)), "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"), "length", "mtime")


def put(files: DataFrame, incoming: DataFrame, exclusive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files after, refused): incoming files replace those of their path, or are refused where it exists."""
    if exclusive:
        refused = incoming.join(files.select("path"), "path", "left_semi")
        return files.unionByName(incoming.join(files.select("path"), "path", "left_anti")), refused
    return files.join(incoming.select("path"), "path", "left_anti").unionByName(incoming), incoming.limit(0)


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files after moves (path, target): a target that exists is replaced; a missing source moves nothing."""
    real = moves.join(files.select("path"), "path", "left_semi")
    moved = files.join(real, "path").select(F.col("target").alias("path"), "length", "mtime")
    return files.join(real.select("path"), "path", "left_anti").join(moved.select("path"), "path", "left_anti").unionByName(moved)


def cloned(files: DataFrame, copies: DataFrame, now: int) -> DataFrame:
    """Files after copies (path, target)."""
    made = files.join(copies, "path").select(F.col("target").alias("path"), "length", F.lit(now).cast("long").alias("mtime"))
    return files.join(made.select("path"), "path", "left_anti").unionByName(made)


def removed(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("path"), "path", "left_anti")


def tombstone_info(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, length, marked, marked_at) of every file; a mark (path, marked_at) without its file is not shown."""
    return files.join(marks, "path", "left").select("path", "length", F.col("marked_at").isNotNull().alias("marked"), "marked_at")


def empty_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories that hold no file at any depth: what pruning removes."""
    path, deep = F.col("path"), F.size(F.split("path", "/"))
    ups = F.when(deep > 1, F.transform(F.sequence(F.lit(1), F.greatest(deep - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    used = files.select(F.explode(ups).alias("path")).distinct()
    return dirs.select("path").join(used, "path", "left_anti")


def parents(files: DataFrame) -> DataFrame:
    return files.select(parent(F.col("path")).alias("path")).where("path != ''").distinct()


#: Readers by scheme; ``register`` adds one.
BACKENDS = {"file": lambda spark, uri: spark.read.parquet(uri), "parquet": lambda spark, uri: spark.read.parquet(uri.removeprefix("parquet://")), "json": lambda spark, uri: spark.read.json(uri.removeprefix("json://")), "csv": lambda spark, uri: spark.read.option("header", True).csv(uri.removeprefix("csv://"))}


def register(scheme: str, reader) -> None:
    if scheme in BACKENDS:
        raise ValueError(f"scheme {scheme} is taken")
    BACKENDS[scheme] = reader


def dial(spark: SparkSession, uri: str) -> DataFrame:
    """The rows behind ``scheme://place``; an unknown scheme is an error, a bare path is a file."""
    scheme = uri.split(":", 1)[0] if "://" in uri else "file"
    if scheme not in BACKENDS:
        raise ValueError(f"no backend for {scheme}")
    return BACKENDS[scheme](spark, uri)


@dataclass(frozen=True)
class Config:
    """What a catalog is opened with; unknown or wrongly typed fields are refused."""

    uri: str = ""
    inline_limit: int = 4096
    topology: str = "sharded"
    verify_on_read: str = "Auto"
    retention: int = 5

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file, or one of ``key: value`` lines."""
        text = Path(path).read_text()
        if path.endswith(".json"):
            raw = json.loads(text)
        else:
            raw = {}
            for line in text.splitlines():
                if line.strip() and not line.lstrip().startswith("#"):
                    k, _, v = line.partition(":")
                    v = v.strip().strip("'\"")
                    raw[k.strip()] = int(v) if v.lstrip("-").isdigit() else v
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if bad := [k for k in raw if k not in kinds]:
            raise ValueError(f"unknown field {bad[0]}")
        if bad := [k for k, v in raw.items() if type(v) is not kinds[k]]:
            raise ValueError(f"field {bad[0]} is no {kinds[bad[0]].__name__}")
        out = cls(**raw)
        if out.topology not in ("flat", "sharded") or out.verify_on_read not in ("Auto", "ForceEnabled", "Disabled") or not 0 <= out.inline_limit <= 65536:
            raise ValueError("a field is out of its range")
        return out

    def explain(self) -> str:
        """What would be opened, without opening it."""
        return "\n".join(f"{f.name} = {getattr(self, f.name)!r}" for f in fields(self))
