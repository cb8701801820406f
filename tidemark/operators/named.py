"""Named artifacts as a table of versions (name, seq, payload): put, get, list, scope, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.catalog import keep_newest


def put(table: DataFrame, incoming: DataFrame, keep: int = 1) -> DataFrame:
    """The table after writing one new version of each incoming name (name, payload).

    ``keep`` 0 replaces the name's only cell (seq 0); otherwise the next seq is appended and only the
    newest ``keep`` versions of the names written stay.
    """
    last = table.groupBy("name").agg(F.max("seq").alias("last"))
    if keep == 0:
        new = incoming.select("name", F.lit(0).cast("long").alias("seq"), "payload")
        return table.join(incoming.select("name"), "name", "left_anti").select("name", "seq", "payload").unionByName(new)
    new = incoming.join(last, "name", "left").select("name", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), "payload")
    grown = table.select("name", "seq", "payload").unionByName(new)
    dropped = keep_newest(grown.join(incoming.select("name"), "name", "left_semi"), "name", "seq", keep)
    return grown.join(dropped.select("name", "seq"), ["name", "seq"], "left_anti")


def get(table: DataFrame) -> DataFrame:
    """The active version of every name."""
    return table.groupBy("name").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def scoped(table: DataFrame, scope: str) -> DataFrame:
    """Names of one scope, without its prefix."""
    return table.where(F.col("name").startswith(scope + "/")).withColumn("name", F.substring("name", len(scope) + 2, 1 << 30))


def delete(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("name") != name)


def scoped_put(table: DataFrame, incoming: DataFrame, scope: str, keep: int = 1, veto=None) -> DataFrame:
    """A put under a scope's prefix; ``veto`` (a condition on name and payload) refuses the whole write."""
    if veto is not None and not incoming.where(veto).isEmpty():
        raise ValueError("the validator refuses a payload")
    return put(table, incoming.select(F.concat(F.lit(scope + "/"), F.col("name")).alias("name"), "payload"), keep)


def merged(versions: DataFrame, cells: DataFrame) -> DataFrame:
    """Versioned names by their active version and unversioned cells as one list (name, seq, payload), in name order."""
    return get(versions).unionByName(cells.select("name", F.lit(0).cast("long").alias("seq"), "payload")).orderBy("name")
