"""Key-value tables of secondary indexes, as rows (table_name, key, value): writes give the next table, scans are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import upsert

KEY = ["table_name", "key"]


def put(rows: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace those under the same table and key."""
    return upsert(rows.select(*KEY, "value"), incoming.select(*KEY, "value"), KEY)


def get(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The value of every wanted (table_name, key), null where there is none."""
    return wanted.select(*KEY).join(rows, KEY, "left").select(*KEY, "value")


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*KEY), KEY, "left_anti")


def _in_table(table_name: str):
    return F.col("table_name") == table_name


def delete_prefix(rows: DataFrame, table_name: str, prefix: str) -> DataFrame:
    """Drops every key that starts with the prefix; an empty one is refused, as it would empty the table."""
    if not prefix:
        raise ValueError("an empty prefix would delete the whole table")
    return rows.where(~(_in_table(table_name) & F.col("key").startswith(prefix)))


def prefix_scan(rows: DataFrame, table_name: str, prefix: str = "") -> DataFrame:
    """Rows whose key starts with the prefix, in key order; '' is the whole table."""
    return rows.where(_in_table(table_name) & F.col("key").startswith(prefix)).orderBy("key")


def range_scan(rows: DataFrame, table_name: str, low: str, high: str) -> DataFrame:
    """Rows with low <= key < high, in key order."""
    return rows.where(_in_table(table_name) & (F.col("key") >= low) & (F.col("key") < high)).orderBy("key")


def prefix_bound(prefix: bytes) -> bytes | None:
    """The least key above every key with the prefix; None when nothing is above (only 255 bytes, or none)."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
