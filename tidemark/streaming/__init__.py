"""Streams: the operation log as a feed, converging a view, and every-N counters."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of an append-only log, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def fire_every(stream: DataFrame, n: int) -> DataFrame:
    """(event_type, firings) of each batch: a counter for each type that fires at n and starts over."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((count % n,))
        if count >= n:
            yield pd.DataFrame({"event_type": [key[0]], "firings": [count // n]})

    return stream.groupBy("event_type").applyInPandasWithState(step, "event_type string, firings long", "count long", "append", GroupStateTimeout.NoTimeout)


def converge(stream: DataFrame, apply, rebuild, checkpoint: str) -> StreamingQuery:
    """Keep a view current: batches of puts are applied, a batch with a delete rebuilds the view whole."""

    def batch(rows: DataFrame, number: int) -> None:
        if rows.where("op = 'delete'").isEmpty():
            apply(rows, number)
        else:
            rebuild(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wait(token, after: int, every: float = 0.05, most: float = 5.0) -> int | None:
    """Polls ``token()`` until it passes a cursor; the new token, or None when the time is over."""
    end = time.monotonic() + most
    while True:
        now = token()
        if now > after:
            return now
        if time.monotonic() >= end:
            return None
        time.sleep(every)


def audited(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Events of a stream as rows of an audit table, each once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(stream: DataFrame, indexers: dict, sink, checkpoint: str) -> StreamingQuery:
    """Derived rows of every batch of puts go to ``sink(rows, number)``: the reaction beside the write."""

    def batch(rows: DataFrame, number: int) -> None:
        for name, f in sorted(indexers.items()):
            sink(f(rows.where("op = 'put'")).selectExpr("*", f"'{name}' AS index"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
