"""Preference formatting: paired completions behind one shared prompt.

The longest common turn prefix of a chosen and a rejected conversation is found by comparing
256-bit hashes of the turns position by position, rendered once as the prompt, and the turns
after it become two completions with masks over what the assistant said.  Texts are dealt by
pair once; every later step is a window or an aggregate inside those partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def consecutive_pairs(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversation 2k is chosen over 2k + 1; a side that is missing is null."""
    ids = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("c")).distinct()
    return ids.groupBy(F.floor(F.col("c") / 2).cast("long").alias("pair_id")).agg(F.max(F.when(F.pmod("c", F.lit(2)) == 0, F.col("c"))).alias("chosen_id"), F.max(F.when(F.pmod("c", F.lit(2)) == 1, F.col("c"))).alias("rejected_id"))


def preference_pairs(conversations: DataFrame, pairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a pair: pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected and their masks.

    Turns are ordered by turn number, then role and text, so repeated turn numbers have a fixed order;
    rows without a conversation id are in no pair.  Null roles and texts render empty and equal each other.
    A mask lists start:end code points of the assistant's words in the completion, ends exclusive, joined
    by commas; it is empty when there is nothing to learn from.  A missing side renders empty and has no
    common prefix.
    """
    sides = pairs.select("pair_id", F.lit(0).alias("side"), F.col("chosen_id").alias("c")).union(pairs.select("pair_id", F.lit(1), F.col("rejected_id"))).where("c IS NOT NULL")
    turns = conversations.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = sides.join(turns, "c").repartition("pair_id")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("t", "role", "text")))
    rows = rows.withColumn("h", F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)))
    place, pair = Window.partitionBy("pair_id", "i"), Window.partitionBy("pair_id")
    same = (F.min("side").over(place) != F.max("side").over(place)) & (F.min("h").over(place) == F.max("h").over(place))
    rows = rows.withColumn("same", same).drop("h")
    rows = rows.withColumn("n_common", F.coalesce(F.min(F.when(~F.col("same"), F.col("i"))).over(pair) - 1, F.max("i").over(pair)))
    rows = rows.withColumn("piece", _rendered(F.col("role"), F.col("text")))
    key = F.when(F.col("i") <= F.col("n_common"), F.lit(-1)).otherwise(F.col("side"))
    # the prefix is rendered once, from the chosen side
    rows = rows.withColumn("part", key).where("part >= 0 OR side = 0")
    said = F.col("role") == "assistant"
    before = F.sum(F.length("piece")).over(Window.partitionBy("pair_id", "part").orderBy("i")) - F.length("piece")
    start = before + F.length(F.lit(OPEN)) + F.length("role") + 1
    span = F.when(said, F.concat(start.cast("string"), F.lit(":"), (start + F.length("text")).cast("string")))
    rows = rows.withColumn("span", span)
    def part(n: int, col: str, sep: str) -> Column:
        listed = F.sort_array(F.collect_list(F.when((F.col("part") == n) & F.col(col).isNotNull(), F.struct("i", col))))
        return F.array_join(F.transform(listed, lambda x: x[col]), sep)

    out = rows.groupBy("pair_id").agg(F.first("n_common").alias("n_common"), part(-1, "piece", "").alias("prompt"), part(0, "piece", "").alias("chosen"), part(1, "piece", "").alias("rejected"), part(0, "span", ",").alias("chosen_mask"), part(1, "span", ",").alias("rejected_mask"))
    out = pairs.join(out, "pair_id", "left")
    empty = ["prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    return out.select("pair_id", "chosen_id", "rejected_id", F.coalesce("n_common", F.lit(0)).cast("long").alias("n_common"), *[F.coalesce(c, F.lit("")).alias(c) for c in empty])


ORACLE = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT c // 2 AS pair_id, max(CASE WHEN c % 2 = 0 THEN c END) AS chosen_id, max(CASE WHEN c % 2 = 1 THEN c END) AS rejected_id FROM ids GROUP BY 1),
turns AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
met AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i, a.i IS NOT NULL AND b.i IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
  FROM (SELECT * FROM turns WHERE side = 0) a FULL JOIN (SELECT * FROM turns WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
common AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n FROM met GROUP BY 1),
pieces AS (SELECT t.*, n, CASE WHEN i <= n THEN -1 ELSE side END AS part, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM turns t JOIN common USING (pair_id) WHERE NOT (i <= n AND side = 1)),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id, part ORDER BY i) - length(piece) + 13 + length(role) AS s FROM pieces),
parts AS (SELECT pair_id, any_value(n) AS n,
  string_agg(piece, '' ORDER BY i) FILTER (WHERE part = -1) AS prompt, string_agg(piece, '' ORDER BY i) FILTER (WHERE part = 0) AS chosen, string_agg(piece, '' ORDER BY i) FILTER (WHERE part = 1) AS rejected,
  string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(text) AS BIGINT), ',' ORDER BY i) FILTER (WHERE part = 0 AND role = 'assistant') AS chosen_mask,
  string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(text) AS BIGINT), ',' ORDER BY i) FILTER (WHERE part = 1 AND role = 'assistant') AS rejected_mask FROM placed GROUP BY 1)
SELECT pair_id, chosen_id, rejected_id, CAST(coalesce(n, 0) AS BIGINT) AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
  coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask FROM pairs LEFT JOIN parts USING (pair_id)
"""
