"""Mixing sources by temperature: DataFrame and SQL functions only.

The token share p of each source is raised to an exponent a in [0, 1] and normalised.
Bisection finds the largest a (the least change) whose weights reach the target entropy,
or, if that would repeat a source more often than allowed, the smallest a that keeps the
repetition limit.  The weights turn into a token budget per source.  A source is then
dealt in passes: each pass is a fresh pseudo-random permutation of all its documents,
full passes come whole and the last one stops at the budget.  Blocks take the sources in
the target proportion, and every block is a pseudo-random permutation of what it holds.

A hot source is never ordered in one task: permutations are cut into buckets by hash,
bucket sums give every bucket its offset, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ROW, numbered, recorded, swept, word_array, written

#: Entropy to reach, as a share of the entropy of equal weights.
ENTROPY = 0.92
#: A source may be repeated at most so often, relative to the least repeated one.
REPEAT = 3.0
#: Halvings of the exponent's interval.
HALVINGS = 30
#: Documents to a bucket and tokens to a block of the output.
BUCKET, BLOCK = 4096, 1 << 20
SEED = 42


def weights(sizes: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT) -> DataFrame:
    """(source, tokens, docs) -> also exponent, weight and epochs, one row a source.

    The budget is the smallest that covers every document of every source once: epochs is at least 1
    and at most ``repeat``.  Sources without tokens keep weight 0 and one pass.  One source alone has
    exponent 1.  The bisection works on one row holding an array of the shares (a number for each source).
    """
    row = F.struct(F.col("tokens").cast("double").alias("t"), "source", "tokens", "docs")
    one = sizes.agg(F.sort_array(F.collect_list(row)).alias("rows"))
    one = one.withColumn("t", F.transform(F.filter("rows", lambda r: r["tokens"] > 0), lambda r: r["t"])).withColumn("k", F.size("t"))
    one = one.withColumn("p", F.expr("transform(t, x -> x / aggregate(t, 0D, (a, y) -> a + y))"))
    h = "aggregate(transform({p}, x -> power(x, {a})), struct(0D AS z, 0D AS s), (c, w) -> struct(c.z + w AS z, c.s + w * ln(w) AS s), c -> ln(c.z) - c.s / c.z)"
    # entropy falls and repetition falls as the exponent grows: both limits are monotone
    goal = f"{entropy!r}D * ln(k)"
    bisect = "CASE WHEN k < 2 THEN 1D ELSE aggregate(sequence(1, {n}), struct(0D AS lo, 1D AS hi), (b, i) -> CASE WHEN {test} THEN struct((b.lo + b.hi) / 2 AS lo, b.hi AS hi) ELSE struct(b.lo AS lo, (b.lo + b.hi) / 2 AS hi) END, b -> {end}) END"
    reaches = h.format(p="p", a="(b.lo + b.hi) / 2") + " >= " + goal
    one = one.withColumn("by_entropy", F.expr("CASE WHEN " + h.format(p="p", a="1D") + f" >= {goal} THEN 1D ELSE " + bisect.format(n=HALVINGS, test=reaches, end="b.lo") + " END"))
    # the least repeated source is the largest: (p_small / p_large) ** (a - 1) must not pass the limit
    over = f"k > 0 AND power(p[0] / p[k - 1], (b.lo + b.hi) / 2 - 1) > {repeat!r}D"
    one = one.withColumn("by_repeat", F.expr(bisect.format(n=HALVINGS, test=over, end="b.hi")))
    one = one.select("rows", F.greatest("by_entropy", "by_repeat").alias("exponent"), F.expr("t[k - 1]").alias("most"), F.expr("aggregate(p, 0D, (c, x) -> c + power(x, greatest(by_entropy, by_repeat)))").alias("z"), F.expr("aggregate(t, 0D, (a, y) -> a + y)").alias("all"))
    df = one.select(F.explode("rows").alias("r"), "exponent", "most", "z", "all").select("r.source", "r.tokens", "r.docs", "exponent", "most", "z", "all")
    alive = F.col("tokens") > 0
    return df.select(
        "source", "tokens", "docs", "exponent",
        F.when(alive, F.pow(F.col("tokens") / F.col("all"), F.col("exponent")) / F.col("z")).otherwise(0.0).alias("weight"),
        F.when(alive, F.floor(1e6 * F.pow(F.col("tokens") / F.col("most"), F.col("exponent") - 1) + 0.5) / 1e6).otherwise(1.0).alias("epochs"),
    )


def _sized(docs: DataFrame, text: str, source: str) -> DataFrame:
    return docs.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))).withColumn("__tokens", F.size(word_array(F.col(text))).cast("long"))


def _place(salt: str, epoch: str, ident: str) -> str:
    """A place in [0, 2**31): a hash of the seed, the salt, the pass and the document."""
    return f"CAST(conv(substring(md5(concat_ws(':', '{SEED}', '{salt}', CAST({epoch} AS string), {ident})), 1, 8), 16, 10) div 2 AS long)"


def plan(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", entropy: float = ENTROPY, repeat: float = REPEAT, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each time a document is emitted: ident, source, n_tokens, epoch, block, place, weight, exponent, carry columns.

    ``block`` and ``place`` (from 1) give the order of the output: a block takes about ``block`` tokens, the sources
    in proportion to their weights, in a permutation of its own.  Tokens are words.  A null source is a source of
    its own, null texts have no tokens; a document without tokens comes once, in a block by its hash.  Rows that
    share the identifier and size tie: they begin at the same place of a pass, so all of them or none are within
    its budget.  Every document comes at least once.  An empty table gives an empty plan.
    """
    extra = [f"__e{i}" for i in range(len(carry))]
    rows = written(_sized(docs, text, source).select(F.col(ident).alias("__id"), F.col(source).alias("__name"), "__source", "__tokens", *[F.col(c).alias(x) for c, x in zip(carry, extra, strict=True)]))
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.sum(F.expr("CAST(__tokens = 0 AS long)")).alias("empty"))
    w = weights(sizes, entropy, repeat).join(sizes.select("source", "empty"), "source")
    w = w.withColumn("share", F.greatest(F.lit(1), F.floor(F.col("weight") * block)).cast("long")).withColumn("budget", F.floor(F.col("epochs") * F.col("tokens") + 0.5).cast("long"))
    # as many blocks as the budget fills, or as hold the documents without tokens in groups of BUCKET
    whole = Window.partitionBy(F.lit(0))
    w = written(w.withColumn("blocks", F.greatest(F.max(F.expr("(budget + share - 1) div share")).over(whole), F.ceil(F.sum("empty").over(whole) / BUCKET), F.lit(1)).cast("long")))
    df = rows.join(w.select(F.col("source").alias("__source"), "exponent", "weight", "epochs", "tokens", "docs", "share", "budget", "blocks"), "__source")
    df = df.withColumn("epoch", F.explode(F.expr("sequence(0, CAST(CASE WHEN __tokens = 0 THEN 0 ELSE ceil(epochs) - 1 END AS int))")))
    name = "coalesce(CAST(__id AS string), '')"
    df = df.withColumn("__u", F.expr(_place("pass", "epoch", name)))
    df = df.withColumn("__bucket", F.expr(f"CAST(__u * (1 + docs div {BUCKET}) div 2147483648 AS long)"))
    key = ["__source", "epoch", "__bucket"]
    sums = df.groupBy(*key).agg(F.sum("__tokens").alias("__t"))
    before = sums.withColumn("__before", F.sum("__t").over(Window.partitionBy("__source", "epoch").orderBy("__bucket")) - F.col("__t")).drop("__t")
    df = df.join(before, key)
    # tokens before this row in the permutation of its pass; ties share a place
    inside = Window.partitionBy(*key).orderBy("__u", "__id", "__tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__start", F.col("__before") + F.sum("__tokens").over(inside) - F.col("__tokens"))
    at = F.col("epoch") * F.col("tokens") + F.col("__start")
    df = df.where((F.col("epoch") == 0) | (at < F.col("budget")))
    number = F.when(F.col("__tokens") == 0, F.pmod("__u", "blocks")).otherwise(F.least(F.floor(at / F.col("share")), F.col("blocks") - 1)).cast("long")
    df = df.withColumn("block", number).withColumn("__v", F.expr(_place("block", "epoch", name)))
    order = Window.partitionBy("block").orderBy("__v", "__id", "epoch", "__source", "__tokens", *extra)
    df = df.withColumn("place", F.row_number().over(order).cast("long"))
    return df.select(F.col("__id").alias(ident), F.col("__name").alias(source), F.col("__tokens").alias("n_tokens"), F.col("epoch"), "block", "place", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"), *[F.col(x).alias(c) for c, x in zip(carry, extra, strict=True)])


def mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", entropy: float = ENTROPY, repeat: float = REPEAT, block: int = BLOCK) -> DataFrame:
    """The documents themselves, each as often as the plan emits it and in the plan's order; columns as they came.

    Rows meet the plan by a number of their own, so null and repeated identifiers stay apart.  The order is a
    sort by ranges of (block, place).
    """
    rows = numbered(docs)
    steps: list[str] = []
    with recorded(steps):
        order = written(plan(rows, text, source, ident, entropy, repeat, block, (ROW,)).select(ROW, F.col("block").alias("__block"), F.col("place").alias("__place")))
    swept(order, steps)
    out = rows.join(order, ROW).orderBy("__block", "__place")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
