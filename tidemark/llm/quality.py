"""Quality rules: base statistics of every text, then robust multivariate outliers per language and source.

Everything is DataFrame and SQL functions.  Each text gives a vector of transformed
statistics on an integer grid.  Within each (language, source) group the location and
scatter are those of a minimum-covariance-determinant search: from three starts
(medians and absolute deviations; mean and covariance; medians and the covariance of
signs) concentration steps keep the share ``H`` of rows with the smallest Mahalanobis
distance and recompute mean and covariance, until the determinant falls no more; the
start with the least determinant holds.  Quantiles are exact percentiles of binned
values with their counts, so a group of any size is only ever aggregated, never
gathered, and integer sums make the estimates the same however rows are dealt.  A
variance is never under the square of its floor, so a statistic that is constant in
most of a group does not make every other value an outlier; above that the data decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, word_array, written

#: Vector: logarithm of the mean word length; roots of the shares of symbols, duplicate lines and repeated words; logarithm of
#: the distinct words over that of the words.
DIMS = 5
#: Grid units per unit of each statistic.
GRID = 250
#: Smallest standard deviation of each statistic, and the smallest pivot of a scatter's factor, in grid units.
FLOORS, PIVOT = (8, 10, 25, 25, 8), 1.0
#: Share of rows that a concentration step keeps; no search was seen to take half as many steps as this.
H, STEPS = 0.75, 30
#: A distance d is binned as the whole part of BINS * ln(1 + d): steps of a 4096th, without an end.
BINS = 4096
#: Median of the chi-squared distribution with DIMS degrees of freedom, and the squared distance that rejects.
CHI_MEDIAN, CUTOFF = 4.3515, 50.0
MIN_WORDS, MAX_REPEAT = 20, 30
SYMBOLS = "#*$%&|<>"


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words and fail.  Lines count as duplicates only if they hold a word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__t", t).withColumn("__w", word_array(F.col("__t")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    windows = F.expr("CASE WHEN size(__x) >= 8 THEN transform(sequence(0, size(__x) - 8), i -> xxhash64(__x[i], __x[i+1], __x[i+2], __x[i+3], __x[i+4], __x[i+5], __x[i+6], __x[i+7])) ELSE array() END")
    df = df.withColumn("__x", F.transform("__w", lambda w: F.xxhash64(w))).select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.size(F.array_distinct("__x")).cast("long").alias("__n_distinct"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        windows.alias("__h"),
    )
    # only texts with a repeated window look for where it is
    df = df.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h, (h, i) -> struct(h, i))) END"))
    df = df.withColumn("__p", F.expr("sort_array(transform(filter(transform(__s, (x, k) -> struct(x.i AS i, (k > 0 AND __s[greatest(k - 1, 0)].h = x.h) OR (k < size(__s) - 1 AND __s[least(k + 1, size(__s) - 1)].h = x.h) AS twice)), x -> x.twice), x -> x.i))"))
    df = df.withColumn("n_repeat_words", F.expr("coalesce(aggregate(__p, struct(0L AS n, -8 AS e), (a, i) -> struct(a.n + least(8, i - a.e + 0) AS n, i AS e), a -> a.n), 0L)"))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.select(*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.size("__l").cast("long").alias("__n_lines"), "__n_distinct")


def _vector() -> list[Column]:
    """The statistics on the grid, rounded down; bounded numbers of values whatever the texts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("__n_lines"), F.lit(1)).cast("double")
    return [
        F.floor(GRID * F.log(chars / n)).cast("long"),
        F.floor(GRID * F.sqrt(F.col("n_symbols") / chars)).cast("long"),
        F.floor(GRID * F.sqrt(F.col("n_dup_lines") / lines)).cast("long"),
        F.floor(GRID * F.sqrt(F.col("n_repeat_words") / n)).cast("long"),
        F.floor(GRID * F.log(F.greatest(F.col("__n_distinct"), F.lit(1)).cast("double")) / F.log(F.greatest(n, F.lit(2.0)))).cast("long"),
    ]


XS = [f"x{i}" for i in range(DIMS)]
KEYS = ["__lang", "__source"]
LOWER = [(i, j) for i in range(DIMS) for j in range(i + 1)]
PARAMS = [f"m{i}" for i in range(DIMS)] + [f"c{i}{j}" for i, j in LOWER]


#: The Cholesky factor l** of a scatter, each column after those it uses.
FACTOR = [f"{f'sqrt(greatest({s}, {PIVOT}D))' if i == j else f'({s}) / l{j}{j}'} AS l{i}{j}" for i, j in LOWER for s in [" - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])]]
#: The standardised residuals of a row.
RESIDUALS = [f"({' - '.join([f'x{i} - m{i}', *(f'l{i}{k} * z{k}' for k in range(i))])}) / l{i}{i} AS z{i}" for i in range(DIMS)]


def _factored(params: DataFrame) -> DataFrame:
    """Adds the factor and ldet, the logarithm of the scatter's determinant: once a group, not once a row."""
    logs = " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMS))
    return params.selectExpr("*", *FACTOR, f"{logs} AS ldet")


def _distanced(rows: DataFrame) -> DataFrame:
    """Adds __d2, the squared Mahalanobis distance of x* from m* under the factor l**."""
    squares = " + ".join(f"z{i} * z{i}" for i in range(DIMS))
    return rows.selectExpr("*", *RESIDUALS, f"{squares} AS __d2")


def _scored(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The rows of every group against its parameters: __b is the bin of the distance.  Inner join; params has few rows a group."""
    return _distanced(rows.join(params, KEYS)).withColumn("__b", F.expr(f"CAST(floor({BINS} * log1p(__d2)) AS bigint)"))


def _lifted(value: str, i: int, j: int) -> str:
    return f"greatest({value}, {float(FLOORS[i] ** 2)}D)" if i == j else value


def _aggregated(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.expr(c) for c in columns])


#: Exact integer sums: n, s* and q**; and the mean and scatter that follow from them.
MOMENTS = ["sum(__n) AS n", *[f"sum(x{i} * __n) AS s{i}" for i in range(DIMS)], *[f"sum(x{i} * x{j} * __n) AS q{i}{j}" for i, j in LOWER]]
MEAN = [f"s{i} / n" for i in range(DIMS)]
SCATTER = [_lifted(f"(q{i}{j} / n - (s{i} / n) * (s{j} / n))", i, j) for i, j in LOWER]


def _starts(vectors: DataFrame) -> DataFrame:
    """(KEYS, start, PARAMS): the three starts of every group, each from aggregates over all its rows."""
    first = written(_aggregated(vectors, KEYS, [*[f"percentile({x}, 0.5D, __n) AS med{i}" for i, x in enumerate(XS)], *MOMENTS]))
    centred = vectors.join(first.select(*KEYS, *[f"med{i}" for i in range(DIMS)]), KEYS)
    sign = [f"CAST(signum(x{i} - med{i}) AS bigint)" for i in range(DIMS)]
    spread = _aggregated(centred, KEYS, [*[f"percentile(abs(x{i} - med{i}), 0.5D, __n) AS dev{i}" for i in range(DIMS)], *[f"sum({sign[i]} * {sign[j]} * __n) AS g{i}{j}" for i, j in LOWER]])
    width = [f"greatest(dev{i} * 1.4826D, {float(FLOORS[i])}D)" for i in range(DIMS)]
    med = [f"med{i}" for i in range(DIMS)]
    starts = [
        (med, [f"{width[i]} * {width[i]}" if i == j else "0D" for i, j in LOWER]),
        (MEAN, SCATTER),
        (med, [_lifted(f"g{i}{j} / n * {width[i]} * {width[j]}", i, j) for i, j in LOWER]),
    ]
    each = [f"struct({k} AS start, " + ", ".join(f"{v} AS {name}" for name, v in zip(PARAMS, [*mean, *cov], strict=True)) + ")" for k, (mean, cov) in enumerate(starts)]
    return first.join(spread, KEYS).selectExpr(*KEYS, f"inline(array({', '.join(each)}))")


def robust_fit(vectors: DataFrame) -> DataFrame:
    """Location m*, scatter c**, its factor l**, ldet and scale of each group, from rows (KEYS, x0.., __n) of distinct vectors and their counts."""
    moving, still, tables = written(_factored(_starts(vectors)).withColumn("ldet", F.lit(float("inf")))), [], []
    for _ in range(STEPS):
        binned = _scored(vectors, moving.drop("ldet"))
        edge = _aggregated(binned, [*KEYS, "start"], [f"percentile(__b, {H}D, __n) AS __edge"])
        kept = binned.join(edge, [*KEYS, "start"]).where(F.col("__b") <= F.col("__edge"))
        after = _aggregated(kept, [*KEYS, "start"], MOMENTS).selectExpr(*KEYS, "start", *[f"{v} AS {name}" for name, v in zip(PARAMS, [*MEAN, *SCATTER], strict=True)])
        after = _factored(after).join(moving.select(*KEYS, "start", F.col("ldet").alias("before")), [*KEYS, "start"])
        after = written(after.withColumn("moved", F.col("ldet") < F.col("before") - 1e-9))
        tables.append(after)
        still.append(after.where("NOT moved").drop("moved", "before"))
        moving = after.where("moved").drop("moved", "before")
        if moving.isEmpty():
            break
    else:
        still.append(moving)
    found = still[0]
    for more in still[1:]:
        found = found.unionByName(more)
    names = [*PARAMS, *[f"l{i}{j}" for i, j in LOWER], "ldet"]
    best = written(found.groupBy(*KEYS).agg(F.min_by(F.struct(*names), F.struct("ldet", "start")).alias("p")).select(*KEYS, "p.*"))
    discarded(*tables)
    # consistency: the median distance becomes that of the chi-squared law, and never makes distances larger
    half = _aggregated(_scored(vectors, best), KEYS, ["percentile(__b, 0.5D, __n) AS half"])
    return written(best.join(half.select(*KEYS, F.greatest(F.lit(1.0), F.expm1(F.col("half") / BINS) / CHI_MEDIAN).alias("scale")), KEYS))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: carry columns, base statistics, base_failed, distance (null if base_failed), kept.

    A null language or source is a group of its own.  Documents that fail the base rules take no part in
    the estimates.  Repeated rows count each time.  An empty table gives an empty result.
    """
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(carry)], F.col(text).alias("__text"), F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")).alias("__lang"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("__source"))
    stats = base_statistics(rows, "__text").drop("__text")
    stats = written(stats.withColumns(dict(zip(XS, _vector(), strict=True))))
    good = stats.where(~F.col("base_failed"))
    vectors = written(good.groupBy(*KEYS, *XS).agg(F.count(F.lit(1)).alias("__n")))
    params = robust_fit(vectors)
    scored = _distanced(stats.join(params, KEYS, "left")).withColumn("__d2", F.when(~F.col("base_failed"), F.col("__d2") / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("__d2") <= cutoff, F.lit(True))
    return scored.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(carry)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("__d2", 3).alias("distance"))
