"""Quality rules: fixed base rules, then robust multivariate outliers by language and source; Spark expressions only.

Statistics of each whole text are turned into vectors of four: log of the mean word length, and the square roots of the
shares of symbols in the word characters, of duplicate lines in the lines, and of repeated words in the words. All are
taken with PRIOR_WORDS words of PRIOR_LENGTH and shares of PRIOR_SHARE, so that one event in a short text is no outlier.

Per (lang, source) a minimum-covariance-determinant estimate is made. From three deterministic starts (median and MAD; the
same with the correlations of the hyperbolic tangents of the scores; and with the covariance of their directions)
concentration steps take the half of the vectors nearest to the last estimate and compute their mean and covariance, until
no start of any group lowers its determinant; each step that lowers one lowers it for good, so this ends (after STEPS of them it
is an error). The start with the least determinant stays (the first of equal
ones); its covariance is scaled for consistency. A document is rejected when its squared Mahalanobis distance is over CUTOFF.
FLOOR is the same in all dimensions and is added to the standard deviations: it keeps the determinant positive where half of the
vectors agree, which discrete statistics do, and says what difference matters then.

Halves and medians are exact up to a grid: distances and scores are cut to steps of a fixed fineness, and all rows of the
step that the middle row lies in are taken, so the same rows are in the half however Spark orders them. Groups are only
ever aggregated by partial sums and counts by step; their estimates are joined back by key, so no group is gathered in one task.

Null or empty texts have zero statistics and fail the base rule. Null languages or sources are groups of their own.
Repeated rows are judged each. Groups of like texts, or of one text, reject only what differs by more than FLOOR allows.
Columns other than doc_id, text, lang and source are not looked at. Without documents the result is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm import text_stats
from fathom.llm.storage import save

PRIOR_WORDS, PRIOR_LENGTH, PRIOR_LINES, PRIOR_SHARE = 50.0, 5.0, 20.0, 0.01
DIMENSIONS = ("x0", "x1", "x2", "x3")
FLOOR = 0.05
#: Starts of a group, and steps after which an estimate that still falls is an error.
STARTS, STEPS = 3, 100
#: The 0.999 quantile of chi-square with four degrees of freedom; and the consistency factor of the half: a half by the
#: share of chi-square with six degrees that lies below the median of that with four.
CUTOFF, CONSISTENCY = 18.47, 0.5 / 0.2370
#: Steps of the grid: of vectors; and of logarithms of distances.
FINE, FINE_LOG = 0.001, 0.002


def statistics(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, source and the base statistics; other columns are dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", "lang", "source", text.alias("t"), text_stats.words(text).alias("w"))
    two = one.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        text_stats.duplicate_lines(F.col("t")).cast("long").alias("n_dup_lines"),
        F.size(F.split("t", "\n", -1)).alias("n_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept = [c for c in two.columns if c != "h"]
    three = two.select(*kept, text_stats.window_hashes(F.col("h"), 5).alias("windows"))
    return three.select(*kept, text_stats.covered_by_repeats(F.col("windows"), 5).cast("long").alias("n_repeat_words"))


def vectors(stats: DataFrame) -> DataFrame:
    share = lambda a, b, prior: F.sqrt((F.least(F.col(a), F.col(b)) + PRIOR_SHARE * prior) / (F.col(b) + prior))
    return stats.withColumns(
        {
            "x0": F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS)),
            "x1": share("n_symbols", "word_chars", PRIOR_WORDS * PRIOR_LENGTH),
            "x2": share("n_dup_lines", "n_lines", PRIOR_LINES),
            "x3": share("n_repeat_words", "n_words", PRIOR_WORDS),
        }
    )


N = range(len(DIMENSIONS))
PAIRS = [(i, j) for i in N for j in range(i + 1)]


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def factored(rows: DataFrame) -> DataFrame:
    """Covariances c00, c10, c11, .. of each row to k00, k10, k11, .., the inverse of their Cholesky factor, and the log of their determinant."""
    kept = [c for c in rows.columns if not c.startswith("c")]
    for j in N:
        for i in N[j:]:
            rest = F.col(f"c{i}{j}") - total([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)])
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in N:
        for i in N[j:]:
            inner = F.lit(1.0) if i == j else -total([F.col(f"l{i}{k}") * F.col(f"k{k}{j}") for k in range(j, i)])
            rows = rows.withColumn(f"k{i}{j}", inner / F.col(f"l{i}{i}"))
    return rows.select(*kept, *(f"k{i}{j}" for i, j in PAIRS), (2 * total([F.log(f"l{i}{i}") for i in N])).alias("det"))


def squared_distance(estimate) -> Column:
    """Squared Mahalanobis distance of a row's vector by an estimate; `estimate` gives the column of a name."""
    y = [total([estimate(f"k{i}{j}") * (F.col(f"x{j}") - estimate(f"m{j}")) for j in range(i + 1)]) for i in N]
    return total([F.pow(v, 2) for v in y])


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by the estimate of the row's group g."""
    return rows.join(estimates.select("g", *(f"m{i}" for i in N), *(f"k{i}{j}" for i, j in PAIRS)), "g", "left").select(*rows.columns, squared_distance(F.col).alias("d2"))


def middles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, at): the least step `at` up to which at least half of the rows (*keys, step) lie."""
    counts = rows.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("step")
    sums = counts.select(*keys, "step", F.sum("n").over(upto).alias("below"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return sums.filter("2 * below >= all").groupBy(*keys).agg(F.min("step").alias("at"))


def medians(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(g, *columns): medians of the columns by group, on the grid."""
    steps = F.array(*(F.struct(F.lit(name).alias("name"), F.round(c / FINE).cast("long").alias("step")) for name, c in columns.items()))
    found = middles(rows.select("g", F.explode(steps).alias("s")).select("g", "s.*"), ["g", "name"])
    return found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("at") * FINE)).alias(name) for name in columns))


def moments(weight: Column, values: list[Column], name: str) -> list[Column]:
    """Aggregates of the weighted rows: their number, sums and sums of products."""
    sums = [F.sum(weight * v).alias(f"{name}a{i}") for i, v in enumerate(values)]
    return [F.sum(weight).alias(f"{name}n"), *sums, *(F.sum(weight * values[i] * values[j]).alias(f"{name}b{i}{j}") for i, j in PAIRS)]


def floored(c: Column, i: int, j: int) -> Column:
    """A covariance, with FLOOR added to the standard deviation of a variance."""
    return F.pow(F.sqrt(F.greatest(c, F.lit(0.0))) + FLOOR, 2) if i == j else c


def starting(rows: DataFrame) -> DataFrame:
    """(g, start, m0, .., c00, ..): the starts of each group."""
    centre = save(medians(rows, {f"m{i}": F.col(f"x{i}") for i in N}), "mcd")
    spread = medians(rows.join(centre, "g"), {f"s{i}": F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in N})
    scale = save(centre.join(spread, "g").select("g", *(f"m{i}" for i in N), *((1.4826 * F.col(f"s{i}") + FLOOR).alias(f"s{i}") for i in N)), "mcd")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in N]
    far = F.sqrt(total([F.pow(v, 2) for v in z]))
    flat = [F.tanh(v) for v in z]
    direction = [F.when(far > 0, v / far).otherwise(0.0) for v in z]
    sums = rows.join(scale, "g").groupBy("g").agg(*moments(F.lit(1.0), flat, "t"), *moments(F.lit(1.0), direction, "d"))
    both = scale.join(save(sums, "mcd"), "g")
    cov = lambda k, i, j: F.col(f"{k}b{i}{j}") / F.col(f"{k}n") - F.col(f"{k}a{i}") * F.col(f"{k}a{j}") / F.pow(f"{k}n", 2)
    corr = lambda i, j: cov("t", i, j) / F.sqrt((cov("t", i, i) + 1e-9) * (cov("t", j, j) + 1e-9))
    s = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    kinds = [
        lambda i, j: s(i, j) if i == j else F.lit(0.0),
        lambda i, j: s(i, j) if i == j else s(i, j) * corr(i, j),
        lambda i, j: s(i, j) * (len(N) * F.col(f"db{i}{j}") / F.col("dn") + (0.05 if i == j else 0.0)),
    ]
    made = [F.struct(F.lit(k).alias("start"), *(F.col(f"m{i}").alias(f"m{i}") for i in N), *(kind(i, j).cast("double").alias(f"c{i}{j}") for i, j in PAIRS)) for k, kind in enumerate(kinds)]
    return both.select("g", F.explode(F.array(*made)).alias("e")).select("g", "e.*")


def concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """(g, start, m0, .., c00, ..) of the half of each group that is nearest by each of its estimates."""
    names = [*(f"m{i}" for i in N), *(f"k{i}{j}" for i, j in PAIRS)]
    by_group = save(now.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", *names))).alias("e")), "mcd")
    step = lambda k: F.round(F.log(squared_distance(lambda name: F.get("e", F.lit(k))[name]) + 1e-6) / FINE_LOG).cast("long")
    # both passes compute the distances anew, which is cheaper than to write them
    near = rows.join(by_group, "g").select("g", *DIMENSIONS, F.array(*(step(k) for k in range(STARTS))).alias("steps"))
    half = middles(near.select("g", F.posexplode("steps").alias("start", "step")), ["g", "start"])
    half = save(half.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("start", "at"))).alias("half")), "mcd")
    inside = lambda k: F.when(F.get("steps", F.lit(k)) <= F.col("half")[k], 1.0).otherwise(0.0)
    values = [F.col(x) for x in DIMENSIONS]
    sums = near.join(half, "g").groupBy("g").agg(*(m for k in range(STARTS) for m in moments(inside(k), values, f"e{k}")))

    def estimate(k: int) -> Column:
        n, mean = F.col(f"e{k}n"), [F.col(f"e{k}a{i}") / F.col(f"e{k}n") for i in N]
        cov = [floored((F.col(f"e{k}b{i}{j}") / n - mean[i] * mean[j]) * CONSISTENCY, i, j).alias(f"c{i}{j}") for i, j in PAIRS]
        return F.struct(F.lit(k).alias("start"), *(mean[i].alias(f"m{i}") for i in N), *cov)

    return sums.select("g", F.explode(F.array(*(estimate(k) for k in range(STARTS)))).alias("e")).select("g", "e.*")


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The estimate of each group g from rows with g and the vector: g, m0, .., k00, .., det, the least of its starts'."""
    best = None
    now = save(factored(save(starting(rows), "mcd")), "mcd")
    for _ in range(steps):
        now = save(factored(save(concentrated(rows, now), "mcd")), "mcd")
        if best is None:
            best = now
            continue
        both = now.join(best.select("g", "start", F.col("det").alias("before")), ["g", "start"])
        lower = both.filter(F.col("det") < F.col("before") - 1e-6).select("g", "start").limit(1).count()
        named = [F.col(c) for c in best.columns if c not in ("g", "start")]
        union = best.select("g", "start", *named).unionByName(now)
        best = save(union.groupBy("g", "start").agg(F.min_by(F.struct(*named), "det").alias("e")).select("g", "start", "e.*"), "mcd")
        if not lower:
            break
    else:
        raise RuntimeError(f"an estimate has not converged in {steps} steps")
    first = best.groupBy("g").agg(F.min_by(F.struct(*(c for c in best.columns if c not in ("g", "start"))), F.struct(F.round("det", 9), "start")).alias("e"))
    return save(first.select("g", "e.*"), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, d2 and kept, for every row."""
    rows = vectors(save(statistics(docs), "quality-stats")).withColumn("g", F.xxhash64(F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = with_distance(rows, estimates(rows)).withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).alias("kept"), "d2"
    )
