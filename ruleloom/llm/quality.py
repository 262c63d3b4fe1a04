"""Quality rules: robust multivariate outliers within each language and source.

Texts become statistics by SQL functions alone. For each group of documents of one language and
source, the minimum covariance determinant estimate of location and scatter is searched from several
deterministic starts: medians with the spreads between quartiles, with the scatter of spatial signs,
and with the scatter of hyperbolic tangents. A concentration step takes the closest SUBSET share of
the group, and its mean and covariance as the next estimate. After FIRST_STEPS from every start the
one of the lowest determinant goes on until its determinant falls no more. With a subset of one half,
junk may be almost half of a group. A document is rejected if its Mahalanobis distance from that
estimate, made consistent for the normal distribution, is beyond CUTOFF. Groups of under LEAST
documents are pooled within their language, and pools of under LEAST over the whole table; a table of
fewer is judged by itself, with a covariance widened for its size.

Quantiles come from counts of narrow bins, so every step is one grouped sum of bounded size,
whatever a group holds; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: ASCII white space in a regular expression inside an SQL literal.
SPACE = r"\\x20\\x09-\\x0D"
LEAST = 60
SUBSET = 0.5
#: Concentration steps from every start, before the best of them goes on.
FIRST_STEPS = 2
#: Steps end when no group's log-determinant falls by more.
SETTLED = 0.01
#: A bound against rounding that lets determinants fall for ever; reaching it is an error.
MOST_STEPS = 200
#: A covariance from n documents is widened by SMALL / n of itself.
SMALL = 12
#: Squared distance beyond which a document is rejected; far in the tail of chi-squared with 6
#: degrees of freedom (1e-15), as ratios in texts have longer tails than the normal distribution.
CUTOFF = 83.0

#: Transformed statistics, and the least standard deviation that each is taken to have.
FEATURES = {"f_length": 0.06, "f_symbols": 0.03, "f_upper": 0.035, "f_marks": 0.03, "f_lines": 0.07, "f_repeats": 0.07}
NAMES = list(FEATURES)
#: Consistency of a covariance of the closest half with 6 dimensions: 0.5 / P(chi2_8 <= q), q the median of chi2_6.
CONSISTENCY = 1.7844


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks of ``text``."""
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    lines = f"filter(split(_t, '\n', -1), l -> l rlike '[^{SPACE}]')"
    # names in lambdas bind a value once: let(x, body) = transform(array(x), v -> body)[0]
    windows = (
        "transform(sequence(0, size(_w) - 5),"
        " i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4)))"
    )
    places = (
        "array_sort(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))"
    )
    covered = (
        f"aggregate({places}, named_struct('last', -100, 'n', 0L),"
        " (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)), a -> a.n)"
    )
    repeats = (
        f"transform(array({windows}), v -> if(size(array_distinct(v)) = size(v), 0L,"
        f" transform(array(array_sort(transform(v, (h, i) -> named_struct('h', h, 'i', i)))), s -> {covered})[0]))[0]"
    )
    d = d.withColumn("_w", F.expr(f"filter(split(_t, '[{SPACE}]+', -1), w -> w != '')"))
    return d.select(
        *keep,
        F.expr("cast(size(_w) as long)").alias("n_words"),
        F.expr("cast(length(array_join(_w, '')) as long)").alias("word_chars"),
        F.expr("cast(size(split(_t, '[#*$%&|<>]', -1)) - 1 as long)").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> named_struct('n', size(l), 'd', size(l) - size(array_distinct(l))))[0]").alias("_l"),
        F.expr(f"if(size(_w) < 5, 0L, {repeats})").alias("n_repeat_words"),
        F.expr(r"cast(size(split(_t, '\\p{Lu}', -1)) - 1 as long)").alias("n_upper"),
        F.expr(rf"cast(size(split(_t, '[^\\p{{L}}\\p{{N}}{SPACE}#*$%&|<>]', -1)) - 1 as long)").alias("n_marks"),
    ).select(
        *keep, "n_words", "word_chars", "n_symbols", F.col("_l.d").cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.col("_l.n").cast("long").alias("n_lines"), "n_upper", "n_marks",
    )


def features(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the features: square roots of shares, and the logarithm of the mean word length.

    Shares are taken of a size with a constant added, so that a few words show no extremes.
    """

    def share(count: str, size: str, extra: float) -> Column:
        return F.sqrt(F.col(count) / (F.col(size) + F.lit(extra)))

    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "f_length": F.log((F.col("word_chars") + F.lit(150.0)) / (F.col("n_words") + F.lit(30.0))),
            "f_symbols": share("n_symbols", "word_chars", 150.0),
            "f_upper": share("n_upper", "word_chars", 150.0),
            "f_marks": share("n_marks", "word_chars", 150.0),
            "f_lines": share("n_dup_lines", "n_lines", 5.0),
            "f_repeats": share("n_repeat_words", "n_words", 30.0),
        }
    )


def grouped(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Adds ``g``, the group whose estimate judges the row."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    rows = rows.withColumn("_lang", lang).withColumn("_source", source)
    sizes = rows.groupBy("_lang", "_source").agg(F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("n"))
    by_lang = Window.partitionBy("_lang", F.col("n") >= LEAST)
    pooled = F.when(F.col("n") >= LEAST, F.concat(F.lit("s|"), "_lang", F.lit("|"), "_source")).when(
        F.sum("n").over(by_lang) >= LEAST, F.concat(F.lit("l|"), "_lang")
    ).otherwise(F.lit("all"))
    names = written(spark, sizes.select("_lang", "_source", pooled.alias("g")), "quality-groups")
    return rows.join(names, ["_lang", "_source"]).drop("_lang", "_source")


def _quantile_bin(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, bin): the lowest bin up to which at least ``share`` of a group's count lies."""
    w = Window.partitionBy(*by)
    return (
        counts.withColumn("up", F.sum("n").over(w.orderBy("bin")))
        .withColumn("all", F.sum("n").over(w))
        .filter(F.col("up") >= share * F.col("all"))
        .groupBy(*by)
        .agg(F.min("bin").alias("bin"))
    )


WIDTH = 0.004


def medians(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(g, m, s): medians of the features, and spreads between quartiles."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(c) / WIDTH).alias("bin")) for k, c in enumerate(NAMES)]))
    counts = rows.select("g", pairs.alias("x")).groupBy("g", "x.k", "x.bin").agg(F.count("*").alias("n"))
    counts = written(spark, counts, "quality-bins")
    q = [_quantile_bin(counts, ["g", "k"], s).withColumnRenamed("bin", f"q{i}") for i, s in enumerate((0.25, 0.5, 0.75))]
    both = q[0].join(q[1], ["g", "k"]).join(q[2], ["g", "k"])
    floor = F.element_at(F.array(*[F.lit(x) for x in FEATURES.values()]), F.col("k") + 1)
    spread = F.greatest((F.col("q2") - F.col("q0")) * WIDTH / 1.349, floor)
    one = both.select("g", "k", ((F.col("q1") + 0.5) * WIDTH).alias("m"), spread.alias("s"))
    gathered = one.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("a"))
    return written(spark, gathered.select("g", F.col("a.m").alias("m"), F.col("a.s").alias("s")), "quality-medians")


def starts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(g, k, mean, w): estimates to start from; k is 0 for quartiles, 1 for spatial signs, 2 for tangents."""
    p = len(NAMES)
    middle = medians(spark, rows)
    z = rows.join(middle, "g").select("g", *[((F.col(c) - F.col("m")[i]) / F.col("s")[i]).alias(f"z{i}") for i, c in enumerate(NAMES)])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")))
    views = [
        [F.col(f"z{i}") / F.greatest(size, F.lit(1e-9)) for i in range(p)],
        [F.tanh(F.col(f"z{i}")) for i in range(p)],
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[x.alias(f"y{i}") for i, x in enumerate(v)]) for k, v in enumerate(views, 1)]))
    each = z.select("g", each.alias("v")).select("g", "v.*")
    scatter = each.groupBy("g", "k").agg(
        F.count("*").alias("n"), *[F.avg(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"y{i}{j}") for i in range(p) for j in range(i + 1)]
    )
    # correlations of the views with the spreads between quartiles, as moments about the medians
    shape = scatter.join(middle, "g")
    scale = lambda i, j: F.sqrt(F.greatest(F.col(f"y{i}{i}") * F.col(f"y{j}{j}"), F.lit(1e-12)))
    found = shape.select(
        "g", "k", "n", *[F.col("m")[i].alias(f"m{i}") for i in range(p)],
        *[
            (F.col("m")[i] * F.col("m")[j] + F.col("s")[i] * F.col("s")[j] * (F.lit(1.0) if i == j else F.col(f"y{i}{j}") / scale(i, j))).alias(f"c{i}{j}")
            for i in range(p)
            for j in range(i + 1)
        ],
    )
    diagonal = F.array(*[F.array(*[1 / F.col("s")[i] if i == j else F.lit(0.0) for j in range(i + 1)]) for i in range(p)])
    plain = middle.select("g", F.lit(0).alias("k"), F.col("m").alias("mean"), diagonal.alias("w"))
    return written(spark, plain.unionByName(whiten(found)), "quality-starts")


def distances(estimates: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Adds k and ``distance``, the squared length of w (x - mean), for each estimate of the row's group."""
    total = None
    for i in range(len(NAMES)):
        z = None
        for j in range(i + 1):
            term = F.col("w")[i][j] * (F.col(NAMES[j]) - F.col("mean")[j])
            z = term if z is None else z + term
        total = z * z if total is None else total + z * z
    # estimates are a row for each group and start: sent to all tasks where their size allows, else shuffled
    return rows.join(estimates, "g", how).withColumn("distance", F.round(total, 6)).drop("mean", "w")


def step(spark: SparkSession, estimates: DataFrame, rows: DataFrame) -> DataFrame:
    """A concentration step: the estimates from the closest SUBSET of each group, for each start."""
    near = distances(estimates, rows).withColumn("bin", F.floor(F.log(F.col("distance") + 1e-6) * 50))
    counts = written(spark, near.groupBy("g", "k", "bin").agg(F.count("*").alias("n")), "quality-distances")
    limit = _quantile_bin(counts, ["g", "k"], SUBSET).withColumnRenamed("bin", "most")
    inside = near.join(limit, ["g", "k"]).filter("bin <= most")
    p = len(NAMES)
    sums = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(NAMES)]
    sums += [F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    moments = written(spark, inside.groupBy("g", "k").agg(*sums), "quality-moments")
    return written(spark, whiten(moments), "quality-estimates")


def log_determinant() -> Column:
    """Of the covariance whose inverse is w'w."""
    return -2 * sum((F.log(F.col("w")[i][i]) for i in range(1, len(NAMES))), F.log(F.col("w")[0][0]))


def settle(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(g, mean, w): the estimate of the lowest determinant that concentration steps come to."""
    estimates = starts(spark, rows)
    for _ in range(FIRST_STEPS):
        estimates = step(spark, estimates, rows)
    ranked = estimates.withColumn("spread", F.round(log_determinant(), 6))
    best = ranked.groupBy("g").agg(F.min_by(F.struct("k", "mean", "w"), F.struct("spread", "k")).alias("e"))
    estimates = written(spark, best.select("g", "e.*"), "quality-best")
    for _ in range(MOST_STEPS):
        after = step(spark, estimates, rows)
        both = estimates.select("g", log_determinant().alias("old")).join(after.select("g", "k", "mean", "w", log_determinant().alias("new")), "g")
        # a group whose determinant falls no more keeps the estimate that it has
        kept = both.join(estimates.select("g", F.struct("k", "mean", "w").alias("former")), "g").select(
            "g", F.when(F.col("new") < F.col("old"), F.struct("k", "mean", "w")).otherwise(F.col("former")).alias("e"), (F.col("old") - F.col("new")).alias("fall")
        )
        kept = written(spark, kept, "quality-kept")
        estimates = kept.select("g", "e.*")
        if (kept.agg(F.max("fall")).first()[0] or 0.0) <= SETTLED:
            return estimates.drop("k")
    raise RuntimeError(f"determinants still fall after {MOST_STEPS} steps")


def whiten(moments: DataFrame) -> DataFrame:
    """(g, k, mean, w) with w'w the inverse covariance: Cholesky factor and its inverse, a column for each entry."""
    p = len(NAMES)
    floors = list(FEATURES.values())
    d = moments
    entries = {}
    for i in range(p):
        for j in range(i + 1):
            c = (CONSISTENCY + SMALL / F.col("n")) * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
            entries[f"s{i}{j}"] = c + F.lit(floors[i] ** 2) if i == j else c
    d = d.withColumns(entries)
    for j in range(p):
        inner = F.col(f"s{j}{j}")
        for k in range(j):
            inner = inner - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        d = d.withColumn(f"l{j}{j}", F.sqrt(F.greatest(inner, F.lit(floors[j] ** 2 / 4))))
        column = {}
        for i in range(j + 1, p):
            inner = F.col(f"s{i}{j}")
            for k in range(j):
                inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            column[f"l{i}{j}"] = inner / F.col(f"l{j}{j}")
        d = d.withColumns(column) if column else d
    for i in range(p):
        row = {f"v{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            inner = None
            for k in range(j, i):
                term = F.col(f"l{i}{k}") * F.col(f"v{k}{j}")
                inner = term if inner is None else inner + term
            row[f"v{i}{j}"] = -inner / F.col(f"l{i}{i}")
        d = d.withColumns(row)
    return d.select(
        "g",
        "k",
        F.array(*[F.col(f"m{i}") for i in range(p)]).alias("mean"),
        F.array(*[F.array(*[F.col(f"v{i}{j}") for j in range(i + 1)]) for i in range(p)]).alias("w"),
    )


def verdicts(spark: SparkSession, docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row of docs.

    Null and empty texts have zeros and fail the base rule. A null language or source is a value of
    its own. Documents that fail the base rule are in no estimate; without any other, distance is null.
    """
    columns = set(docs.columns)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        *[F.col(c).cast("string").alias(c) if c in columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")],
    )
    rows = written(spark, features(statistics(own, ["doc_id", "lang", "source"])), "quality-stats")
    rows = grouped(spark, rows)
    judged = written(spark, rows, "quality-rows")
    estimates = settle(spark, judged.filter("not base_failed"))
    return distances(estimates, judged, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
        "distance",
    )
