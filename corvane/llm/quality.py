"""Quality rules: base statistics of a text, and robust multivariate outliers by minimum covariance determinants.

All of it is DataFrame expressions. Statistics are one row-local projection; the estimates run over the narrow
table of statistics, with a partial aggregation for each step, never over texts.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import fresh, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a pool's rows that the determinant is taken over: junk below half of a pool cannot enter the estimate.
SUPPORT = 0.5
#: Concentration steps of a start end when the logarithm of the determinant falls by no more than this.
SETTLED = 1e-3
#: Rows at which a pool's own estimate weighs as much as that of the pool above it.
PRIOR_ROWS = 40
#: Squared robust distance beyond which a text is rejected: between the labelled good texts of the sf0.1 documents, 81 at
#: most, and the labelled bad ones, 118 at least. These statistics have heavier tails than a normal, so no quantile of one.
CUTOFF = 95.0
#: Medians of chi-square with 4 degrees of freedom (fixed value): makes distances consistent at the normal.
CHI2_MEDIAN = 3.3567
#: Smallest spread of each transformed statistic that counts: differences below a few of these are never outliers.
FLOORS = (0.06, 0.2, 0.32, 0.13)
#: Of approximate quantiles: ranks are off by a 2,000th at most.
ACCURACY = 2_000
#: Files of a table with a row for each pool: few, so that Spark sees its true size and broadcasts it if it is small,
#: and rows are not shuffled by pool, where one pool may hold a third of them.
FEW = 4
NAMES = ("x1", "x2", "x3", "x4")
PAIRS = [(i, j) for j, i in combinations_with_replacement(range(4), 2)]  # i >= j
MEANS = [f"m{k}" for k in range(4)]
COVARIANCES = [f"c_{i}_{j}" for i, j in PAIRS]
WEIGHTS = [f"w_{i}_{j}" for i, j in PAIRS]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) -> those but text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    A null text has no words. Only these input columns are read, so others may have any name.
    """
    text = F.coalesce("text", F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = docs.select("doc_id", "lang", "source", text.alias("text"), F.array_remove(F.split(spaced, " "), "").alias("words"))
    sized = words.select("*", F.size("words").alias("n"))
    three = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = sized.select("*", F.when(F.col("n") > 2, F.slice(three, 1, F.greatest(F.col("n") - 2, F.lit(1)))).alias("h"), lines.alias("lines"))
    # Windows in order of hash; one with the hash of a neighbour occurs twice or more. Distinct positions they cover.
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    marked = hashed.select("*", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).alias("s"))
    twice = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    return marked.select(
        "doc_id", "lang", "source",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def transformed() -> list[Column]:
    """Mean word length, symbols and repeats as logarithms: near normal, and defined for any text."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(chars / words),
        F.log1p(F.lit(100.0) * F.col("n_symbols") / chars),
        F.log1p(F.lit(20.0) * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.log1p(F.lit(5.0) * F.col("n_repeat_words") / words),
    ]


def _root(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Cholesky factor of a 4 x 4 covariance, entry by entry."""
    root: dict[tuple[int, int], Column] = {}
    for i, j in sorted(PAIRS):
        rest = cov[i, j]
        for k in range(j):
            rest = rest - root[i, k] * root[j, k]
        root[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / root[j, j]
    return root


def _inverse(root: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Inverse of a 4 x 4 lower triangular matrix."""
    inverse: dict[tuple[int, int], Column] = {}
    for j in range(4):
        inverse[j, j] = 1.0 / root[j, j]
        for i in range(j + 1, 4):
            total = root[i, j] * inverse[j, j]
            for k in range(j + 1, i):
                total = total + root[i, k] * inverse[k, j]
            inverse[i, j] = -total / root[i, i]
    return inverse


def _distance() -> Column:
    """Squared Mahalanobis distance of x1..x4 from m0..m3 under the joined inverse root w_i_j."""
    total = F.lit(0.0)
    for i in range(4):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m{j}"))
        total = total + z * z
    return total


def _measures(moments: DataFrame, *keys: str) -> DataFrame:
    """(keys, m0.., c_0_0..) -> with the inverse root of the covariance and the logarithm of its determinant.

    Roots are columns before inverses are built on them, so that expressions stay short.
    """
    root = _root({(i, j): F.col(f"c_{i}_{j}") for i, j in PAIRS})
    rooted = moments.select(*keys, *MEANS, *COVARIANCES, *[root[p].alias(f"r_{p[0]}_{p[1]}") for p in PAIRS])
    inverse = _inverse({(i, j): F.col(f"r_{i}_{j}") for i, j in PAIRS})
    size = sum((F.log(f"r_{k}_{k}") for k in range(4)), F.lit(0.0)) * 2.0
    return rooted.select(*keys, *MEANS, *COVARIANCES, *[inverse[p].alias(f"w_{p[0]}_{p[1]}") for p in PAIRS], size.alias("size"))


def _floored(covariance: Column, i: int, j: int) -> Column:
    return covariance + FLOORS[i] ** 2 if i == j else covariance


def _starts(points: DataFrame) -> DataFrame:
    """(pool, x1..x4) -> (pool, start, m0.., c_0_0..): three deterministic starts of each pool, all around its medians.

    0: the median deviations alone; 1: covariance of hyperbolic tangents of standardised rows; 2: covariance of their
    signs, that is of rows scaled to length one.
    """
    centre = points.groupBy("pool").agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(m) for m, x in zip(MEANS, NAMES, strict=True)])
    centre = materialize(centre.coalesce(FEW), "centre")
    away = [F.abs(F.col(x) - F.col(m)) for m, x in zip(MEANS, NAMES, strict=True)]
    spread = points.join(centre, "pool").groupBy("pool").agg(*[F.percentile_approx(d, 0.5, ACCURACY).alias(f"a{k}") for k, d in enumerate(away)])
    wide = [F.sqrt((F.col(f"a{k}") * 1.4826) ** 2 + FLOORS[k] ** 2).alias(f"s{k}") for k in range(4)]
    both = materialize(centre.join(spread, "pool").select("pool", *MEANS, *wide).coalesce(FEW), "spread")
    z = points.join(both, "pool").select("pool", *[((F.col(x) - F.col(f"m{k}")) / F.col(f"s{k}")).alias(f"z{k}") for k, x in enumerate(NAMES)])
    length = F.sqrt(F.greatest(sum((F.col(f"z{k}") ** 2 for k in range(4)), F.lit(0.0)), F.lit(1e-12)))
    z = z.select("pool", *[F.tanh(f"z{k}").alias(f"t{k}") for k in range(4)], *[(F.col(f"z{k}") / length).alias(f"u{k}") for k in range(4)])
    shapes = z.groupBy("pool").agg(*[F.covar_pop(f"{v}{i}", f"{v}{j}").alias(f"{v}_{i}_{j}") for v in "tu" for i, j in PAIRS])
    known = both.join(shapes, "pool")
    rows = None
    for start in range(3):
        made = []
        for i, j in PAIRS:
            shape = [F.lit(float(i == j)), F.col(f"t_{i}_{j}"), F.col(f"u_{i}_{j}") * 4.0][start]
            made.append(_floored(F.col(f"s{i}") * F.col(f"s{j}") * shape, i, j).alias(f"c_{i}_{j}"))
        part = known.select("pool", F.lit(start).alias("start"), *MEANS, *made)
        rows = part if rows is None else rows.unionAll(part)
    return rows


def estimates(points: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(pool, x1..x4) -> (pool, n, m0..m3, c_0_0..): each pool's minimum-covariance-determinant mean and covariance, and its rows.

    From each start, concentration steps: keep the `support` share of smallest distances, take mean and covariance
    over it (partial aggregates), measure anew; a start that no longer shrinks the determinant is done. The smallest
    determinant of a pool's starts wins. FLOORS are added to every covariance, so a statistic without spread rejects
    nothing by itself, and covariances are scaled so that distances have at least the median they have at the normal.
    Tables with a row for each pool and start are written as few files; Spark broadcasts them if they are small, and else
    joins by pool and splits skewed pools. Only whether any start goes on comes to the driver.
    """
    now = materialize(_measures(_starts(points), "pool", "start").withColumn("before", F.lit(None).cast("double")).coalesce(FEW), "estimate")
    done = None
    while True:
        goes_on = F.col("before").isNull() | (F.col("before") - F.col("size") > SETTLED)
        settled = now.where(~goes_on).drop("before")
        done = settled if done is None else done.unionByName(settled)
        now = now.where(goes_on)
        if not now.limit(1).count():
            break
        measured = points.join(now.select("pool", "start", "size", *MEANS, *WEIGHTS), "pool").select("pool", "start", "size", *NAMES, _distance().alias("d2"))
        cut = measured.groupBy("pool", "start").agg(F.percentile_approx("d2", support, ACCURACY).alias("cut"))
        near = measured.join(materialize(cut.coalesce(FEW), "cut"), ["pool", "start"]).where("d2 <= cut")
        moments = near.groupBy("pool", "start", F.col("size").alias("before")).agg(
            *[F.avg(x).alias(m) for m, x in zip(MEANS, NAMES, strict=True)],
            *[_floored(F.covar_pop(NAMES[i], NAMES[j]), i, j).alias(f"c_{i}_{j}") for i, j in PAIRS],
        )
        now = materialize(_measures(moments, "pool", "start", "before").coalesce(FEW), "estimate")
    best = done.groupBy("pool").agg(F.min_by(F.struct(*MEANS, *COVARIANCES, *WEIGHTS), F.struct("size", "start")).alias("e")).select("pool", "e.*")
    best = materialize(best.coalesce(FEW), "best")
    scale = points.join(best, "pool").groupBy("pool").agg(F.percentile_approx(_distance(), 0.5, ACCURACY).alias("d2"), F.count("*").alias("n"))
    scale = scale.select("pool", "n", F.greatest(F.col("d2") / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    whole = best.join(scale, "pool").select("pool", "n", *MEANS, *[(F.col(c) * F.col("scale")).alias(c) for c in COVARIANCES])
    return materialize(whole.coalesce(FEW), "pools")


def _blend(own: DataFrame, above: DataFrame, prior_rows: int) -> DataFrame:
    """own (up, pool, n, m.., c..) moved towards the estimate of the pool above: by n / (n + prior_rows), without a threshold."""
    weight = F.col("n") / (F.col("n") + F.lit(prior_rows))
    upper = above.select(F.col("pool").alias("up"), *[F.col(c).alias(f"up_{c}") for c in (*MEANS, *COVARIANCES)])
    mixed = [(weight * F.col(c) + (1.0 - weight) * F.col(f"up_{c}")).alias(c) for c in (*MEANS, *COVARIANCES)]
    return own.join(upper, "up").select("pool", "n", *mixed)


def robust_distances(points: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, x1..x4, ...) -> with d2, the squared distance from the estimate of the row's language and source.

    Nulls are values of their own. A (language, source) pool's estimate is blended with its language's, and that with the
    one of all rows, by the pool's rows against `prior_rows`: a pool of few rows leans on the wider one, at any size
    in the same way.
    """
    pool, up = fresh(points, "pool", "up")
    as_text = {"ignoreNullFields": "false"}
    marked = points.withColumns({pool: F.to_json(F.struct("lang", "source"), as_text), up: F.to_json(F.struct("lang"), as_text)})
    found = estimates(marked.select(F.explode(F.array(F.lit("*"), up, pool)).alias("pool"), *NAMES))
    names = marked.select(F.col(pool).alias("pool"), F.col(up).alias("up")).distinct()
    languages = names.select(F.col("up").alias("pool"), F.lit("*").alias("up")).distinct()
    tongues = _blend(found.join(languages, "pool"), found.where("pool = '*'"), prior_rows)
    own = _blend(found.join(names, "pool"), tongues, prior_rows)
    known = materialize(_measures(own, "pool").select(F.col("pool").alias(pool), *MEANS, *WEIGHTS).coalesce(FEW), "known")
    return marked.join(known, pool).withColumn("d2", _distance()).drop(pool, up, *MEANS, *WEIGHTS)


def judge(docs: DataFrame, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(doc_id, text, lang, source) -> the statistics, base_failed, d2 and kept, a row for each input row.

    base_failed: fewer than 50 words, or over half of them in repeated windows; so a null or empty text fails. Estimates
    are over the texts that pass that. A text that passes is kept unless its distance exceeds the cutoff; a pool of equal
    rows rejects none. Repeated rows count as often as they come; null languages and sources are values of their own;
    other columns are not read, so they may have any name; an empty table gives no row.
    """
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    stats = materialize(statistics(docs).withColumn("base_failed", failed).withColumns(dict(zip(NAMES, transformed(), strict=True))), "statistics")
    measured = robust_distances(stats.where("not base_failed"), prior_rows).drop(*NAMES).withColumn("kept", F.col("d2") <= cutoff)
    rest = stats.where("base_failed").drop(*NAMES).withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return measured.unionByName(rest)
