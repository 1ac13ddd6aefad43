"""Chunking, BM25 and coverage of a goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: BM25 constants (fixed values).
K1, B = 1.5, 0.75


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines -> (path, first, last, body): runs of lines that aren't blank."""
    blank = F.trim("text") == ""
    run = F.sum(blank.cast("int")).over(Window.partitionBy("path").orderBy("line_no"))
    return _gather(lines.withColumn("run", run).where(~blank))


def fixed_chunks(lines: DataFrame, size: int = 40) -> DataFrame:
    return _gather(lines.withColumn("run", F.floor((F.col("line_no") - 1) / size)))


def bounded_chunks(lines: DataFrame, boundary: str) -> DataFrame:
    """A chunk begins at each line that matches the boundary, and at the first line."""
    run = F.sum(F.col("text").rlike(boundary).cast("int")).over(Window.partitionBy("path").orderBy("line_no"))
    return _gather(lines.withColumn("run", run))


def _gather(runs: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return runs.groupBy("path", "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), rows.alias("rows")).select(
        "path", "first", "last", F.array_join("rows.text", "\n").alias("body")
    )


def bm25(chunks: DataFrame, goal: list[str]) -> DataFrame:
    """chunks (path, first, last, body) and goal tokens -> with length, hits (map term -> tf) and score; a row for each chunk.

    Goal terms are few and driver values, so term counts are columns of a chunk: nothing is exploded, and the corpus
    statistics are one aggregate to a single row.
    """
    terms = sorted(set(goal))
    tokens = T.echo_tokens(F.col("body"))
    counted = chunks.withColumn("tokens", tokens).select(
        "path", "first", "last", F.size("tokens").alias("length"), *[F.size(F.filter("tokens", _is(t))).alias(f"tf{k}") for k, t in enumerate(terms)]
    )
    stats = counted.agg(
        F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]
    )
    both = counted.crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = F.array(*[F.col(f"tf{k}") for k in range(len(terms))])
    return both.select("path", "first", "last", "length", hits.alias("hits"), score.alias("score"))


def _is(term: str):
    return lambda t: t == term


def coverage(scored: DataFrame, goal: list[str], top: int = 10) -> DataFrame:
    """One row: chunks, chunks with a hit, distinct terms found, coverage (terms found x share of the top scores) and spread (1 - Gini of hits).

    Chunks with equal counts of hits are one row of a histogram that also carries the sums; the rest works on it. The
    top scores are a second pass.
    """
    terms = sorted(set(goal))
    best = scored.select("score", "path", "first").orderBy(F.desc("score"), "path", "first").limit(top).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("best"))
    hits = F.aggregate("hits", F.lit(0), lambda a, x: a + x)
    found = [F.max(F.get("hits", F.lit(k)) > 0).alias(f"t{k}") for k in range(len(terms))]
    bars = scored.select(hits.alias("v"), "score", "hits").groupBy("v").agg(
        F.count("*").alias("m"), F.count_if(F.col("score") > 0).alias("c"), F.sum("score").alias("s"), *found
    )
    hit = F.when(F.col("v") > 0, F.col("m")).otherwise(0)
    to = bars.withColumn("h", hit).withColumn("to", F.sum("h").over(Window.orderBy("v")))  # as many rows as distinct counts
    ranks = (2 * F.col("to") - F.col("h") + 1) * F.col("h") / 2 * F.col("v")
    n_terms = F.lit(0)
    for k in range(len(terms)):
        n_terms = n_terms + F.coalesce(F.max(F.col(f"t{k}").cast("int")), F.lit(0))
    whole = to.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("c"), F.lit(0)).alias("covered"), n_terms.cast("long").alias("terms"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("all"), F.sum(ranks).alias("iv"), F.sum(F.col("h") * F.col("v")).alias("total"), F.sum("h").alias("k"),
    )
    n = F.col("k")
    spread = F.when(n >= 2, 1 - (2 * F.col("iv") / (n * F.col("total")) - (n + 1) / n)).otherwise(0.0)
    share = F.when(F.col("all") > 0, F.col("best") / F.col("all")).otherwise(0.0)
    both = whole.crossJoin(F.broadcast(best))  # one row each
    return both.select("chunks", "covered", "terms", (F.col("terms") / F.lit(max(len(terms), 1)) * share).alias("coverage"), F.greatest(F.least(spread, F.lit(1.0)), F.lit(0.0)).alias("spread"))


def file_blocks(lines: DataFrame) -> DataFrame:
    """Lines of packs -> (path, file, line_no, text): text lines of `### file` blocks; `## ` closes one; fences hide headings and are left out."""
    w = Window.partitionBy("path").orderBy("line_no")
    fence = F.col("text").startswith("```")
    inside = F.sum(fence.cast("int")).over(w) % 2 == 1
    marked = lines.withColumns({"fence": fence, "inside": inside})
    heading = ~F.col("inside") & ~F.col("fence")
    opens = F.when(heading & F.col("text").startswith("### "), F.trim(F.substr("text", F.lit(5)))).when(heading & F.col("text").startswith("## "), "")
    named = marked.withColumns({"opens": opens}).withColumn("file", F.last("opens", ignorenulls=True).over(w))
    return named.where((F.col("file") != "") & F.col("opens").isNull() & ~F.col("fence")).select("path", "file", "line_no", "text")


def gate(covered: DataFrame, threshold: float) -> Column:
    """Exit code of an evaluation: 1 under the threshold."""
    return F.when(covered["coverage"] < threshold, 1).otherwise(0)
