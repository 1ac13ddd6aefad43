"""Change sets: logs of queries, changed files, branches, coverage, tests and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.select import merge_ranges

#: Points of a link between a test and a source (fixed values): name, folder, package, each symbol, and the most for symbols.
NAME, FOLDER, PACKAGE, EACH, MOST = 50, 20, 15, 5, 30


def query_log(found: DataFrame, commits: DataFrame, commit_files: DataFrame, limit: int = 100) -> DataFrame:
    """Commits that touch a found path: (commit, at, matched_paths), newest first, with `truncated`."""
    hits = commit_files.select("commit", "path").distinct().join(found.select("path").distinct(), "path", "left_semi")
    grouped = hits.groupBy("commit").agg(F.sort_array(F.collect_set("path")).alias("matched_paths"))
    rows = grouped.join(commits.select("commit", "at"), "commit")
    top = rows.orderBy(F.desc("at"), "commit").limit(limit + 1)
    seen = top.agg((F.count("*") > limit).alias("truncated"))
    return top.orderBy(F.desc("at"), "commit").limit(limit).crossJoin(F.broadcast(seen))  # one row


def changed_files(numstat: DataFrame, status: DataFrame) -> DataFrame:
    """(path, added, deleted, binary) and (path, status) -> with status; a path without one is modified."""
    return numstat.join(status, "path", "left").withColumn("status", F.coalesce("status", F.lit("M")))


def commit_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, blob) of a commit's first parent and of itself -> (path, change): added, deleted or modified; equal content is none."""
    a, b = before.select("path", F.col("blob").alias("a")), after.select("path", F.col("blob").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def branch_changes(numstat: DataFrame, committed: DataFrame, uncommitted: DataFrame, untracked: DataFrame) -> DataFrame:
    """Four path sets -> (path, added, deleted, state): net changes and untracked files; states joined by `+`."""
    paths = numstat.select("path").union(untracked.select("path")).distinct()
    for name, rows in (("committed", committed), ("uncommitted", uncommitted), ("untracked", untracked)):
        paths = paths.join(rows.select("path").distinct().withColumn(name, F.lit(name)), "path", "left")
    state = F.concat_ws("+", "committed", "uncommitted", "untracked")
    return paths.join(numstat.select("path", "added", "deleted"), "path", "left").select("path", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"), state.alias("state"))


def with_worktree(log: DataFrame, dirty: DataFrame) -> DataFrame:
    """The log with one newest row for the work tree, if it has a changed path: (commit, at)."""
    row = dirty.limit(1).select(F.lit("worktree").alias("commit"), F.current_timestamp().alias("at"))
    return log.select(F.col("commit").cast("string").alias("commit"), F.col("at").cast("timestamp").alias("at")).unionByName(row)


def stdin_paths(text: DataFrame) -> DataFrame:
    """(id, value) lines -> (id, path, ord): paths of `diff --git` lines if there are any, else each line that is no comment; the first of equal ones."""
    lines = text.select("id", F.posexplode(T.split_lines(F.col("value"))).alias("ord", "line"))
    named = lines.withColumn("diff", F.regexp_extract("line", r"^diff --git a/\S+ b/(\S+)", 1))
    any_diff = F.max(F.col("diff") != "").over(Window.partitionBy("id"))
    path = F.when(F.col("is_diff"), F.col("diff")).otherwise(F.trim("line"))
    rows = named.withColumn("is_diff", any_diff).withColumn("path", path).where(~F.col("path").startswith("#") & (F.col("path") != ""))
    return rows.groupBy("id", "path").agg(F.min("ord").alias("ord"))


def match_ranges(results: DataFrame, around: int) -> DataFrame:
    """(path, matches array<struct<line>>) -> merged ranges of `around` lines either side."""
    each = results.select("path", F.explode("matches.line").alias("line"))
    return merge_ranges(each.select("path", F.greatest(F.col("line") - around, F.lit(1)).alias("first"), (F.col("line") + around).alias("last")))


def coverage(profile: DataFrame) -> DataFrame:
    """Cover lines `path:a.b,c.d statements count` (value) -> (path, statements, covered, percent)."""
    pattern = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$"
    part = [F.regexp_extract("value", pattern, k) for k in range(1, 6)]
    rows = profile.where(F.col("value").rlike(pattern)).select(part[0].alias("path"), *[p.cast("long").alias(n) for p, n in zip(part[1:], ("first", "last", "n", "hits"), strict=True)])
    sums = rows.groupBy("path").agg(F.sum("n").alias("statements"), F.sum(F.when(F.col("hits") > 0, F.col("n")).otherwise(0)).alias("covered"))
    return sums.select("path", "statements", "covered", F.when(F.col("statements") > 0, F.col("covered") / F.col("statements") * 100).otherwise(0.0).alias("percent"))


def uncovered(profile: DataFrame) -> DataFrame:
    """Merged ranges of lines without a hit: (path, first, last)."""
    pattern = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ 0$"
    rows = profile.where(F.col("value").rlike(pattern))
    return merge_ranges(rows.select(F.regexp_extract("value", pattern, 1).alias("path"), F.regexp_extract("value", pattern, 2).cast("long").alias("first"), F.regexp_extract("value", pattern, 3).cast("long").alias("last")))


def test_links(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files (path, body, package) and symbols -> (test, source, score): name, folder, package and symbols the test mentions.

    Mentions are words, so tests meet symbols by an equi-join; name and folder meet by the folder.
    """
    tests = files.where(F.col("path").endswith("_test.go")).select(F.col("path").alias("test"), "body", F.regexp_replace("package", "_test$", "").alias("package"), T.dirname(F.col("path")).alias("dir"))
    sources = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(F.col("path").alias("source"), "package", T.dirname(F.col("path")).alias("dir"))
    base = F.regexp_replace("test", r"_test\.go$", ".go")
    same_dir = tests.join(sources.drop("package"), "dir").select("test", "source", (F.lit(FOLDER) + F.when(base == F.col("source"), NAME).otherwise(0)).alias("n"))
    same_package = tests.join(sources.drop("dir"), "package").select("test", "source", F.lit(PACKAGE).alias("n"))
    words = tests.select("test", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    held = symbols.join(sources.select(F.col("source").alias("path")), "path", "left_semi").select(F.col("path").alias("source"), "name").distinct()
    said = words.join(held, "name").groupBy("test", "source").agg(F.least(F.count("*") * EACH, F.lit(MOST)).alias("n"))
    return same_dir.unionAll(same_package).unionAll(said.select("test", "source", "n")).groupBy("test", "source").agg(F.sum("n").cast("long").alias("score"))


def repositories(found: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, score) and (repo) folders -> (repo, score): the nearest folder above that is one, else the top folder; the best score of each."""
    parts = F.split(T.dirname(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("dir"), k.alias("depth")))
    each = found.select("path", "score", F.explode(up).alias("u")).select("path", "score", "u.dir", "u.depth")
    nearest = each.join(repos.select(F.col("repo").alias("dir")), "dir", "left_semi").groupBy("path").agg(F.max_by("dir", "depth").alias("repo"))
    named = found.join(nearest, "path", "left").select(F.coalesce("repo", T.truncate_path(F.col("path"), 1)).alias("repo"), "score")
    return named.groupBy("repo").agg(F.max("score").alias("score"))


def evidence(manifests: DataFrame, current: DataFrame) -> DataFrame:
    """(id, at, path, sha) entries and (path, sha) now -> (path, id, at, fresh), newest manifest first by `rank`."""
    both = manifests.join(current.select("path", F.col("sha").alias("now")), "path")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), "id"))
    return both.select("path", "id", "at", (F.col("sha") == F.col("now")).alias("fresh"), rank.alias("rank"))


def staleness(contract_files: DataFrame, current: DataFrame) -> DataFrame:
    """(path, sha) as packed and now -> (path, state): fresh, stale or missing."""
    now = current.select("path", F.col("sha").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha"), "stale").otherwise("fresh")
    return contract_files.join(now, "path", "left").select("path", state.alias("state"))


def group_specs(specs: DataFrame) -> DataFrame:
    """(ord, path, first, last) -> (path, whole, ord, first, last): a whole file takes in its ranges; the first place of a path stands."""
    whole = specs.groupBy("path").agg(F.bool_or(F.col("first").isNull()).alias("whole"), F.min("ord").alias("ord"))
    ranges = merge_ranges(specs.where("first is not null").select("path", "first", "last"))
    kept = whole.where("not whole").join(ranges, "path").select("path", "whole", "ord", "first", "last")
    none = F.lit(None).cast("long")
    return whole.where("whole").select("path", "whole", "ord", none.alias("first"), none.alias("last")).unionByName(kept)


def append_companions(selection: DataFrame, companions: DataFrame) -> DataFrame:
    """(path, score) selections, then companions that are not in them, by `part`."""
    extra = companions.select("path", F.lit(0).cast("long").alias("score")).join(selection.select("path"), "path", "left_anti")
    return selection.select("path", "score", F.lit(0).alias("part")).unionAll(extra.select("path", "score", F.lit(1).alias("part")))


def tier_order(tier: Column) -> Column:
    return F.when(tier == "High", 0).when(tier == "Medium", 1).otherwise(2)


def violations(verified: DataFrame) -> DataFrame:
    """Verified references -> (verdict, references) of those that are not ok, and 1 as exit code if there are any."""
    bad = verified.where("verdict <> 'ok'").groupBy("verdict").agg(F.count("*").alias("references"))
    return bad.withColumn("exit_code", F.lit(1))
