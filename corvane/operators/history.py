"""Commit history: churn, co-change, digests, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.staging import dealt, release, staged, together

#: Commits of more files say nothing of pairs (fixed value).
PAIR_FILES = 50


def churn(commits: DataFrame, commit_files: DataFrame, since: Column | None = None) -> DataFrame:
    """(path, commits, last): commits that touch a path and the latest of their times."""
    rows = commits if since is None else commits.where(F.col("at") >= since)
    return commit_files.select("commit", "path").distinct().join(rows.select("commit", "at"), "commit").groupBy("path").agg(
        F.count("*").alias("commits"), F.max("at").alias("last")
    )


def newest_commits(commits: DataFrame, limit: int) -> DataFrame:
    """The newest commits by time; equal times go by commit."""
    return commits.orderBy(F.desc("at"), "commit").limit(limit)


def pairs(commits: DataFrame, commit_files: DataFrame, limit: int | None = None, min_weight: int = 2) -> DataFrame:
    """(a, b, weight): how many commits touch both paths, a < b, at least min_weight.

    Paths gather per commit and pairs unfold within the row: a commit has PAIR_FILES paths at most here, as larger ones
    give no pairs, so a commit yields a bounded number of pairs and no join is needed. The gathered paths are written once, so
    the pairs are known in number and dealt PAIRS_EACH a task.
    """
    chosen = commits if limit is None else newest_commits(commits, limit)
    files = commit_files.select("commit", "path").distinct().join(chosen.select("commit"), "commit", "left_semi")
    sized = files.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(2, PAIR_FILES))  # before any path is gathered
    gathered = staged(files.join(sized, "commit", "left_semi").groupBy("commit").agg(F.sort_array(F.collect_list("path")).alias("p")).select("p"))
    many = gathered.agg(F.sum(F.size("p").cast("long") * (F.size("p") - 1)).alias("n")).first()["n"] or 0
    later = lambda a, i: F.transform(F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))
    each = gathered.select(F.explode(F.flatten(F.transform("p", later))).alias("x")).select("x.a", "x.b")
    return dealt(each, many // 2, PAIRS_EACH, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def top_pairs(pair_counts: DataFrame, top: int) -> DataFrame:
    return pair_counts.orderBy(F.desc("weight"), "a", "b").limit(top) if top else pair_counts


def partners(pair_counts: DataFrame, churned: DataFrame, anchors: list) -> DataFrame:
    """(path, weight, confidence): what changes with the anchors, which are left out. Confidence: the best pair's share of an anchor's commits, 1 at most."""
    both = pair_counts.select(F.col("a").alias("anchor"), F.col("b").alias("path"), "weight").unionAll(
        pair_counts.select(F.col("b").alias("anchor"), F.col("a").alias("path"), "weight")
    )
    held = both.where(F.col("anchor").isin(*anchors) & ~F.col("path").isin(*anchors))
    own = churned.where(F.col("path").isin(*anchors)).select(F.col("path").alias("anchor"), "commits")
    return held.join(own, "anchor").groupBy("path").agg(
        F.sum("weight").cast("long").alias("weight"), F.least(F.max(F.col("weight") / F.col("commits")), F.lit(1.0)).alias("confidence")
    )


def graph(pair_counts: DataFrame, churned: DataFrame) -> DataFrame:
    """The ends of surviving pairs with their commits, last time and number of links: (path, commits, last, links)."""
    ends = pair_counts.select(F.explode(F.array("a", "b")).alias("path")).groupBy("path").agg(F.count("*").alias("links"))
    return ends.join(churned, "path").select("path", "commits", "last", "links")


def companions(partner_rows: DataFrame, files: DataFrame, seeds: list, n: int) -> DataFrame:
    """The n best partners that exist as files and are no seeds."""
    known = partner_rows.join(files.select("path"), "path", "left_semi").where(~F.col("path").isin(*seeds))
    return known.orderBy(F.desc("weight"), F.desc("confidence"), "path").limit(n)


def digest(commits: DataFrame, commit_files: DataFrame, since: Column) -> DataFrame:
    """One row of a period: commits, authors, files changed, files added (status A outside root commits) and files deleted (status D).

    commits (commit, at, author, root) and commit_files (commit, path, status).
    """
    period = commits.where(F.col("at") >= since).select("commit", "author", "root")
    heads = period.agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"))
    touched = commit_files.select("commit", "path", "status").join(period.select("commit", "root"), "commit")
    by_path = touched.groupBy("path").agg(F.max((F.col("status") == "A") & ~F.col("root")).alias("a"), F.max(F.col("status") == "D").alias("d"))
    sums = by_path.agg(F.count("*").alias("files"), F.count_if("a").alias("added"), F.count_if("d").alias("deleted"))
    return heads.crossJoin(F.broadcast(sums))  # one row each


def hot_files(commits: DataFrame, commit_files: DataFrame, since: Column, top: int) -> DataFrame:
    period = commits.where(F.col("at") >= since)
    return churn(period, commit_files).select("path", "commits").orderBy(F.desc("commits"), "path").limit(top)


def last_touch(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, commit, at) of the newest commit of each path; of equal times the largest commit."""
    rows = commit_files.select("commit", "path").distinct().join(commits.select("commit", "at"), "commit")
    return rows.groupBy("path").agg(F.max(F.struct("at", "commit")).alias("x")).select("path", "x.commit", "x.at")


def in_period(files: DataFrame, touched: DataFrame, modified: DataFrame, since: Column, until: Column) -> DataFrame:
    """files whose effective time is in [since, until]: the last commit's, or the modified time of files without history."""
    timed = files.join(touched.select("path", "at"), "path", "left").join(modified.select("path", "modified"), "path", "left")
    return timed.where(F.coalesce("at", "modified").between(since, until)).select(*files.columns)


def file_log(versions: DataFrame) -> DataFrame:
    """(path, at, blob) oldest to newest -> rows where the content differs from the one before, absence included."""
    before = F.lag("blob").over(Window.partitionBy("path").orderBy("at", "commit"))
    return versions.withColumn("before", before).where(~F.col("blob").eqNullSafe(F.col("before"))).drop("before")


#: Pairs that a task counts.
PAIRS_EACH = 1_000_000
#: Rows of a history that pointer doubling takes at once; longer histories are shortened first.
WALK_ROWS = 200_000
#: First parents that a path's versions of one window span.
DEPTH_BLOCK = 4096


def _heads_up(commit: str, k: int) -> Column:
    """A coin for each commit, another one in each round."""
    return F.pmod(F.xxhash64(commit, F.lit(k)), F.lit(2)) == 1


def _shortened(now: DataFrame, head: Column, k: int) -> DataFrame:
    """(commit, jump, span) without those commits whose coin is 1 and whose parent's is 0, a quarter: (commit, jump, span, over, step).

    Commits that pointed to one left out point on to its parent; `over` is the one left out, `step` the span up to it. Of two
    neighbours one stays at most, so each commit left out is met by its children in one equi-join.
    """
    gone = _heads_up("commit", k) & (F.col("commit") != head) & (F.col("jump").isNull() | ~_heads_up("jump", k))
    kept, meets = now.where(~gone), F.col("jump").isNotNull() & _heads_up("jump", k)
    none = [F.lit(None).cast(now.schema["commit"].dataType).alias("over"), F.lit(None).cast("long").alias("step")]
    left_out = now.where(gone).select(F.col("commit").alias("jump"), F.col("commit").alias("over"), F.col("jump").alias("next"), F.col("span").alias("further"))
    joined = kept.where(meets).join(left_out, "jump", "left")
    passed = F.col("over").isNotNull()
    moved = joined.select("commit", F.when(passed, F.col("next")).otherwise(F.col("jump")).alias("jump"), (F.col("span") + F.coalesce("further", F.lit(0))).alias("span"), "over", F.when(passed, F.col("span")).alias("step"))
    return kept.where(~meets).select("commit", "jump", "span", *none).unionAll(moved)


def first_parents(commits: DataFrame, head: Column) -> DataFrame:
    """(commit, parents) -> (commit, depth) of the head and its first parents, the head at 0; parents that are not there end the walk.

    Long histories are shortened: each round leaves a quarter of the commits out, so all rounds together shuffle and write a few
    times the history, not its logarithm. Of WALK_ROWS commits pointer doubling finds the depths: in round k every commit points 2^k
    links back, and every commit found points on. Then the rounds are walked back: a commit left out gets its depth from the one that
    passed over it. All steps are equi-joins; no chain goes through one task or the driver. commits has each commit once.
    """
    rounds = [staged(commits.select("commit", F.get("parents", F.lit(0)).alias("jump"), F.lit(1).cast("long").alias("span")))]
    while rounds[-1].count() > WALK_ROWS:
        rounds.append(staged(_shortened(rounds[-1].select("commit", "jump", "span"), head, len(rounds))))
    now = staged(rounds[-1].select("commit", "jump", "span", F.when(F.col("commit") == head, F.lit(0).cast("long")).alias("depth")))
    while not now.where("depth is not null and jump is not null").isEmpty():
        further = now.select(F.col("commit").alias("jump"), F.col("jump").alias("next"), F.col("span").alias("more"))
        found = now.where("depth is not null and jump is not null").select(F.col("jump").alias("commit"), (F.col("depth") + F.col("span")).alias("found"))
        moved = now.join(further, "jump", "left").join(found, "commit", "left")
        before, now = now, staged(moved.select("commit", F.col("next").alias("jump"), (F.col("span") + F.col("more")).alias("span"), F.coalesce("depth", "found").alias("depth")))
        release(before)
    walked = [now.where("depth is not null").select("commit", "depth")]
    if len(rounds) == 1:
        release(rounds[0])
        return walked[0]
    walked = [staged(walked[0])]
    release(now)
    while len(rounds) > 1:
        passed = rounds.pop()
        by = passed.where("over is not null").select(F.col("commit").alias("by"), "over", "step")
        known = together(walked).select(F.col("commit").alias("by"), "depth")
        walked.append(staged(by.join(known, "by").select(F.col("over").alias("commit"), (F.col("depth") + F.col("step")).alias("depth"))))
        release(passed)
    release(rounds[0])
    return together(walked)


def path_log(chain: DataFrame, versions: DataFrame, limit: int) -> DataFrame:
    """(path, rank, commit, depth, truncated): the commits of a first-parent chain at which a path's content is not its parent's.

    chain (commit, depth), versions (commit, path, blob) of the files a commit has, each path once: a path that comes or goes counts.
    Neighbours meet in windows of DEPTH_BLOCK depths of a path; a block's first version goes to the block before it as well, so versions
    are shuffled once and no window holds a whole path. The newest `limit` of each path, and whether there were more.
    """
    depth = F.col("depth")
    block = F.floor(depth / DEPTH_BLOCK)
    edge = (depth > 0) & (depth % DEPTH_BLOCK == 0)
    at = versions.join(chain, "commit").select("path", "depth", "blob", F.explode(F.when(edge, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))
    w = Window.partitionBy("path", "block").orderBy("depth")
    own = F.col("block") == block
    before = F.when(F.lead("depth").over(w) == depth + 1, F.lead("blob").over(w))
    after = F.coalesce(F.lag("depth").over(w) == depth - 1, F.lit(False))
    sides = at.select("path", "depth", "blob", own.alias("own"), (own & edge).alias("first"), before.alias("before"), after.alias("after"))
    changed = F.when(F.col("own") & ~F.col("blob").eqNullSafe(F.col("before")), depth)
    goes = F.when((depth > 0) & ~F.col("first") & ~F.col("after") & F.col("blob").isNotNull(), depth - 1)
    each = sides.select("path", F.explode(F.array_compact(F.array(changed, goes))).alias("depth"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("depth"))
    probe = each.select("path", "depth", rank.alias("rank")).where(F.col("rank") <= limit + 1)
    more = probe.withColumn("truncated", F.max("rank").over(Window.partitionBy("path")) > limit)  # limit + 1 rows of a path at most
    return more.where(F.col("rank") <= limit).join(chain, "depth").select("path", "rank", "commit", "depth", "truncated")


def changed_summary(commit_files: DataFrame) -> DataFrame:
    """(commit, files, additions, deletions) of each commit."""
    return commit_files.groupBy("commit").agg(F.count_distinct("path").alias("files"), F.sum("added").cast("long").alias("additions"), F.sum("deleted").cast("long").alias("deletions"))


def chain_breaks(log: DataFrame) -> DataFrame:
    """(source, n, raw, prev_hash) in order of n -> rows whose prev_hash is not the digest of the line before; the first must have none."""
    before = F.lag("raw").over(Window.partitionBy("source").orderBy("n"))
    good = F.when(before.isNull(), F.col("prev_hash").isNull()).otherwise(F.coalesce(F.col("prev_hash") == F.sha2(before, 256), F.lit(False)))
    return log.withColumn("good", good).where("not good").select("source", "n")
