"""History over orders and lineitem as commits and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import history
from corvane.plans.base import COMMITS, commit_files, commits, query, table
from corvane.sources import tables as S

SINCE = "1997-01-01"
ANCHORS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
ANCHOR_SQL = ", ".join(map(str, ANCHORS))
PAIRS = f"""{COMMITS},
sized as (select "commit", path, count(*) over (partition by "commit") as n from commit_files),
pairs as (select x.path as a, y.path as b, count(*) as weight from sized x join sized y on x."commit" = y."commit" and x.path < y.path where x.n <= 50 group by all having count(*) >= 1),
churned as (select path, count(*) as commits, max("at") as last from commit_files join commits using ("commit") group by path)"""


def _since():
    return F.lit(SINCE).cast("timestamp")


@query("a4_file_churn", f"""with {COMMITS} select path, count(*) as commits, max("at") as last from commit_files join commits using ("commit") where "at" >= timestamp '{SINCE}' group by path""")
def a4(spark, sf_dir):
    return history.churn(commits(spark, sf_dir), commit_files(spark, sf_dir), _since())


@query("j1_cochange_pairs", f"""with {PAIRS} select a, b, weight from pairs""")
def j1(spark, sf_dir):
    return history.pairs(commits(spark, sf_dir), commit_files(spark, sf_dir), min_weight=1)


@query("t5_top_pairs", f"""with {PAIRS} select a, b, weight from pairs order by weight desc, a, b limit 50""")
def t5(spark, sf_dir):
    return history.top_pairs(j1(spark, sf_dir), 50)


@query("j1_newest_commits", f"""with {COMMITS}, top as (select "commit" from commits order by "at" desc, "commit" limit 500),
f as (select "commit", path from commit_files join top using ("commit"))
select x.path as a, y.path as b, count(*) as weight from f x join f y on x."commit" = y."commit" and x.path < y.path group by all""")
def j1_limited(spark, sf_dir):
    return history.pairs(commits(spark, sf_dir), commit_files(spark, sf_dir), limit=500, min_weight=1)


PARTNERS = f"""{PAIRS},
sides as (select a as anchor, b as path, weight from pairs union all select b, a, weight from pairs),
partners as (select x.path, cast(sum(weight) as bigint) as weight, least(max(weight / commits), 1.0) as confidence from sides x join churned c on c.path = anchor
  where anchor in ({ANCHOR_SQL}) and x.path not in ({ANCHOR_SQL}) group by x.path)"""


@query("j2_cochange_partners", f"""with {PARTNERS} select path, weight, round(confidence, 9) as confidence from partners""")
def j2(spark, sf_dir):
    churned = history.churn(commits(spark, sf_dir), commit_files(spark, sf_dir))
    return history.partners(j1(spark, sf_dir), churned, ANCHORS).withColumn("confidence", F.round("confidence", 9))


@query("j3_companions", f"""with {PARTNERS} select path, weight, round(confidence, 9) as confidence from partners where path % 2 = 0 order by weight desc, confidence desc, path limit 10""")
def j3(spark, sf_dir):
    present = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")).where("path % 2 = 0")
    churned = history.churn(commits(spark, sf_dir), commit_files(spark, sf_dir))
    known = history.partners(j1(spark, sf_dir), churned, ANCHORS)
    return history.companions(known, present, ANCHORS, 10).withColumn("confidence", F.round("confidence", 9))


@query("j28_cochange_graph", f"""with {PAIRS}, ends as (select path, count(*) as links from (select a as path from pairs union all select b from pairs) group by path)
select path, commits, last, links from ends join churned using (path)""")
def j28(spark, sf_dir):
    return history.graph(j1(spark, sf_dir), history.churn(commits(spark, sf_dir), commit_files(spark, sf_dir)))


@query("a6_digest", f"""with {COMMITS}, p as (select * from commits where "at" >= timestamp '{SINCE}')
select (select count(*) from p) as commits, (select count(distinct author) from p) as authors, count(distinct path) as files,
  count(distinct path) filter (where status = 'A' and not root) as added, count(distinct path) filter (where status = 'D') as deleted from commit_files join p using ("commit")""")
def a6(spark, sf_dir):
    return history.digest(commits(spark, sf_dir), commit_files(spark, sf_dir), _since())


@query("t6_hot_files", f"""with {COMMITS} select path, count(*) as commits from commit_files join commits using ("commit") where "at" >= timestamp '{SINCE}' group by path order by commits desc, path limit 50""")
def t6(spark, sf_dir):
    return history.hot_files(commits(spark, sf_dir), commit_files(spark, sf_dir), _since(), 50)


@query("w16_last_commit", f"""with {COMMITS} select path, max("at") as "at", arg_max("commit", ("at", "commit")) as "commit" from commit_files join commits using ("commit") group by path""")
def w16(spark, sf_dir):
    return history.last_touch(commits(spark, sf_dir), commit_files(spark, sf_dir))


@query("f13_time_filter", f"""with {COMMITS}, touched as (select path, max("at") as "at" from commit_files join commits using ("commit") group by path)
select p_partkey as path from part left join touched on path = p_partkey where coalesce("at", timestamp '1999-06-01') between timestamp '1998-01-01' and timestamp '2000-01-01'""")
def f13(spark, sf_dir):
    present = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    modified = present.withColumn("modified", F.lit("1999-06-01").cast("timestamp"))
    touched = history.last_touch(commits(spark, sf_dir), commit_files(spark, sf_dir))
    return history.in_period(present, touched, modified, F.lit("1998-01-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"))


@query("s7_newest_log", f"""with {COMMITS} select "commit", "at", author, root, (select count(*) from commits) > 100 as truncated from commits order by "at" desc, "commit" limit 100 """)
def s7(spark, sf_dir):
    return S.newest(commits(spark, sf_dir), 100)


@query("a13_changed_summary", f"""with {COMMITS} select "commit", count(distinct path) as files, cast(sum(added) as bigint) as additions, cast(sum(deleted) as bigint) as deletions from commit_files group by "commit" """)
def a13(spark, sf_dir):
    return history.changed_summary(commit_files(spark, sf_dir))


@query("w17_file_log", """with v as (select user_id as path, event_id as "commit", ts as "at", event_type as blob from events),
b as (select *, lag(blob) over (partition by path order by "at", "commit") as before from v)
select path, "commit", "at", blob from b where blob is distinct from before""")
def w17(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("commit"), F.col("ts").alias("at"), F.col("event_type").alias("blob"))
    return history.file_log(rows)


# Orders as commits, parted in branches: keys that five divides stand on a side branch, and the next one merges it. An order
# has three files, whose content is its own; those of pending orders have none.
MAIN = """main as (select *, row_number() over (order by o_orderkey desc) - 1 as depth from orders where o_orderkey % 5 <> 0),
v as (select o_orderkey, depth, unnest(['status', 'priority', 'day']) as path,
  case when o_orderstatus = 'P' then null else unnest([o_orderstatus, o_orderpriority, cast(date_trunc('month', o_orderdate) as varchar)]) end as blob from main),
changed as (select *, row_number() over (partition by path order by depth) as r, count(*) over (partition by path) as n from
  (select *, lead(blob) over (partition by path order by depth) as before from v) where blob is distinct from before)"""


@query("w17_first_parent_log", f"with {MAIN} select path, r as rank, o_orderkey as \"commit\", depth, n > 500 as truncated from changed where r <= 500")
def w17_walk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    before = F.when((key - 1) % 5 == 0, key - 2).otherwise(key - 1)
    parents = F.when((key % 5 == 1) & (key > 1), F.array(before, key - 1)).when(key > 1, F.array(before)).otherwise(F.array().cast("array<bigint>"))
    walked = orders.select(key.alias("commit"), parents.alias("parents"))
    head = walked.where("commit % 5 <> 0").agg(F.max("commit")).first()[0]
    files = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("day"), F.trunc("o_orderdate", "month").cast("string"))
    versions = orders.where("o_orderstatus <> 'P'").select(key.alias("commit"), F.explode(files).alias("path", "blob"))
    return history.path_log(history.first_parents(walked, F.lit(head)), versions, 500)


CHAIN = "(event_id || ':' || event_type || ':' || coalesce(props, ''))"


@query("w2_hash_chain", f"""with l as (select user_id as source, event_id as n, {CHAIN} as raw from events),
h as (select *, sha256(lag(raw) over (partition by source order by n)) as right_hash from l),
c as (select *, case when n % 17 = 0 then 'broken' else right_hash end as prev_hash from h)
select source, n from c where prev_hash is distinct from right_hash""")
def w2(spark, sf_dir):
    from pyspark.sql import Window

    raw = F.concat_ws(":", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("n"), raw.alias("raw"))
    before = F.lag("raw").over(Window.partitionBy("source").orderBy("n"))
    log = rows.withColumn("prev_hash", F.when(F.col("n") % 17 == 0, "broken").otherwise(F.sha2(before, 256)))
    return history.chain_breaks(log)
