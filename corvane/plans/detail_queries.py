"""Smaller operators: reasons, anchors, path checks, groups of extensions, pages of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import contract, filters, relevance, render, scan, search
from corvane.operators import select as X
from corvane.plans.base import COMMITS, FILES, SYMBOLS, commit_files, commits, files, lines, query, symbols, table
from corvane.plans.link_queries import DIFF, j12
from corvane.plans.search_queries import SEARCH_TERMS, STEM
from corvane.plans.search_queries import DIR as LOW_DIR

DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
_FIRST = "case " + " ".join(f"when contains(lower(text), '{t}') then '{t}'" for t in SEARCH_TERMS) + " end"


def _list(tests: list[str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when {t} then '{w}' end" for t, w in zip(tests, SEARCH_TERMS, strict=True)) + ")"


@query("p25_reasons", f"""with {SYMBOLS}, said as (select path, w, min(line_no) as n from (select path, line_no, {_FIRST} as w from lines) where w is not null group by path, w),
content as (select path, string_agg(w, ', ' order by n, w) as content from said group by path),
held as (select path, name, min(line) as n from symbols where {" or ".join(f"contains(lower(name), '{t}')" for t in SEARCH_TERMS)} group by path, name),
named as (select path, string_agg(name, ', ' order by n, name) as symbol from held group by path),
own as (select path, {_list([f"contains({STEM}, '{t}')" for t in SEARCH_TERMS])} as base, {_list([f"contains({LOW_DIR}, '{t}')" for t in SEARCH_TERMS])} as dir from files),
r as (select path, concat_ws('; ', case when symbol <> '' then 'symbol match: ' || symbol end, case when content <> '' then 'content match: ' || content end, case when base <> '' then 'basename match: ' || base end, case when dir <> '' then 'path match: ' || dir end) as reason
  from own left join content using (path) left join named using (path)) select path, reason from r where reason <> ''""")
def p25(spark, sf_dir):
    return search.reasons(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), "the doc tion src1")


@query("j23_anchor", f"""with {FILES} select 'basename' as kind, min(path) as path, cast(1 as bigint) as candidates from files where ends_with(path, '/doc_5.md')""")
def j23(spark, sf_dir):
    return search.anchor(files(spark, sf_dir), symbols(spark, sf_dir), "doc_5.md")


@query("j23_anchor_ambiguous", f"with {SYMBOLS} select 'ambiguous' as kind, cast(null as varchar) as path, count(*) as candidates from symbols where name = 'The'")
def j23a(spark, sf_dir):
    return search.anchor(files(spark, sf_dir), symbols(spark, sf_dir), "The")


@query("s12_parse_results", f"""with {FILES} select path as id, path, case when tokens >= 20 then 0 else 1 end as ord from files where tokens % 3 = 0 union all
select path, 'b.py', case when tokens >= 20 then 1 else 0 end from files where tokens % 3 = 0 union all
select path, 'x/' || path, 0 from files where tokens % 3 = 1 union all select path, 'z.md', 2 from files where tokens % 3 = 1""")
def s12(spark, sf_dir):
    path, t = F.col("path"), F.col("tokens")
    as_json = F.concat(F.lit('[{"path":"./'), path, F.lit('","score":'), t, F.lit('},{"path":"b.py","score":20},{"path":"'), path, F.lit('","score":1}]'))
    as_lines = F.concat(F.lit("x/./"), path, F.lit("\n# note\n\nx/"), path, F.lit("\nz.md"))
    value = F.when(t % 3 == 0, as_json).when(t % 3 == 1, as_lines).otherwise("null")
    return search.parse_results(files(spark, sf_dir).select(path.alias("id"), value.alias("value")))


@query("f21_relative_paths", """select page_id, case page_id % 5 when 0 then 'a/b' when 1 then null when 2 then null when 3 then 'x/y.py' else null end as path from pages""")
def f21(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, [" ./a//b ", "/abs", "C:\\x", "x\\y.py", "a/../b"])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.relative_path(raw).alias("path"))


@query("f12_packable", """select page_id, page_id % 3 <> 2 as packable, page_id % 3 = 1 as generated from pages""")
def f12(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ["src/a.RS", "web/dist/x.js", "a.png"])), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", relevance.is_packable(path).alias("packable"), relevance.is_generated(path).alias("generated"))


@query("f5_allowlist_globs", f"with {FILES} select path from files where regexp_matches(path, '^src[0-4]/en/[^/]*$') or contains('/' || path, '/en/') or starts_with(path, 'src3/') or regexp_matches(path, '^src7/[^/]*/doc_[0-9]7\\.md$')")
def f5(spark, sf_dir):
    path = F.col("path")
    globs = ("src[0-4]/en/**", "en/**", "src3/**", "src7/*/doc_?7.md")  # the second fits below any folder
    return files(spark, sf_dir).where(reduce(lambda a, b: a | b, [path.rlike(scan.glob_regex(g)) for g in globs])).select("path")


@query("f19_secret_paths", "select page_id, page_id % 4 < 3 as secret from pages")
def f19(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ["a/.env", "k/x.pem", "u/.ssh/config", "src/env.py"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", filters.is_secret_path(path).alias("secret"))


@query("k18_role_priority", f"with {FILES} select path, 2 as priority from files")
def k18(spark, sf_dir):
    return files(spark, sf_dir).select("path", relevance.role_order(T.role(F.col("path"))).alias("priority"))


@query("p36_numbers", f"with {FILES} select path, format('{{:,}}', size) as size, case when tokens % 2 = 0 then '+' || tokens else '-' || tokens end as delta from files")
def p36(spark, sf_dir):
    t = F.col("tokens")
    return files(spark, sf_dir).select("path", render.numbered(F.col("size")).alias("size"), render.signed(F.when(t % 2 == 0, t).otherwise(-t)).alias("delta"))


@query("p41_strip_comments", "select page_id, 'x' || page_id || ' y ' || chr(10) || 'z' || chr(10) as code from pages")
def p41(spark, sf_dir):
    source = F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit("/* a\n b */ y // one // two\nz\n// three"))
    return table(spark, sf_dir, "pages").select("page_id", T.strip_comments(source).alias("code"))


@query("t8_sorted_changes", f"with {DIFF} select path, kind, token_delta from d where kind <> 'unchanged' order by abs(token_delta) desc, path limit 40")
def t8(spark, sf_dir):
    return j12(spark, sf_dir).where("kind <> 'unchanged'").orderBy(F.desc(F.abs("token_delta")), "path").limit(40)


@query("a11_changes_by_kind", f"with {DIFF} select kind, string_agg(path, ',' order by path) as paths from d where kind <> 'unchanged' group by kind")
def a11(spark, sf_dir):
    rows = j12(spark, sf_dir).where("kind <> 'unchanged'").groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("p"))
    return rows.select("kind", F.array_join("p", ",").alias("paths"))


@query("a15_distinct_lists", f"with {SYMBOLS} select split_part(path, '/', 2) as lang, count(distinct name) as names, min(name) as first, max(name) as last from symbols group by 1")
def a15(spark, sf_dir):
    return symbols(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("lang")).agg(F.count_distinct("name").alias("names"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("w14_rank_numbers", f"with {FILES} select row_number() over (partition by {DIR} order by tokens desc, path) as rank, path from files")
def w14(spark, sf_dir):
    from pyspark.sql import Window

    return files(spark, sf_dir).select(F.row_number().over(Window.partitionBy(T.dirname(F.col("path"))).orderBy(F.desc("tokens"), "path")).alias("rank"), "path")


@query("v5_prune", "select event_id as id from events where event_id % 10 = 0 or ts >= timestamp '2024-01-15' or ts is null")
def v5(spark, sf_dir):
    at = F.when(F.col("event_id") % 10 == 0, "some day").otherwise(F.col("ts").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), at.alias("created_at"))
    return contract.prune(rows, F.lit("2024-01-15").cast("timestamp")).select("id")


@query("v6_manifest_build", f"with {FILES} select path, sha256(body) as sha, tokens from files")
def v6(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.sha2("body", 256).alias("sha"), "tokens")


@query("u3_path_union", f"with {COMMITS} select path from commit_files where added > 100 union select p_partkey from part where p_size > 45")
def u3(spark, sf_dir):
    changed = commit_files(spark, sf_dir).where("added > 100").select("path")
    return changed.union(table(spark, sf_dir, "part").where("p_size > 45").select("p_partkey")).distinct()


@query("t9_author_log", f"with {COMMITS} select \"commit\", author from commits order by \"at\" desc, \"commit\" limit 500")
def t9(spark, sf_dir):
    return commits(spark, sf_dir).orderBy(F.desc("at"), "commit").limit(500).select("commit", "author")


@query("r2_mentions", f"""with {FILES} select path as id, path as mention, tokens as first, tokens + 4 as last from files union all
select path, 'c' || (tokens % 9) || '.md', null, null from files union all select path, 'x.go', 12, 12 from files""")
def r2(spark, sf_dir):
    t = F.col("tokens")
    text = F.concat(F.lit("fix "), "path", F.lit(":"), t, F.lit("-"), t + 4, F.lit(" and ./c"), t % 9, F.lit(".md, at x.go#L12, twice x.go#L12"))
    return X.mentions(files(spark, sf_dir).select(F.col("path").alias("id"), text.alias("text")))
