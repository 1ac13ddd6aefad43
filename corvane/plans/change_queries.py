"""Renderers, change sets, coverage, tests and evidence bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import changes, graph, relevance, render, search
from corvane.operators import select as X
from corvane.plans.base import COMMITS, FILES, LINES, SYMBOLS, commit_files, commits, files, lines, query, symbols, table
from corvane.plans.link_queries import DIFF, VERDICTS, manifests, v2
from corvane.plans.search_queries import BUDGET, GOAL, RELEVANT, SCORED, SEARCH, k6
from corvane.plans.text_queries import METRICS, a1

DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query("s17_pack_markdown", f"with {FILES} select path, sha256('### ' || path || chr(10) || chr(10) || '```markdown' || chr(10) || case when body = '' or ends_with(body, chr(10)) then body else body || chr(10) end || '```' || chr(10)) as sha from files")
def s17(spark, sf_dir):
    return render.pack_rows(files(spark, sf_dir)).select("path", F.sha2("text", 256).alias("sha"))


@query("s17_pack_xml", f"""with {FILES} select path, sha256('<file path="' || path || '" tokens="' || tokens || '">' || replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</file>' || chr(10)) as sha from files""")
def s17x(spark, sf_dir):
    return render.pack_rows(files(spark, sf_dir), "xml").select("path", F.sha2("text", 256).alias("sha"))


@query("s17_omitted", f"with {FILES} select path, '- ' || path || ' (too large, ' || format('{{:,}}', tokens) || ' of {BUDGET} tokens)' as line from files where tokens > 500 order by tokens desc, path limit 50")
def s17o(spark, sf_dir):
    return render.omitted(files(spark, sf_dir).where("tokens > 500").withColumn("reason", F.lit("too large")), BUDGET)


@query("s19_vimgrep", f"""with {LINES} select path, line_no, path || ':' || line_no || ':' || (strlen(substr(lower(text), 1, strpos(lower(text), 'ing') - 1)) + 1) || ':' || trim(text, ' ') as text from lines where contains(lower(text), 'ing')""")
def s19(spark, sf_dir):
    return render.vimgrep(search.matches(lines(spark, sf_dir), "ing"))


@query("s18_heat_plain", f"with {METRICS} select dir, dir || chr(9) || tokens as text from bucketed where tokens > 0")
def s18(spark, sf_dir):
    return render.heat_rows(a1(spark, sf_dir))


@query("s18_heat_bars", f"with {METRICS} select dir, rpad(dir, 24, ' ') || repeat('#', greatest(cast(floor(tokens / (select max(tokens) from bucketed) * 40 + 0.5) as int), 1)) as text from bucketed where tokens > 0")
def s18b(spark, sf_dir):
    return render.heat_rows(a1(spark, sf_dir), "ascii")


@query("s21_digest_markdown", f"""with {COMMITS}, d as (select (select count(*) from commits) as c, (select count(distinct author) from commits) as a, count(distinct path) as f, count(distinct path) filter (where status = 'A' and not root) as p, count(distinct path) filter (where status = 'D') as m from commit_files join commits using ("commit"))
select '# Digest' || chr(10) || chr(10) || '- commits: ' || c || chr(10) || '- authors: ' || a || chr(10) || '- files: ' || f || chr(10) || '- added: ' || p || chr(10) || '- deleted: ' || m || chr(10) as text from d""")
def s21(spark, sf_dir):
    from corvane.operators import history

    return render.digest_markdown(history.digest(commits(spark, sf_dir), commit_files(spark, sf_dir), F.lit("1900-01-01").cast("timestamp")))


@query("p13_metric_units", f"with {FILES} select path, format('{{:,}}', tokens) || ' tokens' as tokens, format('{{:,}}', tokens * 4) || ' chars' as chars from files")
def p13(spark, sf_dir):
    return files(spark, sf_dir).select("path", render.metric(F.col("tokens"), "tokens").alias("tokens"), render.metric(F.col("tokens"), "chars").alias("chars"))


@query("p43_skim_tiers", f"""with {SYMBOLS}, l as (select path, string_agg(path || ':' || line || ' ' || kind || ' ' || name || chr(10), '' order by line) as list from symbols group by path),
s as (select f.path, tokens as whole, greatest(strlen(coalesce(list, '(no public symbols)' || chr(10))) // 4, 1) as short, greatest(strlen(coalesce(list, '(no symbols)' || chr(10))) // 4, 1) as out from files f left join l using (path))
select path, case when whole <= 100 then 'full' when short <= 100 then 'api+doc' else 'outline' end as tier, case when whole <= 100 then whole when short <= 100 then short else out end as tokens from s""")
def p43(spark, sf_dir):
    return render.skim(files(spark, sf_dir), symbols(spark, sf_dir), 100)


CODE = """code as (select 'f' || page_id || case page_id % 3 when 0 then '.py' when 1 then '.go' else '.ts' end as path, 'import os' || chr(10) || 'def run' || page_id || '(' || chr(10) || '    a,' || chr(10) || '):' || chr(10) || '    pass' || chr(10) || 'class Thing' || page_id || ':' || chr(10) || '    pass' as body from pages)"""
#: Declarations of four languages, and lines that look like some but are none: the same in both engines, with what is found.
DECLARED = (
    ("a.go", "  func (r *Reader) Read(p []byte)", "Read", "function"), ("a.go", "func  main()", "main", "function"), ("a.go", "\ttype  Point struct {", "Point", "type"), ("a.go", "functional()", None, None), ("a.go", "var x = func(a int) {}", None, None),
    ("b.rs", "pub fn open<T>()", "open", "function"), ("b.rs", "    trait Shape {", "Shape", "interface"), ("b.rs", "pub enum Kind", "Kind", "type"), ("b.rs", "async fn later()", None, None), ("b.rs", "pub(crate) struct Hidden", None, None),
    ("c.ts", "export default class App {", "App", "class"), ("c.ts", "export interface Props {", "Props", "interface"), ("c.cjs", "const add = (a, b) => a + b", "add", "function"), ("c.ts", "export const LIMIT = 3", None, None),
    ("c.ts", "type Id = string", None, None), ("c.tsx", "  function view() {", "view", "function"), ("d.py", "    def run(self):", "run", "function"), ("d.py", "class Thing:", "Thing", "class"), ("d.py", "async def later():", None, None), ("e.txt", "def no():", None, None),
)


def code(spark, sf_dir):
    i = F.col("page_id").cast("string")
    path = F.concat(F.lit("f"), i, F.element_at(F.array(F.lit(".py"), F.lit(".go"), F.lit(".ts")), (F.col("page_id") % 3 + 1).cast("int")))
    body = F.concat(F.lit("import os\ndef run"), i, F.lit("(\n    a,\n):\n    pass\nclass Thing"), i, F.lit(":\n    pass"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), body.alias("body"))


@query("p32_line_symbols", f"""with {CODE} select path, 'run' || regexp_extract(path, '\\d+') as name, 'function' as kind, 2 as line from code where ends_with(path, '.py')
union all select path, 'Thing' || regexp_extract(path, '\\d+'), 'class', 6 from code where ends_with(path, '.py') or ends_with(path, '.ts')
union all select * from (values {", ".join(f"('{p}', '{n}', '{k}', {i})" for i, (p, _, n, k) in enumerate(DECLARED, 1) if n)}) v(path, name, kind, line)""")
def p32(spark, sf_dir):
    from corvane.sources import tables as S

    rows = [(p, i, t) for i, (p, t, _, _) in enumerate(DECLARED, 1)]
    return S.code_symbols(S.lines_of(code(spark, sf_dir)).unionAll(spark.createDataFrame(rows, "path string, line_no long, text string")))


@query("p28_signatures", f"""with {CODE}, l as (select path, u.i as line_no, string_split(body, chr(10))[u.i] as text from code, unnest(range(1, 8)) as u(i))
select path, line_no, text from l where (ends_with(path, '.py') and line_no in (2, 3, 4, 6)) or (ends_with(path, '.ts') and line_no = 6)""")
def p28(spark, sf_dir):
    from corvane.sources import tables as S

    rows = S.lines_of(code(spark, sf_dir))
    return render.signatures(rows, S.code_symbols(rows))


@query("p29_public_lines", f"""with {CODE}, l as (select path, u.i as line_no, string_split(body, chr(10))[u.i] as text from code, unnest(range(1, 8)) as u(i))
select path, line_no, text from l where (ends_with(path, '.py') and line_no in (1, 2, 6)) or (not ends_with(path, '.py') and line_no = 1)""")
def p29(spark, sf_dir):
    from corvane.sources import tables as S

    return render.public_lines(S.lines_of(code(spark, sf_dir)))


@query("j17_query_log", f"""with {COMMITS}, found as (select p_partkey as path from part order by greatest(len(p_name) - len(replace(lower(p_name), 'a', '')), 0) desc, p_partkey limit 10), hits as (select distinct "commit", path from commit_files where path in (select path from found)),
g as (select "commit", string_agg(cast(path as varchar), ',' order by path) as matched from hits group by "commit"), r as (select g."commit", "at", matched from g join commits using ("commit"))
select "commit", "at", matched, (select count(*) from r) > 100 as truncated from r order by "at" desc, "commit" limit 100""")
def j17(spark, sf_dir):
    name = F.lower("p_name")
    hits = F.char_length(name) - F.char_length(F.replace(name, F.lit("a"), F.lit("")))
    found = table(spark, sf_dir, "part").orderBy(F.desc(hits), "p_partkey").limit(10).select(F.col("p_partkey").alias("path"))  # the ten best hits of a search
    log = changes.query_log(found, commits(spark, sf_dir), commit_files(spark, sf_dir))
    return log.select("commit", "at", F.array_join(F.col("matched_paths").cast("array<string>"), ",").alias("matched"), "truncated")


@query("j18_changed_files", """select l_partkey as path, count(*) as added, case when l_partkey % 5 = 0 then 'A' else 'M' end as status from lineitem group by l_partkey""")
def j18(spark, sf_dir):
    stat = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("added"))
    status = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("path"), F.lit("A").alias("status"))
    return changes.changed_files(stat, status)


@query("j25_commit_changes", f"with {DIFF} select path, case kind when 'removed' then 'deleted' else kind end as change from d where kind <> 'unchanged'")
def j25(spark, sf_dir):
    a, b = manifests(spark, sf_dir)
    return changes.commit_changes(a.select("path", F.col("sha").alias("blob")), b.select("path", F.col("sha").alias("blob")))


@query("f16_branch_changes", """with n as (select p_partkey as path, p_size as added, 1 as deleted from part where p_partkey % 3 = 0),
p as (select path from n union select p_partkey from part where p_partkey % 7 = 0)
select path, coalesce(n.added, 0) as added, coalesce(n.deleted, 0) as deleted, concat_ws('+', case when path % 2 = 0 then 'committed' end, case when path % 5 = 0 then 'uncommitted' end, case when path % 7 = 0 then 'untracked' end) as state from p left join n using (path)""")
def f16(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("added"), F.lit(1).alias("deleted"))
    return changes.branch_changes(part.where("path % 3 = 0"), part.where("path % 2 = 0"), part.where("path % 5 = 0"), part.where("path % 7 = 0"))


@query("u8_worktree_row", f"with {COMMITS} select cast(\"commit\" as varchar) as \"commit\" from commits union all select 'worktree'")
def u8(spark, sf_dir):
    return changes.with_worktree(commits(spark, sf_dir), table(spark, sf_dir, "region")).select("commit")


@query("s13_stdin_paths", f"""with {LINES}, t as (select path, tokens from files)
select path as id, 'x/' || tokens || '.go' as path, 0 as ord from t where tokens % 3 = 0 union all
select path, trim(text), min(line_no) - 1 from lines join t using (path) where tokens % 3 <> 0 and trim(text) <> '' and not starts_with(trim(text), '#') group by 1, 2""")
def s13(spark, sf_dir):
    header = F.concat(F.lit("diff --git a/x/old.go b/x/"), F.col("tokens"), F.lit(".go\n+++ b\n"))
    text = F.when(F.col("tokens") % 3 == 0, F.concat(header, "body")).otherwise(F.col("body"))
    return changes.stdin_paths(files(spark, sf_dir).select(F.col("path").alias("id"), text.alias("value")))


@query("r5_match_ranges", f"""with {LINES}, r as (select path, greatest(line_no - 2, 1) as first, line_no + 2 as last from lines where contains(text, 'tion')),
o as (select *, case when first <= 1 + max(last) over (partition by path order by first, last rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from r),
g as (select *, sum(opens) over (partition by path order by first, last rows unbounded preceding) as run from o) select path, min(first) as first, max(last) as last from g group by path, run""")
def r5(spark, sf_dir):
    hits = lines(spark, sf_dir).where(F.col("text").contains("tion")).groupBy("path").agg(F.collect_list(F.struct(F.col("line_no").alias("line"))).alias("matches"))
    return changes.match_ranges(hits, 2)


@query("a12_coverage", """select 'p' || (l_partkey % 50) || '.go' as path, cast(sum(l_linenumber) as bigint) as statements, cast(sum(case when l_orderkey % 3 > 0 then l_linenumber else 0 end) as bigint) as covered,
round(sum(case when l_orderkey % 3 > 0 then l_linenumber else 0 end) / sum(l_linenumber) * 100, 9) as percent from lineitem group by 1""")
def a12(spark, sf_dir):
    value = F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".go:1.2,3.4 "), F.col("l_linenumber").cast("string"), F.lit(" "), (F.col("l_orderkey") % 3).cast("string"))
    return changes.coverage(table(spark, sf_dir, "lineitem").select(value.alias("value"))).withColumn("percent", F.round("percent", 9))


@query("a12_uncovered", """with r as (select 'p' || (l_partkey % 50) || '.go' as path, l_orderkey % 5000 + 1 as first, l_orderkey % 5000 + 1 + l_linenumber as last from lineitem where l_suppkey % 3 = 0),
o as (select *, case when first <= 1 + max(last) over (partition by path order by first, last rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from r),
g as (select *, sum(opens) over (partition by path order by first, last rows unbounded preceding) as run from o) select path, min(first) as first, max(last) as last from g group by path, run""")
def a12u(spark, sf_dir):
    first = F.col("l_orderkey") % 5000 + 1
    parts = F.lit("p"), F.col("l_partkey") % 50, F.lit(".go:"), first, F.lit(".1,"), first + F.col("l_linenumber"), F.lit(".2 1 "), F.col("l_suppkey") % 3
    return changes.uncovered(table(spark, sf_dir, "lineitem").select(F.concat(*parts).alias("value")))


@query("k17_test_links", """with d as (select distinct doc_id as i from documents),
t as (select i, 'd' || (i // 4) || '/f' || i || '_test.go' as test from d where i % 4 = 0),
s as (select i, 'd' || (i // 4) || case when i % 4 = 1 then '/f' || (i - 1) || '.go' else '/g' || i || '.go' end as source from d where i % 4 <> 0)
select test, source, cast(case when s.i > t.i + 3 then 5 else 35 + case s.i - t.i when 1 then 55 when 2 then 5 else 0 end end as bigint) as score
from t join s on s.i in (t.i + 1, t.i + 2, t.i + 3, t.i + 5)""")
def k17(spark, sf_dir):
    i, part = F.col("doc_id"), F.floor(F.col("doc_id") / 4)
    is_test = i % 4 == 0
    name = F.when(is_test, F.concat(F.lit("f"), i, F.lit("_test"))).when(i % 4 == 1, F.concat(F.lit("f"), i - 1)).otherwise(F.concat(F.lit("g"), i))
    calls = F.concat(F.lit("S"), i + 1, F.lit("() S"), i + 2, F.lit("() S"), i + 5)
    package = F.concat(F.lit("p"), part, F.when(is_test, "_test").otherwise(""))
    rows = table(spark, sf_dir, "documents").select(
        i, F.concat(F.lit("d"), part, F.lit("/"), name, F.lit(".go")).alias("path"), F.when(is_test, F.concat_ws("\n", "text", calls)).otherwise("").alias("body"), package.alias("package")
    )
    names = rows.where(~is_test).select("path", F.concat(F.lit("S"), i).alias("name"))
    return changes.test_links(rows.drop("doc_id"), names)


@query("j20_repositories", f"""with {SCORED}, s as (select path, basename + path_score + symbol + splitname + content as score from scored where basename + path_score + symbol + splitname + content > 0)
select case when {DIR} in ('src1/en', 'src2/de') then {DIR} when starts_with(path, 'src1/') then 'src1' else split_part(path, '/', 1) end as repo, max(score) as score from s group by 1""")
def j20(spark, sf_dir):
    scored = search.keyword_scores(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), T.query_terms(SEARCH))
    total = F.col("basename") + F.col("path_score") + F.col("symbol") + F.col("splitname") + F.col("content")
    repos = spark.createDataFrame([("src1",), ("src1/en",), ("src2/de",)], "repo string")
    return changes.repositories(scored.select("path", total.alias("score")).where("score > 0"), repos)


@query("j15_evidence", f"""with {DIFF.split(", d as")[0]}, m as (select 'a' as id, 1 as t, path, sha from base union all select 'b', 2, path, sha from cur)
select m.path, id, t as "at", m.sha = f.sha as fresh, row_number() over (partition by m.path order by t desc, id) as rank from m join (select path, sha256(body) as sha from files) f using (path)""")
def j15(spark, sf_dir):
    a, b = manifests(spark, sf_dir)
    rows = a.select(F.lit("a").alias("id"), F.lit(1).alias("at"), "path", "sha").unionAll(b.select(F.lit("b").alias("id"), F.lit(2).alias("at"), "path", "sha"))
    return changes.evidence(rows, files(spark, sf_dir).select("path", F.sha2("body", 256).alias("sha")))


@query("v4_staleness", f"with {DIFF} select path, case kind when 'removed' then 'missing' when 'modified' then 'stale' else 'fresh' end as state from d where kind <> 'added'")
def v4(spark, sf_dir):
    return changes.staleness(*manifests(spark, sf_dir))


@query("u6_group_specs", """with s as (select page_id as ord, 'p' || (page_id % 9) as path, case when page_id % 9 = 4 and page_id > 100 then null else page_id end as first, page_id + 1 as last from pages),
w as (select path, bool_or(first is null) as whole, min(ord) as ord from s group by path),
r as (select path, first, last from s where first is not null),
o as (select *, case when first <= 1 + max(last) over (partition by path order by first, last rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from r),
g as (select *, sum(opens) over (partition by path order by first, last rows unbounded preceding) as run from o), m as (select path, min(first) as first, max(last) as last from g group by path, run)
select path, whole, ord, null as first, null as last from w where whole union all select w.path, whole, ord, first, last from w join m using (path) where not whole""")
def u6(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(i.alias("ord"), F.concat(F.lit("p"), (i % 9).cast("string")).alias("path"), F.when(~((i % 9 == 4) & (i > 100)), i).alias("first"), (i + 1).alias("last"))
    return changes.group_specs(rows)


@query("u2_with_companions", f"with {RELEVANT}, s as (select path, score from tiered where tier = 'High'), c as (select path from tiered where tokens % 50 = 0) select path, score, 0 as part from s union all select path, 0, 1 from c where path not in (select path from s)")
def u2(spark, sf_dir):
    scored = k6(spark, sf_dir)
    return changes.append_companions(scored.where("tier = 'High'"), scored.where("tokens % 50 = 0").select("path"))


@query("w19_tiered_plan", f"""with recursive {RELEVANT}, 
ranked as materialized (select row_number() over (order by case tier when 'High' then 0 else 1 end, -score, path) as k, path, tokens from tiered where tier <> ''),
walk as (select k, path, tokens, tokens <= 9000 as taken, case when tokens <= 9000 then tokens else 0 end as used from ranked where k = 1
  union all select r.k, r.path, r.tokens, w.used + r.tokens <= 9000, case when w.used + r.tokens <= 9000 then w.used + r.tokens else w.used end from walk w join ranked r on r.k = w.k + 1)
select path, tokens, taken, cast(used as bigint) as used from walk""")
def w19(spark, sf_dir):
    ordered = k6(spark, sf_dir).where("tier <> ''").withColumns({"tier_order": changes.tier_order(F.col("tier")), "falling": -F.col("score")})
    return relevance.greedy(ordered, 9000, ["tier_order", "falling"]).select("path", "tokens", "taken", "used")


@query("v2_violation_groups", f"""with {VERDICTS}, e as (select verdict from verdicts union all select 'out-of-context' from files where tokens % 4 = 3)
select verdict, count(*) as "references", 1 as exit_code from e where verdict <> 'ok' group by verdict""")
def v2g(spark, sf_dir):
    return changes.violations(v2(spark, sf_dir))


@query("k3_merged_scores", f"""with {SCORED}, lit as (select path, sum(n) as literal from (select path, 12 as n from files where contains(regexp_extract(path, '([^/]+)\\.md$', 1), 'The') union all
  select path, 10 from symbols where contains(name, 'The') union all select path, 3 from lines where contains(text, 'The')) group by path)
select path, cast(basename + path_score + symbol + splitname + content as bigint) as keywords, cast(coalesce(literal, 0) as bigint) as literal from scored left join lit using (path) where literal > 0""")
def k3(spark, sf_dir):
    parts = files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir)
    scored = search.keyword_scores(*parts, T.query_terms(SEARCH))
    total = F.col("basename") + F.col("path_score") + F.col("symbol") + F.col("splitname") + F.col("content")
    return scored.select("path", total.alias("keywords")).join(search.literal_scores(*parts, "The"), "path")


@query("p27_excerpt_header", f"""with {LINES}, x as (select path, line_no, text from lines where line_no between 2 and 4) select path, string_agg(line_no || ': ' || text, chr(10) order by line_no) as excerpt from x group by path""")
def p27(spark, sf_dir):
    spans = files(spark, sf_dir).select("path", F.lit(2).cast("long").alias("first"), F.lit(4).cast("long").alias("last"))
    kept = X.excerpt(lines(spark, sf_dir), spans)
    rows = kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(": ", F.col("line_no").cast("string"), "text").alias("t")))).alias("x"))
    return rows.select("path", F.array_join("x.t", "\n").alias("excerpt"))


@query("s26_strand_paths", f"""with {RELEVANT} select 'focus' as strand, path from tiered where tier = 'High' union all select 'digest', path from files where tokens > 2000""")
def s26(spark, sf_dir):
    focus = k6(spark, sf_dir).where("tier = 'High'").select(F.lit("focus").alias("strand"), "path")
    return focus.unionAll(files(spark, sf_dir).where("tokens > 2000").select(F.lit("digest").alias("strand"), "path"))


__all__ = ["GOAL"]
