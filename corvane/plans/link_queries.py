"""Edges, contracts, snapshots, strands and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import contract, graph
from corvane.operators import select as X
from corvane.plans.base import FILES, LINES, SYMBOLS, files, gathered_lines, lines, query, symbols, table
from corvane.sources import tables as S

DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
EDGES = "edges as (select distinct l_suppkey as src, l_partkey as dst from lineitem)"


def edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("j5_reverse_edges", f"with {EDGES} select dst, string_agg(cast(src as varchar), ',' order by src) as sources from edges group by dst")
def j5(spark, sf_dir):
    return graph.reverse(edges(spark, sf_dir)).select("dst", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("j6_edges_of", f"with {EDGES} select 'out' as direction, dst as other from edges where src = 7 union select 'in', src from edges where dst = 7")
def j6(spark, sf_dir):
    return graph.edges_of(edges(spark, sf_dir), 7)


@query("j24_symbol_lookup", f"""with {SYMBOLS} select row_number() over (order by case when {DIR} = 'src1/en' then 0 else 1 end, case when split_part(path, '/', 1) = 'src1' then 0 else 1 end, path, line) as rank, path, name, kind, line
from symbols where name = 'The'""")
def j24(spark, sf_dir):
    return graph.lookup(symbols(spark, sf_dir), "The", "src1/en/doc_1.md")


FOCUS = f"""{SYMBOLS}, origin as (select distinct path, regexp_extract(path, '([^/]+)\\.md$', 1) as head from symbols where name = 'Hand'),
words as (select distinct path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as word from lines),
r as (select path, 0 as k, 'anchor-origin' as reason from symbols where name = 'Hand' union all
  select path, 1, 'same-dir' from files where {DIR} in (select {DIR} from symbols where name = 'Hand') union all
  select f.path, 2, 'basename-prefix' from files f join origin o on regexp_extract(f.path, '([^/]+)\\.md$', 1) = head or starts_with(regexp_extract(f.path, '([^/]+)\\.md$', 1), head || '_') union all
  select path, 3, 'name-match' from words where word = 'Hand'),
one as (select path, arg_min(reason, k) as reason from r group by path)"""


@query("j21_focus", f"with {FOCUS} select path, reason from one")
def j21(spark, sf_dir):
    return graph.focus(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), "Hand", endings=("md",))


@query("j22_focus_two_hops", f"""with {FOCUS}, names as (select distinct name from symbols where path in (select path from one)),
more as (select distinct path from words where word in (select name from names) and path not in (select path from one))
select path, reason from one union all select path, 'hop-2' from more""")
def j22(spark, sf_dir):
    return graph.focus(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), "Hand", 2, ("md",))


REFS = f"""{SYMBOLS}, stems as (select distinct name || '.md' as path, name as stem from symbols),
refs as (select s.path, count(f.path) as refs from stems s left join files f on contains(f.body, s.stem) group by s.path),
named as (select f.path, regexp_extract(f.path, '([^/]+)\\.md$', 1) as stem from files f),
own as (select n.path, count(f.path) as refs from named n left join files f on f.path <> n.path and contains(f.body, n.stem) group by n.path)"""


def _named(spark, sf_dir):
    stems = symbols(spark, sf_dir).select(F.concat("name", F.lit(".md")).alias("path"), F.lit("").alias("body")).distinct()
    return stems.unionAll(files(spark, sf_dir).select("path", "body"))


@query("k14_reference_counts", f"with {REFS} select path, refs from refs")
def k14(spark, sf_dir):
    return graph.reference_counts(_named(spark, sf_dir), ~F.col("path").contains("/"))


@query("k13_onboarding", f"""with {REFS}, n as (select path, count(*) as n from symbols group by path),
s as (select f.path, 'core' as role, round(case when n.n > 0 then 15.0 else 0.0 end + case when n.n > 0 then least(3 * log2(n.n + 1), 15.0) else 0.0 end + least(own.refs / greatest((select max(refs) from own), 1) * 20, 20.0), 2) as score from files f left join n using (path) left join own using (path))
select row_number() over (order by score desc, path) as rank, path, role, score from s order by score desc, path limit 10""")
def k13(spark, sf_dir):
    rows = files(spark, sf_dir)
    return X.onboarding(rows, symbols(spark, sf_dir), graph.reference_counts(rows))


@query("p18_line_hashes", f"""with {FILES}, h as (select path, regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+$') as p from files)
select path, u.i as line, sha256(p[u.i]) as sha from h, unnest(range(1, len(p) + 1)) as u(i)""")
def p18(spark, sf_dir):
    return contract.line_hashes(files(spark, sf_dir))


@query("v1_build_contract", f"""with {SYMBOLS}, s as (select path, string_agg(distinct name, ',' order by name) as symbols from symbols group by path),
h as (select path, body, regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+$') as p from files)
select h.path, least(1, len(p)) as line_start, len(p) as line_end, sha256(body) as sha, sha256(array_to_string(list_transform(p, lambda x: sha256(x)), '')) as lines_sha, coalesce(symbols, '') as symbols
from h left join s using (path)""")
def v1(spark, sf_dir):
    built = contract.build(files(spark, sf_dir), symbols(spark, sf_dir))
    return built.select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "sha", F.sha2(F.array_join("line_shas", ""), 256).alias("lines_sha"), F.array_join("symbols", ",").alias("symbols"))


@query("w9_range_hash", f"""with {FILES}, h as (select path, regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+$') as p from files)
select path, 2 as first, 4 as last, case when len(p) >= 4 then sha256(sha256(p[2]) || sha256(p[3]) || sha256(p[4])) end as sha from h""")
def w9(spark, sf_dir):
    spans = files(spark, sf_dir).select("path", F.lit(2).alias("first"), F.lit(4).alias("last"))
    return contract.range_sha(contract.line_hashes(files(spark, sf_dir)), spans)


@query("w8_span_labels", f"""with {LINES}, s as (select path, line_no from lines where line_no % 4 <> 0),
r as (select path, line_no, line_no - row_number() over (partition by path order by line_no) as run from s),
g as (select path, min(line_no) as a, max(line_no) as b from r group by path, run)
select path, string_agg(case when a = b then a || '' else a || '-' || b end, ', ' order by a) as label from g group by path""")
def w8(spark, sf_dir):
    return contract.span_labels(lines(spark, sf_dir).where("line_no % 4 <> 0").select("path", F.col("line_no").alias("line")))


#: A response about each file, of four kinds: lines and a symbol that are there, a file and a symbol that are not, a header, another case.
REFERENCES = """refs as (select path as id, 'line-range' as kind, path, 1 as line_start, tokens % 40 + 1 as line_end, cast(null as varchar) as symbol, 1 as source_line from files where tokens % 4 = 0
  union all select path, 'symbol', null, null, null, 'The', 2 from files where tokens % 4 = 0
  union all select path, 'line-range', concat('src9/xx/doc_', tokens, '.md'), 3, 3, null, 1 from files where tokens % 4 = 1
  union all select path, 'symbol', null, null, null, concat('Nope.Missing', tokens % 7), 1 from files where tokens % 4 = 1
  union all select path, 'diff-header', path, null, null, null, 1 from files where tokens % 4 = 2
  union all select path, 'file', upper(path), null, null, null, 1 from files where tokens % 4 = 3
  union all select path, 'symbol', null, null, null, 'Mod.The', 1 from files where tokens % 4 = 3)"""
VERDICTS = f"""{SYMBOLS}, {REFERENCES}, names as (select distinct name from symbols),
h as (select path, len(regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+$')) as n from files), fold as (select lower(path) as low, min(n) as n from h group by 1),
c as (select r.*, coalesce(h.n, fold.n) as n, a.name is not null or b.name is not null as known from refs r left join h using (path) left join fold on fold.low = lower(r.path)
  left join names a on a.name = r.symbol left join names b on b.name = regexp_extract(r.symbol, '[^.]*$')),
verdicts as (select id, kind, path, symbol, case when kind = 'symbol' then case when known then 'ok' else 'phantom-symbol' end when n is null then 'out-of-context'
  when kind = 'line-range' and not (line_start >= 1 and line_end <= n) then 'stale-content' else 'ok' end as verdict from c)"""


def responses(spark, sf_dir):
    path, t = F.col("path"), F.col("tokens")
    text = (
        F.when(t % 4 == 0, F.concat(F.lit("see "), path, F.lit(":1-"), t % 40 + 1, F.lit("\nand `The`")))
        .when(t % 4 == 1, F.concat(F.lit("the `Nope.Missing"), t % 7, F.lit("` of src9/xx/doc_"), t, F.lit(".md:3")))
        .when(t % 4 == 2, F.concat(F.lit("+++ b/"), path))
        .otherwise(F.concat(F.upper(path), F.lit(" is it, as `Mod.The`, `x.py` no symbol")))
    )
    return files(spark, sf_dir).select(path.alias("id"), text.alias("text"))


@query("r1_references", f"with {FILES}, {REFERENCES} select * from refs union all select path, 'file', 'x.py', null, null, null, 1 from files where tokens % 4 = 3")
def r1(spark, sf_dir):
    return contract.references(responses(spark, sf_dir))


@query("v2_verify", f"""with {VERDICTS} select * from verdicts union all select path, 'file', 'x.py', null, 'out-of-context' from files where tokens % 4 = 3""")
def v2(spark, sf_dir):
    built = contract.build(files(spark, sf_dir), symbols(spark, sf_dir))
    return contract.verify(built, contract.references(responses(spark, sf_dir))).select("id", "kind", "path", "symbol", "verdict")


MANIFESTS = f"""{FILES},
src as (select path, body, tokens, cast(regexp_extract(path, 'doc_(\\d+)', 1) as bigint) as i from files),
base as (select path, sha256(body) as sha, tokens, tokens % 20 as score, case when tokens % 20 >= 10 then 'High' when tokens % 20 >= 3 then 'Medium' else 'Low' end as tier from src where i % 10 <> 0),
cur as (select path, case when i % 7 = 0 then sha256(body || '!') else sha256(body) end as sha, tokens + case when i % 7 = 0 then 1 else 0 end as tokens,
  (tokens + case when i % 5 = 0 then 6 else 0 end) % 20 as score, case when (tokens + case when i % 5 = 0 then 6 else 0 end) % 20 >= 10 then 'High' when (tokens + case when i % 5 = 0 then 6 else 0 end) % 20 >= 3 then 'Medium' else 'Low' end as tier from src where i % 10 <> 1)"""


def manifests(spark, sf_dir):
    rows = files(spark, sf_dir)
    i = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    base = S.manifest(rows, i % 10 != 0, F.lit(False))
    cur = S.manifest(rows, i % 10 != 1, i % 7 == 0)
    score = ((F.col("tokens") - F.when(i % 7 == 0, 1).otherwise(0) + F.when(i % 5 == 0, 6).otherwise(0)) % 20).cast("long")
    return base, cur.withColumn("score", score).withColumn("tier", F.when(F.col("score") >= 10, "High").when(F.col("score") >= 3, "Medium").otherwise("Low"))


DIFF = f"""{MANIFESTS}, d as (select coalesce(a.path, b.path) as path, case when a.sha is null then 'added' when b.sha is null then 'removed' when a.sha = b.sha then 'unchanged' else 'modified' end as kind,
  cast(coalesce(b.tokens, 0) - coalesce(a.tokens, 0) as bigint) as token_delta from base a full join cur b on a.path = b.path)"""


@query("j12_manifest_diff", f"with {DIFF} select path, kind, token_delta from d")
def j12(spark, sf_dir):
    return contract.diff(*manifests(spark, sf_dir))


@query("a10_diff_summary", f"with {DIFF} select kind, count(*) as files, cast(sum(token_delta) as bigint) as token_delta from d group by kind")
def a10(spark, sf_dir):
    return contract.diff_summary(j12(spark, sf_dir))


@query("j14_changed_since", f"with {DIFF} select path from files semi join (select path from d where kind in ('added', 'modified')) using (path)")
def j14(spark, sf_dir):
    return contract.changed_since(files(spark, sf_dir).select("path"), *manifests(spark, sf_dir))


RANK = "case {0} when 'High' then 3 when 'Medium' then 2 else 1 end"


@query("j13_selection_diff", f"""with {MANIFESTS}, c as (select coalesce(a.path, b.path) as path, case when a.sha is null then 'added' when b.sha is null then 'removed'
  when {RANK.format("b.tier")} > {RANK.format("a.tier")} then 'promoted' when {RANK.format("b.tier")} < {RANK.format("a.tier")} then 'demoted'
  when abs(b.score - a.score) / greatest(abs(a.score), 1) >= 0.3 then 'score_changed' end as category, cast(coalesce(b.tokens, 0) - coalesce(a.tokens, 0) as bigint) as token_delta
  from base a full join cur b on a.path = b.path) select * from c where category is not null""")
def j13(spark, sf_dir):
    return contract.selection_diff(*manifests(spark, sf_dir))


@query("a17_last_entry_wins", "select user_id as path, arg_max(event_type, event_id) as kind from events group by user_id")
def a17(spark, sf_dir):
    return contract.last_entries(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind")))


RANGES = f"{LINES}, ranges as (select path, line_no as first, line_no + (line_no % 3) as last from lines where line_no % 5 < 2)"
MERGED = f"""{RANGES}, o as (select *, case when first <= 1 + max(last) over (partition by path order by first, last rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from ranges),
g as (select *, sum(opens) over (partition by path order by first, last rows unbounded preceding) as run from o), merged as (select path, min(first) as first, max(last) as last from g group by path, run)"""


def ranges(spark, sf_dir):
    n = F.col("line_no")
    return lines(spark, sf_dir).where("line_no % 5 < 2").select("path", n.alias("first"), (n + n % 3).alias("last"))


@query("w4_merge_ranges", f"with {MERGED} select path, first, last from merged")
def w4(spark, sf_dir):
    return X.merge_ranges(ranges(spark, sf_dir))


@query("j7_excerpt", f"with {MERGED} select l.path, l.line_no, l.text from lines l join merged m on m.path = l.path and l.line_no between m.first and m.last")
def j7(spark, sf_dir):
    return X.excerpt(lines(spark, sf_dir), ranges(spark, sf_dir))


STRANDS = [("exclude-overlap", 0), ("merge", 1), ("prefer-newer", 2), ("exclude-overlap", 3)]
PICKS = """picks(strand, policy, ord, path, first, last) as (
  select page_id % 4, case page_id % 4 when 0 then 'exclude-overlap' when 1 then 'merge' when 2 then 'prefer-newer' else 'exclude-overlap' end, page_id, 'p' || (page_id % 15),
    case when page_id % 6 = 0 then null else page_id % 40 end, case when page_id % 6 = 0 then null else page_id % 40 + 5 end from pages),
one as (select strand, policy, path, first, last, min(ord) as ord from picks group by strand, policy, path, first, last),
lim as (select *, coalesce(first, 0) as lo, coalesce(last, 2147483647) as hi from one)"""


def picks(spark, sf_dir):
    i = F.col("page_id")
    policy = F.element_at(F.array(*[F.lit(p) for p, _ in STRANDS]), (i % 4 + 1).cast("int"))
    whole = i % 6 == 0
    return table(spark, sf_dir, "pages").select(
        (i % 4).alias("strand"), policy.alias("policy"), i.alias("ord"), F.concat(F.lit("p"), (i % 15).cast("string")).alias("path"),
        F.when(~whole, i % 40).alias("first"), F.when(~whole, i % 40 + 5).alias("last"),
    )


@query("u1_merge_strands", f"""with {PICKS}
select strand, policy, ord, path, first, last from lim a where not exists (select 1 from lim b where b.path = a.path and (b.strand > a.strand or (b.strand = a.strand and b.ord > a.ord)) and b.policy = 'prefer-newer' and b.lo <= a.hi and a.lo <= b.hi)
 and not (a.policy = 'exclude-overlap' and exists (select 1 from lim b where b.path = a.path and (b.strand < a.strand or (b.strand = a.strand and b.ord < a.ord)) and b.lo <= a.hi and a.lo <= b.hi))""")
def u1(spark, sf_dir):
    return X.merge_strands(picks(spark, sf_dir))


@query("w12_allocate", """with s as (select r_name as name, (r_regionkey + 1) / 10.0 as share from region)
select name, share, cast(round(share / greatest(sum(share) over (), 1.0) * 50000) as bigint) as budget from s""")
def w12(spark, sf_dir):
    shares = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), ((F.col("r_regionkey") + 1) / 10.0).alias("share"))
    return X.allocate(shares, 50_000)


@query("j9_resolve_mentions", f"""with {FILES}, m(id, mention) as (values (1, 'doc_3.md'), (1, 'en/doc_5.md'), (2, 'src0/fr/doc_0.md'), (3, 'zz/none.md')),
c as (select m.id, m.mention, count(f.path) as n, min(f.path) as one, max(case when f.path = m.mention then f.path end) as exact from m left join files f on f.path = m.mention or ends_with(f.path, '/' || m.mention) group by all)
select id, mention, coalesce(exact, case when n = 1 then one end) as path, case when exact is not null or n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'missing' end as status from c""")
def j9(spark, sf_dir):
    said = spark.createDataFrame([(1, "see doc_3.md and en/doc_5.md."), (2, "./src0/fr/doc_0.md:4-8"), (3, "zz/none.md")], "id int, text string")
    return X.resolve(X.mentions(said), files(spark, sf_dir)).select("id", "mention", "path", "status")


@query("w18_fold_diff", f"""with {LINES}, d as (select path, line_no as n, line_no % 13 = 0 as changed, text from lines),
m as (select *, max(case when changed then 1 else 0 end) over (partition by path order by n rows between 3 preceding and 3 following) = 1 as near from d),
r as (select *, n - row_number() over (partition by path, near order by n) as run from m)
select path, n, text, cast(null as bigint) as folded from r where near union all select path, min(n), null, count(*) from r where not near group by path, run""")
def w18(spark, sf_dir):
    rows = gathered_lines(spark, sf_dir).select("path", F.col("line_no").alias("n"), (F.col("line_no") % 13 == 0).alias("changed"), "text")
    return X.fold_lines(rows)


@query("w15_line_diff", f"""with {LINES}, n as (select path, max(line_no) as n from lines group by path)
select path, cast(sum(case when line_no = 2 then 1 else 0 end) as bigint) as removed, cast(1 as bigint) as added from lines group by path having count(*) > 1""")
def w15(spark, sf_dir):
    rows = gathered_lines(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x")).where(F.size("x") > 1)
    texts = F.col("x.text")
    after = F.concat(F.slice(texts, 1, 1), F.slice(texts, 3, F.size(texts)), F.array(F.lit("~new~")))
    script = X.changed_lines(rows.select("path", F.concat(F.array_join(texts, "\n"), F.lit("\n")).alias("before"), F.array_join(after, "\n").alias("after")))
    return script.groupBy("path").agg(F.count_if(F.col("op") == "-").alias("removed"), F.count_if(F.col("op") == "+").alias("added"))


@query("j19_status_rollup", f"""with {FILES}, s as (select path, case when tokens % 3 = 0 then 'M' when tokens % 3 = 1 then 'A' else '?' end as status from files),
u as (select unnest([split_part(path, '/', 1), {DIR}]) as dir, case status when 'A' then 50 when 'M' then 40 else 5 end as k, status from s)
select dir, arg_max(status, k) as status from u group by dir""")
def j19(spark, sf_dir):
    status = F.when(F.col("tokens") % 3 == 0, "M").when(F.col("tokens") % 3 == 1, "A").otherwise("?")
    return graph.status_rollup(files(spark, sf_dir).select("path", status.alias("status")))


@query("t10_page", "select p_partkey, p_name from part order by p_partkey limit 25 offset 50")
def t10(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(50).limit(25)


@query("p15_role_priority", """select page_id, case page_id % 5 when 0 then 'test' when 1 then 'doc' when 2 then 'config' when 3 then 'entry' else 'core' end as role from pages""")
def p15(spark, sf_dir):
    names = F.array(*map(F.lit, ["tests/a.py", "docs/x.md", "Cargo.toml", "src/main.py", "src/lib.rs"]))
    return table(spark, sf_dir, "pages").select("page_id", T.role(F.element_at(names, (F.col("page_id") % 5 + 1).cast("int"))).alias("role"))


@query("w15_moved_lines", """with d as (select doc_id as path, concat(source, chr(12), lang) as t from documents where doc_id is not null and source is not null and lang is not null),
s as (select distinct path, t from d)
select path, unnest([1, 2, 3, 4]) as n, unnest(['-', '=', '+', '+']) as op, unnest([concat('c', t, chr(13)), concat('a', t), concat('b', t), concat('a', t)]) as text from s""")
def w15_moved(spark, sf_dir):
    said = F.concat("source", F.lit("\f"), "lang")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and source is not null and lang is not null").select(F.col("doc_id").alias("path"), said.alias("t")).distinct()
    before = F.concat(F.lit("c"), "t", F.lit("\r\na"), "t", F.lit("\n"))
    after = F.concat(F.lit("a"), "t", F.lit("\nb"), "t", F.lit("\na"), "t")
    return X.changed_lines(docs.select("path", before.alias("before"), after.alias("after")))
