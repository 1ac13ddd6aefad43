"""Scalar operators, filters, scans and secrets over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import filters, heat, scan
from corvane.operators import select as X
from corvane.plans.base import FILES, LINES, SYMBOLS, files, lines, query, symbols, table
from corvane.sources import tables as S

DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query("s1_scan_files", f"with {FILES} select path, size, tokens, sha256(body) as sha from files")
def s1(spark, sf_dir):
    return files(spark, sf_dir).select("path", "size", "tokens", F.sha2("body", 256).alias("sha"))


@query("s2_scan_stats", f"with {SYMBOLS}, n as (select path, count(*) as n_symbols from symbols group by path) select f.path, cast(strlen(body) as bigint) as n_bytes, tokens, coalesce(n_symbols, 0) as n_symbols from files f left join n using (path)")
def s2(spark, sf_dir):
    counts = symbols(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_symbols"))
    rows = files(spark, sf_dir).select("path", F.octet_length("body").cast("long").alias("n_bytes"), "tokens")
    return rows.join(counts, "path", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))


@query("s25_symbol_listing", f"with {SYMBOLS} select path, string_agg(name, ',' order by line) as names from symbols group by path")
def s25(spark, sf_dir):
    rows = symbols(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("x"))
    return rows.select("path", F.array_join("x.name", ",").alias("names"))


@query("s5_tree_rollup", f"""with {FILES}, up as (
  select unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) as dir, tokens, size from files)
select dir, count(*) as files, cast(sum(tokens) as bigint) as tokens, cast(sum(size) as bigint) as size from up group by dir""")
def s5(spark, sf_dir):
    return heat.rollup(files(spark, sf_dir))


@query("p5_path_parts", f"with {FILES} select path, regexp_extract(path, '[^/]*$') as base, {DIR} as dir, regexp_extract(path, '([^/]+)\\.md$', 1) as stem, split_part(path, '/', 1) as top, 'doc' as role, 'markdown' as language from files")
def p5(spark, sf_dir):
    path = F.col("path")
    return files(spark, sf_dir).select(
        "path", T.basename(path).alias("base"), T.dirname(path).alias("dir"), T.stem(path).alias("stem"), T.truncate_path(path, 1).alias("top"), T.role(path).alias("role"), T.language(path).alias("language")
    )


@query("p9_text_stats", f"with {FILES} select path, cast(length(body) - length(replace(body, chr(10), '')) + case when body <> '' and not ends_with(body, chr(10)) then 1 else 0 end as bigint) as lines, cast(length(body) as bigint) as chars from files")
def p9(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.line_count(F.col("body")).alias("lines"), F.char_length("body").cast("long").alias("chars"))


@query("p7_split_lines", f"with {LINES} select path, line_no, text from lines")
def p7(spark, sf_dir):
    return lines(spark, sf_dir)


@query("p19_line_entropy", f"""with {FILES}, c as (select path, unnest(string_split(body, '')) as ch from files where body <> ''),
n as (select path, ch, count(*) as n from c group by all), t as (select path, sum(n) as t from n group by path)
select path, round(sum(-(n / t) * log2(n / t)), 9) as bits from n join t using (path) group by path""")
def p19(spark, sf_dir):
    rows = files(spark, sf_dir).where("body <> ''")
    return rows.select("path", F.round(T.entropy(F.col("body")), 9).alias("bits"))


@query("p20_entropy_candidates", f"""with {LINES}, m as (select path, line_no, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_+/=-]+') as found from lines where not contains(text, 'token')),
c as (select path, line_no, u.i as k, found[u.i] as candidate from m, unnest(range(1, len(found) + 1)) as u(i)),
b as (select *, unnest(string_split(candidate, '')) as ch from c where length(candidate) >= 20),
n as (select path, line_no, k, candidate, ch, count(*) as n from b group by all),
e as (select path, line_no, k, candidate, sum(-(n / length(candidate)) * log2(n / length(candidate))) as bits from n group by all)
select path, line_no, arg_min(candidate, k) as candidate, round(arg_min(bits, k), 9) as bits from e where bits >= 3.9999999999 group by path, line_no""")
def p20(spark, sf_dir):
    return scan.entropy_warnings(lines(spark, sf_dir), ("token", "")).withColumn("bits", F.round("bits", 9))


@query("p21_preview", f"""with {LINES}, w as (select distinct regexp_extract(text, '\\p{{L}}+[^\\n]{{0,9}}') as v from lines),
k as (select v, list_filter(range(1, 5), lambda n: strlen(left(v, n)) <= 4) as a, list_filter(range(1, 5), lambda n: strlen(right(v, n)) <= 4) as z from w)
select v, case when strlen(v) <= 12 then v else coalesce(left(v, list_max(a)), '') || '[...]' || coalesce(right(v, list_max(z)), '') end as preview from k""")
def p21(spark, sf_dir):
    words = lines(spark, sf_dir).select(F.regexp_extract("text", r"\p{L}+[^\n]{0,9}", 0).alias("v")).distinct()
    return words.select("v", T.preview(F.col("v")).alias("preview"))


@query("p22_levenshtein", f"with {SYMBOLS}, n as (select distinct name from symbols) select name, levenshtein(name, 'Thention') as distance from n")
def p22(spark, sf_dir):
    return symbols(spark, sf_dir).select("name").distinct().select("name", F.levenshtein("name", F.lit("Thention")).cast("long").alias("distance"))


@query("p26_line_spec", """with s as (select page_id, case page_id % 4 when 0 then 'src/a.py:' || page_id || '-' || (page_id + 5) when 1 then 'src/b.go:' || page_id when 2 then 'src/c.ts#L' || page_id || '-L' || (page_id + 2) else 'src/d.md' end as spec from pages),
x as (select spec, regexp_extract(spec, '^(.+?)(?::|#L)(\\d{1,9})(?:-L?(\\d{1,9}))?$', ['p', 'a', 'b']) as m from s),
y as (select spec, m, try_cast(m['a'] as int) as a, coalesce(try_cast(m['b'] as int), try_cast(m['a'] as int)) as b from x)
select distinct spec, case when a >= 1 and b >= a then m['p'] else spec end as path, case when a >= 1 and b >= a then a end as first, case when a >= 1 and b >= a then b end as last from y""")
def p26(spark, sf_dir):
    i = F.col("page_id")
    s = i.cast("string")
    spec = (
        F.when(i % 4 == 0, F.concat(F.lit("src/a.py:"), s, F.lit("-"), (i + 5).cast("string")))
        .when(i % 4 == 1, F.concat(F.lit("src/b.go:"), s))
        .when(i % 4 == 2, F.concat(F.lit("src/c.ts#L"), s, F.lit("-L"), (i + 2).cast("string")))
        .otherwise("src/d.md")
    )
    rows = table(spark, sf_dir, "pages").select(spec.alias("spec")).distinct()
    return rows.withColumn("r", T.line_spec(F.col("spec"))).select("spec", "r.path", "r.first", "r.last")


@query("p39_slug", "select page_id, rtrim(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 48), '-') as slug from pages where url is not null")
def p39(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("p42_clean_path", """with p as (select page_id as k, coalesce(nullif(regexp_extract(lower(url), '([a-z0-9]+)[^a-z0-9]*$', 1), ''), 'n') as s from pages)
select k, case k % 6 when 0 then 'a/./' || s || '/../c' when 1 then '/' || s || '/../../y' when 2 then './' when 3 then '../' || s || '/b/..' when 4 then s || '//b/' else '/' end as path,
  case k % 6 when 0 then 'a/c' when 1 then '/y' when 2 then '.' when 3 then '../' || s when 4 then s || '/b' else '/' end as clean from p""")
def p42(spark, sf_dir):
    k, found = F.col("page_id"), F.regexp_extract(F.lower("url"), "([a-z0-9]+)[^a-z0-9]*$", 1)
    s = F.coalesce(F.nullif(found, F.lit("")), F.lit("n"))
    forms = [("a/./", s, "/../c"), ("/", s, "/../../y"), ("./",), ("../", s, "/b/.."), (s, "//b/"), ("/",)]
    raw = F.element_at(F.array(*[F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in f]) for f in forms]), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(k.alias("k"), raw.alias("path"))
    return rows.select("k", "path", T.clean_path(F.col("path")).alias("clean"))


@query("p4_identifier_parts", f"""with {SYMBOLS}, n as (select distinct name || 'Re_x9' || name as id, lower(name) as a from symbols where length(name) >= 3)
select id, a || ',re,' || a as parts from n""")
def p4(spark, sf_dir):
    rows = symbols(spark, sf_dir).where(F.char_length("name") >= 3).select(F.concat("name", F.lit("Re_x9"), "name").alias("id")).distinct()
    return rows.select("id", F.array_join(T.identifier_parts(F.col("id")), ",").alias("parts"))


RULES = ["src1/", "*.md", "!src2/", "!src2/**", "src2/de/", "/src3/en/doc_1*"]


@query("f1_ignore_rules", f"""with {FILES} select path from files where not (
  (starts_with(path, 'src2/de/') or not starts_with(path, 'src2/')))""")
def f1(spark, sf_dir):
    return filters.drop_ignored(files(spark, sf_dir), RULES).select("path")


@query("f2_ignore_union", f"with {FILES} select path from files where not starts_with(path, 'src1/') and not contains(path, '/fr/') and not starts_with(path, 'src3/en/doc_1')")
def f2(spark, sf_dir):
    return filters.drop_ignored(files(spark, sf_dir), ["src1/"], ["fr/", "/src3/en/doc_1*"], True).select("path")


@query("f4_path_globs", f"with {FILES} select path from files where (regexp_matches(path, '^src[12]/') or regexp_matches(path, '/en/')) and not regexp_matches(path, 'doc_[0-9]*7\\.md$')")
def f4(spark, sf_dir):
    return files(spark, sf_dir).where(filters.allowed(F.col("path"), ["src{1,2}/**", "en"], ["doc_*7.md"])).select("path")


@query("f9_binary", "select page_id, page_id % 5 = 0 as is_binary from pages where html is not null and html <> ''")
def f9(spark, sf_dir):
    head = F.encode(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("a"), F.char(F.lit(0)), "html")).otherwise(F.col("html")), "utf-8")
    rows = table(spark, sf_dir, "pages").where("html is not null and html <> ''")
    return rows.select("page_id", filters.is_binary(head).alias("is_binary"))


@query("f14_prune_empty_dirs", f"""with {FILES}, d as (select distinct split_part(path, '/', 1) as dir from files union select distinct {DIR} from files),
k as (select distinct unnest([split_part(path, '/', 1), {DIR}]) as dir from files where size > 2000) select dir from d semi join k using (dir)""")
def f14(spark, sf_dir):
    all_files = files(spark, sf_dir)
    folders = all_files.select(T.truncate_path(F.col("path"), 1).alias("dir")).union(all_files.select(T.dirname(F.col("path")).alias("dir"))).distinct()
    return filters.folders_left(folders, all_files.where("size > 2000"))


@query("f17_explicit_selection", f"""with {FILES}, w as (select 'src' || (i % 20) || '/en/doc_' || i || '.md' as path from range(0, 400) r(i))
select path, path in (select path from files) as found from w""")
def f17(spark, sf_dir):
    i = F.col("id")
    wanted = spark.range(0, 400).select(F.concat(F.lit("src"), (i % 20).cast("string"), F.lit("/en/doc_"), i.cast("string"), F.lit(".md")).alias("path"))
    kept, missing = filters.requested(files(spark, sf_dir).select("path"), wanted)
    return kept.select("path", F.lit(True).alias("found")).unionAll(missing.select("path", F.lit(False).alias("found")))


@query("f22_below_path", f"with {FILES} select path from files where path = 'src1/en' or starts_with(path, 'src1/en/')")
def f22(spark, sf_dir):
    return files(spark, sf_dir).where(filters.below(F.col("path"), "src1/en")).select("path")


_HITS = "\n".join(f"when regexp_matches(text, $p${p}$p$) then '{k}'" for k, p, _ in scan.PATTERNS)
_SEV = "\n".join(f"when regexp_matches(text, $p${p}$p$) then '{s}'" for _, p, s in scan.PATTERNS)
_SUB = "\n".join(f"when regexp_matches(text, $p${p}$p$) then regexp_extract(text, $p${p}$p$)" for _, p, s in scan.PATTERNS)


@query("k16_secret_scan", f"""with {LINES}, h as (select path, line_no, case {_HITS} end as kind, case {_SEV} end as severity, case {_SUB} end as hit from lines)
select path, line_no, kind, severity, case when length(hit) <= 12 then hit else left(hit, 4) || '[...]' || right(hit, 4) end as preview from h where kind is not null""")
def k16(spark, sf_dir):
    return scan.scan_files(files(spark, sf_dir))


@query("p33_redact", f"""with {LINES}, h as (select path, line_no, text, case {_HITS} end as kind from lines)
select path, line_no, coalesce('[REDACTED — kind=' || kind || ']', text) as text from h""")
def p33(spark, sf_dir):
    return scan.redact(lines(spark, sf_dir))


@query("r4_script_blocks", "select page_id, array_to_string(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1), chr(10)) as scripts from pages where html is not null")
def r4(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("html is not null")
    return rows.select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(T.SCRIPT_BLOCK), F.lit(1)), "\n").alias("scripts"))


METRICS = f"""{SYMBOLS}, n as (select path, count(*) as symbols from symbols group by path),
churned as (select 'src' || (o_custkey % 20) as dir, count(*) as churn from orders group by 1),
metrics as (select f.path, tokens, coalesce(n.symbols, 0) as symbols, case when ends_with(f.path, '0.md') then coalesce(churn, 0) else 0 end as churn
  from files f left join n using (path) left join churned on dir = split_part(f.path, '/', 1)),
bucketed as (select {DIR} as dir, cast(sum(tokens) as bigint) as tokens, count(*) as files, cast(sum(symbols) as bigint) as symbols, cast(sum(churn) as bigint) as churn from metrics group by 1)"""


def metrics(spark, sf_dir):
    counts = symbols(spark, sf_dir).groupBy("path").agg(F.count("*").alias("symbols"))
    folder = F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string"))
    churned = table(spark, sf_dir, "orders").groupBy(folder.alias("top")).agg(F.count("*").alias("churn"))
    rows = files(spark, sf_dir).join(counts, "path", "left").withColumn("top", T.truncate_path(F.col("path"), 1)).join(churned, "top", "left")
    zero = F.lit(0)
    return rows.select("path", "tokens", F.coalesce("symbols", zero).alias("symbols"), F.when(F.col("path").endswith("0.md"), F.coalesce("churn", zero)).otherwise(zero).alias("churn"))


@query("a1_heat_buckets", f"with {METRICS} select *, cast(tokens as double) as weight from bucketed where tokens > 0")
def a1(spark, sf_dir):
    return heat.buckets(metrics(spark, sf_dir), 2)


@query("j16_churn_map", f"with {METRICS} select *, cast(churn as double) as weight from bucketed where churn > 0 order by weight desc, dir limit 20")
def j16(spark, sf_dir):
    return heat.buckets(metrics(spark, sf_dir), 2, "churn", 20)


@query("a3_totals", f"with {METRICS} select sum(cast(tokens as double)) as weight, cast(sum(tokens) as bigint) as tokens from bucketed")
def a3(spark, sf_dir):
    return a1(spark, sf_dir).agg(F.sum("weight").alias("weight"), F.sum("tokens").cast("long").alias("tokens"))


@query("w11_treemap")
def w11(spark, sf_dir):
    return heat.treemap(a1(spark, sf_dir))


NOISE = f"""{SYMBOLS}, n as (select path, count(*) as n from symbols group by path),
named as (select case when doc_id % 11 = 0 then 'dist/' || doc_id || '.js' when doc_id % 13 = 0 then 'pkg/go.sum' when doc_id % 17 = 0 then 'a/fixtures/' || doc_id || '.txt'
  when doc_id % 19 = 0 then 'img/' || doc_id || '.png' when doc_id % 3 = 0 then 'data/' || doc_id || '.json' else 'src/' || doc_id || '.py' end as path,
  n_chars as size, n_chars // 4 as tokens, coalesce(n, 0) as n from documents left join n on n.path = concat(source, '/', lang, '/doc_', doc_id, '.md')),
classified as (select path, tokens, case when starts_with(path, 'dist/') then 'generated' when path = 'pkg/go.sum' then 'lockfile' when contains(path, '/fixtures/') then 'testdata'
  when ends_with(path, '.png') then 'binary' when ends_with(path, '.json') and size >= 51200 then 'huge-json' when ends_with(path, '.py') and size >= 10240 and n / (size / 1024.0) < 0.5 then 'low-density' end as reason from named)"""


def classified(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    path = (
        F.when(i % 11 == 0, F.concat(F.lit("dist/"), s, F.lit(".js")))
        .when(i % 13 == 0, "pkg/go.sum")
        .when(i % 17 == 0, F.concat(F.lit("a/fixtures/"), s, F.lit(".txt")))
        .when(i % 19 == 0, F.concat(F.lit("img/"), s, F.lit(".png")))
        .when(i % 3 == 0, F.concat(F.lit("data/"), s, F.lit(".json")))
        .otherwise(F.concat(F.lit("src/"), s, F.lit(".py")))
    )
    docs = table(spark, sf_dir, "documents")
    own = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), s, F.lit(".md"))
    counts = symbols(spark, sf_dir).groupBy(F.col("path").alias("own")).agg(F.count("*").alias("n"))
    rows = docs.select(own.alias("own"), path.alias("path"), "n_chars").join(counts, "own", "left")
    return rows.select("path", F.floor(F.col("n_chars") / 4).alias("tokens"), X.noise(F.col("path"), F.col("n_chars"), F.coalesce("n", F.lit(0))).alias("reason"))


@query("k15_noise_classify", f"with {NOISE} select path, tokens, reason from classified")
def k15(spark, sf_dir):
    return classified(spark, sf_dir)


@query("a7_noise_summary", f"with {NOISE} select count(reason) as files, cast(coalesce(sum(tokens) filter (where reason is not null), 0) as bigint) as tokens, round(least(coalesce(sum(tokens) filter (where reason is not null), 0) / sum(tokens), 1.0), 9) as ratio from classified")
def a7(spark, sf_dir):
    return X.noise_summary(classified(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query("a8_noise_globs", f"""with {NOISE}, r as (select path, case when contains(path, '/') then {DIR} else '.' end as dir, regexp_extract(path, '(\\.[^./]*)$', 1) as ext from classified where reason is not null),
s as (select *, count(*) over (partition by dir, ext) as n from r) select distinct case when n >= 3 then dir || '/*' || ext else path end as glob from s""")
def a8(spark, sf_dir):
    return X.noise_globs(classified(spark, sf_dir))


@query("t7_top_noise", f"with {NOISE} select path, tokens, reason from classified where reason is not null and reason <> 'lockfile' order by tokens desc, path limit 20")
def t7(spark, sf_dir):
    return classified(spark, sf_dir).where("reason is not null and reason <> 'lockfile'").orderBy(F.desc("tokens"), "path").limit(20)


@query("s9_git_status", "select 'f' || page_id as path, case page_id % 6 when 0 then '?' when 1 then 'M' when 2 then 'D' when 3 then 'A' when 4 then 'R' else 'D' end as status from pages")
def s9(spark, sf_dir):
    flag = F.element_at(F.array(*map(F.lit, ["??", " M", "D ", "A ", "R ", "DM"])), (F.col("page_id") % 6 + 1).cast("int"))
    return S.parse_status(table(spark, sf_dir, "pages").select(F.concat(flag, F.lit(" f"), F.col("page_id").cast("string")).alias("value")))


@query("s8_numstat", "select page_id as \"commit\", 'p' || page_id as path, case when page_id % 3 = 0 then null else page_id end as added, case when page_id % 3 = 0 then null else 2 * page_id end as deleted, page_id % 3 = 0 as binary from pages")
def s8(spark, sf_dir):
    i = F.col("page_id")
    text = lambda c: F.when(i % 3 == 0, "-").otherwise(c.cast("string"))
    raw = F.concat_ws("\t", text(i), text(2 * i), F.concat(F.lit("p"), i.cast("string")))
    return S.parse_numstat(table(spark, sf_dir, "pages").select(i.alias("commit"), raw.alias("value")))
