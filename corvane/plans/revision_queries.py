"""Pack scans and filters, revisions and their differences, refs, partial contracts, and counts of folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import contract, filters, revisions
from corvane.plans.base import FILES, LINES, files, query, table

#: Paths of the kinds that filters part, by page: the same in both engines.
KINDS = (
    "src/a{}.go", "node_modules/p{}/x.js", "lib/dist/b{}.ts", "doc/tmp/c{}.md", "tmp/d{}.txt", "target/e{}.rs", "build/f{}.Py", "src/rebuild/g{}.MJS", "h{}.lock", "x/coverage/i{}.tsx", "j{}.log", "src/k{}.log.py",
)
PATHS = "paths as (select page_id, replace((" + str(list(KINDS)) + ")[page_id % " + str(len(KINDS)) + " + 1], '{}', cast(page_id as varchar)) as path from pages)"
EXT = "lower(regexp_extract(path, '[.]([^./]*)$', 1))"


def paths(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % len(KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(kind, F.lit("{}"), F.col("page_id").cast("string")).alias("path"))


@query("f3_pack_ignore", f"""with {PATHS} select path from paths where not (path like 'node_modules/%' or path like 'dist/%' or path like 'coverage/%' or path like '%.lock' or path like '.git/%'
  or path like 'build/%' or path like '%/build/%' or path like 'tmp/%' or path like '%/tmp/%' or path like 'src/%.log%')""")
def f3(spark, sf_dir):
    return paths(spark, sf_dir).where(~filters.pack_ignored(F.col("path"), [*filters.PACK_IGNORED, "# note", "!j*", "build/", "./tmp", "src/*.log*", "/x/"])).select("path")


@query("f10_binary_revision", "select page_id, page_id % 21 > 0 and 7989 + page_id % 21 <= 7999 as is_binary from pages")
def f10(spark, sf_dir):
    i = (F.col("page_id") % 21).cast("int")
    body = F.concat(F.repeat(F.lit("a"), i + 7989), F.when(i > 0, F.char(F.lit(0))).otherwise(""), F.lit("b"))
    return table(spark, sf_dir, "pages").select("page_id", filters.is_binary_blob(body.cast("binary")).alias("is_binary"))


@query("f15_changed", f"with {FILES} select path from files where cast(regexp_extract(path, 'doc_(\\d+)', 1) as bigint) in (select o_orderkey from orders)")
def f15(spark, sf_dir):
    rows = files(spark, sf_dir)
    touched = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")).distinct()
    changes = rows.select("path", F.regexp_extract("path", r"doc_(\d+)", 1).cast("long").alias("i")).join(touched, "i", "left_semi")
    return filters.changed(rows, changes).select("path")


@query("f18_api_only", f"with {PATHS} select path, {EXT} in ('go', 'ts', 'tsx', 'js', 'jsx', 'mjs', 'py') as api from paths")
def f18(spark, sf_dir):
    return paths(spark, sf_dir).select("path", filters.api_only(F.col("path")).alias("api"))


@query("s3_scan_pack", f"""with {PATHS} select path, sha256(left(path || ':' || repeat('0123456789', cast(page_id % 90 as int)), 512)) as head from paths
where not regexp_matches(path, '(^|/)(\\.git|node_modules|dist|coverage|target)/') and path not like '%.lock'""")
def s3(spark, sf_dir):
    rows = paths(spark, sf_dir).withColumn("body", F.concat("path", F.lit(":"), F.repeat(F.lit("0123456789"), (F.col("page_id") % 90).cast("int"))))
    return filters.pack_scan(rows).select("path", F.sha2("head", 256).alias("head"))


@query("s4_list_paths", f"with {FILES} select path from files")
def s4(spark, sf_dir):
    return files(spark, sf_dir).select("path")


@query("s6_scan_imports", f"with {PATHS} select path from paths where not regexp_matches(path, '(^|/)(\\.git|node_modules|dist|coverage)/')")
def s6(spark, sf_dir):
    return filters.import_scan(paths(spark, sf_dir)).select("path")


@query("a16_dir_counts", f"""with {LINES}, n as (select path, count(*) as n from lines group by path),
up as (select unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) as dir, tokens, coalesce(n.n, 0) as n from files left join n using (path))
select dir, count(*) as files, cast(sum(tokens) as bigint) as tokens, cast(sum(n) as bigint) as lines from up group by dir""")
def a16(spark, sf_dir):
    return filters.folder_counts(files(spark, sf_dir))


NAMES = """names as (select page_id as "commit", 'n' || page_id as path, case when page_id % 4 < 2 then 'o' || page_id end as old_path, case page_id % 4 when 0 then 'R100' when 1 then 'C75' when 2 then 'M' else 'A' end as status from pages
  union all select page_id, 'z ' || page_id, null, 'D' from pages)"""


def _names(spark, sf_dir):
    i, nul = F.col("page_id").cast("string"), F.char(F.lit(0))
    k = F.col("page_id") % 4
    status = F.element_at(F.array(*map(F.lit, ("R100", "C75", "M", "A"))), (k + 1).cast("int"))
    first = F.concat(status, nul, F.when(k < 2, F.concat(F.lit("o"), i, nul)).otherwise(""), F.lit("n"), i, nul)
    value = F.concat(first, F.lit("D"), nul, F.lit("z "), i, nul, F.lit("R90"), nul, F.lit("cut"), nul)
    return revisions.parse_name_status(table(spark, sf_dir, "pages").select(F.col("page_id").alias("commit"), value.alias("value")))


def _stats(spark, sf_dir):
    i, nul = F.col("page_id").cast("string"), F.char(F.lit(0))
    path = F.when(F.col("page_id") % 4 < 2, F.concat(nul, F.lit("o"), i, nul, F.lit("n"), i)).otherwise(F.concat(F.lit("n"), i))
    value = F.concat(i, F.lit("\t3\t"), path, nul, F.lit("-\t-\tz "), i, nul)
    return revisions.parse_numstat_records(table(spark, sf_dir, "pages").where("page_id % 5 > 0").select(F.col("page_id").alias("commit"), value.alias("value")))


@query("s8_name_status", f"with {NAMES} select * from names")
def s8_names(spark, sf_dir):
    return _names(spark, sf_dir)


CHANGED = f"""{NAMES}, changed as (select *, case when "commit" % 5 > 0 and status <> 'D' then "commit" else 0 end as added, case when "commit" % 5 > 0 and status <> 'D' then 3 else 0 end as deleted,
  status = 'D' and "commit" % 5 > 0 as binary from names)"""


@query("j18_renamed_files", f"with {CHANGED} select * from changed")
def j18_renamed(spark, sf_dir):
    return revisions.changed_between(_names(spark, sf_dir), _stats(spark, sf_dir))


@query("a13_change_totals", f'with {CHANGED} select "commit", count(*) as files, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted, count(*) filter (where "binary") as binary from changed group by "commit"')
def a13_totals(spark, sf_dir):
    return revisions.change_totals(revisions.changed_between(_names(spark, sf_dir), _stats(spark, sf_dir)))


#: Files at two revisions: one in ten is new, one in ten gone, one in seven changed, one in eleven binary.
TWO = f"""{FILES}, src as (select path, body, cast(regexp_extract(path, 'doc_(\\d+)', 1) as bigint) as i from files),
two as (select path, i, case when i % 10 <> 0 then body end as before, case when i % 10 <> 1 then case when i % 7 = 0 then body || chr(10) || 'x' when i % 11 = 0 then 'bin' else body end end as after from src)"""


def _two(spark, sf_dir):
    i = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    src = files(spark, sf_dir).select("path", "body", i.alias("i"))
    nul = F.concat(F.lit("bin"), F.char(F.lit(0)))
    body = F.when(F.col("i") % 7 == 0, F.concat("body", F.lit("\nx"))).when(F.col("i") % 11 == 0, nul).otherwise(F.col("body"))
    return src.where("i % 10 <> 0").select("path", "body"), src.where("i % 10 <> 1").select("path", body.alias("body"))


BINARY = "(i % 10 <> 1 and i % 7 <> 0 and i % 11 = 0)"


@query("j26_revision_diff", f"with {TWO} select path, before is null as added, after is null as deleted, {BINARY} as binary, not {BINARY} and before is not distinct from after as no_change from two")
def j26(spark, sf_dir):
    return revisions.revision_diff(*_two(spark, sf_dir)).drop("before", "after")


ENTRIES = f"{TWO}, e as (select path, i, before, after, before is null as added, after is null as deleted, {BINARY} as binary from two where before is distinct from after)"


def _entries(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    found = revisions.revision_diff(before, after).where("not no_change")
    status = F.when(F.col("added"), "A").when(F.col("deleted"), "D").otherwise("M")
    names = found.select("path", F.lit(None).cast("string").alias("old_path"), status.alias("status"))
    return revisions.patch_entries(names, before, after)


@query("j27_patch_entries", f"""with {ENTRIES} select path, case when added then 'A' when deleted then 'D' else 'M' end as status, added, deleted, "binary", strlen(before) as before_bytes, case when "binary" then 4 else strlen(after) end as after_bytes from e""")
def j27(spark, sf_dir):
    return _entries(spark, sf_dir).select("path", "status", "added", "deleted", "binary", F.octet_length("before").cast("long").alias("before_bytes"), F.octet_length("after").cast("long").alias("after_bytes"))


def _fence(column: str) -> str:
    return f"'```markdown' || chr(10) || coalesce({column}, '') || case when coalesce({column}, '') = '' or ends_with({column}, chr(10)) then '' else chr(10) end || '```' || chr(10)"


_TITLE = "'### ' || path || chr(10) || chr(10)"


@query("s20_sequential", f"""with {ENTRIES} select path, sha256({_TITLE} || case when "binary" then 'binary file changed' || chr(10) || chr(10) else
  case when added then '' else '**Before** (commit aa):' || chr(10) || {_fence("before")} || chr(10) end || case when deleted then '' else '**After** (commit bb):' || chr(10) || {_fence("after")} || chr(10) end end) as sha from e""")
def s20(spark, sf_dir):
    return revisions.render_differences(_entries(spark, sf_dir), "sequential", "aa", "bb").select("path", F.sha2("text", 256).alias("sha"))


@query("s20_side_by_side", f"""with {ENTRIES} select path, sha256({_TITLE} || case when "binary" then 'binary file changed' || chr(10) || chr(10) else
  '<table>' || chr(10) || '<tr><th>Before</th><th>After</th></tr>' || chr(10) || '<tr><td>' || chr(10) || case when added then '' else chr(10) || {_fence("before")} end || chr(10) || '</td><td>' || chr(10)
  || case when deleted then '' else chr(10) || {_fence("after")} end || chr(10) || '</td></tr>' || chr(10) || '</table>' || chr(10) || chr(10) end) as sha from e""")
def s20_pair(spark, sf_dir):
    return revisions.render_differences(_entries(spark, sf_dir), "side-by-side").select("path", F.sha2("text", 256).alias("sha"))


@query("s10_refs", "select case page_id % 3 when 0 then 'branch' when 1 then 'remote' else 'tag' end as kind, 'x/' || page_id as name, 'c' || page_id as \"commit\", page_id as \"at\", case when page_id % 2 = 0 then 1 end as ahead, 2 as behind, 's ' || page_id as subject from pages where page_id % 4 < 3")
def s10(spark, sf_dir):
    i = F.col("page_id").cast("string")
    kind = F.when(F.col("page_id") % 4 == 3, "notes").otherwise(F.element_at(F.array(*map(F.lit, ("heads", "remotes", "tags"))), (F.col("page_id") % 3 + 1).cast("int")))
    value = F.concat_ws("\x1f", F.concat(F.lit("refs/"), kind, F.lit("/x/"), i), F.concat(F.lit("c"), i), i, F.when(F.col("page_id") % 2 == 0, "1").otherwise("gone"), F.lit("2"), F.concat(F.lit("s "), i))
    return revisions.parse_refs(table(spark, sf_dir, "pages").select(value.alias("value")))


PARTIAL = """h as (select path, body, regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+$') as p from files),
l as (select path, u.i as line, sha256(p[u.i]) as sha from h, unnest(range(1, len(p) + 1)) as u(i)), shown as (select * from l where line % 7 < 5)"""


def _shown(spark, sf_dir):
    return contract.line_hashes(files(spark, sf_dir)).where("line % 7 < 5")


@query("v1_partial_contract", f"with {FILES}, {PARTIAL} select path, min(line) as line_start, max(line) as line_end, sha256(string_agg(sha, '' order by line)) as sha, count(*) as n_lines from shown group by path")
def v1_partial(spark, sf_dir):
    built = contract.build_partial(_shown(spark, sf_dir))
    return built.select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "sha", F.size("line_shas").cast("long").alias("n_lines"))


@query("v3_partial_ranges", f"""with {FILES}, {PARTIAL}, c as (select path, unnest([1, 3, 6, 0]) as line_start, unnest([3, 1, 7, 2]) as line_end from files)
select c.path, line_start, line_end, line_start > 0 and count(s.line) = abs(line_end - line_start) + 1 as covered from c left join shown s on s.path = c.path and s.line between least(line_start, line_end) and greatest(line_start, line_end) group by c.path, line_start, line_end""")
def v3(spark, sf_dir):
    spans = F.explode(F.array(*[F.struct(F.lit(a).alias("line_start"), F.lit(b).alias("line_end")) for a, b in ((1, 3), (3, 1), (6, 7), (0, 2))]))
    cited = files(spark, sf_dir).select("path", spans.alias("s")).select("path", "s.*")
    return contract.partial_cover(cited, _shown(spark, sf_dir))


@query("v4_partial_staleness", f"""with {FILES}, {PARTIAL}, i as (select path, cast(regexp_extract(path, 'doc_(\\d+)', 1) as bigint) as i from files)
select distinct path, case when i % 10 = 1 then 'missing' when i % 7 = 0 then 'stale' else 'fresh' end as state from shown join i using (path)""")
def v4_partial(spark, sf_dir):
    i = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    now = files(spark, sf_dir).where(i % 10 != 1).withColumn("body", F.when(i % 7 == 0, F.concat(F.lit("!"), "body")).otherwise(F.col("body")))
    return contract.partial_staleness(_shown(spark, sf_dir), contract.line_hashes(now), now.select("path"))


@query("v7_manifest_contract", "select replace(path, chr(92), '/') as path, 1 as line_start, 1073741824 as line_end, sha from (select case when page_id % 6 = 0 then '  ' else 'a' || chr(92) || page_id end as path, sha256(url) as sha from pages where url is not null) where trim(path) <> ''")
def v7(spark, sf_dir):
    path = F.when(F.col("page_id") % 6 == 0, "  ").otherwise(F.concat(F.lit("a\\"), F.col("page_id").cast("string")))
    manifest = table(spark, sf_dir, "pages").where("url is not null").select(path.alias("path"), F.sha2("url", 256).alias("sha"))
    return contract.from_manifest(manifest).select("path", "line_start", "line_end", "sha")


@query("v2_strict_verify", f"""with {LINES}, n as (select path, count(*) as n from lines where contains(text, '.go') group by path)
select path as id, 'no-references' as verdict from files where not regexp_matches(body, '[A-Za-z_][A-Za-z0-9._/-]*[.](go|ts|tsx|js|jsx|mjs|py|rs|java|kt|rb|swift|md|toml|yaml|yml|json|sh|sql)') and not regexp_matches(body, '`[A-Za-z_][A-Za-z0-9_.]*`') and not regexp_matches(body, '(?m)^[+]{{3}}[ \\t]+b/[^ \\t\\n]+')""")
def v2_strict(spark, sf_dir):
    said = files(spark, sf_dir).select(F.col("path").alias("id"), F.col("body").alias("text"))
    return contract.without_references(said, contract.references(said))

