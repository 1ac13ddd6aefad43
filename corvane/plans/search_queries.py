"""Search, relevance, budgets and coverage over documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import echo, relevance, search
from corvane.plans.base import FILES, LINES, SYMBOLS, files, lines, query, symbols

WORDS = ["doc", "entio", "the"]  # sorted terms of the query below, "the" is a stop word
SEARCH = "the doc tion src1"
SEARCH_TERMS = ["doc", "src1", "tion"]
GOAL = "tion in en doc"
GOAL_TERMS = ["tion", "en", "doc"]
BUDGET = 20_000


def _cases(text: str, points: int, terms: list[str] = SEARCH_TERMS) -> str:
    return "case " + " ".join(f"when contains({text}, '{t}') then {points}" for t in terms) + " else 0 end"


def _adds(text: str, points: int, terms: list[str] = SEARCH_TERMS) -> str:
    return " + ".join(f"(case when contains({text}, '{t}') then {points} else 0 end)" for t in terms)


STEM = "lower(regexp_extract(path, '([^/]+)\\.md$', 1))"
DIR = "lower(regexp_extract(path, '^(.*)/[^/]*$', 1))"
SCORED = f"""{SYMBOLS},
named as (select path, {_adds(STEM, 12)} as basename, {_adds(DIR, 6)} as path_score,
  {" + ".join(f"(case when not contains({STEM}, '{t}') and {STEM} = 'doc_{t}' then 6 else 0 end)" for t in SEARCH_TERMS)} as splitname0 from files),
held as (select path, sum({_cases("lower(name)", 10)}) as symbol, sum({" + ".join(f"(case when lower(name) = '{t}' then 6 else 0 end)" for t in SEARCH_TERMS)}) as part from symbols group by path),
said as (select path, sum({_cases("lower(text)", 3)}) as content from lines group by path),
scored as (select n.path, cast(basename as bigint) as basename, cast(path_score as bigint) as path_score, cast(coalesce(symbol, 0) as bigint) as symbol,
  cast(splitname0 + coalesce(part, 0) as bigint) as splitname, cast(coalesce(content, 0) as bigint) as content
  from named n left join held using (path) left join said using (path))"""


@query("k1_where_score", f"with {SCORED} select * from scored")
def k1(spark, sf_dir):
    return search.keyword_scores(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), T.query_terms(SEARCH))


@query("k4_where_search", f"with {SCORED} select *, basename + path_score + symbol + splitname + content as score from scored where basename + path_score + symbol + splitname + content > 0 order by score desc, path limit 10")
def k4(spark, sf_dir):
    return search.search(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), SEARCH)


@query("f6_require_all", f"""with {SYMBOLS} select path from files f where {" and ".join(
    f"(contains({STEM}, '{t}') or contains({DIR}, '{t}') or exists(select 1 from lines l where l.path = f.path and contains(lower(l.text), '{t}')))" for t in SEARCH_TERMS)}""")
def f6(spark, sf_dir):
    return search.paths_with_all(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), T.query_terms(SEARCH))


@query("k2_literal_score", f"""with {SYMBOLS}, u as (
  select path, 12 as n from files where contains(regexp_extract(path, '([^/]+)\\.md$', 1), 'tion') union all
  select path, 6 from files where contains(regexp_extract(path, '^(.*)/[^/]*$', 1), 'tion') union all
  select path, 10 from symbols where contains(name, 'tion') union all select path, 3 from lines where contains(text, 'tion'))
select path, cast(sum(n) as bigint) as literal from u group by path""")
def k2(spark, sf_dir):
    return search.literal_scores(files(spark, sf_dir), lines(spark, sf_dir), symbols(spark, sf_dir), "tion")


@query("f8_regex_gate", f"with {LINES} select path, cast(3 * count(*) as bigint) as regex from lines where regexp_matches(text, '\\b[A-Z][a-z]+ing\\b') group by path")
def f8(spark, sf_dir):
    return search.regex_scores(lines(spark, sf_dir), r"\b[A-Z][a-z]+ing\b")


@query("k5_did_you_mean", f"""with {SYMBOLS}, names as (
  select name, arg_min(kind, k) as kind from (select {STEM} as name, 'file' as kind, 0 as k from files union all select lower(name), 'symbol', 1 from symbols) group by name),
d as (select name, kind, levenshtein(name, 'theand') as d1, levenshtein(name, 'onentio') as d2 from names),
e as (select name, kind, least(case when d1 between 1 and 2 then d1 end, case when d2 between 1 and 2 then d2 end) as distance from d)
select name, kind, distance from e where distance is not null order by distance, strlen(name), name limit 5""")
def k5(spark, sf_dir):
    return search.suggest(files(spark, sf_dir), symbols(spark, sf_dir), "theand onentio")


@query("p23_p24_matches", f"""with {LINES}, hit as (select path, line_no, text,
  case when contains(lower(text), 'ing') then strlen(substr(lower(text), 1, strpos(lower(text), 'ing') - 1)) + 1
       when contains(lower(text), 'src1') then strlen(substr(lower(text), 1, strpos(lower(text), 'src1') - 1)) + 1 end as byte_column,
  coalesce(list(text) over (partition by path order by line_no rows between 1 preceding and 1 preceding), []) as before,
  coalesce(list(text) over (partition by path order by line_no rows between 1 following and 1 following), []) as after from lines)
select path, line_no, byte_column, text, array_to_string(before, '|') as before, array_to_string(after, '|') as after from hit where byte_column is not null""")
def p24(spark, sf_dir):
    found = search.matches(lines(spark, sf_dir), "ing src1")
    return found.withColumns({"before": F.array_join("before", "|"), "after": F.array_join("after", "|")})


RELEVANT = f"""{SYMBOLS},
flags as (select path, {", ".join(f"bool_or(contains(lower(name), '{t}')) as s{k}" for k, t in enumerate(GOAL_TERMS))} from symbols group by path),
relevant as (select path, tokens, cast(3 + {_adds(STEM, 10, GOAL_TERMS)} + {_adds(DIR, 5, GOAL_TERMS)} + {" + ".join(f"(case when coalesce(s{k}, false) then 8 else 0 end)" for k in range(len(GOAL_TERMS)))} as bigint) as score
  from files left join flags using (path)),
tiered as (select *, case when score >= 10 then 'High' when score >= 3 then 'Medium' else '' end as tier,
  case when score >= 3 then '' when score = 0 then 'outside goal scope' else 'low relevance' end as reason from relevant)"""


@query("k6_relevance", f"with {RELEVANT} select path, tokens, score, tier, reason from tiered")
def k6(spark, sf_dir):
    return relevance.score(files(spark, sf_dir), symbols(spark, sf_dir), GOAL)


@query("k7_rank_top_n", f"with {RELEVANT} select path, tokens, score, tier, reason from tiered where tier <> '' order by score desc, path limit 25")
def k7(spark, sf_dir):
    return relevance.rank(k6(spark, sf_dir), 25)


@query("k8_why_gap", f"with {RELEVANT} select path, score, tier, cast(case when score >= 10 then 0 when score >= 3 then 10 - score else 3 - score end as bigint) as gap from tiered")
def k8(spark, sf_dir):
    return relevance.gap(k6(spark, sf_dir))


def _fold(source: str) -> str:
    """Greedy fold over ranked rows (g, k, path, tokens): a recursive walk, as SQL has no fold that passes rows over."""
    return f"""walk as (
  select g, k, path, tokens, tokens <= {BUDGET} as taken, case when tokens <= {BUDGET} then tokens else 0 end as used from {source} where k = 1
  union all select r.g, r.k, r.path, r.tokens, w.used + r.tokens <= {BUDGET}, case when w.used + r.tokens <= {BUDGET} then w.used + r.tokens else w.used end
  from walk w join {source} r on r.g = w.g and r.k = w.k + 1)"""


@query("w1_budget_pack", f"""with recursive {RELEVANT},
ranked as materialized (select 1 as g, row_number() over (order by -score, path) as k, path, tokens from tiered where tier <> ''), {_fold("ranked")}
select path, tokens, taken, cast(used as bigint) as used from walk""")
def w1(spark, sf_dir):
    ranked = k6(spark, sf_dir).where("tier <> ''").withColumn("order", -F.col("score"))
    return relevance.greedy(ranked, BUDGET, ["order"]).select("path", "tokens", "taken", "used")


@query("w13_strand_trim", f"""with recursive {FILES},
ranked as materialized (select split_part(path, '/', 2) as g, row_number() over (partition by split_part(path, '/', 2) order by cast(regexp_extract(path, 'doc_(\\d+)', 1) as bigint) desc, path) as k, path, tokens from files), {_fold("ranked")}
select g as strand, path, tokens, taken, cast(used as bigint) as used from walk""")
def w13(spark, sf_dir):
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")  # each strand in an order of its own
    strands = files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("strand"), "path", "tokens", (-number).alias("ord"))
    return relevance.greedy(strands, BUDGET, ["ord"], ["strand"]).select("strand", "path", "tokens", "taken", "used")


PLAN = f"""{FILES},
marked as (select path, tokens, case when tokens <= 0 then 'binary' when tokens > {BUDGET} / 2.0 then 'too large' end as why from files),
ranked as materialized (select 1 as g, row_number() over (order by tokens, path) as k, path, tokens from marked where why is null), {_fold("ranked")},
plan as (select path, tokens, case when taken then 'included' else 'over budget' end as status from walk union all select path, tokens, why from marked where why is not null)"""


@query("w3_budget_plan", f"with recursive {PLAN} select * from plan")
def w3(spark, sf_dir):
    return relevance.budget_plan(files(spark, sf_dir).select("path", "tokens"), BUDGET)


@query("a9_budget_groups", f"""with recursive {PLAN},
rows as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from plan where status <> 'included'),
sized as (select *, count(*) over (partition by dir) as n from rows)
select case when n >= 3 then dir || '/**' else path end as item, cast(sum(tokens) as bigint) as tokens, count(*) as files,
  case when min(status) = max(status) then min(status) else 'multiple reasons' end as reason from sized group by 1""")
def a9(spark, sf_dir):
    return relevance.budget_groups(w3(spark, sf_dir))


@query("p14_plan_fit", f"""with {FILES}, t as (select cast(sum(tokens) as bigint) as total from files)
select plan, total, cast(floor(total / lim * 100 + 0.5) as bigint) as percent, total <= lim as fits from t, (values ('small', 16385.0), ('medium', 128000.0), ('large', 2000000.0)) v(plan, lim)""")
def p14(spark, sf_dir):
    return relevance.plan_fit(files(spark, sf_dir), {"small": 16_385, "medium": 128_000, "large": 2_000_000})


PARAGRAPHS = f"""{LINES},
flagged as (select *, trim(text, ' ') = '' as blank, sum(case when trim(text, ' ') = '' then 1 else 0 end) over (partition by path order by line_no) as run from lines),
chunks as (select path, min(line_no) as first, max(line_no) as last, string_agg(text, chr(10) order by line_no) as body from flagged where not blank group by path, run)"""


@query("w5_paragraph_chunks", f"with {PARAGRAPHS} select path, first, last, sha256(body) as sha from chunks")
def w5(spark, sf_dir):
    return echo.paragraphs(lines(spark, sf_dir)).select("path", "first", "last", F.sha2("body", 256).alias("sha"))


@query("w6_symbol_chunks", f"""with {LINES}, r as (select *, sum(case when regexp_matches(text, '^[A-Z][a-z]+ing') then 1 else 0 end) over (partition by path order by line_no) as run from lines)
select path, min(line_no) as first, max(line_no) as last, sha256(string_agg(text, chr(10) order by line_no)) as sha from r group by path, run""")
def w6(spark, sf_dir):
    return echo.bounded_chunks(lines(spark, sf_dir), "^[A-Z][a-z]+ing").select("path", "first", "last", F.sha2("body", 256).alias("sha"))


@query("w7_fixed_chunks", f"with {LINES} select path, min(line_no) as first, max(line_no) as last, sha256(string_agg(text, chr(10) order by line_no)) as sha from lines group by path, (line_no - 1) // 5")
def w7(spark, sf_dir):
    return echo.fixed_chunks(lines(spark, sf_dir), 5).select("path", "first", "last", F.sha2("body", 256).alias("sha"))


ECHO_GOAL = ["tion", "hand", "que", "der"]
ECHO_STOP = ", ".join(f"'{w}'" for w in T.ECHO_STOP)
_TOKENS = f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{Nd}})', '\\1 \\2', 'g'), '(\\p{{Nd}})(\\p{{L}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 and w not in ({ECHO_STOP}))"
BM25 = f"""{PARAGRAPHS},
toks as (select path, first, last, {_TOKENS} as t from chunks),
tf as (select path, first, last, len(t) as length, {", ".join(f"len(list_filter(t, lambda w: w = '{g}')) as tf{k}" for k, g in enumerate(sorted(ECHO_GOAL)))} from toks),
st as (select count(*) as n, greatest(avg(length), 1.0) as mean, {", ".join(f"count(*) filter (where tf{k} > 0) as df{k}" for k in range(4))} from tf),
bm as (select path, first, last, length, [tf0, tf1, tf2, tf3] as hits, {" + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.5 / (tf{k} + 1.5 * (0.25 + 0.75 * length / mean))" for k in range(4))} as score from tf, st)"""


@query("k9_bm25", f"with {BM25} select path, first, last, length, round(score, 9) as score from bm where score > 0")
def k9(spark, sf_dir):
    scored = echo.bm25(echo.paragraphs(lines(spark, sf_dir)), ECHO_GOAL)
    return scored.where("score > 0").select("path", "first", "last", "length", F.round("score", 9).alias("score"))


@query("k12_echo_evaluate", f"""with {BM25}, hits as (select score, list_sum(hits) as v, hits from bm),
r as (select v, row_number() over (order by v) as i, count(*) over () as k from hits where v > 0),
g as (select sum(i * v) as iv, sum(v) as s, max(k) as k from r),
best as (select sum(score) as b from (select score from bm order by score desc, path, first limit 10)),
w as (select count(*) as chunks, count(*) filter (where score > 0) as covered, sum(score) as total, {" + ".join(f"max(case when hits[{k + 1}] > 0 then 1 else 0 end)" for k in range(4))} as terms from hits)
select chunks, covered, cast(terms as bigint) as terms, round(terms / 4.0 * b / total, 9) as coverage, round(greatest(least(1 - (2 * iv / (k * s) - (k + 1) / k), 1.0), 0.0), 9) as spread from w, best, g""")
def k12(spark, sf_dir):
    scored = echo.bm25(echo.paragraphs(lines(spark, sf_dir)), ECHO_GOAL)
    return echo.coverage(scored, ECHO_GOAL).withColumns({"coverage": F.round("coverage", 9), "spread": F.round("spread", 9)})


@query("p3_echo_tokens", f"with {FILES} select path, len({_TOKENS}) as n_tokens, sha256(array_to_string({_TOKENS}, ' ')) as sha from files")
def p3(spark, sf_dir):
    rows = files(spark, sf_dir).select("path", T.echo_tokens(F.col("body")).alias("t"))
    return rows.select("path", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("sha"))
