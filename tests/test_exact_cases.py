"""Small inputs whose results are known: ties, edges and rules that large tables rarely meet."""

import math
import random
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import filters, graph, history, relevance, scan
from corvane.sources import tables as S


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def values(spark, texts, expression):
    """The expression over each text, in order."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, v string")
    return [r["x"] for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_greedy_ties_go_by_path(spark):
    items = spark.createDataFrame([("b", 20, 0), ("a", 90, 0), ("c", 20, 0), ("d", 10, 1)], "path string, tokens long, falling long")
    assert rows(relevance.greedy(items, 100, ["falling"]), "path", "taken", "used") == [("a", True, 90), ("b", False, 90), ("c", False, 90), ("d", True, 100)]
    strands = spark.createDataFrame([("s", 2, "a", 90), ("s", 1, "z", 30), ("t", 1, "y", 100)], "strand string, ord long, path string, tokens long")
    assert rows(relevance.greedy(strands, 100, ["ord"], ["strand"]), "path", "taken") == [("a", False), ("y", True), ("z", True)]
    many = spark.range(3000).select(F.format_string("%05d", "id").alias("path"), (F.col("id") % 7 + 1).alias("tokens"), F.lit(0).alias("o"))
    used, want = 0, []
    for k in range(3000):
        fits = used + k % 7 + 1 <= 500
        used += k % 7 + 1 if fits else 0
        want.append((f"{k:05d}", fits, used))
    assert rows(relevance.greedy(many, 500, ["o"]), "path", "taken", "used") == want
    assert relevance.greedy(many.limit(0), 500, ["o"]).collect() == []


def test_greedy_of_any_sizes_equals_a_plain_fold(spark):
    rng = random.Random(11)
    sizes = {"a": [rng.choice([0, 1, 2, 3, 50, 400, 999, 1000, 1001]) for _ in range(300)], "b": [rng.randint(0, 700) for _ in range(200)], "c": [1, 999, 1, 998, 2, 997] * 20, "d": [2000], "e": [1000, 0, 1, 0]}
    items = spark.createDataFrame([(g, k, f"{k:03d}", n, "x") for g, ns in sizes.items() for k, n in enumerate(ns)], "g string, o long, path string, tokens long, hi string").repartition(5)
    got = {(r["g"], r["o"]): (r["taken"], r["used"]) for r in relevance.greedy(items, 1000, ["o"], ["g"]).collect()}
    for g, ns in sizes.items():
        used = 0
        for k, n in enumerate(ns):
            fits = used + n <= 1000
            used += n if fits else 0
            assert got[g, k] == (fits, used), (g, k)


def test_focus_goes_by_the_defining_file(spark):
    paths = ["p/foo.go", "p/near.go", "q/foo_util.go", "q/foolish.go", "q/bar.go", "q/says.py", "q/says.rs", "q/bar_x.go", "r/late.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    lines = spark.createDataFrame([("q/says.py", 1, "x = Bar()"), ("q/says.rs", 1, "Bar"), ("q/bar.go", 1, "Barber"), ("r/late.ts", 1, "Helper()")], "path string, line_no long, text string")
    symbols = spark.createDataFrame([("p/foo.go", "Bar", "type", 1), ("q/says.py", "Helper", "function", 3)], "path string, name string, kind string, line long")
    one = [("p/foo.go", "anchor-origin"), ("p/near.go", "same-dir"), ("q/foo_util.go", "basename-prefix"), ("q/says.py", "name-match")]
    assert rows(graph.focus(files, lines, symbols, "Bar"), "path", "reason") == one
    assert rows(graph.focus(files, lines, symbols, "Bar", 2), "path", "reason") == sorted([*one, ("r/late.ts", "hop-2")])


def test_digest_counts_files_by_status(spark):
    t = datetime(2024, 1, 2)
    commits = spark.createDataFrame([(1, t, "a", True), (2, t, "a", False), (3, t, "b", False)], "commit long, at timestamp, author string, root boolean")
    files = spark.createDataFrame([(1, "x", "A"), (2, "y", "A"), (2, "x", "M"), (3, "y", "D"), (3, "z", "A"), (3, "w", "D")], "commit long, path string, status string")
    got = history.digest(commits, files, F.lit("2024-01-01").cast("timestamp")).first().asDict()
    assert got == {"commits": 3, "authors": 2, "files": 4, "added": 2, "deleted": 2}


@pytest.mark.parametrize("block", [graph.STEM_BLOCK, 2])
def test_references_are_substrings(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "STEM_BLOCK", block)
    files = spark.createDataFrame([("a/main.go", "uses utility and main"), ("b/util.go", "x"), ("c/main.py", "domain"), ("d/é.md", "é util"), ("e/lone.go", None)], "path string, body string")
    assert rows(graph.reference_counts(files), "path", "refs") == [("a/main.go", 1), ("b/util.go", 2), ("c/main.py", 1), ("d/é.md", 0), ("e/lone.go", 0)]


@pytest.mark.parametrize("block", [graph.STEM_BLOCK, 20])
def test_references_agree_with_a_search_of_every_body(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "STEM_BLOCK", block)
    rng = random.Random(5)
    stems = ["".join(rng.choices("abé𝄞_", k=rng.randint(1, 9))) for _ in range(60)]
    data = [(f"d{k}/{s}.md", None if k == 7 else "".join(rng.choices(["", "ab", *stems, "aaaaaaaaaaaa", "\n"], k=rng.randint(0, 8)))) for k, s in enumerate(stems)]
    data += [("x/.md", "ab"), ("y/a.md", ""), ("z/a.md", "a"), ("z/long.md", "b" * 5000 + "long")]
    files = spark.createDataFrame(data, "path string, body string")
    stem = {r["path"]: r["stem"] for r in files.select("path", T.stem(F.col("path")).alias("stem")).collect()}
    want = sorted((p, sum(1 for q, b in data if q != p and stem[p] in (b or "")) if stem[p] else 0) for p, _ in data)
    assert rows(graph.reference_counts(files), "path", "refs") == want
    assert graph.reference_counts(files.where("false")).count() == 0


def test_references_of_many_stems_take_one_pass(spark):
    names = spark.range(120_000).select(F.format_string("x/n%06d.md", "id").alias("path"), F.lit("").alias("body"))
    files = names.unionAll(spark.createDataFrame([("y/a.md", "n000007 n119999n000007"), ("y/b.md", "n0000071"), ("n000007.txt", "n000007")], "path string, body string"))
    got = graph.reference_counts(files)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    assert rows(got.where("refs > 0"), "path", "refs") == [("n000007.txt", 2), ("x/n000007.md", 3), ("x/n119999.md", 1)]
    asked = graph.reference_counts(files, F.col("path").startswith("n"))
    assert rows(asked, "path", "refs") == [("n000007.txt", 2)]


def test_secret_edges_allowances_and_entropy(spark):
    key = "AKIA" + "0123456789ABCDEF"
    lines = [f"é{key}", f"_{key}", f"{key} # sample", "x = 'aB3dE5gH7jK9mN1pQ2rS4tU6'", "aaaaaaaaaaaaaaaaaaaaaaaa", f"{key}é"]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "path string, line_no long, text string")
    assert rows(scan.warnings(df), "line_no", "kind") == [(0, "aws_access_key"), (2, "aws_access_key"), (5, "aws_access_key")]
    assert rows(scan.warnings(df, allow=("sample", "")), "line_no") == [(0,), (5,)]
    assert ("f", 3, "high_entropy") in rows(scan.warnings(df, entropy=True), "path", "line_no", "kind")
    long_runs = rows(scan.entropy_warnings(df, (key, "")), "line_no", "candidate")
    assert long_runs == [(3, "aB3dE5gH7jK9mN1pQ2rS4tU6")]
    assert scan.entropy_warnings(df, (key, "x =")).count() == 0
    files = spark.createDataFrame([("f", "\n".join(lines)), ("g", "plain")], "path string, body string")
    assert rows(scan.scan_files(files), "path", "line_no") == [("f", 1), ("f", 3), ("f", 6)]
    keyed = [("k", n, t) for n, t in enumerate(["a", "-----BEGIN PRIVATE KEY-----", "MIIabc", "-----END PRIVATE KEY-----", "b"])] + [("l", 0, "MIIabc")]
    out = scan.redact(spark.createDataFrame(keyed, "path string, line_no long, text string"))
    assert [t for _, t in rows(out, "line_no", "text") if t in ("a", "b", "MIIabc")] == ["MIIabc", "a", "b"]


def test_globs_of_allow_lists(spark):
    paths = ["dir/a", "x/dir/b", "dirt/c", "dir/e/f", "a[1]/x"]
    for glob, want in (("dir/**", ["dir/a", "dir/e/f", "x/dir/b"]), ("dir/*", ["dir/a"]), ("di?/a", ["dir/a"]), ("a[1]/**", ["a[1]/x"])):
        assert [p for p, x in zip(paths, values(spark, paths, lambda c: c.rlike(scan.glob_regex(glob))), strict=True) if x] == sorted(want, key=paths.index), glob  # noqa: B023


def test_binary_heads(spark):
    cases = [(b"", False), (b"0\n\x00", True), (b"\x30\x0a\x30", False), (b"a" * 511 + "é".encode(), False), (b"a" * 510 + "日".encode(), False), (b"a" * 509 + "😀".encode(), False)]
    cases += [(b"a" * 511 + b"\xff", True), (b"ab\xff", True), (b"a" * 510 + b"\xe0\x80", True), (b"a" * 600 + b"\x00", False), (b"ok\xc3", False), (b"\xc3(", True)]
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(cases)], "k long, b binary")
    assert [r["x"] for r in df.select("k", filters.is_binary(F.col("b")).alias("x")).orderBy("k").collect()] == [w for _, w in cases]
    blobs = spark.createDataFrame([(1, bytearray(b"a" * 7999 + b"\x00")), (2, bytearray(b"a" * 8000 + b"\x00"))], "k long, b binary")
    assert rows(blobs.select("k", filters.is_binary_blob(F.col("b")).alias("x")), "k", "x") == [(1, True), (2, False)]


def test_ignore_lines_and_pack_filters(spark):
    assert filters.ignore_rule("# note") is None and filters.ignore_rule("   # note") is not None
    paths = ["a.log", "x/a.log", "tmp/x/y", "doc/tmp", "z/node_modules/q", "keep.GO", "k.rs"]
    assert values(spark, paths, lambda c: filters.pack_ignored(c, ["# c", "!keep", "*.log", "tmp/"])) == [True, True, True, False, False, False, False]  # a file named as the folder stays
    paths_below = ["build", "build/g", "src/build/g", "src/rebuild/g", "rebuild", "dist/a", "x/dist/a", "a.log/b", "x/tmp.d/a"]
    assert values(spark, paths_below, lambda c: filters.pack_ignored(c, ["build/", "dist/**", "/x/", "a.*", "tmp"])) == [True, True, True, False, False, True, False, True, False]
    assert values(spark, paths, filters.hard_skipped) == [False] * 4 + [True] + [False] * 2
    assert values(spark, paths, filters.api_only) == [False] * 5 + [True, False]


def test_previews_count_bytes_and_entropy_counts_all(spark):
    assert values(spark, ["twelve bytes", "thirteen byte", "éééééééé", "日本語テキスト", None], T.preview) == ["twelve bytes", "thir[...]byte", "éé[...]éé", "日[...]ト", None]
    got = values(spark, ["", "aaaa", "ab", "abcd" * 500, "aab"], T.entropy)
    assert [round(x, 6) for x in got] == [0.0, 0.0, 1.0, 2.0, 0.918296]
    texts = ["éa😀é\n.$^\\d", "日本語日本", "a" * 7 + "\x00é" * 3, None]
    want = [t and sum(-t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    assert [x and round(x, 9) for x in values(spark, texts, T.entropy)] == [w and round(w, 9) for w in want]
    long = spark.range(64).select(F.repeat(F.concat(F.lit("abcdefgh"), "id"), 20_000).alias("v"))
    began = time.perf_counter()
    assert long.select(T.entropy(F.col("v")).alias("x")).where("x > 3").count() == 64
    assert time.perf_counter() - began < 20  # 12 million characters; a fold over all of them takes far longer


def test_comments(spark):
    assert values(spark, ['import a; // import "./c"\nb /* x\n */ c'], T.strip_comments) == ["import a; \nb  c"]


def test_declarations(spark):
    lines = [("a.go", 1, "func (x) ("), ("a.go", 2, "func (r *T) M() {"), ("b.jsx", 3, "let f = async x => x"), ("b.jsx", 4, "let g = 3 >= 2")]
    got = S.code_symbols(spark.createDataFrame(lines, "path string, line_no long, text string"))
    assert rows(got, "name", "kind", "line") == [("M", "function", 2), ("f", "function", 3)]


def test_periods():
    now = datetime(2024, 5, 10, tzinfo=UTC)
    assert T.period_start("2024-02-03", now) == datetime(2024, 2, 3, tzinfo=UTC)
    assert T.period_start("1h30m", now) == datetime(2024, 5, 9, 22, 30, tzinfo=UTC)
    for bad in ("soon", "2024-13-01", ""):
        with pytest.raises(ValueError):
            T.period_start(bad, now)
