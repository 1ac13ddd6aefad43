"""Operators that have no SQL, and cases the star-schema tables don't hold."""

import time

import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import contract, echo, filters, heat, imports, scan
from corvane.operators import select as X
from corvane.sources import tables as S
from corvane.streaming import watch


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_terms():
    assert T.query_terms("The big_Cat and the-dog, a CAT") == ["big_cat", "the-dog", "cat"]
    assert T.query_terms("a") == ["a"]
    assert T.goal_terms("ログインを調べたい") == ["login", "auth", "session", "ログイン"]
    assert T.duration_seconds("1h30m") == 5400


def test_read_files_and_symbols(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def run():\n    pass\nclass Thing:\n    pass\n")
    (tmp_path / "src" / "b.go").write_text("package x\nfunc (t *T) Go() {}\ntype T struct {}\n")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00")
    files = S.read_files(spark, str(tmp_path))
    assert rows(files, "path") == [("src/a.py",), ("src/b.go",)]
    assert rows(S.code_symbols(S.lines_of(files)), "path", "name", "kind", "line") == [
        ("src/a.py", "Thing", "class", 3), ("src/a.py", "run", "function", 1), ("src/b.go", "Go", "function", 2), ("src/b.go", "T", "type", 3),
    ]


def test_log_source(spark):
    raw = spark.createDataFrame([("\x1f".join(["h%d" % k, "h", "Ann", "a@x", str(k), "p q" if k else "", "did it"]),) for k in range(4)], "value string")
    got = S.parse_log(raw, 3).orderBy(F.desc("at")).collect()
    assert [(r["commit"], r["parents"], r["truncated"]) for r in got] == [("h3", ["p", "q"], True), ("h2", ["p", "q"], True), ("h1", ["p", "q"], True)]


def test_ignore_rules(spark):
    paths = ["a/b.md", "a/keep.md", "node_modules/x/y.js", "src/gen/z.go", "docs/deep/x.tmp", "q?.txt", "top.log", "sub/top.log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = filters.drop_ignored(df, ["# note", "*.md", "!keep.md", "node_modules/", "src/gen", "docs/**/x.tmp", "q?.txt", "/top.log"])
    assert rows(kept, "path") == [("a/keep.md",), ("sub/top.log",)]
    shut = filters.drop_ignored(df, ["a/", "!a/keep.md"])
    assert ("a/keep.md",) not in rows(shut, "path")


def test_globs_and_paths(spark):
    df = spark.createDataFrame([("src/a.ts",), ("src/x/a.test.ts",), ("lib/b.ts",), ("README.md",)], "path string")
    assert rows(df.where(filters.allowed(F.col("path"), ["{src,lib}/**/*.ts"], ["*.test.ts"])), "path") == [("lib/b.ts",), ("src/a.ts",)]
    secret = spark.createDataFrame([(".env",), ("a/.ssh/id",), ("k.pem",), ("ok.txt",)], "path string")
    assert rows(secret.where(filters.is_secret_path(F.col("path"))), "path") == [(".env",), ("a/.ssh/id",), ("k.pem",)]


def test_secret_patterns(spark):
    lines = ["key AKIA" + "A" * 16 + " end", "x = ghp_" + "a" * 40, 'api_key = "' + "z" * 20 + '"', "clean", "MY_SECRET=abcdefghijkl1234"]
    df = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(lines)], "path string, line_no long, text string")
    assert rows(scan.warnings(df), "line_no", "kind") == [(1, "aws_access_key"), (2, "github_pat"), (3, "generic_secret"), (5, "env_assignment")]
    assert rows(scan.warnings(df, allow=("AKIA",), allow_files=("g*",)), "line_no", "kind")[0] == (2, "github_pat")
    assert not scan.warnings(df, allow_files=("f",)).collect()


def test_private_key_redaction(spark):
    body = ["a", "-----BEGIN RSA PRIVATE KEY-----", "abcDEF12", "gh+/=", "-----END RSA PRIVATE KEY-----", "b", "-----BEGIN PRIVATE KEY-----", "not a key! at all?", "c"]
    df = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(body)], "path string, line_no long, text string")
    out = [r["text"] for r in scan.redact(df).orderBy("line_no").collect()]
    assert [t.startswith("[REDACTED") for t in out] == [False, True, True, True, True, False, True, False, False]


def test_imports(spark):
    files = [
        ("src/a.ts", 'import {x} from "./b"; // import y from "./c"\n'), ("src/b.ts", ""), ("src/c.ts", ""), ("pkg/m.py", "from .n import q\nimport os\n"), ("pkg/n.py", ""),
    ]
    df = spark.createDataFrame(files, "path string, body string")
    assert ("src/a.ts", "src/b.ts") in rows(imports.import_edges(df), "src", "dst")
    assert ("pkg/m.py", "pkg/n.py") in rows(imports.import_edges(df), "src", "dst")


def test_treemap_covers_the_map():
    cells = heat.layout([6, 6, 4, 3, 2, 2, 1], 6, 4)
    assert len(cells) == 7 and all(w >= 1 and h >= 1 for _, _, w, h in cells)
    assert heat.layout([], 5, 5) == [] and heat.layout([1], 5, 5) == [(0, 0, 5, 5)]


def test_line_script_walks_from_the_start_and_parts_at_newlines_alone():
    said = lambda a, b, **k: "".join(o + t for o, t in X.line_script(a, b, **k))
    assert said("c\na\n", "a\nb\na\n") == "-c=a+b+a"
    assert said("x\r\n", "x\n") == "-x\r+x" and said("a\fb", "a\fc") == "-a\fb+a\fc" and said("a\u2028b\n", "a\u2028b") == "=a\u2028b"
    assert said("", "\n") == "+" and said("a\n\n", "a\n") == "=a-" and said("", "") == ""
    assert said("a\nb\nc", "a\nx\nc", cells=15) == "-a-b-c+a+x+c" and said("a\nb\nc", "a\nx\nc", cells=16) == "=a-b+x=c"


def test_line_script_rebuilds_both_texts():
    a, b = "a\nb\nc\nd\ne", "a\nx\nc\ne\nf"
    ops = X.line_script(a, b)
    assert [t for o, t in ops if o != "+"] == a.split("\n") and [t for o, t in ops if o != "-"] == b.split("\n")
    assert sum(o == "=" for o, _ in ops) == 3
    whole = X.line_script(a, b, cells=1)
    assert [t for o, t in whole if o != "+"] == a.split("\n")


def test_embedded_contract(spark):
    schema = "struct<schema_version:int,files:array<string>>"
    packs = spark.createDataFrame([(1, "body", (1, ["a"]))], f"id int, body string, contract {schema}")
    text = contract.embed(packs)
    twice = text.withColumn("text", F.concat("text", F.lit('<!-- contract:{"schema_version":2,"files":["b"]} -->')))
    assert contract.parse_embedded(twice, schema).first()["contract"]["schema_version"] == 2


def test_prune_keeps_unreadable_times(spark):
    df = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("b", "2030-01-01 00:00:00"), ("c", "soon")], "id string, created_at string")
    assert rows(contract.prune(df, F.lit("2025-01-01").cast("timestamp")), "id") == [("b",), ("c",)]


def test_file_blocks(spark):
    text = ["intro", "### a.py", "```py", "### no heading", "x = 1", "```", "said", "## end", "out"]
    df = spark.createDataFrame([("p", k + 1, t) for k, t in enumerate(text)], "path string, line_no long, text string")
    assert rows(echo.file_blocks(df), "file", "text") == [("a.py", "### no heading"), ("a.py", "said"), ("a.py", "x = 1")]


def test_debounce_stream(spark, tmp_path):
    polls = [("r", 0, "A"), ("r", 100, "B"), ("r", 200, "C"), ("r", 450, "C"), ("r", 500, "D"), ("r", 550, "C"), ("r", 900, "C")]
    source = tmp_path / "in"
    source.mkdir()
    pd.DataFrame(polls, columns=["key", "at_ms", "digest"]).to_json(source / "a.json", orient="records", lines=True)
    stream = spark.readStream.schema("key string, at_ms long, digest string").json(str(source))
    query = watch.debounce(stream, 200).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(240):
            if query.exception() or spark.table("events_out").count() >= 2:
                break
            time.sleep(0.5)
        assert query.exception() is None
        assert rows(spark.table("events_out"), "event", "digest") == [(1, "A"), (2, "C")]
    finally:
        query.stop()


def test_stores(spark, tmp_path):
    from corvane.sources import stores

    store = stores.ManifestStore(spark, str(tmp_path / "m"))
    entries = [("a.py", "s", 3, "High", 12, "r"), ("b.py", "t", 4, "Low", 1, "r")]
    for k in (2, 1):
        store.save(spark.createDataFrame([(1, f"id{k}", f"2024-0{k}-01", "g", 9, 7, entries, [])], stores.MANIFEST), f"id{k}")
    assert [r["id"] for r in store.list().collect()] == ["id1", "id2"]
    assert rows(store.entries("id1"), "ord", "path", "tokens") == [(0, "a.py", 3), (1, "b.py", 4)]
    for bad in ("../x", ".hidden", ""):
        try:
            store.load(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    mixes = spark.createDataFrame([("1", "x", "g", 1, ["a"]), ("2", "x", "g", 1, ["b"]), ("3", "y", "g", 1, ["c"])], stores.MIX)
    assert [r["id"] for r in stores.find_mix(mixes, "y").collect()] == ["3"]
    assert [r["id"] for r in stores.find_mix(mixes, "2").collect()] == ["2"]
    assert stores.find_mix(mixes, "x").collect() == []


def test_options():
    from corvane.functions import options

    assert options.with_preset({"format": "xml", "explain": None}, "debug")["format"] == "xml"
    assert options.with_preset({}, "debug")["explain"] is True
    assert options.strand_source("where 'two words' --limit 3") == ["where", "two words", "--limit", "3"]


def test_treemap_svg():
    from corvane.operators import render

    assert render.treemap_svg([("a<b", 0, 0, 2, 1)]).count("<rect") == 1 and "a&lt;b" in render.treemap_svg([("a<b", 0, 0, 2, 1)])


def test_embeds_and_public_lines(spark):
    from corvane.operators import render

    df = spark.createDataFrame([("a.py", "x" * 3, 1)], "path string, body string, tokens long")
    assert render.pack_rows(df, "json").first()["text"] == '{"path":"a.py","tokens":1,"content":"xxx"}'
    assert render.pack_rows(df, "plain").first()["text"] == "== a.py ==\nxxx\n"
