"""What a task gets doesn't grow with the tables: pieces are dealt by the rows there are, with the same results."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import graph, history, select
from corvane.plans import base, link_queries
from corvane.sources import tables as S
from tests.conftest import SMALL


def found(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_order_lines_are_dealt_by_their_number(spark, monkeypatch):
    want = found(base.commit_files(spark, SMALL)), found(history.changed_summary(base.commit_files(spark, SMALL)))
    monkeypatch.setattr(S, "LINES_EACH", 500)
    files = base.commit_files(spark, SMALL)
    summary = history.changed_summary(files)
    assert files.rdd.getNumPartitions() == summary.rdd.getNumPartitions() == 12  # 6,000 lines
    assert (found(files), found(summary)) == want


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    commits = spark.range(300).select(F.col("id").alias("commit"), F.lit(None).cast("timestamp").alias("at"))
    files = commits.select("commit", F.explode(F.sequence(F.lit(1), F.col("commit") % 60)).alias("path")).where("path between 1 and commit")
    want = found(history.pairs(commits, files, min_weight=1))
    n = sum(r[2] for r in want)
    monkeypatch.setattr(history, "PAIRS_EACH", n // 9)
    got = history.pairs(commits, files, min_weight=1)
    assert got.rdd.getNumPartitions() in (9, 10) and found(got) == want and len(want) == 50 * 49 // 2
    assert found(history.pairs(commits, files.where("false"))) == []


def test_lines_of_a_path_are_dealt_by_files(spark, monkeypatch):
    monkeypatch.setattr(S, "FILES_EACH", 20)
    rows = base.gathered_lines(spark, SMALL)
    assert rows.rdd.getNumPartitions() == 10 and found(rows) == found(base.lines(spark, SMALL))
    marked = lambda df: df.select("path", F.col("line_no").alias("n"), (F.col("line_no") % 13 == 0).alias("changed"), "text")
    folded = select.fold_lines(marked(rows))
    assert "RepartitionByExpression" in folded._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(map(str, r)) for r in folded.collect()} == {tuple(map(str, r)) for r in select.fold_lines(marked(base.lines(spark, SMALL))).collect()}


def test_line_scripts_are_handed_on_in_pieces(spark, monkeypatch):
    texts = [(f"p{k}", "\n".join("abc"[: k % 4]), "\n".join("axc"[k % 3 :])) for k in range(50)] + [("none", None, None), (None, "x", "y")]
    monkeypatch.setattr(select, "SCRIPT_CHARS", 7)
    got = select.changed_lines(spark.createDataFrame(texts, "path string, before string, after string"))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # rows of a batch at once before
    want = [(p, n, o, t) for p, a, b in texts for n, (o, t) in enumerate(select.line_script(a or "", b or ""), 1)]
    assert sorted(map(str, ((r["path"], r["n"], r["op"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_names_of_a_second_hop_meet_words_where_they_are(spark, monkeypatch):
    args = base.files(spark, SMALL), base.lines(spark, SMALL), base.symbols(spark, SMALL), "Hand", 2, ("md",)
    near = graph.focus(*args)
    assert "strategy=broadcast" in near._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(graph, "NAMES_SENT", 0)
    far = graph.focus(*args)
    assert "strategy=broadcast" not in far._jdf.queryExecution().optimizedPlan().toString()
    assert found(near) == found(far) and len(found(near)) > 0


def test_files_of_any_length_have_a_shortest_script(spark, tmp_path):
    long = "\n".join(map(str, range(5_200)))  # over 25 million cells
    texts = [long, "\n".join(f"{k % 37} {k % 11}" for k in range(5_300)), "\n".join("ab" * 2_600), "a\n\n", "a\nb\n\n", "\n\n", "a\nb\n", "a\nb", "a", None]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": 1})
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    want = con.execute(base.ORACLE_SQL["w15_line_diff"]).fetchall()
    got = [(r["path"], r["removed"], r["added"]) for r in link_queries.w15(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 8


def test_line_scripts_of_long_texts_take_the_same_walk():
    def walk(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                yield "=", a[i]
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                yield "-", a[i]
                i += 1
            else:
                yield "+", b[j]
                j += 1
        yield from [("-", s) for s in a[i:]] + [("+", s) for s in b[j:]]

    draw = random.Random(4)
    for size, kinds in ((12, 2), (40, 3), (300, 4), (300, 60), (700, 30)):
        a = [str(draw.randrange(kinds)) for _ in range(size)]
        b = [str(draw.randrange(kinds + 2)) for _ in range(size - 5)]
        near = [s for s in a for s in ([s] if draw.random() > 0.1 else [] if draw.random() > 0.5 else [s, str(draw.randrange(kinds + 2))])]
        for x, y in ((a, b), (b, a), (a, near), (near, a)):
            assert select.line_script("\n".join(x), "\n".join(y)) == list(walk(x, y))
    a = [f"{k % 1_000}" for k in range(6_000)]
    b = [*a[:100], *a[140:3_000], "new", *a[3_000:5_000], *a[100:140], *a[5_000:]]
    script = select.line_script("\n".join(a), "\n".join(b))
    assert [s for o, s in script if o != "+"] == a and [s for o, s in script if o != "-"] == b
    assert sum(o == "-" for o, _ in script) == 40 and sum(o == "+" for o, _ in script) == 41  # all 6,000 and 6,001 before
