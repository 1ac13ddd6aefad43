"""Differences, patches, refs and stored objects against small cases and a real store."""

import subprocess

import pytest
from pyspark.sql import functions as F

from corvane.operators import contract, revisions


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_records_with_odd_bytes(spark):
    raw = spark.createDataFrame([(1, "\nM\x00a\tb\x00\x00R100\x00R1\x00C2\x00A\x00x\x00R5\x00cut"), (2, ""), (3, None)], "commit long, value string")
    assert found(revisions.parse_name_status(raw).fillna(""), "path", "old_path", "status") == [("C2", "R1", "R100"), ("a\tb", "", "M"), ("x", "", "A")]
    raw = spark.createDataFrame([(1, "\n1\t2\ta\tb\x003\t4\t\x00old\x00new\x00-\t-\tbin\x00x\t\tbad\x00")], "commit long, value string")
    assert found(revisions.parse_numstat_records(raw), "path", "added", "deleted", "binary") == [("a\tb", 1, 2, False), ("bad", 0, 0, False), ("bin", 0, 0, True), ("new", 3, 4, False)]


def test_shown_lines_say_when_there_are_more(spark):
    pairs = spark.createDataFrame([("a", "1\n2\n3", "1\n9\n3", False, False), ("b", "x", "x", False, True)], "path string, before string, after string, binary boolean, no_change boolean")
    assert found(revisions.shown_lines(pairs, 3), "n", "op", "text", "truncated") == [(1, "=", "1", True), (2, "-", "2", True), (3, "+", "9", True)]
    assert {r["truncated"] for r in revisions.shown_lines(pairs).collect()} == {False}


def test_patches_apply(spark, tmp_path):
    before, after = {"a.py": "1\n2\n3\n", "gone.md": "x\n", "r.txt": "k\nl"}, {"a.py": "1\n2\n4\n", "new.md": "y\nz", "r.txt": "k\nm"}
    names = [("a.py", None, "M"), ("gone.md", None, "D"), ("new.md", None, "A"), ("r.txt", None, "M")]
    entries = revisions.patch_entries(spark.createDataFrame(names, "path string, old_path string, status string"), *[spark.createDataFrame(list(x.items()), "path string, body string") for x in (before, after)])
    made = revisions.with_patch(entries)
    for path, body in before.items():
        (tmp_path / path).write_text(body)
    (tmp_path / "all.patch").write_text("".join(r["patch"] for r in made.orderBy("path").collect()))
    subprocess.run(["git", "apply", "all.patch"], cwd=tmp_path, check=True)
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.name != "all.patch"} == after
    text = {r["path"]: r["text"] for r in revisions.render_differences(made, "unified").collect()}
    assert text["a.py"].startswith("```diff\n--- a/a.py\n+++ b/a.py\n") and text["a.py"].endswith("\n```\n\n")
    with pytest.raises(ValueError):
        revisions.render_differences(made, "other")


def test_objects_of_a_store(spark, tmp_path):
    def git(*words):
        return subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *words], cwd=tmp_path, check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "top.txt").write_text("one\n")
    (tmp_path / "d" / "e" / "deep.txt").write_text("two\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "top.txt").write_text("three\n")
    git("commit", "-qam", "second")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / ".git" / "objects"))
    objects = revisions.loose_objects(raw).cache()
    first, second = git("rev-parse", "HEAD~1"), git("rev-parse", "HEAD")
    assert {r["commit"]: r["parents"] for r in revisions.commit_trees(objects).collect()} == {first: [], second: [first]}
    listed = {(c, *line.split("\t")[::-1]) for c in (first, second) for line in git("ls-tree", "-r", "--format=%(objectname)%x09%(path)", c).splitlines()}
    assert {tuple(r) for r in revisions.commit_paths(objects).collect()} == listed
    with pytest.raises(ValueError):
        revisions.commit_paths(objects, depth=2)
    body = objects.where(F.col("kind") == "blob").select(F.decode("body", "utf-8").alias("b"))
    assert found(body, "b") == [("one\n",), ("three\n",), ("two\n",)]


def test_ranges_of_partial_files(spark):
    shown = spark.createDataFrame([("a", n) for n in (2, 3, 4, 8, 9)], "path string, line int")
    cited = [("a", 2, 4), ("a", 4, 2), ("a", 1, 2), ("a", 4, 8), ("a", 9, 9), ("a", 0, 1), ("b", 1, 1), ("a", 5, 7)]
    got = contract.partial_cover(spark.createDataFrame(cited, "path string, line_start int, line_end int"), shown)
    assert {(r["path"], r["line_start"], r["line_end"]) for r in got.where("covered").collect()} == {("a", 2, 4), ("a", 4, 2), ("a", 9, 9)} and got.count() == len(cited)
