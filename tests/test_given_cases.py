"""Inputs with a known result for operators whose queries are fed from whole tables."""

import pytest

from corvane.functions import text as T
from corvane.operators import changes, contract, search, select
from tests.test_exact_cases import rows, values


def test_references_of_responses(spark):
    said = [
        (1, "see src0/fr/doc_0.md:1-2 and src1/en/doc_1.md"), (2, "the `The` and `Nope.Missing` of src9/xx/doc_0.md:3"),
        (3, "+++ b/src2/en/doc_2.md"), (4, "SRC0/FR/DOC_0.MD is it, `x.py` no symbol\nsrc1/en/doc_1.md:1-9999"), (5, "nothing here"), (6, None), (7, ""),
    ]
    found = contract.references(spark.createDataFrame(said, "id int, text string"))
    assert {tuple(r) for r in found.collect()} == {
        (1, "line-range", "src0/fr/doc_0.md", 1, 2, None, 1), (1, "file", "src1/en/doc_1.md", None, None, None, 1), (2, "symbol", None, None, None, "The", 1),
        (2, "symbol", None, None, None, "Nope.Missing", 1), (2, "line-range", "src9/xx/doc_0.md", 3, 3, None, 1), (3, "diff-header", "src2/en/doc_2.md", None, None, None, 1),
        (4, "file", "SRC0/FR/DOC_0.MD", None, None, None, 1), (4, "file", "x.py", None, None, None, 1), (4, "line-range", "src1/en/doc_1.md", 1, 9999, None, 2),
    }


def test_search_results_of_two_forms(spark):
    raw = [(1, '[{"path":"./a.py","score":3},{"path":"b.py","score":9},{"path":"a.py","score":1}]'), (2, "x/./y.ts\n# note\n\nx/y.ts\nz.md"), (3, "null"), (4, "[]"), (5, None)]
    got = search.parse_results(spark.createDataFrame(raw, "id int, value string"))
    assert rows(got, "id", "path", "ord") == [(1, "a.py", 1), (1, "b.py", 0), (2, "x/y.ts", 0), (2, "z.md", 2)]


def test_paths_of_lines_and_of_a_difference(spark):
    raw = [(1, "a.py\n# note\nb/c.go\na.py\n"), (2, "diff --git a/x/y.ts b/x/y.ts\n+++ b\ndiff --git a/z.md b/z.md\n"), (3, ""), (4, None)]
    got = changes.stdin_paths(spark.createDataFrame(raw, "id int, value string"))
    assert rows(got, "id", "path", "ord") == [(1, "a.py", 0), (1, "b/c.go", 2), (2, "x/y.ts", 0), (2, "z.md", 2)]


def test_lines_without_a_hit_merge(spark):
    profile = ["a.go:3.1,5.2 2 0", "a.go:5.3,9.1 1 0", "a.go:10.1,11.1 4 7", "a.go:12.1,13.1 1 0", "b.go:1.1,1.9 1 0", "mode: set", ""]
    got = changes.uncovered(spark.createDataFrame([(r,) for r in profile], "value string"))
    assert rows(got, "path", "first", "last") == [("a.go", 3, 9), ("a.go", 12, 13), ("b.go", 1, 1)]


def test_mentions_and_clean_paths(spark):
    text = [(1, "fix a/b.py:3-7 and ./c.md"), (2, "at x.go#L12, twice x.go#L12"), (3, None)]
    got = {tuple(r) for r in select.mentions(spark.createDataFrame(text, "id int, text string")).collect()}
    assert got == {(1, "a/b.py", 3, 7), (1, "c.md", None, None), (2, "x.go", 12, 12)}
    assert values(spark, ["a/./b/../c", "/x/../../y", "./", "../a/b/..", "a//b/", "/"], T.clean_path) == ["a/c", "/y", ".", "../a", "a/b", "/"]


@pytest.mark.parametrize("verdicts, want", [(["ok", "out-of-context", "out-of-context", "phantom-symbol"], [("out-of-context", 2, 1), ("phantom-symbol", 1, 1)]), (["ok"], [])])
def test_violations_by_verdict(spark, verdicts, want):
    got = changes.violations(spark.createDataFrame([(v,) for v in verdicts], "verdict string"))
    assert rows(got, "verdict", "references", "exit_code") == want


def test_tests_meet_sources_by_name_folder_package_and_words(spark):
    files = [("p/a_test.go", "Alpha() Beta() Gamma", "p_test"), ("p/a.go", "", "p"), ("p/b.go", "", "p"), ("q/c.go", "", "q"), ("r/d_test.go", None, "r")]
    names = [("p/a.go", "Alpha"), ("p/a.go", "Beta"), ("q/c.go", "Gamma"), ("p/b.go", "Delta")]
    got = changes.test_links(spark.createDataFrame(files, "path string, body string, package string"), spark.createDataFrame(names, "path string, name string"))
    assert rows(got, "test", "source", "score") == [("p/a_test.go", "p/a.go", 95), ("p/a_test.go", "p/b.go", 35), ("p/a_test.go", "q/c.go", 5)]
