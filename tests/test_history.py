"""First-parent logs against a plain walk."""

import random

from pyspark.sql import functions as F

from corvane.operators import history


def walk(parents, head):
    out = []
    while head in parents:
        out.append(head)
        head = parents[head][0] if parents[head] else None
    return out


def test_first_parents_of_branching_histories(spark):
    rng = random.Random(7)
    for n in (1, 2, 9, 200):
        parents = {k: rng.sample(range(max(0, k - 4), k), min(k, rng.choice([1, 1, 2]))) for k in range(n)}
        parents[n // 3] = [10**6] if n > 100 else parents[n // 3]  # a shallow history: the parent is not there
        table = spark.createDataFrame([(k, p) for k, p in parents.items()], "commit long, parents array<long>").repartition(3)
        for head in {n - 1, n // 2}:
            got = history.first_parents(table, F.lit(head)).collect()
            assert [c for _, c in sorted((r["depth"], r["commit"]) for r in got)] == walk(parents, head)
    assert not history.first_parents(table, F.lit(-5)).collect()


def test_path_log_sees_content_that_comes_and_goes(spark):
    chain = spark.createDataFrame([(f"c{k}", k) for k in range(7)], "commit string, depth long")  # c0 is the newest
    blobs = {"a": ["2", "2", None, "1", "1", None, None], "b": ["x"] * 7, "c": [None, "y", None, "y", None, "y", None]}
    versions = spark.createDataFrame([(f"c{k}", p, b) for p, bs in blobs.items() for k, b in enumerate(bs) if b], "commit string, path string, blob string")
    want = {p: [k for k in range(7) if bs[k] != (bs[k + 1] if k < 6 else None)] for p, bs in blobs.items()}
    for limit in (2, 3, 10):
        got = history.path_log(chain, versions, limit).collect()
        for p, ks in want.items():
            mine = sorted((r["rank"], r["depth"], r["commit"], r["truncated"]) for r in got if r["path"] == p)
            assert mine == [(i + 1, k, f"c{k}", len(ks) > limit) for i, k in enumerate(ks[:limit])]


def test_long_histories_are_shortened_first(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(history, "WALK_ROWS", 60)
    monkeypatch.setattr(history, "staged", lambda df, f=history.staged: tables.append(f(df)) or tables[-1])
    rng = random.Random(3)
    for n in (61, 250):
        names = [f"{rng.getrandbits(60):015x}" for _ in range(n)]
        parents = {names[k]: [names[p] for p in rng.sample(range(max(0, k - 3), k), min(k, rng.choice([1, 2])))] for k in range(n)}
        parents[names[n // 4]] = ["gone"]
        table = spark.createDataFrame(list(parents.items()), "commit string, parents array<string>").repartition(3)
        for head in (names[-1],):
            tables.clear()
            got = history.first_parents(table, F.lit(head)).collect()
            assert [c for _, c in sorted((r["depth"], r["commit"]) for r in got)] == walk(parents, head)
            assert sorted(r["depth"] for r in got) == list(range(len(got)))
    assert sum("span" in t.columns and "depth" not in t.columns for t in tables) > 3  # rounds before the doubling
    assert not history.first_parents(table, F.lit("none")).collect()


def test_path_log_across_blocks_of_depths(spark, monkeypatch):
    monkeypatch.setattr(history, "DEPTH_BLOCK", 3)
    rng = random.Random(9)
    n = 40
    chain = spark.createDataFrame([(f"c{k}", k) for k in range(n)], "commit string, depth long")
    blobs = {p: [rng.choice([None, "x", "x", "y"]) for _ in range(n)] for p in "abcdef"}
    versions = spark.createDataFrame([(f"c{k}", p, b) for p, bs in blobs.items() for k, b in enumerate(bs) if b], "commit string, path string, blob string")
    got = history.path_log(chain, versions, 100)
    shuffles = got._jdf.queryExecution().optimizedPlan().toString().count("FullOuter")
    assert shuffles == 0  # versions meet their neighbours without a second copy of them
    found = got.collect()
    for p, bs in blobs.items():
        want = [k for k in range(n) if bs[k] != (bs[k + 1] if k + 1 < n else None)]
        mine = sorted((r["rank"], r["depth"], r["commit"]) for r in found if r["path"] == p)
        assert mine == [(i + 1, k, f"c{k}") for i, k in enumerate(want)]
