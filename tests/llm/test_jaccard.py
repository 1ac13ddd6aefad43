"""The n-gram Jaccard join against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from corvane.llm import jaccard
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i if i is not None else -1, len(sets[k]), least.get(top(k), -1)) for k, (i, _) in enumerate(rows))


def ours(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, n int, grp string").repartition(parts)
    return sorted(tuple(-1 if x is None else x for x in r) for r in jaccard.components(table).collect())


def near_copies(rng, seeds=12, copies=14, words=120):
    """Chains and stars of edited texts around the threshold, of several sizes, with a passage that all share."""
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for s in range(seeds):
        text = rng.choices(vocabulary, k=rng.randint(5, words)) + (passage if s % 2 else [])
        for _ in range(copies):
            text = list(text) if rng.random() < 0.5 else text
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                at, kind = rng.randrange(len(text)), rng.random()
                text = text[:at] + ([] if kind < 0.3 else [rng.choice(vocabulary)]) + text[at + (0 if kind > 0.7 else 1) :]
                text = text or ["w1"]
            out.append(" ".join(text))
    return out


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_near_copies(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = list(enumerate(near_copies(rng)))
    rng.shuffle(rows)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows)
    if seed:  # large groups in many blocks, many deals of queries, nothing broadcast
        for name, value in (("BLOCK_BYTES", 3000), ("QUERIES", 2), ("BROADCAST_ROWS", 0), ("SEEN", 3)):
            monkeypatch.setattr(jaccard, name, value)
    assert ours(spark, rows) == want


@pytest.mark.parametrize("shared", [0, 3])
def test_tokens_of_many_groups(spark, shared, monkeypatch):
    """All pairs, or those of tokens that more than three groups share, are made within the bound alone."""
    monkeypatch.setattr(jaccard, "SHARED_GROUPS", shared)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3_000)
    rows = list(enumerate(near_copies(random.Random(7), seeds=6, copies=25, words=150)))
    assert ours(spark, rows) == brute(rows)


def test_hard_rows(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B\n"), (5, "a  B\n"), (None, "a b"), (6, "one two three four"), (7, "ONE two three four five"),
        (8, long), (9, long + " y"), (10, "é ß"), (11, "É ß"), (12, "\x1c"), (13, "a\xa0b"), (None, None), (14, "a b a b a b a b"), (15, "b a b a b a b a b"),
    ]
    assert ours(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None)]) == [(1, 0, 1)]


def test_union_bounds_overlap():
    a, b = np.arange(100, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)
    block = jaccard.Block([a, b])
    assert block.linked(a, 85).tolist() == [0]
    assert block.linked(np.arange(30, 200, dtype=np.uint64), 85).tolist() == []
    assert block.linked(np.arange(1, 101, dtype=np.uint64), 85).tolist() == [0]


def test_tokens_round_trip():
    tokens = np.array([0, 1, 2**48 - 1, 2**40], np.uint64)
    assert jaccard.unpack(jaccard.pack(tokens)).tolist() == tokens.tolist() and len(jaccard.pack(tokens)) == 24


def test_prefix_is_the_rarest_part():
    tokens = np.arange(0, 2**47, 2**47 // 200, dtype=np.uint64)
    cells = np.zeros(1024, np.uint32)
    cells[:256] = 9
    head = jaccard.prefix(tokens, cells, 85)
    assert len(head) == len(tokens) - -(-85 * len(tokens) // 100) + 1 and (head >> np.uint64(38)).min() >= 256
