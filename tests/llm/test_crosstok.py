"""Cross-tokenizer alignment against whole-text encoding and plain dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from corvane.llm import crosstok
from tests.conftest import SMALL

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "x <|endoftext|> <s> </s> <unk> <0x41> y", "naïve café — 日本語 テスト 🙂🙂 x",
    "▁a b", "a ▁ b", "a\x00b c", "don't can't I'll 12 345 $6,7", "tab\tand nbsp and em　wide x\x1cy z", "\x1c a b\x1c c", "a​ b ﻿ c",
    "word " * 300, "z" * 5000, "ab" * 2000 + " " + "?!" * 500, "same words same words", "same words same words", "\U0010ffff x ́ y", "a b " * 70 + "c",
]


def brute(texts):
    tool = crosstok.Aligner(*PATHS)
    docs = []
    for text in texts:
        whole = b" " + (text or "").encode()
        (ids_a, ids_b), = tool.encode([text]) if text else [([], [])]
        parts_a, parts_b = [tool.bytes_a[i] for i in ids_a], [tool.bytes_b[i] for i in ids_b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            docs.append((0, 0, 0, Counter(), ""))
            continue
        spans = []
        for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
            at, side = 0, []
            for i, p in zip(ids, parts, strict=True):
                side.append((at, at + len(p), i))
                at += len(p)
            spans.append(side)
        starts_b, links = defaultdict(list), Counter()
        cover = [k for k, (lo, hi, _) in enumerate(spans[1]) for _ in range(hi - lo)]
        for lo, hi, a in spans[0]:
            for k in sorted(set(cover[lo:hi])):
                links[a, spans[1][k][2]] += 1
        ends = sorted({hi for _, hi, _ in spans[0]} & {hi for _, hi, _ in spans[1]})
        written, before = [], 0
        for end in ends:
            written.append("|".join(",".join(str(i) for lo, hi, i in side if before <= lo and hi <= end) for side in spans) if len(text) < 1000 else None)
            before = end
        digest = hashlib.sha256(";".join(written).encode()).hexdigest() if len(text) < 1000 else None
        docs.append((len(ids_a), len(ids_b), len(ends), links, digest))
        del starts_b
    count = Counter(pair for d in docs for pair in d[3])
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for n_a, n_b, n_groups, links, digest in docs:
        top = sum(m for (a, b), m in links.items() if count[a, b] == best[a])
        out.append((n_a, n_b, n_groups, sum(links.values()), top, sum(m * count[p] for p, m in links.items()), digest))
    return out


def same(spark, texts):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    ours = {r["doc_id"]: tuple(r)[1:] for r in crosstok.align(rows, *PATHS).collect()}
    assert len(ours) == len(texts)
    for k, want in enumerate(brute(texts)):
        assert ours[k][:6] == want[:6], texts[k]
        assert want[6] is None or ours[k][6] == want[6], texts[k]


def test_given_documents(spark):
    same(spark, [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()])


def test_hard_texts_in_small_batches_with_dealt_ids(spark, monkeypatch):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", "▁", " ", "　", "\x1f", "\x85", "9", "'s", "🙂", "<s>", "́", "​", ".", "—"]
    texts = HARD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    same(spark, texts)
    monkeypatch.setattr(crosstok, "ID_BYTES", 20)  # read on the driver: most ids go to several tasks
    same(spark, texts)


def test_batches_and_forgetting():
    memory = crosstok.Memory(crosstok.aligner(*PATHS))
    first = crosstok._postings(memory, ["one two", None, "two " + "q" * 300])
    assert [d[0] > 0 for d in first[0]] == [True, False, True]
    memory.forget()
    assert not memory.number
    assert crosstok._postings(memory, ["one two", None, "two " + "q" * 300]) == first
    assert crosstok._postings(memory, [None, ""]) == ([(0, 0, 0, 0, "")] * 2, [])


def test_empty_table_nulls_and_repeats(spark):
    schema = "doc_id long, text string, batch int, kind string"
    assert crosstok.align(spark.createDataFrame([], schema), *PATHS).count() == 0
    rows = crosstok.align(spark.createDataFrame([(None, "a b", 1, "k"), (None, "a b", 1, "k"), (3, None, None, None)], schema), *PATHS).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["n_best"], r["count_sum"]) for r in rows) == [(0, 2, 2, 4), (0, 2, 2, 4), (3, 0, 0, 0)]


@pytest.mark.parametrize("text", ["a b", "one  two three", "x\ny z"])
def test_cut_pieces_encode_as_the_whole(text):
    tool = crosstok.aligner(*PATHS)
    pieces = tool.encode(crosstok._CUT.split(text))
    assert tool.encode([text]) == [(sum((p[0] for p in pieces), []), sum((p[1] for p in pieces), []))]


def test_pieces_are_encoded_many_in_a_text(monkeypatch):
    asked, encode = [], crosstok.Aligner.encode
    monkeypatch.setattr(crosstok.Aligner, "encode", lambda tool, texts: asked.extend(texts) or encode(tool, texts))
    plain = [" ".join(f"w{k % 700}o{k * k}é" for k in range(2000)), "w1 w2 w3"]
    mixed = [" w1 a\n", "a ▁b c", "", None, *(f"{w} {w}x {w}\n{w}" for w in ("q" * 150, "日本", "z" * 300, "'s", "c ", "▁")), "\x85a b​ c", *plain]
    tool = crosstok.aligner(*PATHS)
    together = crosstok._postings(crosstok.Memory(tool), plain)
    assert len(asked) <= 2003 / crosstok.TOGETHER + 1
    assert together[0][1][:2] == tuple(len(ids) for ids in encode(tool, ["w1 w2 w3"])[0])
    found = crosstok._postings(crosstok.Memory(tool), mixed)
    assert [d[0] == 0 for d in found[0]].count(True) == 4
    monkeypatch.setattr(crosstok, "TOGETHER", 1)
    assert crosstok._postings(crosstok.Memory(tool), mixed) == found
    assert crosstok._postings(crosstok.Memory(tool), plain) == together
