"""Soft-membership mixing: domain posteriors from a labelled table, then document rates by projected gradient."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import fresh, materialize, small_batches

LOG = logging.getLogger(__name__)

#: Buckets of hashed words; a text's features are the buckets it has.
DIMS = 1 << 15
#: Bound of the labelled rows the classifier is fitted on, those of smallest hash; DIMS / 8 bytes each on the driver.
FIT_ROWS = 6_000
EPOCHS = 120
DECAY = 3e-5
#: Expected totals meet their targets within this share of all tokens, or the gap that is left is reported.
TOLERANCE = 1e-4
#: Steps end without that if the last STALL of them did not lessen the largest gap by a hundredth: targets out of reach.
STALL = 8
SLICE = 250_000
#: Target token shares by (quality, toxic) for the registered query and the pipeline.
TARGETS = {"quality=1,toxic=0": 0.93, "quality=0,toxic=0": 0.04, "quality=1,toxic=1": 0.025, "quality=0,toxic=1": 0.005}

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Word buckets of a joined buffer, where each word starts, and the number of white-space words.

    A word here is a run of letters, digits and non-ASCII bytes, A-Z in lower case; its polynomial hash comes from a
    running sum. Slices end at marks, so a word is cut only if it alone exceeds a slice.
    """
    buf = np.frombuffer(raw, np.uint8)
    hashes, places, n_words, at = [], [], 0, 0
    space = _SPACE[buf]
    n_words = int((~space & np.concatenate(([True], space[:-1]))).sum()) if len(buf) else 0
    while at < len(buf):
        end = min(len(buf), at + SLICE)
        if end < len(buf):
            gaps = np.flatnonzero(_MARKS[buf[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        part = buf[at:end]
        word = ~_MARKS[part]
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = 1 << int(max(len(part), SLICE) - 1).bit_length()
        up, down = _powers(size)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[part] * up[: len(part)], dtype=np.uint64)))
        h = (total[stops] - total[starts]) * down[starts]
        hashes.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64))
        places.append(starts + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate(hashes or [none]), np.concatenate(places or [none]), n_words


def presence(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts in order: (row in group, bucket), distinct and sorted, and the texts' numbers of words."""
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < SLICE) and len(raw) < 1024:
            raw.append(texts[at].encode("utf-8", "surrogatepass") + b"\n")
            size += len(raw[-1])
            at += 1
        joined = b"".join(raw)
        ends = np.cumsum([len(r) for r in raw])
        bucket, place, _ = _buckets(joined)
        row = np.searchsorted(ends, place, "right")
        buf = np.frombuffer(joined, np.uint8)
        space = _SPACE[buf]
        opens = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        words = np.bincount(np.searchsorted(ends, opens, "right"), minlength=len(raw))
        both = np.unique(row * DIMS + bucket)
        yield both // DIMS, both % DIMS, words


class Classifier:
    """Softmax regression over the presence of hashed words."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        probs, words = [np.zeros((0, len(self.domains)))], [np.zeros(0, np.int64)]
        for row, bucket, n in presence(texts):
            score = np.stack([np.bincount(row, w, len(n)) for w in self.weights[bucket].T], 1) + self.bias
            score = np.exp(score - score.max(1, keepdims=True))
            probs.append(score / score.sum(1, keepdims=True))
            words.append(n)
        return np.concatenate(probs), np.concatenate(words)


def fit(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), fit_rows: int = FIT_ROWS) -> Classifier:
    """Domains are the combinations of the label columns; rows with a null id or label are left out.

    The `fit_rows` labelled rows of smallest hash are fitted, by Adam on the driver; each sends a bitmap of DIMS bits.
    Without a labelled row there is one domain, "all".
    """
    name = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    clean = labels.dropna(subset=["doc_id", *columns]).select(F.col("doc_id").alias("_id"), name.alias("domain"))
    chosen = clean.orderBy(F.xxhash64("_id"), "_id", "domain").limit(fit_rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = pairs.groupBy("_id", "domain").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # repeated ids count once

    def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for row, bucket, n in presence(batch["text"].tolist()):
                bits = np.zeros((len(n), DIMS), bool)
                bits[row, bucket] = True
                yield pd.DataFrame({"domain": batch["domain"].iloc[at : at + len(n)].to_numpy(), "bits": [b.tobytes() for b in np.packbits(bits, axis=1)]})
                at += len(n)

    found = sorted(rows.mapInPandas(bitmaps, "domain string, bits binary").collect())
    domains = sorted({r["domain"] for r in found})
    if len(domains) < 2:
        return Classifier(domains or ["all"], np.zeros((DIMS, 1)), np.zeros(1))
    y = np.array([domains.index(r["domain"]) for r in found])
    buckets = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in found]
    row = np.repeat(np.arange(len(y)), [len(b) for b in buckets])
    column = np.concatenate(buckets)
    used, column = np.unique(column, return_inverse=True)
    k, n = len(domains), len(y)
    want = np.eye(k)[y]
    w, bias = np.zeros((len(used), k)), np.log(want.mean(0))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        score = np.stack([np.bincount(row, w[column, j], n) for j in range(k)], 1) + bias
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - want) / n
        grad = np.stack([np.bincount(column, error[row, j], len(used)) for j in range(k)], 1) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= 0.5 * error.sum(0)
    weights = np.zeros((DIMS, k))
    weights[used] = w
    return Classifier(domains, weights.astype(np.float32), bias)


def membership(spark: SparkSession, classifier: Classifier):
    """The column function text -> (n_tokens, p): words of the whole text and its domain posteriors."""
    shared = spark.sparkContext.broadcast(classifier)

    @F.pandas_udf("n_tokens long, p array<double>")
    def soft(texts: pd.Series) -> pd.DataFrame:
        p, n = shared.value.posteriors(texts.tolist())
        return pd.DataFrame({"n_tokens": n, "p": list(p)})

    return soft


def members(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_tokens, p): words of the whole text and its domain posteriors; null text: no word."""
    soft = membership(docs.sparkSession, classifier)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), soft(F.coalesce("text", F.lit(""))).alias("m"))
    return found.select("doc_id", "text_hash", "m.n_tokens", "m.p")


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after these steps, folded anew from the posteriors: no state is kept between jobs, so none can be lost."""
    rate = F.lit(1.0)
    for g in steps:
        move = F.lit(0.0)
        for k, x in enumerate(g.tolist()):
            move = move + F.lit(x) * F.get("p", F.lit(k))
        rate = F.greatest(rate - move, F.lit(0.0))
    return rate


@dataclass(frozen=True)
class Totals:
    """Of each domain: the tokens wanted and those expected under the rates; `met` if no gap exceeds the tolerance."""

    wanted: dict[str, float]
    expected: dict[str, float]
    met: bool


def solve(table: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None) -> tuple[Column, Totals]:
    """The rate column over (n_tokens, p), and the tokens of each domain wanted and expected under it.

    Minimises the squared, whitened residual of expected domain totals against budget x target share over rates r >= 0,
    from r = 1. With residuals whitened by G = sum n p p' and documents measured by their tokens, the gradient's
    Lipschitz constant is 1, so full steps converge. A step is one aggregation to as many numbers as there are domains.
    Targets that no rates can meet (a domain of no document) end where steps no longer help, and the totals say so.
    budget: the tokens wanted (None: as many as there are). Domains without a target keep their share of the rest.
    """
    size = len(domains)
    n, p = F.col("n_tokens"), [F.get("p", F.lit(k)) for k in range(size)]
    moments = [F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(size) for j in range(i + 1)]
    first = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), *moments).first()
    total = float(first["n"])
    gram = np.array([[first[f"g{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)])
    if not total:
        return F.lit(1.0), Totals(dict.fromkeys(domains, 0.0), dict.fromkeys(domains, 0.0), True)
    natural = gram.sum(1)
    wanted = np.array([targets.get(d, np.nan) for d in domains], float)
    free = np.isnan(wanted)
    if free.any():
        rest = max(0.0, 1 - wanted[~free].sum())
        wanted[free] = rest * natural[free] / max(natural[free].sum(), 1e-9)
    goal = wanted / max(wanted.sum(), 1e-9) * (budget or total)
    whiten = np.linalg.pinv(gram + 1e-9 * total * np.eye(size))
    steps: list[np.ndarray] = []
    gaps: list[float] = []
    while True:
        got = table.select(n.alias("n_tokens"), "p", _rate(steps).alias("r")).agg(*[F.sum(F.col("r") * n * p[k]).alias(f"t{k}") for k in range(size)]).first()
        expected = np.array([got[f"t{k}"] for k in range(size)], float)
        gaps.append(float(np.abs(expected - goal).max()))
        met = gaps[-1] <= TOLERANCE * total
        if met or (len(gaps) > STALL and min(gaps[-STALL:]) > 0.99 * min(gaps[:-STALL])):
            break
        steps.append(whiten @ (expected - goal))
    return _rate(steps), Totals(dict(zip(domains, goal.tolist(), strict=True)), dict(zip(domains, expected.tolist(), strict=True)), met)


def _copies(rate: Column, *row: Column | str) -> Column:
    """The rate rounded to a neighbouring whole number so that its mean is the rate: the fraction is the chance, by a hash of the row."""
    chance = F.pmod(F.xxhash64(*row, F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget_share: float = 1.0) -> tuple[DataFrame, list[str], Totals]:
    """docs and labels -> ((doc_id, text_hash, n_tokens, p, rate, copies), domains, totals by domain), a row for each of docs.

    Repeated rows have equal rates and copies. A null text, like one without words, has no tokens and rate 1. Without
    labels there is one domain and every rate follows the budget. Other columns are ignored; an empty table gives none.
    """
    classifier = fit(docs, labels)
    with small_batches(docs.sparkSession):
        table = materialize(members(docs, classifier), "members")
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    rate, totals = solve(table, classifier.domains, targets, budget_share * total)
    rated = table.withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(1.0))
    return rated.withColumn("copies", _copies(F.col("rate"), "doc_id", "text_hash")), classifier.domains, totals


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget_share: float = 1.0) -> DataFrame:
    """docs with each row as often as its copies say, all columns kept, whatever their names.

    The pass that reads the texts writes the rows with their posteriors, and the rates are an expression over those: the
    texts are neither joined nor shuffled. Targets that the rates do not meet are logged as a warning, with the totals. Null, empty and repeated texts as in mix; an empty table gives no row.
    """
    classifier = fit(docs, labels)
    held, tokens, posteriors, own = fresh(docs, "mixed", "n_tokens", "p", "text_hash")
    soft = membership(docs.sparkSession, classifier)
    marked = docs.withColumn(held, soft(F.coalesce("text", F.lit(""))))
    with small_batches(docs.sparkSession):
        table = materialize(marked.select(*docs.columns, F.col(held)["n_tokens"].alias(tokens), F.col(held)["p"].alias(posteriors), F.xxhash64("text").alias(own)), "mixed")
    numbers = table.select(F.col(tokens).alias("n_tokens"), F.col(posteriors).alias("p"))
    total = numbers.agg(F.sum("n_tokens")).first()[0] or 0
    rate, totals = solve(numbers, classifier.domains, targets, budget_share * total)
    if not totals.met:
        LOG.warning("targets not met: wanted %s tokens, expected %s", totals.wanted, totals.expected)
    plain = table.select(F.struct(*docs.columns).alias("doc"), F.col(tokens).alias("n_tokens"), F.col(posteriors).alias("p"), F.col(own).alias("text_hash"))
    rate = F.when(F.col("n_tokens") > 0, rate).otherwise(1.0)
    copies = plain.select("doc", _copies(rate, F.col("doc.doc_id"), "text_hash").alias("copies")).where("copies > 0")
    return copies.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")
