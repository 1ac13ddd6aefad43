"""Language ID by nearest centroids of TF-IDF n-gram vectors, with distance-based rejection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import fresh, materialize

#: Buckets of hashed byte 2- and 3-grams.
DIMS = 4096
#: Clustered centroids for each language.
CENTROIDS = 3
#: Bound of the fitting sample: distinct texts for each label. All labelled rows can be in it; hashes choose.
FIT_ROWS = 600
#: Parts of a label's hashes that are ranked by themselves before the label is.
SALTS = 16
#: A text is rejected below this quantile of the cosines that a label's held-out fragments of its length had.
QUANTILE = 0.005
ROUNDS = 12
UNKNOWN = "und"
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32
#: Texts are hashed together up to this many bytes, longer ones slice by slice.
SLICE = 400_000


def _counts(texts: list[str]) -> np.ndarray:
    """float32 (texts x DIMS): how often each bucket's n-grams occur in a text.

    In lower case, with a space at either end and for each ASCII character that is no letter; n-grams that hold two
    spaces in a row do not count, so digits, marks and white space say nothing.
    """
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    out = np.zeros((len(raw), DIMS), np.float32)
    sizes = np.array([len(r) - 2 for r in raw], np.int64)  # positions at which an n-gram starts
    owner = np.repeat(np.arange(len(raw)), sizes + 2)
    buf = _LETTERS[np.frombuffer(b"".join(raw), np.uint8)]
    last = np.cumsum(sizes + 2)
    counted = np.ones(len(buf), bool)
    counted[last - 1] = counted[last - 2] = False
    counted[:-1] &= (buf[:-1] != 32) | (buf[1:] != 32)
    triple = counted[:-2] & ((buf[1:-1] != 32) | (buf[2:] != 32))
    for lo in range(0, len(buf), SLICE):
        b = buf[lo : lo + SLICE + 2].astype(np.uint32)
        at = np.flatnonzero(counted[lo : lo + SLICE])
        two = b[at] << np.uint32(8) | b[at + 1]
        three = two << np.uint32(8) | b[at + 2]
        row = owner[lo : lo + SLICE][at] * DIMS
        n = int(row[0]) // DIMS if len(row) else 0
        for code, salt, fit in ((two, 0x9E3779B1, slice(None)), (three, 0x85EBCA77, triple[lo : lo + SLICE][at])):
            bucket = (code * np.uint32(salt)) >> np.uint32(20)
            part = np.bincount((row - n * DIMS + bucket)[fit])
            whole = out[n:].reshape(-1)
            whole[: len(part)] += part
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if k > begin and (size + len(t) > SLICE or k - begin == 256):
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def _length_bins(texts: list[str]) -> np.ndarray:
    """Length as a power of two, 0 to 12."""
    return np.array([min(max(len(t), 1), 4096).bit_length() - 1 for t in texts], np.int64)


class Model:
    """languages and their centroids (rows), inverse document frequencies, smallest accepted cosine by row and length bin."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.languages, self.centroids, self.idf, self.least = languages, centroids, idf, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid, and whether that is below what is accepted at this length."""
        names, scores, rejected = [], [], []
        for lo, hi in _groups(texts):
            part = texts[lo:hi]
            cos = _vectors(_counts(part), self.idf) @ self.centroids.T
            best = cos.argmax(1)
            score = cos[np.arange(len(part)), best].astype(float).clip(0, 1)
            names += [self.languages[k] for k in best]
            scores.append(score)
            rejected.append(score < self.least[best, _length_bins(part)])
        return names, np.concatenate(scores or [np.zeros(0)]), np.concatenate(rejected or [np.zeros(0, bool)])


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    centre = x.mean(0)
    seeds = [int((x @ centre).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(ROUNDS):
        to = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, quantile: float = QUANTILE) -> Model | None:
    """(text, lang) -> Model, from at most `fit_rows` distinct texts of each label; None if no text has a label.

    Null texts and labels and texts without a letter are left out. The sample takes the texts of a label's
    `fit_rows` smallest distinct hashes, whatever the number of copies. Clustering runs on the
    executors, one label a group; the driver gets document frequencies, centroids and cosines: labels x centroids x DIMS.
    Fragments are held out by halves: their cosines are to centroids of the label's texts of the other half.
    """
    rows = labelled.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    mark = F.xxhash64("text").alias("mark")
    least = rows.select("lang", mark).distinct().withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # the smallest of each part first, so no task reads all hashes of a label
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("mark"))
        least = least.withColumn("k", rank).where(F.col("k") <= fit_rows)
    bounds = [(r["lang"], r["most"]) for r in least.groupBy("lang").agg(F.max("mark").alias("most")).collect()]
    if not bounds:
        return None
    most = F.create_map(*[F.lit(v) for pair in bounds for v in pair])
    near = rows.select("*", mark).where(F.col("mark") <= F.element_at(most, F.col("lang")))
    sample = near.dropDuplicates(["lang", "mark"]).select("lang", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                pieces = [text] + [text[(len(text) - (1 << b)) // 2 :][: 1 << b] for b in range(2, 13) if len(text) >= 1 << b]
                x = _counts(pieces)
                at = [np.flatnonzero(r) for r in x]
                yield pd.DataFrame(
                    {
                        "lang": lang, "whole": [True] + [False] * (len(pieces) - 1), "bin": _length_bins(pieces), "half": zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1,
                        "at": [k.astype(np.uint16).tobytes() for k in at], "n": [r[k].tobytes() for r, k in zip(x, at, strict=True)],
                    }
                )

    table = materialize(sample.mapInPandas(features, "lang string, whole boolean, bin int, half int, at binary, n binary"), "features")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS), 0
        for batch in batches:
            for at in batch["at"]:
                df[np.frombuffer(at, np.uint16)] += 1
                n += 1
        yield pd.DataFrame({"n": [n], "df": [df.tobytes()]})

    parts = table.where("whole").select("at").coalesce(8).mapInPandas(frequencies, "n long, df binary").collect()
    df, n = sum(np.frombuffer(p["df"]) for p in parts), sum(p["n"] for p in parts)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        x, half = _vectors(_dense(pdf), idf), pdf["half"].to_numpy()
        parts = [(-1, x)] + [(k, x[half != k]) for k in (0, 1)]
        rows = [(k, r.astype(np.float32).tobytes()) for k, part in parts if len(part) for r in _cluster(part, centroids)]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "half": [k for k, _ in rows], "c": [c for _, c in rows]})

    found = sorted(table.where("whole").groupBy("lang").applyInPandas(group, "lang string, half int, c binary").collect())
    centres = {(lang, half): [] for lang, half, _ in found}
    for lang, half, c in found:
        centres[lang, half].append(np.frombuffer(c, np.float32))
    names = [lang for lang, half, _ in found if half == -1]
    middle = np.stack([c for (_, half), cs in centres.items() if half == -1 for c in cs])
    own = {key: np.stack(cs).T for key, cs in centres.items()}

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                x = _vectors(_dense(part), idf)
                # A label whose texts are all of one half has no others to be held out from.
                to = [own.get((lang, half), own[lang, -1]) for lang, half in zip(part["lang"], part["half"], strict=True)]
                best = [float((r @ c).max()) for r, c in zip(x, to, strict=True)]
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "bin": part["bin"].to_numpy(), "cos": best})

    low = F.percentile("cos", F.lit(quantile)).alias("low")
    lows = {(r["lang"], r["bin"]): r["low"] for r in table.mapInPandas(cosines, "lang string, bin int, cos double").groupBy("lang", "bin").agg(low).collect()}
    least = np.zeros((len(names), 13))
    for row, lang in zip(least, names, strict=True):
        for b in range(13):  # a length without fragments takes the bound of the next shorter one
            row[b] = lows.get((lang, b), row[b - 1] if b else 0.0)
    return Model(names, middle, idf, least)


def _dense(rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for row, at, n in zip(out, rows["at"], rows["n"], strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    return out


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with a label, its score (0 to 1) and whether it is rejected, in place of columns of those names; all other columns stay.

    A null text, one without a letter, or any text when there is no model: `und`, score 0, rejected. Whole texts; of labels
    with equal cosines the first in order; repeated rows get equal values; an empty table gives none.
    """
    lang, score, rejected = names

    @F.pandas_udf("lang string, score double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        labels, scores, far = model.predict(texts.tolist())
        return pd.DataFrame({"lang": pd.Series(labels, dtype=object), "score": scores, "rejected": far})

    letters = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    if model is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0), rejected: F.lit(True)})
    (held,) = fresh(docs, "guess")
    marked = docs.withColumn(held, guess(F.coalesce("text", F.lit(""))))
    return marked.withColumns(
        {
            lang: F.when(letters, F.col(f"{held}.lang")).otherwise(UNKNOWN),
            score: F.when(letters, F.col(f"{held}.score")).otherwise(0.0),
            rejected: F.when(letters, F.col(f"{held}.rejected")).otherwise(True),
        }
    ).drop(held)


def held_out(doc_id="doc_id", folds: int = 5):
    """Whether crc32 of the id as text is divisible by the folds; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))
