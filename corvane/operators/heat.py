"""Weights by folder, roll-ups and treemaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def weight(by: str) -> Column:
    """The chosen metric: tokens, files, symbols or churn."""
    return {"tokens": F.col("tokens"), "files": F.col("files"), "symbols": F.col("symbols"), "churn": F.col("churn")}[by].cast("double")


def buckets(metrics: DataFrame, depth: int, by: str = "tokens", top: int = 0) -> DataFrame:
    """(path, tokens, symbols, churn) -> (dir, tokens, files, symbols, churn, weight) of folders cut to a depth; positive weights, heaviest first."""
    cut = metrics.groupBy(T.truncate_path(F.col("path"), depth).alias("dir")).agg(
        F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("files"), F.sum("symbols").cast("long").alias("symbols"), F.sum("churn").cast("long").alias("churn")
    )
    kept = cut.withColumn("weight", weight(by)).where("weight > 0")
    return kept.orderBy(F.desc("weight"), "dir").limit(top) if top else kept


def rollup(files: DataFrame) -> DataFrame:
    """files -> (dir, files, tokens, size) of every folder with all below it; `.` is the root."""
    parts = F.split(T.dirname(F.col("path")), "/")
    own = F.when(F.instr("path", "/") == 0, F.array(F.lit("."))).otherwise(
        F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    )
    # Files of a folder are summed first, so each folder's row alone goes up to its ancestors.
    leaves = files.groupBy(own.alias("up")).agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("size").alias("size"))
    each = leaves.select(F.explode("up").alias("dir"), "files", "tokens", "size")
    return each.groupBy("dir").agg(*[F.sum(c).cast("long").alias(c) for c in ("files", "tokens", "size")])


def _worst(total: float, low: float, high: float, side: float) -> float:
    if side <= 0 or total <= 0 or low <= 0:
        return float("inf")
    return max(side * side * high / (total * total), total * total / (side * side * low))


def _half_away(x: float) -> int:
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def layout(weights: list[float], width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Squarified rectangles (x, y, w, h) on whole cells, in the order given; what is not positive has none."""
    area, total = float(width * height), sum(w for w in weights if w > 0)
    if width <= 0 or height <= 0 or total <= 0:
        return []
    sizes = [w / total * area for w in weights if w > 0]
    out: list[tuple[int, int, int, int]] = []
    x, y, w, h = 0.0, 0.0, float(width), float(height)
    at = 0
    while at < len(sizes):
        side, end = min(w, h), at + 1
        acc, low, high = sizes[at], sizes[at], sizes[at]
        while end < len(sizes):
            s = sizes[end]
            if _worst(acc, low, high, side) <= _worst(acc + s, min(low, s), max(high, s), side):
                break
            acc, low, high, end = acc + s, min(low, s), max(high, s), end + 1
        upright = w >= h
        long, short = (h, w) if upright else (w, h)
        thick = max(1, _half_away(acc / long)) if long > 0 else 1
        run, placed = 0.0, 0
        for k in range(at, end):
            run += sizes[k]
            stop = int(long) if k == end - 1 else _half_away(run / acc * long)
            n = max(1, stop - placed)
            out.append((int(x), int(y) + placed, thick, n) if upright else (int(x) + placed, int(y), n, thick))
            placed += n
        if upright:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        at = end
    return out


def treemap(weighted: DataFrame, width: int = 120, height: int = 40) -> DataFrame:
    """(dir, weight) -> (dir, x, y, w, h). Rows follow each other, so the folders of one map, a bounded report, go to one task."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"dir": [], "weight": []}), *batches])
        rows = rows[rows["weight"] > 0].sort_values(["weight", "dir"], ascending=[False, True])
        cells = layout(rows["weight"].tolist(), width, height)
        yield pd.DataFrame({"dir": rows["dir"].tolist(), **{n: [c[k] for c in cells] for k, n in enumerate("xywh")}})

    one = weighted.select("dir", "weight").repartition(1)
    return one.mapInPandas(place, "dir string, x long, y long, w long, h long")
