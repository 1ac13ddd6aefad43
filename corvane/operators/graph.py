"""Edges between files, symbol lookup and focus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.staging import release, staged


def reverse(edges: DataFrame) -> DataFrame:
    """(dst, sources): who points at a node, sorted, each once."""
    return edges.distinct().groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("sources"))


def edges_of(edges: DataFrame, node) -> DataFrame:
    """(direction, other) of one node."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"))
    return out.unionAll(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"))).distinct()


def lookup(symbols: DataFrame, name: str, origin: str = "", kind: str = "") -> DataFrame:
    """(rank, path, name, kind, line) of definitions: same folder first, then same top folder, exported names, path, line."""
    rows = symbols.where(F.col("name") == name)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    path = F.col("path")
    folder = origin.rpartition("/")[0] or "."
    order = [F.when(T.dirname(path) == folder, 0).otherwise(1), F.when(F.substring_index(path, "/", 1) == origin.split("/")[0], 0).otherwise(1), F.when(F.col("name").rlike("^[A-Z]"), 0).otherwise(1), path, F.col("line")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "path", "name", "kind", "line")  # one name's definitions


#: Endings of files that focus reads (fixed values).
FOCUS_ENDINGS = ("go", "ts", "tsx", "js", "jsx", "mjs", "py")
#: Names of a second hop that every task gets; more meet the words by a shuffle.
NAMES_SENT = 1_000_000
_IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def focus(files: DataFrame, lines: DataFrame, symbols: DataFrame, anchor: str, hops: int = 1, endings: tuple[str, ...] = FOCUS_ENDINGS) -> DataFrame:
    """(path, reason): where a symbol is defined, its folder, files named for the defining file (its stem, or that and `_`), and files
    that mention the symbol; then, on a second hop, files that mention symbols of those. The first reason of a path stands.

    Only files of these endings count, but for the defining one. Names meet by equality: a file's stem and each beginning
    of it before a `_` with the defining stem, and identifiers of lines with symbol names, after lines without any are dropped.
    """
    low = F.lower("path")
    ours = reduce(lambda a, b: a | b, [low.endswith("." + e) for e in endings])
    origin = symbols.where(F.col("name") == anchor).select("path").distinct()
    known = files.where(ours).select("path")
    folders = origin.select(T.dirname(F.col("path")).alias("dir")).distinct()
    near = known.withColumn("dir", T.dirname(F.col("path"))).join(folders, "dir", "left_semi")
    stems = origin.select(T.stem(F.col("path")).alias("head")).distinct()
    parts = F.split(T.stem(F.col("path")), "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    named = known.select("path", F.explode(heads).alias("head")).join(stems, "head", "left_semi")
    texts = lines.where(ours)
    said = texts.where(F.col("text").contains(anchor) & F.array_contains(F.regexp_extract_all("text", F.lit(_IDENTIFIER), F.lit(0)), anchor)).select("path").distinct()
    rows = None
    for k, (frame, reason) in enumerate(((origin, "anchor-origin"), (near, "same-dir"), (named, "basename-prefix"), (said, "name-match"))):
        part = frame.select("path", F.lit(k).alias("k"), F.lit(reason).alias("reason"))
        rows = part if rows is None else rows.unionAll(part)
    found = rows.groupBy("path").agg(F.min_by("reason", "k").alias("reason"))
    if hops < 2:
        return found
    found = staged(found)
    names = staged(symbols.join(found.select("path"), "path", "left_semi").select(F.col("name").alias("word")).distinct())
    if names.count() <= NAMES_SENT:
        names = F.broadcast(names)  # else all words of all lines would be shuffled and sorted
    others = texts.join(found.select("path"), "path", "left_anti")
    words = others.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_IDENTIFIER), F.lit(0)))).alias("word"))
    more = words.join(names, "word", "left_semi").select("path").distinct()
    return found.unionAll(more.select("path", F.lit("hop-2").alias("reason")))


#: Stems that one pass over the bodies looks for; more take several passes.
STEM_BLOCK = 2_000_000
#: Bytes of bodies that are searched at once.
SEARCH_BYTES = 1_000_000
#: An odd base of window hashes, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _all_powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64."""
    return _all_powers(base, max(n.bit_length(), 20))[:n]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(41)).astype(np.int64)


class StemIndex:
    """Stems by their bytes: for each length the sorted hashes and the stems in that order, and filters of first two bytes and of hashes."""

    def __init__(self, stems: list[bytes]):
        self.lengths: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.heads = np.zeros(1 << 16, bool)
        by_length: dict[int, list[bytes]] = {}
        for stem in stems:
            by_length.setdefault(len(stem), []).append(stem)
        for size, held in sorted(by_length.items()):
            table = np.frombuffer(b"".join(held), np.uint8).reshape(-1, size)
            hashes = (table * _powers(_BASE, size)).sum(1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.lengths.append((size, hashes[order], table[order]))
            if size == 1:
                self.heads.reshape(256, 256)[table[:, 0]] = True
            else:
                self.heads[table[:, 0].astype(np.int64) << 8 | table[:, 1]] = True
        self.starts = np.cumsum([0, *(len(h) for _, h, _ in self.lengths)])

    def filter(self) -> np.ndarray:
        """Which slots any stem's hash falls into; made where it is used, as it is larger than few stems."""
        slots = np.zeros(1 << 23, bool)
        for _, hashes, _ in self.lengths:
            slots[_slots(hashes)] = True
        return slots

    def name(self, at: int) -> str:
        k = int(np.searchsorted(self.starts, at, "right")) - 1
        return self.lengths[k][2][at - self.starts[k]].tobytes().decode()

    def found(self, bodies: list[bytes], slots: np.ndarray) -> np.ndarray:
        """The numbers of stems that bodies hold, once for each body. Bodies are joined by a byte that no UTF-8 text has, and what a hash finds is compared."""
        row = np.frombuffer(b"\xff".join(bodies) + b"\xff\xff", np.uint8)
        ends = np.cumsum([len(b) + 1 for b in bodies])
        at = np.flatnonzero(self.heads[row[:-1].astype(np.uint16) << 8 | row[1:]])
        if not len(at):
            return at
        sums = np.zeros(len(row) + 1, np.uint64)
        np.cumsum(row * _powers(_BASE, len(row)), out=sums[1:])
        shift, before, out = _powers(_UNBASE, len(row))[at], sums[at], []
        for k, (size, hashes, table) in enumerate(self.lengths):
            n = int(np.searchsorted(at, len(row) - size, "right"))
            window = (sums[at[:n] + size] - before[:n]) * shift[:n]
            near = np.flatnonzero(slots[_slots(window)])
            place = np.searchsorted(hashes, window[near])
            place[place == len(hashes)] = 0
            near, place = (x[hashes[place] == window[near]] for x in (near, place))
            begin = at[near]
            while len(begin):
                same = np.ones(len(begin), bool)
                for j in range(size):
                    same &= row[begin + j] == table[place, j]
                out.append(np.searchsorted(ends, begin[same], "right") << 32 | (place[same] + self.starts[k]))
                more = place + 1 < len(hashes)  # other stems of the same hash
                begin, place = begin[more], place[more] + 1
                again = hashes[place] == hashes[place - 1]
                begin, place = begin[again], place[again]
        return np.unique(np.concatenate(out)) & 0xFFFFFFFF if out else at[:0]


def reference_counts(files: DataFrame, asked: Column | None = None) -> DataFrame:
    """(path, refs): how many other files hold the path's stem on any line, inside longer words too; of the paths `asked` for, or all.

    Each distinct stem is looked for once, and one pass over the bodies finds those of STEM_BLOCK stems: windows of each length that
    stems have are hashed from one prefix sum, only where the first two bytes of a stem stand, and what a hash finds is compared. So a pass costs
    the bodies and what they hold, not their product with the stems. A file's own mention is taken off. Stems are parted in blocks by hash, so what a task
    gets is bounded; the driver holds one block at a time. Counts are summed per batch before they are shuffled. A null body holds nothing,
    and an empty stem has no references.
    """
    rows = files if asked is None else files.where(asked)
    stem = T.stem(F.col("path"))
    stems = staged(rows.select("path", stem.alias("stem"), F.coalesce(F.col("body").contains(stem), F.lit(False)).cast("long").alias("own")))
    distinct = staged(stems.where("stem <> ''").select("stem").distinct())
    blocks = -(-distinct.count() // STEM_BLOCK)
    counted = None
    for k in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("stem"), F.lit(blocks)) == k).select(F.col("stem").cast("binary")).toArrow().column(0).to_pylist()
        if not block:
            continue
        shared = files.sparkSession.sparkContext.broadcast(StemIndex(block))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            slots = index.filter()

            def summed(bodies: list[bytes]) -> pa.RecordBatch:
                at, n = np.unique(index.found(bodies, slots), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(map(index.name, at.tolist()), pa.string()), pa.array(n, pa.int64())], names=["stem", "n"])

            bodies, size = [], 0
            for batch in batches:
                for body in batch.column("body"):
                    bodies.append(body.as_py() or b"")
                    size += len(bodies[-1])
                    if size >= SEARCH_BYTES:
                        yield summed(bodies)
                        bodies, size = [], 0
            if bodies:
                yield summed(bodies)

        part = files.where("body <> ''").select(F.col("body").cast("binary").alias("body")).mapInArrow(count, "stem string, n long")
        counted = part if counted is None else counted.unionAll(part)
    release(distinct)
    if counted is None:
        return stems.select("path", F.lit(0).cast("long").alias("refs"))
    sums = counted.groupBy("stem").agg(F.sum("n").alias("n"))
    return stems.join(sums, "stem", "left").select("path", F.coalesce(F.col("n") - F.col("own"), F.lit(0)).cast("long").alias("refs"))


#: Ranks of change states (fixed values): a folder shows the highest below it.
STATUS_RANK = {"D": 60, "A": 50, "M": 40, "R": 30, "C": 20, "T": 10, "?": 5}


def status_rollup(statuses: DataFrame) -> DataFrame:
    """(path, status) -> (dir, status): of each folder, the highest-ranked state of anything below."""
    parts = F.split(T.dirname(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), F.col("status"))
    return statuses.select(F.explode(up).alias("dir"), "status", rank.alias("k")).groupBy("dir").agg(F.max_by("status", "k").alias("status"))
