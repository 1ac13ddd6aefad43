"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are routed so that every pair within the distance meets (a choice of equal bit blocks, by the
pigeonhole principle). Where they meet, they are sorted by Gray rank; runs of neighbours become nodes that
hold the bit pattern their members share under a mask, and upper nodes factor what lower nodes share. Two nodes
are compared on the bits both share: the differences accumulate down the tree, a pair of nodes is dropped as a
whole once they exceed the distance, and merged as a whole when no member pair can exceed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import connected_components, fresh, materialize, small_batches, spread_join

SEED = 42
WIDTH = 4
DISTANCE = 4
FANOUT = 8
#: Rows a task holds at once; a group of fingerprints beyond it is routed anew by a finer choice of blocks.
GROUP_ROWS = 200_000
#: Node pairs compared at once.
FRONTIER = 100_000
#: Pairs confirmed before those that are linked by then are left out.
CONFIRMED = 64
#: Shingles hashed at once.
SLICE = 65_536
#: Near-duplicate documents: words of a shingle, and the share of shingles two texts have in common.
NEAR_WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of such pairs differ by 10 bits on average, with a deviation of 3; beyond this the index drops a pair.
NEAR_BITS = 24
#: Keys a text is routed by, each of ROWS minimum hashes: a pair at 0.8 misses all of them with a chance of 2e-4.
KEYS, ROWS = 16, 4
#: Bytes of shingles of one key that a task holds; a larger group is met by blocks, each pair of blocks in a task.
BLOCK_BYTES = 8_000_000
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**63, KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**63, KEYS * ROWS, dtype=np.uint64)


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of each run of `width` words, repeats included, in slices; of fewer words the whole sequence."""
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for k in range(0, len(starts), SLICE):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + SLICE], ends[k : k + SLICE], strict=True)], np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _majority(slices: list[np.ndarray]) -> int:
    """The bits set in over half of all hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for h in slices:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash of the A-Z-lowered words' shingles, repeats counted; 0 without words. Unsigned."""
    return _majority(list(shingle_hashes(_words(text), width)))


def fingerprint_column(text, width: int = WIDTH):
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return hashed(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over groups of fingerprints: one tree for each group, levels as arrays.

    Level 0 holds the fingerprints, sorted by group and Gray rank. A node of level l+1 covers up to FANOUT
    neighbours of one group; `ones` and `any` are the AND and OR of its members, so the bits where they agree are
    the shared pattern.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        self.order = order = np.lexsort((gray_rank(codes), groups))
        self.groups, self.codes = groups[order], codes[order]
        self.levels = [(self.codes, self.codes, np.arange(len(codes) + 1))]
        self.label = np.arange(len(codes))
        group = self.groups
        self.owner = [group]
        while len(group) and (group[1:] == group[:-1]).any():
            ones, some, _ = self.levels[-1]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(place % FANOUT == 0)
            self.levels.append(
                (np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts), np.append(starts, len(group)))
            )
            group = group[starts]
            self.owner.append(group)

    def spans(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last leaf of each node."""
        lo, hi = nodes, nodes + 1
        for k in range(level, 0, -1):
            bounds = self.levels[k][2]
            lo, hi = bounds[lo], bounds[hi]
        return lo, hi

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            if not (differ := x != y).any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def link(self, distance: int, alike: Callable[[int, int], bool] | None = None) -> None:
        """Give all leaves of a group that reach each other by links one label.

        With `alike`, two leaves within the distance (as rows of the input) link only if it says so; those that have one label already are not asked.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.owner[top]))
        work = [(top, roots, roots)]
        while work:
            level, a, b = work.pop()
            if len(a) > FRONTIER:
                work += [(level, a[k : k + FRONTIER], b[k : k + FRONTIER]) for k in range(0, len(a), FRONTIER)]
                continue
            ones, some, _ = self.levels[level]
            shared = ~(ones[a] ^ some[a]) & ~(ones[b] ^ some[b])
            apart = np.bitwise_count((ones[a] ^ ones[b]) & shared)
            near = apart <= distance
            a, b, shared, apart = a[near], b[near], shared[near], apart[near]
            if not level:
                self.unite(a, b) if alike is None else self._confirm(a, b, alike)
                continue
            (a_lo, a_hi), (b_lo, b_hi) = self.spans(level, a), self.spans(level, b)
            whole = apart + np.bitwise_count(~shared) <= (distance if alike is None else -1)  # no pair below can be further apart
            for lo, hi, to in ((a_lo, a_hi, a_lo), (b_lo, b_hi, a_lo)):
                n = (hi - lo)[whole]
                at = np.repeat(lo[whole] - np.cumsum(n) + n, n) + np.arange(n.sum())
                self.unite(at, np.repeat(to[whole], n))
            low = np.minimum.reduceat(self.label, lo_all := self.spans(level, np.arange(len(ones)))[0])
            high = np.maximum.reduceat(self.label, lo_all)
            done = whole | ((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[~done], b[~done]
            bounds = self.levels[level][2]
            na, nb = bounds[a + 1] - bounds[a], bounds[b + 1] - bounds[b]
            n = na * nb
            if not len(n):
                continue
            # Depth first: what is put off waits as few parents, not as all their children, and labels found by then prune it.
            first = max(1, int(np.searchsorted(np.cumsum(n), FRONTIER, "right")))
            if first < len(n):
                work.append((level, a[first:], b[first:]))
            a, b, n, nb = a[:first], b[:first], n[:first], nb[:first]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(nb, n)
            x, y = np.repeat(bounds[a], n) + k // width, np.repeat(bounds[b], n) + k % width
            keep = (x <= y) if level > 1 else (x < y)
            work.append((level - 1, x[keep], y[keep]))

    def _confirm(self, a: np.ndarray, b: np.ndarray, alike: Callable[[int, int], bool]) -> None:
        while len(a):
            differ = self.label[a] != self.label[b]
            a, b = a[differ], b[differ]
            x, y, a, b = a[:CONFIRMED], b[:CONFIRMED], a[CONFIRMED:], b[CONFIRMED:]
            good = np.fromiter((alike(i, j) for i, j in zip(self.order[x].tolist(), self.order[y].tolist(), strict=True)), bool, len(x))
            self.unite(x[good], y[good])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.codes[at], self.codes[self.label[at]]


def link_groups(groups: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links inside each group: at most one for each row."""
    several = np.ones(len(groups), bool)
    if len(groups) > 1:
        same = groups[1:] == groups[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    elif len(groups):
        several[:] = False
    index = GrayIndex(groups[several], codes[several])
    index.link(distance)
    return index.edges()


def _meet(distance: int, rows: int, last: bool):
    """Over a partition sorted by key: links as (u, v, false); the rows of a group beyond `rows` as (code, code, true)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_c, held, hot = [], [], 0, None

        def flush(k, c):
            u, v = link_groups(k, c.view(np.uint64), distance)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64), "hot": False})

        for batch in batches:
            k, c = batch["key"].to_numpy(), batch["code"].to_numpy()
            if hot is not None:
                n = int((k == hot).argmin()) if (k != hot).any() else len(k)
                if n:
                    yield pd.DataFrame({"u": c[:n], "v": c[:n], "hot": True})
                k, c = k[n:], c[n:]
                if not len(k):
                    continue
                hot = None
            held_k.append(k)
            held_c.append(c)
            held += len(k)
            if held < rows:
                continue
            k, c = np.concatenate(held_k), np.concatenate(held_c)
            begin = int(np.flatnonzero(k == k[-1])[0])  # the last group may go on
            if begin:
                yield flush(k[:begin], c[:begin])
            k, c = k[begin:], c[begin:]
            if len(k) >= rows and not last:
                yield pd.DataFrame({"u": c, "v": c, "hot": True})
                hot, k, c = k[-1], k[:0], c[:0]
            held_k, held_c, held = [k], [c], len(k)
        if held:
            yield flush(np.concatenate(held_k), np.concatenate(held_c))

    return run


def block_masks(blocks: int, equal: int) -> list[int]:
    """Signed 64-bit masks of every choice of `equal` out of `blocks` bit blocks."""
    bounds = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(x) for x in combinations(parts, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(codes: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(code) distinct signed longs -> (u, v) links that connect exactly the codes that links within `distance` connect.

    With b blocks, two codes within d bits agree on b - d blocks at least, so they meet under one of the choices.
    b follows the number of codes, so that chance meetings stay few. The members of a group too large for a task
    are all routed again under the next, finer choice: exact, and linear in the group.
    """
    n = codes.count()
    plan = [b for b in (2, 4, 6, 8, 12) if b + distance > distance]
    while len(plan) > 1 and n > 64 << (64 * plan[0] // (plan[0] + distance)):
        plan = plan[1:]
    found, rest = None, codes
    for at, equal in enumerate(plan):
        last = at == len(plan) - 1
        keys = [F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(equal + distance, equal))]
        routed = rest.select("code", F.explode(F.array(*keys)).alias("key"))
        met = materialize(
            routed.repartition("key").sortWithinPartitions("key").mapInPandas(_meet(distance, group_rows, last), "u long, v long, hot boolean"),
            "near",
        )
        links = met.where("not hot").select("u", "v")
        found = links if found is None else found.unionAll(links)
        if last or not met.where("hot").limit(1).count():
            return found
        rest = materialize(met.where("hot").select(F.col("u").alias("code")).distinct(), "hot")
    return found


def components(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint, component_id, text_hash, code), a row for each input row.

    Null or wordless texts have fingerprint zero and link like any other. Equal texts have equal fingerprints, so
    copies meet before any link is looked for. component_id is the smallest non-null doc_id of all that links reach
    (null if there is none). Other columns are ignored; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        hashed = materialize(
            docs.select("doc_id", fingerprint_column(docs["text"], width).alias("code"), F.xxhash64("text").alias("text_hash")), "codes"
        )
    total = hashed.count()
    least = materialize(hashed.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "least")
    roots = connected_components(near_links(least.select("code"), distance)).select(F.col("node").alias("code"), "root")
    linked = least.join(roots, "code")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_codes"))
    named = spread_join(linked, ids, "root", "n_codes", total).select("code", "root", "component_id", "n_rows")
    alone = least.join(roots, "code", "left_anti").select("code", F.col("code").alias("root"), F.col("least").alias("component_id"), "n_rows")
    named = materialize(named.unionAll(alone), "named")
    return spread_join(hashed, named, "code", "n_rows", total).select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root"
    )


def sketch(text: str | None, width: int = NEAR_WIDTH) -> tuple[int, int, list[int], bytes]:
    """Of a text: a hash of its words, its fingerprint, the keys it is routed by, and its distinct shingles.

    Hash, fingerprint and keys are signed; shingles are 32-bit hashes in order. Without words: no keys and no shingles.
    """
    words = _words(text)
    slices = list(shingle_hashes(words, width))
    signed = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + 1), _majority(slices)], np.uint64).view(np.int64).tolist()
    if not slices:
        return *signed, [], b""
    least = np.full(KEYS * ROWS, 2**64 - 1, np.uint64)
    distinct = np.unique(np.concatenate(slices))
    for k in range(0, len(distinct), 4096):
        least = np.minimum(least, (distinct[k : k + 4096, None] * _FACTORS + _SHIFTS).min(0))
    keys = [xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(least.reshape(KEYS, ROWS))]
    return *signed, np.array(keys, np.uint64).view(np.int64).tolist(), np.unique(distinct.astype(np.uint32)).tobytes()


def _similar(similarity: float, shingles: list[np.ndarray]) -> Callable[[int, int], bool]:
    def alike(i: int, j: int) -> bool:
        a, b = shingles[i], shingles[j]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both)

    return alike


def _meet_similar(similarity: float):
    """Over a partition sorted by key: links (u, v) that connect the nodes which pairs of equal key and enough similarity connect."""

    def links(rows: list[pd.DataFrame]) -> pd.DataFrame:
        held = pd.concat(rows)
        held = held[held["key"].duplicated(keep=False)].drop_duplicates(["key", "node"])
        nodes, shingles = held["node"].to_numpy(), [np.frombuffer(x, np.uint32) for x in held["shingles"]]
        index = GrayIndex(held["key"].to_numpy(), held["code"].to_numpy().view(np.uint64))
        index.link(NEAR_BITS, _similar(similarity, shingles))
        at = np.flatnonzero(index.label != np.arange(len(index.label)))
        return pd.DataFrame({"u": nodes[index.order[at]], "v": nodes[index.order[index.label[at]]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch["shingles"].str.len().sum())
            if size > BLOCK_BYTES:
                rows = pd.concat(held)
                whole = rows["key"] != rows["key"].iloc[-1]  # the last group may go on
                if whole.any():
                    yield links([rows[whole]])
                    held = [rows[~whole]]
                    size = int(held[0]["shingles"].str.len().sum())
        if held:
            yield links(held)

    return run


def similar_links(nodes: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, row, keys, n_shingles), a row for each node, and (row, code, shingles) -> (u, v): links that connect just the nodes which similar pairs connect.

    Nodes that share a key meet. There the Gray-order index drops pairs whose fingerprints are too far apart, and the
    shingle sets confirm the rest, so every link is exact. Sets move only for nodes that meet others, and of keys that
    the very same nodes share one is enough: the nodes of a key are told by their number and two independent sums of hashes.
    A key whose sets exceed BLOCK_BYTES is parted in blocks by node, and every pair of blocks meets in a task of its
    own: bounded memory, and no pair is lost.
    """
    keyed = nodes.select("row", "node", F.explode("keys").alias("key"), (F.col("n_shingles") * 4).alias("size"))
    told = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"told_{k}") for k in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *told).where("n > 1")
    shared = shared.groupBy("n", "bytes", "told_0", "told_1").agg(F.min("key").alias("key"))
    shared = materialize(shared.select("key", "n", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks")), "keys")
    met = spread_join(keyed.drop("size"), shared, "key", "n", KEYS * nodes.count())
    own, other = F.pmod("node", "blocks"), F.col("other")
    paired = met.select("row", "node", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    routed = materialize(paired.select("row", "node", F.xxhash64("key", F.least("own", other), F.greatest("own", other)).alias("key")), "routed")
    wanted = materialize(routed.select("row").distinct(), "wanted")
    rows = routed.join(sketches.select("row", "code", "shingles").join(wanted, "row", "left_semi"), "row").drop("row")
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_meet_similar(similarity), "u long, v long")


def drop_near_duplicates(docs: DataFrame, width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: the smallest doc_id (null ids last), all columns kept, whatever their names.

    Texts of equal words (A-Z in lower case) are one node; nodes link if their sets of `width`-word shingles share
    `similarity` or more of their union, and links make classes. Null, empty and wordless texts are one node, so one of
    them stays; a text of fewer words than a shingle is one shingle. Repeated rows are copies. Whole texts of any length;
    an empty table gives no row. The texts are read once and written with their sketches, and only rows that
    go are looked up when they are read again: a broadcast while those are few.
    """

    @F.pandas_udf("node long, code long, keys array<long>, shingles binary, n_shingles long")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = [sketch(t, width) for t in texts]
        return pd.DataFrame([(*r, len(r[3]) // 4) for r in rows], columns=["node", "code", "keys", "shingles", "n_shingles"])

    held, row = fresh(docs, "sketch", "row")
    marked = docs.withColumn(held, sketched(docs["text"])).withColumn(row, F.monotonically_increasing_id())
    spark = docs.sparkSession
    with small_batches(spark):
        marked = materialize(marked, "sketches")
    narrow = marked.select("doc_id", F.col(row).alias("row"), f"{held}.*")
    first = F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("row")
    nodes = materialize(narrow.groupBy("node").agg(first, F.min("doc_id").alias("least")), "nodes")
    keys = narrow.select("row", "node", "keys", "n_shingles").join(nodes.select("row"), "row", "left_semi")
    with small_batches(spark):
        links = materialize(similar_links(keys, narrow, similarity), "similar")
    roots = connected_components(links)
    linked = nodes.join(roots, "node")
    best = linked.groupBy("root").agg(F.coalesce(F.min_by("row", "least"), F.min("row")).alias("row"))
    alone = nodes.join(roots, "node", "left_anti").select("row")
    gone = materialize(narrow.select("row").join(best.select("row").unionAll(alone), "row", "left_anti"), "gone")
    return marked.join(gone, marked[row] == gone["row"], "left_anti").select(*docs.columns)
