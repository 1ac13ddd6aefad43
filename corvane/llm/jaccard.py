"""Jaccard links between word n-gram sets by a token-group matrix.

Sets are partitioned into groups of similar ones (equal minimum hash, then links to a leader), so that copies share a group. The
matrix holds, for tokens that a link cannot do without (a prefix in one global order, rare tokens first), which groups have
them. A set is a query for every other group it meets there; where they meet, its overlap with the group's token union
bounds its overlap with any member, and only groups that reach the bound are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import connected_components, materialize, small_batches, spread_join
from corvane.llm.simhash import SEED, _words, shingle_hashes

WIDTH = 4
#: Sets link at this many hundredths of their union.
PERCENT = 85
#: Bytes of a token's hash that are kept: two texts of 1,000 shingles meet a false equal one with a chance of 1e-10.
TOKEN_BYTES = 6
#: Bytes of members' tokens that a task opens at once; larger groups are parted.
BLOCK_BYTES = 2_000_000
#: Queries of a block that go to a task; more are dealt, each task with the members.
QUERIES = 20_000
#: The order of tokens knows counts by hash in at most 2 ** SKETCH_BITS cells, and about CELL tokens to a cell below that.
SKETCH_BITS, CELL = 22, 64
#: Cells count as frequent in a task from this many times its mean.
FREQUENT = 4
#: Groups that may share a token for all their pairs to be counted there; of tokens that more share, only pairs within the bound are made.
SHARED_GROUPS = 64
#: Rows of (row, ...) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Texts a task remembers, so as to keep the tokens of copies once.
SEEN = 200_000


def token_set(text: str | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """(hash of the word sequence, signed; sorted 48-bit hashes of the distinct shingles): of fewer words the whole sequence, without words none."""
    words = _words(text)
    node = int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words), SEED)).view(np.int64))
    slices = list(shingle_hashes(words, width))
    return node, np.unique(np.concatenate(slices) >> np.uint64(64 - 8 * TOKEN_BYTES)) if slices else np.array([], np.uint64)


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    whole = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    whole[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return whole.view("<u8").ravel()


def _sets(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, groups, tokens = [], [], [], []
            for text in batch.column("text"):
                node, found = token_set(text.as_py(), width)
                nodes.append(node)
                sizes.append(len(found))
                groups.append(int((found * np.uint64(0x9E3779B97F4A7C15)).min().view(np.int64)) if len(found) else None)
                tokens.append(None if node in seen or not len(found) else pack(found))
                if len(seen) < SEEN:
                    seen.add(node)
            columns = [batch.column("doc_id"), nodes, sizes, groups, tokens]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class Block:
    """Members' tokens as a token-group matrix of one group: the union of tokens, and which members have each."""

    def __init__(self, tokens: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(tokens)), self.sizes)[order]
        self.union, starts = np.unique(flat[order], return_index=True)
        self.bounds, self.owner = np.append(starts, len(flat)), owner

    def central(self) -> np.ndarray:
        """Of each member how many members have a token of it, on average."""
        many = np.diff(self.bounds)
        return np.bincount(self.owner, np.repeat(many, many), len(self.sizes)) / self.sizes

    def linked(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with these tokens; none without opening if the union holds too few of them."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if 100 * len(at) < percent * len(tokens):
            return at[:0]
        lo, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        both = np.bincount(self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(tokens) - both))


def _tokens(column: pd.Series) -> list[np.ndarray]:
    return [unpack(t) for t in column]


def _grouped(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Parts (key, rows) of a partition sorted by a column; a key's rows may come in several parts."""
    for batch in batches:
        yield from batch.groupby(column, sort=False)


def _lead(percent: int):
    """Over a partition sorted by block: (u, v) links of members with the leader they were first found to link with, and of leaders with one member of each other star.

    Members go by how common their tokens are in the block, the most central first. So what links is missed only between members that
    both hang on leaders, of stars that no leader's links connect; a group of near copies falls into few groups.
    """

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nodes, tokens = rows["node"].to_numpy(), _tokens(rows["tokens"])
        if len(rows) < 2:
            return
        block, free, star, u, v = Block(tokens), np.ones(len(rows), bool), np.arange(len(rows)), [], []
        for k in np.lexsort((nodes, -block.central())):
            if free[k]:
                free[k] = False
                found = block.linked(tokens[k], percent)
                held = found[~free[found] & (star[found] != k)]
                stars, first = np.unique(star[held], return_index=True)
                found = found[free[found]]
                free[found] = False
                star[found] = k
                if len(stars):
                    star[np.isin(star, stars)] = k
                found = np.concatenate([found, held[first]])
                u.append(nodes[found])
                v.append(np.full(len(found), nodes[k]))
        yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, size = [], None, 0
        for key, rows in _grouped(batches, "block"):
            more = int(rows["tokens"].str.len().sum())
            if held and (key != now or size + more > 4 * BLOCK_BYTES):  # parts of an uneven block are met as other groups are
                yield from links(pd.concat(held))
                held, size = [], 0
            now = key
            held.append(rows)
            size += more
        if held:
            yield from links(pd.concat(held))

    return run


def _open(percent: int):
    """Over a partition sorted by (block, tag): members first, then queries. Gives (u, v) links of queries, one a query and block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, members, block, nodes = None, [], None, None
        for key, rows in _grouped(batches, "block"):
            if key != now:
                now, members, block = key, [], None
            own = rows["tag"] == 0
            if own.any():
                members.append(rows[own])
            queries = rows[~own]
            if not len(queries) or not members:
                continue
            if block is None:
                whole = pd.concat(members)
                nodes, block = whole["node"].to_numpy(), Block(_tokens(whole["tokens"]))
            u, v = [], []
            for node, tokens in zip(queries["node"], _tokens(queries["tokens"]), strict=True):
                found = block.linked(tokens, percent)
                if len(found):
                    u.append(node)
                    v.append(nodes[found[0]])
            yield pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return run


def _order(sets: DataFrame, total: int) -> np.ndarray:
    """Of each cell of token hashes a count: exact for none, larger for cells with frequent tokens. A table of bounded size."""
    bits = int(min(SKETCH_BITS, max(10, np.ceil(np.log2(max(total, 1) / CELL)))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for data in batch.column("tokens"):
                np.add.at(counts, unpack(data.as_py()) >> np.uint64(8 * TOKEN_BYTES - bits), 1)
        at = np.flatnonzero(counts > FREQUENT * (counts.mean() + 1))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})

    rows = sets.select("tokens").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(1 << bits, np.uint32)
    for cell, n in rows:
        cells[cell] = min(n, 2**32 - 1)
    return cells


def prefix(tokens: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which a link with a set of at most this size shares one: rare cells first, then by hash."""
    rank = cells[tokens >> np.uint64(8 * TOKEN_BYTES - int(np.log2(len(cells))))]
    n = len(tokens) - -(-percent * len(tokens) // 100) + 1
    if n < len(tokens) // 4:  # no full sort for the few
        edge = np.partition(rank, n - 1)[n - 1]
        kept = np.flatnonzero(rank <= edge)
        return tokens[kept[np.lexsort((tokens[kept], rank[kept]))][:n]]
    return tokens[np.lexsort((tokens, rank))[:n]]


def _prefixes(cells, percent: int):
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(t.as_py()) for t in batch.column("tokens")]
            heads = [prefix(t, cells.value, percent) for t in found]
            if not heads:
                continue
            sizes = [len(h) for h in heads]
            columns = [
                np.concatenate(heads).view(np.int64), np.repeat(batch.column("node").to_numpy(), sizes),
                np.repeat([len(t) for t in found], sizes), np.concatenate([np.arange(n) for n in sizes]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has few rows (counted before)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _opened(sets: DataFrame, nodes: DataFrame, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(node, grp) pairs of queries and groups -> (u, v) links; members: (node, grp) of groups with several, others are their own."""
    wanted_groups = materialize(pairs.groupBy("grp").agg(F.count("*").alias("n")), "wanted")
    several = members.join(wanted_groups, "grp")
    alone = wanted_groups.join(members.select("grp").distinct(), "grp", "left_anti").select("grp", F.col("grp").alias("node"), "n")
    deals = F.ceil(F.col("n") / QUERIES).cast("int")
    own = several.select("node", "grp", "n").unionByName(alone.select("node", "grp", "n"))
    own = own.select("node", F.lit(0).alias("tag"), "grp", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    asked = pairs.join(wanted_groups, "grp").select("node", F.lit(1).alias("tag"), "grp", F.pmod(F.xxhash64("node"), deals).cast("int").alias("deal"))
    roles = materialize(own.unionAll(asked).join(nodes.select("node", "row"), "node"), "roles")
    rows = sets.select("row", "tokens").join(_small(roles, roles.count()), "row").select(F.xxhash64("grp", "deal").alias("block"), "tag", "node", "tokens")
    return rows.repartition("block").sortWithinPartitions("block", "tag").mapInPandas(_open(percent), "u long, v long")


def links(sets: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row, node, tokens) and (node, row, n, grp) -> (u, v): links that connect exactly the nodes that links connect.

    First the nodes of equal minimum hash meet, in blocks of bounded bytes, and hang on leaders they link with; these are the
    groups. Then every node meets the groups, but for its own, with which it shares a token of both prefixes. Of the
    nodes of one group one goes first; the others go only to groups that are not connected with theirs by then. Until then only
    groups are paired, so a group of copies counts once.
    """
    spark = sets.sparkSession
    total = nodes.agg(F.sum("n")).first()[0] or 0
    meet = nodes.groupBy("grp").agg(F.count("*").alias("many"), F.ceil(F.sum("n") * TOKEN_BYTES / BLOCK_BYTES).cast("int").alias("blocks")).where("many > 1")
    meet = materialize(meet, "meet")
    routed = spread_join(nodes, meet, "grp", "many", nodes.count())
    routed = materialize(routed.select("row", "node", F.xxhash64("grp", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "routed")
    met = sets.select("row", "tokens").join(_small(routed, routed.count()), "row").select("block", "node", "tokens")
    led = materialize(met.repartition("block").sortWithinPartitions("block").mapInPandas(_lead(percent), "u long, v long"), "led")
    members = materialize(connected_components(led).select("node", F.col("root").alias("grp")), "groups")

    cells = spark.sparkContext.broadcast(_order(sets, total))
    heads = sets.select("node", "tokens").mapInArrow(_prefixes(cells, percent), "token long, node long, n int, pos int")
    shared = heads.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    shared = materialize(shared, "shared")
    hits = heads.join(shared, "token").distinct()
    hits = materialize(hits.join(members, "node", "left").withColumn("grp", F.coalesce("grp", "node")), "hits")
    index = hits.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.expr("n - pos")).alias("after"), F.min("node").alias("node"))
    # Of a set and one no larger, the first shared token and what either has after it bound the overlap (ahead); so do tokens of both
    # prefixes (least). Of groups, the largest bound of any two members. Sets that link are ahead at their first shared token, so tokens
    # of many groups pair only those; what they may add to the tokens of both is bounded by how many of them either group has.
    many = F.count("*").over(Window.partitionBy("token")) > SHARED_GROUPS
    index = materialize(index.withColumn("many", many), "index")
    often = materialize(index.where("many").groupBy("grp").agg(F.count("*").alias("often")), "often")
    least = f"greatest(i.low, ceil({percent} * q.low / 100))"
    wanted = f"ceil({percent} * (q.low + {least}) / {100 + percent}) - ceil({percent} * q.low / 100) + 1"
    one_size = F.when(F.expr("q.low = q.high"), F.expr(wanted)).otherwise(F.lit(1))
    ahead = f"{100 + percent} * least(q.after, i.after) >= {percent} * (q.low + {least})"
    alike = F.expr(f"q.token = i.token and q.grp <> i.grp and i.low <= q.high and 100 * i.high >= {percent} * q.low and (not q.many or {ahead})")
    met = index.alias("q").join(index.alias("i"), alike).select(
        "q.token", "q.node", F.col("q.grp").alias("own"), "i.grp", "i.low", "i.high", "i.after", "q.many", F.expr(ahead).alias("ahead"), one_size.alias("least")
    )
    first = met.groupBy("own", "grp").agg(F.count_if(~F.col("many")).alias("hits"), F.max("ahead").alias("ahead"), F.min("least").alias("least"), F.min("node").alias("node"))
    of_own, of_grp = (often.select(F.col("grp").alias(c), F.col("often").alias(f"{c}_often")) for c in ("own", "grp"))
    first = first.where("ahead").join(of_own, "own", "left").join(of_grp, "grp", "left")
    first = materialize(first.where("hits + least(coalesce(own_often, 0), coalesce(grp_often, 0)) >= least").select("own", "grp", "node"), "first")
    found = materialize(_opened(sets, nodes, members, first.select("node", "grp"), percent), "found")
    of_groups = found.join(members, F.col("u") == F.col("node"), "left").select(F.coalesce("grp", "u").alias("u"), "v")
    of_groups = of_groups.join(members, F.col("v") == F.col("node"), "left").select("u", F.coalesce("grp", "v").alias("v"))
    roots = connected_components(of_groups)
    named = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("own", "grp")]
    rest = first.join(named[0], "own", "left").join(named[1], "grp", "left").where("coalesce(own_root, own) <> coalesce(grp_root, grp)")
    rest = met.where("ahead").select("token", "own", "grp", "low", "high", "after").join(rest.select("own", "grp", F.col("node").alias("tried")), ["own", "grp"])
    each = hits.select("token", "node", F.col("grp").alias("own"), "n", "pos").join(rest, ["token", "own"]).where(F.expr(
        f"node <> tried and low <= n and 100 * high >= {percent} * n and {100 + percent} * least(n - pos, after) >= {percent} * (n + greatest(low, ceil({percent} * n / 100)))"
    ))
    rest = materialize(each.select("node", "grp").distinct(), "rest")
    more = materialize(_opened(sets, nodes, members, rest, percent), "more")
    return led.unionAll(found).unionAll(more)


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), a row for each row.

    Texts of equal words (A-Z in lower case) are one node, told by a 64-bit hash; shingles are 48-bit hashes. Null, empty and
    wordless texts have an empty set, link with nothing and are their own component, as are their repeats; other repeated
    rows link. component_id is the smallest non-null doc_id of all that links reach. Whole texts of any length; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("node", pa.int64()), ("n", pa.int64()), ("grp", pa.int64()), ("tokens", pa.binary())])
    with small_batches(docs.sparkSession):
        raw = docs.select("doc_id", "text").mapInArrow(_sets(width, schema), f"doc_id {kind.simpleString()}, node long, n long, grp long, tokens binary")
        table = materialize(raw.withColumn("row", F.monotonically_increasing_id()), "sets")
        sets = table.where("tokens is not null").select("row", "node", "tokens")
        nodes = table.where("tokens is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("grp").alias("grp"))
        roots = connected_components(links(sets, materialize(nodes, "nodes"), percent))
    rows = table.select("doc_id", "node", "n")
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
    least = materialize(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "least")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes"))
    total = rows.count()
    named = materialize(spread_join(least, ids, "root", "n_nodes", total).select("node", "component_id", "n_rows"), "named")
    linked = spread_join(rows.where("n > 0"), named, "node", "n_rows", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
