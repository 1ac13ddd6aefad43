"""Goal-driven relevance, budgets and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.staging import staged

#: Points and tiers (fixed values).
STEM, FOLDER, SYMBOL, PACKABLE = 10, 5, 8, 3
HIGH, MEDIUM = 10, 3
#: Extensions of sources worth packing (fixed values).
PACKABLE_EXTENSIONS = ("go", "ts", "tsx", "js", "jsx", "mjs", "py", "rs", "md", "toml", "json", "yaml", "yml")
#: Goal words that ask for documentation (fixed values).
DOC_WORDS = ("doc", "docs", "document", "documentation", "readme", "仕様", "ドキュメント", "説明")
#: Points of a role (fixed values).
ROLE_POINTS = {"entry": 3, "core": 2, "route": 2, "config": 1, "test": -1}


def is_generated(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return low.rlike(r"(?:^|/)(?:dist|build|node_modules)/")


def is_packable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*PACKABLE_EXTENSIONS)


def role_points(role: Column, terms: list[str]) -> Column:
    points = F.when(role == "doc", 3 if set(terms) & set(DOC_WORDS) else -2)
    for name, n in ROLE_POINTS.items():
        points = points.when(role == name, n)
    return points.otherwise(0)


def score(files: DataFrame, symbols: DataFrame, goal: str) -> DataFrame:
    """files (path, tokens, ...) -> (path, tokens, score, tier, reason): each term's stem, folder and first symbol, and the role.

    A term scores once for all symbols of a file, so symbols reduce to one flag a term and path before the join.
    """
    terms = T.goal_terms(goal)
    path = F.col("path")
    role = T.role(path)
    if not terms:
        scored = files.select("path", "tokens", (F.when(is_packable(path), PACKABLE).otherwise(0) + role_points(role, terms)).cast("long").alias("score"))
    else:
        name = F.lower("name")
        held = reduce(lambda a, b: a | b, [name.contains(t) for t in terms])
        flags = symbols.where(held).groupBy("path").agg(*[F.max(name.contains(t)).alias(f"s{k}") for k, t in enumerate(terms)])
        stem, folder = F.lower(T.stem(path)), F.lower(T.dirname(path))
        total = role_points(role, terms)
        for k, t in enumerate(terms):
            total = total + F.when(stem.contains(t), STEM).otherwise(0) + F.when((folder != ".") & folder.contains(t), FOLDER).otherwise(0)
            total = total + F.when(F.coalesce(f"s{k}", F.lit(False)), SYMBOL).otherwise(0)
        scored = files.join(flags, "path", "left").select("path", "tokens", total.cast("long").alias("score"))
    tier = F.when(F.col("score") >= HIGH, "High").when(F.col("score") >= MEDIUM, "Medium").otherwise("")
    out = F.when(F.col("score") >= MEDIUM, "").when(is_generated(path), "generated").when(F.col("score") == 0, "outside goal scope").otherwise("low relevance")
    return scored.select("path", "tokens", "score", tier.alias("tier"), out.alias("reason"))


def rank(scored: DataFrame, n: int) -> DataFrame:
    """The n best of those in a tier: score, then path."""
    return scored.where("tier <> ''").orderBy(F.desc("score"), "path").limit(n)


def gap(scored: DataFrame) -> DataFrame:
    """What a path lacks to the next tier; nothing at the top."""
    need = F.when(F.col("score") >= HIGH, 0).when(F.col("score") >= MEDIUM, HIGH - F.col("score")).otherwise(MEDIUM - F.col("score"))
    return scored.select("path", "score", "tier", need.cast("long").alias("gap"))


def greedy(items: DataFrame, budget: int, order: list[str], group: list[str] | None = None) -> DataFrame:
    """items (path, tokens, ...) with `taken` and `used`: in order, then by path, a row is taken if it still fits, else passed over.

    Each decision depends on all before it, yet no task sees a whole group: with `rest` left, every row of up to half of it fits
    until less than half is left, so those are taken by their prefix sum; of larger ones the first that fits where it stands
    is taken. Either leaves half at most, so the rounds are log2(budget) at most, whatever the rows. Rows are sorted once; prefix sums
    add up within the parts of that sort, and over one sum a part. tokens are 0 or more.
    """
    keys = group or []
    by = [*keys, *order, *([] if "path" in order else ["path"])]
    owner = F.to_json(F.struct(*keys)) if keys else F.lit("")
    marks = {"_owner": owner, "_pos": F.monotonically_increasing_id()}
    rows = staged(items.orderBy(*by).withColumns(marks))
    narrow = rows.select("_owner", "_pos", F.col("tokens").alias("_tokens"))
    state = narrow.select("_owner").distinct().select("_owner", F.lit(0).cast("long").alias("_used"), F.lit(-1).cast("long").alias("_lo"))
    phases, done = [], False
    while not done:
        live = narrow.join(state, "_owner").where(f"_pos > _lo and _tokens <= {budget} - _used")
        rest = F.lit(budget) - F.col("_used")
        live = live.withColumns({"_rest": rest, "_small": F.col("_tokens") * 2 <= rest})
        summed = _running(live, F.when(F.col("_small"), F.col("_tokens")).otherwise(0))
        half = F.when(F.col("_small"), (F.col("_sum") * 2 >= F.col("_rest")) & (F.col("_rest") > 0)).otherwise(F.col("_tokens") <= F.col("_rest") - F.col("_sum"))
        events = summed.where(half).groupBy("_owner").agg(
            F.min_by(F.struct(F.col("_pos").alias("hi"), (F.col("_sum") + F.when(F.col("_small"), 0).otherwise(F.col("_tokens"))).alias("taken")), "_pos").alias("_event")
        )
        turn = staged(state.join(events, "_owner", "left").select("_owner", "_used", "_lo", F.col("_event.hi").alias("_hi"), "_event.taken"))
        phases.append(turn)
        state = turn.where("_hi is not null").select("_owner", (F.col("_used") + F.col("taken")).alias("_used"), F.col("_hi").alias("_lo"))
        done = state.isEmpty()
    spans = reduce(DataFrame.unionAll, phases).withColumnRenamed("_used", "_before").select("_owner", "_before", "_lo", "_hi")
    told = rows.join(spans, "_owner").where("_pos > _lo and (_hi is null or _pos <= _hi)")
    fits = (F.col("tokens") * 2 <= F.lit(budget) - F.col("_before")) | F.coalesce(F.col("_pos") == F.col("_hi"), F.lit(False))
    told = _running(told.withColumn("taken", fits), F.when(F.col("taken"), F.col("tokens")).otherwise(0))
    return told.select(*items.columns, "taken", F.col("_sum").cast("long").alias("used"))


def _running(rows: DataFrame, value: Column) -> DataFrame:
    """rows with `_sum`: of an owner the values up to each row in order of _pos, whose high bits are the part of the sort a row is in."""
    part = F.shiftright("_pos", 33).alias("_part")
    valued = rows.withColumns({"_part": part, "_value": value.cast("long")})
    sums = valued.groupBy("_owner", "_part").agg(F.sum("_value").alias("_whole"))
    ahead = F.sum("_whole").over(Window.partitionBy("_owner").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    offsets = sums.select("_owner", "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    own = F.sum("_value").over(Window.partitionBy("_owner", "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return valued.withColumn("_own", own).join(offsets, ["_owner", "_part"]).withColumn("_sum", F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", "_value", "_part")


#: Budget order of roles (fixed values): lower first.
ROLE_ORDER = {"entry": 0, "core": 0, "route": 0, "config": 0, "test": 1, "util": 1, "other": 1}


def role_order(role: Column) -> Column:
    first = F.lit(2)
    for name, n in ROLE_ORDER.items():
        first = F.when(role == name, n).otherwise(first)
    return first


def budget_plan(files: DataFrame, budget: int) -> DataFrame:
    """(path, tokens, status): binary without tokens, generated, too large over half the budget; else included or over budget.

    Order is role, tokens, path. Within a role sizes ascend, so once one does not fit no later one of that role does: each
    role has a size up to which all fit, and at that size a number of paths. Both follow from the counts of each size, of
    which there are at most half the budget a role; only those come to the driver. No task sees all files in order.
    """
    path, tokens = F.col("path"), F.col("tokens")
    why = F.when(tokens <= 0, "binary").when(is_generated(path), "generated").when(tokens > budget / 2, "too large")
    marked = files.select("path", "tokens", why.alias("why"), role_order(T.role(path)).alias("rank"))
    fit = marked.where("why is null")
    used, edge = 0, {}
    for r in sorted(fit.groupBy("rank", "tokens").agg(F.count("*").alias("n")).collect()):
        if r["rank"] not in edge:
            n = min(r["n"], (budget - used) // r["tokens"])
            used += n * r["tokens"]
            if n < r["n"]:
                edge[r["rank"]] = (r["tokens"], n)
    below, last = F.lit(True), None
    for rank, (size, n) in edge.items():
        below = F.when(F.col("rank") == rank, tokens < size).otherwise(below)
        some = fit.where((F.col("rank") == rank) & (tokens == size)).orderBy("path").limit(n).select("path")
        last = some if last is None else last.unionAll(some)
    marked_fit = fit.withColumn("below", below)
    if last is not None:
        marked_fit = marked_fit.join(last.withColumn("edge", F.lit(True)), "path", "left").withColumn("below", F.col("below") | F.coalesce("edge", F.lit(False)))
    taken = marked_fit.select("path", "tokens", F.when(F.col("below"), "included").otherwise("over budget").alias("status"))
    return taken.unionAll(marked.where("why is not null").select("path", "tokens", F.col("why").alias("status")))


def budget_groups(plan: DataFrame) -> DataFrame:
    """Excluded rows by folder: three or more become `folder/**` with summed tokens; differing reasons are one phrase."""
    rows = plan.where("status <> 'included'").withColumn("folder", T.dirname(F.col("path")))
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("folder")))
    key = F.when(F.col("n") >= 3, F.concat("folder", F.lit("/**"))).otherwise(F.col("path"))
    return sized.groupBy(key.alias("item")).agg(
        F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("files"),
        F.when(F.min("status") == F.max("status"), F.min("status")).otherwise("multiple reasons").alias("reason"),
    )


def plan_fit(files: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(plan, total, percent, fits): all tokens against each named limit, percent rounded half up."""
    total = files.agg(F.sum("tokens").cast("long").alias("total"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("plan"), F.lit(v).cast("long").alias("limit")) for k, v in limits.items()]))
    each = total.select("total", names.alias("p")).select("p.plan", "total", "p.limit")
    return each.select("plan", "total", F.floor(F.col("total") / F.col("limit") * 100 + 0.5).cast("long").alias("percent"), (F.col("total") <= F.col("limit")).alias("fits"))
