"""Content contracts, references in responses, and their verification; snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Extensions that make a word a path reference (fixed values).
EXTENSIONS = ("go", "ts", "tsx", "js", "jsx", "mjs", "py", "rs", "java", "kt", "rb", "swift", "md", "toml", "yaml", "yml", "json", "sh", "sql")
_ENDINGS = "(?i:" + "|".join(sorted(EXTENSIONS, key=len, reverse=True)) + ")"
#: A path with optional lines, a back-ticked symbol, a diff header (fixed values).
PATH_REFERENCE = r"[A-Za-z_][A-Za-z0-9._/-]*\." + _ENDINGS + r"(?::L?\d+(?:-L?\d+)?)?"
SYMBOL_REFERENCE = "`([A-Za-z_][A-Za-z0-9_.]*)`"
DIFF_HEADER = r"^\+\+\+[\t\n\f\r ]+b/([^\t\n\f\r ]+)"
#: Order of tiers (fixed values).
TIERS = {"High": 3, "Medium": 2, "Low": 1}


def line_hashes(files: DataFrame) -> DataFrame:
    """files (path, body) -> (path, line, sha): lines with their terminators."""
    hashes = F.transform(T.logical_lines(F.col("body")), lambda x: F.sha2(x, 256))
    return files.select("path", F.posexplode(hashes).alias("at", "sha")).select("path", (F.col("at") + 1).alias("line"), "sha")


def build(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files (path, body) -> (path, line_start, line_end, sha, line_shas, symbols): sorted distinct symbols; one row a path."""
    names = symbols.groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("symbols"))
    hashes = F.transform(T.logical_lines(F.col("body")), lambda x: F.sha2(x, 256))
    rows = files.select("path", F.least(F.lit(1), F.size(hashes)).alias("line_start"), F.size(hashes).alias("line_end"), F.sha2("body", 256).alias("sha"), hashes.alias("line_shas"))
    return rows.join(names, "path", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def range_sha(hashes: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, sha) and (path, first, last) -> (path, first, last, sha): digest of the lines' digests; null if a line is missing."""
    both = spans.join(hashes, "path").where(F.col("line").between(F.col("first"), F.col("last")))
    parts = both.groupBy("path", "first", "last").agg(F.array_sort(F.collect_list(F.struct("line", "sha"))).alias("x"))
    whole = F.size("x") == F.col("last") - F.col("first") + 1
    made = parts.select("path", "first", "last", F.when(whole, F.sha2(F.array_join("x.sha", ""), 256)).alias("sha"))
    return spans.join(made, ["path", "first", "last"], "left")


def span_labels(shown: DataFrame) -> DataFrame:
    """(path, line) -> (path, label): runs of lines as `a-b`, comma-joined."""
    w = Window.partitionBy("path").orderBy("line")
    runs = shown.distinct().withColumn("run", F.col("line") - F.row_number().over(w)).groupBy("path", "run").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("a", label.alias("label"))))["label"], ", ").alias("label"))


def references(responses: DataFrame) -> DataFrame:
    """(id, text) -> (id, kind, path, line_start, line_end, symbol, source_line), each once: diff headers end a line's search."""
    lines = responses.select("id", F.posexplode(T.split_lines(F.col("text"))).alias("at", "line")).where(F.octet_length("line") <= 1 << 20)
    header = F.regexp_extract("line", DIFF_HEADER, 1)
    none, void = F.lit(None).cast("string"), F.lit(None).cast("int")

    def row(kind: Column, path: Column, a: Column, b: Column, symbol: Column) -> Column:
        return F.struct(kind.alias("kind"), path.alias("path"), a.alias("line_start"), b.alias("line_end"), symbol.alias("symbol"))

    def cited(ref: Column) -> Column:
        a = F.regexp_extract(ref, r":L?(\d+)", 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(ref, r"-L?(\d+)$", 1).try_cast("int"), a)
        path = F.when(a.isNotNull(), F.regexp_replace(ref, r":L?\d+(?:-L?\d+)?$", "")).otherwise(ref)
        return row(F.when(a.isNotNull(), "line-range").otherwise("file"), path, a, F.when(a.isNotNull(), b), none)

    paths = F.transform(F.regexp_extract_all("line", F.lit("(" + PATH_REFERENCE + ")"), F.lit(1)), cited)
    names = F.filter(F.regexp_extract_all("line", F.lit(SYMBOL_REFERENCE), F.lit(1)), lambda s: ~s.rlike(r"\." + _ENDINGS + "$"))
    symbols = F.transform(names, lambda s: row(F.lit("symbol"), none, void, void, s))
    found = F.when(header != "", F.array(row(F.lit("diff-header"), header, void, void, none))).otherwise(F.concat(paths, symbols))
    each = lines.select("id", F.explode(found).alias("r"), (F.col("at") + 1).alias("source_line"))
    return each.select("id", "r.*", "source_line").distinct()


def verify(contract: DataFrame, refs: DataFrame) -> DataFrame:
    """References with `verdict`: ok, out-of-context, stale-content or phantom-symbol.

    Paths meet the contract exactly (a leading `./` goes), else without regard to case; symbols whole, else their last part.
    """
    path = F.regexp_replace("path", r"^\./", "")
    exact = contract.select(F.col("path").alias("exact"), F.col("line_start").alias("e_start"), F.col("line_end").alias("e_end"))
    folded = contract.groupBy(F.lower("path").alias("folded")).agg(F.min(F.struct("path", "line_start", "line_end")).alias("f"))
    names = contract.select(F.explode("symbols").alias("known")).distinct()
    with_path = refs.withColumn("key", path).join(exact, F.col("key") == F.col("exact"), "left").join(folded, F.lower("key") == F.col("folded"), "left")
    first, last = F.coalesce("e_start", "f.line_start"), F.coalesce("e_end", "f.line_end")
    tail = names.select(F.col("known").alias("tail"))
    both = with_path.join(names, F.col("symbol") == F.col("known"), "left").join(tail, F.substring_index("symbol", ".", -1) == F.col("tail"), "left")
    in_span = (F.least("line_start", "line_end") >= first) & (F.greatest("line_start", "line_end") <= last)
    verdict = (
        F.when(F.col("kind") == "symbol", F.when(F.col("known").isNotNull() | F.col("tail").isNotNull(), "ok").otherwise("phantom-symbol"))
        .when(first.isNull(), "out-of-context")
        .when((F.col("kind") == "line-range") & ~in_span, "stale-content")
        .otherwise("ok")
    )
    return both.select(*refs.columns, verdict.alias("verdict"))


def build_partial(shown: DataFrame) -> DataFrame:
    """(path, line, sha) of the lines a pack shows -> (path, line_start, line_end, sha, line_shas): the digest is of the shown lines' digests, in order."""
    rows = shown.groupBy("path").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.array_sort(F.collect_list(F.struct("line", "sha"))).alias("x"))
    return rows.select("path", "line_start", "line_end", F.sha2(F.array_join("x.sha", ""), 256).alias("sha"), F.col("x.sha").alias("line_shas"))


def partial_cover(cited: DataFrame, shown: DataFrame) -> DataFrame:
    """Ranges (path, line_start, line_end, ...) with `covered`: every line of the range, in either order, is shown (path, line).

    Runs of shown lines and the ranges go through one sorted pass a path, so they never meet as pairs. A line below 1 is not covered.
    """
    w = Window.partitionBy("path").orderBy("line")
    runs = shown.select("path", "line").distinct().withColumn("run", F.col("line") - F.row_number().over(w)).groupBy("path", "run").agg(F.min("line").alias("at"), F.max("line").alias("end"))
    names = cited.columns
    ranges = cited.select("path", F.least("line_start", "line_end").alias("at"), F.lit(None).cast("int").alias("end"), F.lit(1).alias("k"), F.struct(*names).alias("r"))
    both = ranges.unionByName(runs.select("path", "at", F.col("end").cast("int").alias("end"), F.lit(0).alias("k")), allowMissingColumns=True)
    reach = F.max("end").over(Window.partitionBy("path").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0))
    high = F.greatest("r.line_start", "r.line_end")
    covered = F.coalesce((F.col("at") > 0) & (F.col("reach") >= high), F.lit(False))
    return both.withColumn("reach", reach).where("k = 1").select("r.*", covered.alias("covered"))


def partial_staleness(shown: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """Shown lines and lines now (path, line, sha), and paths now -> (path, state): missing file, stale if a shown line is gone or differs, else fresh."""
    now = current.select("path", "line", F.col("sha").alias("now"))
    same = shown.join(now, ["path", "line"], "left").groupBy("path").agg(F.bool_and(F.coalesce(F.col("sha") == F.col("now"), F.lit(False))).alias("same"))
    there = files.select("path", F.lit(True).alias("there")).distinct()
    state = F.when(F.col("there").isNull(), "missing").when(F.col("same"), "fresh").otherwise("stale")
    return same.join(there, "path", "left").select("path", state.alias("state"))


def from_manifest(manifest: DataFrame) -> DataFrame:
    """(path, sha) of a saved manifest -> whole-file contract rows, any line inside; blank paths are left out, backslashes become slashes."""
    rows = manifest.where(F.trim("path") != "")
    none = F.array().cast("array<string>")
    return rows.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.lit(1).alias("line_start"), F.lit(1 << 30).alias("line_end"), "sha", none.alias("line_shas"), none.alias("symbols"))


def without_references(responses: DataFrame, refs: DataFrame) -> DataFrame:
    """Responses (id, text) without any reference: under strict rules each is a violation of its own."""
    return responses.join(refs.select("id").distinct(), "id", "left_anti").select("id", F.lit("no-references").alias("verdict"))


def last_entries(entries: DataFrame) -> DataFrame:
    """(path, ord, ...) -> the last entry of each path."""
    rest = [c for c in entries.columns if c not in ("path", "ord")]
    return entries.groupBy("path").agg(F.max_by(F.struct(*rest), "ord").alias("x")).select("path", "x.*")


def diff(base: DataFrame, current: DataFrame, strict: bool = False) -> DataFrame:
    """Snapshots (path, sha, tokens) -> (path, kind, token_delta): added, removed, modified or unchanged; strict: other tokens alone modify."""
    a = base.select("path", F.col("sha").alias("a_sha"), F.col("tokens").alias("a_tokens"))
    b = current.select("path", F.col("sha").alias("b_sha"), F.col("tokens").alias("b_tokens"))
    same = F.col("a_sha") == F.col("b_sha")
    same = same & (F.col("a_tokens") == F.col("b_tokens")) if strict else same
    kind = F.when(F.col("a_sha").isNull(), "added").when(F.col("b_sha").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    delta = F.coalesce("b_tokens", F.lit(0)) - F.coalesce("a_tokens", F.lit(0))
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind"), delta.cast("long").alias("token_delta"))


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("files"), F.sum("token_delta").cast("long").alias("token_delta"))


def _tier(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), c), F.lit(0))


def selection_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshots (path, score, tier, tokens) -> (path, category, token_delta): added, removed, promoted, demoted, or score changed by 30 % or more."""
    a = base.select("path", *[F.col(c).alias("a_" + c) for c in ("score", "tier", "tokens")])
    b = current.select("path", *[F.col(c).alias("b_" + c) for c in ("score", "tier", "tokens")])
    at, bt = _tier(F.col("a_tier")), _tier(F.col("b_tier"))
    moved = F.abs(F.col("b_score") - F.col("a_score")) / F.greatest(F.abs("a_score"), F.lit(1)) >= 0.3
    category = (
        F.when(F.col("a_tier").isNull(), "added").when(F.col("b_tier").isNull(), "removed").when(bt > at, "promoted").when(bt < at, "demoted").when(moved, "score_changed")
    )
    delta = F.coalesce("b_tokens", F.lit(0)) - F.coalesce("a_tokens", F.lit(0))
    return a.join(b, "path", "full_outer").select("path", category.alias("category"), delta.cast("long").alias("token_delta")).where("category is not null")


def changed_since(files: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """files that were added or modified since a snapshot."""
    return files.join(diff(base, current).where("kind in ('added', 'modified')").select("path"), "path", "left_semi")


def prune(manifests: DataFrame, cutoff: Column) -> DataFrame:
    """(id, created_at string) -> those to keep: not older than the cutoff, and those whose time can't be read."""
    at = F.col("created_at").try_cast("timestamp")
    return manifests.where(at.isNull() | (at >= cutoff))


def embed(contracts: DataFrame) -> DataFrame:
    """(id, body, contract struct) -> (id, text): the contract as a comment at the end of a pack's text."""
    return contracts.select("id", F.concat("body", F.lit("\n<!-- contract:"), F.to_json("contract"), F.lit(" -->\n")).alias("text"))


def parse_embedded(packs: DataFrame, schema: str) -> DataFrame:
    """(id, text) -> (id, contract): of the last block that can be read."""
    blocks = F.regexp_extract_all("text", F.lit(r"<!-- contract:(\{.*?\}) -->"), F.lit(1))
    good = F.filter(F.transform(blocks, lambda b: F.from_json(b, schema)), lambda c: c.isNotNull())
    return packs.select("id", F.try_element_at(good, F.lit(-1)).alias("contract"))
